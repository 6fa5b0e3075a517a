"""A text-similarity analytics engine on Spark."""
