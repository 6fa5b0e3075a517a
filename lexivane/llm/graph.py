"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexivane.llm.shared import durable, forget


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges``, written, with their number and a hash of them all."""
    seen = Observation()
    out = durable(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "edges")
    return out, (seen.get["n"], seen.get["x"])


def components(edges: DataFrame) -> DataFrame:
    """For each node of ``edges`` (u, v: bigint) the least node of its component: ``node, root``, written.

    Alternates large-star and small-star steps, which end after a logarithmic number of rounds in practice.
    Each round's edges are written to the shared folder, and those of the one before deleted. Loops and repeated edges are fine; no edges give no rows.
    """
    e, mark = _written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after, now = _written(small.distinct())
        forget(e)
        e = after
        if now == mark:
            break
        mark = now
    out = durable(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")
    forget(e)
    return out
