"""Command line: ``python -m lexivane [--dir DIR] insert-url URL | insert-file FILE | closest TEXT | search TEXT``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lexivane.errors import EngineError
from lexivane.plans.engine import Engine


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexivane")
    parser.add_argument("--dir", default=".")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("insert-url").add_argument("what")
    commands.add_parser("insert-file").add_argument("what")
    for name, k in (("closest", 1), ("search", 5)):
        p = commands.add_parser(name)
        p.add_argument("what")
        p.add_argument("-n", "--num-results", type=int, default=k)
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("lexivane").getOrCreate()
    with Engine(spark, a.dir) as engine:
        try:
            if a.command == "insert-url":
                n = engine.ingest_urls(spark.createDataFrame([(a.what,)], "url string"))
                print("inserted" if n else "nothing inserted")
            elif a.command == "insert-file":
                print(", ".join(f"{t}: {n}" for t, n in engine.ingest_files(a.what).items()))
            else:
                (engine.closest if a.command == "closest" else engine.listing)(a.what, a.num_results).show(truncate=False)
        except EngineError as e:
            print(e, file=sys.stderr)
            return 1
        print(", ".join(f"{k}: {v:.0f} µs" for k, v in engine.last_timing().items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
