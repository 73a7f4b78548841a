"""``python -m loomwell list`` names the queries; ``python -m loomwell run NAME TABLES OUT`` writes one's result as Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from loomwell.plans.registry import ORACLE_SQL, QUERIES


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomwell")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    for name in ("name", "tables", "out"):
        run.add_argument(name)
    run.add_argument("--overwrite", action="store_true")
    got = parser.parse_args(args)
    if got.command == "list":
        for n in QUERIES:
            print(n, "" if n in ORACLE_SQL else "(no SQL)")
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    QUERIES[got.name](spark, got.tables).write.mode("overwrite" if got.overwrite else "errorifexists").parquet(got.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
