"""python -m helixframe list | run QUERY TABLES OUT [--format parquet|csv|json]: registered queries from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import registry


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="helixframe")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="the names of the queries")
    run = commands.add_parser("run", help="run a query over a folder of tables and write its rows")
    run.add_argument("query", choices=sorted(registry.queries()))
    run.add_argument("tables")
    run.add_argument("out")
    run.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
    given = parser.parse_args(arguments)
    if given.command == "list":
        print("\n".join(sorted(registry.queries())))
        return
    spark = SparkSession.builder.appName(given.query).getOrCreate()
    registry.queries()[given.query](spark, given.tables).write.format(given.format).save(given.out)


if __name__ == "__main__":
    main()
