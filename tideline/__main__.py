"""python -m tideline list | run QUERY DIR OUT: name the queries, or write one query's result as Parquet."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from tideline.plans.queries import QUERIES

    if args[:1] == ["list"]:
        print("\n".join(QUERIES))
        return 0
    if len(args) != 4 or args[0] != "run" or args[1] not in QUERIES:
        print(__doc__)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"tideline {args[1]}").getOrCreate()
    QUERIES[args[1]](spark, args[2]).write.mode("errorifexists").parquet(args[3])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
