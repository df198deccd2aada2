"""python -m pagewright.sources --benchmark|--script|--orientation FOLDER: write a corpus."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from pagewright.cluster import ship
from pagewright.sources import corpora


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pagewright.sources")
    which = parser.add_mutually_exclusive_group(required=True)
    for name in corpora.CORPORA:
        which.add_argument(f"--{name}", dest="name", action="store_const", const=name)
    parser.add_argument("folder")
    own = parser.parse_args(argv)
    spark = SparkSession.builder.appName("pagewright-corpora").getOrCreate()
    ship(spark)
    print(f"{corpora.write(spark, own.name, own.folder)} cases of {own.name} in {own.folder}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
