"""python -m pagewright FOLDER: read the page images of a folder and print their lines."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagewright.cluster import ship
from pagewright.engine import require_files
from pagewright.errors import Refused
from pagewright.operators import catalog
from pagewright.plans.read_pages import read
from pagewright.sources.readers import images


def not_negative(text: str) -> int:
    value = int(text)
    if value < 0:
        raise argparse.ArgumentTypeError("must be 0 or more")
    return value


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pagewright")
    parser.add_argument("folder", help="a folder or pattern of images")
    parser.add_argument("--repeat", type=not_negative, default=0, help="read so many times more, and report the median time")
    parser.add_argument("--precision", choices=sorted(catalog.PRECISION), default="fp32")
    parser.add_argument("--all-gpus", action="store_true", help="read on all executors; else one task at a time")
    parser.add_argument("--models", choices=[p[0] for p in catalog.PROFILES], default=catalog.DEFAULT_PROFILE)
    parser.add_argument("--models-root", help="a folder that must hold the files of the chosen models")
    own = parser.parse_args(argv)
    spark = SparkSession.builder.appName("pagewright").getOrCreate()
    ship(spark)
    profile = catalog.profiles(spark).where(F.col("profile") == own.models).first()
    if own.models_root:
        try:
            require_files(spark, catalog.model_files(spark).where(F.col("profile") == own.models), own.models_root, ("det", "ori", "rec") if profile["orients"] else ("det", "rec"))
        except Refused as refused:
            parser.error(str(refused))
    found = images(spark, own.folder)
    found = found.repartition(spark.sparkContext.defaultParallelism) if own.all_gpus else found.coalesce(1)
    # An image's name stands for it; its hash is the key of its page. What is no image in colour is refused by the read itself.
    pages = found.select(F.xxhash64("origin").alias("page_id"), "origin", "height", "width", F.when(F.col("n_channels") == 3, F.col("data")).alias("data"))
    names = pages.select("page_id", "origin")
    times = []
    for _ in range(1 + own.repeat):
        began = time.perf_counter()
        done = read(pages, nets=("det", "ori", "rec") if profile["orients"] else ("det", "rec"), spread=None if own.all_gpus else 1)
        lines = done.lines.join(names, "page_id").orderBy("origin", "center_y", "center_x").select("origin", "text", "confidence")
        rows = lines.toLocalIterator() if not own.repeat else lines.collect()
        if not times:
            for row in rows:
                print(f"{row['origin']}\t{row['confidence']:.3f}\t{row['text']}")
            for row in done.refusals.join(names, "page_id").orderBy("origin", "region_id").toLocalIterator():
                print(f"{row['origin']}\t{row['code']}: {row['detail']}", file=sys.stderr)
        times.append(time.perf_counter() - began)
    if not done.regions + done.refused and not found.head(1):
        parser.error(f"no image in {own.folder}")
    print(f"{done.refused} refused; first read {times[0]:.2f} s" + (f", median of {own.repeat} more {sorted(times[1:])[own.repeat // 2]:.2f} s" if own.repeat else ""))
    print(f"models: {profile['detector']}, {profile['recognizer']}; precision: " + ", ".join(f"{k}={v}" for k, v in catalog.options(own.precision).items()))
    return 2 if done.refused else 0


if __name__ == "__main__":
    raise SystemExit(main())
