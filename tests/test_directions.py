"""Patterns of code points by direction."""

import unicodedata

from pyspark.sql import functions as F

from pagewright.functions import text as tx


def test_directions_of_all_code_points(spark):
    for classes in (("R", "AL"), ("L",)):
        letters = spark.range(0x110000).where("id not between 55296 and 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
        found = {x.id for x in letters.where(F.col("c").rlike(tx._letters_of(*classes))).select("id").collect()}
        assert found == {i for i in range(0x110000) if unicodedata.bidirectional(chr(i)) in classes and not 0xD800 <= i < 0xE000}


def test_a_range_is_not_tried_for_each_letter():
    """Of a Latin letter few ranges are looked at before it is found to be no right-to-left one."""
    pattern = tx._letters_of("R", "AL")
    assert pattern.startswith("(?:(?=[\\x{5be}-") and max(part.count("-") for part in pattern.split("]")) <= 4
