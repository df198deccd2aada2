"""White space: the pattern over all code points, and single spacing."""

from pyspark.sql import functions as F

from pagewright.functions import text as tx


def test_spaces_of_all_code_points(spark):
    letter = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    found = spark.range(0x110000).where("id not between 55296 and 57343").where(letter.rlike(tx.SPACES)).collect()
    assert {r.id for r in found} == {c for c in range(0x110000) if chr(c).isspace() and not 0xD800 <= c < 0xE000}


def test_single_spaced(spark):
    texts = ["", " ", "a", " a", "a ", "a b", "a  b", "a\tb", "a \u2003b", "\u3000a\nb\u00a0", "\u0085", "  ", "a\u200bb", "é \x1f ü", "a\u2028", None]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select(tx.single_spaced(F.col("text")).alias("x")).collect()
    assert [r.x for r in rows] == [None if x is None else " ".join(x.split()) for x in texts]
