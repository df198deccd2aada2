"""Further queries of directions, lines, selections, telemetry and whole comparisons, bound to the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.functions import arrays as ar
from pagewright.functions import geometry as geo
from pagewright.functions import text as tx
from pagewright.operators import catalog, layout, manifest, scoring, telemetry
from pagewright.plans import compare
from pagewright.plans.queries import _NO_SPACE, QUERIES, SQL, query, table
from pagewright.shared import spread

__all__ = ["QUERIES", "SQL"]


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, radians(13 * l_quantity + 0.5) AS t FROM lineitem),
d AS (SELECT l_orderkey, l_linenumber, degrees(atan2(sin(t), -(-cos(t)))) AS d FROM a)
SELECT l_orderkey, l_linenumber, round(CASE WHEN d > 90 THEN d - 180 WHEN d <= -90 THEN d + 180 ELSE d END, 6) AS angle FROM d""")
def axis_angles(spark, sf_dir):
    """The angle of each item's axis, folded."""
    t = F.radians(13 * F.col("l_quantity") + 0.5)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(geo.axis_angle(F.sin(t), -F.cos(t)), 6).alias("angle"))


_SAID = ("abc", "שלום", "12, 3", "a ש", "Ω9", "مرحبا 7")
_WAYS = ("ltr", "rtl", "neutral", "mixed", "ltr", "rtl")
_WAY = "['" + "', '".join(_WAYS) + "'][CAST({} AS INTEGER)]"


@query(f"""
WITH w AS (SELECT doc_id, {_WAY.format("doc_id % 6 + 1")} AS one, {_WAY.format("doc_id // 6 % 6 + 1")} AS two FROM documents)
SELECT doc_id, one, two, one <> 'mixed' AND two <> 'mixed' AND (one = 'neutral' OR two = 'neutral' OR one = two) AS agree FROM w""")
def directions_compared(spark, sf_dir):
    """Directions of two texts of several scripts, and whether they may share a line."""
    texts = F.array(*map(F.lit, _SAID))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.get(texts, (F.col("doc_id") % 6).cast("int")).alias("a"), F.get(texts, F.floor(F.col("doc_id") / 6 % 6).cast("int")).alias("b"))
    rows = rows.select("doc_id", tx.direction(F.col("a")).alias("one"), tx.direction(F.col("b")).alias("two"))
    return rows.withColumn("agree", tx.directions_agree(F.col("one"), F.col("two")))


_LATIN = "abcdefghijklmnopqrstuvwxyz"
_HEBREW = "".join(chr(0x5D0 + i) for i in range(26))


@query(rf"""
WITH n AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS row, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM conversations),
w AS (SELECT conv_id, turn, line, unnest(string_split(regexp_replace(row, ' +', ' ', 'g'), ' ')) AS word, generate_subscripts(string_split(regexp_replace(row, ' +', ' ', 'g'), ' '), 1) AS n FROM n),
h AS (SELECT conv_id, turn, line, n, regexp_replace(translate(word, '{_LATIN}', '{_HEBREW}'), '[^{_HEBREW}0-9.,]', '', 'g') AS word FROM w),
k AS (SELECT * FROM h WHERE word <> ''),
s AS (SELECT *, lag(word) OVER (PARTITION BY conv_id, turn, line ORDER BY n DESC) AS before FROM k),
o AS (SELECT conv_id, turn, line, bool_or(regexp_matches(word, '[{_HEBREW}]')) AS rtl, count(*) AS members,
             string_agg(CASE WHEN before IS NULL THEN word ELSE {_NO_SPACE} || word END, '' ORDER BY n DESC) AS text FROM s GROUP BY ALL)
SELECT conv_id * 1000 + turn AS page_id, CAST(line AS INTEGER) AS line, text, CAST(members AS INTEGER) AS members FROM o WHERE rtl""")
def reconstruct_right_to_left(spark, sf_dir):
    """Lines of words in Hebrew letters (small Latin ones put in their place), joined from the right to the left."""
    lines = spread(table(spark, sf_dir, "conversations")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"), F.posexplode(F.split("text", "\n")).alias("row", "said"))
    said = F.regexp_replace(F.translate("said", _LATIN, _HEBREW), f"[^{_HEBREW[0]}-{_HEBREW[-1]}0-9., ]", "")  # whole lines: words keep what lies between them
    rows = lines.select("page_id", "row", F.posexplode(F.filter(F.split(said, " +"), lambda w: w != "")).alias("n", "text")).repartition("page_id")  # for all windows
    before = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("page_id", "row").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    length = F.length("text") * 10.0
    own = rows.select(
        "page_id", "row", "n", (before * 10.0 + length / 2).alias("center_x"), (F.col("row") * 100.0 + 100).alias("center_y"), F.lit(20.0).alias("thickness"), length.alias("length"), F.lit(90.0).alias("angle"),
        F.lit(False).alias("vertical"), "text", F.lit(0.5).alias("confidence"), F.lit(0.9).alias("box_score"),
    )
    own = own.withColumn("region_id", F.row_number().over(Window.partitionBy("page_id").orderBy("row", "n"))).drop("row", "n")
    found = layout.reconstruct(own).withColumn("line", F.round(F.col("center_y") / 100).cast("int"))
    return found.where(F.col("text").rlike(f"[{_HEBREW}]")).select("page_id", "line", "text", "members")


@query("""
WITH w AS (SELECT item_id, list_filter(string_split(trim(regexp_replace(text, '[ \\t\\n]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM benchmark)
SELECT item_id, CAST(len(w) AS INTEGER) AS words, true AS same_turned, len(w) <= 1 AS same_without_last FROM w""")
def word_multisets(spark, sf_dir):
    """Each item's words, and whether other orders and fewer of them are the same."""
    w = scoring.words(tx.single_spaced(F.col("text")))
    rows = table(spark, sf_dir, "benchmark").select("item_id", w.alias("w"))
    fewer = F.when(F.size("w") > 1, F.slice("w", 1, F.size("w") - 1)).otherwise(F.col("w"))
    return rows.select("item_id", F.size("w").alias("words"), ar.same_multiset(F.col("w"), F.reverse("w")).alias("same_turned"), ar.same_multiset(F.col("w"), fewer).alias("same_without_last"))


@query("""
SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), '|') AS kept FROM conversations""")
def kept_lines(spark, sf_dir):
    """Lines of each turn, single-spaced, without blank ones."""
    rows = spread(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "turn", F.array_join(tx.normalised_lines(F.split(tx.composed(F.col("text")), "\n")), "|").alias("kept"))


@query("""
SELECT '{"language":"' || lang || '","model":"m' || doc_id % 3 || '"}' AS selection, count(*) AS cases, min(doc_id) AS first FROM documents GROUP BY ALL""")
def cases_by_selection(spark, sf_dir):
    """How many cases each declared selection has, whatever the order of its fields."""
    model = F.concat(F.lit('"model": "m'), F.col("doc_id") % 3, F.lit('"'))
    language = F.concat(F.lit('"language": "'), F.col("lang"), F.lit('"'))
    declared = F.concat(F.lit("{"), F.when(F.col("doc_id") % 2 == 0, F.concat(model, F.lit(", "), language)).otherwise(F.concat(language, F.lit(" ,"), model)), F.lit("}"))
    rows = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", manifest.selection_key(declared).alias("selection"))
    return rows.groupBy("selection").agg(F.count("*").alias("cases"), F.min("doc_id").alias("first"))


@query("""
WITH s AS (SELECT s_nationkey % 5 AS vendor_id, s_suppkey % 40 AS device_id FROM supplier),
c AS (SELECT c_nationkey % 5 AS vendor_id, c_custkey % 40 AS device_id, 'card' || c_custkey % 3 AS node FROM customer),
n AS (SELECT vendor_id, device_id, count(DISTINCT node) AS nodes FROM c GROUP BY ALL),
k AS (SELECT vendor_id, device_id, count(*) AS chosen FROM s GROUP BY ALL)
SELECT vendor_id, device_id, nodes, chosen FROM n JOIN k USING (vendor_id, device_id) WHERE nodes > chosen""")
def ambiguous_identities(spark, sf_dir):
    """Device identities under which more nodes report than were selected."""
    selected = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).cast("long").alias("vendor_id"), (F.col("s_suppkey") % 40).cast("long").alias("device_id"))
    samples = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).cast("long").alias("vendor_id"), (F.col("c_custkey") % 40).cast("long").alias("device_id"), F.concat(F.lit("card"), F.col("c_custkey") % 3).alias("drm_node"))
    return telemetry.ambiguous(selected, samples).select("vendor_id", "device_id", "nodes", "chosen")


@query("""
WITH p(precision, flags) AS (VALUES ('fp32', 'accelerated,int8_inference,int8_packed,int8_storage'), ('fp16', 'accelerated,fp16_packed,fp16_storage,fp16_arithmetic,int8_inference,int8_packed,int8_storage'), ('int8', 'accelerated,int8_inference,int8_packed,int8_storage,int8_arithmetic')),
o AS (SELECT o_orderkey, ['fp32', 'fp16', 'int8'][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS precision FROM orders)
SELECT o_orderkey, precision, flags FROM o JOIN p USING (precision)""")
def precision_flags(spark, sf_dir):
    """The flags that the precision of each order sets."""
    known = {name: ",".join(flag for flag, on in catalog.options(name).items() if on) for name in ("fp32", "fp16", "int8")}
    flags = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.get(F.array(*map(F.lit, known)), (F.col("o_orderkey") % 3).cast("int")).alias("precision"))
    return rows.withColumn("flags", F.element_at(flags, F.col("precision")))


_COMPARED = """
SELECT e.engine, d.doc_id AS id, coalesce(d.lang, 'none') AS variant, CAST(d.n_chars * (1 + e.n) AS DOUBLE) AS ms, (d.doc_id + e.n) % 7 AS char_distance, 20 + d.doc_id % 13 AS char_length,
       d.doc_id % 3 AS word_distance, 5 + d.doc_id % 4 AS word_length, (d.doc_id + e.n) % 7 = 0 AS exact
FROM documents d, (VALUES ('near/one', 0), ('near/two', 1)) e(engine, n)"""


def _compared(spark, sf_dir) -> compare.Comparison:
    """Two engines' rows of all documents, checked against these as cases and compared."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("none")).alias("variant"), "n_chars")
    engines = F.explode(F.array(*(F.struct(F.lit(e).alias("engine"), F.lit(n).alias("n")) for e, n in (("near/one", 0), ("near/two", 1)))))
    rows = docs.select("*", engines.alias("e")).select("*", "e.engine", "e.n")
    i = F.col("id")
    rows = rows.select(
        "engine", "id", "variant", F.lit(0).alias("place"), (F.col("n_chars") * (1 + F.col("n"))).cast("double").alias("ms"), ((i + F.col("n")) % 7).alias("char_distance"), (20 + i % 13).alias("char_length"),
        (i % 3).alias("word_distance"), (5 + i % 4).alias("word_length"), ((i + F.col("n")) % 7 == 0).alias("exact"),
    )
    return compare.compare(rows, docs.select("id", "variant"))


@query(f"""
SELECT engine, round(sum(char_distance) / sum(char_length), 9) AS cer, round(sum(word_distance) / sum(word_length), 9) AS wer, round(avg(CASE WHEN exact THEN 1 ELSE 0 END), 9) AS exact_rate,
       round(median(ms), 6) AS p50, round(quantile_disc(ms, 0.95), 6) AS p95, count(*) AS cases FROM ({_COMPARED}) GROUP BY engine""")
def comparison_summary(spark, sf_dir):
    """A whole comparison of engines: cases checked one by one, then rates and times."""
    s = _compared(spark, sf_dir).summary
    return s.select("engine", *(F.round(c, 9).alias(c) for c in ("cer", "wer", "exact_rate")), *(F.round(c, 6).alias(c) for c in ("p50", "p95")), "cases")


@query(f"""
SELECT variant, round(sum(char_distance) FILTER (WHERE engine = 'near/one') / greatest(sum(char_length) FILTER (WHERE engine = 'near/one'), 1), 9) AS one,
       round(sum(char_distance) FILTER (WHERE engine = 'near/two') / greatest(sum(char_length) FILTER (WHERE engine = 'near/two'), 1), 9) AS two FROM ({_COMPARED}) GROUP BY variant""")
def comparison_variants(spark, sf_dir):
    v = _compared(spark, sf_dir).variants
    return v.select("variant", *(F.round(F.col(f"`{e}`"), 9).alias(e.split("/")[1]) for e in ("near/one", "near/two")))
