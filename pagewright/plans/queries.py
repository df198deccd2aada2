"""The engine's own queries, each bound to the driver's tables, with its SQL where SQL can say it.

Every entry applies one operator to whole tables. Rounded columns are rounded
because sums of floating-point numbers depend on the order of partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import arrays as ar
from pagewright.functions import geometry as geo
from pagewright.functions import text as tx
from pagewright.operators import catalog, layout, manifest, policy, scheduling, scoring, telemetry
from pagewright.shared import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CHARSET = [chr(c) for c in (*range(48, 58), *range(65, 91), *range(97, 123))] + ["."]
_SQL_LETTERS = "[" + ", ".join(f"'{c}'" for c in CHARSET) + "]"
#: Vectors of so many neighbouring ids are one crop's time steps.
STEPS = 256
_SQL_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Text ------------------------------------------------------------------------

@query(rf"""
SELECT doc_id, CAST(n - 1 AS INTEGER) AS line_no, trim(regexp_replace(line, '{_SQL_SPACES}+', ' ', 'g'), ' ') AS line
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
WHERE trim(regexp_replace(line, '{_SQL_SPACES}+', ' ', 'g'), ' ') <> ''
""")
def normalise_lines(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", tx.composed(F.col("text")).alias("text"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("line", tx.single_spaced(F.col("line"))).where("line <> ''")


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '[\\x{{{a:x}}}-\\x{{{b:x}}}]') THEN '{n}' END" for a, b, n in tx.SCRIPT_RANGES) + "], lambda x: x IS NOT NULL), ',') AS scripts FROM documents")
def script_sets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.scripts(F.col("text")), ",").alias("scripts"))


@query(r"""
WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES (-1, 'שלום'), (-2, 'a שלום'), (-3, '12 ..'), (-4, 'سلام'), (-5, '०'), (-6, 'ⓐ'), (-7, '𞤀'), (-8, 'ࡀ'), (-9, '٠١')) v(doc_id, text))
SELECT doc_id, CASE WHEN r AND l THEN 'mixed' WHEN r THEN 'rtl' WHEN l THEN 'ltr' ELSE 'neutral' END AS direction
FROM (SELECT doc_id, regexp_matches(text, '[\x{5be}\x{5d0}-\x{5f4}\x{608}\x{60b}\x{60d}\x{61b}-\x{64a}\x{6d0}-\x{6d5}\x{710}\x{712}-\x{72f}\x{840}-\x{858}\x{1e900}-\x{1e943}]') AS r,
      regexp_matches(text, '[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{903}-\x{939}\x{966}-\x{96f}\x{249c}-\x{24e9}]') AS l FROM t)
""")
def text_direction(spark, sf_dir):
    more = spark.createDataFrame([(-1, "שלום"), (-2, "a שלום"), (-3, "12 .."), (-4, "سلام"), (-5, "०"), (-6, "ⓐ"), (-7, "𞤀"), (-8, "ࡀ"), (-9, "٠١")], "doc_id long, text string")
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(more).select("doc_id", tx.direction(F.col("text")).alias("direction"))


@query(r"""
WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations)
SELECT conv_id, turn, word, count(*) AS n,
       NOT (word IN ('the', 'The', 'de', '花') AND (turn * 37 % 100) / 100.0 < 0.6 AND regexp_matches(word, '[\x{41}-\x{24f}]') AND conv_id % 3 = 0) AS accepted
FROM w WHERE word <> '' GROUP BY conv_id, turn, word
""")
def policy_filter(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("word")).where("word <> ''")
    none = F.array().cast("array<string>")
    languages = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("zh-Hans"))).when(F.col("conv_id") % 3 == 1, F.array(F.lit("EN"))).otherwise(none)
    expected = policy.expected_scripts(none, languages, none, none)
    kept = policy.accepted(F.col("word"), (F.col("turn") * 37 % 100) / 100.0, ["the", "The", "de", "花"], expected)
    return words.groupBy("conv_id", "turn", "word").agg(F.count("*").alias("n")).withColumn("accepted", kept)


@query(f"""
SELECT doc_id, CAST(length(regexp_replace(text, '{_SQL_SPACES}', '', 'g')) AS BIGINT) AS ink, CAST(length(text) AS BIGINT) AS letters FROM documents
""")
def ink_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.ink(F.col("text")).cast("long").alias("ink"), F.length("text").cast("long").alias("letters"))


# Recognition -----------------------------------------------------------------

@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS cls, CAST(list_max(embedding) AS DOUBLE) AS score FROM embeddings")
def ctc_argmax(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", ar.best_class(F.col("embedding")).alias("cls"), F.array_max("embedding").cast("double").alias("score"))


def _ctc_sql(offset: int) -> str:
    letters = "[" + ", ".join(f"'{c}'" for c in ([""] if offset == 0 else []) + CHARSET) + "]"
    return f"""
WITH s AS (SELECT label, vec_id // {STEPS} AS crop, vec_id, list_position(embedding, list_max(embedding)) - 1 AS c, CAST(list_max(embedding) AS DOUBLE) AS p FROM embeddings),
p AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY label, crop ORDER BY vec_id), 0) AS before FROM s)
SELECT label, crop, coalesce(string_agg({letters}[CAST(c - {offset} + 1 AS INTEGER)], '' ORDER BY vec_id) FILTER (WHERE c <> before AND c > 0), '') AS text,
       round(coalesce(avg(p) FILTER (WHERE c <> before AND c > 0), 0), 6) AS confidence
FROM p GROUP BY label, crop"""


def _crops(spark, sf_dir) -> DataFrame:
    """Crops of bounded length: a label's vectors of one run of ids are the time steps."""
    steps = table(spark, sf_dir, "embeddings").select("label", F.floor(F.col("vec_id") / STEPS).alias("crop"), F.struct("vec_id", ar.best_class(F.col("embedding")).alias("cls"), F.array_max("embedding").alias("score")).alias("s"))
    return steps.groupBy("label", "crop").agg(F.array_sort(F.collect_list("s")).alias("s"))


def _ctc(spark, sf_dir, offset: int) -> DataFrame:
    letters = F.array(*map(F.lit, ([""] if offset == 0 else []) + CHARSET))
    crops = _crops(spark, sf_dir)
    read = ar.collapse(F.transform("s", lambda x: x["cls"]), F.transform("s", lambda x: x["score"]), letters, offset)
    return crops.select("label", "crop", read.alias("r")).select("label", "crop", "r.text", F.round("r.confidence", 6).alias("confidence"))


@query(f"""
WITH s AS (SELECT label, vec_id // {STEPS} AS crop, vec_id, list_position(embedding, list_max(embedding)) - 1 AS c, CAST(list_max(embedding) AS DOUBLE) AS p FROM embeddings),
n AS (SELECT *, row_number() OVER (PARTITION BY label, crop ORDER BY vec_id) - 1 AS t FROM s),
steps AS (SELECT label, crop, unnest(generate_series(0, (count(*) + 4) // 5 - 1)) AS i FROM s GROUP BY label, crop),
w AS (SELECT label, crop, i, CAST(round_even(40 * i * 0.125, 0) AS BIGINT) AS lo, greatest(CAST(round_even((40 * i + 28) * 0.125, 0) AS BIGINT), CAST(round_even(40 * i * 0.125, 0) AS BIGINT) + 1) AS hi FROM steps),
p AS (SELECT n.label, n.crop, i, t, c, p, coalesce(lag(c) OVER (PARTITION BY n.label, n.crop, i ORDER BY t), 0) AS before FROM n JOIN w ON n.label = w.label AND n.crop = w.crop AND t >= lo AND t < hi),
k AS (SELECT label, crop, i, string_agg({_SQL_LETTERS}[CAST(c AS INTEGER)], '' ORDER BY t) AS text, avg(p) AS confidence FROM p WHERE c <> before AND c > 0 GROUP BY ALL)
SELECT w.label, w.crop, CAST(w.i AS INTEGER) AS span, coalesce(k.text, '') AS text, round(coalesce(k.confidence, 0), 6) AS confidence
FROM w LEFT JOIN k ON w.label = k.label AND w.crop = k.crop AND w.i = k.i""")
def decode_spans(spark, sf_dir):
    """Crops 28 wide that stand side by side all along each strip, read apart; eight pixels are a step."""
    spans = F.transform(F.sequence(F.lit(0), F.ceil(F.size("s") / 5).cast("int") - 1), lambda i: F.struct((40 * i).alias("left"), (40 * i + 28).alias("right")))
    read = ar.decode_spans(F.transform("s", lambda x: x["cls"]), F.transform("s", lambda x: x["score"]), spans, F.lit(0.125), F.array(*map(F.lit, CHARSET)), 1)
    rows = _crops(spark, sf_dir).select("label", "crop", F.posexplode(read).alias("span", "r"))
    return rows.select("label", "crop", "span", "r.text", F.round("r.confidence", 6).alias("confidence"))


@query(_ctc_sql(1))
def ctc_decode(spark, sf_dir):
    return _ctc(spark, sf_dir, 1)


@query(_ctc_sql(0))
def ctc_decode_offset0(spark, sf_dir):
    return _ctc(spark, sf_dir, 0)


@query("""
SELECT label, count(*) AS steps, CAST(min(len(embedding)) AS INTEGER) AS classes, min(len(embedding)) = max(len(embedding)) AND min(len(embedding)) >= 2 AS valid,
       CASE WHEN min(len(embedding)) <> 64 THEN 'dictionary-mismatch' END AS error
FROM embeddings GROUP BY label""")
def logit_contract(spark, sf_dir):
    n = F.size("embedding")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(
        F.count("*").alias("steps"), F.min(n).alias("classes"), ((F.min(n) == F.max(n)) & (F.min(n) >= 2)).alias("valid"), F.when(F.min(n) != len(CHARSET) + 1, "dictionary-mismatch").alias("error")
    )


@query("SELECT vec_id, CASE WHEN embedding[1] >= embedding[2] THEN 0 ELSE 180 END AS angle, CAST(greatest(embedding[1], embedding[2]) AS DOUBLE) AS confidence FROM embeddings")
def orientation_pick(spark, sf_dir):
    scores = F.slice("embedding", 1, 2)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.get(F.array(F.lit(0), F.lit(180)), ar.best_class(scores)).alias("angle"), F.array_max(scores).cast("double").alias("confidence"))


# Geometry --------------------------------------------------------------------

_WH = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 + l_partkey % 5000 AS w, 1 + l_suppkey * 37 % 5000 AS h FROM lineitem"
_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _sides(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*_KEYS, (1 + F.col("l_partkey") % 5000).alias("w"), (1 + F.col("l_suppkey") * 37 % 5000).alias("h"))


@query(f"""
SELECT {", ".join(_KEYS)}, CAST(CASE WHEN greatest(w, h) <= 640 THEN w WHEN w > h THEN 640 ELSE greatest(floor(w * (640.0::DOUBLE / h)), 1) END AS INTEGER) AS width,
       CAST(CASE WHEN greatest(w, h) <= 640 THEN h WHEN w > h THEN greatest(floor(h * (640.0::DOUBLE / w)), 1) ELSE 640 END AS INTEGER) AS height,
       round(CASE WHEN greatest(w, h) <= 640 THEN 1.0::DOUBLE ELSE 640.0::DOUBLE / greatest(w, h) END, 9) AS scale
FROM ({_WH})""")
def scaled_dims(spark, sf_dir):
    s = geo.scaled_size(F.col("w"), F.col("h"))
    return _sides(spark, sf_dir).withColumn("s", s).select(*_KEYS, "s.width", "s.height", F.round("s.scale", 9).alias("scale"))


@query(f"""
SELECT {", ".join(_KEYS)}, CAST((32 - w % 32) % 32 // 2 AS INTEGER) AS left_pad, CAST((32 - w % 32) % 32 - (32 - w % 32) % 32 // 2 AS INTEGER) AS right_pad,
       CAST((32 - h % 32) % 32 // 2 AS INTEGER) AS top_pad, CAST((32 - h % 32) % 32 - (32 - h % 32) % 32 // 2 AS INTEGER) AS bottom_pad
FROM ({_WH})""")
def pad_dims(spark, sf_dir):
    rows = _sides(spark, sf_dir).withColumn("x", geo.padding(F.col("w"))).withColumn("y", geo.padding(F.col("h")))
    return rows.select(*_KEYS, F.col("x.before").alias("left_pad"), F.col("x.after").alias("right_pad"), F.col("y.before").alias("top_pad"), F.col("y.after").alias("bottom_pad"))


_BOX = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS a, 1 + l_partkey % 90 AS b, CAST((l_linenumber * 37 + l_partkey) % 361 - 180 AS DOUBLE) AS angle, l_discount FROM lineitem"


def _boxes(spark, sf_dir):
    angle = ((F.col("l_linenumber") * 37 + F.col("l_partkey")) % 361 - 180).cast("double")
    return table(spark, sf_dir, "lineitem").select(*_KEYS, F.col("l_quantity").alias("a"), (1 + F.col("l_partkey") % 90).alias("b"), angle.alias("angle"), "l_discount")


@query(f"SELECT {', '.join(_KEYS)}, round(a * b * 1.5::DOUBLE / (2.0::DOUBLE * (a + b)), 6) AS unclip FROM ({_BOX})")
def unclip_boxes(spark, sf_dir):
    return _boxes(spark, sf_dir).select(*_KEYS, F.round(geo.unclip_offset(F.col("a"), F.col("b")), 6).alias("unclip"))


@query(f"""
WITH s0 AS (SELECT {", ".join(_KEYS)}, a::DOUBLE AS a, b::DOUBLE AS b, CASE WHEN angle < -30 THEN angle + 180 ELSE angle END AS t,
            (angle BETWEEN -30 AND 30 AND b > a * 2.7::DOUBLE) OR ((angle <= -60 OR angle >= 60) AND a > b * 2.7::DOUBLE) AS v FROM ({_BOX})),
s1 AS (SELECT * REPLACE (CASE WHEN NOT v AND t < 30 THEN b ELSE a END AS a, CASE WHEN NOT v AND t < 30 THEN a ELSE b END AS b, CASE WHEN NOT v AND t < 30 THEN t + 90 ELSE t END AS t) FROM s0),
s2 AS (SELECT * REPLACE (CASE WHEN v AND t >= 60 THEN b ELSE a END AS a, CASE WHEN v AND t >= 60 THEN a ELSE b END AS b, CASE WHEN v AND t >= 60 THEN t - 90 ELSE t END AS t) FROM s1),
s3 AS (SELECT * REPLACE (CASE WHEN NOT v AND a > b THEN b ELSE a END AS a, CASE WHEN NOT v AND a > b THEN a ELSE b END AS b, CASE WHEN NOT v AND a > b THEN t - 90 ELSE t END AS t) FROM s2)
SELECT {", ".join(_KEYS)}, a AS thickness, b AS length, t AS angle, v AS vertical FROM s3""")
def oriented_boxes(spark, sf_dir):
    rows = _boxes(spark, sf_dir).withColumn("o", geo.oriented(F.col("a"), F.col("b"), F.col("angle")))
    return rows.select(*_KEYS, "o.thickness", "o.length", "o.angle", "o.vertical")


@query(f"""
SELECT {", ".join(_KEYS)}, round(1000 - (a * abs(cos(radians(angle))) + b * abs(sin(radians(angle)))) / 2, 4) AS x0, round(500 - (a * abs(sin(radians(angle))) + b * abs(cos(radians(angle)))) / 2, 4) AS y0,
       round(1000 + (a * abs(cos(radians(angle))) + b * abs(sin(radians(angle)))) / 2, 4) AS x1, round(500 + (a * abs(sin(radians(angle))) + b * abs(cos(radians(angle)))) / 2, 4) AS y1
FROM ({_BOX})""")
def bounding_boxes(spark, sf_dir):
    box = geo.bounding_box(F.lit(1000.0), F.lit(500.0), F.col("a"), F.col("b"), F.col("angle"))
    return _boxes(spark, sf_dir).withColumn("o", box).select(*_KEYS, *(F.round(f"o.{c}", 4).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(f"SELECT {', '.join(_KEYS)}, CAST(greatest(floor(greatest(a, b) * 48 / greatest(least(a, b), 1e-6)), 1) AS INTEGER) AS crop_width FROM ({_BOX})")
def crop_widths(spark, sf_dir):
    return _boxes(spark, sf_dir).select(*_KEYS, geo.crop_width(F.least("a", "b"), F.greatest("a", "b")).alias("crop_width"))


@query(f"SELECT {', '.join(_KEYS)}, round(1 - l_discount * 5, 6) AS score FROM ({_BOX}) WHERE round(1 - l_discount * 5, 6) >= 0.6 AND greatest(a, b) >= 3.0")
def region_filter(spark, sf_dir):
    rows = _boxes(spark, sf_dir).withColumn("score", F.round(1 - F.col("l_discount") * 5, 6))
    return rows.where((F.col("score") >= geo.BOX_THRESHOLD) & (F.greatest("a", "b") >= geo.MIN_SIDE)).select(*_KEYS, "score")


# Layout ----------------------------------------------------------------------

_REGIONS = """
regions AS (
  SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY 40.0::DOUBLE * (l_suppkey % 3), 60.0::DOUBLE * l_linenumber + 100 * l_discount, l_partkey, l_suppkey) AS i,
         60.0::DOUBLE * l_linenumber + 100 * l_discount AS x, 40.0::DOUBLE * (l_suppkey % 3) AS y, 20.0::DOUBLE AS t, 20.0::DOUBLE + l_quantity AS l, 90.0::DOUBLE + 200 * l_tax AS angle
  FROM lineitem),
axes AS (SELECT *, sin(radians(angle)) AS sx, -cos(radians(angle)) AS sy FROM regions),
ax AS (SELECT page_id, i, x, y, t, l, CASE WHEN sx < 0 THEN -sx ELSE sx END AS ax, CASE WHEN sx < 0 THEN -sy ELSE sy END AS ay FROM axes),
pairs AS (
  SELECT a.page_id, a.i AS i, b.i AS j FROM ax a JOIN ax b ON a.page_id = b.page_id AND a.i < b.i
  WHERE a.ax * b.ax + a.ay * b.ay >= cos(radians(12.0)) AND abs((b.x - a.x) * -a.ay + (b.y - a.y) * a.ax) <= 0.6 * 20
    AND abs((b.x - a.x) * a.ax + (b.y - a.y) * a.ay) - (a.l + b.l) / 2 BETWEEN -least(40.0, 0.5 * least(a.l, b.l)) AND 80.0)"""


def _regions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), (60.0 * F.col("l_linenumber") + 100 * F.col("l_discount")).alias("center_x"), (40.0 * (F.col("l_suppkey") % 3)).alias("center_y"),
        F.lit(20.0).alias("thickness"), (20.0 + F.col("l_quantity")).alias("length"), (90.0 + 200 * F.col("l_tax")).alias("angle"), F.lit(False).alias("vertical"),
        F.lit("a").alias("text"), F.lit(0.9).alias("confidence"), F.lit(0.9).alias("box_score"), "l_partkey", "l_suppkey",
    )
    return layout.reading_order(rows, "l_partkey", "l_suppkey").drop("l_partkey", "l_suppkey")


@query(f"WITH {_REGIONS} SELECT page_id, CAST(i AS INTEGER) AS region_id, x AS center_x, y AS center_y FROM regions")
def reading_order(spark, sf_dir):
    return _regions(spark, sf_dir).select("page_id", "region_id", "center_x", "center_y")


@query(f"WITH {_REGIONS} SELECT page_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM pairs")
def same_visual_line(spark, sf_dir):
    return layout.same_line_pairs(_regions(spark, sf_dir))


@query(f"""
WITH RECURSIVE {_REGIONS},
ends AS (SELECT page_id, i AS a, j AS b FROM pairs UNION ALL SELECT page_id, j, i FROM pairs),
reach AS (SELECT page_id, i AS a, i AS b FROM regions UNION SELECT r.page_id, r.a, e.b FROM reach r JOIN ends e ON r.page_id = e.page_id AND r.b = e.a)
SELECT page_id, CAST(a AS INTEGER) AS region_id, CAST(min(b) AS INTEGER) AS component FROM reach GROUP BY page_id, a""")
def visual_components(spark, sf_dir):
    return layout.components(_regions(spark, sf_dir)).select("page_id", "region_id", "component")


_TOKENS = r"""
n AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS row, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM conversations),
w AS (SELECT conv_id, turn, line, unnest(string_split(regexp_replace(row, ' +', ' ', 'g'), ' ')) AS word, generate_subscripts(string_split(regexp_replace(row, ' +', ' ', 'g'), ' '), 1) AS n FROM n),
k AS (SELECT *, length(word) AS len FROM w WHERE word <> ''),
p AS (SELECT *, 100.0 * line AS y, coalesce(sum(len + 1) OVER (PARTITION BY conv_id, turn, line ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM k)"""


def _token_regions(spark, sf_dir):
    """The words of each turn's lines as regions, line under line, set in letters 10 wide and 20 high."""
    # Dealt out for all windows while a page is one text, not a row for each word.
    # The number is given, as texts become a hundred times as many rows: parts joined up by their size would be too large to sort.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"), "text").repartition(parts, "page_id")
    lines = texts.select("page_id", F.posexplode(F.split("text", "\n")).alias("line", "row"))
    rows = lines.select("page_id", "line", F.posexplode(F.filter(F.split("row", " +"), lambda w: w != "")).alias("n", "text"))
    before = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("page_id", "line").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    length, confidence = F.length("text") * 10.0, F.length("text") % 10 / 10.0
    own = rows.select("page_id", "line", "n", (before * 10.0 + length / 2).alias("center_x"), (F.col("line") * 100.0 + 100).alias("center_y"), F.lit(20.0).alias("thickness"), length.alias("length"), F.lit(90.0).alias("angle"), F.lit(False).alias("vertical"), "text", confidence.alias("confidence"), F.lit(0.9).alias("box_score"))
    return own.withColumn("region_id", F.row_number().over(Window.partitionBy("page_id").orderBy("line", "n"))).drop("line", "n")


_NO_SPACE = r"""CASE WHEN regexp_matches(before, '[(\[{<«\p{Ps}\p{Pi}]$') OR regexp_matches(word, '^[)\]}>».,;:!?%\p{Pe}\p{Pf}]') THEN '' ELSE ' ' END"""


@query(rf"""
WITH {_TOKENS},
s AS (SELECT *, lag(word) OVER (PARTITION BY conv_id, turn, line ORDER BY n) AS before FROM p)
SELECT conv_id * 1000 + turn AS page_id, string_agg(CASE WHEN before IS NULL THEN word ELSE {_NO_SPACE} || word END, '' ORDER BY n) AS text, CAST(count(*) AS INTEGER) AS members
FROM s GROUP BY conv_id, turn, line""")
def reconstruct_text(spark, sf_dir):
    return layout.reconstruct(_token_regions(spark, sf_dir)).select("page_id", "text", "members")


@query(rf"""
WITH {_TOKENS}
SELECT conv_id * 1000 + turn AS page_id, round(min(pos * 10.0) + (max((pos + len) * 10.0) - min(pos * 10.0)) / 2, 4) AS center_x, CAST(min(y) AS DOUBLE) AS center_y, 20.0::DOUBLE AS thickness,
       round(CAST(max((pos + len) * 10.0) - min(pos * 10.0) AS DOUBLE), 4) AS length, round(CASE WHEN sum(len) > 0 THEN sum(len * (len % 10 / 10.0)) / sum(len) END, 6) AS confidence
FROM p GROUP BY conv_id, turn, line""")
def merged_rectangles(spark, sf_dir):
    lines = layout.reconstruct(_token_regions(spark, sf_dir))
    return lines.select("page_id", F.round("center_x", 4).alias("center_x"), F.round("center_y", 4).alias("center_y"), F.round("thickness", 4).alias("thickness"), F.round("length", 4).alias("length"), F.round("confidence", 6).alias("confidence"))


@query("""
WITH r AS (SELECT conv_id AS page_id, CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS text, (turn * 37 % 100) / 100.0 AS confidence FROM conversations)
SELECT page_id, count(*) FILTER (WHERE text = '') AS undecoded_regions, count(*) FILTER (WHERE text <> '' AND confidence < 0.3) AS filtered_regions, count(*) FILTER (WHERE text <> '' AND confidence >= 0.3) AS kept_regions
FROM r GROUP BY page_id""")
def assemble_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("page_id"), F.col("turn").alias("region_id"), F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("text")).alias("text"), ((F.col("turn") * 37 % 100) / 100.0).alias("confidence"),
        F.lit(0.0).alias("center_x"), (F.col("turn") * 60.0).alias("center_y"), F.lit(20.0).alias("thickness"), F.lit(300.0).alias("length"), F.lit(90.0).alias("angle"), F.lit(False).alias("vertical"), F.lit(0.9).alias("box_score"),
    )
    return layout.assemble(rows, F.col("confidence") >= 0.3)[1]


# Scoring ---------------------------------------------------------------------

_ACCENTS = "translate({}, 'éèêàçñóíáúüöäßÉÈÊÀÇÑÓÍÁÚÜÖÄ', chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6) || chr(7) || chr(8) || chr(11) || chr(12) || chr(14) || chr(15) || chr(16) || chr(17) || chr(18) || chr(19) || chr(20) || chr(21) || chr(22) || chr(23) || chr(24) || chr(25) || chr(26) || chr(27) || chr(28) || chr(29) || chr(30) || chr(31))"


@query(f"SELECT item_id, CAST(levenshtein({_ACCENTS.format('a')}, {_ACCENTS.format('b')}) AS INTEGER) AS distance FROM (SELECT item_id, text AS a, replace(replace(reverse(text), 'e', ''), 'an', 'nna') AS b FROM benchmark)")
def char_distance(spark, sf_dir):
    other = F.regexp_replace(F.regexp_replace(F.reverse("text"), "e", ""), "an", "nna")
    return table(spark, sf_dir, "benchmark").select("item_id", F.levenshtein("text", other).alias("distance"))


def _letters(words: str, known: str) -> str:
    return f"array_to_string(list_transform({words}, lambda w: chr(CAST(32 + list_position({known}, w) AS INTEGER))), '')"


@query(f"""
WITH c AS (SELECT item_id, string_split(text, ' ') AS a, list_reverse(list_filter(string_split(text, ' '), lambda w: NOT contains(w, 'on'))) AS b FROM benchmark),
k AS (SELECT *, list_distinct(a) AS known FROM c)
SELECT item_id, CAST(levenshtein({_letters("a", "known")}, {_letters("b", "known")}) AS INTEGER) AS distance FROM k""")
def word_distance(spark, sf_dir):
    a = F.split("text", " ")
    b = F.reverse(F.filter(a, lambda w: ~F.contains(w, F.lit("on"))))
    return table(spark, sf_dir, "benchmark").select("item_id", tx.word_distance(a, b).alias("distance"))


@query()
def score_cases(spark, sf_dir):
    lines = F.split(tx.composed(F.col("text")), "\n")
    cases = spread(table(spark, sf_dir, "conversations"), even=True).select("conv_id", "turn", lines.alias("truth_lines"), F.reverse(F.transform(lines, lambda x: F.regexp_replace(x, "er", "re"))).alias("observed_lines"))
    scored = scoring.score_cases(cases)
    return scored.select("conv_id", "turn", "char_distance", "char_length", "word_distance", "word_length", F.round("cer", 9).alias("cer"), F.round("wer", 9).alias("wer"), "exact")


_ROWS = "SELECT event_type AS engine, 'v' || user_id % 11 AS variant, value AS ms, event_id % 7 AS char_distance, 20 + event_id % 13 AS char_length, event_id % 3 AS word_distance, 5 + event_id % 4 AS word_length, event_id % 7 = 0 AS exact FROM events"


def _result_rows(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), F.concat(F.lit("v"), F.col("user_id") % 11).alias("variant"), F.col("value").alias("ms"), (e % 7).alias("char_distance"), (20 + e % 13).alias("char_length"), (e % 3).alias("word_distance"), (5 + e % 4).alias("word_length"), (e % 7 == 0).alias("exact"))


@query(f"""
SELECT engine, round(sum(char_distance) / sum(char_length), 9) AS cer, round(sum(word_distance) / sum(word_length), 9) AS wer, round(avg(CASE WHEN exact THEN 1 ELSE 0 END), 9) AS exact_rate,
       round(median(ms), 6) AS p50, round(quantile_disc(ms, 0.95), 6) AS p95, round(sum(ms) / 1000, 6) AS seconds, count(*) AS cases FROM ({_ROWS}) GROUP BY engine""")
def engine_summary(spark, sf_dir):
    s = scoring.engine_summary(_result_rows(spark, sf_dir), "engine")
    return s.select("engine", *(F.round(c, 9).alias(c) for c in ("cer", "wer", "exact_rate")), *(F.round(c, 6).alias(c) for c in ("p50", "p95", "seconds")), "cases")


_ENGINES = ["click", "error", "purchase", "signup", "view"]


@query(f"SELECT variant, {', '.join(f'''round(sum(char_distance) FILTER (WHERE engine = '{e}') / greatest(sum(char_length) FILTER (WHERE engine = '{e}'), 1), 9) AS {e}''' for e in _ENGINES)} FROM ({_ROWS}) GROUP BY variant")
def variant_pivot(spark, sf_dir):
    p = scoring.variant_pivot(_result_rows(spark, sf_dir), "variant", "engine", _ENGINES)
    return p.select("variant", *(F.round(e, 9).alias(e) for e in _ENGINES))


def _parity(spark, sf_dir):
    wanted = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("variant"))
    labels = table(spark, sf_dir, "labels")
    got = labels.select((F.col("doc_id") + F.when(F.col("doc_id") % 10 == 0, 100000000).otherwise(0)).alias("id"), F.when(F.col("quality") == 1, "en").otherwise("fr").alias("variant"))
    again = got.where("id % 9 = 0").withColumn("variant", F.when(F.col("id") % 2 == 0, F.lit("de")).otherwise(F.col("variant")))
    return wanted.unionByName(wanted.where("id % 50 = 0")), got.withColumn("place", F.lit(1)).unionByName(again.withColumn("place", F.lit(2)))


@query("""
WITH e AS (SELECT doc_id AS id, lang AS variant FROM documents),
g0 AS (SELECT doc_id + CASE WHEN doc_id % 10 = 0 THEN 100000000 ELSE 0 END AS id, CASE WHEN quality = 1 THEN 'en' ELSE 'fr' END AS variant FROM labels),
g AS (SELECT id, variant, 1 AS place FROM g0 UNION ALL SELECT id, CASE WHEN id % 2 = 0 THEN 'de' ELSE variant END, 2 FROM g0 WHERE id % 9 = 0),
last AS (SELECT id, variant FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY place DESC) = 1),
p AS (
  SELECT id, 'listed' AS problem FROM e WHERE id % 50 = 0
  UNION ALL SELECT id, 'duplicate' FROM g GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT id, 'missing' FROM e WHERE id NOT IN (SELECT id FROM g)
  UNION ALL SELECT DISTINCT id, 'extra' FROM g WHERE id NOT IN (SELECT id FROM e)
  UNION ALL SELECT e.id, 'variant' FROM e JOIN last ON e.id = last.id WHERE e.variant <> last.variant)
SELECT p.id, problem, e.variant AS wanted, last.variant AS got FROM p LEFT JOIN e ON p.id = e.id LEFT JOIN last ON p.id = last.id""")
def case_parity(spark, sf_dir):
    return scoring.case_parity(*_parity(spark, sf_dir))


@query("""
WITH g0 AS (SELECT doc_id + CASE WHEN doc_id % 10 = 0 THEN 100000000 ELSE 0 END AS id FROM labels),
g AS (SELECT id FROM g0 UNION ALL SELECT id FROM g0 WHERE id % 9 = 0),
e AS (SELECT doc_id AS id FROM documents UNION ALL SELECT doc_id FROM documents WHERE doc_id % 50 = 0)
SELECT id, 'missing' AS side FROM (SELECT id FROM e EXCEPT ALL SELECT id FROM g)
UNION ALL SELECT id, 'extra' FROM (SELECT id FROM g EXCEPT ALL SELECT id FROM e)""")
def id_multiset_parity(spark, sf_dir):
    return scoring.id_multiset_parity(*_parity(spark, sf_dir))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def selection_required(spark, sf_dir):
    cases = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return manifest.without_selection(cases, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query(r"""
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN doc_id % 11 = 0 THEN 'id' END, CASE WHEN doc_id % 13 = 0 THEN 'script' END, CASE WHEN doc_id % 17 = 0 THEN 'direction' END,
  CASE WHEN contains(text, chr(10) || chr(10)) OR text = '' OR text LIKE chr(10) || '%' OR text LIKE '%' || chr(10) THEN 'lines' END,
  CASE WHEN doc_id % 19 = 0 THEN 'palette' END, CASE WHEN n_chars < 20 THEN 'size' END, CASE WHEN doc_id % 23 = 0 THEN 'image' END], lambda x: x IS NOT NULL), ',') AS broken
FROM documents""")
def manifest_checks(spark, sf_dir):
    d = F.col("doc_id")
    text = lambda s: F.lit(s)
    case = {
        "id": F.concat(F.when(d % 11 == 0, "-").otherwise("case-"), d), "script": F.when(d % 13 == 0, "latin").otherwise("Latn"), "language": F.col("lang"), "direction": F.when(d % 17 == 0, "up").otherwise("ltr"),
        "lines": F.split("text", "\n"), "foreground": F.when(d % 19 == 0, "#12345").otherwise("#123456"), "background": text("#ffffff"), "width_px": F.floor(F.col("n_chars") / 20), "height_px": F.lit(10), "font_px": F.lit(None).cast("int"),
        "content_label": text("text"), "readings": F.array().cast("array<string>"), "variant": text("clean"), "image": F.concat(F.when(d % 23 == 0, "../").otherwise("img/"), d, F.lit(".png")),
    }
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(manifest.violations(case), ",").alias("broken"))


# Devices, telemetry, scheduling ----------------------------------------------

@query("""
WITH p(profile, det_in, rec_out, ctc_offset) AS (VALUES ('v6-medium', 'input', 'output', 0), ('v6-small', 'input', 'output', 0), ('v6-tiny', 'input', 'output', 0), ('v5-mobile', 'in0', 'out0', 1))
SELECT o_orderkey, wanted, det_in, rec_out, ctc_offset, CASE WHEN profile IS NULL THEN 'unknown profile ' || wanted || '; known: v5-mobile, v6-medium, v6-small, v6-tiny' END AS error
FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'v6-medium' WHEN 1 THEN 'v6-small' WHEN 2 THEN 'v6-tiny' WHEN 3 THEN 'v5-mobile' ELSE 'v7' END AS wanted FROM orders) LEFT JOIN p ON wanted = profile""")
def catalog_resolve(spark, sf_dir):
    names = F.array(*map(F.lit, ("v6-medium", "v6-small", "v6-tiny", "v5-mobile", "v7")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.get(names, (F.col("o_orderkey") % 5).cast("int")).alias("wanted"))
    return catalog.resolve(rows, "wanted").select("o_orderkey", "wanted", "det_in", "rec_out", "ctc_offset", "error")


@query('SELECT s_suppkey AS "index", s_name AS name, s_nationkey % 4 AS kind, CAST(row_number() OVER (ORDER BY s_nationkey % 4, s_suppkey) AS INTEGER) AS rank FROM supplier WHERE s_nationkey % 4 < 3')
def device_rank(spark, sf_dir):
    return telemetry.rank_devices(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("index"), F.col("s_name").alias("name"), (F.col("s_nationkey") % 4).alias("kind")))


@query("""
WITH s AS (SELECT event_id, 'n' || user_id % 40 AS name, CASE WHEN event_id % 2 = 0 THEN user_id % 7 END AS vendor_id, user_id % 5 AS device_id, CASE WHEN event_id % 3 = 0 THEN 'card' || user_id % 6 END AS drm_node FROM events),
d AS (SELECT * FROM (VALUES ('n1', 3, 2, 'card4'), ('n2', NULL, 1, NULL), ('n5', 1, 1, NULL)) v(name, vendor_id, device_id, drm_node))
SELECT event_id FROM s WHERE EXISTS (SELECT 1 FROM d WHERE CASE WHEN s.drm_node IS NOT NULL AND d.drm_node IS NOT NULL THEN s.drm_node = d.drm_node
  WHEN s.vendor_id IS NOT NULL AND s.device_id IS NOT NULL AND d.vendor_id IS NOT NULL AND d.device_id IS NOT NULL THEN s.vendor_id = d.vendor_id AND s.device_id = d.device_id ELSE s.name = d.name END)""")
def device_match(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    samples = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("n"), u % 40).alias("name"), F.when(e % 2 == 0, u % 7).alias("vendor_id"), (u % 5).alias("device_id"), F.when(e % 3 == 0, F.concat(F.lit("card"), u % 6)).alias("drm_node"))
    chosen = spark.createDataFrame([("n1", 3, 2, "card4"), ("n2", None, 1, None), ("n5", 1, 1, None)], "name string, vendor_id long, device_id long, drm_node string")
    return telemetry.matching_samples(samples, chosen).select("event_id")


@query("""
SELECT 'drv' || user_id % 3 AS driver, CAST(user_id % 50 AS VARCHAR) AS client, '0000:0' || user_id % 4 AS pdev, 'drm-engine-' || event_type AS metric, max(CAST(floor(value * 10) AS BIGINT)) AS amount
FROM events GROUP BY ALL""")
def fdinfo_parse(spark, sf_dir):
    u = F.col("user_id")
    text = F.concat(F.lit("pos:\t0\ndrm-driver:\tdrv"), u % 3, F.lit("\ndrm-client-id:\t"), u % 50, F.lit("\ndrm-pdev:\t0000:0"), u % 4, F.lit("\ndrm-engine-"), F.col("event_type"), F.lit(":\t"), F.floor(F.col("value") * 10), F.lit(" ns\ndrm-memory-x:\t5 KiB\n"))
    return telemetry.parse_fdinfo(table(spark, sf_dir, "events").select(text.alias("value")))


@query("""
WITH s AS (SELECT user_id, event_type AS metric, event_id % 2 AS late, max(CAST(floor(value * 100) AS BIGINT)) AS amount FROM events GROUP BY ALL)
SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.metric, a.metric) AS metric, greatest(coalesce(a.amount, 0) - coalesce(b.amount, 0), 0) AS gain
FROM (SELECT * FROM s WHERE late = 0) b FULL JOIN (SELECT * FROM s WHERE late = 1) a ON a.user_id = b.user_id AND a.metric = b.metric""")
def counter_delta(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("metric"), (F.col("event_id") % 2).alias("late")).agg(F.max(F.floor(F.col("value") * 100)).cast("long").alias("amount"))
    return telemetry.counter_gain(rows.where("late = 0").drop("late"), rows.where("late = 1").drop("late"), ["user_id"])


@query(f"""
WITH u AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS matched, count(DISTINCT event_type) > 4 AS amb, count(*) AS counters, count(*) FILTER (WHERE event_type = 'view') AS sys, count(*) FILTER (WHERE event_type = 'view' AND value > 20) AS readable FROM events GROUP BY user_id),
r AS (SELECT user_id, CASE WHEN matched = 0 THEN '{telemetry.NO_MATCH}' WHEN amb THEN '{telemetry.AMBIGUOUS}' END AS p,
      CASE WHEN counters = 0 THEN '{telemetry.NO_COUNTER}' WHEN sys = 0 THEN '{telemetry.NO_MATCH}' WHEN amb THEN '{telemetry.AMBIGUOUS}' WHEN readable = 0 THEN '{telemetry.NO_SAMPLES}' END AS s FROM u)
SELECT user_id, CASE WHEN p IS NULL THEN 'process' WHEN s IS NULL THEN 'system' ELSE 'none' END AS provider, p IS NULL OR s IS NULL AS supported, CASE WHEN p IS NOT NULL AND s IS NOT NULL THEN p || '; ' || s END AS reason FROM r""")
def proof_ladder(spark, sf_dir):
    kind = F.col("event_type")
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(kind == "click").alias("matched"), (F.count_distinct(kind) > 4).alias("amb"), F.count("*").alias("counters"), F.count_if(kind == "view").alias("sys"), F.count_if((kind == "view") & (F.col("value") > 20)).alias("readable"))
    reasons = telemetry.preferred(telemetry.process_status(F.col("matched"), F.col("amb")), telemetry.system_status(F.col("counters"), F.col("sys"), F.col("amb"), F.col("readable")))
    return users.select("user_id", reasons.alias("r")).select("user_id", "r.*")


@query("SELECT event_type, round(sum(value), 4) AS total, max(value) AS most, round(avg(value), 6) AS mean, count(*) AS samples FROM events GROUP BY event_type")
def telemetry_rollup(spark, sf_dir):
    return telemetry.rollup(table(spark, sf_dir, "events"), "event_type").select("event_type", F.round("total", 4).alias("total"), "most", F.round("mean", 6).alias("mean"), "samples")


@query("""
SELECT user_id, round(list_reduce(list_prepend(1.0::DOUBLE, list(value ORDER BY ts, event_id)), lambda c, x: (c + x) / 2), 6) AS cost FROM events GROUP BY user_id""")
def cost_ema(spark, sf_dir):
    return scheduling.cost_after(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 1.0).select("user_id", F.round("cost", 6).alias("cost"))


@query()
def schedule_sim(spark, sf_dir):
    crops = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("crop"), (F.col("l_quantity") * 10).cast("int").alias("width"))
    return scheduling.simulate_pages(crops, {0: 1.0, 1: 1.2, 2: 4.0})


@query("SELECT event_id, user_id, g AS generation, g < max(g) OVER (PARTITION BY user_id) AS stale FROM (SELECT event_id, user_id, CAST(day(ts) AS INTEGER) AS g FROM events)")
def stale_replies(spark, sf_dir):
    return scheduling.current_replies(table(spark, sf_dir, "events").select("event_id", "user_id", F.dayofmonth("ts").alias("generation")), "user_id").select("event_id", "user_id", "generation", "stale")


@query("""
SELECT event_id, user_id, reply IS NULL OR reply > ts + INTERVAL 120 SECOND AS expired FROM (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS reply FROM events)""")
def expired_jobs(spark, sf_dir):
    reply = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").withColumn("reply", reply)
    return rows.select("event_id", "user_id", (F.col("reply").isNull() | (F.col("reply") > F.col("ts") + F.expr("INTERVAL 120 SECONDS"))).alias("expired"))


@query("""
SELECT event_id, user_id, reply IS NULL OR reply > ts + INTERVAL 120 SECOND AS expired FROM (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS reply FROM events)""")
def stream_expired_jobs(spark, sf_dir):
    """The same of a stream, each job told when event time passes its deadline."""
    from pagewright.streaming import deadlines
    from pagewright.streaming import telemetry as live

    jobs = deadlines.expired_jobs(live.ended(live.stream(spark, sf_dir, "events").select("event_id", "user_id", "ts")))
    return live.settled(jobs, "append", state_store=deadlines.ROCKS)


@query("SELECT lang, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY lang")
def warmup_first(spark, sf_dir):
    return scheduling.first_of_each(table(spark, sf_dir, "documents").select("lang", "doc_id", "source"), "lang", "doc_id").select("lang", "doc_id", "source")


@query("""
WITH s AS (SELECT p_brand, p_partkey, p_size, coalesce(sum(p_size + 32) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM part)
SELECT p_partkey, CAST(l AS BIGINT) AS "left", CAST(l + p_size AS BIGINT) AS "right", CAST(round_even(l * 0.125, 0) AS INTEGER) AS lo, CAST(greatest(round_even((l + p_size) * 0.125, 0), round_even(l * 0.125, 0) + 1) AS INTEGER) AS hi FROM s""")
def strip_spans(spark, sf_dir):
    rows = scheduling.packed_spans(table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").alias("width")), "p_brand", "p_partkey")
    return rows.withColumn("s", ar.span_steps(F.col("left"), F.col("right"), F.lit(0.125))).select("p_partkey", "left", "right", "s.lo", "s.hi")


# Pages and streams -----------------------------------------------------------

@query()
def detect_boxes(spark, sf_dir):
    """Regions of each embedding taken as an 8 x 8 probability map."""
    import numpy as np
    import pyarrow as pa

    from pagewright.operators import pixels

    names = ("vec_id", "region_id", "center_x", "center_y", "thickness", "length", "angle", "vertical", "score")

    def run(batches):
        for batch in batches:
            rows = []
            for vec, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = pixels.regions(np.clip(4 * np.array(values).reshape(8, 8), 0, 1))
                rows += [(vec, i, *r) for i, r in enumerate(found)]
            types = (pa.int64(), pa.int32(), *(pa.float64(),) * 5, pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], list(names))

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, region_id int, center_x double, center_y double, thickness double, length double, angle double, vertical boolean, score double")


@query()
def contour_points(spark, sf_dir):
    """Corner points of all borders, outer ones and those of holes, of each embedding taken as an 8 x 8 probability map."""
    import numpy as np
    import pyarrow as pa

    from pagewright.operators import pixels

    kind = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))

    def run(batches):
        for batch in batches:
            vectors = np.clip(4 * np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, 8, 8), 0, 1)
            vecs, turns, holes, points = [], [], [], []
            for vec, values in zip(batch.column(0).to_pylist(), vectors, strict=True):
                for i, (corners, hole) in enumerate(pixels.contours(values > pixels.BINARY)):
                    vecs.append(vec), turns.append(i), holes.append(hole), points.append([{"x": x, "y": y} for x, y in corners.tolist()])
            yield pa.RecordBatch.from_arrays([pa.array(vecs, pa.int64()), pa.array(turns, pa.int32()), pa.array(holes, pa.bool_()), pa.array(points, kind)], ["vec_id", "contour", "hole", "points"])

    whole = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where("size(embedding) = 64")
    return whole.mapInArrow(run, "vec_id long, contour int, hole boolean, points array<struct<x:int,y:int>>")


@query()
def detect_boxes_sql(spark, sf_dir):
    """The same, written in SQL with a table function."""
    from pagewright.functions import tables

    tables.register(spark)
    return spark.sql("SELECT e.vec_id, r.* FROM {rows} e, LATERAL map_regions(e.embedding, 8, 4.0D) r", rows=table(spark, sf_dir, "embeddings"))


@query("SELECT conv_id, turn, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line, unnest(string_split(text, chr(10))) AS text FROM conversations")
def turn_lines_sql(spark, sf_dir):
    """The lines of each turn, by a table function in SQL."""
    from pagewright.functions import tables

    tables.register(spark)
    return spark.sql("SELECT c.conv_id, c.turn, l.line, l.text FROM {rows} c, LATERAL text_lines(c.text) l", rows=spread(table(spark, sf_dir, "conversations")))


@query()
def read_pages(spark, sf_dir):
    """Benchmark texts set as pages, read back and scored."""
    from pagewright.plans.read_pages import read_and_score

    texts = spread(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page_id"), "text"))
    return read_and_score(spark, texts)


@query("""
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS samples, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY 1, 2""")
def stream_telemetry(spark, sf_dir):
    from pagewright.streaming import telemetry as live

    counted = live.windowed(live.ended(live.stream(spark, sf_dir, "events")), "1 hour", "10 minutes", "event_type")
    return live.settled(counted, "append").withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
SELECT user_id AS key, g AS generation, event_id, coalesce(g < max(g) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stale
FROM (SELECT event_id, user_id, CAST(day(ts) AS BIGINT) AS g FROM events)""")
def stream_stale_replies(spark, sf_dir):
    from pagewright.streaming import telemetry as live

    replies = live.stream(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.dayofmonth("ts").cast("long").alias("generation"), "event_id")
    return live.settled(live.stale_replies(replies, forgets=False), "append")
