"""Queries of runs, manifests, catalogs and telemetry, bound to the driver's tables, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from pagewright import engine
from pagewright.functions import arrays as ar
from pagewright.functions import geometry as geo
from pagewright.operators import catalog, layout, manifest, measures, telemetry
from pagewright.plans import compare
from pagewright.plans.queries import QUERIES, SQL, query, table
from pagewright.shared import spread
from pagewright.sources import corpora, readers

__all__ = ["QUERIES", "SQL"]

# Counters --------------------------------------------------------------------

_HALVES = "SELECT user_id, event_type AS metric, event_id % 2 AS late, max(CAST(floor(value * 100) AS BIGINT)) AS amount FROM events GROUP BY ALL"


def _maps(spark, sf_dir):
    """Each user's counters before and after, as maps."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("metric"), (F.col("event_id") % 2).alias("late")).agg(F.max(F.floor(F.col("value") * 100)).cast("long").alias("amount"))
    counters = lambda late: F.map_from_entries(F.collect_list(F.when(F.col("late") == late, F.struct("metric", "amount"))))
    return rows.groupBy("user_id").agg(counters(0).alias("before"), counters(1).alias("after"))


@query(f"SELECT user_id, metric, max(amount) AS amount FROM ({_HALVES}) GROUP BY ALL")
def merged_counters(spark, sf_dir):
    return _maps(spark, sf_dir).select("user_id", F.explode(ar.merged_counters(F.col("before"), F.col("after"))).alias("metric", "amount"))


@query(f"SELECT user_id, metric, greatest(coalesce(max(amount) FILTER (WHERE late = 1), 0) - coalesce(max(amount) FILTER (WHERE late = 0), 0), 0) AS gain FROM ({_HALVES}) GROUP BY ALL")
def map_gain(spark, sf_dir):
    return _maps(spark, sf_dir).select("user_id", F.explode(telemetry.map_gain(F.col("before"), F.col("after"))).alias("metric", "gain"))


@query(f"""
WITH s AS ({_HALVES})
SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.metric, a.metric) AS metric, greatest(coalesce(a.amount, 0) - coalesce(b.amount, 0), 0) AS amount, 'card' || a.user_id % 6 AS device
FROM (SELECT * FROM s WHERE late = 0) b FULL JOIN (SELECT * FROM s WHERE late = 1) a ON a.user_id = b.user_id AND a.metric = b.metric""")
def bracketed_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("metric"), (F.col("event_id") % 2).alias("late")).agg(F.max(F.floor(F.col("value") * 100)).cast("long").alias("amount"))
    rows = rows.withColumn("device", F.concat(F.lit("card"), F.col("user_id") % 6))
    return telemetry.bracketed(rows.where("late = 0"), rows.where("late = 1"), ["user_id"]).withColumnRenamed("gain", "amount")


@query("""
SELECT 'drm-engine-' || event_type AS metric, CAST(sum(CAST(floor(value * 10) AS BIGINT)) AS BIGINT) AS amount FROM events GROUP BY 1
UNION ALL SELECT 'drm-memory-vram', CAST(sum(user_id) AS BIGINT) FROM events""")
def gpu_counters(spark, sf_dir):
    text = F.concat(F.lit("drm-driver:\tx\ndrm-engine-"), F.col("event_type"), F.lit(":\t"), F.floor(F.col("value") * 10), F.lit(" ns\ndrm-memory-vram:\t"), F.col("user_id"), F.lit(" KiB\ndrm-total:\t9\n"))
    return telemetry.diagnostic_counters(table(spark, sf_dir, "events").select(text.alias("value")))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey WHEN 2 THEN NULL ELSE p_partkey END AS number FROM part""")
def hex_numbers(spark, sf_dir):
    key = F.col("p_partkey")
    text = F.when(key % 4 == 0, F.concat(F.lit("0x"), F.hex(key), F.lit("\n"))).when(key % 4 == 1, F.lower(F.hex(key))).when(key % 4 == 2, F.concat(F.hex(key), F.lit("g"))).otherwise(F.concat(F.lit(" 0X"), F.hex(key)))
    return table(spark, sf_dir, "part").select("p_partkey", readers.hex_number(text).alias("number"))


@query("""
SELECT user_id, problem FROM (
  SELECT user_id, CASE WHEN n = 0 THEN 'a proof needs a device' WHEN supported AND reason <> '' THEN 'a supported proof has no reason' WHEN NOT supported AND reason = '' THEN 'an unsupported proof needs a reason' END AS problem
  FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'view' AND event_id % 3 = 0) AS n, user_id % 2 = 0 AS supported, CASE WHEN user_id % 3 = 0 THEN '' ELSE 'why' END AS reason FROM events GROUP BY user_id)) WHERE problem IS NOT NULL""")
def proof_problems(spark, sf_dir):
    seen = F.collect_list(F.when((F.col("event_type") == "view") & (F.col("event_id") % 3 == 0), F.col("event_id")))
    proofs = table(spark, sf_dir, "events").groupBy("user_id").agg(seen.alias("devices")).withColumn("supported", F.col("user_id") % 2 == 0).withColumn("reason", F.when(F.col("user_id") % 3 == 0, "").otherwise("why"))
    return telemetry.proof_problems(proofs).select("user_id", "problem")


@query('SELECT s_suppkey AS runtime_index, s_name AS name, TRY_CAST(CASE WHEN s_suppkey % 3 = 0 THEN \'none\' ELSE CAST(s_nationkey AS VARCHAR) END AS BIGINT) AS vendor_id, CAST(s_suppkey % 7 AS BIGINT) AS device_id, CAST(NULL AS VARCHAR) AS drm_node FROM supplier')
def device_identity(spark, sf_dir):
    vendor = F.when(F.col("s_suppkey") % 3 == 0, "none").otherwise(F.col("s_nationkey").cast("string"))
    return telemetry.identity(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("index"), F.col("s_name").alias("name"), vendor.alias("vendor_id"), (F.col("s_suppkey") % 7).cast("string").alias("device_id")))


@query("SELECT s_nationkey, string_agg(s_name, ' + ' ORDER BY s_suppkey) AS name FROM supplier GROUP BY s_nationkey")
def device_names(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct(F.col("s_suppkey").alias("index"), F.col("s_name").alias("name"))).alias("d"))
    return rows.select("s_nationkey", catalog.device_name(F.col("d")).alias("name"))


# Catalog ---------------------------------------------------------------------

@query("""
WITH p(port, det_in, rec_in, ctc_offset) AS (VALUES ('avafly-v6', 'input', 'input', 0), ('nihui-v5', 'in0', 'in0', 1))
SELECT o_orderkey, wanted, det_in, rec_in, ctc_offset, CASE WHEN port IS NULL THEN 'unknown port ' || wanted || '; known: avafly-v6, nihui-v5' END AS error
FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'avafly-v6' WHEN 1 THEN 'nihui-v5' ELSE 'other' END AS wanted FROM orders) LEFT JOIN p ON wanted = port""")
def port_models(spark, sf_dir):
    names = F.array(*map(F.lit, ("avafly-v6", "nihui-v5", "other")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.get(names, (F.col("o_orderkey") % 3).cast("int")).alias("wanted"))
    return catalog.for_ports(rows, "wanted").select("o_orderkey", "wanted", "det_in", "rec_in", "ctc_offset", "error")


@query("""
WITH v(profile, dictionary) AS (VALUES ('v6-medium', 'm/PaddleOCR-ncnn-CPP/models/ppocr_keys_v6.txt'), ('v6-small', 'm/PaddleOCR-ncnn-CPP/models/ppocr_keys_v6.txt'), ('v6-tiny', 'm/PaddleOCR-ncnn-CPP/models/ppocr_keys_v6_tiny.txt'), ('v5-mobile', 'own/ppocrv5_keys.txt')),
o AS (SELECT o_orderkey, ['v6-medium', 'v6-small', 'v6-tiny', 'v5-mobile', 'none'][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS profile FROM orders)
SELECT o_orderkey, profile, dictionary FROM o LEFT JOIN v USING (profile)""")
def dictionary_paths(spark, sf_dir):
    """Where the dictionary lies that each order's profile needs."""
    names = F.array(*map(F.lit, ("v6-medium", "v6-small", "v6-tiny", "v5-mobile", "none")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.get(names, (F.col("o_orderkey") % 5).cast("int")).alias("profile"))
    files = catalog.model_files(spark).select("profile", catalog.dictionary_path(F.col("dictionary"), "m", "own").alias("dictionary"))
    return rows.join(files, "profile", "left").select("o_orderkey", "profile", "dictionary")


@query("SELECT doc_id AS id, 'v' || doc_id % 4 AS model, 'v' || doc_id % 3 AS declared FROM documents WHERE doc_id % 4 <> doc_id % 3")
def undeclared_models(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    model = lambda n: own.withColumn("model", F.concat(F.lit("v"), F.col("id") % n))
    return catalog.undeclared(model(4), model(3)).select("id", "model", "declared")


@query("""
SELECT l_orderkey AS page_id, count(*) AS crops, CASE WHEN l_orderkey % 4 = 3 THEN 'alone' WHEN count(*) FILTER (WHERE l_quantity > 25) = 0 THEN 'nothing' WHEN l_orderkey % 4 = 0 THEN 'spare' ELSE 'pool' END AS way
FROM lineitem GROUP BY l_orderkey""")
def way_of_reading(spark, sf_dir):
    workers = F.when(F.col("page_id") % 4 < 3, F.col("page_id") % 4)
    pages = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.count("*").alias("crops"), F.count_if(F.col("l_quantity") > 25).alias("text"))
    return pages.select("page_id", "crops", engine.way_of_reading(workers, F.col("text")).alias("way"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_partkey - (l_suppkey % 32) // 2) / (0.25::DOUBLE + l_discount), 6) AS x FROM lineitem")
def original_points(spark, sf_dir):
    x = geo.original_point(F.col("l_partkey"), 0.25 + F.col("l_discount"), F.col("l_suppkey") % 32)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(x, 6).alias("x"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN h < 1 OR w < 1 OR c <> 3 THEN 'image-invalid' END AS code, CASE WHEN h < 1 OR w < 1 OR c <> 3 THEN h || ' x ' || w || ' x ' || c END AS detail
FROM (SELECT *, l_partkey % 7 - 1 AS h, l_suppkey % 5 AS w, CASE WHEN l_linenumber = 4 THEN 1 ELSE 3 END AS c FROM lineitem)""")
def page_refusals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("*", (F.col("l_partkey") % 7 - 1).cast("int").alias("h"), (F.col("l_suppkey") % 5).cast("int").alias("w"), F.when(F.col("l_linenumber") == 4, 1).otherwise(3).alias("c"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", readers.image_error(F.col("c"), F.col("h"), F.col("w")).alias("e")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "e.code", "e.detail")


# Manifests and results -------------------------------------------------------

_CASE = {
    "id": "case-1", "script": "Latn", "language": "en-GB", "direction": "ltr", "lines": ["one", "two"], "font": {"family": "f", "file": "f", "source": "s", "version": "1", "license": "l"},
    "palette": {"foreground": "#000000", "background": "#FFFFFF"}, "size": {"font_px": None, "width_px": 500, "height_px": 600}, "background_objects": [{"kind": "line", "bounds": [0, 1, 2, 3], "fill": "#123456"}],
    "content_label": "text", "known_false_readings": ["a", "b"], "recognition": {"pagewright": {"model": "m"}, "paddleocr": None, "tesseract": {"language": "eng"}}, "variant": "clean", "image": "a/b.png",
}
#: What is put in place of what, and the first problem that this makes.
_FAULTS = [
    ('"variant"', '"variant"', None), ('"case-1"', '"-case"', "id: no id"), ('"case-1"', "7", "id: no id"), ('"Latn"', '"latin"', "script: no script"), ('"en-GB"', '"english-"', "language: no language"), ('"ltr"', '"up"', "direction: unknown"),
    ('["one", "two"]', '["one", ""]', "lines.1: no text"), ('["one", "two"]', '"one"', "lines: no array"), ('"family": "f", ', "", "font: no family"), ('"license": "l"', '"license": ""', "font.license: no text"), ('"version": "1"', '"version": "1", "x": 1', "font: unknown x"),
    ('"#FFFFFF"', '"white"', "palette.background: no colour"), ('"#000000"', '"#00000"', "palette.foreground: no colour"), ('"font_px": null', '"font_px": 0', "size.font_px: not above 0"), ('"width_px": 500', '"width_px": 0', "size.width_px: not above 0"), ('"height_px": 600', '"height_px": 1.5', "size.height_px: not above 0"),
    ('"kind": "line"', '"kind": "blob"', "background_objects.0.kind: unknown"), ("[0, 1, 2, 3]", "[0, 1, 2]", "background_objects.0.bounds: not four"), ("[0, 1, 2, 3]", "[0, 1, 2, -3]", "background_objects.0.bounds.3: below 0"), ('"#123456"', '"#1234567"', "background_objects.0.fill: no colour"),
    ('"content_label": "text"', '"content_label": "words"', "content_label: unknown"), ('["a", "b"]', '["a", "a"]', "known_false_readings: repeated"), ('["a", "b"]', '["a", ""]', "known_false_readings.1: no text"), ('"model": "m"', '"model": ""', "recognition.pagewright.model: no text"), ('"paddleocr": null, ', "", "recognition: no paddleocr"),
    ('"clean"', '""', "variant: no text"), ('"a/b.png"', '"../b.png"', "image: no image path"), ('"a/b.png"', '"/b.png"', "image: no image path"), ('"a/b.png"', '"b.gif"', "image: no image path"), ('"lines"', '"line"', "case: no lines"), ('"id"', '"extra": 1, "id"', "case: unknown extra"), ("{", "", "case: no object"), ('["a", "b"]', '["a" "b"]', "case: no JSON"),
]


@query(f"""
SELECT doc_id, CASE doc_id % {len(_FAULTS)} {" ".join(f"WHEN {i} THEN '{what}'" for i, (_, _, what) in enumerate(_FAULTS) if what)} END AS problem FROM documents""")
def manifest_rules(spark, sf_dir):
    """Cases that each break one rule, and the first problem that is found."""
    text = json.dumps(_CASE)
    assert all(old in text for old, _, _ in _FAULTS)
    cases = F.array(*(F.lit(text.replace(old, new, 1)) for old, new, _ in _FAULTS))
    rows = spread(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", F.get(cases, (F.col("doc_id") % len(_FAULTS)).cast("int")).alias("case"))
    return rows.select("doc_id", F.get(manifest.case_problems(F.col("case")), F.lit(0)).alias("problem"))


@query("SELECT conv_id AS id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def repeated_case_ids(spark, sf_dir):
    return manifest.repeated_ids(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")))


@query("""SELECT event_type, count(*) AS n, '{"model":{"a":' || user_id % 3 || ',"b":1},"x":"' || event_type || '"}' AS key FROM events GROUP BY event_type, user_id % 3""")
def selection_keys(spark, sf_dir):
    """Selections written with their fields in either order have one key."""
    part = F.when(F.col("event_id") % 2 == 0, F.format_string('"model": {"b": 1, "a": %d}, "x": "%s"', F.col("user_id") % 3, F.col("event_type"))).otherwise(F.format_string('"x": "%s", "model": {"a": %d, "b": 1}', F.col("event_type"), F.col("user_id") % 3))
    key = manifest.selection_key(F.concat(F.lit("{"), part, F.lit("}")))
    return table(spark, sf_dir, "events").groupBy("event_type", key.alias("key")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT p_type, substr(regexp_extract(p_type, '[^ ]*$'), 1, 13) AS label FROM part")
def engine_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_type", compare.label(F.translate("p_type", " ", "/")).alias("label")).distinct()


@query("""
WITH e AS (SELECT doc_id AS id, lang AS variant FROM documents),
r0 AS (SELECT 'engine' || doc_id % 2 AS engine, doc_id AS id, lang AS variant, 1 AS place FROM documents),
r AS (SELECT * FROM r0 WHERE id % 7 <> 0 UNION ALL SELECT engine, id, 'other', 2 FROM r0 WHERE id % 11 = 0 UNION ALL SELECT engine, id + 100000000, variant, 3 FROM r0 WHERE id % 13 = 0),
engines AS (SELECT DISTINCT engine FROM r), w AS (SELECT engine, id, variant FROM e, engines),
last AS (SELECT engine, id, variant FROM r QUALIFY row_number() OVER (PARTITION BY engine, id ORDER BY place DESC) = 1)
SELECT engine, id, 'missing' AS problem FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.engine = w.engine AND r.id = w.id)
UNION ALL SELECT DISTINCT engine, id, 'extra' FROM r WHERE id NOT IN (SELECT id FROM e)
UNION ALL SELECT engine, id, 'duplicate' FROM r GROUP BY engine, id HAVING count(*) > 1
UNION ALL SELECT w.engine, w.id, 'variant' FROM w JOIN last ON w.engine = last.engine AND w.id = last.id WHERE w.variant <> last.variant""")
def compare_problems(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("variant"))
    rows = docs.withColumn("engine", F.concat(F.lit("engine"), F.col("id") % 2)).withColumn("place", F.lit(1))
    again = rows.where("id % 11 = 0").withColumn("variant", F.lit("other")).withColumn("place", F.lit(2))
    more = rows.where("id % 13 = 0").withColumn("id", F.col("id") + 100000000).withColumn("place", F.lit(3))
    results = rows.where("id % 7 <> 0").unionByName(again).unionByName(more)
    return compare.problems(results, docs).select("engine", "id", "problem")


@query("""
WITH known AS (SELECT DISTINCT unnest(string_split(text, '')) AS letter FROM benchmark)
SELECT doc_id, letter FROM (SELECT DISTINCT doc_id, unnest(string_split(regexp_replace(text, '[\\s\\p{Z}\\p{Cf}]', '', 'g'), '')) AS letter FROM documents) WHERE letter <> '' AND letter NOT IN (SELECT letter FROM known)""")
def font_gaps(spark, sf_dir):
    """Letters of each document that no benchmark text has."""
    coverage = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "")).alias("letter"))
    return corpora.uncovered(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), coverage, F.col("text")).select("doc_id", "letter")


@query("""
WITH r AS (SELECT conv_id AS page_id, CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS text FROM conversations)
SELECT page_id, count(*) AS lines FROM r WHERE text <> '' GROUP BY page_id""")
def line_counts(spark, sf_dir):
    """Lines of each page; turns are set far apart, so each is a line."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("page_id"), F.col("turn").alias("region_id"), F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("text")).alias("text"), F.lit(0.9).alias("confidence"),
        F.lit(0.0).alias("center_x"), (F.col("turn") * 60.0).alias("center_y"), F.lit(20.0).alias("thickness"), F.lit(300.0).alias("length"), F.lit(90.0).alias("angle"), F.lit(False).alias("vertical"), F.lit(0.9).alias("box_score"),
    )
    return layout.line_counts(layout.assemble(rows)[0])


# Measures --------------------------------------------------------------------

def _reads(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("way"), (F.col("l_extendedprice") / 1000).alias("ms"), (F.col("l_quantity") * 10).cast("long").alias("width"), F.lit(48).alias("height"), "l_orderkey", "l_linenumber")


@query("""
SELECT l_returnflag AS model, count(*) AS crops, round(sum(CAST(l_quantity * 10 AS BIGINT) * 48) / 1e6, 6) AS mpix, round(sum(l_extendedprice / 1000) / count(*), 6) AS ms_per_crop, round(sum(l_extendedprice / 1000) / (sum(CAST(l_quantity * 10 AS BIGINT) * 48) / 1e6), 6) AS ms_per_mpix
FROM lineitem GROUP BY 1""")
def crop_costs(spark, sf_dir):
    return measures.costs(_reads(spark, sf_dir), "model").select("model", "crops", *(F.round(c, 6).alias(c) for c in ("mpix", "ms_per_crop", "ms_per_mpix")))


@query("""
WITH t AS (SELECT l_linestatus AS way, sum(l_extendedprice / 1000) AS ms FROM lineitem GROUP BY 1)
SELECT way, round((SELECT ms FROM t WHERE way = 'O') / ms, 6) AS speed_up FROM t""")
def speed_ups(spark, sf_dir):
    return measures.speed_up(_reads(spark, sf_dir), "way", "ms", "O").select("way", F.round("speed_up", 6).alias("speed_up"))


@query("SELECT p_partkey, round((p_size * 20 - p_retailprice) / 20, 6) AS overhead FROM part")
def call_overheads(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(measures.call_overhead(F.col("p_size").cast("double"), F.col("p_retailprice"), 20), 6).alias("overhead"))


@query("""
WITH r AS (SELECT conv_id AS crop, turn AS way, CASE WHEN conv_id % 5 = 0 THEN NULL WHEN turn % 3 = 2 THEN upper(text) ELSE 'a' || conv_id END AS text FROM conversations), b AS (SELECT crop, text FROM r WHERE way = 0)
SELECT way, count(*) FILTER (WHERE r.text IS NOT DISTINCT FROM b.text) AS same, count(*) AS crops FROM r JOIN b ON r.crop = b.crop GROUP BY way""")
def same_texts(spark, sf_dir):
    text = F.when(F.col("conv_id") % 5 == 0, None).when(F.col("turn") % 3 == 2, F.upper("text")).otherwise(F.concat(F.lit("a"), F.col("conv_id")))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("crop"), F.col("turn").alias("way"), text.alias("text"))
    return measures.same_texts(rows, "crop", "way", "text", 0)


@query("SELECT CAST(p_partkey // 4 AS BIGINT) AS grp, p_size <= 20 AS packed, count(*) AS crops, CAST(sum(p_size) AS BIGINT) AS width FROM part GROUP BY 1, 2")
def batching_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(measures.groups_of(F.col("p_partkey"), 4).alias("grp"), measures.packs(F.col("p_size"), 20).alias("packed"))
    return rows.agg(F.count("*").alias("crops"), F.sum("p_size").cast("long").alias("width"))


# Jobs in flight --------------------------------------------------------------

def messages(spark, sf_dir):
    """Events as a pool's messages: users are pools, hours are generations, kinds of event what happens."""
    return _messages(table(spark, sf_dir, "events"))


def _messages(events):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    event = F.element_at(F.create_map(*(F.lit(x) for pair in (("signup", "ready"), ("view", "sent"), ("click", "done"), ("error", "failed"), ("purchase", "page")) for x in pair)), F.col("event_type"))
    return events.select(
        (F.col("user_id") % 50).alias("pool"), at.alias("at"), event.alias("event"), (F.col("user_id") % 3).cast("int").alias("device"), F.dayofmonth("ts").cast("long").alias("generation"), (F.col("event_id") % 4).alias("crop"),
        F.col("value").alias("ms"), (F.col("event_id") % 90 + 10).cast("int").alias("columns"),
    )


@query()
def dispatch_outcomes(spark, sf_dir):
    from pagewright.streaming import dispatch

    return dispatch.outcomes(messages(spark, sf_dir))
