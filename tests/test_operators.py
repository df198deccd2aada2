"""Hand-made vectors of the engine's operators."""

import itertools
import random
import time
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagewright.backends import DICTIONARY, TemplateBackend, greedy
from pagewright.errors import Refused
from pagewright.functions import arrays as ar
from pagewright.functions import geometry as geo
from pagewright.functions import text as tx
from pagewright.operators import catalog, layout, pixels, policy, scheduling, scoring, telemetry
from pagewright.plans.queries import QUERIES
from pagewright.plans.read_pages import recognise, recognise_page, rendered, wrapped
from pagewright.sources import corpus, readers

REGION = "page_id long, region_id int, center_x double, center_y double, thickness double, length double, angle double, vertical boolean, text string, confidence double, box_score double"


def lines(spark, *regions):
    rows = [(1, i, *r) for i, r in enumerate(regions)]
    found = layout.reconstruct(spark.createDataFrame(rows, REGION)).orderBy("component", "region_id").collect()
    return found


def region(x, y, text, length=40.0, thickness=20.0, angle=90.0, confidence=0.9):
    return (float(x), float(y), thickness, float(length), float(angle), False, text, confidence, 0.9)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("regions", "texts"),
    [
        ([region(20, 50, "hello"), region(70, 50, "world")], ["hello world"]),
        ([region(20, 30, "a"), region(20, 70, "b")], ["a", "b"]),
        ([region(5, 50, "(", 10), region(40, 50, "value"), region(74, 50, ",", 8), region(104, 50, "next", 32), region(134, 50, ")", 8)], ["(value, next)"]),
        ([region(20, 50, "left"), region(90, 50, "right")], ["left   right"]),
        ([region(20, 50, "left  "), region(70, 50, "right")], ["left  right"]),
        ([region(80, 50, "שלום"), region(30, 50, "עולם"), region(1, 50, "!", 8)], ["שלום עולם!"]),
        ([region(20, 50, "left"), region(60, 50, ".", 8), region(100, 50, "ימין")], ["left", ".", "ימין"]),
        ([region(20, 50, "x"), region(20, 50, "x")], ["x", "x"]),
    ],
)
def test_lines(spark, regions, texts):
    assert [r["text"] for r in lines(spark, *regions)] == texts


def test_merged_rectangle(spark):
    row = lines(spark, region(20, 50, "hello"), region(70, 50, "world"))[0]
    assert (round(row["center_x"], 6), round(row["center_y"], 6), round(row["length"], 6), round(row["thickness"], 6), round(row["confidence"], 6)) == (45, 50, 90, 20, 0.9)
    d = 50 / np.sqrt(2)
    skew = lines(spark, region(100, 100, "skew", angle=45), region(100 + d, 100 - d, "line", angle=45))
    assert [r["text"] for r in skew] == ["skew line"] and round(skew[0]["angle"], 6) == 45 and round(skew[0]["length"], 6) == 90


def test_assembly_order_and_counts(spark):
    rows = [(1, i, *region(x, y, t)) for i, (x, y, t) in enumerate([(300, 50, "right"), (10, 200, "below"), (20, 50, "left"), (0, 0, "")])]
    found, counts = layout.assemble(spark.createDataFrame(rows, REGION))
    assert [r["text"] for r in found.orderBy("region_id").collect()] == ["left", "right", "below"]
    assert counts.first()["undecoded_regions"] == 1


@pytest.mark.parametrize(("classes", "scores", "text", "mean"), [([1, 1, 0, 1], [1.0] * 4, "aa", 1.0), ([0, 0], [1.0] * 2, "", 0.0), ([1, 0, 2], [2.0, 9.0, 4.0], "ab", 3.0), ([1, 0, 2, 0, 3], [1.0] * 5, "abc", 1.0)])
def test_ctc(spark, classes, scores, text, mean):
    read = ar.collapse(F.array(*map(F.lit, classes)), F.array(*map(F.lit, scores)), F.array(*map(F.lit, "abc")), 1)
    assert tuple(one(spark, read)) == (text, mean)
    logits = np.full((len(classes), 4), -10.0)
    logits[np.arange(len(classes)), classes] = scores
    assert greedy(logits, list("abc")) == (text, mean)


def test_ctc_offset_and_contracts():
    logits = np.full((3, 4), -10.0)
    logits[np.arange(3), [1, 0, 2]] = 1
    assert greedy(logits, ["", "a", "b", "c"], 0)[0] == "ab"
    with pytest.raises(Refused, match="blanks for 7"):
        greedy(np.zeros((2, 6)), ["", *"abcde"], 1)
    for shape in ((20,), (1, 1, 7, 20), (2, 7, 20), (0, 20), (7, 0), (7, 1)):
        with pytest.raises(Refused, match="recognition-output-invalid"):
            greedy(np.zeros(shape), list("abc"))


def test_geometry(spark):
    size = lambda w, h: tuple(one(spark, geo.scaled_size(F.lit(w), F.lit(h))))[:2]
    assert size(4001, 4000) == (640, 639) and size(300, 200) == (300, 200)
    assert 11 < one(spark, geo.unclip_offset(F.lit(16.0), F.lit(400.0))) < 12 and one(spark, geo.unclip_offset(F.lit(0.0), F.lit(0.0))) == 0
    grid = [(float(a), float(b), float(t)) for t in range(-180, 181, 7) for p in ((12, 40), (20, 300), (54, 129), (47, 1088)) for a, b in (p, p[::-1])]
    rows = spark.createDataFrame(grid, "a double, b double, t double").withColumn("o", geo.oriented(F.col("a"), F.col("b"), F.col("t"))).collect()
    for r in rows:
        assert r["o"]["vertical"] or r["o"]["thickness"] <= r["o"]["length"]
        assert tuple(r["o"]) == pytest.approx(pixels.oriented(r["a"], r["b"], r["t"]))


def test_regions_of_a_map():
    probability = np.zeros((40, 40))
    probability[10:20, 10:30] = 0.8
    (found,) = pixels.regions(probability)
    assert found.score == pytest.approx(0.8) and found.length > found.thickness and not found.vertical
    cx, cy, a, b, _ = pixels.least_rectangle(np.array([[0, 0], [10, 10], [5, 15], [-5, 5]]))
    assert sorted((a, b)) == pytest.approx([np.sqrt(50), np.sqrt(200)]) and (cx, cy) == pytest.approx((2.5, 7.5))
    page = np.full((100, 400, 3), 255, np.uint8)
    page[40:60, 50:350] = 0
    patch = pixels.crop(page, pixels.Region(200, 50, 20, 300, 90, False, 1.0))
    assert patch.shape[0] == 48 and 600 <= patch.shape[1] <= 800 and (patch[24, 50:-50] == 0).all()
    assert [pixels.orientation_patch(np.zeros((48, w, 3), np.uint8)).shape for w in (24, 120, 400)] == [(80, 160, 3)] * 3
    with pytest.raises(ValueError, match="0 or 180"):
        pixels.rotated(patch, 90)


def test_text(spark):
    assert one(spark, tx.normalised(F.lit(" a  b é "))) == "a b é"
    assert one(spark, tx.scripts(F.lit("Aα Я א ع ა ひ カ 花"))) == ["Latn", "Grek", "Cyrl", "Hebr", "Arab", "Geor", "Hira", "Kana", "Hani"]
    assert [one(spark, tx.direction(F.lit(t))) for t in ("a", "א", "a א", "12", "")] == ["ltr", "rtl", "mixed", "neutral", "neutral"]
    words = lambda t: F.array(*map(F.lit, t))
    assert one(spark, tx.word_distance(words("abc"), words("ac"))) == 1
    assert one(spark, F.levenshtein(F.lit("ação"), F.lit("acao"))) == 2


def test_assignment():
    random = np.random.default_rng(5)
    for n in range(6):
        for _ in range(20):
            costs = random.integers(0, 9, (n, n))
            least = min((sum(costs[i, p] for i, p in enumerate(order)) for order in itertools.permutations(range(n))), default=0)
            assert scoring.least_assignment(costs.tolist()) == least


@pytest.mark.parametrize(("truth", "seen", "distance", "length", "exact"), [(["tea"], ["teapots"], 4, 3, False), (["north", "by"], ["worth"], 3, 7, False), (["left right", "up"], ["up", "left   right"], 0, 12, True), ([], [], 0, 0, True), ([], ["extra"], 5, 0, False)])
def test_scores(spark, truth, seen, distance, length, exact):
    row = scoring.score_cases(spark.createDataFrame([(truth, seen)], "truth_lines array<string>, observed_lines array<string>")).first()
    assert (row["char_distance"], row["char_length"], row["exact"], row["cer"]) == (distance, length, exact, distance / max(1, length))


@pytest.mark.parametrize(("text", "confidence", "page", "model", "kept"), [("花", 0.41, ["en"], [], False), ("花", 0.41, ["zh-Hans"], [], True), ("花", 0.41, [], ["zh"], True), ("花", 0.41, [], [], True), ("花", 0.6, ["en"], [], True), ("木", 0.1, ["en"], [], True), ("花", 0.41, [], ["en"], False)])
def test_policy(spark, text, confidence, page, model, kept):
    strings = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    expected = policy.expected_scripts(strings([]), strings(page), strings([]), strings(model))
    assert one(spark, policy.accepted(F.lit(text), F.lit(confidence), ["花"], expected)) is kept
    with pytest.raises(ValueError, match="between"):
        policy.accepted(F.lit(text), F.lit(confidence), [], expected, 1.5)


def test_schedule():
    assert {d for d, *_ in scheduling.simulate({0: 1.0, 1: 10.0}, [300, 200, 100])} == {0}
    assert {d for d, *_ in scheduling.simulate({0: 1.0, 1: 1.2}, [300, 200, 100])} == {0, 1}
    # The first crop takes four times its price, so the device's price rises and the other one gets the rest.
    assert scheduling.simulate({0: 1.0, 1: 1.2}, [100, 90, 80], {0: 4.0, 1: 1.2}) == [(1, 1, 0.0, 108.0), (1, 2, 108.0, 204.0), (0, 0, 0.0, 400.0)]
    assert scheduling.simulate({0: 1.0}, []) == []
    for costs, widths in (({}, [1]), ({0: 0}, [1]), ({0: 1}, [0])):
        with pytest.raises(ValueError, match="device|above zero"):
            scheduling.simulate(costs, widths)


def stepwise(costs, widths, speeds):
    """The scheduling rules one at a time, on plain lists."""
    left = sorted(range(len(widths)), key=lambda i: (-widths[i], i))
    price, given, busy, out, now = dict(costs), dict.fromkeys(costs, 0.0), {}, [], 0.0
    while left or busy:
        least = min(price.values())
        for d in sorted((d for d in costs if d not in busy), key=price.get):
            if not left:
                break
            if price[d] <= 1.5 * least:
                crop = left[0]
            elif given[d] + price[d] * widths[left[-1]] <= least * sum(widths[i] for i in left):
                crop = left[-1]
            else:
                continue
            left.remove(crop)
            given[d] += price[d] * widths[crop]
            busy[d] = (now + speeds[d] * widths[crop], crop, now)
        d = min(busy, key=lambda x: (busy[x][0], x))
        now, crop, start = busy.pop(d)
        out.append((d, crop, start, now))
        price[d] = (price[d] + (now - start) / widths[crop]) / 2
    return out


def test_schedule_against_the_rules_one_at_a_time():
    random.seed(6)
    for _ in range(400):
        costs = {d: random.choice([1.0, 1.3, 2.0, 3.5]) for d in range(random.randint(1, 4))}
        speeds = {d: c * random.choice([1, 1, 2, 0.5]) for d, c in costs.items()}
        widths = [random.randint(1, 300) for _ in range(random.randint(0, 25))]
        assert scheduling.simulate(costs, widths, speeds) == stepwise(costs, widths, speeds)


def test_schedule_query(spark):
    pages = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").orderBy("l_linenumber", "l_partkey", "l_suppkey").collect():
        pages.setdefault(r["l_orderkey"], []).append(int(r["l_quantity"] * 10))
    found = {}
    for r in QUERIES["schedule_sim"](spark, "/root/testdata/sf0.001").collect():
        found.setdefault(r["page_id"], []).append((r["device"], r["crop"] - 1, r["start"], r["end"]))
    costs = {0: 1.0, 1: 1.2, 2: 4.0}
    assert found == {page: stepwise(costs, widths, costs) for page, widths in pages.items()}


def test_completions_of_crops_not_given(spark):
    rows = lambda *r: spark.createDataFrame(r, "page_id long, device int, crop long")
    assert [tuple(r) for r in scheduling.unasked_completions(rows((1, 0, 5), (1, 1, 6)), rows((1, 0, 5), (1, 0, 6))).collect()] == [(1, 0, 6)]


def test_direction_of_every_code_point(spark):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    wanted = {"L": "ltr", "R": "rtl", "AL": "rtl"}
    rows = spark.createDataFrame(pd.DataFrame({"c": points, "text": [chr(c) for c in points]}))
    told = {r["c"]: r["d"] for r in rows.select("c", tx.direction(F.col("text")).alias("d")).where("d <> 'neutral'").collect()}
    assert told == {c: wanted[b] for c in points if (b := unicodedata.bidirectional(chr(c))) in wanted}


def test_words_beyond_a_plane_of_letters(spark):
    words = F.transform(F.sequence(F.lit(1), F.lit(140_000)), lambda i: F.concat(F.lit("w"), i))
    coded = spark.range(1).select(tx.word_codes(F.slice(words, 139_999, 2), words).alias("c")).first()["c"]
    assert len(coded) == 2 and coded[0] != coded[1]
    assert one(spark, tx.word_distance(F.split(F.lit("a b c d"), " "), F.split(F.lit("a x c"), " "))) == 2


def test_long_crops_take_time_in_proportion(spark):
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(40_000)), lambda i: (i % 3).cast("int")).alias("c")).select("c", F.transform("c", lambda c: F.lit(1.0)).alias("p"))
    began = time.perf_counter()
    assert len(rows.select(ar.collapse(F.col("c"), F.col("p"), F.array(F.lit("a"), F.lit("b")), 1)["text"].alias("t")).first()["t"]) == 26_667
    assert time.perf_counter() - began < 10


def test_borders_and_holes():
    u = np.zeros((30, 40))
    u[5:25, 5:10] = u[5:25, 30:35] = u[20:25, 5:35] = 0.9
    assert [round(r.score, 6) for r in pixels.regions(u)] == [0.9]
    u[5:10, 5:35] = 0.9  # closed: the hole counts, and has a border of its own
    inside = u[5:25, 5:35]
    assert [round(r.score, 6) for r in pixels.regions(u)] == [round(float(inside.mean()), 6)]
    full = np.full((30, 40), 0.9)
    full[10, 10] = 0.1
    found = pixels.regions(full, 0.3, 0.3)
    assert len(found) == 2 and round(found[1].score, 6) == round((4 * 0.9 + 0.1) / 5, 6)
    for line in ([(3, 3)], [(3, 3), (3, 4), (3, 5)], [(3, 3), (4, 4), (5, 5)], [(3, 5), (4, 4), (5, 3)]):
        page = np.zeros((9, 9))
        page[tuple(zip(*line, strict=True))] = 1
        assert pixels.regions(page, 0.1, 0.1) == []
    bent = np.zeros((9, 9))
    bent[[3, 3, 4], [3, 4, 5]] = 1
    assert len(pixels.regions(bent, 0.1, 0.1)) == 1


def plain_enclosed(mask):
    """Everything that cannot be reached from outside without crossing a pixel of the mask, by sides."""
    h, w = mask.shape
    seen, todo = set(), [(-1, -1)]
    while todo:
        y, x = todo.pop()
        if (y, x) in seen or not (-1 <= y <= h and -1 <= x <= w) or (0 <= y < h and 0 <= x < w and mask[y, x]):
            continue
        seen.add((y, x))
        todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return {(y, x) for y in range(h) for x in range(w)} - seen


def test_borders_against_flooding():
    random_ = np.random.default_rng(8)
    for _ in range(60):
        mask = random_.random((9, 11)) < random_.choice([0.3, 0.5, 0.7])
        outer = [(ys, xs, fy, fx) for ys, xs, fy, fx in pixels.borders(mask)]
        for ys, xs in pixels.blobs(mask):
            own = np.zeros(mask.shape, bool)
            own[ys, xs] = True
            mine = next(b for b in outer if len(b[0]) == len(ys) and (b[0] == ys).all() and (b[1] == xs).all())
            assert set(zip(mine[2].tolist(), mine[3].tolist(), strict=True)) == plain_enclosed(own)


@pytest.mark.parametrize("angle", range(-90, 91, 5))
def test_both_statements_of_the_turning_rules_agree(spark, angle):
    sides = [(a, b) for a in (1.0, 5.0, 14.0, 30.0) for b in (1.0, 5.0, 14.0, 30.0)]
    rows = spark.createDataFrame([(a, b, float(angle)) for a, b in sides], "a double, b double, angle double").select("*", geo.oriented(F.col("a"), F.col("b"), F.col("angle")).alias("o")).collect()
    assert [tuple(r["o"]) for r in rows] == [pixels.oriented(r["a"], r["b"], r["angle"]) for r in rows]


def test_tensors():
    page = np.full((20, 30, 3), 255, np.uint8)
    prepared = pixels.normalised(page, pixels.DET_MEAN, pixels.DET_NORM)
    assert prepared[0, 0] == pytest.approx([(255 - m) * n for m, n in zip(pixels.DET_MEAN, pixels.DET_NORM, strict=True)])
    assert pixels.line_input(page[:10]).shape == (48, 144, 3) and pixels.line_input(page).max() == pytest.approx(1)
    assert pixels.orientation_input(page).shape == (80, 160, 3)


def test_devices(spark):
    devices = spark.createDataFrame([(0, "soft", 3), (1, "igp", 1), (2, "big", 0), (3, "big2", 0)], "index int, name string, kind int")
    assert [r["name"] for r in telemetry.rank_devices(devices).orderBy("rank").collect()] == ["big", "big2", "igp"]
    text = "drm-driver:\ti915\ndrm-client-id:\t7\ndrm-pdev:\t0000:03\ndrm-engine-render:\t{} ns\n"
    before, after = (telemetry.parse_fdinfo(spark.createDataFrame([(text.format(n),), ("nothing",)], "value string")) for n in (100, 900))
    assert telemetry.counter_gain(before, after, ["driver", "client", "pdev"]).first()["gain"] == 800
    assert telemetry.counter_gain(after, before, ["driver", "client", "pdev"]).first()["gain"] == 0
    selected = spark.createDataFrame([("a", 1, 2, None)], "name string, vendor_id int, device_id int, drm_node string")
    samples = spark.createDataFrame([("a", 1, 2, "card0"), ("b", 1, 2, "card1")], "name string, vendor_id int, device_id int, drm_node string")
    assert telemetry.ambiguous(selected, samples).count() == 1 and telemetry.matching_samples(samples, selected).count() == 2


def test_catalog(spark):
    facts = {r["profile"]: r for r in catalog.profiles(spark).collect()}
    assert len(facts) == 4 and facts["v5-mobile"]["ctc_offset"] == 1 and facts["v6-tiny"]["ctc_offset"] == 0
    on = {p: {f for f, x in catalog.options(p).items() if x} for p in catalog.PRECISION}
    always = {"accelerated", "int8_inference", "int8_packed", "int8_storage"}
    assert on == {"fp32": always, "fp16": always | {"fp16_packed", "fp16_storage", "fp16_arithmetic"}, "int8": always | {"int8_arithmetic"}}
    with pytest.raises(ValueError, match="unknown precision"):
        catalog.options("fp8")


def test_parity(spark):
    wanted = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, variant string")
    got = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("c", "z", 3), ("d", "x", 4), ("d", "x", 5), ("c", "y", 0), ("e", "q", 6), ("e", "x", 7)], "id string, variant string, place int")
    wanted = wanted.unionByName(spark.createDataFrame([("e", "x"), ("e", "x")], wanted.schema))
    assert {(r["id"], r["problem"]) for r in scoring.case_parity(wanted, got).collect()} == {("a", "duplicate"), ("b", "missing"), ("c", "duplicate"), ("c", "variant"), ("d", "extra"), ("d", "duplicate"), ("e", "listed"), ("e", "duplicate")}


def test_pages_are_read_back(spark, tmp_path):
    text = "Seven grey boxes were moved up the quay, (twice) 1234567890 and left again."
    backend = TemplateBackend()
    backend.load()
    for variant in ("clean", "skew-2deg", "blur-3px", "lossy-q40"):
        page = np.ascontiguousarray(corpus.VARIANTS[variant](corpus.render(wrapped(text, 40))))
        assert " ".join(t for _, t, _ in recognise_page(page, backend, DICTIONARY)) == text
    assert recognise_page(np.full((64, 64, 3), 255, np.uint8), backend, DICTIONARY) == []
    with pytest.raises(Refused, match="image-invalid"):
        recognise_page(np.zeros((4, 4), np.uint8), backend, DICTIONARY)
    (tmp_path / "a.png").write_bytes(corpus.png(corpus.render([text[:20]])))
    (tmp_path / "b.png").write_bytes(b"no image")
    rows = {r["origin"][-5:]: r for r in readers.images(spark, str(tmp_path)).collect()}
    assert rows["b.png"]["height"] == -1
    page = spark.createDataFrame([(1, rows["a.png"]["height"], rows["a.png"]["width"], bytes(rows["a.png"]["data"])), (2, 5, 5, b"short")], "page_id long, height int, width int, data binary")
    found = recognise(page).collect()
    assert " ".join(r["text"] for r in found if r["page_id"] == 1) == text[:20].strip() and next(r for r in found if r["page_id"] == 2)["error"]
    assert rendered(spark.createDataFrame([(1, None)], "page_id long, text string")).count() == 1


CASE = {
    "id": "a", "script": "Latn", "language": "en-GB", "direction": "ltr", "lines": ["x"], "font": None, "palette": {"foreground": "#000000", "background": "#ffffff"}, "size": {"font_px": None, "width_px": 5, "height_px": 6},
    "background_objects": [{"kind": "line", "bounds": [0, 1, 2, 3], "fill": "#123456"}], "content_label": "text", "known_false_readings": [], "recognition": {"pagewright": {"model": "m"}, "paddleocr": None, "tesseract": {"language": "eng"}},
    "variant": "clean", "image": "a.png",
}


def test_sources(spark, tmp_path):
    (tmp_path / "keys.txt").write_text("a\nb\n \n", encoding="utf-8")
    assert readers.dictionary(spark, str(tmp_path / "keys.txt")) == ["a", "b", " "]
    (tmp_path / "few.txt").write_text("a\n", encoding="utf-8")
    with pytest.raises(Refused, match="dictionary-invalid"):
        readers.dictionary(spark, str(tmp_path / "few.txt"))
    case = CASE | {"id": "a"}
    readers.write_manifest(str(tmp_path / "ground-truth.json"), {"schema_version": 4, "cases": [case]})
    assert readers.cases(spark, str(tmp_path)).first()["id"] == "a"
    for broken, said in (([CASE, CASE], "repeat"), ([CASE | {"lines": ["x", ""]}], r"cases\.0: lines\.1"), ([CASE, {k: v for k, v in CASE.items() if k != "font"}], r"cases\.1: case: no font")):
        with pytest.raises(ValueError, match=said):
            readers.write_manifest(str(tmp_path / "x.json"), {"schema_version": 4, "cases": broken})
    assert not (tmp_path / "x.json").exists()
    with pytest.raises(ValueError, match="not a manifest"):
        readers.write_manifest(str(tmp_path / "x.json"), {"schema_version": 3, "cases": []})


def test_benchmark_pages(spark):
    from pagewright.plans.read_pages import read_and_score

    texts = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").selectExpr("item_id AS page_id", "text").where("item_id < 6")
    rows = read_and_score(spark, texts).collect()
    assert len(rows) == 6 and sum(r["char_distance"] for r in rows) <= 0.01 * sum(r["char_length"] for r in rows)
