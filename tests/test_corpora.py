"""Corpora, corpus runs and their comparison, from made pages to the printed table."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import catalog, manifest
from pagewright.plans import compare, run_corpus
from pagewright.plans.read_pages import rendered
from pagewright.sources import corpora, corpus, readers, sinks
from pagewright.sources.__main__ import main as command


@pytest.fixture(scope="module")
def orientation(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("orientation"))
    assert corpora.write(spark, "orientation", folder) == 4
    return folder


@pytest.mark.parametrize(("name", "n"), [("benchmark", 55), ("script", 27), ("orientation", 4)])
def test_corpora(spark, name, n):
    rows = corpora.cases(spark, name).select("place", "case", F.length("content").alias("bytes")).orderBy("place").collect()
    assert len(rows) == n and all(r["bytes"] > 100 for r in rows)
    cases = [json.loads(r["case"]) for r in rows]
    assert len({c["id"] for c in cases}) == n
    frame = spark.createDataFrame([(r["place"], r["case"]) for r in rows], "place long, case string")
    assert frame.where(F.size(manifest.case_problems(F.col("case"))) > 0).count() == 0
    if name == "script":
        assert [c["content_label"] for c in cases].count("text") == 24 and sum(not c["lines"] for c in cases) == 2
        assert all(len(c["background_objects"]) == (0 if c["variant"] == "clean" else 2) for c in cases if c["content_label"] == "text")


def test_quarter_turns_and_decorations():
    page = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    turned = corpora.quarter_turned(page, 90)
    assert turned.shape == (4, 2, 3) and (turned[0, 1] == page[0, 0]).all() and (corpora.quarter_turned(turned, 270) == page).all()
    with pytest.raises(ValueError, match="multiple"):
        corpora.quarter_turned(page, 45)
    blank, records = corpora.decorated(np.full((100, 200, 3), 255, np.uint8), {"foreground": "#000000", "background": "#102030"}, ("circle", "rectangle", "polygon"))
    assert [r["kind"] for r in records] == ["circle", "rectangle", "polygon"] and tuple(blank[50, 100]) == (16, 32, 48)
    for r in records:
        x, y, w, h = r["bounds"]
        assert 0 <= x and x + w <= 200 and 0 <= y and y + h <= 100 and tuple(blank[y + h // 2, x + w // 2]) == tuple(int(r["fill"][i : i + 2], 16) for i in (1, 3, 5))
    assert corpora.objects_of(200, 100, ("circle",)) == records[:1]


def test_run_and_compare(spark, orientation, tmp_path):
    upright = {"orientation-000deg", "orientation-180deg"}
    rows = run_corpus.run_corpus(spark, orientation, engine="stand-in/one", device="none").cache()
    found = {r["id"]: r for r in rows.collect()}
    assert len(found) == 4 and all(r["ms"] > 0 and r["selection"] == '{"model":"v6-medium"}' for r in found.values())
    assert {i for i, r in found.items() if r["exact"]} >= {"orientation-000deg"} and all(len(found[i]["truth_lines"]) == 2 for i in upright)
    assert "cer=0.000" in run_corpus.progress(rows).where("id = 'orientation-000deg'").first()["line"]
    sinks.write_results(rows, str(tmp_path / "results"))
    back = readers.results(spark, str(tmp_path / "results" / "*.json"))
    assert sorted(r["id"] for r in back.collect()) == sorted(found)
    cases = readers.cases(spark, orientation)
    other = back.withColumn("engine", F.lit("other")).withColumn("char_distance", F.lit(1).cast("long"))
    both = compare.compare(back.unionByName(other), cases)
    text = compare.report(both)
    assert text.splitlines()[2].startswith("other ") and text.splitlines()[3].startswith("stand-in/one") and "one" in text.splitlines()[5]
    assert len([line for line in text.splitlines() if line.startswith("orientation-")]) == 4
    broken = back.where("id <> 'orientation-090deg'").unionByName(back.where("id = 'orientation-000deg'").withColumn("variant", F.lit("x")).withColumn("place", F.lit(99)))
    with pytest.raises(ValueError, match=r"stand-in/one: 1 duplicate: orientation-000deg; 1 missing: orientation-090deg; 1 variant: orientation-000deg"):
        compare.compare(broken.unionByName(other), cases)
    with pytest.raises(ValueError, match="lists ids twice: orientation-000deg"):
        compare.compare(back, cases.unionByName(cases.where("id = 'orientation-000deg'")))
    with pytest.raises(ValueError, match="no results"):
        compare.compare(back.where("false"), cases)
    with pytest.raises(ValueError, match="no paddleocr model is declared for orientation-000deg"):
        run_corpus.run_corpus(spark, orientation, engine="x", device="x", selector="paddleocr")


def test_letters_that_a_font_lacks(spark):
    texts = spark.createDataFrame([(1, "ab c‍é"), (2, "\t ")], "id long, text string")
    coverage = spark.createDataFrame([("a",), ("c",)], "letter string")
    assert sorted((r["id"], r["letter"]) for r in corpora.uncovered(texts, coverage, F.col("text")).collect()) == [(1, "b"), (1, "é")]


def test_fonts_by_role_and_language():
    assert corpora.font("alternate", "en")["family"] == "ruled-wide" and corpora.font("alternate", "ar")["family"] == "ruled"


def test_other_programs_read_and_fail(spark):
    cases = spark.createDataFrame([("a", b"one\n\n two \n")], "id string, image binary")
    row = run_corpus.read_with(cases, ["cat"]).first()
    assert (row["observed_lines"], row["error"]) == (["one", " two "], None) and row["ms"] > 0
    assert run_corpus.read_with(cases, ["head", "-c", "3", "{}"]).first()["observed_lines"] == ["one"]
    assert run_corpus.read_with(cases, ["false"]).first()["error"].startswith("exit 1")


def test_phases_of_reading(spark):
    pages = rendered(spark.createDataFrame([(1, "one two three"), (2, "")], "page_id long, text string"))
    found = {(r["page_id"], r["phase"]): r["calls"] for r in run_corpus.phases(pages).collect()}
    assert found == {(1, "detect"): 1, (1, "crop"): 3, (1, "orient"): 3, (1, "recognise"): 3, (2, "detect"): 1}


def test_corpus_command(tmp_path, capsys, spark):
    with pytest.raises(SystemExit):
        command([str(tmp_path)])
    with pytest.raises(SystemExit):
        command(["--script", "--orientation", str(tmp_path)])
    assert command(["--orientation", str(tmp_path)]) == 0 and "4 cases" in capsys.readouterr().out


def test_catalog_takes_new_rows(spark):
    catalog.register(detectors=[("own-det", "own.param", "a", "b", "int8")], profiles=[("own", "own-det", "v6-tiny-rec", None)])
    row = catalog.profiles(spark).where("profile = 'own'").first()
    assert (row["det_in"], row["rec_in"], row["required_precision"], row["orients"]) == ("a", "input", ["int8"], False)
    with pytest.raises(ValueError, match="already"):
        catalog.register(profiles=[("own", "own-det", "v6-tiny-rec", None)])
    for kind in catalog._added.values():
        kind.clear()


def test_lossy_codec_loses_more_at_lower_quality():
    r = np.random.default_rng(4)
    page = corpus.render(["a page of words", "and more"], 3)
    page = np.clip(page + r.normal(0, 12, page.shape) + np.linspace(0, 40, page.shape[1])[None, :, None] * [1, 0, -1], 0, 255).astype(np.uint8)
    ratio = lambda q: 10 * np.log10(255**2 / np.mean((page.astype(float) - corpus.lossy(page, q)) ** 2))
    ratios = [ratio(q) for q in (1, 10, 25, 50, 75, 90, 100)]
    assert ratios == sorted(ratios) and ratios[-1] > 25 and ratios[0] < 20
    for shape in ((1, 1), (8, 8), (9, 17), (30, 7)):
        flat = np.full((*shape, 3), (10, 200, 90), np.uint8)
        assert np.abs(corpus.lossy(flat, 95).astype(int) - flat).max() <= 3
    gray = np.repeat(page[..., :1], 3, axis=2)
    assert np.ptp(corpus.lossy(gray, 30), axis=2).max() == 0  # no colour comes from none
    # One block by the definition of the transform.
    block = r.integers(0, 256, (8, 8)).astype(float)
    table = np.full((8, 8), 16.0)
    direct = np.zeros((8, 8))
    wave = lambda n, k: np.cos(np.pi * (2 * n + 1) * k / 16) * (np.sqrt(0.5) if k == 0 else 1) / 2
    for u in range(8):
        for v in range(8):
            c = sum((block[y, x] - 128) * wave(y, u) * wave(x, v) for y in range(8) for x in range(8))
            direct += np.rint(c / 16) * 16 * np.array([[wave(y, u) * wave(x, v) for x in range(8)] for y in range(8)])
    assert np.allclose(corpus._coded(block, table), direct + 128)
    with pytest.raises(ValueError, match="quality"):
        corpus.lossy(page, 0)
