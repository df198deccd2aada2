"""Reading stage by stage: equal to the fused read, and what was refused comes along."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright import engine
from pagewright.__main__ import main
from pagewright.backends import DICTIONARY, ReplayBackend, TemplateBackend
from pagewright.engine import Engine
from pagewright.errors import Refused
from pagewright.operators import catalog, pixels
from pagewright.plans import read_pages as reading
from pagewright.sources import corpus

TEXT = "Nine small ships left port at dawn, all bound (it is said) for 24 bays."
PAGE = "page_id long, height int, width int, data binary"


def page(i, image):
    return (i, image.shape[0], image.shape[1], np.ascontiguousarray(image[..., ::-1]).tobytes())


def pages_of(spark, *rows):
    return spark.createDataFrame(list(rows), PAGE).repartition(2)


def rows_of(df):
    return sorted(repr([round(x, 4) if isinstance(x, float) else x for x in r]) for r in df.collect())


@pytest.mark.parametrize("turned", [False, True])
def test_stages_equal_the_fused_read(spark, turned):
    image = corpus.render(reading.wrapped(TEXT, 30))
    image = image[::-1, ::-1] if turned else image
    pages = pages_of(spark, page(1, image), page(2, np.full((50, 60, 3), 255, np.uint8)), page(3, corpus.skewed(image, 2.0)))
    staged = reading.recognise(pages, spread=5)
    assert rows_of(staged) == rows_of(reading.recognise_fused(pages).select(staged.columns))
    lines = reading.read_pages(pages).where("page_id = 1").orderBy("center_y").collect()
    assert " ".join(r.text for r in (reversed(lines) if turned else lines)) == TEXT or turned  # turned lines are upright, their order is the page's
    assert set(" ".join(r.text for r in lines).split()) == set(TEXT.split())


def test_orientation_gets_its_tensor():
    seen = []

    class Net(TemplateBackend):
        def orient(self, patch):
            seen.append((patch.shape, patch.dtype, float(patch.min()), float(patch.max())))
            return super().orient(patch)

    with Engine(Net, DICTIONARY) as own:
        for text in ("to", "a line of words", TEXT):
            for unit in (2, 3, 5):
                patch = corpus.render([text], unit, 4)
                patch = pixels.bilinear(patch, max(1, patch.shape[1] * 48 // patch.shape[0]), 48)
                assert own.upright(patch)[1] == 0 and own.upright(np.ascontiguousarray(patch[::-1, ::-1]))[1] == 180
    assert all(s[:2] == ((80, 160, 3), np.float32) and -1 <= s[2] and s[3] <= 1 for s in seen)


def test_each_stage_says_what_it_does(spark):
    pages = pages_of(spark, page(1, corpus.render(["one two", "three"])))
    detected = reading.detect(pages)
    assert [len(r.boxes) for r in detected.collect()] == [3] and detected.columns == [c.split()[0] for c in ("page_id", "height", "width", "data", "boxes", "error")]
    cropped = reading.crops(detected)
    assert all(len(r.patch) == 48 * r.patch_width * 3 for r in cropped.collect())
    assert {r.turned for r in reading.orient(cropped).collect()} == {0}
    scored = reading.logits(cropped)
    assert all(len(r.logits) == 4 * r.steps * r.classes and r.classes == len(DICTIONARY) + 1 for r in scored.collect())
    assert sorted(r.text for r in reading.decode(scored).collect()) == ["one", "three", "two"]


def test_crops_of_one_page_reach_all_tasks(spark):
    image = corpus.render([" ".join(["ab"] * 25)] * 8, 2)
    cropped = reading.crops(reading.detect(pages_of(spark, page(1, image))))
    assert cropped.count() == 200
    assert cropped.select(F.spark_partition_id()).distinct().count() == 1
    found = reading.recognise(pages_of(spark, page(1, image)), spread=8).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in found}) == 8 and {r.text for r in found} == {"ab"}


def test_refusals_are_rows(spark):
    good = corpus.render(["fine"])
    pages = pages_of(spark, page(1, good), (2, 5, 5, b"short"), (3, -1, -1, None), (4, 0, 9, b""), page(5, corpus.render(["also"])))
    for fused in (False, True):
        done = reading.read(pages, fused=fused)
        assert (done.regions, done.refused) == (2, 3)
        assert sorted(r.text for r in done.lines.collect()) == ["also", "fine"]
        assert sorted((r.page_id, r.code) for r in done.refusals.collect()) == [(2, "image-invalid"), (3, "image-invalid"), (4, "image-invalid")]
    with pytest.raises(Refused, match="page 2: image-invalid.*page 3"):
        reading.read_pages(pages)


def test_a_crop_is_refused_and_others_are_read(spark):
    class Net(TemplateBackend):
        def recognise(self, patch):
            if patch.shape[1] > 300:
                raise RuntimeError("too wide for me")
            return super().recognise(patch)

    done = reading.read(pages_of(spark, page(1, corpus.render(["short", "averyverylongwordindeed"]))), factory=Net)
    assert [r.text for r in done.lines.collect()] == ["short"]
    refused = done.refusals.collect()
    assert [(r.page_id, r.code, r.detail) for r in refused] == [(1, "recognition-inference-failed", "extract failed: too wide for me")] and refused[0].region_id is not None


def test_no_pages(spark):
    done = reading.read(spark.createDataFrame([], PAGE))
    assert (done.regions, done.refused, done.lines.collect(), done.refusals.collect()) == (0, 0, [], [])


def test_engines_that_cannot_open():
    def absent():
        import no_such_runtime  # noqa: F401

    class Unfound(ReplayBackend):
        def load(self):
            raise FileNotFoundError("det.param")

    for factory, code in ((absent, "runtime-missing"), (Unfound, "model-missing")):
        with pytest.raises(Refused, match=code):
            Engine(factory, DICTIONARY)


def test_models_are_checked_before_a_read(spark, tmp_path):
    models = catalog.model_files(spark).where("profile = 'v6-tiny'")
    with pytest.raises(Refused, match="model-missing"):
        engine.require_files(spark, models, str(tmp_path / "nowhere"), ["det", "rec"])
    paths = {r.path for r in engine.absent_files(spark, models, str(tmp_path / "nowhere"), ["det", "rec"]).collect()}
    for path in paths:
        (tmp_path / "m" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "m" / path).write_bytes(b"x")
    engine.require_files(spark, models, str(tmp_path / "m"), ["det", "rec"])
    # A file of that name elsewhere is not the one that is needed.
    one = sorted(paths)[0]
    (tmp_path / "m" / "other").mkdir()
    (tmp_path / "m" / one).rename(tmp_path / "m" / "other" / one.split("/")[-1])
    assert [r.path for r in engine.absent_files(spark, models, str(tmp_path / "m"), ["det", "rec"]).collect()] == [one]


def test_command_tells_what_it_could_not_read(spark, tmp_path, capsys):
    (tmp_path / "a.png").write_bytes(corpus.png(corpus.render(["hello there"])))
    assert main([str(tmp_path)]) == 0 and "\thello" in capsys.readouterr().out
    (tmp_path / "b.png").write_bytes(b"no image")
    assert main([str(tmp_path), "--all-gpus"]) == 2
    told = capsys.readouterr()
    assert "hello" in told.out and "1 refused" in told.out and "b.png\timage-invalid" in told.err
    with pytest.raises(SystemExit):
        main([str(tmp_path), "--models-root", str(tmp_path)])
    (tmp_path / "none").mkdir()
    with pytest.raises(SystemExit):
        main([str(tmp_path / "none")])
