"""Engines and what they refuse, jobs in flight, counters while something runs."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright import engine
from pagewright.backends import DICTIONARY, ReplayBackend, TemplateBackend
from pagewright.engine import Engine
from pagewright.errors import CODES, Refused, error
from pagewright.operators import catalog, measures, pixels, telemetry
from pagewright.plans import run_queries
from pagewright.sources import corpus, readers
from pagewright.streaming import capture, dispatch
from pagewright.streaming import telemetry as live

FOLDER = "/root/testdata/sf0.001"


# Engines ---------------------------------------------------------------------

@pytest.mark.parametrize(
    ("code", "attempt"),
    [
        ("nets-invalid", lambda: engine.chosen_nets([], True)),
        ("nets-invalid", lambda: engine.chosen_nets(["det", "x"], True)),
        ("target-size-invalid", lambda: engine.target_side("wide")),
        ("target-size-invalid", lambda: engine.target_side(0)),
        ("options-conflict", lambda: engine.run_options({}, half=True)),
        ("image-invalid", lambda: engine.pixels_of([1, 2])),
        ("image-invalid", lambda: engine.pixels_of(np.zeros((2, 2, 3)))),
        ("image-invalid", lambda: engine.pixels_of(np.zeros((0, 2, 3), np.uint8))),
        ("patch-invalid", lambda: engine.pixels_of(np.zeros((47, 2, 3), np.uint8), "patch-invalid", 48)),
        ("dictionary-invalid", lambda: Engine(TemplateBackend, ["a"])),
        ("net-unloaded", lambda: Engine(TemplateBackend, DICTIONARY, nets=["rec"]).detect(np.zeros((9, 9, 3), np.uint8))),
        ("detection-inference-failed", lambda: Engine(ReplayBackend, DICTIONARY).detect(np.zeros((9, 9, 3), np.uint8))),
        ("detection-output-invalid", lambda: Engine(lambda: ReplayBackend(detect=[np.zeros((1, 2, 2))]), DICTIONARY).detect(np.zeros((9, 9, 3), np.uint8))),
        ("orientation-inference-failed", lambda: Engine(lambda: ReplayBackend(orient=[[1, 2, 3]]), DICTIONARY).upright(np.zeros((48, 9, 3), np.uint8))),
        ("recognition-output-invalid", lambda: Engine(lambda: ReplayBackend(recognise=[np.zeros((2, 3, 4))]), DICTIONARY).read_packed([np.zeros((48, 9, 3), np.uint8)])),
        ("dictionary-mismatch", lambda: Engine(ReplayBackend, DICTIONARY).decode(np.zeros((2, 5)))),
    ],
)
def test_refusals(code, attempt):
    assert code in CODES
    with pytest.raises(Refused) as refused:
        attempt()
    assert refused.value.code == code


def test_defaults_and_switches():
    assert engine.chosen_nets(None, True) == ("det", "ori", "rec") and engine.chosen_nets(None, False) == ("det", "rec")
    assert engine.run_options(half=True) == catalog.options("fp16") and engine.run_options(accelerated=False)["accelerated"] is False
    assert engine.target_side("640") == 640
    with pytest.raises(ValueError, match="no crops"):
        engine.some([], "crops")
    with pytest.raises(ValueError, match="unknown refusal"):
        Refused("x", "y")
    with pytest.raises(ValueError, match="a strip needs a patch"):
        pixels.packed([])


class Failing(ReplayBackend):
    closed = 0

    def load(self):
        raise OSError("no weights")

    def close(self):
        Failing.closed += 1


def test_an_engine_that_does_not_open_is_closed():
    with pytest.raises(Refused, match="model-invalid: no weights"):
        Engine(Failing, DICTIONARY)
    assert Failing.closed == 1
    with Engine(TemplateBackend, DICTIONARY) as one:
        pass
    one.close()
    with pytest.raises(Refused, match="net-unloaded"):
        one.logits(np.zeros((48, 9, 3), np.uint8))


def test_a_failure_keeps_its_text_and_gets_its_stage():
    def step():
        raise MemoryError

    with pytest.raises(Refused, match="recognition-inference-failed: extract failed: MemoryError"):
        engine.guarded("recognition", "extract", step)


def test_strips_read_as_their_crops_do():
    page = np.ascontiguousarray(corpus.render(["first line", "second", "third line here"]))
    with Engine(TemplateBackend, DICTIONARY) as one:
        patches = [p for _, p in one.crops(page)]
        alone = [one.decode(one.logits(p)) for p in patches]
        assert [t for t, _ in one.read_grouped(patches, 0)] == [t for t, _ in alone]
        assert len(one.read_packed(patches)) == len(patches) == len(one.read_grouped(patches, 200))


def test_files_of_models(spark, tmp_path):
    files = catalog.model_files(spark).where("profile = 'v5-mobile'")
    root = tmp_path / "models"
    names = ["nihui-port/app/src/main/assets/PP_OCRv5_mobile_det.ncnn.param", "nihui-port/app/src/main/assets/PP_OCRv5_mobile_det.ncnn.bin", "ppocrv5_keys.txt"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    assert engine.absent_files(spark, files, str(root), ["det"]).count() == 0
    assert sorted(r["path"][-4:] for r in engine.absent_files(spark, files, str(root), ["det", "rec"]).collect()) == [".bin", "aram"]
    assert catalog.models_root(spark) == "models" and catalog.models_root(spark, "x") == "x"
    spark.conf.set(catalog.ROOT_SETTING, "/shared/m ")
    assert catalog.models_root(spark) == "/shared/m"
    spark.conf.unset(catalog.ROOT_SETTING)


def test_rows_carry_refusals(spark):
    row = spark.range(1).select(error("image-invalid", "why").alias("e")).first()["e"]
    assert (row["code"], row["detail"]) == ("image-invalid", "why")


def test_overhead_of_calls(spark):
    assert spark.range(1).select(measures.call_overhead(F.lit(5.0), F.lit(60.0), 20).alias("x")).first()["x"] == 2.0


# Jobs in flight --------------------------------------------------------------

def message(at, event, device=None, generation=None, crop=None, ms=None, columns=None):
    return {"at": at, "event": event, "device": device, "generation": generation, "crop": crop, "ms": ms, "columns": columns}


def play(*messages):
    pool = dispatch.Pool()
    return pool, [row[1:] for m in messages for row in dispatch.step(pool, m)]


def test_replies_count_for_their_page_and_set_prices():
    pool, rows = play(message(0, "ready", 0, ms=100.0, columns=100), message(0, "page", generation=1), message(1, "sent", 0, 1, 7), message(2, "done", 0, 1, 7, 300.0, 100), message(3, "page", generation=2), message(4, "done", 0, 1, 8, 1.0, 100))
    assert rows == [(0, 1, 7, "answer", 2.0), (0, 1, 8, "stale", 2.0)] and pool.prices == {"0": 2.0} and pool.flying == {}


def test_deadlines_retire_a_device_with_all_its_jobs():
    pool, rows = play(
        message(0, "ready", 0, ms=1.0, columns=1), message(0, "ready", 1, ms=1.0, columns=1), message(0, "page", generation=1), message(1, "sent", 0, 1, 1), message(100, "sent", 0, 1, 2), message(100, "sent", 1, 1, 3),
        message(121, "done", 1, 1, 3, 1.0, 1), message(122, "sent", 0, 1, 4),
    )
    assert rows == [(0, 1, 1, "worker-response-timeout", None), (0, 1, 2, "worker-response-timeout", None), (1, 1, 3, "answer", 1.0), (0, 1, 4, "worker-unavailable", None)] and list(pool.prices) == ["1"]
    assert play(message(0, "start", 3), message(31, "page", generation=1))[1] == [(3, None, None, "worker-start-timeout", None)]


def test_failures_purge_what_is_in_flight_and_odd_messages_break_the_protocol():
    pool, rows = play(message(0, "ready", 0, ms=1.0, columns=1), message(0, "sent", 0, 0, 2), message(0, "sent", 0, 0, 1), message(1, "died", 0), message(2, "done", 0, 0, 1, 1.0, 1), message(3, "what", 0))
    assert [r[3] for r in rows] == ["worker-died", "purged", "purged", "worker-protocol", "worker-protocol"] and [r[2] for r in rows[1:3]] == [1, 2] and not pool.flying


def test_outcomes_do_not_depend_on_batches(spark, tmp_path):
    messages = run_queries.messages(spark, FOLDER)
    wanted = sorted(map(repr, dispatch.outcomes(messages).collect()))
    assert wanted
    rows = sorted(spark.read.parquet(f"{FOLDER}/events.parquet").collect(), key=lambda r: r["ts"])
    third = len(rows) // 3
    schema = spark.read.parquet(f"{FOLDER}/events.parquet").schema
    for i in range(3):
        spark.createDataFrame(rows[i * third : (i + 1) * third if i < 2 else None], schema).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        next((tmp_path / f"part{i}").glob("*.parquet")).rename(tmp_path / f"{i}.parquet")
        time.sleep(1.1)  # files are taken in the order of their times
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "?.parquet").parquet(str(tmp_path))
    found = live.settled(dispatch.live_outcomes(run_queries._messages(events)), "append")
    assert sorted(map(repr, found.collect())) == wanted


def test_outcomes_query_against_the_rules(spark):
    pools = {}
    for m in run_queries.messages(spark, FOLDER).orderBy("at").collect():
        pools.setdefault(m["pool"], []).append(m.asDict())
    wanted = []
    for pool, messages in pools.items():
        state = dispatch.Pool()
        wanted += [(pool, *row) for m in messages for row in dispatch.step(state, m)]
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)) for r in run_queries.QUERIES["dispatch_outcomes"](spark, FOLDER).collect())


def test_answers_go_back_to_their_crops(spark):
    crops = spark.createDataFrame([(1, 1, 0, "a"), (1, 1, 1, "b")], "pool long, generation long, crop long, region string")
    answers = spark.createDataFrame([(1, 1, 1, "answer")], "pool long, generation long, crop long, outcome string")
    assert [r["region"] for r in dispatch.in_order(answers, crops).collect()] == ["b"]


# Counters --------------------------------------------------------------------

def card(root, name, busy, vendor="0x1002\n"):
    folder = root / name / "device"
    folder.mkdir(parents=True)
    for file, text in (("gpu_busy_percent", busy), ("vendor", vendor), ("device", "0x73ff\n")):
        (folder / file).write_text(text)
    return folder / "gpu_busy_percent"


def test_busy_counters_and_their_devices(spark, tmp_path):
    card(tmp_path, "card1", "7\n"), card(tmp_path, "card0", "0\n", "none")
    rows = readers.busy_devices(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r["name"], r["vendor_id"], r["device_id"], r["drm_node"]) for r in rows] == [("card0", None, 0x73FF, "card0"), ("card1", 0x1002, 0x73FF, "card1")]


def test_counters_are_sampled_while_a_block_runs(spark, tmp_path):
    busy = card(tmp_path, "card0", "5")
    card(tmp_path, "card1", "not now")
    with capture.sampled(spark, str(tmp_path / "card*/device/gpu_busy_percent"), str(tmp_path / "kept")):
        deadline = time.time() + 40
        while time.time() < deadline and not list((tmp_path / "kept" / "samples").glob("part-*")):
            time.sleep(0.2)
        busy.write_text("80")
        time.sleep(2)
    rows = spark.read.parquet(str(tmp_path / "kept" / "samples")).collect()
    assert {r["path"] for r in rows} == {str(busy)} and {5.0} <= {r["value"] for r in rows} <= {5.0, 80.0}


def test_counters_before_and_after_a_block_that_fails(spark, tmp_path):
    fdinfo = tmp_path / "fd"
    fdinfo.mkdir()
    text = "drm-driver:\ti915\ndrm-client-id:\t7\ndrm-pdev:\t0000:03\ndrm-engine-render:\t{} ns\n"
    (fdinfo / "3").write_text(text.format(100))
    (fdinfo / "4").write_text("pos:\t0\n")
    with pytest.raises(KeyError), capture.bracketed(spark, f"{fdinfo}/*", str(tmp_path / "kept")) as bracket:
        with pytest.raises(RuntimeError, match="not ended"):
            bracket.result()
        (fdinfo / "3").write_text(text.format(900))
        raise KeyError
    assert [(r["gain"], r["device"]) for r in bracket.result().collect()] == [(800, "0000:03")]


def test_proofs_and_devices(spark):
    chosen = spark.createDataFrame([("a", 1, 2, None)], "name string, vendor_id long, device_id long, drm_node string")
    seen = spark.createDataFrame([("a", 1, 2, "card0", 0.0), ("a", 1, 3, "card1", 9.0)], "name string, vendor_id long, device_id long, drm_node string, value double")
    assert not telemetry.activity_observed(seen, chosen, True)
    busy = seen.withColumn("value", F.lit(4.0))
    assert telemetry.activity_observed(busy, chosen, True) and not telemetry.activity_observed(busy, chosen, False)
    devices = spark.createDataFrame([(0, "soft", 3), (1, "big", 0)], "index int, name string, kind int")
    assert telemetry.selected_device(devices)["name"] == "big"
    with pytest.raises(Refused, match="worker-unavailable"):
        telemetry.selected_device(devices.where("kind = 3"))


def test_devices_are_ranked_over_runs_of_indices(spark):
    random.seed(2)
    rows = [(i, f"d{i}", random.randrange(4)) for i in random.sample(range(9000), 700)]
    found = {r["index"]: r["rank"] for r in telemetry.rank_devices(spark.createDataFrame(rows, "index int, name string, kind int")).collect()}
    kept = sorted((k, i) for i, _, k in rows if k < 3)
    assert found == {i: at + 1 for at, (_, i) in enumerate(kept)}


def test_matching_by_node_then_identity_then_name(spark):
    random.seed(5)
    pick = lambda: (random.choice("ab"), random.choice([None, 1, 2]), random.choice([None, 1, 2]), random.choice([None, "x", "y"]))
    samples, chosen = [(i, *pick()) for i in range(200)], [pick() for _ in range(3)]

    def same(a, b):
        if a[3] is not None and b[3] is not None:
            return a[3] == b[3]
        if None not in (*a[1:3], *b[1:3]):
            return a[1:3] == b[1:3]
        return a[0] == b[0]

    kinds = "name string, vendor_id long, device_id long, drm_node string"
    found = telemetry.matching_samples(spark.createDataFrame(samples, f"i long, {kinds}"), spark.createDataFrame(chosen, kinds))
    assert sorted(r["i"] for r in found.collect()) == [i for i, *d in samples if any(same(tuple(d), c) for c in chosen)]
