"""Model profiles as joins of small tables: detector, recogniser, precision, port."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_V6, _V5 = "PaddleOCR-ncnn-CPP/models", "nihui-port/app/src/main/assets"
# Fixed values: (name, graph, input blob, output blob, required precision).
DETECTORS = [
    ("v6-medium-det", f"{_V6}/PP_OCRv6_medium_det.param", "input", "output", None),
    ("v6-small-det", f"{_V6}/PP_OCRv6_small_det.param", "input", "output", None),
    ("v6-tiny-det", f"{_V6}/PP_OCRv6_tiny_det.param", "input", "output", None),
    ("v5-mobile-det", f"{_V5}/PP_OCRv5_mobile_det.ncnn.param", "in0", "out0", None),
]
PACKAGED = "ppocrv5_keys.txt"
# Fixed values: (name, graph, dictionary, input blob, output blob, dictionary holds the blank, required precision).
RECOGNIZERS = [
    ("v6-medium-rec", f"{_V6}/PP_OCRv6_medium_rec.param", f"{_V6}/ppocr_keys_v6.txt", "input", "output", True, None),
    ("v6-small-rec", f"{_V6}/PP_OCRv6_small_rec.param", f"{_V6}/ppocr_keys_v6.txt", "input", "output", True, None),
    ("v6-tiny-rec", f"{_V6}/PP_OCRv6_tiny_rec.param", f"{_V6}/ppocr_keys_v6_tiny.txt", "input", "output", True, None),
    ("v5-mobile-rec", f"{_V5}/PP_OCRv5_mobile_rec.ncnn.param", PACKAGED, "in0", "out0", False, None),
]
_LINES = f"{_V6}/PP_LCNet_x0_25_textline_ori.param"
# Fixed values: (profile, detector, recogniser, graph that tells upside-down lines).
PROFILES = [
    ("v6-medium", "v6-medium-det", "v6-medium-rec", _LINES),
    ("v6-small", "v6-small-det", "v6-small-rec", _LINES),
    ("v6-tiny", "v6-tiny-det", "v6-tiny-rec", _LINES),
    ("v5-mobile", "v5-mobile-det", "v5-mobile-rec", None),
]
# Fixed values: (port, detector, recogniser) whose facts hold for files of that port that lie elsewhere.
PORTS = [("avafly-v6", "v6-medium-det", "v6-medium-rec"), ("nihui-v5", "v5-mobile-det", "v5-mobile-rec")]
#: The session's setting for the folder of the graphs, and where they are taken to be without it.
ROOT_SETTING, DEFAULT_ROOT = "spark.pagewright.models.root", "models"
DEFAULT_PROFILE = "v6-medium"
# The flags of each precision.
FLAGS = ("accelerated", "fp16_packed", "fp16_storage", "fp16_arithmetic", "int8_inference", "int8_packed", "int8_storage", "int8_arithmetic")
PRECISION = {
    "fp32": (True, False, False, False, True, True, True, False),
    "fp16": (True, True, True, True, True, True, True, False),
    "int8": (True, False, False, False, True, True, True, True),
}


def ctc_offset(includes_blank: Column) -> Column:
    return F.when(includes_blank, 0).otherwise(1)


#: What a session has added to the catalog, by the names of its tables.
_added: dict[str, list[tuple]] = {"detectors": [], "recognizers": [], "profiles": []}


def register(*, detectors: Sequence[tuple] = (), recognizers: Sequence[tuple] = (), profiles: Sequence[tuple] = ()) -> None:
    """Adds rows, shaped like those above, to the catalog; a name that is taken is refused."""
    for kind, known, rows in (("detectors", DETECTORS, detectors), ("recognizers", RECOGNIZERS, recognizers), ("profiles", PROFILES, profiles)):
        for row in rows:
            if row[0] in {x[0] for x in [*known, *_added[kind]]}:
                raise ValueError(f"{row[0]!r} is already one of the {kind}")
            _added[kind].append(row)


def _parts(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    det = spark.createDataFrame([*DETECTORS, *_added["detectors"]], "detector string, det string, det_in string, det_out string, det_precision string")
    rec = spark.createDataFrame([*RECOGNIZERS, *_added["recognizers"]], "recognizer string, rec string, dictionary string, own_in string, own_out string, includes_blank boolean, rec_precision string")
    return det, rec


def _with_facts(pairs: DataFrame) -> DataFrame:
    """Pairs of a detector and a recogniser with both's facts; a recogniser without blobs of its own uses the detector's."""
    det, rec = _parts(pairs.sparkSession)
    required = F.array_distinct(F.array_compact(F.array("det_precision", "rec_precision")))
    both = pairs.join(det, "detector").join(rec, "recognizer").withColumn("rec_in", F.coalesce("own_in", "det_in")).withColumn("rec_out", F.coalesce("own_out", "det_out")).drop("own_in", "own_out")
    return both.withColumn("ctc_offset", ctc_offset(F.col("includes_blank"))).withColumn("required_precision", required)


def profiles(spark: SparkSession) -> DataFrame:
    """One row a profile with its detector's and recogniser's facts."""
    own = spark.createDataFrame([*PROFILES, *_added["profiles"]], "profile string, detector string, recognizer string, ori string")
    return _with_facts(own).withColumn("orients", F.col("ori").isNotNull())


def models_root(spark: SparkSession, root: str | None = None) -> str:
    """The folder given, or that of the session's setting, or the default."""
    return root or (spark.conf.get(ROOT_SETTING, None) or "").strip() or DEFAULT_ROOT


def model_files(spark: SparkSession) -> DataFrame:
    """(profile, det, ori, rec, dictionary): paths below the root of models; the packaged dictionary is by its name alone."""
    return profiles(spark).select("profile", "det", "ori", "rec", "dictionary")


def dictionary_path(name: Column, root: str, packaged: str) -> Column:
    """Where a dictionary lies: the packaged one in its own folder, others beside the models."""
    return F.when(name == PACKAGED, F.concat(F.lit(f"{packaged}/"), name)).otherwise(F.concat(F.lit(f"{root}/"), name))


def for_ports(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` (files named by the caller) with the facts of the port that ``column`` names; ``error`` where there is none."""
    facts = _with_facts(rows.sparkSession.createDataFrame(PORTS, "port string, detector string, recognizer string"))
    facts = facts.select("port", "det_in", "det_out", "rec_in", "rec_out", "includes_blank", "ctc_offset", "required_precision")
    found = rows.join(facts, rows[column] == facts["port"], "left")
    known = ", ".join(sorted(p[0] for p in PORTS))
    return found.withColumn("error", F.when(F.col("port").isNull(), F.concat(F.lit("unknown port "), F.col(column), F.lit(f"; known: {known}"))))


def undeclared(overrides: DataFrame, declared: DataFrame) -> DataFrame:
    """Ids (id, model) whose model is not the one their case declares."""
    wanted = declared.select("id", F.col("model").alias("declared"))
    return overrides.join(wanted, "id").where(~F.col("model").eqNullSafe(F.col("declared")))


def resolve(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the facts of the profile that ``column`` names; ``error`` where there is none."""
    known = ", ".join(sorted(p[0] for p in [*PROFILES, *_added["profiles"]]))
    facts = profiles(rows.sparkSession)
    found = rows.join(facts, rows[column] == facts["profile"], "left")
    return found.withColumn("error", F.when(F.col("profile").isNull(), F.concat(F.lit("unknown profile "), F.col(column), F.lit(f"; known: {known}"))))


def options(precision: str) -> dict[str, bool]:
    if precision not in PRECISION:
        raise ValueError(f"unknown precision {precision!r}; known: {', '.join(PRECISION)}")
    return dict(zip(FLAGS, PRECISION[precision], strict=True))


def device_name(names: Column) -> Column:
    """Names of the devices in order, as one."""
    return F.array_join(F.transform(F.array_sort(names), lambda d: d["name"]), " + ")
