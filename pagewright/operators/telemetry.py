"""Which device did the work: counters of processes and systems, matched to selected devices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from pagewright.errors import Refused
from pagewright.functions import arrays as ar

#: Device kinds that count, in order of preference; software rasterisers do not.
KIND_RANK = {0: 0, 1: 1, 2: 2}
IDENTITY = ("name", "vendor_id", "device_id", "drm_node")

#: Fixed values, in seconds: how long a reply may take, and how long a worker may take to be ready.
REPLY_SECONDS, READY_SECONDS = 120, 30

# Reasons a proof is not supported.
NO_COUNTER = "no counter of its kind"
NO_MATCH = "no counter matches the selected device"
AMBIGUOUS = "several devices share the selected PCI identity"
NO_SAMPLES = "the counter produced no readable samples"


def field(text: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(text, rf"(?m)^{key}:\s*(\S+)", 1), F.lit(""))


def parse_fdinfo(files: DataFrame) -> DataFrame:
    """(driver, client, pdev, counters) of each file (value: its text) that has them; the larger of repeated counters."""
    pattern = r"(?m)^(drm-engine-[^:]+):\s+(\d+)\s+ns"
    names = F.regexp_extract_all("value", F.lit(pattern), F.lit(1))
    amounts = F.transform(F.regexp_extract_all("value", F.lit(pattern), F.lit(2)), lambda x: x.cast("long"))
    rows = files.select(field(F.col("value"), "drm-driver").alias("driver"), field(F.col("value"), "drm-client-id").alias("client"), field(F.col("value"), "drm-pdev").alias("pdev"), F.explode(F.arrays_zip(names.alias("metric"), amounts.alias("amount"))).alias("c"))
    rows = rows.where("driver is not null and client is not null and pdev is not null")
    return rows.groupBy("driver", "client", "pdev", F.col("c.metric").alias("metric")).agg(F.max("c.amount").alias("amount"))


def diagnostic_counters(files: DataFrame) -> DataFrame:
    """(metric, amount) summed over all files (value: its text): engine and memory counters as they stand, no client told apart."""
    pattern = r"(?m)^(drm-(?:engine|memory)-\w+):\s+(\d+)"
    names = F.regexp_extract_all("value", F.lit(pattern), F.lit(1))
    amounts = F.transform(F.regexp_extract_all("value", F.lit(pattern), F.lit(2)), lambda x: x.cast("long"))
    return files.select(F.explode(F.arrays_zip(names.alias("metric"), amounts.alias("amount"))).alias("c")).groupBy("c.metric").agg(F.sum("c.amount").alias("amount"))


def identity(devices: DataFrame) -> DataFrame:
    """Devices of the runtime (index, name, vendor_id, device_id, as text or numbers) as telemetry knows them; what is no number is null."""
    number = lambda c: F.expr(f"try_cast({c} AS long)")
    return devices.select(F.col("index").alias("runtime_index"), "name", number("vendor_id").alias("vendor_id"), number("device_id").alias("device_id"), F.lit(None).cast("string").alias("drm_node"))


def counter_gain(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What every counter gained between two snapshots (keys, metric, amount), never below 0."""
    on = [*keys, "metric"]
    both = before.withColumnRenamed("amount", "old").join(after.withColumnRenamed("amount", "new"), on, "full_outer")
    return both.select(*on, F.greatest(F.coalesce("new", F.lit(0)) - F.coalesce("old", F.lit(0)), F.lit(0)).alias("gain"))


def map_gain(before: Column, after: Column) -> Column:
    return ar.counter_delta(before, after)


#: So many device indices are ranked together.
_RANKED = 1 << 10


def rank_devices(devices: DataFrame) -> DataFrame:
    """Hardware devices (index, name, kind) by preference; rank 1 is the one to select.

    Devices are ranked in runs of indices, after those of all runs before.
    """
    known = F.create_map(*(F.lit(x) for pair in KIND_RANK.items() for x in pair))
    kept = devices.where(F.col("kind").isin(*KIND_RANK)).withColumn("_run", F.struct(F.element_at(known, F.col("kind")).alias("kind"), F.floor(F.col("index") / _RANKED).alias("at")))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = kept.groupBy("_run").agg(F.count("*").alias("n")).select("_run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_run").orderBy("index"))
    return kept.join(runs, "_run").withColumn("rank", (F.col("_before") + own).cast("int")).drop("_run", "_before")


def selected_device(devices: DataFrame) -> Row:
    """The device to run on; refused where only software rasterisers are left."""
    best = rank_devices(devices).where("rank = 1").head(1)
    if not best:
        raise Refused("worker-unavailable", "no hardware device")
    return best[0]


def same_device(a: str, b: str) -> Column:
    """By node where both have one, else by PCI identity where both have one, else by name."""
    both = lambda c: F.col(f"{a}.{c}").isNotNull() & F.col(f"{b}.{c}").isNotNull()
    equal = lambda c: F.col(f"{a}.{c}") == F.col(f"{b}.{c}")
    pci = both("vendor_id") & both("device_id")
    return F.when(both("drm_node"), equal("drm_node")).when(pci, equal("vendor_id") & equal("device_id")).otherwise(equal("name"))


def matching_samples(samples: DataFrame, selected: DataFrame) -> DataFrame:
    """Samples whose device is selected, by the rule of ``same_device``: three searches, each by equal keys."""
    s, d = samples.alias("s"), selected.alias("d")
    has = lambda t, *names: reduce(Column.__and__, [F.col(f"{t}.{n}").isNotNull() for n in names])
    out = lambda c: F.col(f"s.{c}").outer()
    by_node = F.col("d.drm_node") == out("drm_node")
    not_by_node = has("d", "drm_node") & out("drm_node").isNotNull()
    pci = ("vendor_id", "device_id")
    by_pci = (F.col("d.vendor_id") == out("vendor_id")) & (F.col("d.device_id") == out("device_id")) & ~not_by_node
    not_by_pci = has("d", *pci) & out("vendor_id").isNotNull() & out("device_id").isNotNull()
    by_name = (F.col("d.name") == out("name")) & ~not_by_node & ~not_by_pci
    return s.where(d.where(by_node).exists() | d.where(by_pci).exists() | d.where(by_name).exists())


def activity_observed(samples: DataFrame, selected: DataFrame, supported: bool) -> bool:
    """Whether a supported proof saw a selected device at work."""
    return supported and bool(matching_samples(samples, selected).where("value > 0").head(1))


def proof_problems(proofs: DataFrame) -> DataFrame:
    """Proofs (devices: array, supported, reason) that contradict themselves, with ``problem``."""
    none = F.size(F.coalesce("devices", F.array())) == 0
    said = F.coalesce("reason", F.lit("")) != ""
    problem = F.when(none, "a proof needs a device").when(F.col("supported") & said, "a supported proof has no reason").when(~F.col("supported") & ~said, "an unsupported proof needs a reason")
    return proofs.withColumn("problem", problem).where("problem is not null")


def bracketed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What each counter gained from before a run to after it, with the device of the later snapshot (keys, metric, amount, device)."""
    on = [*keys, "metric"]
    gained = counter_gain(before.select(*on, "amount"), after.select(*on, "amount"), keys)
    return gained.join(after.select(*on, "device"), on, "left")


def ambiguous(selected: DataFrame, samples: DataFrame) -> DataFrame:
    """PCI identities under which more nodes report than were selected."""
    pci = ["vendor_id", "device_id"]
    chosen = selected.where("vendor_id is not null and device_id is not null").groupBy(*pci).agg(F.count("*").alias("chosen"))
    return samples.groupBy(*pci).agg(F.count_distinct("drm_node").alias("nodes")).join(chosen, pci).where("nodes > chosen")


def process_status(matched: Column, is_ambiguous: Column) -> Column:
    """Null if supported, else why not."""
    return F.when(matched == 0, NO_MATCH).when(is_ambiguous, AMBIGUOUS)


def system_status(counters: Column, matched: Column, is_ambiguous: Column, readable: Column) -> Column:
    return F.when(counters == 0, NO_COUNTER).when(matched == 0, NO_MATCH).when(is_ambiguous, AMBIGUOUS).when(readable == 0, NO_SAMPLES)


def preferred(process_reason: Column, system_reason: Column) -> Column:
    """struct(provider, supported, reason): a process's own counters before the system's, with both reasons if neither."""
    made = lambda provider, supported, reason: F.struct(F.lit(provider).alias("provider"), F.lit(supported).alias("supported"), reason.alias("reason"))
    none = F.lit(None).cast("string")
    return F.when(process_reason.isNull(), made("process", True, none)).when(system_reason.isNull(), made("system", True, none)).otherwise(made("none", False, F.concat_ws("; ", process_reason, system_reason)))


def rollup(samples: DataFrame, *keys: str) -> DataFrame:
    return samples.groupBy(*keys).agg(F.sum("value").alias("total"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.count("*").alias("samples"))
