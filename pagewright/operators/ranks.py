"""Order statistics and running sums of groups of any size, exact, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.shared import cut

#: Ranges that a round cuts a range into, and the bound of each sketch that proposes them.
RANGES, SKETCH = 128, 2048
#: A range with no more rows is sorted in one row; so small ones need no further round.
FEW = 1 << 16
#: Groups whose ranges are sent to all tasks; of more, rows are joined to them by a shuffle.
MOST_SENT = 10_000


def _sent(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MOST_SENT else df


def order_statistics(rows: DataFrame, group: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """(group, n, and for each of ``ranks`` the value that stands there) of every group's non-null values, ascending, NaN last.

    A rank is an expression of ``n``, the number of the group's values, from 1.

    Selection by counting: a sketch of bounded size proposes values to cut at, the
    rows below, at and between them are counted (partial counts, one row a range
    and task), and the next round looks only into the one range that holds the
    rank, until such ranges have ``FEW`` rows. A value that is repeated often is
    itself a cut, so ties end the search. No task holds a group's values, whatever
    their number.
    """
    names = list(ranks)
    rows = cut(rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null"))
    sizes = cut(rows.groupBy("g").agg(F.count("*").alias("n")))
    wanted = F.array(*(F.struct(F.lit(i).alias("of"), r.cast("long").alias("want")) for i, r in enumerate(ranks.values())))
    none = F.lit(None).cast("double")
    # Of each rank the open range that it lies in; null ends are open, and NaN lies above all.
    open_ranks = sizes.select("g", F.explode(wanted).alias("r"), "n").select("g", "r.*", none.alias("lo"), none.alias("hi"), "n").where("want between 1 and n")
    found: list[DataFrame] = []
    while True:
        spans = open_ranks.select("g", "lo", "hi").distinct()
        n_spans, most = open_ranks.agg(F.count_distinct(F.struct("g", "lo", "hi")), F.max("n")).first()
        if not n_spans:
            break
        own = spans.select(F.col("g").alias("of_g"), "lo", "hi")
        inside = F.col("g").eqNullSafe(F.col("of_g")) & (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi")))
        held = rows.join(_sent(own, n_spans), inside).select("g", "lo", "hi", "v")
        if most <= FEW:
            of_span = held.groupBy(F.col("g").alias("of_g"), F.col("lo").alias("of_lo"), F.col("hi").alias("of_hi")).agg(F.array_sort(F.collect_list("v")).alias("all"))
            same = F.col("g").eqNullSafe(F.col("of_g")) & F.col("lo").eqNullSafe(F.col("of_lo")) & F.col("hi").eqNullSafe(F.col("of_hi"))
            found.append(open_ranks.join(of_span, same).select("g", "of", F.get("all", (F.col("want") - 1).cast("int")).alias("value")))
            break
        cuts = held.groupBy("g", "lo", "hi").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", [i / RANGES for i in range(RANGES + 1)], SKETCH))).alias("cuts"))
        own = cuts.select(F.col("g").alias("of_g"), F.col("lo").alias("of_lo"), F.col("hi").alias("of_hi"), "cuts")
        same = F.col("g").eqNullSafe(F.col("of_g")) & F.col("lo").eqNullSafe(F.col("of_lo")) & F.col("hi").eqNullSafe(F.col("of_hi"))
        # An even place is between two cuts, an odd one at a cut.
        below = F.size(F.filter("cuts", lambda c: c < F.col("v")))
        place = 2 * below + F.when(F.get("cuts", below) == F.col("v"), 1).otherwise(0)
        counted = held.join(_sent(own, n_spans), same).select("g", "lo", "hi", "cuts", place.alias("place")).groupBy("g", "lo", "hi", "cuts", "place").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("g", "lo", "hi").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counted = counted.withColumn("before", before).select(F.col("g").alias("of_g"), F.col("lo").alias("of_lo"), F.col("hi").alias("of_hi"), "cuts", "place", "before", F.col("n").alias("counted"))
        met = open_ranks.join(counted, same & (F.col("want") > F.col("before")) & (F.col("want") <= F.col("before") + F.col("counted")))
        at = F.floor(F.col("place") / 2).cast("int")
        sure = (F.col("place") % 2) == 1
        met = cut(met.select("g", "of", F.when(sure, F.get("cuts", at)).alias("value"), (F.col("want") - F.col("before")).alias("want"), F.when(at > 0, F.get("cuts", at - 1)).otherwise(F.col("lo")).alias("lo"), F.coalesce(F.get("cuts", at), "hi").alias("hi"), F.col("counted").alias("n"), sure.alias("sure")))
        found.append(met.where("sure").select("g", "of", "value"))
        open_ranks = met.where("not sure").select("g", "of", "want", "lo", "hi", "n")
    if not found:
        return sizes.select(F.col("g").alias(group), "n", *(none.alias(x) for x in names))
    values = found[0]
    for other in found[1:]:
        values = values.unionByName(other)
    wide = values.groupBy(F.col("g").alias("of_g")).agg(*(F.max(F.when(F.col("of") == i, F.col("value"))).alias(x) for i, x in enumerate(names)))
    return sizes.join(wide, F.col("g").eqNullSafe(F.col("of_g")), "left").select(F.col("g").alias(group), "n", *names)


def running_sum(rows: DataFrame, group: str, order: str, value: Column, name: str, *, slices: int | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` over those before each in its group; of equal ``order`` (a number) any may come first.

    The order is cut into slices (a bounded number, of about equal sizes). Sums
    within a slice and the sums of the slices before add up, so that a group with a
    large part of all rows is dealt to many tasks.
    """
    slices = slices or 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(order, [i / slices for i in range(1, slices)], 100 * slices)).first()[0] if slices > 1 else None
    edges = F.array(*map(F.lit, sorted(set(cuts or [])))).cast(f"array<{dict(rows.dtypes)[order]}>")
    own = rows.withColumn("_slice", F.size(F.filter(edges, lambda x: x <= F.col(order)))).withColumn("_value", value)
    ahead = own.groupBy(group, "_slice").agg(F.sum("_value").alias("_sum"))
    ahead = ahead.select(F.col(group).alias("_group"), F.col("_slice").alias("_of"), F.coalesce(F.sum("_sum").over(Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inner = F.coalesce(F.sum("_value").over(Window.partitionBy(group, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = own.withColumn("_inner", inner).join(ahead, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_slice") == F.col("_of")))
    return met.select(*rows.columns, (F.col("_ahead") + F.col("_inner")).alias(name))
