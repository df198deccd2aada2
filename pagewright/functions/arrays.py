"""Arrays and maps: best class, CTC collapse, counters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.geometry import let


def best_class(scores: Column) -> Column:
    """The first of the largest scores, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def collapse(classes: Column, scores: Column, dictionary: Column, offset: int) -> Column:
    """struct(text, confidence) of best classes by time step.

    A class that repeats the step before, blank or not, is skipped; so is the
    blank, 0; what remains is looked up at class minus ``offset``. The
    confidence is the mean score of the letters kept, 0 if none is.
    """
    pairs = F.zip_with(classes, scores, lambda c, p: F.struct(c.alias("cls"), p.alias("score")))
    before = lambda steps, i: F.coalesce(F.get(steps, i - 1)["cls"], F.lit(0))
    kept = let(pairs, lambda steps: F.filter(steps, lambda s, i: (s["cls"] != before(steps, i)) & (s["cls"] > 0) & (s["cls"] - offset < F.size(dictionary))))

    def read(k: Column) -> Column:
        text = F.array_join(F.transform(k, lambda s: F.get(dictionary, s["cls"] - offset)), "")
        total = F.aggregate(k, F.lit(0.0), lambda a, s: a + s["score"].cast("double"))
        return F.struct(text.alias("text"), F.when(F.size(k) > 0, total / F.size(k)).otherwise(0.0).alias("confidence"))

    return let(kept, read)


def merged_counters(one: Column, two: Column) -> Column:
    """The larger value of each counter of two maps."""
    return F.map_zip_with(one, two, lambda k, a, b: F.greatest(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))))


def counter_delta(before: Column, after: Column) -> Column:
    """What each counter gained; never below 0."""
    return F.map_zip_with(before, after, lambda k, a, b: F.greatest(F.coalesce(b, F.lit(0)) - F.coalesce(a, F.lit(0)), F.lit(0)))


def span_steps(left: Column, right: Column, scale: Column) -> Column:
    """struct(lo, hi): the time steps of a pixel span, rounded half to even, one step at least."""
    lo = F.bround(left * scale).cast("int")
    return F.struct(lo.alias("lo"), F.greatest(F.bround(right * scale).cast("int"), lo + 1).alias("hi"))


def decode_spans(classes: Column, scores: Column, spans: Column, scale: Column, dictionary: Column, offset: int) -> Column:
    """Of each pixel span (left, right) of a strip, what its time steps read: array<struct<text, confidence>>."""

    def read(part: Column) -> Column:
        own = lambda values: F.slice(values, part["lo"] + 1, part["hi"] - part["lo"])
        return collapse(own(classes), own(scores), dictionary, offset)

    return F.transform(F.transform(spans, lambda s: span_steps(s["left"], s["right"], scale)), read)


def same_multiset(one: Column, two: Column) -> Column:
    return F.array_sort(one) == F.array_sort(two)
