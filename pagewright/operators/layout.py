"""Assembly of recognised regions into lines, in reading order.

A region is a row (page_id, region_id, center_x, center_y, thickness, length,
angle, vertical, text, confidence, box_score); ``region_id`` is its place in
reading order and breaks every tie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagewright.functions import geometry as geo
from pagewright.functions import text as tx
from pagewright.operators import graph
from pagewright.shared import cut

# Fixed values.
PERPENDICULAR, MAX_GAP, MAX_OVERLAP, OVERLAP_SHARE = 0.6, 4.0, 2.0, 0.5
MIN_GAP, SPACE_WIDTH, MOST_SPACES = 0.25, 0.5, 8


def reading_order(regions: DataFrame, *ties: str) -> DataFrame:
    """``region_id`` by position, top to bottom, then left to right; equal places by ``ties``."""
    return regions.withColumn("region_id", F.row_number().over(Window.partitionBy("page_id").orderBy("center_y", "center_x", *ties)))


def with_axis(regions: DataFrame) -> DataFrame:
    axis = geo.line_axis(F.col("angle"), F.col("vertical"))
    return regions.withColumn("axis", axis).withColumn("direction", tx.direction(F.col("text")))


#: Pages with so few regions are one cell; a length counts as so much thickness; two axes of one line are apart by no more degrees.
_FEW, _SLENDER, _MOST_APART = 24, 16.0, 12.01
_FINITE = " and ".join(f"abs({c}) < 1e12" for c in ("center_x", "center_y", "thickness", "length", "angle")) + " and vertical is not null and page_id is not null"
_OWN = ("region_id", "center_x", "center_y", "thickness", "length", "axis", "direction")


def _celled(rows: DataFrame) -> DataFrame:
    """Finite ``rows`` (with axis) with what their page says of its cells.

    Two regions of one visual line have an end of one near the start of the other:
    along the line at most by ``MAX_GAP`` of the larger thickness, across by
    ``PERPENDICULAR`` of it, and somewhat more by as much as angles on the page
    differ (the ends of lines that lean apart are farther apart than their centres
    tell). So cells are laid along the page's mean axis, and their size follows from
    a region's own thickness, in steps of two: of a pair, the larger region says in
    which grid it meets. ``grids`` has a bit for each grid that some region asks for.
    """
    keys = ["page_id", "vertical"]
    # Half a per cent more, so that rounding loses nothing.
    rows = rows.withColumn("level", F.greatest(F.ceil(F.log2(F.greatest("thickness", F.col("length") / _SLENDER, F.lit(1e-9)) * 1.005)), F.lit(0)).cast("int"))
    lean = F.degrees(F.atan2("axis.y", "axis.x"))
    page = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("axis.x").alias("rx"), F.avg("axis.y").alias("ry"), F.min(lean).alias("least"), F.max(lean).alias("most"), F.bit_or(F.expr("shiftleft(1L, level)")).alias("grids")
    )
    size, ref = F.hypot("rx", "ry"), F.degrees(F.atan2("ry", "rx"))
    off = F.least(F.greatest(F.col("most") - ref, ref - F.col("least")), F.lit(90.0))
    apart = F.radians(F.least(F.col("most") - F.col("least"), F.lit(_MOST_APART)))
    skew, short, turn = F.sin(apart) / 2, (1 - F.cos(apart)) / 2, F.when(size > 0, F.sin(F.radians(off))).otherwise(1.0)
    page = page.select(
        *keys, (F.col("n") <= _FEW).alias("few"), "grids", F.when(size > 0, F.col("rx") / size).otherwise(1.0).alias("rx"), F.when(size > 0, F.col("ry") / size).otherwise(0.0).alias("ry"),
        # How far, in units of the grid, an end lies from the other's start: across, along, and along the other way.
        (PERPENDICULAR + MAX_GAP * turn + _SLENDER * (skew + short * turn)).alias("across"), (MAX_GAP + PERPENDICULAR * turn + _SLENDER * (short + skew * turn)).alias("along"),
        (MAX_OVERLAP + PERPENDICULAR * turn + _SLENDER * (short + skew * turn)).alias("back"),
    )
    return rows.join(page, keys)


def _candidates(rows: DataFrame) -> DataFrame:
    """Regions (suffixes _x and _y) of which x may end where y starts: neighbours in the grid of the larger one, each such meeting once."""
    finite = rows.where(_FINITE)
    most = finite.groupBy("page_id", "vertical").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= _FEW:  # each page is one cell
        one, two = (finite.select("page_id", "vertical", *(F.col(c).alias(f"{c}_{side}") for c in _OWN)) for side in "xy")
        return one.join(two, ["page_id", "vertical"])
    celled = _celled(finite)
    unit = F.expr("shiftleft(1L, grid)").cast("double")
    place = lambda value, size: F.floor(value / size).cast("long")
    keys = ("page_id", "vertical", "grid", "part", "row", "cell")
    bits = F.filter(F.sequence(F.col("level"), F.lit(41)), lambda g: F.col("grids").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), g)) != 0)
    grids = F.when(F.col("few"), F.array(F.lit(0))).otherwise(bits)
    own = F.col("few") | (F.col("level") == F.col("grid"))

    def meets(side: str, sign: int) -> DataFrame:
        x, y = F.col("center_x") + F.col("axis.x") * F.col("length") * (sign / 2), F.col("center_y") + F.col("axis.y") * F.col("length") * (sign / 2)
        near = celled.select("*", F.explode(grids).alias("grid")).withColumn("at", geo.dot(x, y, F.col("rx"), F.col("ry"))).withColumn("off", geo.dot(x, y, -F.col("ry"), F.col("rx")))
        high, wide = F.col("across") * unit, F.col("along") * unit
        if sign > 0:
            row, cell = F.sequence(place(F.col("off") - high, high), place(F.col("off") + high, high)), F.sequence(place(F.col("at") - F.col("back") * unit, wide), place(F.col("at") + wide, wide))
            # Part 0: x in its own grid, with all of it; part 1: a smaller x, with those whose own grid it is.
            part = F.array(F.when(own, 0).otherwise(1))
        else:
            row, cell, part = F.array(place(F.col("off"), high)), F.array(place(F.col("at"), wide)), F.when(own, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        one = F.col("few")
        zero = F.array(F.lit(0).cast("long"))
        part = F.when(one, F.array(F.lit(0))).otherwise(part)
        near = near.withColumn("part", F.explode(part)).withColumn("row", F.explode(F.when(one, zero).otherwise(row))).withColumn("cell", F.explode(F.when(one, zero).otherwise(cell)))
        return near.select(*keys, *(F.col(c).alias(f"{c}_{side}") for c in _OWN))

    return meets("x", 1).join(meets("y", -1), list(keys))


def _pairs(rows: DataFrame) -> DataFrame:
    met = _candidates(rows)
    x_first = F.col("region_id_x") < F.col("region_id_y")
    of = lambda c, first: F.when(x_first if first else ~x_first, F.col(f"{c}_x")).otherwise(F.col(f"{c}_y"))
    met = met.where("region_id_x <> region_id_y").select("page_id", x_first.alias("ahead"), *(of(c, True).alias(f"{c}_a") for c in _OWN), *(of(c, False).alias(f"{c}_b") for c in _OWN))
    ax, ay = F.col("axis_a.x"), F.col("axis_a.y")
    dx, dy = F.col("center_x_b") - F.col("center_x_a"), F.col("center_y_b") - F.col("center_y_a")
    along = geo.dot(dx, dy, ax, ay)
    thick = F.greatest("thickness_a", "thickness_b")
    gap = F.abs(along) - (F.col("length_a") + F.col("length_b")) / 2
    overlap = F.least(MAX_OVERLAP * thick, OVERLAP_SHARE * F.least("length_a", "length_b"))
    on_line = (
        (F.col("ahead") == (along >= 0))  # the meeting at a's end if b lies behind it, else that at b's end
        & tx.directions_agree(F.col("direction_a"), F.col("direction_b"))
        & (geo.dot(ax, ay, F.col("axis_b.x"), F.col("axis_b.y")) >= geo.MIN_AXIS_DOT)
        & (F.abs(geo.dot(dx, dy, -ay, ax)) <= PERPENDICULAR * thick)
        & (gap >= -overlap)
        & (gap <= MAX_GAP * thick)
    )
    return met.where(on_line).select("page_id", F.col("region_id_a").alias("i"), F.col("region_id_b").alias("j"))


def candidate_pairs(regions: DataFrame) -> DataFrame:
    """The pairs that ``same_line_pairs`` compares."""
    return _candidates(cut(with_axis(regions)))


def same_line_pairs(regions: DataFrame) -> DataFrame:
    """(page_id, i, j), i before j, of regions on one visual line by the axis of i.

    Only regions in neighbouring cells meet, so a page may hold any number of
    regions. One without finite numbers is on no other's line. Regions are
    worked out once and kept in the shared folder.
    """
    return _pairs(cut(with_axis(regions)))


#: Regions of a page that a task puts into lines by itself; those of a page with more meet in cells.
LOCAL_REGIONS = 1 << 12
#: Regions, of however many pages, and pairs that a task compares in one go.
_AT_ONCE, _PAIRS_AT_ONCE = 1 << 15, 1 << 19


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    return rows[name].cast(pa.float64()).to_numpy()


def _line_labels(rows: pa.Table) -> np.ndarray:
    """Of regions in the order of (page_id, region_id) the place of the first one of each one's visual line."""
    n = rows.num_rows
    page = rows["page_id"].combine_chunks().dictionary_encode()
    known = np.asarray(page.is_valid()) & np.asarray(rows["region_id"].is_valid()) & np.asarray(rows["vertical"].is_valid())
    page, ids = np.asarray(page.indices.fill_null(-1)), np.asarray(rows["region_id"].combine_chunks().fill_null(-1))
    x, y, thick, length, angle = (_numbers(rows, c) for c in ("center_x", "center_y", "thickness", "length", "angle"))
    for value in (x, y, thick, length, angle):
        known &= np.abs(value) < 1e12
    axis = rows["axis"].combine_chunks()
    ax, ay = (np.asarray(axis.field(c)) for c in (0, 1))
    way = np.asarray(pa.compute.index_in(rows["direction"], pa.array(["neutral", "ltr", "rtl", "mixed"])))
    # Equal ids of a page are one node.
    same = np.flatnonzero((page[1:] == page[:-1]) & (ids[1:] == ids[:-1]) & known[1:] & known[:-1])
    ends = [(same, same + 1)]
    own = np.flatnonzero(known)
    if not len(own):
        return np.arange(n)
    # A page's regions of one kind come one after another; along each axis one reaches so far at most, whichever way the other leans.
    kind = page[own].astype(np.int64) * 2 + np.asarray(rows["vertical"].combine_chunks().fill_null(False))[own]
    kinds, kind = np.unique(kind, return_inverse=True)
    reach = np.abs(length[own]) / 2 + MAX_GAP * np.abs(thick[own])
    best = None
    for at, along, across in ((x, ax, ay), (y, ay, ax)):
        steepest = [np.zeros(len(kinds)), np.zeros(len(kinds))]
        for most, part in zip(steepest, (along, across), strict=True):
            np.maximum.at(most, kind, np.abs(part[own]))
        far = (reach * steepest[0][kind] + PERPENDICULAR * np.abs(thick[own]) * steepest[1][kind]) * (1 + 1e-9) + 1e-6 + 1e-9 * np.abs(at[own])
        # Starts and ends in one order of all kinds: those of a later kind lie after all of an earlier one.
        low, high = at[own] - far, at[own] + far
        order = np.lexsort((low, kind))
        start = np.searchsorted(kind[order], np.arange(len(kinds) + 1))
        last = np.empty(len(own), np.int64)
        for k in range(len(kinds)):
            part = slice(start[k], start[k + 1])
            last[part] = start[k] + np.searchsorted(low[order[part]], high[order[part]], "right")
        meets = last - np.arange(len(own)) - 1
        cost = np.bincount(kind[order], meets, len(kinds))
        if best is None:
            best = (cost, order, meets)
        else:
            first = best[0] <= cost
            keep = [first[kind[best[1]]], ~first[kind[order]]]
            # Both orders hold a kind's regions in the same places.
            order, meets = np.where(keep[0], best[1], order), np.where(keep[0], best[2], meets)
    total = np.cumsum(meets)
    begin = 0
    while begin < len(own):
        before = total[begin - 1] if begin else 0
        end = max(int(np.searchsorted(total, before + _PAIRS_AT_ONCE, "right")), begin + 1)
        some = meets[begin:end]
        one = np.repeat(np.arange(begin, end), some)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(some) - some, some)
        one, two = own[order[one]], own[order[two]]
        a, b = np.minimum(one, two), np.maximum(one, two)
        dx, dy = x[b] - x[a], y[b] - y[a]
        along = dx * ax[a] + dy * ay[a]
        t = np.maximum(thick[a], thick[b])
        gap = np.abs(along) - (length[a] + length[b]) / 2
        on = (gap <= MAX_GAP * t) & (gap >= -np.minimum(MAX_OVERLAP * t, OVERLAP_SHARE * np.minimum(length[a], length[b])))
        on &= np.abs(dx * -ay[a] + dy * ax[a]) <= PERPENDICULAR * t
        on &= (ax[a] * ax[b] + ay[a] * ay[b] >= geo.MIN_AXIS_DOT) & (ids[a] != ids[b])
        on &= (way[a] != 3) & (way[b] != 3) & ((way[a] == 0) | (way[b] == 0) | (way[a] == way[b]))
        ends.append((a[on], b[on]))
        begin = end
    return graph.least_labels(np.concatenate([a for a, _ in ends]), np.concatenate([b for _, b in ends]), n)


def _whole_pages(batches: Iterator[pa.RecordBatch], settle: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    """``settle`` of many whole pages at a time, whose regions come in the order of (page_id, region_id)."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < _AT_ONCE:
            continue
        rows = pa.Table.from_batches(held)
        last = rows["page_id"][count - 1]
        # Regions of no page are on no line: they wait for no others.
        own = np.asarray(pa.compute.equal(rows["page_id"], last).fill_null(False)) if last.is_valid else np.zeros(count, bool)
        whole = 0 if own.all() else int(np.flatnonzero(~own)[-1]) + 1
        if whole:
            yield from settle(rows.slice(0, whole)).to_batches()
        held, count = rows.slice(whole).to_batches(), count - whole
    if count:
        yield from settle(pa.Table.from_batches(held)).to_batches()


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions, whole pages in a task: their last column, empty so far, becomes their component."""

    def settle(rows: pa.Table) -> pa.Table:
        least = rows["region_id"].combine_chunks().take(pa.array(_line_labels(rows)))
        return rows.set_column(rows.num_columns - 1, "component", least)

    return _whole_pages(batches, settle)


def _in_order(regions: DataFrame) -> DataFrame:
    """``regions`` with axis, direction and a column ``component`` to be filled: the window brings a page's regions together, in order."""
    kind = dict(regions.dtypes)["region_id"]
    placed = with_axis(regions).withColumn("component", F.row_number().over(Window.partitionBy("page_id").orderBy("region_id")).cast(kind))
    return placed.sortWithinPartitions("page_id", "region_id")


def components(regions: DataFrame, *, local_regions: int = LOCAL_REGIONS) -> DataFrame:
    """``regions`` with axis, direction and ``component``, the smallest region_id of its visual line.

    Pages of at most ``local_regions`` are put into lines within tasks, many
    together; of larger ones pairs and components are found by all tasks, of
    regions kept in the shared folder. For this a page's regions are counted
    first, so ``regions`` is worked out twice: cut what is dear.
    """
    kind = dict(regions.dtypes)["region_id"]
    large = regions.where("page_id is not null").groupBy("page_id").agg(F.count("*").alias("n")).where(F.col("n") > local_regions).select("page_id")
    many = bool(large.head(1))
    small = regions
    if many:
        large = cut(large)
        small = regions.join(large, "page_id", "left_anti")
    placed = _in_order(small)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in placed.schema])
    labelled = placed.mapInArrow(_labelled, schema)
    if not many:
        return labelled
    rows = cut(with_axis(regions.join(large, "page_id", "left_semi")))
    labels = graph.components(_pairs(rows)).select("page_id", F.col("node").cast(kind).alias("region_id"), F.col("label").cast(kind).alias("component"))
    return labelled.unionByName(rows.join(labels, ["page_id", "region_id"], "left").withColumn("component", F.coalesce("component", "region_id")))


def _ends_tight(text: Column) -> Column:
    last = F.right(text, F.lit(1))
    return last.rlike(tx.SPACES) | tx.opens(last)


def _starts_tight(text: Column) -> Column:
    first = F.left(text, F.lit(1))
    return first.rlike(tx.SPACES) | tx.closes(first)


def separator(before: Column, after: Column, thickness: Column) -> Column:
    """What stands between two neighbours: nothing, or one to eight spaces by the gap."""
    gap = F.abs(after["at"] - before["at"]) - (before["length"] + after["length"]) / 2
    count = F.least(F.greatest(F.floor(gap / (SPACE_WIDTH * thickness) + 0.5), F.lit(1)), F.lit(MOST_SPACES)).cast("int")
    tight = _ends_tight(before["text"]) | _starts_tight(after["text"]) | (gap < MIN_GAP * thickness)
    return F.when(tight, "").otherwise(F.repeat(F.lit(" "), count))


def _weighted(members: Column, field: str) -> Column:
    total = lambda f: F.aggregate(members, F.lit(0.0), lambda s, m: s + f(m))
    ink = total(lambda m: m["ink"].cast("double"))
    return F.when(ink > 0, total(lambda m: m[field] * m["ink"]) / ink).otherwise(total(lambda m: m[field]) / F.size(members))


_FIELDS = ("region_id", "center_x", "center_y", "thickness", "length", "angle", "vertical", "text", "confidence", "box_score")
#: Regions whose numbers and texts are all there; pages of others are joined by groups, which say what becomes of nulls.
_PLAIN = f"{_FINITE} and thickness > 0 and abs(confidence) < 1e12 and abs(box_score) < 1e12 and region_id is not null and text is not null"


def _joined_lines(rows: pa.Table) -> pa.Table:
    """``_reconstructed`` of the plain regions of whole pages (with axis, direction, ink and whether their ends are tight)."""
    n = rows.num_rows
    label = _line_labels(rows)
    firsts, group = np.unique(label, return_inverse=True)
    k = len(firsts)
    x, y, thick, length, ink, confidence, score = (_numbers(rows, c) for c in ("center_x", "center_y", "thickness", "length", "ink", "confidence", "box_score"))
    axis = rows["axis"].combine_chunks()
    way = np.asarray(pa.compute.index_in(rows["direction"], pa.array(["neutral", "ltr", "rtl", "mixed"])))
    count = np.bincount(group, minlength=k)
    some = [np.bincount(group[way == w], minlength=k) > 0 for w in (1, 2, 3)]
    apart = (count == 1) | some[2] | (some[0] & some[1])
    sx, sy = (np.bincount(group, np.asarray(axis.field(c)), k) for c in (0, 1))
    size = np.hypot(sx, sy)
    own = np.flatnonzero(~apart[group])
    g = group[own]
    ax, ay = sx[group[own]] / size[g], sy[g] / size[g]
    at, off = x[own] * ax + y[own] * ay, y[own] * ax - x[own] * ay
    keys = [own, rows["region_id"].combine_chunks().to_numpy(zero_copy_only=False)[own], at * np.where(some[1][g], -1.0, 1.0), g]
    page = rows["page_id"].combine_chunks().dictionary_encode().indices
    if np.any((np.diff(np.asarray(page)) == 0) & (np.diff(rows["region_id"].combine_chunks().to_numpy(zero_copy_only=False)) == 0)):
        # Ids that a page repeats are told apart by what else there is.
        text = np.unique(np.array(rows["text"].to_pylist(), object), return_inverse=True)[1]
        more = (off, x[own], y[own], thick[own], length[own], _numbers(rows, "angle")[own], np.asarray(rows["vertical"].combine_chunks())[own], text[own], confidence[own], score[own])
        keys[:1] = more[::-1]
    order = np.lexsort(keys)
    own, g, at, off = own[order], g[order], at[order], off[order]
    start = np.flatnonzero(np.diff(g, prepend=-1))
    lines = g[start]
    members = count[lines]
    first = np.zeros(len(own), bool)
    first[start] = True
    line = np.cumsum(first) - 1
    # The middle thickness of each line.
    sizes = thick[own][np.lexsort((thick[own], g))]
    middle = 0.5 * sizes[start + (members - 1) // 2] + 0.5 * sizes[start + members // 2]
    thick, length, ink = thick[own], length[own], ink[own]
    before = np.maximum(np.arange(len(own)) - 1, 0)
    gap = np.abs(at - at[before]) - (length[before] + length) / 2
    spaces = np.clip(np.floor(gap / (SPACE_WIDTH * middle[line]) + 0.5), 1, MOST_SPACES).astype(np.int64)
    ends, starts = (np.asarray(rows[c].combine_chunks())[own] for c in ("ends_tight", "starts_tight"))
    spaces[first | ends[before] | starts | (gap < MIN_GAP * middle[line])] = 0
    between = pa.array([" " * i for i in range(MOST_SPACES + 1)]).take(pa.array(spaces))
    texts = pa.compute.binary_join_element_wise(between, rows["text"].combine_chunks().take(pa.array(own)), "")
    texts = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(np.append(start, len(own)), pa.int32()), texts), "")

    def weighted(values: np.ndarray) -> np.ndarray:
        total = np.bincount(line, ink, len(start))
        return np.where(total > 0, np.bincount(line, values * ink, len(start)) / np.where(total > 0, total, 1), np.bincount(line, values, len(start)) / members)

    if len(own):
        low, high = np.minimum.reduceat(at - length / 2, start), np.maximum.reduceat(at + length / 2, start)
        top, bottom = np.minimum.reduceat(off - thick / 2, start), np.maximum.reduceat(off + thick / 2, start)
    else:
        low = high = top = bottom = np.zeros(0)
    ax, ay = sx[lines] / size[lines], sy[lines] / size[lines]
    mid, over = (low + high) / 2, (top + bottom) / 2
    angle = np.degrees(np.arctan2(ax, -ay))
    angle = np.where(angle > 90, angle - 180, np.where(angle <= -90, angle + 180, angle))
    names = ["page_id", "component", *_FIELDS, "members"]
    alone = np.flatnonzero(apart[group])
    kept = rows.select(["page_id", *_FIELDS]).take(pa.array(alone))
    component = lambda places: rows["region_id"].combine_chunks().take(pa.array(firsts[group[places]]))
    double = lambda c: kept[c].combine_chunks().cast(pa.float64()) if pa.types.is_floating(kept[c].type) or pa.types.is_integer(kept[c].type) and c not in ("page_id", "region_id") else kept[c].combine_chunks()
    one = [double("page_id"), component(alone), *(double(c) for c in _FIELDS), pa.array(np.ones(len(alone)), pa.int32())]
    head = own[start]
    merged = [
        rows["page_id"].combine_chunks().take(pa.array(head)), component(head), component(head), ax * mid - ay * over, ay * mid + ax * over, bottom - top, high - low, angle,
        rows["vertical"].combine_chunks().take(pa.array(head)), texts, weighted(confidence[own]), weighted(score[own]), pa.array(members, pa.int32()),
    ]
    return pa.table({name: pa.chunked_array([a, b if isinstance(b, pa.Array) else pa.array(b)]) for name, a, b in zip(names, one, merged, strict=True)})


def _joined(schema: pa.Schema, local_regions: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of regions in the order of (page_id, region_id) the lines of their pages; those of large pages and of pages that are not plain go on as they are, without members."""

    def left(rows: pa.Table) -> pa.Table:
        return pa.table([pa.chunked_array([pa.nulls(rows.num_rows, f.type)]) if f.name in ("component", "members") else rows[f.name].cast(f.type) for f in schema], schema=schema)

    def settle(rows: pa.Table) -> pa.Table:
        page = np.asarray(rows["page_id"].combine_chunks().dictionary_encode().indices.fill_null(-1)) + 1
        other = np.bincount(page) > local_regions
        other[page[~np.asarray(rows["plain"].combine_chunks())]] = True
        own, rest = (rows.filter(pa.array(keep)) for keep in (~other[page], other[page]))
        return pa.concat_tables([*([_joined_lines(own).cast(schema)] if own.num_rows else []), *([left(rest)] if rest.num_rows else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = None, None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if passing is not None:  # the rest of a page too large to be held
                end = pa.compute.equal(rows["page_id"], passing).to_pylist().count(True)
                yield from left(rows.slice(0, end)).to_batches()
                rows = rows.slice(end)
                if not rows.num_rows:
                    continue
                passing = None
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows < _AT_ONCE:
                continue
            last = held["page_id"][held.num_rows - 1]
            own = np.asarray(pa.compute.equal(held["page_id"], last).fill_null(False)) if last.is_valid else np.zeros(held.num_rows, bool)
            whole = 0 if own.all() else int(np.flatnonzero(~own)[-1]) + 1
            if whole:
                yield from settle(held.slice(0, whole)).to_batches()
            held = held.slice(whole) if whole < held.num_rows else None
            if held is not None and held.num_rows > local_regions:
                yield from left(held).to_batches()
                held, passing = None, last
        if held is not None and held.num_rows:
            yield from settle(held).to_batches()

    return run


def _lines_in_tasks(regions: DataFrame, local_regions: int) -> DataFrame:
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in _reconstructed(regions.limit(0), local_regions=None).schema])
    placed = _in_order(regions).withColumn("ink", tx.ink(F.col("text"))).withColumn("ends_tight", _ends_tight(F.col("text"))).withColumn("starts_tight", _starts_tight(F.col("text")))
    placed = placed.withColumn("plain", F.coalesce(F.expr(_PLAIN), F.lit(False)))
    placed = placed.select("page_id", *_FIELDS, "axis", "direction", "ink", "ends_tight", "starts_tight", "plain", "component")
    return placed.mapInArrow(_joined(to_arrow_schema(schema), local_regions), schema)


def reconstruct(regions: DataFrame, *, local_regions: int = LOCAL_REGIONS) -> DataFrame:
    """Lines: members of a component joined along its axis, with the spaces their gaps imply.

    A component of one region, or of both writing directions, stays as it is.
    Pages of at most ``local_regions`` are found and joined within tasks, many
    together, so that only their lines leave a task. Pages with more, and those
    with a null or a number that is not finite, leave it as they are and go as
    ``components`` and groups. Both are kept in the shared folder, so regions are
    worked out once.
    """
    lines = cut(_lines_in_tasks(regions, local_regions))
    other = lines.where("members is null").select("page_id", *_FIELDS)
    if not other.head(1):
        return lines
    return lines.where("members is not null").unionByName(_reconstructed(other, local_regions=local_regions))


def _reconstructed(regions: DataFrame, *, local_regions: int | None) -> DataFrame:
    """``reconstruct`` by groups, of any regions; without ``local_regions`` only its columns count."""
    fields = _FIELDS
    rows = _in_order(regions) if local_regions is None else components(regions, local_regions=local_regions)
    rows = rows.withColumn("ink", tx.ink(F.col("text")))
    grouped = rows.groupBy("page_id", "component").agg(
        F.collect_list(F.struct(*fields, "ink")).alias("members"),
        F.sum("axis.x").alias("sx"), F.sum("axis.y").alias("sy"), F.median("thickness").alias("thickness"),
        F.bool_or(F.col("direction") == "mixed").alias("mixed"), F.bool_or(F.col("direction") == "ltr").alias("ltr"), F.bool_or(F.col("direction") == "rtl").alias("rtl"),
    )
    size = F.hypot("sx", "sy")
    grouped = grouped.withColumn("ax", F.col("sx") / size).withColumn("ay", F.col("sy") / size)
    apart = (F.size("members") == 1) | F.col("mixed") | (F.col("ltr") & F.col("rtl"))
    along = lambda m: m["center_x"] * F.col("ax") + m["center_y"] * F.col("ay")
    across = lambda m: m["center_y"] * F.col("ax") - m["center_x"] * F.col("ay")
    sign = F.when(F.col("rtl"), -1.0).otherwise(1.0)
    placed = F.array_sort(F.transform("members", lambda m: F.struct((along(m) * sign).alias("key"), m["region_id"].alias("region_id"), along(m).alias("at"), across(m).alias("off"), *(m[f].alias(f) for f in (*fields[1:], "ink")))))
    joined = grouped.withColumn("apart", apart).withColumn("m", F.when(~F.col("apart"), placed))
    pieces = F.transform("m", lambda x, i: F.when(i == 0, x["text"]).otherwise(F.concat(separator(F.get("m", F.greatest(i - 1, F.lit(0))), x, F.col("thickness")), x["text"])))
    edge = lambda at, side, sign, pick: pick(F.transform("m", lambda x: x[at] + sign * x[side] / 2))
    joined = joined.select(
        "page_id", "component", "apart", "members", "ax", "ay", F.col("m")[0]["vertical"].alias("vertical"), F.size("m").alias("count"),
        F.array_join(pieces, "").alias("text"), _weighted(F.col("m"), "confidence").alias("confidence"), _weighted(F.col("m"), "box_score").alias("box_score"),
        edge("at", "length", -1, F.array_min).alias("lo"), edge("at", "length", 1, F.array_max).alias("hi"),
        edge("off", "thickness", -1, F.array_min).alias("top"), edge("off", "thickness", 1, F.array_max).alias("bottom"),
    )
    mid, over = (F.col("lo") + F.col("hi")) / 2, (F.col("top") + F.col("bottom")) / 2
    merged = F.struct(
        F.col("component").alias("region_id"), (F.col("ax") * mid - F.col("ay") * over).alias("center_x"), (F.col("ay") * mid + F.col("ax") * over).alias("center_y"),
        (F.col("bottom") - F.col("top")).alias("thickness"), (F.col("hi") - F.col("lo")).alias("length"), geo.axis_angle(F.col("ax"), F.col("ay")).alias("angle"),
        "vertical", "text", "confidence", "box_score", F.col("count").alias("members"),
    )
    alone = F.transform("members", lambda m: F.struct(*(m[f].alias(f) for f in fields), F.lit(1).alias("members")))
    # One pass over the groups, whichever way each of them goes.
    return joined.select("page_id", "component", F.explode(F.when(F.col("apart"), alone).otherwise(F.array(merged))).alias("line")).select("page_id", "component", "line.*")


def assemble(regions: DataFrame, accepted: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines, counts): empty readings are counted and dropped, refused ones too, the rest reconstructed."""
    kept = F.coalesce(accepted, F.lit(True)) if accepted is not None else F.lit(True)
    empty = F.coalesce("text", F.lit("")) == ""
    counts = regions.groupBy("page_id").agg(F.count_if(empty).alias("undecoded_regions"), F.count_if(~empty & ~kept).alias("filtered_regions"), F.count_if(~empty & kept).alias("kept_regions"))
    return reconstruct(cut(reading_order(regions.where(~empty & kept), "region_id"))), counts


def line_counts(lines: DataFrame) -> DataFrame:
    """(page_id, lines) of assembled lines."""
    return lines.groupBy("page_id").agg(F.count("*").alias("lines"))
