"""Character and word error rates that do not depend on the order of lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import arrays as ar
from pagewright.functions import text as tx
from pagewright.operators import ranks


def _assignment(cost: np.ndarray) -> np.ndarray:
    """Of each column the row that it is paired with at the least total cost (square; shortest augmenting paths)."""
    n = len(cost)
    own = cost.argmin(axis=1)
    if len(set(own.tolist())) == n:  # each row has its cheapest column
        return np.argsort(own)
    row_price, column_price = np.zeros(n), np.zeros(n)
    row_of = np.full(n, -1)
    for start in range(n):
        reach, via = np.full(n, np.inf), np.full(n, -1)
        done = np.zeros(n, bool)
        row, paid, last = start, 0.0, -1
        while True:
            step = paid + cost[row] - row_price[row] - column_price
            better = ~done & (step < reach)
            reach[better], via[better] = step[better], last
            column = int(np.argmin(np.where(done, np.inf, reach)))
            paid, last = reach[column], column
            done[column] = True
            if row_of[column] < 0:
                break
            row = row_of[column]
        row_price[start] += paid
        seen = np.flatnonzero(done & (row_of >= 0))
        row_price[row_of[seen]] += paid - reach[seen]
        column_price[done] -= paid - reach[done]
        while last >= 0:
            before = via[last]
            row_of[last] = start if before < 0 else row_of[before]
            last = before
    return row_of


def least_assignment(costs: Sequence[Sequence[float]]) -> float:
    """The least total cost of pairing each row with a column of its own (square)."""
    cost = np.asarray(costs, float)
    return float(cost[_assignment(cost), np.arange(len(cost))].sum()) if len(cost) else 0


def edits(one: Sequence, two: Sequence) -> int:
    """Least insertions, removals and replacements from one sequence to the other (bit-parallel, a column of the table in each step)."""
    short, long = (one, two) if len(one) <= len(two) else (two, one)
    start, n, m = 0, len(short), len(long)
    while start < n and short[start] == long[start]:
        start += 1
    while n > start and short[n - 1] == long[m - 1]:
        n, m = n - 1, m - 1
    if n == start:
        return m - n
    places: dict = {}
    for i, x in enumerate(long[start:m]):
        places.setdefault(x, []).append(i)
    bits = {x: sum(1 << i for i in at) for x, at in places.items()}
    count = m - start
    every, last = (1 << count) - 1, 1 << (count - 1)
    up, down = every, 0
    for x in short[start:n]:
        equal = bits.get(x, 0)
        flat = equal | down
        across = (((equal & up) + up) ^ up) | equal
        more, less = (down | ~(across | up)) & every, up & across
        if more & last:
            count += 1
        elif less & last:
            count -= 1
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(flat | more)) & every, more & flat & every
    return count


#: Lines whose pairs are compared in step with one another, at most so many; so many a word of 64 letters are worth it.
_IN_STEP, _WORTH = 1 << 12, 32
#: Numbers in a table of pairs in step, and in what a task pairs in one go.
_TABLE, _AT_ONCE = 1 << 22, 1 << 22
#: Letters are counted by their numbers' remainder of this: a letter replaced changes a count at most by one either way.
_COUNTED = 128


def _runs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs one after another: each place's run, its number within the run, and where it lies."""
    own = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return own, inner, starts[own] + inner


def _alike(codes: np.ndarray, one: np.ndarray, two: np.ndarray, sizes: np.ndarray, step: int) -> np.ndarray:
    """How many places from ``one`` and ``two`` on, forwards or backwards, are alike, of at most ``sizes``."""
    own, inner, _ = _runs(one, sizes)
    differ = np.flatnonzero(codes[one[own] + step * inner] != codes[two[own] + step * inner])
    begin = np.cumsum(sizes) - sizes
    first = np.append(differ, len(own))[np.searchsorted(differ, begin)]
    return np.minimum(first - begin, sizes)


def _in_step(codes: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, wide: int) -> np.ndarray:
    """Edits of pairs of runs (from a and b, m <= n long, none empty, n falling), a letter of every pair in each step.

    ``edits``, but only for places at most 32 * ``wide`` apart, in ``wide`` words
    that move on with the letters: less than that is exact, all else is at least that.
    """
    count, kinds, half = len(m), int(codes.max()) + 1, 32 * wide
    own, place, where = _runs(a, m)
    text_own, text_place, text_where = _runs(b, n)
    keys, text_keys = own * kinds + codes[where], text_own * kinds + codes[text_where]
    # Slot 0: letters that the pair's other line does not have.
    if count * kinds <= _TABLE:
        seen = np.zeros(count * kinds, bool)
        seen[keys] = True
        slot_of = np.cumsum(seen, dtype=np.int32) * seen
        slots, text_slots = slot_of[keys], slot_of[text_keys]
    else:
        found, slots = np.unique(keys, return_inverse=True)
        slots += 1
        at = np.minimum(np.searchsorted(found, text_keys), len(found) - 1)
        text_slots = np.where(found[at] == text_keys, at + 1, 0)
    # At letter i of the texts the words hold the places from i - half on.
    place += half
    equals = np.zeros((int(n[0]) // 64 + wide + 2, int(slots.max()) + 1), np.uint64)
    np.bitwise_or.at(equals.reshape(-1), (place // 64) * equals.shape[1] + slots, np.uint64(1) << (place % 64).astype(np.uint64))
    steps = np.zeros((int(n[0]), count), np.int64)
    steps[text_place, text_own] = text_slots
    going = np.searchsorted(-n, -np.arange(len(steps)), "left").tolist()
    up, down = np.zeros((wide, count), np.uint64), np.zeros((wide, count), np.uint64)
    for w in range(wide):
        up[w] = ((1 << 64) - 1) >> min(max(half - 64 * w, 0), 64) << min(max(half - 64 * w, 0), 64)
    # The last letters' place, followed from the first step on: what does not stay the same there is an edit.
    followed = half - (n - m)
    shift, own_word = (followed % 64).astype(np.uint64), [(followed // 64 == w).astype(np.uint64) for w in range(wide)]
    kept = np.zeros(count, np.uint64)
    one, top = np.uint64(1), np.uint64(63)
    buffers, same_, more_, less_ = np.empty((2, count), np.uint64), *(np.empty((wide, count), np.uint64) for _ in range(3))
    live = None
    for i, step in enumerate(steps):
        if going[i] != live:
            live = going[i]
            u, d, same, more, less = (x[:, :live] for x in (up, down, same_, more_, less_))
            equal, other, far, sum_, picks = buffers[0, :live], buffers[1, :live], shift[:live], kept[:live], [x[:live] for x in own_word]
        slot, word, off = step[:live], i // 64, i % 64
        right, left = np.uint64(off), np.uint64(64 - off)
        for w in range(wide):
            np.take(equals[word + w], slot, out=equal, mode="clip")
            if off:
                np.right_shift(equal, right, out=equal)
                np.take(equals[word + w + 1], slot, out=other, mode="clip")
                np.left_shift(other, left, out=other)
                np.bitwise_or(equal, other, out=equal)
            if w:  # one less in the place above
                np.right_shift(less[w - 1], top, out=other)
                np.bitwise_or(equal, other, out=equal)
            flat = same[w]
            np.bitwise_and(equal, u[w], out=flat)
            np.add(flat, u[w], out=flat)
            np.bitwise_xor(flat, u[w], out=flat)
            np.bitwise_or(flat, equal, out=flat)
            np.bitwise_or(flat, d[w], out=flat)
            np.bitwise_or(flat, u[w], out=more[w])
            np.invert(more[w], out=more[w])
            np.bitwise_or(more[w], d[w], out=more[w])
            np.bitwise_and(flat, u[w], out=less[w])
            np.right_shift(flat, far, out=other)
            np.bitwise_and(other, picks[w], out=other)
            np.add(sum_, other, out=sum_)
        for w in range(wide):
            np.right_shift(same[w], one, out=equal)
            if w + 1 < wide:
                np.left_shift(same[w + 1], top, out=other)
                np.bitwise_or(equal, other, out=equal)
            np.bitwise_and(equal, more[w], out=d[w])
            np.bitwise_or(equal, more[w], out=equal)
            np.invert(equal, out=equal)
            np.bitwise_or(equal, less[w], out=u[w])
    return n - kept.astype(np.int64)


def _all_edits(codes: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``edits`` of pairs of runs of ``codes``, from a and b, m and n long: many in step, few one by one."""
    total = np.zeros(len(a), np.int64)
    if not len(a):
        return total
    a, m, b, n = np.where(m <= n, (a, m, b, n), (b, n, a, m))
    same = _alike(codes, a, b, m, 1)
    a, m, b, n = a + same, m - same, b + same, n - same
    same = _alike(codes, a + m - 1, b + n - 1, m, -1)
    m, n = m - same, n - same
    total[:] = n
    todo, kinds, wide = np.flatnonzero(m > 0), int(codes.max(initial=0)) + 1, 1
    todo = todo[np.argsort(-n[todo])]
    while len(todo):
        within = n[todo] - m[todo] < 32 * wide
        now, begin, open_ = todo[within], 0, [todo[~within]]
        while begin < len(now):
            longest = int(n[now[begin]])
            most = _TABLE // max(longest, min(longest, kinds) * (longest // 64 + wide + 2))
            some = now[begin : begin + max(1, min(most, _IN_STEP))]
            begin += len(some)
            if len(some) >= _WORTH * wide:
                total[some] = _in_step(codes, a[some], m[some], b[some], n[some], wide)
                open_.append(some[total[some] >= 32 * wide])
            else:
                for i in some.tolist():
                    total[i] = edits(codes[a[i] : a[i] + m[i]].tolist(), codes[b[i] : b[i] + n[i]].tolist())
        # Wider words tell what these did not; where they reach over the whole line they tell all.
        todo = np.concatenate(open_)
        todo, wide = todo[np.argsort(-n[todo])], 2 * wide
    return total


def _assignments(cost: np.ndarray) -> np.ndarray:
    """``_assignment`` of many tables of one size."""
    own = cost.argmin(axis=2)
    rows = np.argsort(own, axis=1)
    for i in np.flatnonzero((np.take_along_axis(own, rows, 1) != np.arange(cost.shape[1])).any(axis=1)).tolist():
        rows[i] = _assignment(cost[i])
    return rows


def _pairings(codes: np.ndarray, sizes: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The least pairings of cases. ``codes``: the lines' letters or words as numbers, one line after another, ``sizes`` of them each; ``one``, ``two``: how many lines, in this order, each case's sides have (all first sides, then all second ones)."""
    total = np.zeros(len(one), np.int64)
    bags = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * _COUNTED + codes % _COUNTED, minlength=(len(sizes) + 1) * _COUNTED).reshape(-1, _COUNTED).astype(np.int32)
    starts, sizes = np.append(np.cumsum(sizes) - sizes, 0), np.append(sizes, 0)  # the last one: an empty line
    firsts = (np.cumsum(one) - one, one.sum() + np.cumsum(two) - two)
    most = np.maximum(one, two)
    going = []
    for n in np.unique(most[most > 0]).tolist():
        cases = np.flatnonzero(most == n)
        lines = [np.where(np.arange(n) < count[cases, None], first[cases, None] + np.arange(n), len(sizes) - 1) for first, count in zip(firsts, (one, two), strict=True)]
        shared = np.stack([np.minimum(bags[lines[0][:, i]][:, None], bags[lines[1]]).sum(axis=2) for i in range(n)], axis=1)
        cost = (np.maximum(sizes[lines[0]][:, :, None], sizes[lines[1]][:, None, :]) - shared).astype(float)
        going.append((cases, *lines, cost, np.zeros(cost.shape, bool)))
    turn = 0
    while going:
        left, todo = [], []
        for cases, own, other, cost, known in going:
            n = cost.shape[1]
            rows = _assignments(cost)
            chosen = (np.arange(len(cases))[:, None], rows, np.arange(n))
            done = known[chosen].all(axis=1)
            total[cases[done]] = np.rint(cost[chosen].sum(axis=1)[done])
            if done.all():
                continue
            new = np.zeros(known.shape, bool)
            new[chosen] = True
            if turn >= n:  # bounds that tell nothing apart: all pairs
                new[:] = True
            cases, own, other, cost, known, new = (x[~done] for x in (cases, own, other, cost, known, new))
            new &= ~known
            known |= new
            left.append((cases, own, other, cost, known))
            todo.append(np.nonzero(new))
        pairs = [(own[c, i], other[c, j]) for (_, own, other, _, _), (c, i, j) in zip(left, todo, strict=True)]
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            found, begin = _all_edits(codes, starts[a], sizes[a], starts[b], sizes[b]), 0
            for (_, _, _, cost, _), at in zip(left, todo, strict=True):
                cost[at] = found[begin : begin + len(at[0])]
                begin += len(at[0])
        going, turn = left, turn + 1
    return total


def least_pairing(one: Sequence[Sequence], two: Sequence[Sequence]) -> int:
    """The least total of edits when each line is paired with one of the other side's, the shorter side filled up with empty ones.

    Lines have at least as many edits as letters that only one of them has. Pairs
    that these bounds choose are compared, until none of the pairs chosen is a
    bound: the rest could only cost more.
    """
    numbers: dict = {}
    lines = [*one, *two]
    codes = np.array([numbers.setdefault(x, len(numbers)) for line in lines for x in line], np.int64)
    return int(_pairings(codes, np.array([len(line) for line in lines], np.int64), np.array([len(one)]), np.array([len(two)]))[0])


def _lines_of(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    return np.asarray(pa.compute.list_value_length(column).fill_null(0)).astype(np.int64), column.flatten()


def _least(truth: pa.Array, observed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The least pairings, by letters and by words, of many cases at once."""
    (one, first), (two, second) = _lines_of(truth), _lines_of(observed)
    lines = pa.concat_arrays([first, second])
    letters = np.frombuffer("".join(lines.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.asarray(pa.compute.utf8_length(lines)).astype(np.int64)
    split = pa.compute.split_pattern(lines, " ")
    words = split.flatten()
    filled = np.asarray(pa.compute.not_equal(words, ""))
    line_of = np.repeat(np.arange(len(lines)), np.asarray(pa.compute.list_value_length(split)))
    words, word_sizes = words.filter(pa.array(filled)).dictionary_encode(), np.bincount(line_of[filled], minlength=len(lines))
    if len(letters):
        letters = (np.cumsum(np.bincount(letters) > 0) - 1)[letters]
    return _pairings(letters, sizes, one, two), _pairings(np.asarray(words.indices).astype(np.int64), word_sizes, one, two)


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with two more columns: the least pairings of their lines by letters and by words."""
    for batch in batches:
        truth, observed = batch["truth_lines"], batch["observed_lines"]
        known = np.asarray(truth.is_valid()) & np.asarray(observed.is_valid())
        # What a row costs: its lines, its letters, its table of pairs.
        weight = np.zeros(len(known))
        for side in (truth, observed):
            count, lines = _lines_of(side)
            letters = np.append(0, np.cumsum(np.asarray(pa.compute.utf8_length(lines)).astype(np.int64) + _COUNTED // 2))
            ends = np.cumsum(count)
            weight += letters[ends] - letters[ends - count] + count.astype(float) ** 2
        parts, begin = [], 0
        reached = np.cumsum(weight)
        while begin < len(known):
            end = max(int(np.searchsorted(reached, (reached[begin - 1] if begin else 0) + _AT_ONCE, "right")), begin + 1)
            parts.append(_least(truth.slice(begin, end - begin), observed.slice(begin, end - begin)))
            begin = end
        found = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64(), mask=~known) for x in found)], [*batch.schema.names, "char_distance", "word_distance"])


def words(line: Column) -> Column:
    return F.filter(F.split(line, " "), lambda w: w != "")


def score_cases(cases: DataFrame) -> DataFrame:
    """``cases`` (truth_lines, observed_lines: composed texts) with distances, lengths, rates and ``exact``.

    Letters and words choose their pairings independently.
    """
    lined = cases.withColumn("truth_lines", tx.normalised_lines(F.col("truth_lines"))).withColumn("observed_lines", tx.normalised_lines(F.col("observed_lines")))
    truth, observed = F.col("truth_lines"), F.col("observed_lines")
    total = lambda lines, f: F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + f(x))
    lined = lined.drop("char_distance", "word_distance")
    schema = T.StructType([*lined.schema.fields, T.StructField("char_distance", T.LongType()), T.StructField("word_distance", T.LongType())])
    measured = lined.mapInArrow(_paired, schema)
    measured = measured.withColumn("char_length", total(truth, F.length)).withColumn("word_length", total(truth, lambda x: F.size(words(x))))
    rate = lambda part: F.col(f"{part}_distance") / F.greatest(F.col(f"{part}_length"), F.lit(1))
    return measured.withColumn("cer", rate("char")).withColumn("wer", rate("word")).withColumn("exact", ar.same_multiset(truth, observed))


def engine_summary(rows: DataFrame, engine: str, *, milliseconds: str = "ms") -> DataFrame:
    """Pooled rates, share of exact cases, median and nearest-rank p95 of an engine's rows; times may be null.

    Sums are combined before the shuffle and times selected by counting, so an
    engine may have any number of rows.
    """
    n = F.col("n")
    pooled = lambda part: F.try_divide(F.sum(f"{part}_distance"), F.sum(f"{part}_length"))
    sums = rows.groupBy(engine).agg(pooled("char").alias("cer"), pooled("word").alias("wer"), F.avg(F.col("exact").cast("int")).alias("exact_rate"), (F.sum(milliseconds) / 1000).alias("seconds"), F.count("*").alias("cases"))
    times = ranks.order_statistics(rows, engine, milliseconds, {"low": F.floor((n + 1) / 2), "high": F.ceil((n + 1) / 2), "p95": F.ceil(n * 95 / 100)}).withColumnRenamed(engine, "of")
    both = sums.join(times, F.col(engine).eqNullSafe(F.col("of")), "left")
    return both.select(engine, "cer", "wer", "exact_rate", ((F.col("low") + F.col("high")) / 2).alias("p50"), "p95", "seconds", "cases")


def variant_pivot(rows: DataFrame, variant: str, engine: str, engines: Sequence[str]) -> DataFrame:
    """Pooled character error of each variant (rows) and engine (columns)."""
    return rows.groupBy(variant).pivot(engine, list(engines)).agg(F.sum("char_distance") / F.greatest(F.sum("char_length"), F.lit(1)))


PROBLEMS = ("listed", "duplicate", "missing", "extra", "variant")


def case_parity(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row for each problem of an id: listed more than once, repeated, missing, extra, of another variant.

    ``expected``: id, variant. ``actual``: id, variant, place; of rows that
    repeat an id the last one's variant counts.
    """
    listed = expected.groupBy("id").agg(F.count("*").alias("times"), F.max("variant").alias("wanted"))
    seen = actual.groupBy("id").agg(F.count("*").alias("n"), F.max_by("variant", "place").alias("got"))
    both = listed.join(seen, "id", "full_outer")
    times, n = F.col("times"), F.col("n")
    tests = (times > 1, n > 1, n.isNull(), times.isNull(), times.isNotNull() & n.isNotNull() & ~F.col("wanted").eqNullSafe(F.col("got")))
    found = F.array_compact(F.array(*(F.when(test, name) for name, test in zip(PROBLEMS, tests, strict=True))))
    return both.select("id", F.explode(found).alias("problem"), "wanted", "got")


def id_multiset_parity(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Ids that one side has more often than the other."""
    missing = expected.select("id").exceptAll(actual.select("id")).withColumn("side", F.lit("missing"))
    return missing.unionByName(actual.select("id").exceptAll(expected.select("id")).withColumn("side", F.lit("extra")))
