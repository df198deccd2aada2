"""Pairings of many cases at once against those of one at a time."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_pairings import plain

from pagewright.operators import scoring


def changed(r, line, times, letters):
    out = list(line)
    for _ in range(times):
        at = r.randrange(len(out) + 1)
        out[at : at + r.randrange(2)] = r.choice(["", r.choice(letters), r.choice(letters) * 3])
    return "".join(out)


def cases(r, count):
    letters = r.choice(["ab ", "abcdefgh é花 "])
    for _ in range(count):
        truth = [" ".join("".join(r.choice(letters) for _ in range(r.choice([0, 3, 30, 90]))).split()) for _ in range(r.randrange(5))]
        seen = [" ".join(changed(r, x, r.choice([0, 0, 1, 6, 40]), letters).split()) for x in truth if r.random() < 0.9]
        r.shuffle(seen)
        yield [x for x in truth if x], [x for x in seen if x]


def measured(both):
    lines = lambda side: pa.array([None if x is None else x[side] for x in both], pa.list_(pa.string()))
    batch = pa.record_batch({"truth_lines": lines(0), "observed_lines": lines(1)})
    (out,) = scoring._paired(iter([batch]))
    return list(zip(out["char_distance"].to_pylist(), out["word_distance"].to_pylist(), strict=True))


def wanted(both):
    total = []
    for sides in both:
        for split in (list, str.split):
            one, two = ([split(line) for line in side] for side in sides)
            n = max(len(one), len(two))
            one, two = ([*x, *[[]] * (n - len(x))] for x in (one, two))
            total.append(scoring.least_assignment([[plain(a, b) for b in two] for a in one]))
    return list(zip(total[::2], total[1::2], strict=True))


@pytest.mark.parametrize(("at_once", "table"), [(1 << 22, 1 << 22), (3000, 1 << 22), (1 << 22, 1 << 14)])
def test_many_cases(monkeypatch, at_once, table):
    monkeypatch.setattr(scoring, "_AT_ONCE", at_once)
    monkeypatch.setattr(scoring, "_TABLE", table)
    monkeypatch.setattr(scoring, "_WORTH", 2)
    both = list(cases(random.Random(at_once + table), 90))
    assert measured(both) == wanted(both)
    assert measured([*both[:3], None, *both[3:9]]) == [*wanted(both[:3]), (None, None), *wanted(both[3:9])]
    assert measured([]) == []


@pytest.mark.parametrize("wide", [1, 2, 3])
def test_words_that_move_on(wide):
    r = random.Random(wide)
    pairs = []
    while len(pairs) < 400:
        one = "".join(r.choice("abcd") for _ in range(r.choice([1, 5, 40, 70, 150])))
        two = changed(r, one, r.choice([1, 5, 20, 40]), "abcdef")
        one, two = sorted((one, two), key=len)
        if one and len(two) - len(one) < 32 * wide:
            pairs.append((one, two))
    pairs.sort(key=lambda p: -len(p[1]))
    codes = np.array([ord(x) for p in pairs for x in p[0] + p[1]])
    m, n = (np.array([len(p[side]) for p in pairs]) for side in (0, 1))
    start = np.cumsum(m + n) - m - n
    found = scoring._in_step(codes, start, m, start + m, n, wide).tolist()
    exact = [plain(*p) for p in pairs]
    assert [min(x, 32 * wide) for x in found] == [min(x, 32 * wide) for x in exact]
    assert max(exact) >= 32


def test_like_lines_of_many_cases_are_not_compared_one_by_one(monkeypatch):
    r = random.Random(2)
    truth = [[" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(8)) for _ in range(3)] for _ in range(200)]
    monkeypatch.setattr(scoring, "edits", lambda a, b: pytest.fail("one by one"))
    assert measured([(x, [line.replace("a", "", 1) + "x" for line in reversed(x)]) for x in truth])[0][0] > 0
