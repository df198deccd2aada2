"""Edits and least pairings of lines against tables of all edits."""

import random

from pagewright.operators import scoring


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edits():
    r = random.Random(3)
    for _ in range(800):
        a, b = ("".join(r.choice("abé") for _ in range(r.randrange(90))) for _ in "xy")
        assert scoring.edits(a, b) == plain(a, b)
        assert scoring.edits(a.split("a"), b.split("a")) == plain(a.split("a"), b.split("a"))


def test_least_pairings():
    r = random.Random(4)
    for _ in range(600):
        one, two = (["".join(r.choice("abc") for _ in range(r.randrange(7))) for _ in range(r.randrange(6))] for _ in "xy")
        n = max(len(one), len(two))
        filled = [[*lines, *[""] * (n - len(lines))] for lines in (one, two)]
        assert scoring.least_pairing(one, two) == scoring.least_assignment([[plain(a, b) for b in filled[1]] for a in filled[0]])


def test_lines_are_not_all_compared(monkeypatch):
    r = random.Random(5)
    lines = [" ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 9))) for _ in range(12)) for _ in range(30)]
    compared = []
    edits = scoring.edits
    monkeypatch.setattr(scoring, "edits", lambda a, b: compared.append(1) or edits(a, b))
    seen = [x.replace("ab", "ba") + "!" for x in reversed(lines)]
    assert scoring.least_pairing(lines, seen) == sum(edits(a, b) for a, b in zip(lines, reversed(seen), strict=True))
    assert len(compared) <= 90
