"""Byte kernels and lattices against plain code."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import _lattice
from pagewright.llm import _text as kernel
from pagewright.llm._lattice import Lattice, estimate, load_pieces, rank_scores
from pagewright.llm.lm_scoring import VOCABULARY

TEXTS = ["", None, "a", " a  b\tc\n", "é ü\x0bz", "x" * 3000, "ab" * 7 + " " * 9 + "cd", "1 2 3 4 5 6", "ÀÉ abc ABC"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


def read(texts):
    data, offsets, valid = kernel.buffers(pa.array(texts, pa.string()))
    return kernel.Words(kernel.LOWER[data], offsets), valid


def test_words_match_a_regular_expression(monkeypatch):
    texts = TEXTS * 3
    for size in (1 << 20, 7):  # also where slices end within words and texts
        monkeypatch.setattr(kernel, "_SLICE", size)
        found, valid = read(texts)
        got = [[found.data[a:b].tobytes().decode() for a, b in zip(found.start[i:j], found.end[i:j], strict=True)] for i, j in zip(found.first, found.first[1:])]
        assert got == [words(t) for t in texts] and valid.tolist() == [t is not None for t in texts]


def test_equal_words_have_equal_hashes():
    found, _ = read(["ab cd ab", "cd ab", "abcd ba"])
    names = [found.data[a:b].tobytes() for a, b in zip(found.start, found.end, strict=True)]
    by_name = {}
    for name, h in zip(names, found.hash, strict=True):
        assert by_name.setdefault(name, h) == h
    assert len(set(by_name.values())) == len(by_name) == 4


def test_slices_of_arrow_columns():
    column = pa.array(["zz", "ab", None, "cd e"], pa.string()).slice(1)
    data, offsets, valid = kernel.buffers(column)
    assert data.tobytes() == b"abcd e" and offsets.tolist() == [0, 2, 2, 6] and valid.tolist() == [True, False, True]


def segmentations(word, pieces):
    if not word:
        yield []
    for i in range(1, len(word) + 1):
        if word[:i] in pieces:
            for rest in segmentations(word[i:], pieces):
                yield [word[:i], *rest]


def test_lattice_sums_all_segmentations():
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"abc", b"bc", b" abc"]
    lattice = Lattice(pieces)
    logp = np.log(np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 2).T)
    names = [b"abc", b"aab", b"cabab", b"b", b"abcabc"]
    data = np.frombuffer(b"".join(names), np.uint8)
    ends = np.cumsum([len(w) for w in names])
    starts = ends - [len(w) for w in names]
    got = lattice.score(data, starts, ends, logp)
    used = np.zeros(len(pieces))
    for word, row in zip(names, got, strict=True):
        paths = [[pieces.index(p) for p in path] for path in segmentations(b" " + word, set(pieces))]
        for m in range(2):
            chances = [math.exp(sum(logp[k, m] for k in path)) for path in paths]
            assert row[m] == pytest.approx(math.log(sum(chances)))
        for path in paths:
            for k in path:
                used[k] += 2 * math.exp(sum(logp[j, 0] for j in path)) / math.exp(row[0])
    assert lattice.expected(data, starts, ends, np.full(len(names), 2.0), logp[:, 0]) == pytest.approx(used)
    assert np.exp(estimate(used, 0.1)).sum() == pytest.approx(1)


def test_long_words_take_the_other_path():
    pieces, _ = load_pieces(VOCABULARY)
    lattice = Lattice(pieces)
    logp = np.full((len(pieces), 1), -math.log(len(pieces)))
    random.seed(1)
    word = "".join(random.choice("théring") for _ in range(400)).encode()
    data = np.frombuffer(word, np.uint8)
    long = lattice.score(data, np.array([0]), np.array([len(word)]), logp)
    assert long[0] == pytest.approx(lattice.score_one(b" " + word, logp)) and np.isfinite(long).all()
    short = data[:50]
    assert lattice.score(short, np.array([0]), np.array([50]), logp)[0] == pytest.approx(lattice.score_one(b" " + short.tobytes(), logp))


def uses_by_plain_sums(word, pieces, logp):
    """Expected uses by forward and backward sums over every pair of positions, in whole arrays of logs."""
    index = {p: k for k, p in enumerate(pieces)}
    n, longest = len(word), max(map(len, pieces))
    edges = [(i, j, index[word[i:j]]) for i in range(n) for j in range(i + 1, min(n, i + longest) + 1) if word[i:j] in index]
    alpha, beta, used = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf), np.zeros(len(pieces))
    alpha[0] = beta[n] = 0
    for i, j, k in sorted(edges, key=lambda e: e[1]):
        alpha[j] = np.logaddexp(alpha[j], alpha[i] + logp[k])
    for i, j, k in sorted(edges, key=lambda e: -e[0]):
        beta[i] = np.logaddexp(beta[i], beta[j] + logp[k])
    for i, j, k in edges:
        used[k] += math.exp(alpha[i] + logp[k] + beta[j] - alpha[n])
    return used


@pytest.mark.parametrize("block", [7, 100, 4096])
@pytest.mark.parametrize("text", ["lattice", "汉字每行不分词", "aGVsbG8gd29ybGQ"])
def test_expected_uses_do_not_depend_on_length(monkeypatch, text, block):
    monkeypatch.setattr(_lattice, "_BLOCK", block)
    pieces, ranks = load_pieces(VOCABULARY)
    lattice = Lattice(pieces)
    logp = rank_scores(ranks)
    random.seed(3)
    raw = "".join(random.choice(text) for _ in range(420)).lower().encode()
    for size in (255, 256, 257, 400):
        data = np.frombuffer(raw[:size], np.uint8)
        got = lattice.expected(data, np.array([0]), np.array([size]), np.array([3.0]), logp)
        assert got == pytest.approx(3 * uses_by_plain_sums(b" " + raw[:size], pieces, logp))
        assert got @ [len(p) for p in pieces] == pytest.approx(3 * (size + 1))
