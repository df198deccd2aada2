"""All segmentations of words into the pieces of a fixed vocabulary.

A text's words are separated by white space and pieces never reach over it, so
the sum over all segmentations of a text is the product over its words of the
sum over all segmentations of the word. Words are scored in groups of equal
length, one array operation for all words of a group; the forward recursion is
kept in log space. Long words have the same sums, taken position by position.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np

from pagewright.llm._text import _BASE, _BYTE, _U, _powers, mix

#: Words of so many bytes are walked one by one, their expected uses block by block.
_LONG = 256
_BLOCK = 1 << 12
_CELLS = 1 << 17
#: So many models at once; more are scored one block after another.
_MODELS = 32


def load_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Usable pieces of a sentencepiece model, as bytes, and their ranks.

    Pieces with A-Z cannot occur in lower-cased text and are left out. A word's
    start is a space byte. Every single byte is a piece, so every word has a
    segmentation.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rank: dict[bytes, int] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        piece = model.id_to_piece(i)
        raw = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        if any(65 <= b <= 90 for b in raw) or b" " in raw[1:]:
            continue
        place = -model.get_score(i) if not model.is_byte(i) else float(model.get_piece_size())
        rank[raw] = min(rank.get(raw, place), place)
    for b in range(256):
        rank.setdefault(bytes([b]), float(model.get_piece_size()))
    pieces = sorted(rank)
    return pieces, np.array([rank[p] for p in pieces])


def rank_scores(ranks: np.ndarray) -> np.ndarray:
    """Natural log of the probabilities that the vocabulary's own order gives (Zipf)."""
    p = 1.0 / (ranks + 10.0)
    return np.log(p / p.sum())


class Lattice:
    """The vocabulary as two hash tables, so that a lookup is two gathers."""

    def __init__(self, pieces: Sequence[bytes]):
        self.pieces = list(pieces)
        self.longest = max(map(len, self.pieces))
        self.keys = np.array([self._hash(p) for p in self.pieces], np.uint64)
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("pieces must be distinct")
        self.bits = max(8, int(np.ceil(np.log2(4 * len(self.pieces)))))
        self.table, self.ids = self._place()
        self._index: dict[bytes, int] | None = None

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * _BASE + int(_BYTE[b])) & (2**64 - 1)
        return h

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = keys * _U(0xD6E8FEB86659FD93)
        m ^= m >> _U(32)
        one = m & _U((1 << self.bits) - 1)
        two = (m >> _U(40)) & _U((1 << self.bits) - 1)
        return one.astype(np.int64), two.astype(np.int64) + (1 << self.bits)

    def _place(self) -> tuple[np.ndarray, np.ndarray]:
        """Cuckoo placement: a key lies in one of its two slots."""
        one, two = self._slots(self.keys)
        held = np.full(2 << self.bits, -1, np.int64)
        for k in range(len(self.keys)):
            at, moved = int(one[k]), k
            for _ in range(500):
                moved, held[at] = int(held[at]), moved
                if moved < 0:
                    break
                at = int(two[moved]) if at == one[moved] else int(one[moved])
            else:
                raise ValueError("the vocabulary does not fit its table")
        missing = len(self.keys)
        table = np.where(held >= 0, self.keys[held], _U(0))
        return table, np.where(held >= 0, held, missing).astype(np.int32)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Piece of each key; as many as there are pieces where there is none."""
        one, two = self._slots(keys)
        found = np.where(self.table[one] == keys, self.ids[one], np.int32(len(self.pieces)))
        return np.where(self.table[two] == keys, self.ids[two], found)

    @property
    def index(self) -> dict[bytes, int]:
        if self._index is None:
            self._index = {p: i for i, p in enumerate(self.pieces)}
        return self._index

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_index": None}

    # Groups ------------------------------------------------------------------

    def _groups(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which words, their bytes by position with the space before them)."""
        lengths = ends - starts
        order = np.argsort(lengths, kind="stable")
        bounds = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            n = int(lengths[order[a]])
            if n >= _LONG:
                continue
            most = max(1, _CELLS // (n + 1))
            for c in range(a, b, most):
                which = order[c : min(b, c + most)]
                letters = np.empty((n + 1, len(which)), np.uint8)
                letters[0] = 32
                for j in range(n):
                    letters[j + 1] = data[starts[which] + j]
                yield which, letters

    def _edges(self, letters: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(from, to) -> (words that have a piece there, which piece)."""
        n, m = letters.shape
        prefix = np.zeros((n + 1, m), np.uint64)
        for j in range(n):
            prefix[j + 1] = prefix[j] * _U(_BASE) + _BYTE[letters[j]]
        power = _powers(_BASE, self.longest + 1)
        none, out = len(self.pieces), {}
        for size in range(1, min(self.longest, n) + 1):
            ids = self.lookup(prefix[size:] - prefix[:-size] * power[size])
            for i in range(n - size + 1):
                hit = np.flatnonzero(ids[i] != none)
                if len(hit):
                    out[i, i + size] = hit, ids[i][hit]
        return out

    @staticmethod
    def _forward(edges: dict, n: int, m: int, logp: np.ndarray) -> np.ndarray:
        alpha = np.full((n + 1, m, logp.shape[1]), -np.inf)
        alpha[0] = 0
        for (i, j), (hit, ids) in sorted(edges.items(), key=lambda e: e[0][1]):
            alpha[j][hit] = np.logaddexp(alpha[j][hit], alpha[i][hit] + logp[ids])
        return alpha

    def score(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Log of the sum over segmentations of each word, for each column of logp (piece x model)."""
        out = np.zeros((len(starts), logp.shape[1]))
        for which, letters in self._groups(data, starts, ends):
            n, m = letters.shape
            edges = self._edges(letters)
            for k in range(0, logp.shape[1], _MODELS):
                out[which, k : k + _MODELS] = self._forward(edges, n, m, logp[:, k : k + _MODELS])[n]
        for w in np.flatnonzero(ends - starts >= _LONG):
            out[w] = self.score_one(b" " + data[starts[w] : ends[w]].tobytes(), logp)
        return out

    def score_one(self, word: bytes, logp: np.ndarray) -> np.ndarray:
        """One word, position by position, with no table but a dictionary."""
        ring = [np.zeros(logp.shape[1])]
        for j in range(1, len(word) + 1):
            best = np.full(logp.shape[1], -np.inf)
            for i in range(max(0, j - self.longest), j):
                k = self.index.get(word[i:j])
                if k is not None:
                    best = np.logaddexp(best, ring[i - j] + logp[k])
            ring.append(best)
            if len(ring) > self.longest:
                ring.pop(0)
        return ring[-1]

    def expected(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words, under one model."""
        total = np.zeros(len(self.pieces))
        logp = logp[:, None]
        for which, letters in self._groups(data, starts, ends):
            n, m = letters.shape
            edges = self._edges(letters)
            alpha = self._forward(edges, n, m, logp)[:, :, 0]
            beta = np.full((n + 1, m), -np.inf)
            beta[n] = 0
            for (i, j), (hit, ids) in sorted(edges.items(), key=lambda e: -e[0][0]):
                beta[i][hit] = np.logaddexp(beta[i][hit], beta[j][hit] + logp[ids, 0])
            for (i, j), (hit, ids) in edges.items():
                use = np.exp(alpha[i][hit] + logp[ids, 0] + beta[j][hit] - alpha[n][hit]) * weights[which][hit]
                total += np.bincount(ids, use, len(self.pieces))
        chances = logp[:, 0].tolist()
        for w in np.flatnonzero(ends - starts >= _LONG):
            for ids, use in self._long_uses(np.concatenate([[np.uint8(32)], data[starts[w] : ends[w]]]), chances):
                total += np.bincount(ids, use * weights[w], len(self.pieces))
        return total

    def _into(self, word: np.ndarray, a: int, b: int) -> Iterator[list[tuple[int, int]]]:
        """For each position from a + 1 to b, the (from, piece) of all pieces that end there."""
        low = max(0, a + 1 - self.longest)
        code = _BYTE[word[low:b]]
        keys, found = code, []
        for size in range(1, min(self.longest, b - low) + 1):
            if size > 1:
                keys = keys[:-1] * _U(_BASE) + code[size - 1 :]
            ids = self.lookup(keys)
            at = np.flatnonzero(ids != len(self.pieces))
            found.append(np.stack([at + low + size, at + low, ids[at]]))
        to, start, ids = np.concatenate(found, axis=1)
        order = np.argsort(to, kind="stable")
        bounds = np.searchsorted(to[order], np.arange(a + 1, b + 2))
        pairs = list(zip(start[order].tolist(), ids[order].tolist(), strict=True))
        return (pairs[i:j] for i, j in pairwise(bounds.tolist()))

    def _long_uses(self, word: np.ndarray, logp: list[float]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pieces, their expected uses) in one word; only what a block needs of the one before it is kept."""
        n = len(word)
        blocks = [(a, min(a + _BLOCK, n)) for a in range(0, n, _BLOCK)]

        def onward(alpha: list[float], edges: list[list[tuple[int, int]]], low: int) -> list[float]:
            """Forward sums of the positions from low to the end of the block."""
            alpha = alpha.copy()
            for into in edges:
                sums = [alpha[i - low] + logp[k] for i, k in into]
                top = max(sums)
                alpha.append(top + math.log(sum(math.exp(x - top) for x in sums)))
            return alpha

        lows = [max(0, a + 1 - self.longest) for a, _ in blocks]
        kept = [[0.0]]
        for (a, b), low in zip(blocks, lows, strict=True):
            kept.append(onward(kept[-1], list(self._into(word, a, b)), low)[max(0, b + 1 - self.longest) - low :])
        whole = kept.pop()[-1]
        beta = [0.0]  # of the positions from the last block's end on; before it only parts of the sums
        first = n
        for (a, b), low in zip(reversed(blocks), reversed(lows), strict=True):
            edges = list(self._into(word, a, b))
            alpha = onward(kept.pop(), edges, low)
            beta = [-math.inf] * (first - low) + beta
            ids, use = [], []
            for j, into in zip(range(b, a, -1), reversed(edges), strict=True):
                for i, k in into:
                    rest = logp[k] + beta[j - low]
                    ids.append(k)
                    use.append(alpha[i - low] + rest - whole)
                    x, y = (rest, beta[i - low]) if rest > beta[i - low] else (beta[i - low], rest)
                    beta[i - low] = x + math.log1p(math.exp(y - x))
            yield np.array(ids), np.exp(use)
            beta, first = beta[: a - low + 1], low


def estimate(counts: np.ndarray, prior: float) -> np.ndarray:
    """Natural log of smoothed piece probabilities."""
    return np.log((counts + prior) / (counts.sum() + prior * len(counts)))


__all__ = ["Lattice", "estimate", "load_pieces", "mix", "rank_scores"]
