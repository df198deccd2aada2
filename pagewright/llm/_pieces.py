"""Piece probabilities from word counts: expectation-maximisation over all segmentations.

One job an iteration: tasks turn their words into expected uses of pieces, these
are summed by piece, and as many numbers as the vocabulary has pieces come back.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm._lattice import Lattice, estimate
from pagewright.llm._text import buffers


def pack(*values) -> bytes:
    raw = pickle.dumps(values, 5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpack(blob: bytes) -> tuple:
    return pickle.loads(pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True))


def words_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as a binary column."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _expected(lattice: Lattice, logp: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(logp.shape)
        for batch in batches:
            data, offsets, _ = buffers(batch.column(1))
            group, n = np.asarray(batch.column(0)), np.asarray(batch.column(2)).astype(float)
            for g in np.unique(group):
                own = np.flatnonzero(group == g)
                total[g] += lattice.expected(data, offsets[own], offsets[own + 1], n[own], logp[g])
        g, piece = np.nonzero(total)
        yield pa.record_batch({"grp": pa.array(g, pa.int32()), "piece": pa.array(piece, pa.int32()), "used": pa.array(total[g, piece])})

    return run


def fit(counts: DataFrame, lattice: Lattice, groups: int, start: np.ndarray, *, iterations: int, prior: float, extra: np.ndarray | None = None) -> np.ndarray:
    """Log probabilities (groups x pieces) from ``counts`` (grp int, word binary, n long).

    ``extra``: counts of one more symbol for each group, which has the last column.
    """
    extra = np.zeros((groups, 0)) if extra is None else extra.reshape(groups, 1).astype(float)
    logp = np.tile(start, (groups, 1))
    for turn in range(iterations):
        rows = counts.mapInArrow(_expected(lattice, logp), "grp int, piece int, used double").groupBy("grp", "piece").agg(F.sum("used").alias("used")).toPandas()
        used = np.zeros((groups, len(lattice.pieces)))
        used[rows["grp"].to_numpy(), rows["piece"].to_numpy()] = rows["used"].to_numpy()
        full = np.concatenate([used, extra], axis=1)
        fitted = np.stack([estimate(x, prior) for x in full])
        logp = fitted if turn == iterations - 1 else fitted[:, : len(lattice.pieces)]
    return logp
