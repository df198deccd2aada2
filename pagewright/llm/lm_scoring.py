"""Language-model scoring: the marginal probability of a text over a subword lattice.

A word's probability sums over all its segmentations into pieces of a fixed
vocabulary (forward recursion in log space); a text's is the product over its
words and one end symbol. Starting from the scores the vocabulary's order gives,
piece probabilities are re-estimated on the counts of all training words.

Documents are read in units of a few MB. A unit's distinct words go, with their
counts, to buckets by a hash of the word, so that a word met in every document
costs one entry a unit and no bucket is hotter than another. A bucket counts
and scores each of its words once and answers every unit by position; the
units then add up their documents. Nothing held by a task grows with the corpus.

Defined results: a null or empty text has no word, only its end; a row with a
null id is a training row or not by the empty text's crc32, and one whose
``held_out`` is null is a training row; repeated rows are scored, and counted,
each time; texts of equal words get equal scores; a very long text is a unit of
its own, and a very long word is scored position by position with the same sums;
an empty table gives an empty result. Extra columns are ignored, whatever their
names. Words are told apart by 64-bit hashes: of n distinct ones, two are taken for
one with probability below n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm._lattice import Lattice, load_pieces, rank_scores
from pagewright.llm._pieces import fit, pack, unpack, words_of
from pagewright.llm._session import cut, documents, not_remainder, partitions
from pagewright.llm._text import LOWER, Words, buffers, chunks, span_hashes

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MODULUS, HELD_OUT = 7, 2
_LN10 = np.log(10.0)
_ROWS = "kind int, place long, unit long, blob binary"
_WORDS, _TEXTS, _VALUES = 0, 1, 2


def _rows(kind: int, places: list[int], unit: int, blobs: list[bytes]) -> pa.RecordBatch:
    n = len(places)
    return pa.record_batch({"kind": pa.array([kind] * n, pa.int32()), "place": pa.array(places, pa.int64()), "unit": pa.array([unit] * n, pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _read(buckets: int) -> Callable:
    """Units: their words by bucket, and their texts as word numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, held = part.column(0), np.asarray(part.column(1).fill_null(False).cast(pa.uint8())).astype(bool)
                data, offsets, _ = buffers(part.column(2))
                data = LOWER[data]
                words = Words(data, offsets)
                _, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
                bucket = (words.hash[first] >> np.uint64(33)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")  # words are numbered in the order of buckets
                number = np.empty(len(order), np.int64)
                number[order] = np.arange(len(order))
                first, bucket = first[order], bucket[order]
                word = number[which]
                learnt = np.bincount(word, ~held[words.doc], len(first)).astype(np.int64)
                names = words_of(data, words.start[first], words.end[first])
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else np.zeros(1, np.int64)
                places, blobs = [], []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    raw, at, _ = buffers(names.slice(a, b - a))
                    places.append(int(bucket[a])), blobs.append(pack(raw.tobytes(), np.diff(at).astype(np.uint32), learnt[a:b].astype(np.uint32)))
                if places:
                    yield _rows(_WORDS, places, unit, blobs)
                pair, times = np.unique(words.doc * max(1, len(first)) + word, return_counts=True)
                doc, word = pair // max(1, len(first)), pair % max(1, len(first))
                yield _rows(_TEXTS, [-1], unit, [pack(ids.to_pylist(), held, np.bincount(words.doc, minlength=part.num_rows), np.bincount(doc, minlength=part.num_rows), word.astype(np.uint32), times.astype(np.uint32))])
                unit += 1

    return run


def _bucket(table: pa.Table) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of a bucket: (unit, from, to) of each row, bytes, starts, ends, word of each entry, count of each word."""
    spans, raws, lengths, learnt, at = [], [], [], [], 0
    for unit, blob in zip(table["unit"].to_pylist(), table["blob"].to_pylist(), strict=True):
        raw, size, n = unpack(blob)
        spans.append((unit, at, at + len(size)))
        raws.append(raw), lengths.append(size), learnt.append(n)
        at += len(size)
    data = np.frombuffer(b"".join(raws), np.uint8)
    size = np.concatenate(lengths).astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    _, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return spans, data, starts[first], ends[first], which, np.bincount(which, np.concatenate(learnt), len(first)).astype(np.int64)


def _count(table: pa.Table) -> pa.Table:
    _, data, starts, ends, _, n = _bucket(table)
    known = np.flatnonzero(n)
    return pa.table({"grp": pa.array(np.zeros(len(known)), pa.int32()), "word": words_of(data, starts[known], ends[known]).cast(pa.binary()), "n": pa.array(n[known], pa.int64())})


def _value(lattice: Lattice, logp: np.ndarray) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        spans, data, starts, ends, which, n = _bucket(table)
        score = lattice.score(data, starts, ends, logp)
        place = table["place"][0].as_py()
        rows = [_rows(_VALUES, [place], unit, [pack(n[which[a:b]].astype(np.uint64), score[which[a:b]])]) for unit, a, b in spans]
        return pa.Table.from_batches(rows)

    return run


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double, vocabulary_score double"


def _add_up(table: pa.Table) -> pa.Table:
    """One unit: its texts' sums from the answers of its buckets, which come in the order of its words."""
    rows = sorted(zip(table["kind"].to_pylist(), table["place"].to_pylist(), table["blob"].to_pylist(), strict=True), key=lambda r: r[:2])
    answers = [unpack(blob) for kind, _, blob in rows if kind == _VALUES]
    n = np.concatenate([x[0] for x in answers]) if answers else np.empty(0, np.uint64)
    score = np.concatenate([x[1] for x in answers]) if answers else np.empty((0, 2))
    ids, held, n_words, n_pairs, word, times = next(unpack(blob) for kind, _, blob in rows if kind == _TEXTS)
    docs = len(ids)
    doc = np.repeat(np.arange(docs), n_pairs)
    add = lambda value: np.bincount(doc, times * value[word], docs)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held), "n_tokens": pa.array(n_words + 1, pa.int64()), "n_known": pa.array(add(n > 0).astype(np.int64)), "base_sum": pa.array(add(np.log10(n + 1.0))), "score": pa.array(add(score[:, 0]) / _LN10), "vocabulary_score": pa.array(add(score[:, 1]) / _LN10)})


def score_texts(docs: DataFrame, *, vocabulary: str = VOCABULARY, iterations: int = 3, prior: float = 0.01) -> DataFrame:
    """Score all texts of ``docs`` (doc_id long, held_out boolean, text), learning from rows not held out.

    ``score``: the lattice model's log10 probability of the whole text, with piece
    scores re-estimated on the training words; ``vocabulary_score``: that with the
    scores that the vocabulary's own order gives.
    ``base_score``: that of whole words and the end, add-one smoothed.
    """
    spark = docs.sparkSession
    buckets = max(partitions(spark), -(-int(docs.select(F.sum(F.octet_length("text"))).first()[0] or 0) // (16 << 20)))
    pieces, ranks = load_pieces(vocabulary)
    lattice = Lattice(pieces)
    units = cut(docs.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text").mapInArrow(_read(buckets), _ROWS))
    words = units.where(F.col("kind") == _WORDS).groupBy("place")
    counts = cut(words.applyInArrow(_count, "grp int, word binary, n long"))
    ends = docs.where("held_out is null or not held_out").count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("distinct")).first()
    train_tokens, distinct = total["n"] + ends, total["distinct"] + (ends > 0)
    logp = fit(counts, lattice, 1, rank_scores(ranks), iterations=iterations, prior=prior, extra=np.array([ends]))[0]
    end = logp[-1]  # the share of ends is that of the training texts in both models
    own = rank_scores(ranks) + np.log1p(-np.exp(end))
    values = words.applyInArrow(_value(lattice, np.stack([logp[:-1], own], axis=1)), _ROWS)
    sums = values.unionByName(units.where(F.col("kind") == _TEXTS)).groupBy("unit").applyInArrow(_add_up, _RESULT)
    known_end = int(ends > 0)
    base = F.col("base_sum") + F.lit(float(np.log10(ends + 1))) - F.col("n_tokens") * F.lit(float(np.log10(train_tokens + distinct + 1)))
    return sums.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + known_end).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), *((F.col(c) + F.lit(float(end / _LN10))).alias(c) for c in ("score", "vocabulary_score")))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", (~not_remainder("doc_id", MODULUS, HELD_OUT)).alias("held_out"), "text")
    return score_texts(docs)
