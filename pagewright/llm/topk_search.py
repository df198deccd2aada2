"""Exact top-k search by inner product: term-at-a-time accumulation.

A dimension is a term, a row's non-zero integer component there a posting. For a
block of queries and a batch of rows there is a dense array of scores; term by
term, each query's weight is scattered with the term's postings into it. The
best k of each query are found by partition selection, of equal scores those of
smaller ids, and merged, first in a task, then over all.

Rows are not moved: each task streams over its own rows, and queries come to it
by broadcasts of at most ``PASS_BYTES``, one pass over the rows each. What is
shuffled are k results a query and task. The driver holds one pass's queries.

Defined results: a vector that is null or holds a null or non-finite component
takes no part, neither does a row without an id; a shorter vector has no posting
in the terms it lacks; an empty one scores 0; a row does not meet rows of its own
id; a repeated query id is one query, the row with the smallest vector; repeated
candidates are ranked each time; without queries or rows there is no result.
Components and scores of any size are exact; a score beyond the ends of a long
counts as that end, when it is ranked too. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm._session import cut

BLOCK_QUERIES = 1024
#: Bytes of one pass's queries, and cells of a dense array of scores or rows.
PASS_BYTES = 1 << 26
_CELLS = 1 << 21
_LONG = 2**63


def scaled(vectors: DataFrame, *, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, terms array<double>) of the rows that take part."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return vectors.where(x.isNotNull() & F.col(id_column).isNotNull()).where(finite).select(F.col(id_column).cast("long").alias("vec_id"), x.cast("array<double>").alias("terms"))


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of each value, exact: 64-bit integers, or Python's where one does not fit."""
    if not len(values) or np.abs(values).max() * scale < 2.0**53:
        return np.floor(values * scale).astype(np.int64)
    # A double of 2**53 or more is an integer itself.
    return np.array([int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in values.tolist()], object)


def _matrix(lists: pa.ListArray, scale: int) -> np.ndarray:
    """Rows x terms; a list that is shorter than the longest ends in zeros."""
    lengths = np.asarray(lists.value_lengths())
    flat = whole(np.asarray(lists.flatten()), scale)
    out = np.zeros((len(lists), int(lengths.max(initial=0))), flat.dtype)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores (queries x rows), built up term by term; Python's integers where they may not fit 64 bits."""
    terms = min(queries.shape[1], rows.shape[1])
    fits = _most(queries) * _most(rows) * terms < _LONG
    if not fits:
        queries, rows = queries.astype(object), rows.astype(object)
    elif object in (queries.dtype, rows.dtype):
        queries, rows = queries.astype(np.int64), rows.astype(np.int64)
    scores = np.zeros((len(queries), len(rows)), np.int64 if fits else object)
    for term in range(terms):
        having = np.flatnonzero(rows[:, term])
        asking = np.flatnonzero(queries[:, term])
        if not len(having) or not len(asking):
            continue
        weights = queries[asking, term][:, None]
        if len(having) == len(rows) and len(asking) == len(queries):
            scores += weights * rows[:, term]
        else:
            scores[np.ix_(asking, having)] += weights * rows[having, term]
    return scores


def scored(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers. The few rows and queries that are too large for that arithmetic go a slower way, the others do not."""
    terms = max(1, min(queries.shape[1], rows.shape[1]))
    bound = int((_LONG // terms) ** 0.5) - 1
    small = lambda x: np.array([_most(v) < bound for v in x], bool) if _most(x) >= bound else np.ones(len(x), bool)
    q, r = small(queries), small(rows)
    out = np.zeros((len(queries), len(rows)), np.int64)
    ends = lambda x: np.clip(x, -_LONG, _LONG - 1).astype(np.int64) if x.size else x.astype(np.int64)
    for one in (q, ~q):
        for two in (r, ~r):
            if one.any() and two.any():
                out[np.ix_(one, two)] = ends(accumulate(queries[one], rows[two]))
    return out


def select(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> list[np.ndarray]:
    """Places of each query's k best allowed rows; of equal scores those of smaller ids."""
    out = []
    for score, may in zip(scores, allowed, strict=True):
        places = np.flatnonzero(may)
        if len(places) > k:
            own = score[places]
            least = np.partition(own, len(own) - k)[len(own) - k]
            places = places[own >= least]  # with all ties at the edge
        out.append(places[np.lexsort((ids[places], -(score[places] + 1)))][:k])  # so that the least long has a negative too
    return out


def _search(asked: Broadcast, k: int, scale: int) -> Callable:
    """The best k of a task's rows (vec_id, terms) for each query of a pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, lists = asked.value
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in query_ids]
        # Block by block as numbers, so that one wide or huge query does not widen all.
        blocks = [(at, _matrix(lists.slice(at, BLOCK_QUERIES), scale)) for at in range(0, len(query_ids), BLOCK_QUERIES)]
        for batch in batches:
            widest = int(np.asarray(batch.column(1).value_lengths()).max(initial=1)) if batch.num_rows else 1
            step = max(1, _CELLS // max(min(BLOCK_QUERIES, max(1, len(query_ids))), widest))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                ids, rows = np.asarray(part.column(0)), _matrix(part.column(1), scale)
                for at, queries in blocks:
                    own = query_ids[at : at + BLOCK_QUERIES]
                    scores = scored(queries, rows)
                    for q, places in enumerate(select(scores, ids, ids[None, :] != own[:, None], k)):
                        s, i = np.concatenate([held[at + q][0], scores[q, places]]), np.concatenate([held[at + q][1], ids[places]])
                        best = np.lexsort((i, -(s + 1)))[:k]
                        held[at + q] = s[best], i[best]
        sizes = [len(s) for s, _ in held]
        if sum(sizes):
            yield pa.record_batch({"query_id": pa.array(np.repeat(query_ids, sizes)), "vec_id": pa.array(np.concatenate([i for _, i in held])), "score": pa.array(np.concatenate([s for s, _ in held]))})

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, *, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``rows`` for each of ``queries`` (both vec_id, terms)."""
    spark = rows.sparkSession
    queries = cut(queries.groupBy("vec_id").agg(F.min("terms").alias("terms")))
    held = queries.agg(F.sum(F.size("terms") + 2)).first()[0] or 0
    passes = max(1, -(-8 * held // PASS_BYTES))
    found = None
    for i in range(passes):
        asked = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i).toArrow()
        sent = spark.sparkContext.broadcast((np.asarray(asked["vec_id"]), asked["terms"].combine_chunks()))
        own = rows.select("vec_id", "terms").mapInArrow(_search(sent, k, scale), "query_id long, vec_id long, score long")
        if passes > 1:
            own = cut(own)
            sent.destroy()
        found = own if found is None else found.unionByName(own)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, rows.where("vec_id % 100 = 0"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS t
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
terms AS (SELECT vec_id, unnest(t) AS w, unnest(range(len(t))) AS term FROM v),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM terms q JOIN terms c ON q.term = c.term AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
  GROUP BY 1, 2),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
