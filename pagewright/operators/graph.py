"""Connected components of many graphs at once, small and large, from one list of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.shared import cut

#: Edges of one graph that a task settles by itself; a graph with more is dealt out by ranges of its nodes.
LOCAL_EDGES = 1 << 18
#: Edges that a task settles in one go, of however many graphs.
_AT_ONCE = 1 << 16


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of ``n`` nodes the smallest that each reaches by edges a-b: roots hook on smaller ones, then paths are halved."""
    up = np.arange(n)
    while True:
        one, two = up[a], up[b]
        if (one == two).all():
            return up
        np.minimum.at(up, np.maximum(one, two), np.minimum(one, two))
        while (up != (over := up[up])).any():
            up = over


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, node, label) of edges sorted by (page_id, part): each part's nodes with its smallest one that they reach."""

    def settle(edges: pa.Table) -> pa.RecordBatch:
        page = edges["page_id"].combine_chunks().dictionary_encode()
        own = np.asarray(page.indices).astype(np.int64)
        part = np.asarray(edges["part"])
        i, j = np.asarray(edges["i"]), np.asarray(edges["j"])
        fresh = np.concatenate([[False], (own[1:] != own[:-1]) | (part[1:] != part[:-1])])
        group = np.cumsum(fresh)
        nodes, places = np.unique(np.stack([np.concatenate([group, group]), np.concatenate([i, j])]), axis=1, return_inverse=True)
        places = places.reshape(-1)
        label = nodes[1][least_labels(places[: len(i)], places[len(i) :], nodes.shape[1])]
        first = np.flatnonzero(np.concatenate([[True], fresh[1:]]))
        return pa.record_batch({"page_id": page.dictionary.take(pa.array(own[first][nodes[0]])), "node": pa.array(nodes[1]), "label": pa.array(label)})

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < _AT_ONCE:
            continue
        table = pa.Table.from_batches(held)
        last = table.slice(rows - 1)
        own = np.asarray(table["part"]) == last["part"][0].as_py()
        own &= np.asarray(pa.compute.equal(table["page_id"], last["page_id"][0]))
        whole = int(np.flatnonzero(~own)[-1]) + 1 if not own.all() else 0
        if whole:
            yield settle(table.slice(0, whole))
        held, rows = table.slice(whole).to_batches(), rows - whole
    if rows:
        yield settle(pa.Table.from_batches(held))


def _local(edges: DataFrame, part: Column) -> DataFrame:
    dealt = edges.select("page_id", part.cast("long").alias("part"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))
    dealt = dealt.repartition("page_id", "part").sortWithinPartitions("page_id", "part")
    return dealt.mapInArrow(_stars, f"page_id {dict(edges.dtypes)['page_id']}, node long, label long")


def components(edges: DataFrame, *, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(page_id, node, label) of ``edges`` (page_id, i, j): the smallest node of its page that each node reaches; nodes without an edge are not listed.

    A page with few edges is settled in a task, together with many others. A page
    with more is dealt out: tasks contract ranges of its nodes to stars; these are
    linked round by round, each node to the least neighbour of its neighbours and
    what was larger to that (large stars and small stars in turn), so chains
    shrink to a share of their length in each round, until nothing changes. No
    task holds a page, and no edges come to the driver.
    """
    edges = cut(edges.where("page_id is not null"))
    sizes = edges.groupBy("page_id").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > local_edges).select("page_id", (F.col("n") / local_edges + 1).cast("long").alias("parts"))
    if not large.head(1):
        return _local(edges, F.lit(0))
    large = cut(large)
    small = _local(edges.join(large, "page_id", "left_anti"), F.lit(0))
    spread = edges.join(large, "page_id")
    most = spread.groupBy("page_id").agg((F.max("i") / F.max("parts") + 1).cast("long").alias("step"))
    stars = _local(spread.join(most, "page_id"), F.floor(F.col("i") / F.col("step")))
    return small.unionByName(_linked(stars.where("node <> label").select("page_id", F.col("node").alias("i"), F.col("label").alias("j"))))


def _linked(edges: DataFrame) -> DataFrame:
    """Labels of all nodes from edges (i > j) by large and small stars; neighbours are never collected in one row."""
    edges = cut(edges)
    before = None
    while True:
        both = edges.unionByName(edges.select("page_id", F.col("j").alias("i"), F.col("i").alias("j")))
        least = both.groupBy("page_id", "i").agg(F.min("j").alias("least")).select("page_id", "i", F.least("i", "least").alias("least"))
        # Large stars: larger neighbours hang on the least one, or on the node itself.
        large = both.where("j > i").join(least, ["page_id", "i"]).select("page_id", F.col("j").alias("i"), F.col("least").alias("j")).distinct()
        low = large.groupBy("page_id", "i").agg(F.min("j").alias("least"))
        # Small stars: smaller neighbours and the node hang on the least of them.
        other = large.join(low, ["page_id", "i"]).where("j <> least").select("page_id", F.col("j").alias("i"), F.col("least").alias("j"))
        edges = cut(other.unionByName(low.select("page_id", "i", F.col("least").alias("j"))).where("i <> j").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("page_id", "i", "j").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select("page_id", F.col("j").alias("node")).distinct().select("page_id", "node", F.col("node").alias("label"))
    return edges.select("page_id", F.col("i").alias("node"), F.col("j").alias("label")).unionByName(roots)
