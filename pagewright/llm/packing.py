"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the longest length are cut into pieces. Pieces are dealt
into groups by a hash, so many that a group holds a bounded number of tokens;
each is packed alone. Equal rows are counted together first and dealt in lots of
bounded tokens, so neither a repeated or missing id nor one very long document
fills a group. Groups depend on the tokens alone. Pieces are taken from
the longest down. A piece goes into the open bin that it fills best; where none
has room, a bin of the length with the least cost per token is opened. Every
permitted length is tried as the largest to open by choice, and the cheapest
outcome kept; last, each bin shrinks to the least-cost length that holds it.

Defined results: a document longer than the longest length is cut into pieces,
all but the last full; a null or negative length counts 0, and every document
has one end token more; ties go by id, then piece; rows with equal or null ids
are packed each on its own; an empty table gives no bin. Extra columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm._session import cut, documents
from pagewright.llm.mixing import n_words

LENGTHS = (512, 1024, 2048, 4096, 8192)
GROUP_TOKENS = 1 << 20


def cost(length: int) -> float:
    """What a sequence costs: its tokens, attention over it, and a share for the sequence itself."""
    return 64 + length + length * length / 32768


def best_fit(sizes: Sequence[int], lengths: Sequence[int], chosen: int) -> tuple[list[int], list[int], list[int]]:
    """Bin of each piece (in the order given), and the opened length and the use of each bin.

    ``chosen``: no longer length is opened unless the piece needs it.
    """
    open_bins: dict[int, list[int]] = defaultdict(list)
    rooms: list[int] = []  # the distinct rooms of open bins, ascending
    bins, opened, used = [], [], []
    for size in sizes:
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            bin_ = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(at)
        else:
            fits = [x for x in lengths if x >= size]
            room = min([x for x in fits if x <= chosen] or fits[:1], key=lambda x: (cost(x) / x, -x))
            bin_ = len(opened)
            opened.append(room), used.append(0)
        bins.append(bin_)
        used[bin_] += size
        room -= size
        if room:
            if not open_bins[room]:
                insort(rooms, room)
            open_bins[room].append(bin_)
    return bins, opened, used


def shrunk(use: int, lengths: Sequence[int]) -> int:
    return min((x for x in lengths if x >= use), key=cost)


def pack_group(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """The cheapest outcome: bin of each piece, final length and use of each bin."""
    best = None
    for chosen in lengths:
        bins, _, used = best_fit(sizes, lengths, chosen)
        final = [shrunk(u, lengths) for u in used]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = total, bins, final, used
    return best[1:]


_RESULT = "bin_id long, capacity int, bin_used int, doc_id long, piece int, start long, length int, offset int"


def _pack(lengths: tuple[int, ...]) -> Callable:
    longest = max(lengths)

    def run(table: pa.Table) -> pa.Table:
        group = table["grp"][0].as_py()
        n, first, last = (np.asarray(table[c].combine_chunks()) for c in ("n", "first", "last"))
        ids = np.asarray(table["doc_id"].fill_null(np.iinfo(np.int64).min))
        held = last - first
        doc = np.repeat(np.arange(len(n)), held)
        item = np.arange(len(doc)) - np.repeat(np.cumsum(held) - held, held) + first[doc]
        piece = item % -(-n[doc] // longest)  # of whichever of the equal rows
        size = np.minimum(n[doc] - piece * longest, longest)
        order = np.lexsort((piece, ids[doc], -size))
        doc, piece, size = doc[order], piece[order], size[order]
        bins, final, used = map(np.array, pack_group(size.tolist(), lengths))
        by_bin = np.argsort(bins, kind="stable")
        doc, piece, size, bins = doc[by_bin], piece[by_bin], size[by_bin], bins[by_bin]
        total = np.cumsum(size) - size
        offset = total - total[np.searchsorted(bins, bins)]
        return pa.table({
            "bin_id": pa.array((np.int64(group) << 32) + bins, pa.int64()), "capacity": pa.array(final[bins], pa.int32()), "bin_used": pa.array(used[bins], pa.int32()),
            "doc_id": table["doc_id"].combine_chunks().take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(piece * longest, pa.int64()), "length": pa.array(size, pa.int32()), "offset": pa.array(offset, pa.int32()),
        })

    return run


def pack(docs: DataFrame, tokens: str, *, lengths: Sequence[int] = LENGTHS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row for each piece of each of ``docs`` (doc_id long, tokens): its bin and where it lies there."""
    longest = max(lengths)
    n = (F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)) + 1).cast("long")
    rows = cut(docs.select("doc_id", n.alias("n")).groupBy("doc_id", "n").agg(F.count("*").alias("times")))
    total = rows.agg(F.sum(F.col("n") * F.col("times"))).first()[0] or 0
    groups = max(1, -(-int(total) // group_tokens))
    # The pieces of equal rows, one row's after another's, in lots of about a quarter of a group.
    lot = max(1, group_tokens // (4 * longest))
    items = F.col("times") * F.ceil(F.col("n") / longest)
    lots = rows.select("doc_id", "n", items.alias("items"), F.explode(F.sequence(F.lit(0).cast("long"), items - 1, F.lit(lot).cast("long"))).alias("first"))
    dealt = lots.select("doc_id", "n", "first", F.least(F.col("first") + lot, "items").alias("last"), F.pmod(F.xxhash64("doc_id", "n", "first"), F.lit(groups)).alias("grp"))
    return dealt.groupBy("grp").applyInArrow(_pack(tuple(sorted(lengths))), _RESULT)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir).select("doc_id", n_words(F.col("text")).alias("n_tokens")), "n_tokens")
