"""Merkle manifest of a data set: a root, and a proof for every row.

Every group (source) of leaves is a tree of fixed fanout, and the groups' roots
are the leaves of one more. Leaves are numbered within their group by one sort by
ranges and the sums of what lies in the ranges before, so no group needs to fit
in a task. A number tells the aligned block of ``fanout ** height`` leaves; a
block's digests are one contiguous matrix of 64-byte hex rows that is hashed
level by level, each run of ``fanout`` rows being one slice of it; siblings of a
node are found by index arithmetic. Blocks' roots are the leaves of the next
round, until each group has one; paths are then handed down, round by round.

Defined results: nulls are part of a leaf; leaves of a group ascend by key, null
first, equal keys by their leaf, so equal rows stand next to each other; a null
group comes first; a group of one leaf is its own root, as is a single group's;
texts are hashed whole; an empty table gives an empty manifest whose root is
None. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm._session import cut, documents, partitions

FANOUT, HEIGHT = 3, 6
_HEX = 64


def digest_of(*fields: Column) -> Column:
    """A row's leaf: SHA-256 (binary) of its fields, each ``-`` if null, else UTF-8 byte count, ``:`` and value."""
    written = [F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"))) for f in fields]
    return F.unhex(F.sha2(F.concat(*written), 256))


def _hash(text: bytes) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


def levels_of(leaves: np.ndarray, fanout: int, height: int, alone: bool) -> list[np.ndarray]:
    """The digest matrices (rows of 64 hex bytes) of a block, leaves first.

    A block that is a whole tree ends at its root, any other after ``height`` levels.
    """
    out = [np.ascontiguousarray(leaves)]
    while len(out[-1]) > 1 if alone else len(out) <= height:
        rows = out[-1]
        full = len(rows) // fanout
        runs = [*rows[: full * fanout].reshape(full, fanout * _HEX), *([rows[full * fanout :].reshape(-1)] if len(rows) % fanout else [])]
        out.append(np.frombuffer(b"".join(_hash(r.data) for r in runs), np.uint8).reshape(-1, _HEX))
    return out


def path_of(levels: list[np.ndarray], at: int, fanout: int) -> bytes:
    """What joins a leaf to its block's root: at each level its place in its run, the run's length (two hex digits each), then the others' digests."""
    out = []
    for rows in levels[:-1]:
        first = at // fanout * fanout
        run = rows[first : first + fanout]
        place = at - first
        out.append(b"%02x%02x" % (place, len(run)) + run[:place].tobytes() + run[place + 1 :].tobytes())
        at //= fanout
    return b"".join(out)


def steps(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The digests before and behind the own one, level by level."""
    at = 0
    while at < len(path):
        place, n = int(path[at : at + 2], 16), int(path[at + 2 : at + 4], 16)
        middle, end = at + 4 + place * _HEX, at + 4 + (n - 1) * _HEX
        yield path[at + 4 : middle], path[middle:end]
        at = end


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root (hex) that a leaf (hex) and its path give."""
    for before, behind in steps(path):
        leaf = _hash(before + leaf + behind)
    return leaf


def proof_of(path: bytes) -> bytes:
    """Digest of all siblings on a path, from the leaf up."""
    return _hash(b"".join(x for step in steps(path) for x in step))


def _hexed(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Digest rows of a binary column of 32 bytes each."""
    return np.frombuffer(b"".join(x.hex().encode() for x in column.to_pylist()), np.uint8).reshape(-1, _HEX)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (grp, ...) with ``place`` within the group, by ``order`` with nulls first, and ``total``, the group's size."""
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    at = cut(dealt.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = at.groupBy("grp", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("grp").alias("in_grp"), "part", (before - F.col("first")).alias("shift"), F.sum("n").over(group).alias("total"))
    met = at.withColumn("own", part).join(sizes, (F.col("own") == F.col("part")) & F.col("grp").eqNullSafe(F.col("in_grp")))
    return met.withColumn("place", F.col("at") + F.col("shift")).drop("at", "own", "part", "shift", "in_grp")


def _build(fanout: int, height: int) -> Callable:
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        total = rows["total"][0].as_py()
        alone = total <= fanout**height
        root = levels_of(_hexed(rows["leaf"]), fanout, height, alone)[-1]
        assert len(root) == 1
        fixed = lambda name: b"".join(x or bytes(32) for x in rows[name].to_pylist())
        return pa.table(
            {
                "grp": pa.array([key[0].as_py()], rows.schema.field("grp").type), "block": pa.array([key[1].as_py()], pa.int64()), "total": pa.array([total], pa.int64()),
                "keys": pa.array([rows["key"].to_pylist()], pa.list_(rows.schema.field("key").type)), "leaves": pa.array([fixed("leaf")], pa.binary()), "changed": pa.array([fixed("changed")], pa.binary()),
                "root": pa.array([bytes.fromhex(root.tobytes().decode())], pa.binary()),
            }
        )

    return run


def blocks_of(leaves: DataFrame, fanout: int, height: int) -> list[DataFrame]:
    """The blocks of every round over leaves (grp, key, leaf, changed, place, total)."""
    size = fanout**height
    most = leaves.agg(F.max("total")).first()[0] or 0
    rounds = []
    while True:
        kinds = dict(leaves.dtypes)
        block = F.floor(F.col("place") / size).cast("long")
        schema = f"grp {kinds['grp']}, block long, total long, keys array<{kinds['key']}>, leaves binary, changed binary, root binary"
        rounds.append(cut(leaves.withColumn("block", block).groupBy("grp", "block").applyInArrow(_build(fanout, height), schema)))
        if most <= size:
            return rounds
        most = -(-most // size)
        parents = rounds[-1].where(F.col("total") > size)
        leaves = parents.select("grp", F.col("block").alias("key"), F.col("root").alias("leaf"), F.lit(None).cast("binary").alias("changed"), F.col("block").alias("place"), F.ceil(F.col("total") / size).alias("total"))


def roots_of(rounds: list[DataFrame], fanout: int, height: int) -> DataFrame:
    """(grp, root) of each tree."""
    alone = [r.where(F.col("total") <= fanout**height).select("grp", "root") for r in rounds]
    out = alone[0]
    for other in alone[1:]:
        out = out.unionByName(other)
    return out


def _unfold(fanout: int, height: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                keys = row.column("keys").flatten()
                leaves = row.column("leaves")[0].as_py()
                n = len(leaves) // 32
                total = row.column("total")[0].as_py()
                above = row.column("above")[0].as_py() or b""
                rows = np.frombuffer(leaves.hex().encode(), np.uint8).reshape(n, _HEX)
                levels = levels_of(rows, fanout, height, total <= fanout**height)
                changed = row.column("changed")[0].as_py()
                yield pa.record_batch(
                    {
                        "grp": pa.array(row.column("grp").to_pylist() * n, row.schema.field("grp").type), "key": keys,
                        "leaf": pa.array([leaves[32 * k : 32 * k + 32] for k in range(n)], pa.binary()),
                        "changed": pa.array([x if any(x := changed[32 * k : 32 * k + 32]) else None for k in range(n)], pa.binary()),
                        "path": pa.array([path_of(levels, k, fanout) + above for k in range(n)], pa.binary()),
                    }
                )

    return run


def unfolded(rounds: list[DataFrame], fanout: int, height: int, above: DataFrame | None = None) -> DataFrame:
    """(grp, key, leaf, changed, path) of each leaf of the first round; ``above`` (grp, path) is what lies over each tree."""
    size = fanout**height
    paths = None
    for rows in reversed(rounds):
        alone, inner = rows.where(F.col("total") <= size), rows.where(F.col("total") > size)
        nothing = F.lit(None).cast("binary").alias("above")
        if above is None:
            alone = alone.select("*", nothing)
        else:
            over = above.select(F.col("grp").alias("in_grp"), F.col("path").alias("above"))
            alone = alone.join(over, F.col("grp").eqNullSafe(F.col("in_grp"))).drop("in_grp")
        if paths is not None:
            over = paths.select(F.col("grp").alias("in_grp"), F.col("key").alias("in_block"), F.col("path").alias("above"))
            inner = inner.join(over, (F.col("block") == F.col("in_block")) & F.col("grp").eqNullSafe(F.col("in_grp"))).drop("in_grp", "in_block")
            alone = alone.unionByName(inner)
        kinds = dict(rows.dtypes)
        key = kinds["keys"].removeprefix("array<").removesuffix(">")
        paths = alone.drop("block", "root").mapInArrow(_unfold(fanout, height), f"grp {kinds['grp']}, key {key}, leaf binary, changed binary, path binary")
    return paths


@dataclass(frozen=True)
class Manifest:
    """``root`` in hex (None of nothing), ``subroots`` (grp, root), and of each leaf (grp, key, leaf, changed, path)."""

    root: str | None
    subroots: DataFrame
    leaves: DataFrame


def manifest(leaves: DataFrame, *, fanout: int = FANOUT, height: int = HEIGHT) -> Manifest:
    """Of rows (grp, key, leaf binary, changed binary or null); ``changed`` is carried along."""
    if not 2 <= fanout <= 255 or height < 1:
        raise ValueError("a fanout of 2 to 255 and a height of 1 at least")
    own = blocks_of(numbered(leaves, ["key", "leaf"]), fanout, height)
    subroots = roots_of(own, fanout, height)
    tops = subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("key"), F.col("root").alias("leaf"), F.lit(None).cast("binary").alias("changed"))
    over = blocks_of(numbered(tops, ["key"]), fanout, height)
    root = roots_of(over, fanout, height).first()
    above = unfolded(over, fanout, height).select(F.col("key").alias("grp"), "path")
    return Manifest(None if root is None else root["root"].hex(), subroots, unfolded(own, fanout, height, above))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column("path").to_pylist()
        seen = [(c or x).hex().encode() for x, c in zip(batch.column("leaf").to_pylist(), batch.column("changed").to_pylist(), strict=True)]
        yield pa.record_batch(
            {
                "grp": batch.column("grp"), "key": batch.column("key"), "leaf": pa.array([x.hex() for x in batch.column("leaf").to_pylist()], pa.string()),
                "proof_sha256": pa.array([proof_of(p).decode() for p in paths], pa.string()), "folded_root": pa.array([fold(x, p).decode() for x, p in zip(seen, paths, strict=True)], pa.string()),
            }
        )


def judged(made: Manifest) -> DataFrame:
    """(grp, key, leaf, proof_sha256, folded_root, verified) in hex: whether each leaf, the changed one where there is one, still leads to the root."""
    kinds = dict(made.leaves.dtypes)
    out = made.leaves.mapInArrow(_judge, f"grp {kinds['grp']}, key {kinds['key']}, leaf string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.lit(made.root))


def document_leaves(docs: DataFrame) -> DataFrame:
    """(grp, key, leaf, changed) of documents; where 2 divides the id's CRC-32, ``changed`` is the leaf without the text's newlines. A row without an id stays."""
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    other = digest_of(*rest, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    changes = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.col("text").contains("\n")
    return docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("key"), digest_of(*rest, F.col("text")).alias("leaf"), F.when(changes, other).alias("changed"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = manifest(document_leaves(documents(spark, sf_dir, spread=False)))
    sub = made.subroots.select(F.col("grp").alias("in_grp"), F.lower(F.hex("root")).alias("subroot"))
    rows = judged(made).join(sub, F.col("grp").eqNullSafe(F.col("in_grp")))
    return rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", F.lit(made.root).cast("string").alias("root"), "proof_sha256", "folded_root", "verified")


def _sql() -> str:
    """Both trees level by level, as far as a table of millions of rows goes."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    names = [
        "d AS (SELECT *, replace(text, chr(10), '') AS bare, coalesce(source, '') || CASE WHEN source IS NULL THEN '-' ELSE '+' END AS g FROM documents)",
        f"own AS (SELECT doc_id, source, g, {leaf('text')} AS h, {leaf('bare')} AS bare_h FROM d)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM own)",
    ]

    def tree(x: str, levels: int) -> None:
        for i in range(levels):
            run = f"PARTITION BY g, p // {FANOUT} ORDER BY p ROWS BETWEEN"
            names.append(
                f"{x}s{i} AS (SELECT g, p, n, h, p // {FANOUT} AS up, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,"
                f" CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r FROM {x}{i})"
            )
            names.append(f"{x}{i + 1} AS (SELECT g, up AS p, (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h FROM {x}s{i} GROUP BY g, up)")

    tree("a", 14)
    names.append("b0 AS (SELECT 0 AS g, a.g AS of, a.h, row_number() OVER (ORDER BY s.source NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM a14 a JOIN (SELECT DISTINCT g, source FROM own) s USING (g))")
    tree("b", 9)
    # CRC-32 of the decimal id: each character is taken in, then eight steps of a bit; only its last bit counts.
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, CAST(3988292384 AS BIGINT)) ELSE a // 2 END"
    even = f"coalesce(xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), lambda a, x: {step}), CAST(4294967295 AS BIGINT)) % 2 = 0, false)"
    names.append(f"w0 AS (SELECT a0.doc_id, a0.g, a0.h AS leaf, a0.p, b0.p AS bp, b0.h AS subroot, '' AS others, CASE WHEN {even} THEN a0.bare_h ELSE a0.h END AS f FROM a0 JOIN b0 ON b0.of = a0.g)")
    at = 0
    for x, levels in (("a", 14), ("b", 9)):
        for i in range(levels):
            own = "w.g = s.g AND w.p = s.p" if x == "a" else "w.bp = s.p"
            step = f"w.p // {FANOUT} AS p, w.bp" if x == "a" else f"w.p, w.bp // {FANOUT} AS bp"
            names.append(f"w{at + 1} AS (SELECT w.doc_id, w.g, w.leaf, {step}, w.subroot, w.others || s.l || s.r AS others, CASE WHEN s.n > 1 THEN sha256(s.l || w.f || s.r) ELSE w.f END AS f FROM w{at} w JOIN {x}s{i} s ON {own})")
            at += 1
    return "WITH " + ",\n".join(names) + f"\nSELECT doc_id, leaf, subroot, b9.h AS root, sha256(others) AS proof_sha256, f AS folded_root, f = b9.h AS verified FROM w{at}, b9"


OP11_SQL = _sql()
