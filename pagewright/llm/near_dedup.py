"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A sketch has ``COORDINATES`` places. Rounds of hashed bin placement throw every
shingle into one bin a round; the first rounds choose the bin at random and the
last ones give each bin its own round, so every place fills, whatever the size
of the set. Sets of similarity J agree in a place with probability J, with
concentration bounds like those of independent permutations.

Texts with equal shingle sets are one class from the start. Classes that agree
in a whole band are candidates. In each bucket all are first compared with the
smallest, its pivot (a star, not all pairs). Where these links leave a pivot's
group in several components, members of different ones are compared if they
share a shingle early enough in a common ranking and bitmaps do not rule them
out (prefix, position and bitmap filters lose no pair at the threshold). Every
link is confirmed
on the two full sets, so results are exact but for pairs that no band catches:
at similarity 0.8 a pair is missed with probability (1 - 0.8**4)**25 < 2e-6.
Sets hold 64-bit hashes: two shingles of a corpus of n distinct ones are taken
for one with probability below n / 2**64 each, and sets are told apart by 128 bits.

Defined results: a null or empty text, or one without a word, has no shingle,
is linked with nothing and is its own component; a text of fewer words than a
shingle is one shingle; rows that repeat an id count as one document with
several texts; a row with a null id gets the component of its class if that has
rows with ids and else null, and is kept in the latter case only, so copies among
rows without ids are all kept unless ``keyed`` gives them keys; very long texts are used
whole; an empty table gives an empty result. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm._graph import components
from pagewright.llm._session import cut, cut_pairs, documents
from pagewright.llm._text import LOWER, Words, _U, buffers, chunks, mix

ROWS, BANDS = 4, 25
COORDINATES = ROWS * BANDS
_TURNS = np.array([mix(np.array([i + 1], np.uint64) * _U(0x9E3779B97F4A7C15))[0] for i in range(2 * COORDINATES)])


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h = words.hash
    n = len(words.first) - 1
    rolled = np.zeros(len(h), np.uint64)
    if len(h) >= size:
        for k in range(size):
            rolled[: len(h) - size + 1] += mix(h[k : len(h) - size + 1 + k] + _U(k)) * _U(2 * k + 3)
    rolled = mix(rolled)
    out = []
    for d in range(n):
        a, b = words.first[d], words.first[d + 1]
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:  # the whole sequence, told from a shingle by its length
            whole = h[a:b] * (np.arange(b - a, dtype=np.uint64) * _U(2) + _U(1))
            out.append(mix(whole.sum(dtype=np.uint64, keepdims=True) + _U((int(b - a) * 0xA24BAED4963EE407) & (2**64 - 1))))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Fast similarity sketches (sets x COORDINATES); a smaller value beats a later round's."""
    n, t = len(sets), COORDINATES
    full = _U(2**64 - 1)
    sketch = np.full((n, t), full)
    open_sets = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    for turn in range(2 * t):
        if not len(open_sets):
            break
        values = np.concatenate([sets[i] for i in open_sets])
        owner = np.repeat(open_sets, [len(sets[i]) for i in open_sets])
        x = mix(values ^ _TURNS[turn])
        place = ((x >> _U(32)) * _U(t) >> _U(32)).astype(np.int64) if turn < t else np.full(len(x), turn - t)
        rank = (_U(turn) << _U(48)) | (mix(x) >> _U(16))
        np.minimum.at(sketch.reshape(-1), owner * t + place, rank)
        open_sets = open_sets[(sketch[open_sets] == full).any(axis=1)]
    return sketch


def _sketch(size: int) -> Callable:
    spread = np.arange(ROWS, dtype=np.uint64) * _U(2) + _U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets, _ = buffers(part.column(1))
                sets = shingle_sets(Words(LOWER[data], offsets), size)
                sketch = mix(sketches(sets)).reshape(len(sets), BANDS, ROWS)
                bands = mix((sketch * spread).sum(axis=2, dtype=np.uint64) ^ (np.arange(BANDS, dtype=np.uint64) << _U(56))).astype(np.int64)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(bands.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), lists], ["doc_id", "n_shingles", "digest", "bands"])

    return run


def _set_pairs(part: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The two full sets of each row with text_a and text_b; a pivot's text comes again and again and is read once."""
    column_b = part.column(part.schema.get_field_index("text_b")).dictionary_encode()
    sets = []
    for column in (part.column(part.schema.get_field_index("text_a")), column_b.dictionary):
        data, offsets, _ = buffers(column)
        sets.append(shingle_sets(Words(LOWER[data], offsets), size))
    of = np.asarray(column_b.indices)
    for i in range(part.num_rows):
        yield sets[0][i], sets[1][of[i]]


def _verify(size: int, percent: int) -> Callable:
    """Of pairs with their texts, those whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text_a"):
                good = []
                for x, y in _set_pairs(part, size):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                keep = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])

    return run


_BITS = 256


def _bitmap(shingles: np.ndarray) -> np.ndarray:
    bits = np.zeros(_BITS, np.uint8)
    bits[(shingles >> _U(20)).astype(np.int64) % _BITS] = 1
    return np.packbits(bits).view(np.int64)


def _prefixes(size: int, percent: int) -> Callable:
    """What decides whether text a can be like another text of pivot b's group.

    All shingles are ranked, those outside the pivot's set first. Two texts that
    are similar enough share a shingle among the first (100 - percent) % of each.
    Bitmaps of the shingles outside the pivot and of the pivot's that are missing
    bound what two texts share from above.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text_a"):
                n, out, pivot, first, maps = [], [], [], [], ([], [])
                for x, y in _set_pairs(part, size):
                    inside = np.isin(x, y, assume_unique=True)
                    ranked = x[np.argsort(inside, kind="stable")]
                    n.append(len(x)), out.append(len(x) - int(inside.sum())), pivot.append(len(y))
                    first.append(ranked[: len(x) - -(-percent * len(x) // 100) + 1].astype(np.int64))
                    maps[0].append(_bitmap(x[~inside])), maps[1].append(_bitmap(np.setdiff1d(y, x, assume_unique=True)))
                numbers = [pa.array(c, pa.int32()) for c in (n, out, pivot)]
                lists = [pa.array(c, pa.list_(pa.int64())) for c in (*maps, first)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *numbers, *lists], ["a", "b", "label", "n", "out", "pivot", "extra", "missing", "first"])

    return run


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b and more) with text_a and text_b."""
    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select(*pairs.columns, "text_a", "text_b")


def _links(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    return cut_pairs(_with_texts(pairs, texts).mapInArrow(_verify(size, percent), "a long, b long").distinct())


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Star pairs with the component of a."""
    return pairs.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("label", F.coalesce("label", "a"))


def _unjoined(tried: DataFrame, labels: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Candidate pairs among members of a pivot's group that are in different components.

    Instead of all pairs of a group, only those that share a shingle early
    enough in the ranking of both to be able to reach the threshold. The texts
    are read once, and a posting is a few numbers.
    """
    placed = _labelled(tried, labels)
    # Sums are cut before they are joined: a join of two plain shuffles is one that Spark can split where a key is hot.
    open_groups = placed.groupBy("b").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("b")
    open_pairs = cut_pairs(placed.join(cut_pairs(open_groups), "b").select("a", "b", "label"))
    member = "a long, b long, label long, n int, out int, pivot int, extra array<long>, missing array<long>, first array<long>"
    members = cut_pairs(_with_texts(open_pairs, texts).mapInArrow(_prefixes(size, percent), member))
    maps = [F.get(c, F.lit(i)).alias(f"{c}{i}") for c in ("extra", "missing") for i in range(_BITS // 64)]
    rows = members.select("a", "b", "label", "n", "out", "pivot", *maps, F.posexplode("first").alias("place", "shingle"))
    # A shingle that members of one component only have cannot join two.
    by_label = rows.groupBy("b", "shingle", "label").agg(F.count("*").alias("members"))
    shared = by_label.groupBy("b", "shingle").agg(F.max_by("label", F.struct("members", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    rows = cut_pairs(rows.join(cut_pairs(shared), ["b", "shingle"]))
    one, two = (rows.select("b", "shingle", *(F.col(c).alias(f"{c}_{x}") for c in rows.columns if c not in ("b", "shingle", "main")), *([F.col("main")] if x == "x" else [])) for x in "xy")
    one = one.where(F.col("label_x") != F.col("main"))  # of the largest component's members none meets another
    once = (F.col("label_y") == F.col("main")) | (F.col("a_x") > F.col("a_y"))
    # At most this many are shared if this is the first shared one: the rest of what lies outside the pivot, and inside it.
    left = lambda x: F.greatest(F.col(f"out_{x}") - F.col(f"place_{x}"), F.lit(0))
    within = lambda x: F.col(f"n_{x}") - F.greatest(F.col(f"out_{x}"), F.col(f"place_{x}"))
    reach = F.least(left("x"), left("y")) + F.least(within("x"), within("y"))
    # And at most this many in any case.
    bits = lambda body: sum((F.bit_count(body(i)) for i in range(_BITS // 64)), F.lit(0))
    both_miss = bits(lambda i: F.col(f"missing{i}_x").bitwiseOR(F.col(f"missing{i}_y")))
    own = lambda x, y: F.col(f"out_{x}") - bits(lambda i: F.col(f"extra{i}_{x}").bitwiseAND(F.bitwise_not(F.col(f"extra{i}_{y}"))))
    bound = F.col("pivot_x") - both_miss + F.least(own("x", "y"), own("y", "x"))
    enough = (100 + percent) * F.least(reach, bound) >= percent * (F.col("n_x") + F.col("n_y"))
    pairs = one.join(two, ["b", "shingle"]).where(F.col("label_x") != F.col("label_y")).where(once & enough)
    return cut_pairs(pairs.select(F.greatest("a_x", "a_y").alias("a"), F.least("a_x", "a_y").alias("b")).distinct())


def near_duplicates(docs: DataFrame, *, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id long, text)."""
    docs = docs.select("doc_id", "text")
    rows = cut(docs.mapInArrow(_sketch(shingle_words), "doc_id long, n_shingles long, digest binary, bands array<long>"))
    with_id = rows.where("digest is not null and doc_id is not null")
    classes = cut(with_id.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    members = classes.select("rep", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot <> last").select("band", "pivot")
    tried = cut_pairs(members.join(cut_pairs(buckets), "band").where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct())
    ids = tried.select(F.col("a").alias("doc_id")).unionByName(tried.select(F.col("b").alias("doc_id"))).distinct()
    texts = cut(docs.join(ids, "doc_id", "left_semi"))  # only texts of candidates are carried on
    links = _links(tried, texts, shingle_words, percent)
    more = _unjoined(tried, components(links), texts, shingle_words, percent)
    classes = classes.drop("bands")
    several = with_id.groupBy("doc_id").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).where("one <> other").select("doc_id")
    same_id = with_id.join(several, "doc_id").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = components(links.unionByName(_links(more, texts, shingle_words, percent)).unionByName(same_id))

    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component"))
    out = rows.drop("bands").join(named, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


#: Ids that several rows have (or none), up to which they are sent to all tasks instead of shuffling documents.
MOST_SENT = 100_000


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row) of ``docs``, with keys in the place of ids, so that no two rows have one key and none is null.

    An id that one row has is its key. Rows that share an id or have none are told
    apart by their texts: a key far below zero is fixed by id and text, and of
    rows that have both in common the one of the least hash stands for all.
    """
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    shared = cut_pairs(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("shared_id")))
    n = shared.count()
    if not n:
        return rows.select("doc_id", "text", "row")
    side = F.broadcast(shared) if n <= MOST_SENT else shared
    same = F.col("doc_id").eqNullSafe(F.col("shared_id"))
    key = F.lit(-(2**63)) + F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")), F.col("text").isNull()), 8)
    told = rows.join(side, same, "left_semi").withColumn("key", key)
    one = told.groupBy("key").agg(F.min_by(F.struct("text", "row"), F.xxhash64("row")).alias("one")).select(F.col("key").alias("doc_id"), "one.text", "one.row")
    return rows.join(side, same, "left_anti").select("doc_id", "text", "row").unionByName(cut(one))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle_words=4)
