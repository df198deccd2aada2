"""Benchmark decontamination by a generalised suffix automaton.

The words of all benchmark items make one suffix automaton (one for each block
of about ``BLOCK_WORDS`` words). The words of a document are streamed through it;
it knows at each word the longest match that ends there. Where that is ``window``
words or longer the last ``window`` words are a window of some item, and the
state tells of which; an item with fewer words is found where the match ends with
the whole of it. Words inside windows are hit; ``remove`` takes out the spans of
hit words that exceed a length, and documents that exceed a share of hit words.

Items are cut into overlapping pieces, dealt to blocks by hash and built in tasks,
so the benchmark may be of any size: automata go to the workers by broadcasts of
at most ``PASS_BYTES`` of them, one pass over the documents each.

Words are lower-cased (A-Z) and compared by a 64-bit hash; those of every hit are
then compared letter by letter, so hashes decide nothing alone.

Defined results: null and empty texts have no words, items without words are met
by nothing; an item's repeats count once for each id, an id's repeats once, and
an item without an id makes words hit but is not listed; equal texts of documents
get equal results, each row its own; a document of any length is streamed whole,
in bounded memory besides a small multiple of its own size; an empty table of
documents gives an empty result, and without items nothing is hit. Extra columns
are ignored by ``find`` and kept by ``remove``.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm._automaton import NONE, Builder, stream
from pagewright.llm._session import cut, documents
from pagewright.llm._text import Words, buffers, chunks, span_hashes

WINDOW = 10
#: Words of one automaton, on average, and bytes of automata that a worker holds in one pass.
BLOCK_WORDS, PASS_BYTES = 1 << 19, 1 << 27
#: Words of a piece of an item.
PIECE_WORDS = 1 << 14

_BYTES = np.arange(256, dtype=np.uint8)
#: Lower case, and a space for every byte that is in no word: words are digits, letters a-z and all beyond ASCII.
TABLE = np.where(((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128), _BYTES, 32).astype(np.uint8)
TABLE[65:91] = np.arange(97, 123)
_WORD = re.compile(rb"[^\x20]+")

_SPANS = "spans array<struct<first:int,last:int,start:int,end:int>>"
FOUND = f"n_words long, longest int, {_SPANS}, items array<string>"


def words_of_text(text: str | None) -> list[bytes]:
    return _WORD.findall(TABLE[np.frombuffer((text or "").encode(), np.uint8)].tobytes())


def _pieces(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, whole, pieces = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of_text(text)
                step = PIECE_WORDS - window + 1
                for at in range(0, max(1, len(words) - window + 1), step) if words else ():
                    ids.append(i), whole.append(len(words) < window), pieces.append(b" ".join(words[at : at + PIECE_WORDS]))
            yield pa.record_batch({"item_id": pa.array(ids, pa.string()), "short": pa.array(whole, pa.bool_()), "piece": pa.array(pieces, pa.binary())})

    return run


def _build(window: int) -> Callable:
    """All pieces of a block as one pickled automaton."""

    def run(rows: pa.Table) -> pa.Table:
        names: dict[bytes, set[str]] = defaultdict(set)
        short: dict[bytes, bool] = {}
        for piece, i, is_short in zip(rows["piece"].to_pylist(), rows["item_id"].to_pylist(), rows["short"].to_pylist(), strict=True):
            names[piece] |= {i} - {None}
            short[piece] = is_short
        texts = sorted(names)
        vocabulary = sorted({w for t in texts for w in t.split()})
        number = {w: k for k, w in enumerate(vocabulary)}
        sequences = [[number[w] for w in t.split()] for t in texts]
        builder = Builder()
        for s in sequences:
            builder.add(s)
        own = builder.freeze(len(vocabulary))
        length, link = own["length"], own["link"]
        by_length = np.argsort(length, kind="stable")
        # The state among a state and its links that holds the window, and the nearest that is a short item.
        full = np.full(len(length), NONE, np.int32)
        for s in by_length:
            if length[s] >= window:
                full[s] = full[link[s]] if length[link[s]] >= window else s
        classes: dict[int, set[int]] = defaultdict(set)
        ends = np.zeros(len(length), bool)
        for c, (text, tokens) in enumerate(zip(texts, sequences, strict=True)):
            states = builder.walk(tokens)
            if short[text]:
                ends[states[-1]] = True
                classes[states[-1]].add(c)
            else:
                for s in states[window - 1 :]:
                    classes[int(full[s])].add(c)
        near = np.full(len(length), NONE, np.int32)
        for s in by_length:
            near[s] = s if ends[s] else near[link[s]] if link[s] != NONE else NONE
        data = b"".join(vocabulary)
        stop = np.cumsum([len(w) for w in vocabulary], dtype=np.int64)
        hashes = span_hashes(np.frombuffer(data, np.uint8), np.concatenate([[0], stop[:-1]]), stop)
        order = np.argsort(hashes)
        shortest = min([window, *(len(s) for s, t in zip(sequences, texts, strict=True) if short[t])])
        own |= {"full": full, "near": near, "hashes": hashes[order], "number": order.astype(np.int32)}
        made = {"arrays": own, "vocabulary": vocabulary, "classes": {s: sorted(c) for s, c in classes.items()}, "ids": [sorted(names[t]) for t in texts], "shortest": shortest}
        return pa.table({"automaton": pa.array([pickle.dumps(made)], pa.binary())})

    return run


def automata(items: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(automaton binary): one row a block of ``items`` (item_id, text)."""
    pieces = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text")).mapInArrow(_pieces(window), "item_id string, short boolean, piece binary")
    letters = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-letters // (6 * block_words)))  # about six bytes a word
    block = F.pmod(F.xxhash64("piece"), F.lit(blocks))
    return pieces.groupBy(block.alias("block")).applyInArrow(_build(window), "automaton binary")


def _hits(made: dict, tokens: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(last word, state, words) of each window met by words of these numbers (NONE: in no item); and the longest match, by word."""
    own = made["arrays"]
    known = tokens != NONE
    edge = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= made["shortest"]
    state, held = stream(own, tokens, starts[long], ends[long])
    at = np.flatnonzero(held >= window)
    found = [(at, own["full"][state[at]], np.full(len(at), window, np.int32))]
    at = np.flatnonzero(held)
    now = np.where(held[at] == own["length"][state[at]], state[at], own["link"][state[at]])
    while len(at):
        now = own["near"][now]
        at, now = at[now != NONE], now[now != NONE]
        found.append((at, now, own["length"][now]))
        now = own["link"][now]
    return (*(np.concatenate(x) for x in zip(*found, strict=True)), held)


def _numbers(made: dict, hashes: np.ndarray) -> np.ndarray:
    own = made["arrays"]
    if not len(own["hashes"]):
        return np.full(len(hashes), NONE, np.int32)
    at = np.minimum(np.searchsorted(own["hashes"], hashes), len(own["hashes"]) - 1)
    return np.where(own["hashes"][at] == hashes, own["number"][at], NONE)


def _met(made: dict, data: np.ndarray, words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_hits`` of all texts in ``data``, every word of which is what it was taken for."""
    tokens = _numbers(made, words.hash)
    inner = np.ones(len(tokens), bool)  # no match goes on from one text to the next
    inner[words.first[(words.first > 0) & (words.first < len(tokens))]] = False
    spaced = np.full(len(tokens) + int((~inner).sum()), NONE, np.int64)
    place = np.arange(len(tokens)) + np.cumsum(~inner)
    while True:
        spaced[place] = tokens
        last, state, size, held = _hits(made, spaced, window)
        back = np.searchsorted(place, last)
        covered = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(covered, back - size + 1, 1)
        np.add.at(covered, back + 1, -1)
        hit = np.flatnonzero(np.cumsum(covered[:-1]))
        wrong = [w for w in hit if data[words.start[w] : words.end[w]].tobytes() != made["vocabulary"][tokens[w]]]
        if not wrong:
            return back, state, size, held[place]
        tokens[wrong] = NONE


def _find(passed: Broadcast, window: int, first: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [pickle.loads(x) for x in passed.value]
        for batch in batches:
            for part in chunks(batch, "text"):
                yield _searched(part, blocks, window, first)

    return run


def _searched(part: pa.RecordBatch, blocks: list[dict], window: int, first: bool) -> pa.RecordBatch:
    raw, offsets, _ = buffers(part.column(part.schema.get_field_index("text")))
    data = TABLE[raw]
    words = Words(data, offsets)
    n = part.num_rows
    covered = np.zeros(len(words.hash) + 1, np.int64)
    longest = np.zeros(n, np.int32)
    names: list[set[str]] = [set() for _ in range(n)]
    if not first:
        before = part.column(part.schema.get_field_index("found"))
        for d, x in enumerate(before.to_pylist()):
            longest[d] = x["longest"]
            names[d] |= set(x["items"])
            for s in x["spans"]:
                covered[words.first[d] + s["first"]] += 1
                covered[words.first[d] + s["last"]] -= 1
    for made in blocks:
        last, state, size, held = _met(made, data, words, window)
        np.add.at(covered, last - size + 1, 1)
        np.add.at(covered, last + 1, -1)
        np.maximum.at(longest, words.doc, held)
        for d, s in np.unique(np.stack([words.doc[last], state]), axis=1).T if len(last) else ():
            for c in made["classes"][int(s)]:
                names[d].update(made["ids"][c])
    inside = np.cumsum(covered[:-1]) > 0
    begins = inside.copy()
    begins[1:] &= ~(inside[:-1] & (words.doc[1:] == words.doc[:-1]))
    stops = inside.copy()
    stops[:-1] &= ~(inside[1:] & (words.doc[1:] == words.doc[:-1]))
    spans: list[list[dict[str, int]]] = [[] for _ in range(n)]
    lead = None
    for a, b in zip(np.flatnonzero(begins), np.flatnonzero(stops), strict=True):
        d = int(words.doc[a])
        if lead is None or lead[0] != d:
            lead = (d, np.concatenate([[0], np.cumsum((raw[offsets[d] : offsets[d + 1]] & 0xC0) != 0x80)]))
        point = lambda byte: int(lead[1][byte - offsets[d]])  # noqa: E731, B023
        own = int(words.first[d])
        spans[d].append({"first": int(a) - own, "last": int(b) + 1 - own, "start": point(words.start[a]), "end": point(words.end[b])})
    kind = pa.struct([("n_words", pa.int64()), ("longest", pa.int32()), ("spans", pa.list_(pa.struct([(x, pa.int32()) for x in ("first", "last", "start", "end")]))), ("items", pa.list_(pa.string()))])
    found = pa.array([{"n_words": int(w), "longest": int(m), "spans": s, "items": sorted(i)} for w, m, s, i in zip(np.diff(words.first), longest, spans, names, strict=True)], kind)
    keep = [i for i, f in enumerate(part.schema) if f.name != "found"]
    return pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), found], [*(part.schema.field(i).name for i in keep), "found"])


def find(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` (text and others) with ``found``: n_words, longest, spans and items.

    Spans are maximal runs of hit words: words ``first`` to before ``last``, code
    points ``start`` to before ``end``. ``longest`` is the longest match, known
    where at least as many words as the shortest window are known one after the other.
    """
    spark = docs.sparkSession
    made = cut(automata(items, window=window, block_words=block_words).withColumn("id", F.monotonically_increasing_id()))
    passes: list[list[int]] = [[]]
    held = 0
    for row in made.select("id", F.length("automaton").alias("size")).orderBy("id").toLocalIterator():
        if passes[-1] and held + row["size"] > pass_bytes:
            passes.append([])
            held = 0
        passes[-1].append(row["id"])
        held += row["size"]
    docs = docs.drop("found")
    for i, ids in enumerate(passes):
        blobs = [bytes(r[0]) for r in made.where(F.col("id").isin(ids)).select("automaton").collect()]
        schema = T.StructType([*(f for f in docs.schema.fields if f.name != "found"), *T.StructType.fromDDL(f"found struct<{_colon(FOUND)}>").fields])
        docs = docs.mapInArrow(_find(spark.sparkContext.broadcast(blobs), window, i == 0), schema)
    return docs


def _colon(ddl: str) -> str:
    """Fields of a table as those of a struct."""
    return re.sub(r"(\w+) (long|int|array<)", r"\1:\2", ddl)


def n_hit(found: Column) -> Column:
    """Words inside any window."""
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])


def remove(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, most_words: int = WINDOW - 1, most_share: float = 0.5) -> DataFrame:
    """``docs`` without spans of more than ``most_words`` hit words, and without documents of which more than ``most_share`` of the words are hit."""
    own = docs.select(F.struct("*").alias("row"), F.col("text") if "text" in docs.columns else F.lit(None).cast("string").alias("text"))
    met = find(own, items, window=window).where(n_hit(F.col("found")) <= F.col("found.n_words") * most_share)
    gone = F.filter("found.spans", lambda s: s["last"] - s["first"] > most_words)
    ends = F.concat(F.array(F.lit(0)), F.transform(gone, lambda s: s["end"]))
    starts = F.concat(F.transform(gone, lambda s: s["start"]), F.array(F.char_length("text")))
    kept = F.array_join(F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda x: F.substring(F.col("text"), x["a"] + 1, x["b"] - x["a"])), "")
    text = F.when(F.size(gone) > 0, kept).otherwise(F.col("text"))
    return met.select(*(text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    met = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = n_hit(F.col("found"))
    names = F.col("found.items")
    return met.select(
        "doc_id", "found.n_words", hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(names), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
s AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
items AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS words FROM s),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
grams AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS words FROM p, (SELECT DISTINCT k FROM items) WHERE i + k - 1 <= len(w)),
met AS (SELECT r, i, k, item_id FROM grams JOIN items USING (k, words)),
hit AS (SELECT r, count(DISTINCT word) AS n FROM (SELECT r, unnest(range(i, i + k)) AS word FROM met) GROUP BY r),
names AS (SELECT r, count(*) AS n, string_agg(name, ',' ORDER BY name) AS list FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM met WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(names.n, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN names USING (r)
"""
