"""Decontamination against comparing every window, and the automaton against plain strings."""

import hashlib
import random
import re

import numpy as np
import pytest

from pagewright.llm import _automaton, decontamination
from pagewright.llm._automaton import Builder, stream
from pagewright.llm.decontamination import find, n_hit, op13_decontamination, remove

FOLDER = "/root/testdata/sf0.001"
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=10):
    """For each text: (n_words, hit word places, item ids as strings)."""
    windows = []
    for i, text in items:
        w = words(text)
        k = min(window, len(w))
        windows += [(tuple(w[a : a + k]), i) for a in range(len(w) - k + 1) if k]
    sizes = {len(w) for w, _ in windows}
    by = {}
    for w, i in windows:
        by.setdefault(w, set()).add(i)
    out = []
    for text in docs:
        w, hit, ids = words(text), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if (found := by.get(tuple(w[a : a + k]))) is not None:
                    hit |= set(range(a, a + k))
                    ids |= {str(i) for i in found - {None}}
        out.append((len(w), sorted(hit), sorted(ids)))
    return out


def places(found):
    return [p for s in found["spans"] for p in range(s["first"], s["last"])]


@pytest.mark.parametrize("lane", [1, 3, 256])
def test_longest_matches(monkeypatch, lane):
    monkeypatch.setattr(_automaton, "LANE", lane)
    r = random.Random(lane)
    for case in range(30):
        k = r.choice([1, 2, 3, 6])
        own = [[r.randrange(k) for _ in range(r.randrange(1, 30))] for _ in range(r.randrange(1, 5))]
        builder = Builder()
        for s in own:
            builder.add(s)
        grams = {tuple(s[a:b]) for s in own for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
        read = [r.randrange(k) for _ in range(60)] + r.choice(own) + [r.randrange(k) for _ in range(5)]
        cuts = sorted(r.sample(range(len(read)), 3))
        starts, ends = np.array([0, *cuts]), np.array([*cuts, len(read)])
        _, held = stream(builder.freeze(k), np.array(read), starts, ends)
        for a, b in zip(starts, ends, strict=True):
            for p in range(a, b):
                assert held[p] == max((n for n in range(p - a + 2) if n == 0 or tuple(read[p + 1 - n : p + 1]) in grams), default=0), case


def test_states_grow_with_the_words():
    r = random.Random(1)
    for sequence in ([0] * 3000, [r.randrange(2) for _ in range(3000)], list(range(3000))):
        builder = Builder()
        builder.add(sequence)
        assert len(builder.length) <= 2 * len(sequence)


def made(seed=2, n=150):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "B", "be", "the", "Été", "中文", "x1", "zz"])
    gap = lambda: r.choice([" ", ", ", "\n", "\t-", "..."])
    text = lambda n: "".join(word() + gap() for _ in range(n))
    items = [(i, text(r.choice([0, 1, 4, 4, 9, 10, 11, 40]))) for i in range(12)]
    items += [(20, items[7][1]), (None, text(12)), (3, text(15)), (21, None), (22, "... --"), (23, text(900))]
    docs = [None, "", "- -", "a"]
    for _ in range(n):
        parts = [text(r.randrange(30))]
        if r.random() < 0.5:
            w = words(r.choice(items)[1])
            a = r.randrange(len(w) + 1)
            parts += [gap().join(w[a : a + r.choice([3, 9, 10, 25, 2000])]).upper() if r.random() < 0.5 else " ".join(w[a:])]
        docs.append("~".join([*parts, text(r.randrange(20))]))
    return docs, items


@pytest.mark.parametrize("options", [{}, {"window": 4}, {"block_words": 40}, {"block_words": 40, "pass_bytes": 1}])
def test_equals_comparing_windows(spark, options):
    docs, items = made()
    rows = [(i, t, 1, "x") for i, t in enumerate(docs)]
    table = spark.createDataFrame(rows, "doc_id long, text string, found int, items string").repartition(2)  # clashing names
    found = find(table, spark.createDataFrame(items, "item_id long, text string"), **options)
    got = {r.doc_id: r for r in found.withColumn("n_hit", n_hit(found["found"])).collect()}
    wanted = plain(docs, items, options.get("window", 10))
    assert len(got) == len(docs)
    for i, (n, hit, ids) in enumerate(wanted):
        f = got[i].found
        assert (f.n_words, places(f), f["items"], got[i].n_hit) == (n, hit, ids, len(hit)), i
        for s in f.spans:
            assert words(docs[i][s["start"] : s["end"]]) == words(docs[i])[s["first"] : s["last"]]
    assert any(w[1] for w in wanted) and any(w[0] and not w[1] for w in wanted)


def test_pieces_of_long_items_lose_no_window(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 16)
    docs, items = made(seed=9, n=60)
    found = find(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    wanted = plain(docs, items)
    for r in found:
        assert (places(r.found), r.found["items"]) == wanted[r.doc_id][1:]


def test_words_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "_numbers", lambda made, hashes: np.zeros(len(hashes), np.int32))  # every word is taken for the first
    item, doc = "same " * 12, "same " * 11 + "other " * 30 + "same " * 10
    pickled = next(iter(decontamination._build(10)(decontamination.pa.table({"piece": [b" ".join([b"same"] * 12)], "item_id": ["1"], "short": [False]}))["automaton"].to_pylist()))
    part = decontamination.pa.record_batch({"text": decontamination.pa.array([doc])})
    out = decontamination._searched(part, [decontamination.pickle.loads(pickled)], 10, True).column("found").to_pylist()[0]
    assert places(out) == plain([doc], [(1, item)])[0][1]


def test_long_text_and_many_copies(spark):
    item = " ".join(f"w{i}" for i in range(40))
    doc = f"{'lead in ' * 5} {item} " + "filler " * 400000 + item + " " + " ".join(["w1 w2 w3"] * 20000)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([doc, *[item] * 500])], "doc_id long, text string")
    items = spark.createDataFrame([(i, item) for i in range(300)], "item_id int, text string")
    for r in find(docs, items).collect():
        assert len(places(r.found)) == (80 if r.doc_id == 0 else 40) and len(r.found["items"]) == 300 and r.found.longest == 40


def test_removing(spark):
    item = " ".join(f"q{i}" for i in range(12))
    rows = [(1, f"Before. {item}! After é {' '.join('word' for _ in range(20))}", "k"), (2, item, "k"), (3, "nothing here", "k"), (4, None, "k"), (5, f"some words then {item} and {' '.join(f'more{i}' for i in range(30))}", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = {r.doc_id: r for r in remove(docs, items).collect()}
    assert sorted(left) == [1, 3, 4, 5] and left[1].row == "k" and list(left[1].asDict()) == docs.columns
    assert left[1].text == rows[0][1].replace(item, "") and left[3].text == "nothing here" and left[4].text is None
    assert left[5].text == rows[4][1].replace(item, "")
    assert {r.doc_id for r in remove(docs, items, most_share=1.0).collect()} == {1, 2, 3, 4, 5}
    assert {r.doc_id: r.text for r in remove(docs, items, most_words=12, most_share=1.0).collect()} == {r[0]: r[1] for r in rows}


def test_query_equals_comparing_windows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: r for r in op13_decontamination(spark, FOLDER).collect()}
    wanted = plain([d.text for d in docs], items)
    assert len(got) == len(docs)
    for d, (n, hit, ids) in zip(docs, wanted, strict=True):
        sha = hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert tuple(got[d.doc_id]) == (d.doc_id, n, len(hit), len(ids), sha, bool(hit))
    assert any(w[1] for w in wanted)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [r.found.asDict() for r in find(docs, items).collect()] == [{"n_words": 3, "longest": 0, "spans": [], "items": []}]
    assert find(docs.where("false"), items).collect() == []
