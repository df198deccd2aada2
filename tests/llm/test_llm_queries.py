"""Whole queries against plain Python, and both sides of every bound that once changed a result."""

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import fingerprints, language_id, lm_scoring, mixing, near_dedup, packing, pii, topk_search, warc_revisits
from pagewright.llm._lattice import load_pieces

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").toPandas()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def xxhash64(*texts):
    seed = 42
    for t in texts:
        seed = xxhash.xxh64_intdigest(t, seed)
    return seed


# 1 ---------------------------------------------------------------------------

def plain_prints(text, k=fingerprints.K, w=fingerprints.W):
    if not text:
        return []
    run = min(k, len(text))
    h = [signed(xxhash64(text[i : i + run].encode("utf-32-be"))) >> 16 for i in range(len(text) - run + 1)]
    w, out = min(w, len(h)), []
    for i in range(len(h) - w + 1):
        least = min(h[i : i + w])
        at = max(j for j in range(i, i + w) if h[j] == least)
        if not out or out[-1][1] != at:
            out.append((least, at))
    return out


def plain_likeness(one, two):
    a, b = {h for h, _ in one}, {h for h, _ in two}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, table):
    texts = list(table.text.fillna(""))
    prints = [plain_prints(t) for t in texts]
    rows = {r["doc_id"]: r for r in fingerprints.op1_fingerprints(spark, FOLDER).collect()}
    seen = {}
    for i, d in enumerate(table.doc_id):
        after = (i + 1) % len(texts)
        n = len(texts[i])
        edited = plain_prints(texts[i][: n - n // 4] + texts[after][: n // 4])
        row = rows[d]
        assert row["n_prints"] == len(prints[i])
        assert row["near_edited"] == pytest.approx(plain_likeness(prints[i], edited)) and row["near_next"] == pytest.approx(plain_likeness(prints[i], prints[after]))
        for digest, plain in ((row["fingerprint"], prints[i]), (row["edited_fingerprint"], edited)):
            assert seen.setdefault(digest, plain) == plain
    assert len(seen) == len({tuple(p) for p in seen.values()})


# 3 ---------------------------------------------------------------------------

def test_mixing_by_hand(spark, table):
    rows = {r["doc_id"]: r for r in mixing.op3_mixing(spark, FOLDER).collect()}
    by = ("source", "lang", "topic")
    tokens = {d: max(1, len(words(t))) for d, t in zip(table.doc_id, table.text, strict=True)}
    cells = Counter()
    for d, r in rows.items():
        cells[tuple(r[b] for b in by)] += tokens[d]
    total = sum(cells.values())
    share = {c: n / total for c, n in cells.items()}
    wanted = []
    for i in range(len(by)):
        own = Counter()
        for c, n in cells.items():
            own[c[i]] += n
        tempered = {v: n**0.9 for v, n in own.items()}
        wanted.append({v: n / sum(tempered.values()) for v, n in tempered.items()})
    fitted = dict(share)
    for _ in range(60):
        for i, target in enumerate(wanted):
            have = Counter()
            for c, f in fitted.items():
                have[c[i]] += f
            fitted = {c: f * target[c[i]] / have[c[i]] for c, f in fitted.items()}
    most = max(fitted[c] / share[c] for c in cells)
    for d, r in rows.items():
        c = tuple(r[b] for b in by)
        weight = fitted[c] / share[c]
        assert r["weight"] == pytest.approx(weight, abs=1e-6) and r["probability"] == pytest.approx(weight / most, abs=1e-6)
        assert r["sampled"] == ((xxhash64(str(d).encode(), b"mix") >> 11) / 2.0**53 < r["probability"])
        assert r["gap"] < 1e-6


def test_both_ways_of_raking_agree(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 30), ("b", "x", 50), ("b", "y", 10)], "s string, l string, tokens long")
    cases = [
        {"s": {"a": 0.5, "b": 0.5}, "l": {"x": 0.3, "y": 0.7}},
        {"s": {"a": 0.25, "b": 0.25, "absent": 0.5}, "l": {"x": 0.3, "y": 0.7}},
        {"s": {"a": 1.0}, "l": {"x": 0.3, "y": 0.3, "absent": 0.4}},
        {"s": {"absent": 1.0}, "l": {"x": 1.0, "y": 1.0}},
        None,
    ]
    for targets in cases:
        weights = [{(r["s"], r["l"]): r["weight"] for r in mixing.rake(cells, ["s", "l"], targets, small=small, rounds=8).collect()} for small in (100, 1)]
        assert weights[1] == pytest.approx(weights[0], abs=1e-9)
    nested = spark.createDataFrame([("a", "x", 10), ("b", "y", 30)], "s string, l string, tokens long")
    for small in (100, 1):
        assert mixing.rake(nested, ["s", "l"], {"s": {"a": 0.5, "b": 0.5}, "l": {"x": 0.9, "y": 0.1}}, small=small, rounds=4).first()["gap"] == pytest.approx(0.4)


def test_mixing_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a", "en", 5, "kept"), (2, "b", "fr", 7, "kept")], "doc_id long, source string, lang string, n long, by_0 string").withColumn("row", F.col("by_0")).withColumn("_by_source", F.col("by_0")).withColumn("tokens", F.col("by_0"))
    mixed = mixing.mix(rows, ["source", "lang"], "n")
    assert mixed.columns == [*rows.columns, "weight", "probability", "sampled", "gap"]
    assert {tuple(r[c] for c in ("by_0", "row", "_by_source", "tokens")) for r in mixed.collect()} == {("kept",) * 4}


# 4 and 10 --------------------------------------------------------------------

class Plain:
    """The piece model, one word and one segmentation edge after another."""

    def __init__(self, vocabulary):
        self.pieces, self.ranks = load_pieces(vocabulary)
        self.index = {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces))
        p = 1 / (self.ranks + 10.0)
        self.start = np.log(p / p.sum())
        self.edges = {}

    def edges_of(self, word):
        if word not in self.edges:
            raw = b" " + word.encode()
            self.edges[word] = len(raw), [(i, j, k) for j in range(1, len(raw) + 1) for i in range(max(0, j - self.longest), j) if (k := self.index.get(raw[i:j])) is not None]
        return self.edges[word]

    def forward(self, word, logp):
        n, edges = self.edges_of(word)
        alpha = [0.0] + [-math.inf] * n
        for i, j, k in edges:
            alpha[j] = np.logaddexp(alpha[j], alpha[i] + logp[k])
        return alpha

    def score(self, word, logp):
        return self.forward(word, logp)[-1]

    def fit(self, counts, prior, ends=None, turns=3):
        logp = self.start
        for _ in range(turns):
            used = np.zeros(len(self.pieces))
            for word, times in counts.items():
                n, edges = self.edges_of(word)
                alpha = self.forward(word, logp)
                beta = [-math.inf] * n + [0.0]
                for i, j, k in sorted(edges, key=lambda e: -e[0]):
                    beta[i] = np.logaddexp(beta[i], beta[j] + logp[k])
                for i, j, k in edges:
                    used[k] += times * math.exp(alpha[i] + logp[k] + beta[j] - alpha[n])
            full = used if ends is None else np.append(used, ends)
            logp = np.log((full + prior) / (full.sum() + prior * len(full)))
        return logp


@pytest.fixture(scope="module")
def plain():
    return Plain(lm_scoring.VOCABULARY)


@pytest.fixture(scope="module")
def some(spark, tmp_path_factory):
    """A folder whose documents are few enough for plain Python: the shorter ones, whole."""
    folder = str(tmp_path_factory.mktemp("some"))
    spark.read.parquet(f"{FOLDER}/documents.parquet").where("n_chars < 700").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_lm_scores(spark, some, plain):
    texts = {r["doc_id"]: words(r["text"]) for r in spark.read.parquet(f"{some}/documents.parquet").collect()}
    learns = {d: w for d, w in texts.items() if zlib.crc32(str(d).encode()) % 7 != 2}
    logp = plain.fit(Counter(itertools.chain(*learns.values())), 0.01, len(learns))
    end = logp[-1]
    own = plain.start + math.log(1 - math.exp(end))
    rows = {r["doc_id"]: r for r in lm_scoring.op4_lm_scoring(spark, some).collect()}
    assert rows.keys() == texts.keys()
    known = {w: (plain.score(w, logp), plain.score(w, own)) for w in set(itertools.chain(*texts.values()))}
    for d, ws in texts.items():
        for at, column in enumerate(("score", "vocabulary_score")):
            assert rows[d][column] == pytest.approx((sum(known[w][at] for w in ws) + end) / math.log(10), rel=1e-9)


def test_languages(spark, some, plain):
    table = spark.read.parquet(f"{some}/documents.parquet").collect()
    counts = defaultdict(Counter)
    for r in table:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            counts[r["lang"]].update(words(r["text"]))
    languages = sorted(counts)
    models = [plain.fit(counts[x], 0.1) for x in languages]
    rows = {r["doc_id"]: r for r in language_id.op10_language_id(spark, some).collect()}
    known = {}
    for r in table:
        if not any(map(str.isalpha, r["text"] or "")):
            assert (rows[r["doc_id"]]["lang_pred"], rows[r["doc_id"]]["score"]) == ("und", 0)
            continue
        likely = np.zeros(len(languages))
        for w in words(r["text"]):
            if w not in known:
                known[w] = np.array([plain.score(w, m) for m in models])
            likely += known[w]
        best = int(likely.argmax())
        assert rows[r["doc_id"]]["lang_pred"] == languages[best]
        assert rows[r["doc_id"]]["score"] == pytest.approx(1 / np.exp(likely - likely[best]).sum(), rel=1e-6)


def test_any_number_of_languages(spark):
    names = [f"l{i:03}" for i in range(600)]
    random.seed(12)
    rows = [(i, " ".join("".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(20)), names[i]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.train(docs, iterations=1)
    assert model.languages == names
    told = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs.where("doc_id < 40 or doc_id > 570"), model).collect()}
    assert np.mean([told[i] == names[i] for i in told]) > 0.9


# 5 ---------------------------------------------------------------------------

def test_one_large_group_of_near_copies(spark):
    random.seed(5)
    base = [f"t{i}" for i in range(90)]
    rows = []
    for i in range(2500):
        line = list(base)
        for _ in range(random.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            line[random.randrange(len(line))] = f"e{random.random()}"
        rows.append((i, " ".join(line[: random.choice([90, 90, 80, 70])])))
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (r[1].split() for r in rows)]
    every = {s: i for i, s in enumerate(s for s, n in Counter(itertools.chain(*sets)).items() if n > 1)}
    matrix = np.zeros((len(rows), len(every)), np.float32)
    for i, s in enumerate(sets):
        matrix[i, [every[x] for x in s if x in every]] = 1
    both = matrix @ matrix.T
    n = np.array([len(s) for s in sets])
    linked = (100 * both >= 80 * (n[:, None] + n[None, :] - both)) | np.eye(len(rows), dtype=bool)
    label = np.arange(len(rows))
    while True:
        step = np.where(linked, label[None, :], len(rows)).min(axis=1)
        if (step == label).all():
            break
        label = step
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), shingle_words=4).collect()}
    assert len(set(label)) > 100
    assert got == {i: (int(n[i]), int(label[i])) for i in range(len(rows))}


# 6 ---------------------------------------------------------------------------

def plain_pack(sizes, lengths):
    best = None
    for chosen in lengths:
        room, opened, held, touched = [], [], [], {}
        for turn, size in enumerate(sizes):
            fits = [i for i, r in enumerate(room) if r >= size]
            if fits:  # the fullest that has room; of equals the one last added to
                at = min(fits, key=lambda i: (room[i], -touched[i]))
            else:
                wide = [x for x in lengths if x >= size]
                opened.append(min([x for x in wide if x <= chosen] or wide[:1], key=lambda x: (packing.cost(x) / x, -x)))
                room.append(opened[-1]), held.append([])
                at = len(room) - 1
            room[at] -= size
            touched[at] = turn
            held[at].append(size)
        cost = sum(packing.cost(min(x for x in lengths if x >= sum(h))) for h in held)
        if best is None or cost < best[0]:
            best = cost, held
    return best


def test_packing_query(spark, table):
    rows = packing.op6_packing(spark, FOLDER).toPandas()
    tokens = {d: len(words(t)) + 1 for d, t in zip(table.doc_id, table.text, strict=True)}
    assert rows.groupby("doc_id").length.sum().to_dict() == tokens
    for _, own in rows.groupby("doc_id"):
        own = own.sort_values("piece")
        assert own.start.tolist() == [8192 * p for p in own.piece] and own.piece.tolist() == list(range(len(own)))
    for _, group in rows.groupby(rows.bin_id // 2**32):
        sizes = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True]).length.tolist()
        cost, held = plain_pack(sizes, packing.LENGTHS)
        bins = group.groupby("bin_id")
        assert sorted(sorted(own.length) for _, own in bins) == sorted(map(sorted, held))
        assert sum(packing.cost(c) for c in bins.capacity.first()) == pytest.approx(cost)
        assert (bins.length.sum() == bins.bin_used.first()).all() and all(c == min(x for x in packing.LENGTHS if x >= u) for c, u in zip(bins.capacity.first(), bins.bin_used.first(), strict=True))


def test_packing_does_not_depend_on_the_session(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 700).alias("n"))
    found = []
    for n in ("3", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, packing.pack(docs, "n", group_tokens=1 << 15).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_packing_splits_repeated_and_missing_ids_and_long_documents(spark):
    same = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), F.lit(99).alias("n"))
    long = spark.createDataFrame([(8, 8192 * 300 - 1)], "doc_id long, n int")
    rows = packing.pack(same.unionByName(long), "n", group_tokens=1 << 16).toPandas()
    lengths = rows[rows.doc_id == 8].sort_values("piece")
    assert lengths.length.tolist() == [8192] * 300 and lengths.piece.tolist() == list(range(300))
    assert (rows[rows.doc_id == 7].length == 100).sum() == 2000 and (rows[rows.doc_id.isna()].length == 100).sum() == 2000
    assert rows.groupby(rows.bin_id // 2**32).length.sum().max() < 5 * (1 << 16)
    assert (rows.groupby("bin_id").length.sum() <= rows.groupby("bin_id").capacity.first()).all()


# 7, 8, 9 ---------------------------------------------------------------------

def test_revisits_with_no_and_with_many_headers(spark):
    many = [(f"X-{i}", "v" * 50) for i in range(5000)]
    rows = [(1, "a.com/p", 10, "response", [("ETag", '"x"'), *many]), (2, "a.com/p", 20, "revisit", []), (3, "a.com/p", 30, "revisit", [("ETag", '"x"')])]
    frame = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers array<struct<name:string,value:string>>")
    found = {r["record_id"]: (r["status"], r["target_id"]) for r in warc_revisits.resolve(frame).collect()}
    assert found == {2: ("unverified", 1), 3: ("resolved", 1)}


def test_personal_data_takes_time_in_proportion():
    texts = ["1" * 400_000, "1." * 200_000, "1.2.3." + "4" * 200_000 + ".", "joe [at] mail [dot] com " * 8000, "a@b.co " * 40_000, "+1" + "(" * 200_000, "a." * 150_000 + "@"]
    for text in texts:
        began = time.perf_counter()
        pii.spans(text)
        assert time.perf_counter() - began < 4, text[:20]
    assert len(pii.spans("joe [at] mail [dot] com " * 50)[1]) == 50


def test_covered_stretches_are_those_of_all_spans():
    random.seed(9)
    for _ in range(300):
        covered, held = pii._Covered([]), []
        for _ in range(12):
            a = random.randrange(40)
            b = a + random.randint(1, 9)
            assert covered.meets(a, b) == any(x < b and a < y for x, y in held)
            covered.add(a, b)
            held.append((a, b))


def test_search_with_clashing_columns_and_large_numbers(spark, monkeypatch):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>").withColumn("terms", F.lit("x")).withColumn("block", F.lit(1)).withColumn("tile", F.lit(2))
    rows = topk_search.scaled(frame)
    assert [tuple(r) for r in topk_search.top_k(rows, rows.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 2, 1536 * 1024), (0, 2, 1, 1024 * 1024)]
    monkeypatch.setattr(topk_search, "PASS_BYTES", 40)
    assert topk_search.top_k(rows, rows).count() == 6
    wide = spark.createDataFrame([(0, [2.0**40, 1.0]), (1, [2.0**11, 3.0]), (2, [-(2.0**11), 3.0])], "vec_id long, embedding array<double>")
    large = topk_search.scaled(wide)
    assert [r["score"] for r in topk_search.top_k(large, large.where("vec_id = 0"), scale=1).orderBy("rank").collect()] == [2**51 + 3, -(2**51) + 3]
    assert topk_search.accumulate(np.array([[2**52, 2**40]]), np.array([[2**10, -(2**22)]])).tolist() == [[0]]


def plain_best(vectors, k=10):
    """Whole numbers of any size; scores beyond a long count as its end."""
    low, high = -(2**63), 2**63 - 1
    whole = {i: [int(x) * 1024 if abs(x) >= 2.0**53 else math.floor(1024 * x) for x in v] for i, v in vectors}
    out = []
    for q in (i for i in whole if i % 100 == 0):
        found = sorted((-max(low, min(high, sum(a * b for a, b in zip(whole[q], v, strict=False)))), i) for i, v in whole.items() if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_search_with_huge_components_among_good_rows(spark):
    r = random.Random(12)
    vectors = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(220)]
    vectors += [(300, [1e20, 1.0, 0, 0, 0, 0.0]), (301, [1e300, 0.0]), (302, [-1e20] * 6), (400, [2.0**53, 2.0**-10]), (303, [2.0**50, -(2.0**50), 0.5]), (304, [-1e-300] * 6)]
    vectors = [(i, [float(x) for x in v]) for i, v in vectors]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    rows = topk_search.scaled(frame)
    found = topk_search.top_k(rows, rows.where("vec_id % 100 = 0"))
    assert sorted(tuple(x) for x in found.collect()) == plain_best(vectors)


def test_search_of_wide_vectors_in_passes(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "PASS_BYTES", 1 << 16)
    monkeypatch.setattr(topk_search, "_CELLS", 1 << 13)
    r = np.random.default_rng(5)
    vectors = [(i, r.normal(size=4096).tolist()) for i in range(401)]
    rows = topk_search.scaled(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(2))
    assert sorted(tuple(x) for x in topk_search.top_k(rows, rows.where("vec_id % 100 = 0")).collect()) == plain_best(vectors)


# The pipeline ----------------------------------------------------------------

def test_near_copies_among_rows_without_or_with_equal_ids(spark):
    base = " ".join(f"t{i}" for i in range(60))
    rows = [(None, base), (None, base), (None, base + " more"), (None, None), (3, "one thing"), (3, "another thing"), (4, base), (5, "apart from all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).repartition(3)
    found = [corpus_pipeline.drop_near_copies(spark, docs.repartition(n), FOLDER) for n in (1, 5)]
    assert found[0].columns == docs.columns
    kept = [sorted(map(repr, x.collect())) for x in found]
    assert kept[0] == kept[1] and len(kept[0]) == 5
    texts = [r.text for r in found[0].collect()]
    assert {"one thing", "another thing", "apart from all", None} < set(texts) and sum(t is not None and t.startswith(base) for t in texts) == 1


def test_near_dedup_stage_against_all_pairs(spark, monkeypatch):
    """Rows with ids, shared ids and none: one row of each group of similar texts stays, and every row alone."""
    r = random.Random(21)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        own = [r.choice(vocabulary) for _ in range(r.randrange(8, 90))]
        texts += [" ".join(own), " ".join(own), " ".join([*own[: len(own) - 1], "end"]), " ".join([*own, "more"])][: r.randrange(1, 5)]
    rows = [(r.choice([i, i, i, 7, 8, None]), t, "x") for i, t in enumerate([*texts, None, "", "one two"])]

    def shingles(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets = [shingles(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            alike = sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
            if alike or rows[i] == rows[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for most in (100_000, 0):
        monkeypatch.setattr(near_dedup, "MOST_SENT", most)
        kept = [tuple(x) for x in corpus_pipeline.drop_near_copies(spark, docs.repartition(3), FOLDER).collect()]
        assert len(kept) == len(set(group)) and {group[rows.index(k)] for k in kept} == set(group)
