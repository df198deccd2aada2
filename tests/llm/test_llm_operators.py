"""Each operator against brute force, and on nulls, empty, long, tied, repeated and missing rows."""

import hashlib
import itertools
import math
import pathlib
import random
import re
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import fingerprints, language_id, license_scan, lm_scoring, mixing, near_dedup, packing, pii, topk_search, warc_revisits
from pagewright.llm.license_texts import LICENSES
from pagewright.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(20000))
ODD = [
    (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 4), (4, "one", "en", "a", 3), (5, "one", "fr", "b", 3), (5, "one", "fr", "b", 3),
    (None, "no id here at all, mail a.b@c.org", "en", "b", 9), (6, LONG, "en", "a", len(LONG)), (7, LONG + " tail", "en", "a", len(LONG) + 5), (8, "été à la mer 😀", "fr", "b", 14), (9, "12 34 !!", "en", "a", 8), (5, "another text of the same id", "en", "a", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("score", F.lit("clash")).withColumn("probability", F.lit("clash")).withColumn("kept", F.lit("clash")).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    found, wanted = QUERIES[name](spark, FOLDER), connection.sql(ORACLE_SQL[name])
    order = [list(wanted.columns).index(c) for c in found.columns]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in wanted.fetchall())


# 1 ---------------------------------------------------------------------------

def plain_winnow(spark, text, k=fingerprints.K, w=fingerprints.W):
    if not text:
        return []
    run = min(k, len(text))
    grams = [text[i : i + run] for i in range(len(text) - run + 1)]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(grams)], "i int, g string").select("i", F.shiftright(F.xxhash64(F.encode("g", "UTF-32")), 16).alias("h")).orderBy("i").collect()
    h, out = [r["h"] for r in rows], []
    window = min(w, len(h))
    for i in range(len(h) - window + 1):
        least = min(h[i : i + window])
        at = max(j for j in range(i, i + window) if h[j] == least)
        if not out or out[-1][1] != at:
            out.append((least, at))
    return out


def test_winnowing(spark):
    random.seed(3)
    texts = ["", "a", "abcdefg", "abcdefgh", "aaaa" * 20, "😀é" * 40] + ["".join(random.choice("abé😀 ") for _ in range(n)) for n in (22, 23, 24, 4111, 4119, 9000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [tuple(p) for p in r["prints"]] for r in fingerprints.fingerprint(frame).collect()}
    for i, text in enumerate(texts):
        assert found[i] == plain_winnow(spark, text)
    for r in fingerprints.compare_edited(frame).withColumn("direct", fingerprints.winnow(F.col("edited"))).collect():
        assert r["edited_prints"] == r["direct"]
        following, n = texts[(r["doc_id"] + 1) % len(texts)], len(r["text"])
        assert r["edited"] == r["text"][: n - n // 4] + following[: n // 4]


def test_fingerprint_query(spark, docs, odd, none):
    rows = {r["doc_id"]: r for r in fingerprints.op1_fingerprints(spark, FOLDER).collect()}
    assert sorted(rows) == [d for d, _ in docs]
    for (d, text), (_, following) in zip(docs, docs[1:] + docs[:1], strict=True):
        q = len(text) // 4
        assert rows[d]["n_chars"] == len(text) and rows[d]["edited_sha256"] == hashlib.sha256((text[: len(text) - q] + following[:q]).encode()).hexdigest()
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows.values()]) > 0.95
    strange = fingerprints.compare_edited(odd).collect()
    assert len(strange) == len(ODD) and len({tuple(map(tuple, r["prints"])) for r in strange if r["text"] == "one"}) == 1
    # Every row has a place; those without an id come first, in the order of their texts, and the last row's next is the first.
    rows = [(None, "bbbbbbbb tail"), (None, "aaaaaaaa tail"), (-(2**63), "least of ids"), (5, None), (5, "five five five"), (7, "seven and more"), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    wanted = []
    for (i, t), (_, after) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        t, after = t or "", after or ""
        wanted.append(repr((i, t, t[: len(t) - len(t) // 4] + after[: len(t) // 4])))
    assert sorted(repr((r["doc_id"], r["text"], r["edited"])) for r in fingerprints.compare_edited(table.repartition(3)).collect()) == sorted(wanted)
    assert fingerprints.compare_edited(none).count() == 0
    single = fingerprints.compare_edited(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert single["edited"] == "abcdefab"


# 2 ---------------------------------------------------------------------------

def test_licences(spark, odd, none):
    mit = dict(LICENSES[4:5])["MIT"]
    rows = [(1, "Copyright (c) 2020 X\n\n" + mit.upper().replace(",", " ;")), (2, "x\nReleased under the  MIT Licence!\ny"), (3, mit + " more")]
    found = {r["doc_id"]: (r["license"], r["notices"], r["licensed"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.builtin(spark)).collect()}
    assert found == {1: ("MIT", "", True), 2: (None, "MIT", True), 3: (None, "", False)}
    assert license_scan.scan(odd, license_scan.builtin(spark)).where("licensed").count() == 0
    assert license_scan.scan(odd, license_scan.builtin(spark)).count() == len(ODD)
    assert license_scan.scan(none, license_scan.builtin(spark)).count() == 0
    assert license_scan.scan(odd, license_scan.builtin(spark).limit(0)).count() == len(ODD)


def rewrapped(text, width):
    """Paragraphs at another width; lines that hold a notice stay lines of their own."""
    out = []
    for block in re.split(r"\n\s*\n", text):
        run = []
        for line in [*block.split("\n"), None]:
            if line is None or re.search(r"copyright (\(c\)|\[)|all rights reserved", line, re.IGNORECASE):
                out += textwrap.wrap(" ".join(run), width, break_long_words=False, break_on_hyphens=False)
                run = []
                out += [line] if line is not None else []
            else:
                run.append(line)
        out.append("")
    return "\n".join(out)


def test_licences_do_not_depend_on_wrapping(spark):
    known = [(r["license"], r["text"]) for r in license_scan.builtin(spark).collect()]
    rows = [(i, f"{head}{rewrapped(text, width)}", name) for i, ((name, text), width, head) in enumerate(itertools.product(known, (30, 47, 64, 72, 79, 100, 10**6), ("", "Copyright 2020 The X Authors\n\n")))]
    texts = spark.createDataFrame(rows, "doc_id long, text string, name string").repartition(8)
    found = {r["doc_id"]: r["license"] for r in license_scan.scan(texts, license_scan.builtin(spark)).collect()}
    assert [(name, text[:300]) for i, text, name in rows if found[i] != name] == []


def test_only_notices_are_left_out(spark):
    notices = ["Copyright (c) 2020 X", "  # Copyright 2020, X", "Copyright X Corp.", "COPYRIGHT: X", "Copyright by X", "Copyright The X Authors", "Copyright the X Authors", "(C) 2020 X", "(c) Copyright 2020 X", "© X", "Copyright © X", "Copyright [yyyy] [name]", "Copyright <year> X", "All rights reserved.", " * all rights reserved"]
    prose = ["copyright notice and this permission notice appear", "COPYRIGHT HOLDERS OR CONTRIBUTORS BE LIABLE", "Copyright License. Subject to", "copyright, patent, trademark", "copyrighted by X", "copyright resulting from the compilation", "COPYRIGHT THE SOFTWARE", "(c) You must retain", "all rights reserved by X stay", "copyright. Those who"]
    rows = spark.createDataFrame([(x,) for x in notices + prose], "text string").select("text", license_scan.canonical(F.concat(F.lit("a\n"), F.col("text"), F.lit("\nb"))).alias("form"))
    assert {r["text"] for r in rows.where("form = 'a b'").collect()} == set(notices)


def test_whole_texts_and_titles_are_known(spark):
    body = {name: text for name, text in reversed(LICENSES) if "\n" in text}
    titled = [("MIT", "The MIT License (MIT)"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("ISC", "ISC License"), ("Zlib", "zlib License"), ("0BSD", "BSD Zero Clause License")]
    rows = [(name, f"{title}\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n{body[name]}") for name, title in titled]
    folder = pathlib.Path(license_scan.__file__).parent / "known"
    apache, gpl = (folder / "Apache-2.0.txt").read_text(), (folder / "GPL-3.txt").read_text()
    rows += [(name, (folder / f"{file}.txt").read_text()) for name, file in [("GPL-2.0", "GPL-2"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3")]]
    rows += [("Apache-2.0", apache), ("Apache-2.0", apache[: apache.index("APPENDIX")]), ("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2020 X Inc.")), ("GPL-3.0", gpl), ("GPL-3.0", gpl[: gpl.index("END OF TERMS")])]
    texts = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"]: r["license"] for r in license_scan.scan(texts, license_scan.builtin(spark)).collect()}
    assert [found[i] for i in range(len(rows))] == [name for name, _ in rows]


# 3 ---------------------------------------------------------------------------

def test_mixing(spark, odd, none):
    rows = mixing.op3_mixing(spark, FOLDER).toPandas()
    for name in ("source", "lang", "topic"):
        share = rows.n_tokens.clip(lower=1).groupby(rows[name]).sum() ** 0.9
        got = (rows.n_tokens.clip(lower=1) * rows.weight).groupby(rows[name]).sum()
        assert (got / got.sum()).to_numpy() == pytest.approx((share / share.sum()).to_numpy(), abs=1e-6)
    assert rows.probability.max() == pytest.approx(1) and rows.sampled.sum() == pytest.approx(rows.probability.sum(), abs=4 * math.sqrt(len(rows)) / 2)
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 30), ("b", "x", 50), ("b", "y", 10)], "s string, l string, tokens long")
    targets = {"s": {"a": 0.5, "b": 0.5}, "l": {"x": 0.3, "y": 0.7}}
    small = {(r["s"], r["l"]): r["weight"] for r in mixing.rake(cells, ["s", "l"], targets).collect()}
    large = {(r["s"], r["l"]): r["weight"] for r in mixing.rake(cells, ["s", "l"], targets, small=1, rounds=8, tolerance=1e-4).collect()}
    assert large == pytest.approx(small, rel=1e-2)
    zero = mixing.rake(cells, ["s"], {"s": {"a": 1.0}}).where("s = 'b'").select("weight").distinct().collect()
    assert [r[0] for r in zero] == [0.0]
    strange = mixing.mix(odd, ["source", "lang"], "n_chars")
    assert strange.count() == len(ODD) and strange.where("probability is null or sampled is null").count() == 0
    assert mixing.mix(none, ["source", "lang"], "n_chars").count() == 0


# 4 ---------------------------------------------------------------------------

def test_lm_scoring(spark, docs, odd, none):
    rows = {r["doc_id"]: r for r in lm_scoring.op4_lm_scoring(spark, FOLDER).collect()}
    counts = Counter()
    for d, text in docs:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update([*words(text), None])
    total, distinct = sum(counts.values()), len(counts)
    for d, text in docs:
        tokens = [*words(text), None]
        row = rows[d]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["held_out"]) == (len(tokens), sum(counts[t] > 0 for t in tokens), total, zlib.crc32(str(d).encode()) % 7 == 2)
        assert row["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens))
        assert -math.inf < row["score"] < 0
    columns = F.col("doc_id"), (F.col("doc_id") % 2 == 0).alias("held_out"), F.col("text")
    strange = lm_scoring.score_texts(odd.select(*columns)).collect()
    assert sorted(str(r["doc_id"]) for r in strange) == sorted(str(r[0]) for r in ODD) and all(r["score"] < 0 for r in strange)
    assert {r["n_tokens"] for r in strange if r["doc_id"] in (1, 2, 3)} == {1}
    assert lm_scoring.score_texts(none.select(*columns)).count() == 0


# 5 ---------------------------------------------------------------------------

def plain_components(rows, size, percent=80):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, (a, _)), (j, (b, _)) in itertools.combinations(enumerate(rows), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for (d, _), s in zip(rows, sets, strict=True)}


def test_near_duplicates(spark, docs, odd, none):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.op5_near_dedup(spark, FOLDER).collect()}
    assert found == plain_components(docs, 4)
    # Families whose members drift apart, so that stars alone do not join them.
    random.seed(11)
    rows, base = [], [f"t{i}" for i in range(120)]
    for family in range(4):
        line = [f"{family}{w}" for w in base]
        for _ in range(40):
            line = list(random.choice([line, [f"{family}{w}" for w in base]]))
            for _ in range(random.randint(1, 6)):
                line[random.randrange(len(line))] = f"e{random.random()}"
            rows.append((len(rows), " ".join(line)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shingle_words=4).collect()}
    assert got == plain_components(rows, 4)
    strange = near_dedup.near_duplicates(odd).collect()
    assert len(strange) == len(ODD)
    assert {(r["n_shingles"], r["component_id"] == r["doc_id"], r["kept"]) for r in strange if r["doc_id"] in (1, 2, 3)} == {(0, True, True)}
    assert {r["component_id"] for r in strange if r["doc_id"] in (6, 7)} == {6} and {r["component_id"] for r in strange if r["doc_id"] == 5} == {4}
    assert near_dedup.near_duplicates(none).count() == 0


def test_sketches_fill_and_estimate():
    random_ = np.random.default_rng(2)
    base = random_.integers(0, 2**63, 400, dtype=np.uint64)
    other = np.concatenate([base[:320], random_.integers(0, 2**63, 80, dtype=np.uint64)])
    one, two, tiny, empty = near_dedup.sketches([np.unique(base), np.unique(other), base[:1], base[:0]])
    full = np.uint64(2**64 - 1)
    assert (one != full).all() and (tiny != full).all() and (empty == full).all()
    assert abs((one == two).mean() - 320 / 480) < 0.25


# 6 ---------------------------------------------------------------------------

def plain_best_fit(sizes, lengths, chosen):
    room, bins = [], []
    for size in sizes:
        fits = [i for i, r in enumerate(room) if r >= size]
        if fits:
            least = min(room[i] for i in fits)
            at = next(i for i in fits if room[i] == least)
        else:
            wide = [x for x in lengths if x >= size]
            room.append(min([x for x in wide if x <= chosen] or wide[:1], key=lambda x: (packing.cost(x) / x, -x)))
            at = len(room) - 1
        room[at] -= size
        bins.append(at)
    return room, bins


def test_packing(spark, odd, none):
    random.seed(4)
    for _ in range(30):
        sizes = sorted((random.randint(1, 64) for _ in range(random.randint(1, 40))), reverse=True)
        bins, opened, used = packing.best_fit(sizes, (16, 32, 64), 32)
        room, _ = plain_best_fit(sizes, (16, 32, 64), 32)
        assert sorted(o - u for o, u in zip(opened, used, strict=True)) == sorted(room)
        _, final, used = packing.pack_group(sizes, (16, 32, 64))
        assert all(f == min(x for x in (16, 32, 64) if x >= u) for f, u in zip(final, used, strict=True)) and sum(used) == sum(sizes)
        assert sum(map(packing.cost, final)) <= min(sum(packing.cost(packing.shrunk(u, (16, 32, 64))) for u in packing.best_fit(sizes, (16, 32, 64), c)[2]) for c in (16, 32, 64)) + 1e-9
    rows = packing.pack(odd.select("doc_id", mixing.n_words(F.col("text")).alias("n")), "n").toPandas()
    assert rows.length.sum() == sum(len(words(r[1])) + 1 for r in ODD) and (rows.groupby("bin_id").length.sum() <= rows.groupby("bin_id").capacity.first()).all()
    pieces = rows[rows.doc_id == 6].sort_values("piece")
    assert pieces.start.tolist() == [0, 8192, 16384] and pieces.length.tolist() == [8192, 8192, 20001 - 16384]
    for _, own in rows.sort_values("offset").groupby("bin_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
    assert packing.pack(none, "n_chars").count() == 0


# 7 ---------------------------------------------------------------------------

def test_revisits(spark):
    h = lambda **x: [(k.replace("_", "-"), v) for k, v in x.items()]
    rows = [
        (1, "http://www.A.com/p/?b=2&a=1#f", 10, "response", h(ETag='"x"', Content_Type="t", Date="1")),
        (2, "https://a.com:443/p?a=1&b=2&utm_source=z", 20, "response", h(ETag='"y"', Vary="q")),
        (3, "a.com/p?a=1&b=2", 15, "revisit", h(ETag='W/"x"', Date="2", Content_Type="no")),
        (4, "a.com/p?b=2&a=1", 20, "revisit", h(ETag='"x"')),
        (5, "a.com/p?b=2&a=1", 5, "revisit", h(ETag='"x"')),
        (6, "a.com/p?a=1&b=2", 30, "revisit", None),
        (7, None, 30, "revisit", None),
        (8, "a.com/p", None, "revisit", None),
        (3, "a.com/p?a=1&b=2", 15, "revisit", h(ETag='W/"x"', Date="2", Content_Type="no")),
        (9, "a.com", 1, "metadata", None),
    ]
    frame = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers array<struct<name:string,value:string>>").withColumn("status", F.lit("clash"))
    for slices in (1, 2, 16):
        found = sorted((r["record_id"], r["status"], r["target_id"]) for r in warc_revisits.resolve(frame, slices=slices).fillna({"target_id": -1}).collect())
        assert found == [(3, "resolved", 1), (3, "resolved", 1), (4, "changed", 2), (5, "missing", -1), (6, "unverified", 2), (7, "missing", -1), (8, "missing", -1)]
    merged = next(r["headers"] for r in warc_revisits.resolve(frame).collect() if r["record_id"] == 3)
    assert [tuple(x) for x in merged] == [("content-type", "t"), ("date", "2"), ("etag", 'W/"x"')]
    assert warc_revisits.resolve(frame.limit(0)).count() == 0


# 8 ---------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            out += [(kind, m.start(), m.end())] if good else []
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_personal_data(spark, docs, odd, none):
    random.seed(1)
    parts = ["a@b.c", "@", ".", "a", "1", "9.", "+1", "(", ") ", " ", "-", "255", "4111111111111111", "1.2.3.4", "é", "@x.y", "İ", "000"]
    for _ in range(4000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        assert pii.spans(text)[0] == plain_spans(text), text
    rows = {r["doc_id"]: r for r in pii.op8_pii(spark, FOLDER).collect()}
    for d, text in docs:
        base = plain_spans(text)
        assert rows[d]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert rows[d]["n_email"] == sum(k == "email" for k, _, _ in base)
    for text, wanted in [("joe.x [at] mail [dot] com", "<HANDLE>"), ("IBAN: DE89 3704 0044 0532 0130 00 ok", "IBAN: <IBAN> ok"), ("SSN 123-45-6789.", "SSN <SSN>."), ("ftp://u:p@h.org/x", "<LOGIN>/x"), ("nothing at all: x", "nothing at all: x")]:
        assert pii.masked(text, pii.spans(text)[1]) == wanted
    strange = pii.mask(odd)
    assert strange.columns == odd.columns and strange.count() == len(ODD)
    assert strange.where("doc_id is null").first()["text"].endswith("mail <EMAIL>")
    assert pii.find(odd).count() == len(ODD) and pii.find(none).count() == 0


@pytest.mark.parametrize("cue", ["Social Security Number: ", "SSN no. ", "SSN is ", "ssn=", "SSN #", "social security no: ", "Social Security Number (SSN): ", "social security number is: ", '"ssn": "', "SSN - ", "SSN:    "])
def test_words_between_cue_and_social_security_number(cue):
    text = f"My {cue}123-45-6789, ok"
    assert pii.masked(text, pii.spans(text)[1]) == f"My {cue}<SSN>, ok"


@pytest.mark.parametrize("cue", ["IBAN number ", "IBAN no.: ", "IBAN is ", "IBAN code = ", "iban=", "IBAN (", '"iban": "', "IBAN - "])
def test_words_between_cue_and_iban(cue):
    text = f"My {cue}DE89 3704 0044 0532 0130 00, ok"
    assert pii.masked(text, pii.spans(text)[1]) == f"My {cue}<IBAN>, ok"


def test_other_words_after_a_cue_end_the_search():
    for text in ["SSN form of 12 May, part 123-45-6789", "IBAN notes DE89370400440532013000", "SSN number 000-45-6789", "IBAN number DE88370400440532013000"]:
        assert pii.spans(text)[1] == pii.spans(text)[0]


# 9 ---------------------------------------------------------------------------

def test_top_k(spark, monkeypatch):
    random_ = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in random_.integers(-2, 3, 4) / 4]) for i in range(60)]
    vectors += [(100, [0.5, -0.25, 0.5, 1.0]), (101, None), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan")] * 4), (104, [float("inf")] * 4), (105, []), (None, [1.0] * 4), (7, vectors[7][1]), (0, vectors[0][1])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    rows = topk_search.scaled(frame)
    for block in (1024, 1):
        monkeypatch.setattr(topk_search, "BLOCK_QUERIES", block)
        found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk_search.top_k(rows, rows.where("vec_id % 100 = 0")).collect()}
        good = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
        for q in (0, 100):
            own = next(v for i, v in good if i == q)
            ranked = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in good if i != q)[:10]
            assert [found[q, r + 1] for r in range(10)] == [(i, -s) for s, i in ranked]
    assert topk_search.top_k(rows.limit(0), rows.limit(0)).count() == 0


# 10 --------------------------------------------------------------------------

def test_language(spark, docs, odd, none):
    rows = {r["doc_id"]: r for r in language_id.op10_language_id(spark, FOLDER).collect()}
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for d, r in rows.items())
    held = [d for d, r in rows.items() if r["held_out"]]
    assert np.mean([rows[d]["lang_pred"] == langs[d] for d in held]) > 0.97
    told = language_id.identify(odd, language_id.train(odd)).collect()
    assert len(told) == len(ODD) and {r["lang_pred"] for r in told if r["doc_id"] in (1, 2, 3, 9)} == {"und"}
    assert all(r["lang_pred"] in ("en", "fr") for r in told if r["doc_id"] in (4, 6, 8))
    nothing = language_id.train(none)
    assert language_id.identify(none, nothing).count() == 0 and {r["lang_pred"] for r in language_id.identify(odd, nothing).collect()} == {"und"}


# The pipeline ----------------------------------------------------------------

def test_pipeline(spark, odd, none, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert set(rows.doc_id) <= {r["doc_id"] for r in docs.select("doc_id").collect()} and (rows.bin_used <= rows.capacity).all()
    kept = {r["doc_id"] for r in near_dedup.near_duplicates(docs).where("kept").collect()}
    assert set(rows.doc_id) <= kept
    for start in (odd.drop("score", "probability", "kept"), odd, none):
        state = start
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{id(start)}-{i}")
            stage(spark, state, FOLDER).write.parquet(path)
            after = spark.read.parquet(path)
            if name != "packing":
                assert sorted(after.columns) == sorted(start.columns)
            state = after
