"""The Merkle manifest against trees built in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagewright.llm.merkle import document_leaves, fold, judged, manifest, op11_merkle_manifest

FOLDER = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc, text):
    fields = (doc[0], doc[1], doc[2], doc[3], text)
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(leaves, fanout):
    """(root, for each leaf the (before, behind) digests of its path)."""
    levels, paths = [leaves], [[] for _ in leaves]
    where = list(range(len(leaves)))
    while len(levels[-1]) > 1:
        rows = levels[-1]
        for i, at in enumerate(where):
            first = at // fanout * fanout
            paths[i].append((rows[first:at], rows[at + 1 : first + fanout]))
        where = [at // fanout for at in where]
        levels.append([sha("".join(rows[i : i + fanout])) for i in range(0, len(rows), fanout)])
    return levels[-1][0], paths


def plain(docs, fanout=3):
    groups = defaultdict(list)
    for d in docs:
        text = d[4]
        bare = text.replace("\n", "") if text is not None and d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0 else text
        groups[d[1]].append((d[0] is not None, d[0] or 0, leaf_of(d, text), leaf_of(d, bare), d[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: tree([r[2] for r in sorted(groups[g])], fanout) for g in names}
    root, tops = tree([subs[g][0] for g in names], fanout) if names else (None, [])
    out = []
    for g, top in zip(names, tops, strict=True):
        for row, path in zip(sorted(groups[g]), subs[g][1], strict=True):
            f = row[3]
            for before, behind in path + top:
                f = sha("".join([*before, f, *behind]))
            proof = sha("".join(x for before, behind in path + top for x in (*before, *behind)))
            out.append((row[4], row[2], subs[g][0], root, proof, f, f == root))
    return sorted(map(repr, out))


def rows_of(spark, docs, **options):
    made = manifest(document_leaves(docs), **options)
    subs = {r["grp"]: r["root"].hex() for r in made.subroots.collect()}
    return sorted(repr((r.key, r.leaf, subs[r.grp], made.root, r.proof_sha256, r.folded_root, r.verified)) for r in judged(made).collect())


def table(n=90):
    r = random.Random(3)
    made = [(i, r.choice(["a", "b", "é", None, "a", "a"]), r.choice(["en", None]), r.choice([None, 5]), r.choice([None, "", "x\ny", "no line", "\n", "中\n"])) for i in range(n)]
    return [*made, (None, "a", None, None, None), (None, "a", "en", 1, "x\n"), (5, "a", "en", 2, "other"), (7, "b", "en", 2, "same\n"), (7, "b", "en", 2, "same\n"), (8, "alone", "en", 3, "long\n" * 100000)]


@pytest.mark.parametrize(("fanout", "height"), [(3, 6), (3, 1), (2, 2), (4, 1), (16, 2)])
def test_equals_plain_trees(spark, fanout, height):
    own = table()
    docs = spark.createDataFrame([(*d, 1, 2) for d in own], "doc_id long, source string, lang string, n_chars long, text string, grp int, path int")  # clashing names
    assert rows_of(spark, docs.repartition(3), fanout=fanout, height=height) == plain(own, fanout)


def test_query_equals_plain_trees(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    found = op11_merkle_manifest(spark, FOLDER)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = found.collect()
    assert sorted(repr(tuple(r)) for r in rows) == plain([tuple(d) for d in docs.collect()])
    assert {r.verified for r in rows} == {True, False}


def test_empty_and_single(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    made = manifest(document_leaves(spark.createDataFrame([], schema)))
    assert made.root is None and judged(made).collect() == []
    one = [(1, "s", "en", 1, "a")]
    assert rows_of(spark, spark.createDataFrame(one, schema)) == plain(one)
    assert fold(b"0" * 64, b"") == b"0" * 64
    for bad in ({"fanout": 1}, {"height": 0}):
        with pytest.raises(ValueError, match="fanout"):
            manifest(document_leaves(spark.createDataFrame(one, schema)), **bad)


def test_any_change_is_seen(spark):
    docs = spark.createDataFrame([(i, "s", "en", 3, f"text {i}") for i in range(40)], "doc_id long, source string, lang string, n_chars long, text string")
    before = manifest(document_leaves(docs)).root
    for c, value in (("text", "x"), ("lang", None), ("n_chars", 4), ("source", "t")):
        other = docs.withColumn(c, F.when(F.col("doc_id") == 17, F.lit(value)).otherwise(F.col(c)))
        assert manifest(document_leaves(other)).root != before
    assert manifest(document_leaves(docs.repartition(7))).root == before
