"""Fill-in-the-middle against regular expressions and whole strings."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm.fill_in_middle import fill_in_middle, op12_fill_in_middle, restored, runs
from pagewright.llm._text import buffers

FOLDER = "/root/testdata/sf0.001"
PATTERN = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"}


def plain(doc_id, text, unit="line", p="<P>", s="<S>", m="<M>", percent=100):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall(PATTERN[unit], text)
    assert "".join(units) == text
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or p in text or s in text or m in text or h3 % 100 >= percent:
        return n, "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 50:
        return n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


def texts(seed=5):
    r = random.Random(seed)
    made = ["".join(r.choice("ab é\n\n\t中😀<") for _ in range(r.randrange(30))) for _ in range(300)]
    return [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "x <P> y\nz", "a<S", "<M", "\n" * 5000 + "end", *made, "long line " * 30000 + "\n" + "é\n" * 20000]


def test_ends_of_units_by_arithmetic():
    own = texts()
    data, offsets, _ = buffers(pa.array(own, pa.string()))
    for unit, pattern in PATTERN.items():
        told = runs(data, offsets, unit)
        units = [re.findall(pattern, t or "") for t in own]
        assert told.units().tolist() == [len(u) for u in units]
        for share in (0, 0.3, 0.7, 1):
            upto = np.array([int(len(u) * share) for u in units])
            wanted = [len("".join(u[:k]).encode()) for u, k in zip(units, upto, strict=True)]
            assert (told.ends(upto) - offsets[:-1]).tolist() == wanted


@pytest.mark.parametrize("unit", ["line", "word"])
def test_equals_strings_and_restores(spark, unit):
    rows = [*enumerate(texts()), (None, "no id\nhere"), (7, "again\nand again"), (7, "again\nand again")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, form string, n int")  # clashing names
    done = fill_in_middle(docs, unit=unit).withColumn("back", restored(F.col("output"), F.col("form")))
    found = sorted((repr((r.doc_id, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.back)) for r in done.collect()))
    assert found == sorted(repr((i, plain(i, t, unit), t or "")) for i, t in rows)
    assert {r.form for r in done.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_query_equals_strings(spark):
    own = {r.doc_id: r for r in op12_fill_in_middle(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert len(own) == len(docs)
    for d in docs:
        n, form, a, b, output = plain(d.doc_id, d.text)
        assert tuple(own[d.doc_id]) == (d.doc_id, n, form, a, b, sha(output), sha(d.text or ""))


def test_share_of_documents_and_other_sentinels(spark):
    docs = spark.createDataFrame([(i, f"one\ntwo {i}\nthree") for i in range(400)], "doc_id long, text string")
    done = fill_in_middle(docs, percent=30, sentinels=("[pre]", "(suf)", "{mid}")).collect()
    wanted = [plain(i, f"one\ntwo {i}\nthree", "line", "[pre]", "(suf)", "{mid}", 30) for i in range(400)]
    assert sorted((r.doc_id, r.form, r.output) for r in done) == [(i, w[1], w[4]) for i, w in enumerate(wanted)]
    assert 80 < sum(r.form != "plain" for r in done) < 160
    for bad in (("<a>", "<a>x", "<b>"), ("aba", "<s>", "<m>"), ("", "<s>", "<m>"), ("xy", "yz", "<m>")):
        with pytest.raises(ValueError, match="sentinels"):
            fill_in_middle(docs, sentinels=bad)


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
