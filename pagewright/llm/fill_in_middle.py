"""Fill-in-the-middle: texts cut at units and written with the middle last.

A text is held as its maximal runs of one character class, each with the number
of units that end up to and with it (cumulative). Where the first ``u`` units end
is found by binary search of the run that holds the u-th unit's end; the offset
within the run is arithmetic: the units of a run end at equal steps. For lines
the classes are newline and not newline: each newline ends a unit, and what is
left at a text's end is one more. For words they are white space and the rest:
each run of the rest ends a unit, and so does white space at a text's end.

Cuts are chosen by hashes of the id alone, so equal ids get equal choices.

Defined results: a null text is an empty one, which is ``plain``, as is one that
holds a sentinel; a null id counts as the empty text where an id decides;
repeated rows give repeated results; a text of any length is cut whole; both
cuts may fall on one place, at the start or at the end, and leave parts empty;
an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm._session import documents
from pagewright.llm._text import SPACE, buffers, chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
UNITS = ("line", "word")


@dataclass(frozen=True)
class Runs:
    """The runs of a column of texts: where each starts, how far apart its units end, and how many units end before it."""

    start: np.ndarray
    step: np.ndarray
    before: np.ndarray  # one entry more than runs
    first: np.ndarray  # runs of text t are those from first[t] to first[t + 1]
    offsets: np.ndarray

    def units(self) -> np.ndarray:
        """Units of each text."""
        return self.before[self.first[1:]] - self.before[self.first[:-1]]

    def ends(self, units: np.ndarray) -> np.ndarray:
        """Where the first ``units[t]`` units of each text end, in bytes of the column."""
        wanted = self.before[self.first[:-1]] + units
        run = np.searchsorted(self.before, wanted) - 1  # the run that has the wanted unit's end
        inside = units > 0
        run = np.where(inside, run, 0)
        if not len(self.start):
            return self.offsets[:-1].copy()
        return np.where(inside, self.start[run] + (wanted - self.before[run]) * self.step[run], self.offsets[:-1])


def runs(data: np.ndarray, offsets: np.ndarray, unit: str = "line") -> Runs:
    """The class runs of texts that lie one after the other in ``data``."""
    table = NEWLINE if unit == "line" else ~SPACE
    marked = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = marked[1:] != marked[:-1]
    edge[offsets] = True
    start = np.flatnonzero(edge[:-1])
    length = np.diff(np.append(start, len(data)))
    ending = marked[start]
    # Each newline ends a line; a run of other characters ends one word.
    own = np.where(ending, length if unit == "line" else 1, 0)
    last = np.isin(start + length, offsets)
    own = np.where(last & ~ending, 1, own)
    step = np.where(ending & (unit == "line"), 1, length)
    return Runs(start, step, np.concatenate([[0], np.cumsum(own)]), np.searchsorted(start, offsets), offsets)


def _write(unit: str, sentinels: tuple[str, str, str]) -> Callable:
    """Texts of a batch (own columns first, then text, share, order, one, two), cut and written."""
    p, s, m = (x.encode() for x in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets, _ = buffers(part.column(part.schema.get_field_index("text")))
                told = runs(data, offsets, unit)
                n = told.units()
                take = lambda name: np.asarray(part.column(part.schema.get_field_index(name)))  # noqa: E731, B023
                cuts = np.sort(np.stack([take("one") % (n + 1), take("two") % (n + 1)]), axis=0)
                one, two = told.ends(cuts[0]), told.ends(cuts[1])
                chosen, spm = take("chosen"), take("spm")
                raw = data.tobytes()
                forms, counts, written = [], [], []
                for i in range(part.num_rows):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    text = raw[a:b]
                    if not text or not chosen[i] or p in text or s in text or m in text:
                        forms.append("plain"), counts.append((None, None)), written.append(text)
                        continue
                    prefix, middle, suffix = raw[a : one[i]], raw[one[i] : two[i]], raw[two[i] : b]
                    forms.append("spm" if spm[i] else "psm")
                    counts.append((len(prefix.decode()), len(middle.decode())))
                    written.append(b"".join((s, suffix, p, prefix, m, middle) if spm[i] else (p, prefix, s, suffix, m, middle)))
                yield pa.record_batch(
                    {
                        "doc_id": part.column(0), "n": pa.array(n, pa.int64()), "form": pa.array(forms, pa.string()),
                        "prefix_chars": pa.array([c[0] for c in counts], pa.int64()), "middle_chars": pa.array([c[1] for c in counts], pa.int64()),
                        "output": pa.array(written, pa.binary()).cast(pa.string()),
                    }
                )

    return run


def fill_in_middle(docs: DataFrame, *, salt: str = "7:", percent: int = 100, spm_percent: int = 50, unit: str = "line", sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of ``docs`` (doc_id, text).

    ``percent`` of the documents are cut, of these ``spm_percent`` with the suffix
    first. Sentinels must not end as another begins, so that ``restored`` is exact.
    """
    if unit not in UNITS:
        raise ValueError(f"a unit is one of {UNITS}")
    for x in sentinels:
        if not x or any(x != y and x in y or any(x[i:] == y[: len(x) - i] for i in range(1, len(x))) for y in sentinels):
            raise ValueError("sentinels overlap")
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    group = lambda i: F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long")
    asked = docs.select("doc_id", "text", digest.alias("digest"))
    asked = asked.select("doc_id", "text", group(0).alias("one"), group(1).alias("two"), (group(2) % 100 < percent).alias("chosen"), (group(3) % 100 < spm_percent).alias("spm"))
    return asked.mapInArrow(_write(unit, sentinels), f"doc_id {dict(docs.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output of a form was written from."""
    p, s, m = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands behind each of the three sentinels."""
        one = F.locate(second, output)
        two = F.locate(m, output)
        return (
            F.substring(output, F.lit(len(first) + 1), one - 1 - len(first)),
            F.substring(output, one + len(second), two - one - len(second)),
            F.substring(output, two + len(m), F.char_length(output)),
        )

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(documents(spark, sf_dir))
    text = restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u
  FROM documents),
g AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM g),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix
  FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
