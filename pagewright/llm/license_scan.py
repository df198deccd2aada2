"""Licence scans by canonical digest, in DataFrame functions only.

A text is brought to a canonical form: lower case, without the lines that are
copyright notices (wrapped sentences that go on with "copyright" stay), every run
of punctuation or white space one space, equivalent spellings made one. The digest of the whole form is hash-joined to the digests of known licence
texts; so is the digest of each whole line, which finds the notices that name a
licence within other text. Only lines whose form is as long as some known form
travel; the table of licences may have any size, as Spark chooses the join by it.

Defined results: a null or empty text, or one of copyright lines only, has the
digest of the empty form and no licence; if several known texts have one
canonical form the licence that sorts first counts; repeated rows give repeated
results; rows with null ids are scanned like others; very long texts are read
whole, in one pass for the whole form and one for their lines; an empty table
gives an empty result, an empty table of licences no licence. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm._session import cut, documents
from pagewright.llm.license_texts import LICENSES, SPELLINGS, all_known

#: The SQL's simpler rule: every line that starts so, wrapped sentences too.
_COPYRIGHT = r"(^|\n)[^\p{L}\n©(]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
#: Words that go on with a sentence after "copyright", where a notice would name its holder.
_GO_ON = (
    "holders? owners? notices? laws? and or nor interests? disclaimers? permissions? on licen[cs]es? licen[cs]ed treat(y|ies) statements? ownership of if doctrines? are is was "
    "in to for acts? rights? protections? protected infringements? claims? patents? trademarks? terms polic(y|ies) information status works? materials? under from with which that as at "
    "those also lines? owned headers? assignments? markings? legends? exceptions? restrictions? may shall must can will does do has have not but when where unless"
).replace(" ", "|")
#: A holder is written with a capital; the words above count where a text is all capitals.
_HOLDER = rf"[\s&&[^\n]]*:?[\s&&[^\n]]*((held |owned )?by )?(?!the (software|library|program|work))(the )?(?!({_GO_ON})(?![\p{{L}}\p{{N}}]))(?-i:[\p{{Lu}}\p{{Lt}}\p{{Lo}}])"
_MARKED = r"[^\p{L}\p{N}\n.;\u0022]*(\(c\)|©|[0-9]{4}|y{4}|year)"
#: A line that is a notice: copyright followed by a mark, a year or a holder; a mark and a year; or all rights reserved alone.
_NOTICE = rf"(?i)(^|\n)[^\p{{L}}\n©(]*(©|\(c\)[^\p{{L}}\n]*[0-9]{{4}}|(\(c\)[^\p{{L}}\n]*)?copyright(?![\p{{L}}\p{{N}}-])({_MARKED}|{_HOLDER})|all rights reserved[^\p{{L}}\p{{N}}\n]*(?=\n|$))[^\n]*"
_GAPS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    out = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), _NOTICE, "\n"))
    out = F.concat(F.lit(" "), F.regexp_replace(out, _GAPS, " "), F.lit(" "))
    for spelling, meant in SPELLINGS:
        out = F.replace(out, F.lit(f" {spelling} "), F.lit(f" {meant} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def known(licenses: DataFrame) -> DataFrame:
    """(digest, licence, size) of a table (licence, text); texts whose canonical form is empty are not known."""
    forms = licenses.select("license", canonical(F.col("text")).alias("form")).where("form <> ''")
    return forms.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"), F.max(F.length("form")).alias("size"))


def scan(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """(doc_id, digest, license, notices, n_notices, licensed) for each row of ``docs`` (doc_id, text).

    ``license``: the licence whose text is the whole text; ``notices``: the
    licences, sorted and comma-joined, that whole lines name.
    """
    table = cut(known(licenses))
    sizes = F.array(*(F.lit(r["size"]) for r in table.select("size").distinct().collect())).cast("array<int>")  # no more numbers than a licence has letters
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), canonical), lambda form: F.array_contains(sizes, F.length(form)))
    # Each text is worked off once: only digests and the few lines that are as long as a known text go on.
    rows = cut(docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), lines.alias("lines")))
    named = rows.select("doc_id", F.col("digest").alias("whole"), F.explode("lines").alias("form")).select("doc_id", "whole", F.sha2("form", 256).alias("digest")).join(table.select("digest", "license"), "digest")
    notices = named.groupBy(F.col("doc_id").alias("id"), "whole").agg(F.array_sort(F.collect_set("license")).alias("found")).select("id", "whole", F.array_join("found", ",").alias("notices"), F.size("found").alias("n"))
    out = rows.select("doc_id", "digest").join(table.select("digest", "license"), "digest", "left")
    out = out.join(notices, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("whole")), "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return out.select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"), n.alias("n_notices"), (F.col("license").isNotNull() | (n > 0)).alias("licensed"))


def builtin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(all_known(), "license string, text string")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), builtin(spark))


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '{_COPYRIGHT}', chr(10), 'g')"
    out = f"' ' || regexp_replace({out}, '{_GAPS}', ' ', 'g') || ' '"
    for spelling, meant in SPELLINGS:
        out = f"replace({out}, ' {spelling} ', ' {meant} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP2_SQL = f"""
WITH known AS (
  SELECT sha256(form) AS digest, min(license) AS license
  FROM (SELECT license, {_sql_canonical("text")} AS form FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in LICENSES)}) v(license, text))
  WHERE form <> '' GROUP BY 1),
docs AS (SELECT doc_id, text, sha256({_sql_canonical("text")}) AS digest FROM documents),
lines AS (SELECT doc_id, digest AS whole, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM docs),
notices AS (
  SELECT doc_id, whole, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS notices, count(DISTINCT k.license) AS n
  FROM (SELECT doc_id, whole, {_sql_canonical("line")} AS form FROM lines) l JOIN known k ON sha256(l.form) = k.digest
  WHERE form <> '' GROUP BY 1, 2)
SELECT d.doc_id, d.digest, k.license, coalesce(n.notices, '') AS notices, CAST(coalesce(n.n, 0) AS BIGINT) AS n_notices,
       k.license IS NOT NULL OR coalesce(n.n, 0) > 0 AS licensed
FROM docs d LEFT JOIN known k ON d.digest = k.digest
LEFT JOIN notices n ON d.doc_id IS NOT DISTINCT FROM n.doc_id AND d.digest = n.whole
"""
