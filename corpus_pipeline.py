"""From raw documents to packed training sequences, stage by stage.

Every stage reads what its predecessor kept, as Parquet, and decides with one
operator of the llm subpackage; all but the last return the columns of
``documents``, extra ones too, whatever their names. Stages give an empty result
for an empty table, treat rows that repeat alike, use whole texts of any length,
and decide ties as their operators do.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import language_id, mixing, near_dedup, packing, pii
from pagewright.llm._session import not_remainder
from pagewright.shared import shared_folder

#: Texts whose language is less sure go.
LEAST_SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, by a model of those whose id is not held out.

    Null, empty and letterless texts have none and go, as do those as likely in
    another language as in the one told.
    """
    model = language_id.train(docs.where(not_remainder("doc_id", language_id.MODULUS, language_id.HELD_OUT)))
    names = ["text" if c == "text" else f"column_{i}" for i, c in enumerate(docs.columns)]  # so that none is taken for a result
    told = language_id.identify(docs.toDF(*names), model)
    return told.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SURE)).select(*names).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest key.

    Rows are told apart by their ids; those that share an id or have none by their
    texts (``near_dedup.keyed``), so different texts with one id are documents of
    their own. Null and empty texts are linked with nothing; of those with one id
    in common (or none) one stays.
    """
    keyed = near_dedup.keyed(docs)
    kept = near_dedup.near_duplicates(keyed).where("kept").select("doc_id")
    return keyed.join(kept, "doc_id", "left_semi").select("row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind; null and empty texts as they are."""
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have their target weights.

    Nulls in a dimension are a value of their own; equal ids get equal decisions.
    """
    measured = docs.select(F.struct("*").alias("row"), "doc_id", "source", "lang", mixing.topic(F.col("text")).alias("topic"), mixing.n_words(F.col("text")).alias("n_tokens"))
    return mixing.mix(measured, ["source", "lang", "topic"], "n_tokens").where("sampled").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens lie in sequences of the permitted lengths; a null or empty text has an end only."""
    return packing.pack(docs.select("doc_id", mixing.n_words(F.col("text")).alias("n_tokens")), "n_tokens")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what stands between two lies in the shared checkpoint folder until the second is written."""
    base = posixpath.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{i - 1}-{STAGES[i - 1][0]}")
            before.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(before, True)
    return docs
