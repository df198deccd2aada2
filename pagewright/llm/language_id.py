"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A
text's likelihood under a language sums over all segmentations of its words
into pieces (forward algorithm); the language with the highest likelihood wins.

Words of a batch of texts are told apart by 64-bit hashes (two of n distinct ones
are taken for one with probability below n**2 / 2**65). Any number of languages: each takes a quarter of a megabyte of the model, in the
driver and in each worker, and nothing else grows with their number.

Defined results: a text that is null, empty or without a letter is ``und`` with
score 0; ties go to the language that sorts first; rows with null ids are scored
like others, and count as the empty text where an id decides; repeated rows give
repeated results; a very long text is scored whole, and a very long word of it
position by position with the same sums; with no labelled row at all every text
is ``und``; an empty table gives an empty result. Columns of the input other than
``text`` pass through; an input column named like a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm._lattice import Lattice, load_pieces, rank_scores
from pagewright.llm._pieces import fit, words_of
from pagewright.llm._session import cut, documents, not_remainder, partitions, unit_hash
from pagewright.llm._text import LOWER, Words, buffers, chunks

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNDETERMINED = "und"
MODULUS, HELD_OUT = 3, 1


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    lattice: Lattice
    logp: np.ndarray  # pieces x languages


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            group = np.asarray(part.column(0))
            data, offsets, _ = buffers(part.column(1))
            data = LOWER[data]
            words = Words(data, offsets)
            if not len(words.hash):
                continue
            of = group[words.doc]
            for g in np.unique(of):
                own = np.flatnonzero(of == g)
                _, first, n = np.unique(words.hash[own], return_index=True, return_counts=True)
                at = own[first]
                yield pa.record_batch({"grp": pa.array(np.full(len(n), g), pa.int32()), "word": words_of(data, words.start[at], words.end[at]).cast(pa.binary()), "n": pa.array(n, pa.int64())})


def train(docs: DataFrame, *, vocabulary: str = VOCABULARY, sample_docs: int = 2000, iterations: int = 3, prior: float = 0.1) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of ``docs`` (columns doc_id, text, lang).

    The classifier is fitted on a sample of labelled rows whose bound is
    ``sample_docs``, the expected number of documents of each language, picked by
    a hash of the id; sampled texts are used whole.
    """
    spark = docs.sparkSession
    labelled = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    languages = sorted(sizes)
    pieces, ranks = load_pieces(vocabulary)
    lattice = Lattice(pieces)
    if not languages:
        return LanguageModel([], lattice, np.zeros((len(pieces), 0)))
    share = spark.createDataFrame([(x, i, min(1.0, sample_docs / sizes[x])) for i, x in enumerate(languages)], "lang string, grp int, share double")
    sample = labelled.join(F.broadcast(share), "lang").where(unit_hash("doc_id", "sample") < F.col("share")).select("grp", "text")
    counts = cut(sample.mapInArrow(_count_words, "grp int, word binary, n long").groupBy("grp", "word").agg(F.sum("n").alias("n")).repartition(partitions(spark)))
    logp = fit(counts, lattice, len(languages), rank_scores(ranks), iterations=iterations, prior=prior)
    return LanguageModel(languages, lattice, np.ascontiguousarray(logp.T))


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; only texts without a Latin one are decoded."""
    lower = data | 32
    latin = (lower >= 97) & (lower <= 122) & (data < 128)
    total = np.concatenate([[0], np.cumsum(latin)])
    found = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return found


def _predict(model: LanguageModel, drop_text: bool) -> Callable:
    names = np.array([*model.languages, UNDETERMINED], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets, _ = buffers(part.column(part.schema.get_field_index("text")))
                letters = has_letter(data, offsets)
                words = Words(low := LOWER[data], offsets)
                n, g = part.num_rows, len(model.languages)
                best, score = np.full(n, g), np.zeros(n)
                if g and len(words.hash):
                    _, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
                    value = model.lattice.score(low, words.start[first], words.end[first], model.logp)
                    likely = np.stack([np.bincount(words.doc, value[which, k], n) for k in range(g)], axis=1)
                    top = likely.argmax(axis=1)
                    sure = 1 / np.exp(likely - likely[np.arange(n), top][:, None]).sum(axis=1)
                    best, score = np.where(letters, top, g), np.where(letters, sure, 0.0)
                keep = [i for i, f in enumerate(part.schema) if not (drop_text and f.name == "text")]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(names[best], pa.string()), pa.array(score)], [*(part.schema.field(i).name for i in keep), "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: LanguageModel, *, drop_text: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior probability of that language."""
    docs = docs.drop("lang_pred", "score")
    fields = [f for f in docs.schema.fields if not (drop_text and f.name == "text")]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_predict(model, drop_text), schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learns = not_remainder("doc_id", MODULUS, HELD_OUT)
    model = train(docs.where(learns))
    rows = docs.select("doc_id", (~learns).alias("held_out"), "text")
    return identify(rows, model, drop_text=True)
