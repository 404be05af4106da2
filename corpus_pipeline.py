"""From raw documents to packed token sequences, one operator a stage.

Every stage takes the documents that the one before has kept, and all but the last return
them with the columns they came with.  Each handles null, empty, very long and repeated
texts and empty tables as its operator's module says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import language_id, line_frequency, minhash, packing, substring_dedup
from auditloom.llm.common import ready, stored, table


def _measured(docs: DataFrame) -> DataFrame:
    """With the lengths of texts that may have changed."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without letters, or far from their profile, go.

    Far is a score under the one that 0.5 % of a language's labelled documents stay under
    (``language_id.above_bar``).  A missing label is filled with the prediction.  Where no
    document is labelled there is nothing to compare with, and all documents with letters
    stay.
    """
    ready(spark)
    learned = language_id.train(docs)
    if not learned[0]:
        return docs.filter(F.col("text").rlike("\\p{L}"))
    return language_id.above_bar(docs, learned)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without boilerplate lines."""
    ready(spark)
    return _measured(line_frequency.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand in a document of smaller id."""
    return _measured(substring_dedup.without_repeats(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of one length."""
    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("packing", packed),
]

#: Language profiles and tokens are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
