"""From raw documents to packed training sequences: five stages over whole tables.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import dedup, language, packing, pii, toxicity
from factloom.llm.common import materialise, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents predicted toxic go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents in no language known here go."""
    return language.keep_known(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the first document of each group of near-duplicates stays."""
    return dedup.one_of_each(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: personal data gives way to surrogates; n_chars follows the text."""
    return pii.protect(docs, pii.session_key(spark)).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: pieces of documents with their places in the training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

#: Trained scores, hashing and tokens are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
