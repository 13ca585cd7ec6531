"""Search over texts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import fold
from factloom.sources.shared import materialise

#: Saturation of a word's count, and weight of the text's length.
K1, B = 1.2, 0.75
#: Folders that an index deals its words to.
BUCKETS = 256


def bm25(docs: DataFrame, id_col: str, text: str, query: str, k: int) -> DataFrame:
    """(id, score) of the k texts that answer a query best by BM25, ties to the smaller id.

    Each text is folded and split once; its length and counts of the query's words are written, and what the corpus has
    of them is one row of as many numbers as the query has words.
    """
    terms = list(dict.fromkeys(query.lower().split()))
    split = docs.select(F.col(id_col), F.split(fold(F.col(text)), " ").alias("_words"))
    counts = [(F.size("_words") - F.size(F.array_remove("_words", t))).alias(f"_tf{i}") for i, t in enumerate(terms)]
    rows = materialise(split.select(id_col, F.size("_words").alias("_len"), *counts))
    known = rows.agg(F.count("*").alias("n"), F.avg("_len").alias("mean"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    score, mean = F.lit(0.0), float(known["mean"] or 1.0)
    for i in range(len(terms)):
        tf, df = F.col(f"_tf{i}"), known[f"df{i}"]
        score += F.ln(F.lit(1 + (known["n"] - df + 0.5) / (df + 0.5))) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / mean))
    found = rows.where(" or ".join(f"_tf{i} > 0" for i in range(len(terms)))).select(id_col, score.alias("score"))
    return found.orderBy(F.desc("score"), id_col).limit(k)


def _bucket(word):
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def write_index(docs: DataFrame, id_col: str, text: str, folder: str) -> None:
    """Postings (word, id, tf, len) in a folder for each bucket of words, and the number and mean length of the texts.

    Rows are dealt by range of bucket, word and id, so a word that most texts have fills several files. Null texts
    aren't indexed; a folder is written once.
    """
    split = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.split(fold(F.col(text)), " ").alias("words")).withColumn("len", F.size("words"))
    postings = split.select("id", "len", F.explode("words").alias("word")).groupBy("id", "word", "len").agg(F.count("*").cast("int").alias("tf"))
    postings.withColumn("bucket", _bucket("word")).repartitionByRange("bucket", "word", "id").sortWithinPartitions("bucket", "word", "id").write.partitionBy("bucket").parquet(f"{folder}/postings")
    read = docs.sparkSession.read.parquet(f"{folder}/postings")
    read.select("id", "len").distinct().agg(F.count("*").alias("n"), F.avg("len").alias("mean")).write.parquet(f"{folder}/corpus")


def search_index(spark: SparkSession, folder: str, query: str, k: int, other: DataFrame | None = None, weight: float = 0.0) -> DataFrame:
    """(id, score) of the k texts that answer a query best, read from the postings of its words alone.

    ``other`` (id, other) is a second score from 0 to 1; it counts with its weight and BM25, as a share of the best, with
    the rest. Ties go to the smaller id.
    """
    terms = list(dict.fromkeys(w for w in fold_words(spark, query)))
    buckets = {r[0] for r in spark.createDataFrame([(t,) for t in terms], "word string").select(_bucket("word")).collect()} if terms else set()
    postings = spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin(*buckets) & F.col("word").isin(*terms))
    corpus = spark.read.parquet(f"{folder}/corpus").first()
    counts = {r.word: r.df for r in postings.groupBy("word").agg(F.count("*").alias("df")).collect()}  # a row for each word of the query
    weights = [F.when(F.col("word") == t, F.lit(math.log(1 + (corpus["n"] - df + 0.5) / (df + 0.5)))) for t, df in counts.items()]
    idf = F.coalesce(*weights, F.lit(0.0))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (corpus["mean"] or 1.0)))
    found = postings.groupBy("id").agg(F.sum(part).alias("score"))
    if other is not None:
        top = found.agg(F.max("score")).first()[0] or 1.0
        found = found.join(other.select("id", "other"), "id", "left").select("id", ((1 - weight) * F.col("score") / top + weight * F.coalesce("other", F.lit(0.0))).alias("score"))
    return found.orderBy(F.desc("score"), "id").limit(k)


def fold_words(spark: SparkSession, text: str) -> list[str]:
    """The words of one text of the driver's, folded as texts are."""
    return [w for w in spark.range(1).select(F.split(fold(F.lit(text)), " ")).first()[0] if w]
