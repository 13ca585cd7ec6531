"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence give one posterior: the likelihood of the text's byte trigrams, the declared language, the
suffix of the address, and a prior for the host. How far declarations and suffixes can be trusted and what a host
writes in is counted over the whole corpus by grouped aggregation; a host's prior is smoothed towards that of its site,
and the site's towards the corpus. Counts are expected ones, from the text alone and without the row itself, so nothing
is believed twice. One class stands for no language known here: its texts are made of trigrams that the models haven't
seen. A text for which it is the most probable class after all evidence is of language "und".
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import materialise, table, text_batches
from factloom.llm.html import Page, host_of

#: Documents that the trigram models are fitted on, about, and the fewest for a language; and how many texts of a
#: language are drawn at least, about, or all that it has. Of a text longer than LONGEST, STRETCHES from all over it.
SAMPLE, LEAST, EACH = 6_000, 5, 100
LONGEST, STRETCHES = 20_000, 8
BINS = 1 << 16
#: A text's trigrams count as so many independent ones at most, since neighbours repeat each other.
INDEPENDENT = 60
#: Weight of what a level inherits from the level above, in documents.
INHERITED = 20.0
#: Shares of unseen trigrams in a language known here and in others; of so many trigrams one counts, for neighbours are
#: unseen together; and how often a text is in another language, before anything is counted.
UNSEEN_KNOWN, UNSEEN_OTHER, TOGETHER, OTHER = 0.3, 0.9, 4, 1e-3
UNKNOWN = "und"
BLOCK = 1 << 20

_LETTERS = np.full(256, 32, dtype=np.uint32)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[97:123] = np.arange(97, 123)


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Bins of the byte trigrams of a text's words with a space around each, in blocks."""
    raw = _LETTERS[np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8)]
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    b = raw[keep]
    for at in range(0, max(1, len(b) - 2), BLOCK):
        part = b[at : at + BLOCK + 2]
        h = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]
        yield (h * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)


@dataclass
class Trigrams:
    """Log probability of each bin in each language, and the bins that no two texts have."""

    languages: list[str]
    table: np.ndarray
    unseen: np.ndarray

    def score(self, text: str) -> list[float]:
        """Tempered log likelihoods of the languages, and of none of them, above the likeliest language's."""
        total, n, odd = np.zeros(len(self.languages)), 0, 0
        for bins in trigrams(text):
            total += self.table[:, bins].sum(axis=1)
            n += len(bins)
            odd += int(self.unseen[bins].sum())
        if not n:
            return [0.0] * (len(total) + 1)
        total *= min(1.0, INDEPENDENT / n)
        share = odd / n
        told = share * np.log(UNSEEN_OTHER / UNSEEN_KNOWN) + (1 - share) * np.log((1 - UNSEEN_OTHER) / (1 - UNSEEN_KNOWN))
        return [*(total - total.max()).tolist(), float(min(n / TOGETHER, INDEPENDENT) * told)]


def fit(texts: list[str], languages: list[str]) -> Trigrams:
    """Models of the languages that have enough texts, add-one smoothed."""
    names = sorted(k for k in set(languages) if languages.count(k) >= LEAST)
    counts, holders = np.zeros((len(names), BINS)), np.zeros(BINS)
    for text, name in zip(texts, languages):
        if name in names:
            row = sum((np.bincount(bins, minlength=BINS) for bins in trigrams(text)), np.zeros(BINS))
            counts[names.index(name)] += row
            holders += row > 0
    unseen = holders < 2  # one text may be in any language
    counts += 0.5
    return Trigrams(names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32), unseen)


def evidence(docs: DataFrame, text: str, declared: Column, host: Column, suffix: Column) -> DataFrame:
    """Name the evidence of each row; what is absent is an empty string. Clashing columns keep their own names."""
    site = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return docs.withColumns({
        "_text": F.coalesce(F.col(text), F.lit("")),
        "_declared": F.coalesce(F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})\b", 1)), F.lit("")),
        "_host": F.coalesce(host, F.lit("")),
        "_site": F.coalesce(F.when(site != "", site).otherwise(host), F.lit("")),
        "_suffix": F.coalesce(suffix, F.lit("")),
    })


def stretches(text: Column) -> Column:
    """The text, or of a long one as much as LONGEST in stretches at equal distances."""
    n, size = F.length(text), LONGEST // STRETCHES
    parts = [F.substring(text, (n * i / STRETCHES).cast("int") + 1, F.lit(size)) for i in range(STRETCHES)]
    return F.when(n <= LONGEST, text).otherwise(F.concat_ws(" ", *parts))


def train(rows: DataFrame) -> Trigrams:
    """Fit on a bounded sample of each language's rows, drawn by a hash of the text.

    Which languages there are is counted over all rows that declare one, so a rare one has its model in any corpus.
    """
    known = rows.where("_declared <> ''").select("_text", "_declared")
    texts = known.groupBy("_declared").agg(F.count("*").alias("rows"), F.approx_count_distinct(F.xxhash64("_text")).alias("texts")).collect()
    share = SAMPLE / max(1, sum(r["rows"] for r in texts))
    rates = [(r["_declared"], int(min(1.0, max(share, EACH / max(1, r["texts"]))) * (1 << 20))) for r in texts]
    rates = rows.sparkSession.createDataFrame(rates, "_declared string, _rate int")
    drawn = known.join(F.broadcast(rates), "_declared")  # a row for each language
    drawn = drawn.where(F.pmod(F.xxhash64("_text"), F.lit(1 << 20)) < F.col("_rate"))
    drawn = drawn.select(stretches(F.col("_text")).alias("_text"), "_declared").distinct().collect()
    drawn.sort()
    return fit([r[0] for r in drawn], [r[1] for r in drawn])


def scored(rows: DataFrame, model: Trigrams, kept: list[str]) -> DataFrame:
    """The kept columns and the evidence, the text replaced by _scores: of the languages, and of none of them."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.table, model.unseen))
    columns = [*kept, "_declared", "_host", "_site", "_suffix"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Trigrams(*shared.value)
        for batch in parts:
            scores = pa.array([own.score(t) for t in batch.column(len(columns)).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], scores], names=[*columns, "_scores"])

    text_batches(spark)
    schema = rows.select(*columns).schema.add("_scores", T.ArrayType(T.DoubleType()))
    return rows.select(*columns, "_text").mapInArrow(batches, schema)


def _normal(logs: Column) -> Column:
    top = F.array_max(logs)
    likely = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(likely, F.lit(0.0), lambda a, b: a + b)
    return F.transform(likely, lambda x: x / total)


def _added(size: int, column: str) -> Column:
    return F.array(*[F.sum(F.col(column)[i]) for i in range(size)])


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0.0)))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def identify(rows: DataFrame, kept: list[str], model: Trigrams | None = None) -> DataFrame:
    """The kept columns with _lang and _posterior of each row of evidence(); repeated rows stay.

    Every text is scored once and its scores are written; from then on no text moves. Expected counts by host, site,
    declaration and suffix are summed per task before the shuffle, so a hot host is one row of them per task, and each
    row meets those of its own values without its own share. _lang is null where no language could be learned; empty
    texts are what their other evidence says; of classes equally probable the first by name is taken, "und" last.
    """
    model = model or train(rows)
    names = [*model.languages, UNKNOWN]
    if len(names) == 1:
        return rows.select(*kept, F.lit(None).cast("string").alias("_lang"), F.lit(0.0).alias("_posterior"))
    size = len(names)
    start = F.array(*[F.lit(0.0)] * (size - 1), F.lit(float(np.log(OTHER))))
    found = materialise(scored(rows, model, kept).withColumn("_p", _normal(_plus(F.col("_scores"), start))))
    counts = materialise(found.groupBy("_host", "_site", "_declared", "_suffix").agg(_added(size, "_p").alias("_n")))
    corpus = counts.agg(_added(size, "_n").alias("n")).first().n  # a row of as many numbers as languages
    overall = F.array(*[F.lit(float(x or 0.0)) for x in corpus])
    by = lambda name, *keys: counts.groupBy(*keys).agg(_added(size, "_n").alias(name))
    hosts = by("_host_n", "_host", "_site").join(by("_site_n", "_site"), "_site")
    full = found.join(materialise(hosts), ["_host", "_site"])
    for key in ("_declared", "_suffix"):
        full = full.join(materialise(by(f"{key}_n", key)), key)
    own = F.col("_p")
    rest = _minus(overall, own)
    smooth = lambda n, above: F.zip_with(n, above, lambda x, q: (x + INHERITED * q) / (_total(n) + INHERITED))
    flat = F.transform(rest, lambda x: (x + 1.0) / (_total(rest) + size))
    full = full.withColumn("_logs", F.col("_scores")).withColumn("_flat", flat)
    full = full.withColumn("_site_prior", smooth(_minus(F.col("_site_n"), own), F.col("_flat")))
    full = full.withColumn("_logs", _plus(F.col("_logs"), F.transform(smooth(_minus(F.col("_host_n"), own), F.col("_site_prior")), lambda x: F.log(x))))
    for key in ("_declared", "_suffix"):
        value = _minus(F.col(f"{key}_n"), own)
        share = _total(F.col(f"{key}_n")) / float(sum(x or 0.0 for x in corpus) or 1.0)
        # log P(value | language): a value seldom seen says little, and an empty one nothing
        weight = F.when(F.col(key) == "", 0.0).otherwise(_total(value) / (_total(value) + INHERITED))
        likely = F.zip_with(value, rest, lambda n, a: weight * F.log((n + INHERITED * share) / (a + INHERITED)))
        full = full.withColumn("_logs", _plus(F.col("_logs"), likely))
    full = full.withColumn("_posteriors", _normal(F.col("_logs"))).withColumn("_posterior", F.array_max("_posteriors"))
    lang = F.element_at(F.array(*map(F.lit, names)), F.array_position("_posteriors", F.col("_posterior")).cast("int"))
    return full.select(*kept, lang.alias("_lang"), "_posterior")


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents declare `lang` and come from `source`; a source that is no host name has no suffix."""
    source = F.lower("source")
    return evidence(docs, "text", F.col("lang"), source, F.regexp_extract(source, r"\.([a-z]+)$", 1))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages: the main text, the language of the markup, the host and the last label of its name."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [Page(h or "").plain_text() for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["page_id", "url", "html", "main_text"])

    text_batches(pages.sparkSession)
    schema = pages.select("page_id", "url", "html").schema.add("main_text", T.StringType())
    found = pages.select("page_id", "url", "html").mapInArrow(batches, schema)
    declared = F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return evidence(found, "main_text", declared, host_of(), F.regexp_extract(host_of(), r"\.([a-z]+)$", 1))


def row_key() -> Column:
    """A hash of what the verdict on a document depends on."""
    return F.xxhash64("text", "lang", "source")


def keep_known(docs: DataFrame) -> DataFrame:
    """Documents, with their own columns, unless the fused posterior says that they are in no language known here.

    Only the keys of those that go meet the documents again. Null and empty texts stay unless all other evidence is of
    unknown languages; repeated rows stay or go together.
    """
    key = "_key"
    while key in docs.columns:
        key += "_"
    verdicts = identify(document_evidence(docs.select(row_key().alias("_key"), "text", "lang", "source")), ["_key"])
    gone = materialise(verdicts.where(F.col("_lang") == UNKNOWN).select(F.col("_key").alias(key)).distinct())
    return docs.withColumn(key, row_key()).join(gone, key, "left_anti").select(*docs.columns)


def op1_language_id(spark, sf_dir):
    found = identify(document_evidence(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")), ["doc_id"])
    return _verdicts(found, "doc_id")


def op1_language_id_pages(spark, sf_dir):
    return _verdicts(identify(page_evidence(table(spark, sf_dir, "pages")), ["page_id", "url"]), "page_id", "url")


def _verdicts(found: DataFrame, *ids: str) -> DataFrame:
    known = F.coalesce(F.col("_lang") != UNKNOWN, F.lit(True))
    return found.select(*ids, F.col("_lang").alias("language"), F.col("_posterior").alias("posterior"), known.alias("kept"))
