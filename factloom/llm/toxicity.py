"""Toxicity by multiple-instance learning: a text is toxic if any of its sentences is.

Only documents have labels. Each sentence gets a logistic score of its words, a document the noisy-or of its
sentences, and the likelihood of the document labels trains the sentence scores. The sentences that made a document
toxic can then be pointed out. Features are words and their beginnings, so inflected and joined forms share weight.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import clean_text, table, text_batches

#: Labelled documents that the sentence scorer is fitted on, about, and their characters; of a text longer than LONGEST
#: as much in STRETCHES from all over it.
LABELLED, CHARACTERS = 6_000, 24_000_000
LONGEST, STRETCHES = 50_000, 20
#: What a feature must tell of the labels (chi-squared on one degree of freedom), and the fewest documents that have it.
TELLING, LEAST_DOCUMENTS = 6.63, 4
BEGINNINGS = (3, 4, 5, 6)
ROUNDS, RATE, DECAY = 500, 0.05, 5e-5
CACHED_WORDS = 500_000
#: Words of a sentence that has no end mark are scored in stretches of so many, so lists count as sentences too.
STRETCH = 40

TOKEN = regex.compile(r"[\p{L}\p{M}]+|[.!?;|\n。！？।]+")
WORD = regex.compile(r"[\p{L}\p{M}]+")


def features(word: str) -> list[str]:
    """The word, and its first letters: a beginning is marked so that it isn't taken for a word."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)]


@dataclass
class Scorer:
    """Weights by feature, and the sentence's bias."""

    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            if WORD.match(word):
                w = sum(self.weights.get(f, 0.0) for f in features(word.lower()))
            else:
                w = np.nan  # ends a sentence
            self.known[word] = w
        return w

    def sentences(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each sentence that has words: the first token, the token after its last, its log(1 - p)."""
        word = self.word
        values = np.array([word(t) for t in TOKEN.findall(text)], dtype=np.float64)
        starts, stops = stretches(np.isnan(values))
        sums = np.concatenate([[0.0], np.cumsum(np.nan_to_num(values))])
        logit = self.bias + sums[stops] - sums[starts]
        return starts, stops, -np.logaddexp(0.0, logit)

    def score(self, text: str) -> float:
        """Noisy-or of the sentences; a text without words has that of one empty sentence."""
        _, _, clean = self.sentences(text)
        return float(-np.expm1(clean.sum() if len(clean) else -np.logaddexp(0.0, self.bias)))

    def offending(self, text: str, least: float = 0.5) -> list[dict]:
        """Sentences whose own probability reaches ``least``, or the likeliest if none does: offsets in code points."""
        starts, stops, clean = self.sentences(text)
        if not len(clean):
            return []
        p = -np.expm1(clean)
        chosen = np.flatnonzero(p >= least)
        chosen = chosen if len(chosen) else [int(p.argmax())]
        spans = [m.span() for m in TOKEN.finditer(text)]
        return [{"start": spans[starts[i]][0], "stop": spans[stops[i] - 1][1], "p": float(p[i])} for i in chosen]


def stretches(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs between end marks, cut every STRETCH words."""
    inside = np.concatenate([[False], ~ends, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[::2], edges[1::2]
    cuts = (stops - starts + STRETCH - 1) // STRETCH
    run = np.repeat(np.arange(len(starts)), cuts)
    step = np.arange(len(run)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    begin = starts[run] + step * STRETCH
    return begin, np.minimum(begin + STRETCH, stops[run])


def fit(texts: Iterable[str], labels: list[int]) -> Scorer:
    """Fit on labelled texts, read once; without both labels every score is the share of toxic ones."""
    number: dict[str, int] = {}
    words = [np.array([number.setdefault(t, len(number)) for t in map(str.lower, TOKEN.findall(text))], dtype=np.int32) for text in texts]
    y = np.array(labels, dtype=np.float64)
    n, positive = len(y), float(y.sum())
    if not 0 < positive < n:
        rate = min(0.99, max(0.01, positive / n)) if n else 0.01
        return Scorer({}, float(np.log(rate / (1 - rate))))
    vocabulary = list(number)
    is_word = np.array([bool(WORD.match(t)) for t in vocabulary], dtype=bool)
    own = [features(t) if w else [] for t, w in zip(vocabulary, is_word)]
    toxic, clean = Counter(), Counter()
    for tokens, label in zip(words, labels):
        (toxic if label else clean).update({f for w in np.unique(tokens) for f in own[w]})
    seen = [f for f, k in (toxic + clean).items() if k >= LEAST_DOCUMENTS]
    a = np.array([toxic[f] for f in seen], dtype=np.float64)
    b = np.array([clean[f] for f in seen], dtype=np.float64)
    lean = (a * n - (a + b) * positive) ** 2 / ((a + b) * (n - a - b) + 1.0)
    lean *= n / (positive * (n - positive))
    index = {seen[i]: k for k, i in enumerate(np.lexsort((seen, -lean))) if lean[i] >= TELLING}
    del toxic, clean
    chosen = [[index[f] for f in fs if f in index] for fs in own]
    cols, rows, owner, at = [], [], [], 0
    for doc, tokens in enumerate(words):
        starts, stops = stretches(~is_word[tokens])
        if not len(starts):
            owner.append(doc)
            at += 1
        for s, e in zip(starts, stops):
            ids = [k for w in tokens[s:e] for k in chosen[w]]
            cols.append(np.array(ids, dtype=np.int32))
            rows.append(np.full(len(ids), at, dtype=np.int32))
            owner.append(doc)
            at += 1
    cols, rows, owner = np.concatenate(cols), np.concatenate(rows), np.array(owner, dtype=np.int32)
    weights, bias = np.zeros(len(index) + 1), np.log(positive / n / (at / n))
    weights[-1] = bias
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, ROUNDS + 1):
        logit = np.bincount(rows, weights[cols], at) + weights[-1]
        clean_log = np.bincount(owner, -np.logaddexp(0.0, logit), n)
        p = np.clip(-np.expm1(clean_log), 1e-9, 1.0)
        # d(-log likelihood) / d(logit of a sentence): its share of the document's noisy-or
        pull = (1 - y) - y * np.exp(np.clip(clean_log, -700, 0)) / p
        g = pull[owner] / (1 + np.exp(-np.clip(logit, -700, 700)))
        grad = np.append(np.bincount(cols, g[rows], len(index)), g.sum()) / n
        grad[:-1] += DECAY * weights[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        weights -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Scorer({f: float(weights[k]) for f, k in index.items() if weights[k]}, float(weights[-1]))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Scorer:
    """Fit on a bounded sample of the labelled documents outside the held-out fold.

    The sample is drawn by a hash of the id, so its expected size is ``labelled`` rows and CHARACTERS at most whatever
    the table's size, and its ids are few enough to broadcast; texts of any length are in it, and the driver holds their
    words' numbers, not the texts. Contradicting labels count as toxic.
    """
    known = (
        labels.where("doc_id is not null and toxic is not null").where(~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("label_of_it"))
    )
    texts = docs.select("doc_id", clean_text().alias("text"))
    sizes = texts.select("doc_id", F.least(F.length("text"), F.lit(LONGEST)).cast("long").alias("size"))
    n, characters = sizes.join(known, "doc_id").agg(F.count("*"), F.sum("size")).first()
    share = min(1.0, labelled / max(1, n), CHARACTERS / max(1, characters or 0))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", stretched(F.col("text")).alias("text"), "label_of_it")
    drawn_labels: list[int] = []

    def one_by_one() -> Iterator[str]:
        for r in rows.orderBy("doc_id", "text").toLocalIterator():
            drawn_labels.append(int(r.label_of_it > 0))
            yield r.text

    return fit(one_by_one(), drawn_labels)


def stretched(text):
    """The text, or of a long one as much as LONGEST in stretches at equal distances."""
    n, size = F.length(text), LONGEST // STRETCHES
    parts = [F.substring(text, (n * i / STRETCHES).cast("int") + 1, F.lit(size)) for i in range(STRETCHES)]
    return F.when(n <= LONGEST, text).otherwise(F.concat_ws("\n", *parts))


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences of those predicted toxic, for every row.

    Null and empty texts are scored as one empty sentence; repeated rows stay and score alike. A score of exactly a half
    counts as toxic. Offsets are code points of the text as it is.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((scorer.weights, scorer.bias))
    text_batches(spark)
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(*shared.value)
        for batch in rows:
            texts = batch.column(2).to_pylist()
            scores = [own.score(t) for t in texts]
            hits = [own.offending(t) if s >= 0.5 else [] for t, s in zip(texts, scores)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(scores), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(hits, span)],
                names=["doc_id", "held_out", "score", "predicted", "offending"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), clean_text().alias("text")).mapInArrow(
        batches, f"doc_id {kind}, held_out boolean, score double, predicted int, offending array<struct<start:int,stop:int,p:double>>"
    )


def keep_clean(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows, with their own columns, that aren't predicted toxic; nothing is shuffled."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((scorer.weights, scorer.bias))
    text_batches(spark)
    at = docs.columns.index("text")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(*shared.value)
        for batch in rows:
            yield batch.filter(pa.array([own.score(t or "") < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
