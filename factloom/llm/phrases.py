"""Phrase collocation mining with depth-limited count tries.

Each shard of the corpus is read into a trie of its phrases of up to four words with their counts, level by level. A
trie's nodes are sorted by their words, so the phrases of a prefix range are a run on every level; the runs are
serialised, sent to the range's task and merged there, many shards at a time. The walk from the root to a node passes
the left parts of its phrase with their counts. A right part lies under other prefixes: the suffix link of a node, the
phrase without its first word, is followed by a join of frequent phrases. Nothing is pruned before counts are whole.

Ranges are cut between pairs of words, so that one frequent first word fills several of them; each of these gets that
word's count from every shard.
"""

from __future__ import annotations

import string
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import clean_text, materialise, table, text_batches

#: Words of a phrase at most, occurrences of a candidate at least, per cent of a phrase that a longer one may not hold,
#: and phrases of a language in the report.
DEPTH, LEAST, HELD, TOP = 4, 30, 80, 2000
#: Words of a shard, and pairs of neighbouring words of the corpus to a prefix range.
SHARD_WORDS, RANGE_PAIRS = 2_000_000, 500_000
#: Nodes gathered by a merge before they are summed.
MERGED_NODES = 2_000_000
#: Ranges are cut by a sample of so many documents and at most so many pairs of each. Only their sizes depend on it.
SAMPLED, PAIRS = 2_000, 64
#: Bytes of a word that a cut between ranges has.
CUT = 32
#: Shares of one-word right parts, which many phrases have in common.
SHARES = 16

#: What ends a piece of text, and what stands between words.
ENDS, BETWEEN = b".,;:!?\x0b\x0c\r", b"\t"
_READ = bytes.maketrans(
    string.ascii_uppercase.encode() + ENDS + BETWEEN, string.ascii_lowercase.encode() + b"\n" * len(ENDS) + b" "
)
NO_LANGUAGE = "und"


class _Numbers(dict):
    """Words numbered from 1 as they come; the end of a piece is 0."""

    def __init__(self):
        super().__init__({b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words_of(text: bytes) -> Iterator[bytes]:
    """The words of a text, and a line feed wherever a piece ends."""
    return filter(None, text.translate(_READ).replace(b"\n", b" \n ").split(b" "))


class Trie:
    """Phrases of a corpus part: sorted words, and on each level the nodes' parents, words and counts, in order."""

    def __init__(self, words: list[bytes], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], carried: bool = False):
        self.words, self.levels, self.carried = words, levels, carried

    def __len__(self) -> int:
        return sum(len(counts) for _, _, counts in self.levels)

    @classmethod
    def counted(cls, numbers: _Numbers, ids: np.ndarray) -> Trie:
        words = sorted(w for w, n in numbers.items() if n)
        rank = np.zeros(len(words) + 1, np.int32)
        rank[[numbers[w] for w in words]] = np.arange(1, len(words) + 1, dtype=np.int32)
        ids, size = rank[ids], len(words) + 1
        node = ids  # the phrase that begins here, from 1 on; 0 where none of this length does
        levels = [(np.zeros(len(words), np.int32), np.arange(len(words), dtype=np.int32), np.bincount(ids, minlength=size)[1:])]
        for depth in range(2, DEPTH + 1):
            following = ids[depth - 1 :]
            node = node[: len(following)]
            places = np.flatnonzero((node > 0) & (following > 0))
            keys, inverse, counts = np.unique(node[places].astype(np.int64) * size + following[places], return_inverse=True, return_counts=True)
            levels.append(((keys // size - 1).astype(np.int32), (keys % size - 1).astype(np.int32), counts))
            node = np.zeros(len(following), np.int32)
            node[places] = inverse + 1
        return cls(words, levels)

    def cut(self, bounds: list[tuple[bytes, bytes]]) -> Iterator[tuple[int, Trie]]:
        """The part of each prefix range that has any, by number; ``carried`` if its first word belongs to an earlier range."""
        size = len(self.words)
        pairs = self.levels[1][0].astype(np.int64) * size + self.levels[1][1]
        starts = [(0, 0, 0)]
        for one, two in bounds:
            at, after = bisect_left(self.words, one), bisect_right(self.words, one)
            key = at * size + (bisect_left(self.words, two) if after > at else 0)
            starts.append((at, after, int(np.searchsorted(pairs, key))))
        starts.append((size, size, len(pairs)))
        for number, ((low, own, begin), (_, stop, end)) in enumerate(zip(starts, starts[1:])):
            if low == stop:
                continue
            runs = [(low, stop), (begin, end)]
            for parents, _, _ in self.levels[2:]:
                runs.append(tuple(np.searchsorted(parents, runs[-1])))
            levels, before = [], 0
            for (a, b), (parents, words, counts) in zip(runs, self.levels):
                levels.append((parents[a:b] - before, words[a:b], counts[a:b]))
                before = a
            levels[0] = (np.zeros(stop - low, np.int32), *levels[0][1:])
            used = np.unique(np.concatenate([w for _, w, _ in levels]))
            levels = [(p, np.searchsorted(used, w).astype(np.int32), c) for p, w, c in levels]
            yield number, Trie([self.words[i] for i in used], levels, own > low)

    def serialised(self) -> tuple[bytes, bytes]:
        """Words and nodes; parents are written as differences, which are small since nodes are in order."""
        columns = [np.array([len(c) for _, _, c in self.levels], np.int64).tobytes()]
        for parents, words, counts in self.levels:
            columns += [np.diff(parents, prepend=0).astype("<i4").tobytes(), words.astype("<i4").tobytes(), counts.astype("<i8").tobytes()]
        return zlib.compress(b"\n".join(self.words), 1), zlib.compress(b"".join(columns), 1)

    @classmethod
    def parsed(cls, words: bytes, nodes: bytes, carried: bool) -> Trie:
        data, at, levels = zlib.decompress(nodes), 8 * DEPTH, []
        for n in np.frombuffer(data, "<i8", DEPTH):
            parents = np.cumsum(np.frombuffer(data, "<i4", n, at), dtype=np.int64)
            levels.append((parents, np.frombuffer(data, "<i4", n, at + 4 * n), np.frombuffer(data, "<i8", n, at + 8 * n)))
            at += 16 * n
        return cls(zlib.decompress(words).split(b"\n"), levels, carried)

    @classmethod
    def merged(cls, tries: list[Trie]) -> Trie:
        """One trie of many, whose sorted runs are merged level by level."""
        if len(tries) == 1:
            return tries[0]
        words = sorted(set().union(*(t.words for t in tries)))
        number = {w: i for i, w in enumerate(words)}
        renamed = [np.fromiter((number[w] for w in t.words), np.int64, len(t.words)) for t in tries]
        above, levels = [np.zeros(1, np.int64)] * len(tries), []
        for depth in range(DEPTH):
            keys = [a[t.levels[depth][0]] * len(words) + r[t.levels[depth][1]] for t, r, a in zip(tries, renamed, above)]
            counts = np.concatenate([t.levels[depth][2] for t in tries]).astype(np.int64)
            unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            summed = np.zeros(len(unique), np.int64)
            np.add.at(summed, inverse, counts)
            levels.append((unique // len(words), unique % len(words), summed))
            above = np.split(inverse, np.cumsum([len(k) for k in keys])[:-1])
        return cls(words, levels, any(t.carried for t in tries))

    def frequent(self, least: int) -> Iterator[tuple[str, int, int, list[int]]]:
        """(phrase, words, count, counts of its left parts, shortest first) of each node that is frequent.

        A part is at least as frequent as the phrase, so the walk goes on under frequent nodes only.
        """
        held: dict[int, tuple[str, list[int]]] = {}
        for depth, (parents, words, counts) in enumerate(self.levels):
            below = {}
            for i in np.flatnonzero(counts >= least).tolist():
                word, count = self.words[words[i]].decode("utf-8", "replace"), int(counts[i])
                above, lefts = held[int(parents[i])] if depth else ("", [])
                phrase = f"{above} {word}" if depth else word
                below[i] = (phrase, [*lefts, count])
                if depth or not (self.carried and i == 0):
                    yield phrase, depth + 1, count, lefts
            held = below


def ranges(docs: DataFrame, range_pairs: int = RANGE_PAIRS) -> dict[str, tuple[int, list[tuple[bytes, bytes]]]]:
    """For each sampled language the number of its first range, and the cuts between its ranges."""
    share = min(1.0, SAMPLED / max(docs.count(), 1))

    def pairs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w[:CUT] for w in words_of(text)]
                places = [i for i in range(len(words) - 1) if words[i] != b"\n" != words[i + 1]]
                drawn = places[:: -(-len(places) // PAIRS) or 1]
                found += [(lang, words[i], words[i + 1], len(places) / len(drawn)) for i in drawn]
            columns = zip(*found) if found else [[]] * 4
            kinds = [pa.string(), pa.binary(), pa.binary(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "one", "two", "weight"])

    drawn = docs.sample(share, seed=12) if share < 1 else docs
    rows = drawn.mapInArrow(pairs, "lang string, one binary, two binary, weight double").collect()
    found, first = {}, 0
    key = lambda r: (r.lang, bytes(r.one), bytes(r.two))
    for lang, group in groupby(sorted(rows, key=key), key=lambda r: r.lang):
        weight, cuts = 0.0, []
        for r in group:
            weight += r.weight / share
            if weight >= range_pairs and (not cuts or cuts[-1] != key(r)[1:]):
                cuts.append(key(r)[1:])
                weight = 0.0
        found[lang] = (first, cuts)
        first += len(cuts) + 1
    return found


def _range_of_others(lang: str, known: dict) -> int:
    """The range of a language that the sample doesn't have: one, beyond those of the sample."""
    return sum(len(cuts) + 1 for _, cuts in known.values()) + zlib.crc32(lang.encode()) % 1000


def counted(docs: DataFrame, least: int = LEAST, shard_words: int = SHARD_WORDS, range_pairs: int = RANGE_PAIRS, merged_nodes: int = MERGED_NODES) -> DataFrame:
    """lang, phrase, depth, count and lefts of all phrases of one to four words with ``least`` occurrences.

    Rows of depth 0 have a range's share of all words of a language. ``docs`` has lang (a string) and text (binary).
    """
    known = ranges(docs, range_pairs)

    def shards(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        size = 0
        for batch in rows:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                numbers, parts = held.setdefault(lang, (_Numbers(), []))
                ids = np.fromiter(map(numbers.__getitem__, words_of(text)), np.int32)
                parts += [ids, np.zeros(1, np.int32)]
                size += len(ids)
                if size >= shard_words:
                    yield from serialised(held)
                    held, size = {}, 0
        yield from serialised(held)

    def serialised(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, (numbers, parts) in held.items():
            if len(numbers) == 1:
                continue
            first, cuts = known.get(lang) or (_range_of_others(lang, known), [])
            for number, trie in Trie.counted(numbers, np.concatenate(parts)).cut(cuts):
                words, nodes = trie.serialised()
                yield pa.RecordBatch.from_pydict({
                    "range": pa.array([first + number], pa.int32()), "lang": pa.array([lang], pa.string()),
                    "carried": pa.array([trie.carried]), "words": pa.array([words], pa.binary()), "nodes": pa.array([nodes], pa.binary()),
                })

    def runs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = (row for batch in rows for row in zip(*(c.to_pylist() for c in batch.columns)))
        for (_, lang), group in groupby(blobs, key=lambda row: row[:2]):
            held, size = [], 0
            for _, _, carried, words, nodes in group:
                held.append(Trie.parsed(words, nodes, carried))
                size += len(held[-1])
                if size >= merged_nodes and len(held) > 1:
                    held = [Trie.merged(held)]
                    size = 0
            trie = Trie.merged(held)
            own = trie.levels[0][2][1 if trie.carried else 0 :]
            found = [("", 0, int(own.sum()), []), *trie.frequent(least)]
            phrases, depths, counts, lefts = zip(*found)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(found), pa.string()), "phrase": pa.array(phrases, pa.string()),
                "depth": pa.array(depths, pa.int32()), "count": pa.array(counts, pa.int64()), "lefts": pa.array(lefts, pa.list_(pa.int64())),
            })

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.mapInArrow(shards, "range int, lang string, carried boolean, words binary, nodes binary").repartitionById(
        tasks, F.pmod(F.col("range"), F.lit(tasks)).cast("int")
    )
    return dealt.sortWithinPartitions("range", "lang").mapInArrow(
        runs, "lang string, phrase string, depth int, count long, lefts array<long>"
    )


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r and score of each candidate at its lowest-scoring cut, of equal ones the first."""
    right = phrases.where("depth >= 1").select(
        F.col("lang").alias("_lang"), F.col("phrase").alias("_rest"), F.col("count").alias("r"),
        F.explode(F.when(F.col("depth") == 1, F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))).alias("_share"),
    )
    cuts = phrases.where("depth >= 2").select("lang", "phrase", "depth", F.col("count").alias("a"), F.posexplode("lefts").alias("k", "l"))
    rest = F.array_join(F.slice(F.split("phrase", " "), F.col("k") + 2, F.col("depth")), " ")
    share = F.when(F.col("depth") - F.col("k") == 2, F.pmod(F.xxhash64("phrase"), F.lit(SHARES)).cast("int")).otherwise(0)
    cuts = cuts.withColumn("rest", rest).withColumn("share", share)
    both = cuts.join(right, (F.col("lang") == F.col("_lang")) & (F.col("rest") == F.col("_rest")) & (F.col("share") == F.col("_share")))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    both = both.withColumns({"wide_a": 2_000_000 * wide("a"), "wide_lr": wide("l") + wide("r")}).withColumn("score", F.expr("wide_a div wide_lr"))
    return both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score"
    )


def not_held(candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """Candidates without those that longer ones hold.

    A phrase is at least as frequent as all that hold it, so of these the ones a word longer decide.
    """
    words = F.split("phrase", " ")
    parts = F.array(F.slice(words, F.lit(1), F.col("depth") - 1), F.slice(words, F.lit(2), F.col("depth") - 1))
    longer = phrases.where("depth >= 3").select(F.col("lang").alias("_lang"), "count", F.explode(parts).alias("part"))
    longer = longer.groupBy("_lang", F.array_join("part", " ").alias("_part")).agg(F.max("count").alias("most"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    held = (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_part")) & (100 * wide("most") >= HELD * wide("a"))
    return candidates.join(longer, held, "left_anti")


def best(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language with their rank.

    Before a language's rows meet, a quantile that surely leaves enough of them cuts off the rest.
    """
    halvings, accuracy = list(range(21)), 1_000_000
    many = candidates.groupBy(F.col("lang").alias("_lang")).agg(
        F.count("*").alias("_n"), F.percentile_approx("score", [1 - 0.5**j for j in halvings], accuracy).alias("_at")
    )
    enough = F.greatest(*[F.when(F.col("_n") * (0.5**j - 2 / accuracy) > top, F.get("_at", F.lit(j))).otherwise(-1) for j in halvings])
    kept = candidates.join(many.select("_lang", enough.alias("_least")), (F.col("lang") == F.col("_lang")) & (F.col("score") >= F.col("_least")))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.drop("_lang", "_least").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of each language.

    Null texts are empty, a null lang is that of ``NO_LANGUAGE``; documents of any length and repeated ones count as
    they stand, and other columns are left out. An empty table has no phrases. ``sizes`` are those of ``counted``.
    """
    text_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), clean_text().cast("binary").alias("text"))
    phrases = materialise(counted(texts, least, **sizes))
    words = phrases.where("depth = 0").groupBy("lang").agg(F.sum("count").alias("n"))
    found = best(not_held(scored(phrases), phrases), top).join(words, "lang")
    longs = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
    return found.select("lang", *longs("rank"), "phrase", *longs("a", "l", "r", "n", "score"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))
