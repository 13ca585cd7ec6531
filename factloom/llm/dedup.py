"""Near-duplicate removal by SimHash with covering tables and by rare shingles, verified on five-word shingles.

Texts of the same words are one node. Each node has a SimHash fingerprint of its word set; the covering tables of the
`simhash` module bring together every pair of nodes within four bits. Fingerprints can't reach all texts of similar
shingles, so nodes meet by a prefix filter too (Chaudhuri and others, 2006): in any common order of all shingles, two
sets of a similarity of 0.8 share one of the first fifth of each. The order is rarest first: what a fixed share of the
rows shows to be common comes late, whatever the table's size. Where a shingle stands in both prefixes bounds what two
nodes of its bucket can share, so most of those that share a passage alone never meet. Pairs so found are links
if their five-word shingles are similar enough, and of each linked group one row stays. What is written for every row
is small: whole sets of shingles are taken, again from the texts, of those alone whose counts leave a pair possible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import clean_text, forget, materialise, text_batches
from factloom.operators.components import components
from factloom.llm.simhash import BITS, BLOCK, covering_masks, words_of

SHINGLE, SIMILAR = 5, 0.8
RADIUS = 4
#: Share of the rows whose shingles are counted, to put common ones last; the fewest rows of a common one, and how many
#: of those are kept, the most frequent first. They order the prefixes: any order finds the same links, a good one with
#: fewer pairs. Rows of a shingle above CLASSES count as so many where the most frequent are chosen.
COUNTED, LEAST, COMMON = 1 / 8, 3, 1_000_000
CLASSES = 50_000
#: Parts that shingles are dealt in by hash; their counts bound how similar two texts can be.
PARTS, MOST = 128, 127


def mark(words: list[bytes]) -> int:
    """SimHash fingerprint of the set of words, as a signed long."""
    vocabulary = sorted(set(words))
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(vocabulary), BLOCK):
        raw = b"".join(map(xxhash.xxh3_64_digest, vocabulary[at : at + BLOCK]))
        ones += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, BITS // 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(vocabulary)).tobytes(), "big", signed=True)


def hashes(words: list[bytes]) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles, ascending; a shorter text is one shingle, none without words."""
    n = len(words) - SHINGLE + 1 if len(words) >= SHINGLE else min(1, len(words))
    found = [np.empty(0, dtype=np.int64)]
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + SHINGLE - 1]
        grams = zip(*(part[i:] for i in range(SHINGLE))) if len(part) >= SHINGLE else [part]
        raw = np.frombuffer(b"".join([xxhash.xxh64_digest(b" ".join(g)) for g in grams]), dtype=">u8")
        found.append(np.unique(raw.astype("<u8").view(np.int64)))
    return np.unique(np.concatenate(found))


def sketch(words: list[bytes]) -> np.ndarray:
    """The distinct hashes of all shingles, cut to 32 bits."""
    return _short(hashes(words))


def _short(found: np.ndarray) -> np.ndarray:
    return np.unique((found >> 32).astype(np.int32))


def parts(short: np.ndarray) -> np.ndarray:
    """How many of the hashes fall in each part, in a byte each: more count as ``MOST``."""
    return np.minimum(np.bincount(short & (PARTS - 1), minlength=PARTS), MOST).astype(np.int8)


def ordered(found: np.ndarray, common: np.ndarray, holders: np.ndarray) -> np.ndarray:
    """The shingles of a text, rarest first.

    ``common`` are ascending hashes of known frequency ``holders``; other shingles come before them, in order of hash.
    """
    rank = np.zeros(len(found), dtype=np.int64)
    if len(common) and len(found):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        rank = np.where(common[at] == found, holders[at], 0)
    return found[np.lexsort((found, rank))]


def prefix(found: np.ndarray, common: np.ndarray, holders: np.ndarray) -> np.ndarray:
    """The rarest shingles of a text, so many that no similar text is without all of them.

    Similar sets of n and m shingles share 0.8 max(n, m) at least, and so one of the first n // 5 + 1 and m // 5 + 1.
    """
    return ordered(found, common, holders)[: len(found) // 5 + 1] if len(found) else found


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and frequencies of shingles that many of a fixed share of the rows have; COMMON at most."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(hashes(words_of(text)), pa.int64())], names=["hash"])

    text_batches(docs.sparkSession)
    drawn = F.pmod(F.xxhash64("doc_id", clean_text()), F.lit(1 << 20)) < int(COUNTED * (1 << 20))
    counts = docs.where(drawn).select(clean_text().alias("text")).mapInArrow(batches, "hash long").groupBy("hash").agg(F.count("*").alias("holders"))
    counts = materialise(counts.where(F.col("holders") >= LEAST))
    classes = counts.groupBy(F.least("holders", F.lit(CLASSES)).alias("holders")).agg(F.count("*").alias("n")).collect()
    kept, least = 0, CLASSES
    for holders, n in sorted(map(tuple, classes), reverse=True):
        kept += n
        if kept > COMMON:
            break
        least = holders
    found = counts.where(F.col("holders") >= least).limit(COMMON).toArrow()
    forget(counts)
    common, holders = (found.column(c).to_numpy() for c in ("hash", "holders"))
    order = np.argsort(common)
    return common[order], holders[order]


def row_keys(docs: DataFrame) -> list:
    """The row's doc_id as a string and the hash of its text: rows of equal keys have equal texts."""
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64(clean_text()).alias("text_hash")]


def signatures(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, id, text_hash, node, fp, rare, parts, size) of each row; ``shared`` is the broadcast of common_shingles()."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            words = [words_of(t) for t in batch.column(3).to_pylist()]
            found = [hashes(w) for w in words]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary()),
                    pa.array([mark(w) for w in words], pa.int64()),
                    pa.array([prefix(h, *shared.value) for h in found], pa.list_(pa.int64())),
                    pa.array([parts(_short(h)) for h in found], pa.list_(pa.int8())),
                    pa.array([len(h) for h in found], pa.int32()),
                ],
                names=["doc_id", "id", "text_hash", "node", "fp", "rare", "parts", "size"],
            )

    text_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", *row_keys(docs), clean_text().alias("text"))
    return rows.mapInArrow(batches, f"doc_id {kind}, id string, text_hash long, node binary, fp long, rare array<long>, parts array<tinyint>, size int")


def of_nodes(docs: DataFrame, needed: DataFrame, kind: str, one) -> DataFrame:
    """(number, found) of the needed nodes (number, id, text_hash), by ``one`` from the words of a row of each.

    Other texts reach no worker.
    """
    arrow = pa.list_(pa.int64() if kind == "long" else pa.int32())

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [one(words_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, arrow)], names=["number", "found"])

    text_batches(docs.sparkSession)
    texts = docs.select(*row_keys(docs), clean_text().alias("text")).join(needed, ["id", "text_hash"])
    return texts.select("number", "text").mapInArrow(batches, f"number long, found array<{kind}>").dropDuplicates(["number"])


def members(rows: DataFrame) -> DataFrame:
    """The rows whose bucket has other nodes too, with how many ``rows`` it has. Nearly all buckets hold one node.

    The rows are dealt once, and both their ends and the join are taken from that one exchange.
    """
    dealt = rows.repartition("bucket")
    ends = dealt.groupBy("bucket").agg(F.min("number").alias("low"), F.max("number").alias("high"), F.count("*").alias("rows"))
    return materialise(dealt.join(ends.where("low < high").select("bucket", "rows"), "bucket"))


def reach(size, held):
    """Shingles that a similar node may have at most, if only ``held`` of the node's own can be shared.

    Sets of n and m that share s are similar if 9 s >= 4 (n + m); and s is no more than what either can share.
    """
    return (9 * held - 4 * size) / 4


def entries(nodes: DataFrame) -> DataFrame:
    """(bucket, number, size, reach) of the shingles in the prefixes.

    Of similar nodes the first shingle that both have counts: there, what either can share is that one and what comes
    after it in its order. So a later place in the prefix reaches fewer nodes.
    """
    placed = nodes.select(F.posexplode("rare").alias("place", "bucket"), "number", "size")
    return placed.select("bucket", "number", "size", reach(F.col("size"), F.col("size") - F.col("place")).alias("reach"))


def with_leaders(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members of each bucket with its leaders: its oldest node and the one that most buckets share.

    Where members have size and reach, a pair must be within both reaches.

    The text that copies were made of shares more buckets than any copy, so the second links a large group at once. A
    bucket of any size gives two pairs a member at most and no group is compared with itself.
    """
    bound = ["size", "reach"] if "reach" in met.columns else []
    met = met.select("bucket", "number", *bound)
    degree = met.groupBy("number").agg(F.count("*").alias("degree"))
    aged = met.join(materialise(nodes.select("number", "first_id").join(degree, "number")), "number")
    one = F.struct("number", *bound)
    leaders = aged.groupBy("bucket").agg(F.min_by(one, F.struct("first_id", "number")).alias("oldest"), F.max_by(one, F.struct("degree", "number")).alias("hub"))
    pairs = met.join(leaders, "bucket").withColumn("led", F.explode(F.array("oldest", "hub"))).withColumn("leader", F.col("led.number")).where("number <> leader")
    if bound:
        pairs = pairs.where("reach >= led.size and led.reach >= size")
    return pairs.select(F.least("number", "leader").alias("a"), F.greatest("number", "leader").alias("b")).distinct()


def _rooted(met: DataFrame, roots: DataFrame) -> DataFrame:
    """``met`` with the root of each node: the smallest node that links lead to, or the node itself."""
    return met.join(roots.withColumnRenamed("node", "number"), "number", "left").withColumn("root", F.coalesce("root", "number"))


def to_hubs(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members of each bucket with one of the group that most of its members are of, if not theirs.

    Groups so get their links without being compared with each other; what has none after this is left to across().
    """
    rooted = _rooted(met, roots).select("bucket", "number", "root", "size", "reach")
    groups = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.min("number").alias("number"), F.min_by("size", "number").alias("size"), F.min_by("reach", "number").alias("reach"))
    most = groups.groupBy("bucket").agg(F.max(F.struct("n", "root", "number", "size", "reach")).alias("hub"), F.count("*").alias("groups")).where("groups > 1")
    pairs = rooted.join(most, "bucket").where("root <> hub.root and reach >= hub.size and hub.reach >= size").select("number", F.col("hub.number").alias("leader"))
    return pairs.select(F.least("number", "leader").alias("a"), F.greatest("number", "leader").alias("b")).distinct()


def across(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members of each bucket that no links connect so far, by (node, root) of those that have any.

    Groups of a bucket are paired before their members, so a large group of connected nodes isn't compared with itself;
    and only groups, then nodes, of which each is within the other's reach.
    """
    rooted = _rooted(met, roots).select("bucket", "number", "root", "size", "reach")
    groups = rooted.groupBy("bucket", "root").agg(F.min("size").alias("size"), F.max("reach").alias("reach"))
    ends = groups.groupBy("bucket").agg(F.min("root").alias("first"), F.max("root").alias("last"))
    open_buckets = materialise(ends.where("first < last").select("bucket"))
    rooted = materialise(rooted.join(open_buckets, "bucket", "left_semi"))
    groups = materialise(rooted.groupBy("bucket", "root").agg(F.min("size").alias("size"), F.max("reach").alias("reach")))
    within = (F.col("reach_a") >= F.col("size_b")) & (F.col("reach_b") >= F.col("size_a"))
    side = lambda df, name, *more: df.select("bucket", *(F.col(c).alias(f"{c}_{name}") for c in ("root", "size", "reach", *more)))
    sides = side(groups, "a").join(side(groups, "b"), "bucket").where("root_a < root_b").where(within).select("bucket", "root_a", "root_b")
    one = sides.join(side(rooted, "a", "number"), ["bucket", "root_a"])
    both = one.join(side(rooted, "b", "number"), ["bucket", "root_b"]).where(within)
    return both.select(F.least("number_a", "number_b").alias("a"), F.greatest("number_a", "number_b").alias("b")).distinct()


def candidates(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of node numbers that share a bucket of a covering table with one of its two leaders.

    ``nodes`` has number, first_id and fp.
    """
    tables = F.array(*[F.struct(F.lit(j).alias("table"), F.lit(m).cast("long").alias("mask")) for j, m in enumerate(covering_masks(RADIUS))])
    rows = nodes.select("number", "fp", F.explode(tables).alias("t"))
    rows = rows.select(F.xxhash64("t.table", F.col("fp").bitwiseAND(F.col("t.mask"))).alias("bucket"), "number")
    return with_leaders(members(rows), nodes)


def similarity(a, b):
    """Jaccard similarity of two sets of hashes; two empty ones are alike."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(1.0)


def possible(a, b, both):
    """False only for texts that can't be similar: their counts by part differ by more than similar sets may.

    Sets of n and m with s shared are similar if s >= 0.8 (n + m - s), that is if n + m - 2 s <= (n + m) / 9; and what
    the counts differ by is n + m - 2 s at most, ``both`` being n + m or more. Counts cut at ``MOST`` differ by less.
    """
    total = lambda x: F.aggregate(x, F.lit(0), lambda p, q: p + q)
    return 9 * total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("int") - y))) <= both


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose shingles are similar enough. Most others are told apart by their counts, without the shingles."""

    def sides(pairs: DataFrame, held: DataFrame) -> DataFrame:
        return pairs.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b")

    sizes = nodes.select("number", "size")
    alike = sides(pairs, sizes).where(5 * F.least("x", "y") >= 4 * F.greatest("x", "y")).select("a", "b", (F.col("x") + F.col("y")).alias("both"))
    possible_ones = materialise(sides(alike, nodes.select("number", "parts")).where(possible(F.col("x"), F.col("y"), F.col("both"))).select("a", "b"))
    needed = possible_ones.select(F.explode(F.array("a", "b")).alias("number")).distinct()
    needed = materialise(nodes.join(needed, "number", "left_semi").select("number", "id", "text_hash"))
    held = materialise(of_nodes(docs, needed, "int", sketch))
    links = materialise(sides(possible_ones, held).where(similarity(F.col("x"), F.col("y")) >= SIMILAR).select("a", "b"))
    forget(possible_ones, needed, held)
    return links


def _free_shuffles(spark) -> None:
    """Spark removes shuffles that nobody refers to any more once the driver has collected its garbage."""
    spark.sparkContext._jvm.System.gc()


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows, with their own columns, that are the first of their group: of smallest doc_id, null ids last.

    Texts of the same words are a group whatever their white space and letter case; null and empty texts are one such.
    Of rows that repeat both doc_id and text one stays. Texts may be of any length; other columns may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))
    found = materialise(signatures(docs, shared).withColumn("number", F.monotonically_increasing_id()))
    age = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), "id", "text_hash", "number")
    firsts = materialise(found.groupBy("node").agg(F.min(age).alias("age")).select("age", F.col("age.number").alias("number")))
    own = found.select("number", "id", "text_hash", "fp", "rare", "parts", "size").join(firsts.select("number", "age"), "number")
    first = F.coalesce(F.col("age.doc_id").try_cast("long"), F.lit((1 << 63) - 1))
    nodes = materialise(own.withColumn("first_id", first))
    forget(found, firsts)
    pairs = materialise(candidates(nodes.select("number", "first_id", "fp")))
    _free_shuffles(docs.sparkSession)
    met = members(entries(nodes))
    pairs = materialise(pairs.unionAll(with_leaders(met, nodes)).distinct())
    links = verified(pairs, nodes, docs)
    roots = materialise(components(links))
    for more in (to_hubs, across):
        _free_shuffles(docs.sparkSession)
        fresh = materialise(more(met, roots).join(pairs, ["a", "b"], "left_anti"))
        pairs, links = pairs.unionAll(fresh), links.unionAll(verified(fresh, nodes, docs))
        roots = materialise(components(links))
    forget(met)
    rooted = nodes.select(F.col("number").alias("node"), "age").join(roots, "node", "left")
    kept = rooted.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("age").alias("age"))
    kept = materialise(kept.select("age.id", "age.text_hash").distinct())
    forget(nodes, roots)
    keys = row_keys(docs)
    rows = docs.select(F.struct("*").alias("row"), *keys).join(kept, ["id", "text_hash"])
    again = docs.select(*keys).join(kept, ["id", "text_hash"], "left_semi").groupBy("id", "text_hash").count()
    again = materialise(again.where("count > 1").select("id", "text_hash"))
    copy = F.row_number().over(W.partitionBy("id", "text_hash").orderBy("id"))
    repeated = rows.join(again, ["id", "text_hash"], "left_semi").withColumn("copy", copy).where("copy = 1").select("row.*")
    return rows.join(again, ["id", "text_hash"], "left_anti").select("row.*").unionAll(repeated)
