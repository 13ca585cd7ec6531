"""SimHash near-duplicates by covering locality-sensitive hashing.

A table keeps the bits of a fingerprint that one structured mask selects. With masks for every nonzero vector of
``radius + 1`` bits (Pagh, 2016) any two fingerprints within the radius agree on all bits of at least one mask, so
they meet in that table whatever bits differ. Which fingerprints of a shared bucket really are within the radius is
then found without comparing them in pairs: with radius 2, two of them are close exactly if each is at most one bit
from a common midpoint, and a midpoint has 65 fingerprints around it at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import clean_text, materialise, table, text_batches
from factloom.operators.components import components

BITS = 64
SEED = 42
#: Shingles whose bits are counted at once: bounds memory on very long texts.
BLOCK = 1 << 17


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased and other letters as they are."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str, shingle: int = 3, seed: int = SEED) -> int:
    """Majority bits of the shingles' XXH64; 0 for a text without words."""
    words = words_of(text)
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle))) if n > 1 or len(part) >= shingle else [part]
        hashes = b"".join([digest(b" ".join(gram), seed) for gram in grams])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, BITS // 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """One row per document: its id and the fingerprint as a signed long. Other columns are left out."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            marks = [fingerprint(text, shingle, seed) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], names=[id_col, "fp"])

    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, clean_text().alias("text")).mapInArrow(batches, f"{id_col} {kind}, fp long")


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks over 64 bits, as signed longs.

    Bit i carries the vector 1 + (i mod (2^(radius+1) - 1)); the mask of v keeps the bits whose vector has an odd
    product with v. At most ``radius`` differing bits span less than the whole space, so some v is orthogonal to all
    of them and its mask leaves them out.
    """
    size = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, size + 1):
        mask = sum(1 << i for i in range(BITS) if ((1 + i % size) & v).bit_count() % 2)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return masks


def bucket_rows(nodes: DataFrame, radius: int) -> DataFrame:
    """A row for each fingerprint and table: fp, mask and key, which is what the mask keeps."""
    masks = F.array(*[F.lit(m).cast("long") for m in covering_masks(radius)])
    return nodes.select("fp", F.explode(masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def linked_fingerprints(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within two bits of each other, and no others.

    Every midpoint joins its surroundings to their smallest member, so the edges number in the fingerprints and not
    in the pairs. Only bits outside a mask that a fingerprint shares with another one are flipped.
    """
    buckets = bucket_rows(nodes, 2)
    shared = materialise(buckets.groupBy("mask", "key").count().where("count > 1").drop("count"))
    free = (
        buckets.join(shared, ["mask", "key"], "left_semi")
        .groupBy("fp")
        .agg(F.expr("bit_or(~mask)").alias("free"))
    )
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), i) for i in range(BITS)])
    midpoints = (
        free.select("fp", "free", F.explode(flips).alias("flip"))
        .where(F.col("flip").bitwiseAND(F.col("free")) == F.col("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("midpoint"))
    )
    around = midpoints.groupBy("midpoint").agg(F.sort_array(F.collect_list("fp")).alias("near"))  # 65 at most
    return (
        around.where("size(near) > 1")
        .select(F.explode(F.expr("slice(near, 2, size(near))")).alias("a"), F.col("near")[0].alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id of every row: documents whose fingerprints link within two bits.

    Null and empty texts have fingerprint 0 and link like any other; repeated rows stay; a row with a null id gets
    the component its text belongs to. A component's id is its smallest doc_id (null if it has none).
    """
    marks = materialise(fingerprints(docs, shingle))
    nodes = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(linked_fingerprints(nodes))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialise(rooted)
    names = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = materialise(rooted.join(names, "root").select("fp", "component_id"))
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
