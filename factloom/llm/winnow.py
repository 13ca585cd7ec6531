"""Document fingerprints by winnowing (Schleimer, Wilkerson and Aiken, 2003), in DataFrame expressions alone.

Hashes of every run of K words roll over a text; of each window of W consecutive hashes the smallest is selected, the
rightmost of equal ones. Any two texts that share K + W - 1 words in a row share a selected hash. A hash and its
position are one long, the hash in the upper bits and the distance from the far end below, so the minimum of a window
is the rightmost of its smallest hashes, and everything stays in arrays of longs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import clean_text, materialise, table

#: Words in a gram, and grams in a window.
GRAM, WINDOW = 3, 4
POSITION_BITS = 31
FAR_END = (1 << POSITION_BITS) - 1


def _roll(a: Column, b: Column, n: int) -> Column:
    """Cyclic polynomial: the hash of n words rotated before those of the words on its left are added."""
    return F.shiftleft(a, n).bitwiseXOR(F.shiftrightunsigned(a, 64 - n)).bitwiseXOR(b)


def _rolled(df: DataFrame, column: str, n: int, join) -> DataFrame:
    """Combine each run of n array elements in about log2(n) steps; join(left, right, elements of right) is a Column.

    Runs of 2^j are joined from two of half the length, and n is covered by its binary digits. Shorter arrays give
    an empty one.
    """
    parts, size, step = [], 1, column
    while True:
        if n & size:
            parts.append((step, size))
        if 2 * size > n:
            break
        name = f"{column}_{2 * size}"
        df = df.withColumn(name, _shifted(step, step, size, size, join))
        step, size = name, 2 * size
    done, length = parts[-1]
    for part, size in reversed(parts[:-1]):
        name = f"{column}_to_{length + size}"
        df = df.withColumn(name, _shifted(done, part, length, size, join))
        done, length = name, length + size
    return df.withColumnRenamed(done, f"{column}_rolled") if done != column else df.withColumn(f"{column}_rolled", F.col(column))


def _shifted(left: str, right: str, by: int, size: int, join) -> Column:
    """Join element i of one array with element i + by of another, which stands for ``size`` first elements."""
    n = F.greatest(F.size(right) - by, F.lit(0))
    return F.zip_with(
        F.slice(left, F.lit(1), n), F.slice(right, F.lit(by + 1), n), lambda a, b: join(a, b, size)
    )


def fingerprint(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add ``out``, the selected hash-and-position longs of a text column, in order of position.

    Words are runs between white space, letters lower-cased. Marks stand before the first word, so every word ends a
    gram, and the windows begin with the first gram alone: texts of any length go by one rule, and texts of the same
    first word share a selected hash as those of a common passage do. A text without words has none (an empty array).
    """
    kept = df.columns
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    mark = F.xxhash64(F.lit(""))  # no word is empty
    df = df.withColumn("_h", F.concat(F.array_repeat(mark, gram - 1), F.transform(words, lambda w: F.xxhash64(w))))
    df = _rolled(df, "_h", gram, _roll)
    mixed = lambda h: F.shiftrightunsigned(F.xxhash64(h), 64 - 32)
    key = lambda h, i: F.shiftleft(mixed(h), POSITION_BITS) + (F.lit(FAR_END) - i)
    never = F.lit((1 << 63) - 1)  # above every key
    df = df.withColumn("_k", F.concat(F.array_repeat(never, window - 1), F.transform("_h_rolled", key)))
    df = _rolled(df, "_k", window, lambda a, b, n: F.least(a, b))
    return df.withColumn(out, F.array_distinct("_k_rolled")).select(*kept, out)


def hash_of(key: Column) -> Column:
    return F.shiftright(key, POSITION_BITS)


def position_of(key: Column) -> Column:
    """Number of words before the last one of the selected gram."""
    return F.lit(FAR_END) - key.bitwiseAND(F.lit(FAR_END))


def likeness(a: Column, b: Column) -> Column:
    """Share of the hashes of both fingerprints that either has; 1 for two without any, 0 if one has none."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    shared = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(shared / F.greatest(F.size(x) + F.size(y) - shared, F.lit(1)))


def spelled(keys: Column) -> Column:
    """A fingerprint as a string: 16 hexadecimal digits for each selected key, in order, joined by commas."""
    return F.array_join(F.transform(keys, lambda k: F.lower(F.lpad(F.hex(k), 16, "0"))), ",")


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) of distinct ids: the next larger one, and after the last the first.

    Ids are dealt by range, linked inside each range, and the ends of ranges linked over one row per range.
    """
    dealt = ids.select("doc_id").distinct().repartitionByRange("doc_id").withColumn("_part", F.spark_partition_id())
    dealt = materialise(dealt)
    inside = dealt.withColumn("next_id", F.lead("doc_id").over(W.partitionBy("_part").orderBy("doc_id")))
    ends = dealt.groupBy("_part").agg(F.min("doc_id").alias("_first"))
    around = W.partitionBy(F.lit(0)).orderBy("_part")
    first = F.first("_first").over(around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ends = ends.select("_part", F.coalesce(F.lead("_first").over(around), first).alias("_next"))
    return inside.join(ends, "_part").select("doc_id", F.coalesce("next_id", "_next").alias("next_id"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Every row with its text, n_chars, the next document's text and the edited text.

    The next document is that of the next larger doc_id; of rows that repeat a doc_id the next text is the smallest,
    and a row with a null id has itself as the next.
    """
    texts = docs.select("doc_id", clean_text().alias("text"))
    known = texts.where("doc_id is not null")
    links = successors(known).select(F.col("doc_id").alias("_from"), F.col("next_id").alias("_to"))
    dealt = known.repartition("doc_id")  # dealt once; both uses below read the same exchange
    first = dealt.groupBy("doc_id").agg(F.min("text").alias("next_text"))
    following = first.join(links, F.col("doc_id") == F.col("_to")).select(F.col("_from").alias("doc_id"), "next_text")
    paired = dealt.join(following, "doc_id", "left").unionByName(
        texts.where("doc_id is null").withColumn("next_text", F.col("text"))
    )
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    paired = paired.withColumn("next_text", F.coalesce("next_text", "text")).withColumn("n_chars", n.cast("long"))
    return paired.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))


def op9_winnowing(spark, sf_dir):
    """Every row with its fingerprint, that of its edit, and how alike both and the next document's are.

    The next document's fingerprint is taken again from the text that the edit needs anyway: an array of longs is about
    as large as the text that it comes from and doesn't compress, so sending fingerprints along would double the shuffle.
    Texts may be of any length; equal texts have equal fingerprints, and repeated rows stay.
    """
    pairs = edited_pairs(table(spark, sf_dir, "documents"))
    found = pairs.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    for text, out in (("text", "fingerprint"), ("edited", "edited_fingerprint"), ("next_text", "next_fingerprint")):
        found = fingerprint(found, text, out)
    hashes = {c: F.transform(c, hash_of) for c in ("fingerprint", "edited_fingerprint", "next_fingerprint")}
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        spelled(F.col("fingerprint")).alias("fingerprint"),
        spelled(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(hashes["fingerprint"], hashes["edited_fingerprint"]).alias("near_edited"),
        likeness(hashes["fingerprint"], hashes["next_fingerprint"]).alias("near_next"),
    )
