import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from factloom.llm import winnow


def plain(text):
    """Fingerprint by the definition in plain Python: (hash, position) of each window's minimum, rightmost of equals."""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
    mask, k, w = 2**64 - 1, winnow.GRAM, winnow.WINDOW
    base = [xxhash.xxh64_intdigest(x.encode(), 42) for x in [""] * (k - 1) + words]
    keys = []
    for i in range(len(words)):
        h = 0
        for x in base[i : i + k]:
            h = (h << 1 | h >> 63) & mask ^ x
        keys.append(xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42) >> 32)
    out = []
    for i in range(len(keys)):
        h, p = min((keys[j], -j) for j in range(max(0, i - w + 1), i + 1))
        if not out or out[-1] != (h, -p):
            out.append((h, -p))
    return out


def plain_string(text):
    return ",".join(f"{(h << 31) + (2**31 - 1 - p):016x}" for h, p in plain(text))


def plain_likeness(a, b):
    x, y = ({h for h, _ in plain(t)} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprint_is_that_of_the_definition(spark):
    rng = random.Random(8)
    texts = ["", "  \n", "one", "one two", "a b c", "a b c d", "a a a a a a a a a a", "x y x y x y x y x y"]
    texts += [" ".join(rng.choices("abcde", k=rng.randrange(5, 60))) for _ in range(12)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    got = winnow.fingerprint(df, "text", "f").withColumn("h", F.transform("f", winnow.hash_of)).withColumn("p", F.transform("f", winnow.position_of))
    for r in got.collect():
        assert list(zip(r.h, r.p)) == plain(texts[r.i]), texts[r.i]


def test_likeness_has_no_step_at_any_length(spark):
    """A text and the same with two more words stay alike, and an edit that keeps the first word shares a hash."""
    words = [f"w{i}" for i in range(60)]
    rows = [(n, " ".join(words[:n]), " ".join(words[: n + 2]), " ".join([*words[: (n + 1) // 2], "x", "y"])) for n in range(1, 50)]
    df = spark.createDataFrame(rows, "n int, a string, b string, c string").coalesce(1)
    for c in "abc":
        df = winnow.fingerprint(df, c, f"f{c}").withColumn(f"f{c}", F.transform(f"f{c}", winnow.hash_of))
    found = df.select("n", winnow.likeness(F.col("fa"), F.col("fb")).alias("more"), winnow.likeness(F.col("fa"), F.col("fc")).alias("edit")).collect()
    assert all(r.more >= r.n / (r.n + 4) / 2 and r.edit > 0 for r in found)


def test_shared_passage_is_always_found(spark):
    rng = random.Random(3)
    need = winnow.GRAM + winnow.WINDOW - 1
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for i in range(150):
        shared = [word() for _ in range(need)]
        rows.append((i, *(" ".join([word() for _ in range(rng.randrange(9))] + shared + [word() for _ in range(rng.randrange(9))]) for _ in range(2))))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    df = winnow.fingerprint(winnow.fingerprint(df, "a", "fa"), "b", "fb")
    near = df.select(winnow.likeness(F.transform("fa", winnow.hash_of), F.transform("fb", winnow.hash_of)).alias("n"))
    assert near.where("n <= 0").count() == 0


def test_pairs_and_edits(spark, tmp_path):
    rng = random.Random(6)
    texts = {i * 7 - 40: " ".join(rng.choices(["un", "deux", "très", "日本", "x"], k=rng.randrange(40))) for i in range(60)}
    texts[1000], texts[1001], texts[1002] = None, "", "same words here again and again to the end"
    texts[1003] = texts[1004] = " ".join(rng.choices("abcdefgh", k=60_000))
    rows = [(i, t, "clash", 1) for i, t in texts.items()]
    rng.shuffle(rows)
    docs = spark.createDataFrame([*rows, (None, "no id at all", "c", 2)], "doc_id long, text string, edited string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = winnow.op9_winnowing(spark, str(tmp_path))
    kinds = dict(out.dtypes)
    assert kinds["fingerprint"] == kinds["edited_fingerprint"] == "string" and kinds["near_edited"] == kinds["near_next"] == "double"
    found = {r.doc_id: r for r in out.collect()}
    ids = sorted(texts)
    assert len(found) == len(ids) + 1
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        text, other = texts[i] or "", texts[nxt] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert found[i].n_chars == len(text)
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert found[i].fingerprint == plain_string(text) and found[i].edited_fingerprint == plain_string(edited)
        assert abs(found[i].near_edited - plain_likeness(text, edited)) < 1e-12
        assert abs(found[i].near_next - plain_likeness(text, other)) < 1e-12
        if edited == text:
            assert found[i].fingerprint == found[i].edited_fingerprint and found[i].near_edited == 1


def test_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "b b b b"), (1, "a a a a"), (2, "c c c c"), (2, "c c c c")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.next_text) for r in winnow.edited_pairs(docs).collect())
    assert got == [(1, "a a a a", "c c c c"), (1, "b b b b", "c c c c"), (2, "c c c c", "a a a a"), (2, "c c c c", "a a a a")]
    assert winnow.edited_pairs(docs.limit(0)).count() == 0
    one = winnow.edited_pairs(docs.limit(1).select(F.lit(5).cast("long").alias("doc_id"), F.lit("abcd").alias("text"))).collect()
    assert [(r.doc_id, r.edited) for r in one] == [(5, "abab")]
