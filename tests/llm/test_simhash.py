import random

import xxhash
from pyspark.sql import functions as F

from factloom.llm import simhash
from factloom.operators.components import components


def brute_fingerprint(text):
    words = [w for w in text.encode().lower().replace(b"\x0b", b" ").split() if w]
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks):
    ids = sorted(marks)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (marks[i] ^ marks[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_masks_cover_every_pair_of_bits():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        rng = random.Random(radius)
        for _ in range(300):
            differ = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(m & differ == 0 for m in masks)


def test_links_are_those_of_brute_force(spark):
    rng = random.Random(3)
    marks = {}
    for i in range(400):
        base = marks[rng.randrange(i)] if i and rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randrange(4)):
            base ^= 1 << rng.randrange(64)
        marks[i] = base
    signed = [(i, m - (1 << 64) if m >> 63 else m) for i, m in marks.items()]
    nodes = spark.createDataFrame(signed, "first_id long, fp long").groupBy("fp").agg(F.min("first_id").alias("first_id"))
    root = {r.node: r.root for r in components(simhash.linked_fingerprints(nodes)).collect()}
    got = {}
    for i, fp in signed:
        got.setdefault(root.get(fp, fp), []).append(i)
    want = {}
    for i, r in brute_components(marks).items():
        want.setdefault(r, []).append(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_whole_query_and_its_edge_cases(spark):
    texts = ["One two three four", "one TWO three\tfour", "", None, "  \n", "one", "École ÉCOLE x y z", "a b", "a b", "w " * 5000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    marks = {i: brute_fingerprint(t or "") for i, t in enumerate(texts)}
    want = brute_components(marks)
    for r in found:
        assert r.fp & (2**64 - 1) == marks[r.doc_id]
        assert r.component_id == want[r.doc_id]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []


def test_long_texts_are_counted_in_blocks(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefg", k=1000))
    whole = simhash.fingerprint(text)
    for block in (7, 99, 998, 1000):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert simhash.fingerprint(text) == whole
    assert whole & (2**64 - 1) == brute_fingerprint(text)
