import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import dedup
from factloom.llm.simhash import words_of


def shingles(text):
    w = words_of(text or "")
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return words_of(a or "") == words_of(b or "") or bool(x | y) and len(x & y) / len(x | y) >= 0.8


def brute(rows):
    """The first row of each group of similar texts, by comparing all pairs."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if similar(rows[a][1], rows[b][1]):
                root[find(a)] = find(b)
    first = {}
    for i in order:
        first.setdefault(find(i), rows[i])
    return first.values()


def corpus(seed, families=25):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(400)]
    rows = []
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.randrange(120, 400))
        rows.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            text = " ".join(copy)
            rows.append(text if rng.random() < 0.7 else text.upper().replace(" ", "\n"))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_one_of_each_group_stays(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, row string")
    kept = dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    got, want = sorted(r.doc_id for r in kept.collect()), sorted(i for i, _ in brute(rows))
    assert got == want


def test_nulls_empties_and_repeated_rows(spark):
    rows = [(5, None), (3, ""), (4, " \n"), (None, "alone in the world of words"), (None, "Alone in the world of WORDS"), (7, "same"), (7, "same"), (8, "other"), (7, "different text under one id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((str(r.doc_id), (r.text or "").lower()) for r in dedup.one_of_each(docs).collect())
    assert kept == sorted([("3", ""), ("None", "alone in the world of words"), ("7", "same"), ("8", "other"), ("7", "different text under one id")])
    assert dedup.one_of_each(docs.limit(0)).count() == 0


def test_a_large_group_gives_no_pairs_of_all(spark):
    rng = random.Random(6)
    base = ["w%d" % rng.randrange(10_000) for _ in range(300)]
    rows = []
    for i in range(150):
        copy = list(base)
        copy[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = dedup.signatures(docs, spark.sparkContext.broadcast(dedup.common_shingles(docs)))
    nodes = found.select(F.col("doc_id").alias("number"), F.col("doc_id").alias("first_id"), "fp")
    n = dedup.candidates(nodes).count()
    assert 149 <= n <= 2 * 150 * (2 ** (dedup.RADIUS + 1) - 1) and n < 150 * 149 / 2
    assert dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).count() == 1


def test_sketch_of_a_short_text_is_exact(spark):
    a, b = (" ".join(random.Random(s).choices("abcd", k=60)) for s in (1, 2))
    x, y = shingles(a), shingles(b)
    df = spark.createDataFrame([(dedup.sketch(words_of(a)).tolist(), dedup.sketch(words_of(b)).tolist())], "a array<int>, b array<int>")
    assert df.select(dedup.similarity(F.col("a"), F.col("b"))).first()[0] == len(x & y) / len(x | y)


def test_similar_texts_out_of_reach_of_fingerprints_are_found(spark):
    rng = random.Random(17)
    vocabulary = [f"w{i}" for i in range(3_000)]
    rows = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randrange(150, 500))
        scattered = list(base)
        for at in range(25, len(base), 50):
            scattered[at] = rng.choice(vocabulary)
        rows += [base, base[: round(0.83 * len(base))], base + rng.choices(vocabulary, k=len(base) // 6), scattered]
    rows = list(enumerate(" ".join(r) for r in rows))
    got = sorted(r.doc_id for r in dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(i for i, _ in brute(rows))


def test_prefixes_of_similar_sets_meet_in_any_order():
    rng = np.random.default_rng(3)
    for _ in range(300):
        pool = np.sort(rng.choice(1_000, rng.integers(1, 60), replace=False))
        a, b = (pool[rng.random(len(pool)) < 0.95] for _ in range(2))
        common = np.sort(rng.choice(pool, rng.integers(0, len(pool) + 1), replace=False))
        holders = rng.integers(3, 9, len(common))
        if len(a) and len(b) and len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8:
            assert len(np.intersect1d(dedup.prefix(a, common, holders), dedup.prefix(b, common, holders)))


def test_the_most_frequent_shingles_are_kept(spark, monkeypatch):
    monkeypatch.setattr(dedup, "COUNTED", 1.0)
    rows = [(i, " ".join(f"{k}x{j}" for j in range(8))) for k, n in (("a", 9), ("b", 5), ("c", 4), ("d", 2)) for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    for most, want in ((100, [9] * 4 + [5] * 4 + [4] * 4), (8, [9] * 4 + [5] * 4), (3, [9] * 3), (0, [])):
        monkeypatch.setattr(dedup, "COMMON", most)
        for classes in (50_000, 5):
            monkeypatch.setattr(dedup, "CLASSES", classes)
            common, holders = dedup.common_shingles(docs)
            assert list(common) == sorted(set(common)) and len(holders) <= most
            if classes > 9 and most >= 4:
                assert sorted(holders, reverse=True) == want
    none, _ = dedup.common_shingles(docs.limit(0))
    assert len(none) == 0


def test_members_of_a_bucket_that_no_links_connect_all_meet(spark):
    roots = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (4, 3), (3, 3)], "node long, root long")
    group = {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6}
    want = {(a, b) for b in group for a in range(b) if group[a] != group[b]}

    def found(size):
        rows = [(1, n, size.get(n, 100), size.get(n, 100) * 1.25) for n in range(7)] + [(2, n, 100, 125.0) for n in range(2)]
        return [(r.a, r.b) for r in dedup.across(spark.createDataFrame(rows, "bucket long, number long, size int, reach double"), roots).collect()]

    assert set(found({})) == want and len(found({})) == len(want)
    assert set(found({6: 70})) == {p for p in want if 6 not in p}


@pytest.mark.parametrize("common", [0, 40, 1_000_000])
def test_crowded_shingles_lose_no_links(spark, monkeypatch, common):
    """Passages that many texts share crowd their buckets, whether none, some or all of their shingles come last."""
    monkeypatch.setattr(dedup, "COUNTED", 1.0)
    monkeypatch.setattr(dedup, "COMMON", common)
    rng = random.Random(common)
    passages = [[f"p{k}x{i}" for i in range(60)] for k in range(3)]
    rows = []
    for i in range(120):
        base = list(rng.choice(passages))
        own = [f"o{i}x{j}" for j in range(rng.choice([2, 5, 8, 12, 40, 90]))]
        rows.append(own[: len(own) // 2] + base + own[len(own) // 2 :])
        if i % 3 == 0:
            copy = list(rows[-1])
            copy[rng.randrange(len(copy))] = f"z{i}"
            rows.append(copy)
    rows += [passages[0] + passages[1], passages[1] + passages[0], passages[0] + passages[1] + ["end"]]
    rng.shuffle(rows)
    rows = list(enumerate(" ".join(r) for r in rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in dedup.one_of_each(docs).collect())
    assert got == sorted(i for i, _ in brute(rows))


def test_similar_texts_behind_unrelated_leaders_are_found(spark):
    rng = random.Random(29)
    bases = [[f"v{rng.randrange(10**6)}" for _ in range(200)] for _ in range(4)]
    oldest = [b[at : at + 5] for b in bases for at in range(196)]
    last = [b[at : at + 6] for b in bases for at in range(195)]
    rows = list(enumerate(" ".join(r) for r in [*oldest, *bases, *(b[:166] for b in bases), *last]))
    cut = {len(oldest) + len(bases) + i for i in range(len(bases))}
    got = {r.doc_id for r in dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i for i, _ in rows} - cut


def test_long_texts_near_the_bound_are_decided_exactly(spark):
    rng = random.Random(31)
    rows, cut = [], set()
    for i in range(24):
        base = [f"u{rng.randrange(10**7)}" for _ in range(2_504)]
        share = 0.79 if i % 2 else 0.81
        cut |= {2 * i + 1} if share > 0.8 else set()
        rows += [base, base[: round(share * 2_500) + 4]]
    rows = list(enumerate(" ".join(r) for r in rows))
    got = {r.doc_id for r in dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i for i, _ in rows} - cut


def test_counts_by_part_never_tell_similar_sets_apart(spark):
    rng = np.random.default_rng(5)
    rows, alike = [], []
    for _ in range(200):
        pool = np.unique(rng.integers(-(2**31), 2**31, rng.integers(1, rng.choice([400, 40_000]))).astype(np.int32))
        a, b = (pool[rng.random(len(pool)) < rng.choice([0.5, 0.93, 1.0])] for _ in range(2))
        union = len(np.union1d(a, b))
        alike.append(not union or len(np.intersect1d(a, b)) / union >= 0.8)
        rows.append((len(rows), dedup.parts(a).tolist(), dedup.parts(b).tolist(), len(a) + len(b)))
    assert max(max(r[1]) for r in rows) == dedup.MOST
    df = spark.createDataFrame(rows, "i int, a array<tinyint>, b array<tinyint>, n int")
    got = {r.i: r.ok for r in df.select("i", dedup.possible(F.col("a"), F.col("b"), F.col("n")).alias("ok")).collect()}
    assert all(got[i] for i in range(len(rows)) if alike[i]) and any(alike) and not all(got.values())
