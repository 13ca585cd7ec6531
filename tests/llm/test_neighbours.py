import numpy as np
import pytest

from factloom.llm import neighbours as ann


def clustered(n, dim=16, centres=40, seed=1):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((centres, dim))[rng.integers(centres, size=n)] * 3 + rng.standard_normal((n, dim))


def exact(x, ids, query, k=10):
    d = np.sqrt(((x - x[ids == query][0]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != query][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def frame(spark, x, ids):
    rows = [(int(i), [float(v) for v in row], 5) for i, row in zip(ids, x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, part int")


def test_parts_are_balanced():
    graph = ann.neighbour_graph(clustered(1000), 10)
    for parts in (2, 8, 16):
        sizes = np.bincount(ann.balanced_parts(graph, parts), minlength=parts)
        assert sizes.max() - sizes.min() <= np.log2(parts) + 1
    part = ann.balanced_parts(graph, 8)
    kept = (part[graph] == part[:, None]).mean()
    assert kept > 3 / 8  # far more edges stay inside than a random cut leaves


def test_graph_is_that_of_brute_force():
    x = clustered(700)
    graph = ann.neighbour_graph(x, 5)
    for i in (0, 350, 699):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        assert set(graph[i]) == set(np.argsort(d)[:5])


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(ann, "PART_ROWS", 150)
    x, ids = clustered(3000, seed=seed).astype(np.float32).astype(float), np.arange(3000)
    vectors = frame(spark, x, ids)
    found = {}
    for r in ann.search(vectors, vectors.where("vec_id % 100 = 0")).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, 3000, 100))
    hits = 0
    for q, rows in found.items():
        rows.sort()
        want = dict(exact(x, ids, q))
        assert [r for r, _, _ in rows] == list(range(1, 11))
        assert [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
        for _, v, s in rows:
            assert np.isclose(s, np.sqrt(((x[v] - x[q]) ** 2).sum()), rtol=1e-12)
        hits += sum(v in want for _, v, _ in rows)
    assert hits / (10 * len(found)) >= 0.9


def recall(found, x, ids, queries):
    hits = total = 0
    for q in queries:
        want = dict(exact(x, ids, q))
        rows = [r for r in found if r.query_id == q]
        assert sorted(r["rank"] for r in rows) == list(range(1, len(want) + 1))
        hits, total = hits + sum(r.vec_id in want for r in rows), total + len(want)
    return hits / total


def test_parts_of_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 100)
    monkeypatch.setattr(ann, "MOST_PARTS", 4)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 150)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    x, ids = clustered(2500, seed=4).astype(np.float32).astype(float), np.arange(2500)
    vectors = frame(spark, x, ids)
    cuts = []
    monkeypatch.setattr(ann.Levels, "cut", lambda self, large, cut=ann.Levels.cut: (cuts.append(large.count()), cut(self, large)))
    found = ann.search(vectors, vectors.where("vec_id % 100 = 0")).collect()
    assert cuts and recall(found, x, ids, range(0, 2500, 100)) >= 0.9


def test_recall_on_the_embeddings(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], dtype=float), np.array([r.vec_id for r in rows])
    found = ann.op3_neighbours(spark, "/root/testdata/sf0.1").collect()
    assert recall(found, x, ids, ids[ids % 100 == 0]) >= 0.9


def test_repeated_ids_crowd_nobody_out(spark):
    rows = [(0, [0.0, 1.0]), (0, [0.0, 0.5])] + [(1, [0.001 * i, 0.6]) for i in range(40)] + [(i, [float(i), 1.0]) for i in range(2, 32)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted((r["rank"], r.vec_id) for r in ann.search(vectors, vectors.where("vec_id = 0")).collect())
    assert found == [(i, i) for i in range(1, 11)]
    (first,) = [r.score for r in ann.search(vectors, vectors.where("vec_id = 0")).collect() if r["rank"] == 1]
    assert np.isclose(first, np.float64(np.float32(0.6)) - 0.5)  # asked with the smaller of its two vectors


def test_queries_in_nearly_empty_parts_visit_more(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 40)
    monkeypatch.setattr(ann, "AIM", 0.01)
    x, ids = clustered(600, centres=80, seed=6).astype(np.float32).astype(float), np.arange(600)
    vectors = frame(spark, x, ids)
    found = ann.search(vectors, vectors.where("vec_id % 20 = 0"), probes=1).collect()
    assert {q: sum(r.query_id == q for r in found) for q in range(0, 600, 20)} == {q: 10 for q in range(0, 600, 20)}


def test_one_vector_that_most_rows_share(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 8)).astype(np.float32).astype(float)
    x[rng.random(1500) < 0.6] = x[0]
    ids = np.arange(1500) * 3
    vectors = frame(spark, x, ids)
    found = {}
    for r in ann.search(vectors, vectors.where("vec_id % 300 = 0")).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, rows in found.items():
        assert [(v, s) for _, v, s in sorted(rows)] == exact(x, ids, q)


def test_vectors_that_take_no_part(spark):
    good = [[float(i), 1.0] for i in range(6)]
    rows = [(i, v) for i, v in enumerate(good)]
    rows += [(100, None), (200, [0.0, 0.0]), (300, [float("nan"), 1.0]), (400, [1.0, float("inf")]), (500, [1.0, None]), (600, []), (None, [1.0, 1.0]), (700, [1.0, 2.0, 3.0]), (3, [3.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.search(vectors, vectors.where("vec_id % 100 = 0")).collect()
    assert {r.query_id for r in found} == {0}
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(i, i, float(i)) for i in range(1, 6)]
    assert ann.search(vectors.limit(0), vectors.limit(0)).count() == 0
