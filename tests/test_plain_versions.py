"""Queries that SQL can't express, against plain versions."""

import math

import duckdb
import numpy as np
import pyarrow as pa

from factloom.operators import geometry as operators
from factloom.plans import catalog, geometry

SF_DIR = "/root/testdata/sf0.001"


def test_bootstrap_interval_is_that_of_resampling(spark):
    rows = duckdb.sql(f"select source, sum(quality), count(*) from '{SF_DIR}/documents.parquet' join '{SF_DIR}/labels.parquet' using (doc_id) group by 1").fetchall()
    k, n = (np.array([r[i] for r in rows], dtype=float) for i in (1, 2))
    rng = np.random.default_rng(1)
    drawn = rng.integers(len(k), size=(20_000, len(k)))
    low, high = np.percentile(k[drawn].sum(1) / n[drawn].sum(1), [2.5, 97.5])
    r = catalog.plans()["bootstrap_interval"](spark, SF_DIR).first()
    assert abs(r.low - low) < 0.03 and abs(r.high - high) < 0.03 and r.replicates == 1000


def test_greedy_match_is_that_of_a_walk(spark):
    pairs = duckdb.sql(
        f"""
        select a.l_orderkey as k, a.l_linenumber as l, b.l_linenumber as r, abs(a.q - b.q) as d from
          (select l_orderkey, l_linenumber, max(l_quantity) as q from '{SF_DIR}/lineitem.parquet' where l_returnflag = 'A' group by 1, 2) a join
          (select l_orderkey, l_linenumber, max(l_quantity) as q from '{SF_DIR}/lineitem.parquet' where l_returnflag = 'R' group by 1, 2) b
          on a.l_orderkey = b.l_orderkey and abs(a.q - b.q) <= 10
        """
    ).fetchall()
    used, want = set(), set()
    for k, left, right, d in sorted(pairs, key=lambda p: (p[0], p[3], p[1], p[2])):
        if (k, "l", left) not in used and (k, "r", right) not in used:
            used |= {(k, "l", left), (k, "r", right)}
            want.add((k, left, right))
    got = catalog.plans()["greedy_match"](spark, SF_DIR)
    assert {(r.k, r.l, r.r) for r in got.select("k", "l", "r").collect()} == want


def test_word_errors_of_conversations(spark):
    turns = duckdb.sql(f"select conv_id, turn, coalesce(text, '') from '{SF_DIR}/conversations.parquet' order by 1, 2").fetchall()
    want = {}
    for (conv, _, a), (other, _, b) in zip(turns, turns[1:]):
        a, b = a.lower().split(), b.lower().split()
        if conv != other or not a:
            continue
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                before, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, before + (x != y))
        errors, total = want.get(conv, (0, 0))
        want[conv] = (errors + d[-1], total + len(a))
    got = {r.conv_id: (r.errors, r.total) for r in catalog.plans()["word_errors"](spark, SF_DIR).collect()}
    assert got == want


def test_shape_change_in_plain_loops(spark):
    rooms = {r.p_partkey: [tuple(p) for p in r.polygon] for r in geometry._rooms(spark, SF_DIR).collect()}
    found = catalog.plans()["shape_change"](spark, SF_DIR).collect()
    assert {r.p_partkey for r in found} == set(rooms)

    def to_segment(p, a, b):
        length = math.dist(a, b) ** 2
        t = 0.0 if not length else min(1.0, max(0.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / length))
        return math.dist(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))

    for r in found:
        here = rooms[r.p_partkey]
        there = [(x + 2.0, y - 1.0) for x, y in here]
        one_way = lambda a, b: max(min(math.dist(p, q) for q in b) for p in a)
        assert math.isclose(r.moved, max(one_way(here, there), one_way(there, here)), abs_tol=1e-9)
        assert math.isclose(r.edge, min(to_segment((5.0, 3.0), a, b) for a, b in zip(here, [*here[1:], here[0]])), abs_tol=1e-9)


def test_contours_are_met_in_whole_batches(spark):
    df = catalog.plans()["shape_change"](spark, SF_DIR)
    assert "RepartitionByExpression" in df._jdf.queryExecution().optimizedPlan().toString()
    rng = np.random.default_rng(3)
    shapes = lambda n: [None if i % 17 == 0 else [[float(v) for v in p] for p in rng.integers(0, 9, (int(rng.integers(1, 7)), 2))] for i in range(n)]
    a, b = shapes(120), shapes(119) + [[]]

    def along(c):
        both = np.array(x + y)
        step = max(float((both.max(0) - both.min(0)).max()) / operators.STEPS, 1e-9)
        for p, q in zip(np.array(c), np.array([*c[1:], c[0]])):
            n = max(int(np.ceil(math.dist(p, q) / step)), 1)
            yield from (p + i / n * (q - p) for i in range(n))

    def to_edges(p, c):
        c = np.array(c)
        d = np.roll(c, -1, axis=0) - c
        t = np.clip(((p - c) * d).sum(1) / np.maximum((d**2).sum(1), 1e-300), 0, 1)
        return np.sqrt(((c + t[:, None] * d - p) ** 2).sum(1)).min()

    got = spark.createDataFrame(list(zip(range(120), a, b)), "i int, a array<array<double>>, b array<array<double>>").select("i", operators.hausdorff("a", "b").alias("h")).collect()
    assert len(got) == 120
    for i, h in got:
        x, y = a[i], b[i]
        if not x or not y:
            assert h is None
        else:
            assert abs(h - max(max(to_edges(p, y) for p in along(x)), max(to_edges(p, x) for p in along(y)))) < 1e-9


def test_areas_shared_in_one_batch_are_those_of_a_clip():
    rng = np.random.default_rng(5)

    def convex(n):
        angles = np.sort(rng.uniform(0, 2 * math.pi, n))
        return (rng.uniform(0, 3, 2) + 2 * np.stack([np.cos(angles), np.sin(angles)], axis=1)).tolist()

    def clipped(p, q):
        for (ax, ay), (bx, by) in zip(q, [*q[1:], q[0]]):
            side = lambda x, y, ax=ax, ay=ay, bx=bx, by=by: (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            kept = []
            for a, b in zip(p, [*p[1:], *p[:1]]):
                s, t = side(*a), side(*b)
                if s >= 0:
                    kept.append(a)
                if (s >= 0) != (t >= 0):
                    kept.append((a[0] + s / (s - t) * (b[0] - a[0]), a[1] + s / (s - t) * (b[1] - a[1])))
            p = kept
        return size(p)

    size = lambda p: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, [*p[1:], *p[:1]]))) / 2
    a, b = [None, [[0.0, 0.0], [1.0, 1.0]], *(convex(3 + i % 4) for i in range(60))], [convex(3 + i % 3) for i in range(62)]
    found = operators.polygon_iou.func(*(pa.array(x, pa.list_(pa.list_(pa.float64()))) for x in (a, b))).to_pylist()
    assert found[:2] == [None, None]
    for x, y, iou in zip(a[2:], b[2:], found[2:]):
        shared = clipped([tuple(p) for p in x], y)
        assert abs(iou - shared / (size(x) + size(y) - shared)) < 1e-9
