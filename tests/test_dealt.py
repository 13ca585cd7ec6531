"""How often plans deal out their rows: what is shuffled lies on disk."""

import math
import random
import re
from pathlib import Path

import numpy as np
import pytest

from factloom.kinds import lowering
from factloom.operators import spatial, stacks
from factloom.plans import catalog
from tests.test_lowering import FINDING, FRAGMENT
from tests.test_space import shapes

SF = "/root/testdata/sf0.001"
SHAPES = "sheet int, item int, shape array<array<double>>"


@pytest.fixture
def exchanges(spark):
    """Shuffles of a plan as it is without sizes of tables."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield lambda df: len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))
    for k, v in before.items():
        spark.conf.set(k, v)


def test_shapes_are_dealt_out_once_for_all_predicates(spark, exchanges):
    assert exchanges(catalog.plans()["spatial_predicates"](spark, SF)) <= 4


@pytest.mark.parametrize("cell", [0.4, 3.0, 50.0])
def test_predicates_at_once_equal_all_pairs(spark, cell):
    rng = random.Random(12)
    a, b = shapes(rng, 80) + [(7, 900, [[0.0, 0.0]])], shapes(rng, 50)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        asked = spatial.Asked(inside="inside", within={"meets": 0.0, "near": 4.0}, spaced=("spaced", 6.0), covered=("covered", 7.0, 1.5))
        made = spatial.judged(spark.createDataFrame(a, SHAPES), spark.createDataFrame(b, SHAPES), ["sheet"], "item", asked, cell)
        got = {(r.predicate, r.item): r.holds for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    a, b = ([(s, i, np.array(p)) for s, i, p in rows] for rows in (a, b))
    want, centre = {}, {i: (s, p.mean(0)) for s, i, p in a}
    for s, i, p in a:
        if on := [q for t, _, q in b if t == s]:
            gaps = [spatial.gap(p, q) for q in on]
            want |= {("inside", i): any(all(spatial._holds(q, *x) for x in p) for q in on), ("meets", i): min(gaps) <= 1e-9, ("near", i): min(gaps) <= 4 + 1e-9}
        others = [c for j, (t, c) in centre.items() if t == s and j != i]
        want["spaced", i] = not others or any(math.dist(c, centre[i][1]) <= 6 + 1e-9 for c in others)
    for s, i, q in b:
        if len(q) > 2:
            low, high = q.min(0), q.max(0)
            xs, ys = (low[k] + 1.5 * np.arange(int((high[k] - low[k]) / 1.5 + 1e-9) + 1) for k in (0, 1))
            points = [*q, *((x, y) for x in xs for y in ys if spatial._holds(q, x, y))]
            want["covered", i] = all(any(t == s and math.dist(c, x) <= 7 + 1e-9 for t, c in centre.values()) for x in points)
    assert got == want
    assert {v for (k, _), v in want.items() if k == "covered"} == {True, False}


def test_stacks_are_dealt_out_once(spark, exchanges):
    before = len(list(Path(spark.conf.get("spark.checkpoint.dir")).rglob("rdd-*")))
    assert exchanges(catalog.plans()["kind_layers"](spark, SF)) <= 2
    assert len(list(Path(spark.conf.get("spark.checkpoint.dir")).rglob("rdd-*"))) <= before


def test_operations_of_stacks_need_no_further_deal(spark, exchanges):
    assert exchanges(catalog.plans()["layer_operations"](spark, SF)) <= 1


def test_the_nth_of_a_material_is_moved_to_the_nth(spark):
    layers = lambda names: [(n if n.isalpha() else None, n, 1.0) for n in names]
    cases = {"o1": ("abcd", "bcda"), "o3": ("1bcd", "bcd1"), "o4": ("", "ab"), "o5": ("abcdea", "bcdeaqa")}
    rows = [(o, layers(a), layers(b), 0.5) for o, (a, b) in cases.items()]
    pairs = spark.createDataFrame(rows, f"o string, before {stacks.LAYERS}, after {stacks.LAYERS}, tolerance double")
    none = spark.createDataFrame([], "was string, now string, verdict string")
    got = {}
    for r in stacks.operations(pairs, ["o"], none).orderBy("o", "step").collect():
        got.setdefault(r.o, []).append((r.op, r.before_at, r.after_at))
    same = lambda *pairs: [("match", i, j) for i, j in pairs]
    assert got["o1"] == [("reorder", 0, 3), *same((1, 0), (2, 1), (3, 2))]
    assert got["o3"] == [("reorder", 0, 3), *same((1, 0), (2, 1), (3, 2))]
    assert got["o4"] == [("insert_layer", None, 0), ("insert_layer", None, 1)]
    assert sorted(x[0] for x in got["o5"]).count("reorder") == 1 and [x[0] for x in got["o5"]].count("insert_layer") == 1
    assert {(r.o, r.op) for r in stacks.operations(spark.createDataFrame([("e", [], [], 0.5)], pairs.schema), ["o"], none, every=True).collect()} == {("e", None)}


def test_doors_are_dealt_out_once(spark, exchanges):
    before = len(list(Path(spark.conf.get("spark.checkpoint.dir")).rglob("rdd-*")))
    assert exchanges(catalog.plans()["kind_direction"](spark, SF)) <= 1
    assert len(list(Path(spark.conf.get("spark.checkpoint.dir")).rglob("rdd-*"))) <= before


def test_fragments_are_dealt_out_once(spark, exchanges, monkeypatch):
    before = len(list(Path(spark.conf.get("spark.checkpoint.dir")).rglob("rdd-*")))
    found = catalog.plans()["kind_lowering"](spark, SF)
    assert exchanges(found) <= 8
    assert len(list(Path(spark.conf.get("spark.checkpoint.dir")).rglob("rdd-*"))) <= before
    want = sorted(found.collect())
    monkeypatch.setattr(lowering, "MOST_MARKS", 0)
    assert sorted(catalog.plans()["kind_lowering"](spark, SF).collect()) == want


def test_a_finding_without_fragments_is_missing_evidence_of_both_sides(spark):
    finding = [("x", "o", "P", "CMP", "CANDIDATE", "10", "7", False, False)]
    fragments = spark.createDataFrame([], FRAGMENT)
    (r,) = lowering.lower(spark.createDataFrame(finding, FINDING), fragments).collect()
    assert (r.status, r.steps, r.change) == ("NOT_COMPARABLE", ["VER-02"], None)
