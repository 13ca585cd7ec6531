import random

from pyspark.sql import functions as F

from factloom import kinds
from factloom.operators import stacks

MENTIONS = "object_id string, param_code string, stage string, item string, layers array<struct<m:string,raw:string,t:double>>, role string, confidence double, file_id string, page int"
GROUPS = {"pvc": "film", "tpo": "film", "bitumen": "roll", "wool": "warm"}


def every_alignment(a, b, i, j):
    """All paths from places (i, j) back to the start, with their worth; letters sort as ties are broken."""
    if not i and not j:
        yield 0, ""
        return
    if i and j:
        x, y = a[i - 1], b[j - 1]
        worth = 3 if x[0] is not None and x[0] == y[0] else 0 if not x[1] or not y[1] else 1 if x[2] is not None and x[2] == y[2] else -5
        for s, p in every_alignment(a, b, i - 1, j - 1):
            yield s + worth, "D" + p
    if j:
        for s, p in every_alignment(a, b, i, j - 1):
            yield s - 2, "I" + p
    if i:
        for s, p in every_alignment(a, b, i - 1, j):
            yield s - 2, "X" + p


def test_alignment_equals_exhaustive_search():
    rng = random.Random(4)
    kinds_of = [("a", 1, "g"), ("b", 1, "g"), ("c", 1, "h"), ("d", 1, None), ("~x", 0, None), (None, 0, None)]
    pairs = [([rng.choice(kinds_of) for _ in range(rng.randrange(5))], [rng.choice(kinds_of) for _ in range(rng.randrange(5))]) for _ in range(400)]
    found = list(stacks.steps(*stacks.scores([a for a, _ in pairs], [b for _, b in pairs])))
    for (a, b), path in zip(pairs, found):
        best = min((-s, p) for s, p in every_alignment(a, b, len(a), len(b)))[1][::-1]
        assert "".join("I" if i < 0 else "X" if j < 0 else "D" for i, j in path) == best
        assert [i for i, _ in path if i >= 0] == list(range(len(a))) and [j for _, j in path if j >= 0] == list(range(len(b)))


def findings(spark, cases):
    """(status, worst, operations, violations) of each case, evaluated together as an object each."""
    layer = lambda x: (x[0], x[1] if len(x) > 2 else x[0] or "?", float(x[-1]) if x[-1] is not None else None)
    rows, denied, asked = [], [("none", "roof", True)], []
    for n, (before, after, more) in enumerate(cases):
        marks, roles = more.get("marks", ("K-1", "k 1")), more.get("roles", ("CURRENT", "CURRENT"))
        asked.append((f"o{n}", "P"))
        rows += [(f"o{n}", "P", s, mark, [layer(x) for x in stack], role, 0.9, s, 1) for s, stack, mark, role in zip(("PD", "RD"), (before, after), marks, roles) if stack is not None]
        denied += [(f"o{n}", "roof", False)] * more.get("denied", 0)
    params = spark.createDataFrame([("P", "layers", 1.0, "roof")], "param_code string, kind string, tolerance double, applicability string")
    analogs = spark.createDataFrame([("pvc", "tpo", "EQUIVALENT"), ("pvc", "bitumen", "NOT_EQUIVALENT")], "was string, now string, verdict string")
    profiles = spark.createDataFrame(denied, "object_id string, flag string, value boolean")
    found = kinds.evaluate("layers", spark.createDataFrame(rows, MENTIONS), params, analogs=analogs, groups=GROUPS, profiles=profiles, asked=spark.createDataFrame(asked, "object_id string, param_code string"))
    got = {f.object_id: (f.status, f.worst, f.operations, f.violations) for f in found.collect()}
    return [got[o] for o, _ in asked]


PVC, TPO, WOOL, SAND, FOIL = ("pvc", 2), ("tpo", 2), ("wool", 150), ("sand", 100), ("foil", 1)


CASES = [
    ([PVC, WOOL, SAND], [PVC, WOOL, SAND], ("NEGATIVE_VERIFIED", None, 3, 0)),
    ([PVC, FOIL, WOOL], [PVC, WOOL], ("CANDIDATE", "delete_layer", 3, 1)),
    ([PVC, WOOL], [PVC, FOIL, WOOL], ("NEGATIVE_VERIFIED", None, 3, 0)),
    ([PVC, WOOL], [TPO, WOOL], ("NEGATIVE_VERIFIED", None, 2, 0)),
    ([("pvc", 4), WOOL], [("tpo", 2), WOOL], ("CANDIDATE", "thickness_down", 3, 1)),
    ([PVC, WOOL], [("bitumen", 2), WOOL], ("CANDIDATE", "delete_layer", 3, 1)),
    ([WOOL, PVC], [("wool", 120), PVC], ("CANDIDATE", "thickness_down", 2, 1)),
    ([WOOL, PVC], [("wool", 151), ("pvc", 9)], ("NEGATIVE_VERIFIED", None, 2, 0)),
    ([WOOL, PVC], [("wool", None), PVC], ("NEGATIVE_VERIFIED", None, 2, 0)),
    ([PVC, (None, "old felt", 5)], [PVC, (None, "new felt", 5)], ("NOT_COMPARABLE", None, 2, 0)),
    ([PVC, (None, "Old felt", 5)], [PVC, (None, "old  FELT", 5)], ("NEGATIVE_VERIFIED", None, 2, 0)),
    ([PVC, WOOL, SAND, FOIL], [WOOL, SAND, FOIL, PVC], ("CANDIDATE", "reorder", 4, 1)),
    ([PVC, ("wool", 200)], [PVC, WOOL, ("wool", 50)], ("NEGATIVE_VERIFIED", None, 2, 0)),
    ([PVC], None, ("MISSING_EVIDENCE", None, 0, 0)),
]


def test_each_operation_and_status(spark):
    assert findings(spark, [(before, after, {}) for before, after, _ in CASES]) == [want for *_, want in CASES]


def test_gates_marks_and_likeness(spark):
    cases = [
        ([PVC], [PVC], {"denied": 1}, "NOT_APPLICABLE"), ([PVC], [PVC], {"roles": ("CURRENT", "CONFLICT")}, "CLARIFICATION_REQUIRED"),
        ([PVC], [PVC], {"roles": ("CURRENT", "SUPERSEDED")}, "MISSING_EVIDENCE"), ([PVC, WOOL], [SAND, FOIL], {"marks": ("K-1", "K-2")}, "NOT_COMPARABLE"),
        ([PVC, WOOL], [PVC, WOOL], {"marks": ("K-1", "K-2")}, "NEGATIVE_VERIFIED"), ([PVC, WOOL], [SAND, FOIL], {"marks": ("K-1", None)}, "CANDIDATE"),
    ]
    assert [f[0] for f in findings(spark, [c[:3] for c in cases])] == [c[3] for c in cases]


def test_stacks_without_marks_find_the_most_alike_that_is_free(spark):
    from factloom.kinds.layers import paired, usable

    rows = []
    for no, (stage, mark, names) in enumerate([("PD", None, "abc"), ("PD", None, "abd"), ("PD", "Z", "xyz"), ("RD", None, "abc"), ("RD", None, "abcd"), ("RD", None, "xyq"), ("RD", "Y", "kkk"), ("ID", "Z", "x")]):
        rows.append(("o", "P", stage, mark, [(c, c, 1.0) for c in names], "CURRENT", 0.9 - no / 100, stage, no))
    params = spark.createDataFrame([("P", "layers", 1.0)], "param_code string, kind string, tolerance double")
    got = sorted((r.stage, r.before_no, r.after_no) for r in paired(usable(spark.createDataFrame(rows, MENTIONS), params)).collect())
    assert got == [("ID", 3, 1), ("RD", 1, 1), ("RD", 2, 2), ("RD", 3, 3)]


def test_runs_of_unknown_material_stay_apart(spark):
    df = spark.range(1).select(stacks.merged_runs(F.expr("array(struct(null as m, '' as raw, 1d as t), struct(null as m, '-' as raw, 1d as t), struct('a' as m, 'A' as raw, 1d as t), struct('a' as m, 'B' as raw, cast(null as double) as t))")).alias("v"))
    assert [tuple(x) for x in df.collect()[0].v] == [(None, "", 1.0), (None, "-", 1.0), ("a", "A + B", None)]
