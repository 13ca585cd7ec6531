"""Every check that may lower a finding, alone, and cascades of any length."""

import pytest
from pyspark.sql import functions as F

from factloom.kinds.lowering import Gates, cascade_roots, is_refinement, lower

CA, CL, ME, NC, NV = "CANDIDATE", "CLARIFICATION_REQUIRED", "MISSING_EVIDENCE", "NOT_COMPARABLE", "NEGATIVE_VERIFIED"
FINDING = "finding_id string, object_id string, param_code string, op string, status string, expected string, actual string, threshold boolean, absence boolean"
FRAGMENT = (
    "finding_id string, side string, value string, stage string, document_code string, revision string, role string, approval_status string, file_id string, page int, "
    "bbox array<double>, doc_kind string, quality string, confidence double, unit string, method string"
)
BOX = [0.1, 0.1, 0.2, 0.2]


def run(spark, finding=None, expected=None, actual=None, extra=(), **tables):
    row = {"finding_id": "x", "object_id": "o", "param_code": "P", "op": "CMP", "status": CA, "expected": "10", "actual": "7", "threshold": False, "absence": False} | (finding or {})
    base = {"finding_id": "x", "document_code": "D", "revision": "1", "role": "CURRENT", "page": 1, "bbox": BOX, "doc_kind": "plan", "quality": "OK", "confidence": 0.9, "unit": "m", "method": "a"}
    parts = [base | {"side": "expected", "value": "10", "stage": "PD", "file_id": "pd"} | (expected or {}), base | {"side": "actual", "value": "7", "stage": "RD", "file_id": "rd"} | (actual or {})]
    parts = [p for p in parts + [base | e for e in extra] if p.get("side")]
    frame = lambda rows, schema: spark.createDataFrame([tuple(r.get(c.split(" ")[0]) for c in schema.split(", ")) for r in rows], schema)
    (r,) = lower(frame([row], FINDING), frame(parts, FRAGMENT), **tables).collect()
    return r.status, r.steps, r.change, r.flags


def test_nothing_to_lower(spark):
    assert run(spark) == (CA, [], "NONE", [])
    assert run(spark, {"status": ME}) == (ME, [], None, [])


@pytest.mark.parametrize(
    "what, status, step",
    [
        ({"actual": {"unit": "mm"}}, NC, "GTE-04"),
        ({"actual": {"doc_kind": "photo"}, "gates": Gates(sheet_kinds={"CMP": ["plan"]})}, NC, "GTE-04"),
        ({"actual": {"method": "b"}}, NC, "GTE-04"),
        ({"actual": {"quality": "ABSTAIN"}}, NC, "GTE-05"),
        ({"actual": {"confidence": 0.5}, "gates": Gates(min_confidence={"P": 0.6, "default": 0.1})}, NC, "GTE-05"),
        ({"actual": {"role": "UNRESOLVED"}}, CL, "VER-01"),
        ({"extra": [{"side": "actual", "value": "7", "stage": "RD", "file_id": "r2", "revision": "2"}]}, CL, "VER-01"),
        ({"expected": {"approval_status": "CANCELLED"}}, CL, "VER-03"),
        ({"expected": {"side": None}}, NC, "VER-02"),
        ({"finding": {"actual": "—"}, "actual": {"value": "—", "bbox": None}}, NC, "VER-02"),
        ({"finding": {"absence": True}}, ME, "VER-05"),
        ({"finding": {"expected": "5...8"}}, NV, "VER-07"),
    ],
)
def test_each_check(spark, what, status, step):
    got = run(spark, what.pop("finding", None), **what)
    assert got[:2] == (status, [step])


def test_gates_that_let_pass(spark):
    assert run(spark, actual={"method": "b"}, gates=Gates(equivalent_methods=[["a", "b"]]))[0] == CA
    assert run(spark, actual={"unit": "mm"}, gates=Gates(units_normalized=True))[0] == CA
    assert run(spark, {"threshold": True}, expected={"side": None})[0] == CA
    assert run(spark, {"status": NV}, actual={"unit": "mm"})[0] == NC
    more = [{"side": "actual", "value": "10", "stage": "ID", "file_id": "id"}]
    assert run(spark, {"status": NV, "actual": "10"}, actual={"unit": "mm"}, extra=more)[0] == NV  # not all pairs


def test_later_revisions_of_the_package(spark):
    def files(*rows):
        return spark.createDataFrame([("rd", "RD", "D", "1", None), *rows], "file_id string, stage string, document_code string, revision string, stamp_change int")

    assert run(spark, revisions=files(("r2", "RD", "D", "rev. 2", None)))[:2] == (CL, ["VER-03"])
    assert run(spark, revisions=files(("r2", "RD", "E", "2", None), ("r3", "ID", "D", "2", None), ("r0", "RD", "D", "0", None)))[0] == CA


def test_coverage_of_what_is_absent(spark):
    seen = lambda *rows: spark.createDataFrame([("o", *r) for r in rows], "object_id string, stage string, document_code string, parsed boolean, low_quality_pages int")
    assert run(spark, {"absence": True}, searched=seen(("RD", "D", True, 0)))[0] == CA
    assert run(spark, {"absence": True}, searched=seen(("RD", "D", True, 1)))[:2] == (NC, ["VER-05"])
    assert run(spark, {"absence": True}, searched=seen(("PD", "D", True, 0)))[0] == ME


def test_changes_and_marks(spark):
    mark = lambda kind, number, box: spark.createDataFrame([("rd", 1, kind, number, box)], "file_id string, page int, kind string, number string, bbox array<double>")
    reg = lambda number, basis: spark.createDataFrame([("o", "P", number, basis)], "object_id string, param_code string, number string, basis_file_id string")
    near, far = [0.22, 0.1, 0.3, 0.2], [0.5, 0.5, 0.6, 0.6]
    assert run(spark, marks=mark("cloud", "No. 3", near), changes=reg("3", "order"))[:3] == (NV, ["VER-08"], "APPROVED_CHANGE")
    assert run(spark, marks=mark("cloud", "4", near), changes=reg("3", "order"))[:3] == (CL, ["VER-08"], "CHANGE_CONFLICT")
    unverified = (CA, [], "CHANGE_APPROVAL_UNVERIFIED", ["CHANGE_APPROVAL_UNVERIFIED"])
    assert run(spark, marks=mark("cloud", "3", near), changes=reg("3", "rd")) == unverified  # founded on itself
    assert run(spark, marks=mark("cloud", "3", far), changes=reg("3", "order")) == unverified
    assert run(spark, marks=mark("stamp_row", "3", None)) == unverified


def test_findings_of_several_facts(spark):
    more = [{"side": "actual", "value": "6", "stage": "ID", "file_id": "id"}]
    assert run(spark, extra=more)[3] == ["COMPOSITE"]


def test_refinements(spark):
    cases = [("B25", "B25 W6 F150", True), ("B25", "В25, W6", True), ("C1", "C1, C2", False), ("B2", "B25", False), ("200...250", "230", True), ("200…250", "260", False), ("не менее 150", "150", True),
             ("не более 150", "151", False), ("10", "12", False), ("B25", "B25", False), (None, "x", False), ("200 x 300", "200 x 300 (S1)", True), ("M150", "M150 (M200)", False), ("brick", "brick M150", True),
             ("20-30", "25,5 mm", True), ("20-30", "31", False), ("не ниже 4", "3,9", False), ("НЕ ВЫШЕ 4", "4", True), ("7", "7 mm", False), ("EI 60", "EI 60 / W", True), ("EI 60", "REI 60 W", False)]
    df = spark.createDataFrame([(i, e, a) for i, (e, a, _) in enumerate(cases)], "i int, e string, a string")
    got = {r.i: r.r for r in df.select("i", is_refinement(F.col("e"), F.col("a")).alias("r")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for *_, w in cases]


def test_cascades_of_any_length_and_cycles(spark):
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(12)]
    edges = spark.createDataFrame([*chain, ("x", "y"), ("y", "z"), ("z", "x"), ("gap0", "gap1"), ("gap1", "gap2")], "cause string, effect string")
    codes = [f"c{i:02d}" for i in range(13)] + ["x", "y", "z", "gap0", "gap2"]
    rows = [("o", c, CA) for c in codes] + [("o", "gap1", NV), ("p", "c05", CA), ("p", "c07", CA)]
    got = {(r.object_id, r.param_code): r.root for r in cascade_roots(spark.createDataFrame(rows, "object_id string, param_code string, status string"), edges).collect()}
    assert got == {("o", f"c{i:02d}"): "c00" for i in range(1, 13)} | {("o", "y"): "x", ("o", "z"): "x"}


def test_a_requirement_is_taken_once(spark):
    from factloom.plans import catalog

    plan = catalog.plans()["kind_lowering"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<=\\d)[XХ×](?=\\d)") == 2
