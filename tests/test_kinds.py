"""Every step of every ladder, over mentions and params of the tests' own."""

import pytest

from factloom import kinds

CA, CL, ME, NC, NA, NV = "CANDIDATE", "CLARIFICATION_REQUIRED", "MISSING_EVIDENCE", "NOT_COMPARABLE", "NOT_APPLICABLE", "NEGATIVE_VERIFIED"
MENTION = (
    "object_id string, param_code string, stage string, value_num double, value_text string, role string, confidence double, file_id string, page int, "
    "variant string, element string, aspect string, state string, hint boolean"
)
PARAM = (
    "param_code string, kind string, applicability string, rule string, tolerance double, low double, high double, scale array<string>, direction string, "
    "tolerance_abs double, tolerance_pct double, factors array<double>, cert_match boolean, separate array<string>, pd_silent string"
)


def frame(spark, rows, schema):
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def evaluate(spark, kind, param, cases, **tables):
    """Statuses of cases, each a list of mentions (stage, number or text, more): one object a case."""
    rows = []
    for name, case in cases.items():
        for i, (stage, value, *more) in enumerate(case):
            row = {"object_id": name, "param_code": "P", "stage": stage, "role": "CURRENT", "confidence": 1.0 - i / 100, "file_id": "f", "page": i}
            row |= {"value_num": float(value)} if isinstance(value, (int, float)) else {"value_text": value}
            rows.append(row | (more[0] if more else {}))
    params = frame(spark, [{"param_code": "P", "kind": kind} | param, {"param_code": "Q", "kind": "other"}], PARAM)
    asked = spark.createDataFrame([(n, "P") for n in cases], "object_id string, param_code string")
    return {r.object_id: r for r in kinds.evaluate(kind, frame(spark, rows, MENTION), params, asked=asked, **tables).collect()}


def statuses(*args, **tables):
    return {k: r.status for k, r in evaluate(*args, **tables).items()}


DISPUTED = {"role": "CONFLICT"}


@pytest.mark.parametrize(
    "rule, bad, good",
    [
        ({"rule": "delta_pct", "tolerance": 10.0}, (100, 111), (100, 110)),
        ({"rule": "equal"}, (5, 6), (5, 5)),
        ({"rule": "equal"}, ("x", "y"), ("x", "x")),
        ({"rule": "decrease"}, (5, 4), (5, 6)),
        ({"rule": "increase"}, (5, 6), (5, 4)),
        ({"rule": "decrease", "scale": ["I", "II", "III"]}, ("II", "I"), ("II", "III")),
    ],
)
def test_generic_rules_between_stages(spark, rule, bad, good):
    cases = {
        "bad": [("PD", bad[0]), ("RD", bad[0]), ("ID", bad[1])],
        "good": [("PD", good[0]), ("ID", good[1])],
        "one": [("PD", good[0])],
        "none": [],
        "disputed": [("PD", bad[0], DISPUTED), ("ID", bad[1])],
        "mixed": [("PD", 5), ("RD", "text")],
    }
    found = evaluate(spark, "generic", rule, cases)
    assert {k: r.status for k, r in found.items()} == {"bad": CA, "good": NV, "one": ME, "none": ME, "disputed": CL, "mixed": NC}
    assert (found["bad"].expected_stage, found["bad"].worst_stage) == ("PD", "ID") and found["good"].worst_stage is None


def test_generic_thresholds_and_profiles(spark):
    cases = {"low": [("PD", 9), ("RD", 8), ("ID", 20)], "fine": [("RD", 10)], "text": [("PD", 1), ("RD", "wide")], "none": [], "house": [("PD", 1)]}
    profiles = spark.createDataFrame([("house", "gas", False), ("low", "gas", True)], "object_id string, flag string, value boolean")
    found = evaluate(spark, "generic", {"rule": "min", "low": 10.0, "applicability": "gas"}, cases, profiles=profiles)
    assert {k: r.status for k, r in found.items()} == {"low": CA, "fine": NV, "text": NC, "none": ME, "house": NA}
    assert found["low"].worst_stage == "RD"
    assert statuses(spark, "generic", {"rule": "max", "high": 5.0}, {"a": [("ID", 6)], "b": [("ID", 5)]}) == {"a": CA, "b": NV}


def test_quantity_ladder(spark):
    norms = spark.createDataFrame([("P", "min", 3.0, "fail"), ("P", "max", 400.0, "warn"), ("P", "max", 5000.0, "fail")], "param_code string, side string, bound double, severity string")
    v = lambda x: {"variant": x}
    e = lambda x: {"element": x}
    cases = {
        "border": [("PD", 100), ("RD", 90)],
        "less": [("PD", 100), ("RD", 95), ("ID", 80)],
        "more": [("PD", 100), ("RD", 190)],
        "scale": [("PD", 100), ("RD", 10)],
        "one": [("PD", 100)],
        "unit lost": [("PD", 100), ("RD", "hundred")],
        "disputed": [("PD", 100, DISPUTED), ("RD", 80)],
        "norm": [("PD", 100), ("RD", 100), ("RD", 2), ("RD", 1)],
        "warned": [("PD", 450), ("RD", 450)],
        "variants": [("PD", 100, v("a")), ("RD", 50, v("b"))],
        "shared variant": [("PD", 100, v("a")), ("PD", 70, v("b")), ("RD", 70, v("b"))],
        "elements": [("PD", 100, e("x")), ("RD", 80, e("x")), ("PD", 50, e("y")), ("RD", 50, e("y"))],
        "spread": [("PD", 100), ("RD", 80, e("x")), ("RD", 90, e("y"))],
    }
    found = evaluate(spark, "quantity", {"direction": "decrease", "tolerance_abs": 5.0, "tolerance_pct": 10.0, "factors": [10.0, 1000.0]}, cases, norms=norms)
    want = {"border": NV, "less": CA, "more": NV, "scale": NC, "one": ME, "unit lost": NC, "disputed": CL, "norm": CA, "warned": NV}
    want |= {"variants": NC, "shared variant": NV, "elements": CA, "spread": NC}
    assert {k: r.status for k, r in found.items()} == want
    assert found["less"].actual == 80 and found["norm"].actual == 1 and found["elements"].parts == 2
    either = statuses(spark, "quantity", {"direction": "any", "tolerance_pct": 10.0, "factors": []}, {"up": [("PD", 100), ("RD", 111)], "down": [("PD", 100), ("RD", 89)], "in": [("PD", 100), ("RD", 110)]})
    assert either == {"up": CA, "down": CA, "in": NV}


def test_count_ladder(spark):
    cases = {
        "same": [("PD", 4), ("RD", 4)],
        "other": [("PD", 4), ("RD", 5)],
        "unsure": [("PD", 4), ("RD", 5), ("RD", 4)],
        "broken": [("PD", 4), ("RD", 4.5)],
        "disputed": [("PD", 4), ("RD", 5, DISPUTED)],
    }
    assert statuses(spark, "count", {}, cases) == {"same": NV, "other": CA, "unsure": CL, "broken": ME, "disputed": CL}


def test_class_ladder(spark):
    e = lambda x: {"element": x}
    scale = {"scale": ["B15", "B20", "B25", "B30"], "cert_match": False}
    cases = {
        "lower": [("PD", "B25"), ("RD", "B20")],
        "higher": [("PD", "B25"), ("RD", "B30")],
        "system": [("PD", "B25"), ("RD", "M350")],
        "one": [("PD", "B25")],
        "disputed": [("PD", "B25", DISPUTED), ("RD", "B20")],
        "apart": [("PD", "B25", e("slab")), ("RD", "B20", e("wall"))],
        "general": [("PD", "B25"), ("RD", "B20", e("wall"))],
        "leftover": [("PD", "B25"), ("RD", "B25"), ("ID", "M350")],
        "built": [("PD", "B20"), ("RD", "B30"), ("ID", "B25")],
    }
    found = evaluate(spark, "class", scale, cases)
    want = {"lower": CA, "higher": NV, "system": NC, "one": ME, "disputed": CL, "apart": NC, "general": CA, "leftover": NC, "built": NV}
    assert {k: r.status for k, r in found.items()} == want and found["lower"].drop == 1
    assert statuses(spark, "class", scale | {"cert_match": True}, {"built": cases["built"]}) == {"built": CA}


def test_composition_ladder(spark):
    row = lambda stage, name, amount: (stage, amount, {"value_text": name})
    cases = {
        "same": [row("PD", "a", 50), row("PD", "b", 50), row("RD", "a", 40), row("RD", "b", 40)],
        "moved": [row("PD", "a", 50), row("PD", "b", 50), row("RD", "a", 70), row("RD", "b", 30)],
        "added": [row("PD", "a", 50), row("ID", "a", 50), row("ID", "c", 1)],
        "apart": [row("PD", "a", 50), row("RD", "a", 50), row("RD", "parking", 1)],
        "one": [row("PD", "a", 1)],
    }
    rows, param = cases, {"tolerance": 10.0, "separate": ["parking"]}
    found = evaluate(spark, "composition", param, rows)
    assert {k: r.status for k, r in found.items()} == {"same": NV, "moved": CA, "added": CA, "apart": NC, "one": ME}
    assert (found["moved"].changed_stage, found["added"].changed_stage) == ("RD", "ID")


def test_category_ladder(spark):
    aliases = spark.createDataFrame([("steel pipe", "pipe A"), ("pipe a", "pipe A")], "name string, canonical string")
    analogs = spark.createDataFrame([("pipe A", "pipe B", "EQUIVALENT"), ("pipe A", "pipe C", "NOT_EQUIVALENT")], "canonical string, substitute string, verdict string")
    cases = {
        "alias": [("PD", "steel pipe"), ("RD", "pipe a")],
        "analog": [("PD", "pipe a"), ("RD", "pipe B")],
        "worse": [("PD", "pipe a"), ("RD", "pipe B"), ("ID", "pipe C")],
        "unknown": [("PD", "pipe a"), ("RD", "pipe D")],
        "no design": [("RD", "pipe a"), ("ID", "pipe a")],
        "no later": [("PD", "pipe a")],
        "disputed": [("PD", "pipe a"), ("RD", "pipe C", DISPUTED)],
    }
    found = statuses(spark, "category", {}, cases, aliases=aliases, analogs=analogs)
    assert found == {"alias": NV, "analog": NV, "worse": CA, "unknown": NC, "no design": ME, "no later": ME, "disputed": CL}


def test_presence_ladder(spark):
    p = lambda stage, state, aspect="x", **more: (stage, more.pop("n", "said"), {"state": state, "aspect": aspect} | more)
    cases = {
        "kept": [p("PD", "PRESENT"), p("RD", "PRESENT"), p("ID", "PRESENT")],
        "dropped": [p("PD", "PRESENT"), p("RD", "ABSENT"), p("ID", "PRESENT")],
        "silent": [p("PD", "PRESENT"), p("RD", "PRESENT")],
        "mixed design": [p("PD", "PRESENT"), p("PD", "ABSENT"), p("RD", "PRESENT")],
        "mixed later": [p("PD", "PRESENT"), p("RD", "PRESENT"), p("RD", "ABSENT")],
        "hint": [p("PD", "PRESENT"), p("RD", None, hint=True), p("ID", None, hint=True)],
        "excluded": [p("PD", "ABSENT"), p("RD", "PRESENT")],
        "no design": [p("RD", "PRESENT")],
        "fewer": [p("PD", "PRESENT", n=4), p("RD", "PRESENT", n=3), p("ID", "PRESENT", n=4)],
        "disputed": [p("PD", "PRESENT", role="UNRESOLVED"), p("RD", "ABSENT")],
        "worst": [p("PD", "PRESENT", "a"), p("RD", "ABSENT", "a"), p("PD", "PRESENT", "b"), p("RD", "PRESENT", "b"), p("ID", "PRESENT", "b")],
    }
    found = evaluate(spark, "presence", {"pd_silent": ME}, cases)
    want = {"kept": NV, "dropped": CA, "silent": ME, "mixed design": NC, "mixed later": NC, "hint": NC, "excluded": NA, "no design": ME, "fewer": CA, "disputed": CL, "worst": CA}
    assert {k: r.status for k, r in found.items()} == want and found["worst"].aspect == "a"


def test_method_ladder(spark):
    lineage = spark.createDataFrame([(t, a) for t, a in [("pile", "pile"), ("bored pile", "bored pile"), ("bored pile", "pile"), ("slab", "slab")]], "term string, ancestor string")
    cases = {
        "same": [("PD", "pile"), ("RD", "pile")],
        "refined": [("PD", "pile"), ("RD", "bored pile")],
        "coarser": [("PD", "bored pile"), ("RD", "pile")],
        "other": [("PD", "pile"), ("RD", "pile"), ("ID", "slab")],
        "unknown": [("PD", "pile"), ("RD", "magic")],
        "unknown design": [("PD", "magic"), ("RD", "pile")],
        "silent": [("PD", "pile")],
        "nowhere": [],
    }
    want = {"same": NV, "refined": NV, "coarser": CA, "other": CA, "unknown": NC, "unknown design": NC, "silent": ME, "nowhere": NA}
    assert statuses(spark, "method", {}, cases, lineage=lineage) == want


def test_registry(spark):
    with pytest.raises(ValueError, match="unknown kind"):
        kinds.evaluate("none", spark.range(1), spark.range(1))
    assert {"generic", "quantity", "count", "class", "composition", "category", "presence", "method"} <= set(kinds.KINDS)
    with pytest.raises(ValueError, match="twice"):
        kinds.kind("generic")(lambda m, p: None)
