from factloom import kinds
from factloom.kinds.direction import conflicts

MENTIONS = "object_id string, param_code string, stage string, mark string, building string, value string, confidence double, file_id string, page int, evac boolean, role string, excluded string, exemption string, discipline string"
BASE = dict(mark="D1", building=None, value="outward", confidence=0.9, file_id="f", page=1, evac=None, role="CURRENT", excluded=None, exemption=None, discipline="AR")
COLUMNS = [c.split()[0] for c in MENTIONS.split(", ")]
PD, RD, ID = "PD", "RD", "ID"

CASES = {
    "turned": ([(PD, {}), (RD, dict(value="inward"))], "CANDIDATE"),
    "same": ([(PD, {}), (RD, {})], "NEGATIVE_VERIFIED"),
    "better": ([(PD, dict(value="inward")), (RD, {})], "NEGATIVE_VERIFIED"),
    "excused": ([(PD, dict(exemption="x")), (RD, dict(value="sliding"))], "NOT_COMPARABLE"),
    "general excuse": ([(PD, {}), (PD, dict(mark=None, excluded="EXEMPT")), (RD, dict(value="inward"))], "CANDIDATE"),
    "said of all": ([(PD, dict(mark=None)), (RD, dict(value="inward", evac=True))], "CANDIDATE"),
    "not known": ([(PD, dict(mark=None)), (RD, dict(value="inward"))], "NOT_COMPARABLE"),
    "known elsewhere": ([(PD, dict(mark=None)), (RD, dict(value="inward")), (ID, dict(evac=True))], "CANDIDATE"),
    "other building": ([(PD, dict(building="A")), (RD, dict(building="B", value="inward"))], "NOT_COMPARABLE"),
    "narrow": ([(PD, {}), (RD, dict(value="blocks", evac=True))], "NOT_COMPARABLE"),
    "hinges": ([(PD, {}), (RD, dict(value="hand"))], "NOT_COMPARABLE"),
    "lost": ([(PD, {}), (RD, {}), (RD, dict(mark="D2", evac=True, excluded="AMBIGUOUS"))], "NOT_COMPARABLE"),
    "outside": ([(PD, {}), (RD, dict(excluded="SMALL_ROOM", value="inward"))], "NEGATIVE_VERIFIED"),
    "disputed": ([(PD, dict(role="CONFLICT")), (RD, {})], "CLARIFICATION_REQUIRED"),
    "past": ([(PD, {}), (RD, dict(role="SUPERSEDED", value="inward"))], "MISSING_EVIDENCE"),
    "no source": ([(PD, {}), (RD, dict(discipline="XX", value="inward"))], "MISSING_EVIDENCE"),
    "worst of equals": ([(PD, {}), (RD, {}), (RD, dict(value="inward"))], "CANDIDATE"),
    "norm": ([(RD, dict(value="inward", evac=True))], "CANDIDATE"),
}


def tables(spark):
    rows = []
    for name, (mentions, _) in CASES.items():
        for stage, more in mentions:
            values = dict(object_id=name, param_code="N" if name == "norm" else "P", stage=stage) | BASE | more
            rows.append(tuple(values[c] for c in COLUMNS))
    params = [(code, "direction", {s: ["AR"] for s in (PD, RD, ID)}, code == "N") for code in "PN"]
    return spark.createDataFrame(rows, MENTIONS), spark.createDataFrame(params, "param_code string, kind string, sources map<string,array<string>>, norm boolean")


def test_statuses(spark):
    found = {r.object_id: r.status for r in kinds.evaluate("direction", *tables(spark)).collect()}
    assert found == {name: want for name, (_, want) in CASES.items()}


def test_stages_that_contradict_themselves(spark):
    found = {(r.object_id, r.stage): (r.named_differently, r.inward) for r in conflicts(*tables(spark)).collect()}
    assert found == {("worst of equals", RD): (1, 0)}
