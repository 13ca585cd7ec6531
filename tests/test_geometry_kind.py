import numpy as np
from pyspark.sql import functions as F

from factloom import kinds
from factloom.kinds.geometry import PARAMS, elements, matched
from factloom.operators import crosschecks, geometry

MENTIONS = ("object_id string, param_code string, stage string, role string, confidence double, file_id string, page int, key string, at array<double>, polygon array<array<double>>, "
            "value double, label_value double, measured_value double, by string, frame string, residual_mm double, scale_n double, scale_spread_pct double")  # fmt: skip
BASE = dict(role="CURRENT", confidence=0.9, file_id="f", page=1, key="D-1", at=None, polygon=None, value=None, label_value=None, measured_value=None, by=None, frame="bld", residual_mm=1.0, scale_n=100.0, scale_spread_pct=1.0)
COLUMNS = [c.split()[0] for c in MENTIONS.split(", ")]


def mention(o, param, stage, **more):
    return tuple((dict(object_id=o, param_code=param, stage=stage) | BASE | more)[c] for c in COLUMNS)


def square(x, y, side=1000.0):
    x, y = float(x), float(y)
    return [[x, y], [x + side, y], [x + side, y + side], [x, y + side]]


def test_statuses_of_what_is_measured(spark):
    settings = {"LEN": ("length", "min", "decrease", 5.0, None, 900.0), "EACH": ("length", "each", "any", 5.0, None, None), "AREA": ("area", "sum", "decrease", 0.1, None, None), "N": ("count", "sum", "any", 0.0, None, None),
                "POS": ("position", "each", "any", 50.0, None, None), "SHAPE": ("shape", "each", "any", 0.2, None, None)}
    params = [(code, "geometry", m, how, d, tol, pct, 5.0, 2.0, 300.0, 10.0, 0.9, 100.0, low, None) for code, (m, how, d, tol, pct, low) in settings.items()]
    cases = {
        ("len", "LEN"): ([("PD", dict(label_value=1000.0)), ("RD", dict(label_value=994.0))], ("CANDIDATE", 1, 0, 994.0)),
        ("norm", "LEN"): ([("RD", dict(label_value=890.0))], ("CANDIDATE", 0, 0, 890.0)),
        ("one", "LEN"): ([("RD", dict(label_value=950.0))], ("NEGATIVE_VERIFIED", 0, 0, None)),
        ("pd", "LEN"): ([("PD", dict(label_value=950.0))], ("MISSING_EVIDENCE", 0, 0, None)),
        ("scale", "LEN"): ([("PD", dict(measured_value=1000.0, scale_spread_pct=9.0)), ("RD", dict(measured_value=10.0, scale_n=None))], ("NOT_COMPARABLE", 0, 0, None)),
        ("label", "LEN"): ([("PD", dict(label_value=1000.0, measured_value=700.0)), ("RD", dict(label_value=999.0))], ("NEGATIVE_VERIFIED", 1, 1, None)),
        ("conflict", "LEN"): ([("PD", dict(label_value=1000.0, role="CONFLICT"))], ("CLARIFICATION_REQUIRED", 0, 0, None)),
        ("past", "LEN"): ([("PD", dict(label_value=1000.0, role="SUPERSEDED"))], ("MISSING_EVIDENCE", 0, 0, None)),
        ("each", "EACH"): ([("PD", dict(label_value=900.0, key="D 1")), ("PD", dict(label_value=700.0, key="D2")), ("RD", dict(label_value=705.0, key="Д3")), ("RD", dict(label_value=800.0, key="d 1"))], ("CANDIDATE", 1, 0, 800.0)),
        ("drawn", "AREA"): ([("PD", dict(polygon=square(0, 0, 2000.0))), ("RD", dict(polygon=square(0, 0, 20.0), frame="sheet"))], ("NEGATIVE_VERIFIED", 1, 0, None)),
        ("flat", "AREA"): ([("PD", dict(polygon=[[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]])), ("RD", dict(polygon=square(0, 0)))], ("MISSING_EVIDENCE", 0, 0, None)),
        ("signs", "N"): ([("PD", dict(at=[0.0, 0.0])), ("PD", dict(value=2.0)), ("RD", dict(value=2.0))], ("CANDIDATE", 1, 0, 2.0)),
        ("moved", "POS"): ([("PD", dict(at=[0.0, 0.0])), ("RD", dict(at=[60.0, 0.0]))], ("CANDIDATE", 1, 0, 60.0)),
        ("still", "POS"): ([("PD", dict(at=[0.0, 0.0])), ("RD", dict(at=[30.0, 40.0]))], ("NEGATIVE_VERIFIED", 1, 0, None)),
        ("gone", "POS"): ([("PD", dict(at=[0.0, 0.0])), ("RD", dict(at=[0.0, 0.0], key="E"))], ("CANDIDATE", 0, 0, None)),
        ("loose", "POS"): ([("PD", dict(at=[0.0, 0.0])), ("RD", dict(at=[20.0, 0.0], key=None))], ("NEGATIVE_VERIFIED", 1, 0, None)),
        ("sheet", "POS"): ([("PD", dict(at=[0.0, 0.0], frame="s")), ("RD", dict(at=[0.0, 0.0]))], ("NOT_COMPARABLE", 0, 0, None)),
        ("off", "POS"): ([("PD", dict(at=[0.0, 0.0], residual_mm=11.0)), ("RD", dict(at=[0.0, 0.0]))], ("NOT_COMPARABLE", 0, 0, None)),
        ("same", "SHAPE"): ([("PD", dict(polygon=square(0, 0))), ("RD", dict(polygon=square(10, 0)))], ("NEGATIVE_VERIFIED", 1, 0, None)),
        ("notch", "SHAPE"): ([("PD", dict(polygon=square(0, 0))), ("RD", dict(polygon=[[0.0, 0.0], [490.0, 0.0], [500.0, 300.0], [510.0, 0.0], [1000.0, 0.0], [1000.0, 1000.0], [0.0, 1000.0]]))], ("CANDIDATE", 1, 0, 0.997)),
        ("recount", "SHAPE"): ([("PD", dict(polygon=square(0, 0), label_value=1.0)), ("RD", dict(polygon=square(0, 0), label_value=1.3))], ("CANDIDATE", 1, 0, 1.0)),
    }
    rows = [mention(o, param, stage, **more) for (o, param), (stages, _) in cases.items() for stage, more in stages]
    found = kinds.evaluate("geometry", spark.createDataFrame(rows, MENTIONS), spark.createDataFrame(params, PARAMS)).collect()
    got = {(r.object_id, r.param_code): (r.status, r.pairs, r.off_scale, r.worst if r.worst is None else round(r.worst, 3)) for r in found}
    assert got == {k: want for k, (_, want) in cases.items()}


def test_elements_find_each_other_by_mark_and_then_by_place(spark):
    at = lambda stage, key, x: mention("o", "P", stage, key=key, at=[float(x), 0.0])
    rows = [at("PD", "A", 0), at("PD", "a ", 1000), at("PD", None, 5000), at("PD", "B", 9000), at("PD", "C", 20000), at("RD", "A.", 990), at("RD", "A", 40), at("RD", "Z", 5100), at("RD", None, 9200), at("RD", "Y", 20000)]
    params = [("P", "geometry", "position", "each", "any", 1.0, None, 5.0, 2.0, 300.0, 10.0, 0.9, 100.0, None, None)]
    placed = elements(spark.createDataFrame(rows, MENTIONS), spark.createDataFrame(params, PARAMS))
    x = {(r.stage, r.no): r.at[0] for r in placed.collect()}
    pairs, alone = matched(placed)
    assert sorted((x["PD", r.was_no], x["RD", r.no]) for r in pairs.collect()) == [(0.0, 40.0), (1000.0, 990.0), (5000.0, 5100.0), (9000.0, 9200.0)]
    assert [x["PD", r.was_no] for r in alone.collect()] == [20000.0]


def test_contours_are_held_along_their_edges(spark):
    flat, bent = np.array(square(0, 0)), np.array([[0.0, 0.0], [500.0, 0.0], [1000.0, 0.0], [1000.0, 1000.0], [500.0, 700.0], [0.0, 1000.0]])
    assert abs(geometry._hausdorff(flat, bent) - 300) < 6 and geometry._hausdorff(flat, np.array([[0.0, 0.0], [500.0, 0.0], *square(0, 0)[1:]])) < 1e-9
    df = spark.createDataFrame([(square(0, 0), square(0, 0, 400.0)), (None, square(0, 0))], "a array<array<double>>, b array<array<double>>")
    assert [r.h if r.h is None else round(r.h) for r in df.select(geometry.hausdorff(F.col("a"), F.col("b")).alias("h")).collect()] == [849, None]


def test_walls_are_laid_on_routes_in_the_building(spark):
    turned, plain = [0.0, 1.0, -1.0, 0.0, 100.0, 0.0], [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    frames = "floor string, frame array<double>, residual_mm double"
    walls = spark.createDataFrame([("RD", [[0.0, 50.0], [40.0, 50.0]], "1", turned, 1.0), ("RD", [[50.0, 0.0], [50.0, 40.0]], None, plain, 1.0)], f"stage string, points array<array<double>>, {frames}")
    routes = spark.createDataFrame([("RD", "s1", "V1", [[0.0, 10.0], [60.0, 10.0], [60.0, 20.0], [0.0, 20.0]], "1", plain, 1.0), ("RD", "s2", "V2", [[0.0, 10.0], [60.0, 10.0]], "1", plain, 9.0), ("RD", "s3", "V3", [[0.0, 30.0], [60.0, 30.0]], "2", plain, 1.0)],
                                   f"stage string, sheet string, route string, points array<array<double>>, {frames}")
    devices = spark.createDataFrame([("RD", "s1", [52.0, 10.0], plain), ("RD", "s2", [50.0, 20.0], plain)], "stage string, sheet string, at array<double>, frame array<double>")
    got = [tuple(r) for r in crosschecks.unguarded_walls(walls, routes, devices, ["stage"], 3.0, 2.0, 25.0).collect()]
    assert got == [("RD", "s1", "V1", 50.0, 20.0)]
