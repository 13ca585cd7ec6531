from pyspark.sql import functions as F

from factloom.functions import checks


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.x for r in sorted(df.select("i", make(F.col("v")).alias("x")).collect())]


def test_event_times_are_utc(spark):
    cases = {"2024-02-29": "2024-02-29T00:00:00.000Z", "2024-03-01T01:30+03:00": "2024-02-29T22:30:00.000Z", "2024-03-01 01:30:05.1239": "2024-03-01T01:30:05.123Z", "2023-02-29": None, "2024-03-01T24:00": None, "0999-01-01": None,
             "1.3.2024": None, "2024-03-01T01:30:00Z": "2024-03-01T01:30:00.000Z", None: None}
    assert column(spark, cases, checks.event_time) == list(cases.values())


def test_numbers_and_ranges_of_cells(spark):
    cases = {"1 200,5 м": (1200.5, 1200.5, "м"), "12": (12.0, 12.0, None), "30...20 mm": (20.0, 30.0, "mm"), "от 5 до 7": (5.0, 7.0, None), "5 floors": None, "12 (see 3)": None, "—": None}
    got = column(spark, cases, checks.range_of)
    assert [g and (g.low, g.high, g.unit) for g in got[1:]] == list(cases.values())[1:] and got[0] is None  # metres in Cyrillic aren't a known unit


def test_fields_by_kind(spark):
    rows = [("code", "AB - 1.2", "АВ-1.2", True), ("code", "AB-1", "AB1", False), ("stage", "PD", "п", True), ("sheet", "лист 07", "7", True), ("room", "1.18а", "1.18 A", True), ("revision", "B", "b", False), ("text", None, None, False), ("x", " a  b", "a b", True)]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, k string, a string, b string")
    assert [r.x for r in sorted(df.select("i", checks.same_field(F.col("k"), F.col("a"), F.col("b")).alias("x")).collect())] == [r[3] for r in rows]


def test_sources_objects_and_cards(spark):
    assert column(spark, ["A", None, " ", "—", " - "], checks.stage_required) == [True, False, False, False, False]
    assert column(spark, [["*"], ["B"], [], None], lambda v: checks.is_named_source(v, F.lit("A")), "array<string>") == [True, False, False, False]
    assert column(spark, ["estimate", "plan", None], lambda v: checks.is_document_source(v, F.array(F.lit("plan")))) == [False, True, True]
    assert column(spark, [" Синтетика 1", "House", None], lambda v: checks.is_real(v, F.lit(None).cast("boolean"))) == [False, True, True]
    assert column(spark, ["CONFIRMED_VIOLATION", "OPEN"], lambda v: checks.gold_label(v, F.lit(1), F.lit("e"))) == ["POSITIVE", None]
    assert column(spark, ["CONFIRMED_VIOLATION"], lambda v: checks.gold_label(v, F.lit(0), F.lit("e"))) == [None]
