import re

import pytest

from factloom.functions import classes
from factloom.kinds import direction, layers, types
from factloom.plans import catalog
from factloom.plans.layers import _inputs

SF = "/root/testdata/sf0.001"
KINDS = ("generic", "count", "quantity", "class", "class_vectors", "composition", "category", "presence", "method", "geometry")
#: A join by a param alone, or by a name of a catalogue: few values, so few tasks.
FEW = re.compile(r"SortMergeJoin \[(?:(?:param_code|value_text|term|was|name|now|m)#\d+,? ?)+\]")


@pytest.fixture
def planned(spark):
    """Plans as they are without sizes of tables."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("kind", KINDS)
def test_mentions_are_not_dealt_out_by_param_or_name(spark, planned, kind):
    assert not FEW.findall(planned(catalog.plans()[f"kind_{kind}"](spark, SF)))


def test_a_notation_is_read_once(spark, monkeypatch):
    plan = catalog.plans()["kind_class_vectors"]
    want = sorted(plan(spark, SF).collect())
    read = []
    monkeypatch.setattr(types, "vector", lambda dims, text: read.append(str(text)) or classes.vector(dims, text))
    found = plan(spark, SF)
    assert len(read) == 1 and "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    monkeypatch.setattr(types, "MOST_NOTATIONS", 0)
    assert sorted(plan(spark, SF).collect()) == want


def test_stacks_and_doors_are_not_dealt_out_by_param(spark, planned):
    mentions, params, _ = _inputs(spark, SF)
    assert not FEW.findall(planned(layers.usable(mentions, params)))
    doors = spark.createDataFrame([], "object_id long, param_code string, stage string, value string, role string, confidence double, file_id string, page int, mark string, building string, evac boolean, excluded string, exemption string, discipline string")
    rules = spark.createDataFrame([], "param_code string, kind string, sources map<string,array<string>>, norm boolean")
    assert not FEW.findall(planned(direction.readings(doors, rules)))
