import duckdb

from factloom.plans import catalog
from factloom.sources import tables


def test_first_fragment_where_part_keys_are_longer_than_a_million(spark, tmp_path):
    lines = [(1, 1, 1_500_000, "A"), (1, 2, 400_000, "R"), (2, 1, 7, "N"), (2, 2, 3, "R"), (3, 3, 5_000_000, "A"), (3, 6, 1_999_999, "N")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "O"), (2, "F"), (3, "O")], "o_orderkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: r.first_flag for r in catalog.plans()["first_fragment"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    for t in ("lineitem", "orders"):
        db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = {r[0]: r[3] for r in db.execute(catalog.oracles()["first_fragment"]).fetchall()}
    assert got == want == {1: "R", 2: "N", 3: "N"}


def test_document_counts_are_dealt_by_rows_and_not_by_a_setting(spark, monkeypatch):
    want = sorted(catalog.plans()["document_counts"](spark, "/root/testdata/sf0.001").collect())
    monkeypatch.setattr(tables, "ROWS", 500)
    found = catalog.plans()["document_counts"](spark, "/root/testdata/sf0.001")
    assert "RepartitionByExpression [l_orderkey" in found._jdf.queryExecution().optimizedPlan().toString()
    assert tables.dealt(spark.range(6_001), "id").rdd.getNumPartitions() == 13
    assert sorted(found.collect()) == want
