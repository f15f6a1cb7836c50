"""Percentiles of large groups are not held in one buffer."""

from ledgerline.plans.sql import QUERIES


def test_no_buffer_of_all_values(spark, tmp_path):
    spark.range(100).selectExpr("IF(id % 2 = 0, 'A', NULL) AS l_returnflag", "CAST(id AS double) AS l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = QUERIES["sql_percentile"](spark, str(tmp_path))
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.l_returnflag or "", r.median, r.p90) for r in out.collect()) == [("", 50.0, 89.2), ("A", 49.0, 88.2)]
