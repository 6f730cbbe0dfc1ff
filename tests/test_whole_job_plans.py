"""Rows that an earlier round left out of the expression queries."""

from inkframe.plans import catalog
from pyspark.sql import functions as F


def test_all_ten_forms_are_validated_and_single_lines_keep_their_value(spark, tmp_path):
    keys = [3, 47, 88, 120, 121, 160, 204]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").withColumn("o_custkey", F.lit(1)).write.parquet(f"{tmp_path}/orders.parquet")
    status = {r.o_orderkey: r.status for r in catalog.QUERIES["expr_validate_all"](spark, str(tmp_path)).collect()}
    assert sorted(status) == keys and status[88] == "OK"
    got = {r.image_id: (r.n_lines, r.value, r.summary) for r in catalog.QUERIES["line_summary_values"](spark, str(tmp_path)).collect()}
    assert got[2] == (1, 89.0, None) and got[0] == (1, 1.333333, None) and got[1] == (1, 53.0, None)
    assert got[3][:2] == (2, None) and got[3][2].endswith("/2 lines evaluated successfully") and got[5] == (1, None, None)
