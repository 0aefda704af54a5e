"""Rounding on the edge of a label."""

from tidemark.plans import base, load_all

load_all()


def test_rating_label_on_the_edge(spark, tmp_path):
    rows = [(1, 1, 2750.0), (2, 1, 7250.0), (3, 3, 2750.0), (4, 1, 2750.01)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.c_custkey: r.label for r in base.QUERIES["N19_rating_labels"](spark, str(tmp_path)).collect()}
    assert got == {1: "strong_sell", 2: "strong_buy", 3: "unknown", 4: "sell"}
