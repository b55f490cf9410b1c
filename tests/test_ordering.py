"""Distributed rank / running sum equals the single-task window."""

from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from marginmart.operators.ordering import global_order


def test_global_order_matches_window(spark):
    rows = [(f"k{i:04d}", Decimal(str((i * 7919) % 101)) / 4) for i in range(2500)]
    df = spark.createDataFrame(rows, "name string, v decimal(21,4)")
    order = [F.col("v").desc(), F.col("name").asc()]
    got = global_order(df, order, "rank", {"run": "v"}, num_partitions=7)
    w = Window.orderBy(*order)
    want = df.select("name", F.row_number().over(w).alias("rank"),
                     F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("run"))
    assert sorted(map(tuple, got.select("name", "rank", "run").collect())) == sorted(map(tuple, want.collect()))
