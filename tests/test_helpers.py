"""Smaller helpers: CSV sink, table re-sort, pivot at the edge, label positions, rounding."""

import pytest
from pyspark.sql import functions as F

from marginmart.functions import labels as L
from marginmart.operators import compare as C
from marginmart.operators import grids as G
from marginmart.operators import profile as P
from marginmart.operators import ranking as R


def test_export_csv_roundtrip(spark, enriched_small, tmp_path):
    path = str(tmp_path / "export")
    P.export_csv(enriched_small, path)
    back = spark.read.option("header", True).csv(path)
    assert back.count() == P.export_rollup(enriched_small).count()
    assert set(back.columns) == {"CompanyName", "PrimaryPerformerName", "YEAR", "MONTH", "Profit",
                                 "TicketsSold", "SaleTotal", "ProfitMargin"}


def test_sort_table_nulls_last(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert [r[0] for r in R.sort_table(df, "x").collect()] == [3.0, 1.0, None]
    assert [r[0] for r in R.sort_table(df, "x", descending=False).collect()] == [1.0, 3.0, None]


def test_pivot_wide_zero_fill(spark):
    cells = spark.createDataFrame([("a", "NBA", 1.0), ("b", "NFL", 2.0)], "row_label string, col_label string, value double")
    wide = {r.row_label: r for r in G.pivot_wide(cells, ["NBA", "NFL", "NHL"]).collect()}
    assert (wide["a"].NBA, wide["a"].NFL, wide["a"].NHL) == (1.0, 0.0, 0.0)
    assert wide["b"].NFL == 2.0


def test_gradient_positions(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (20.0,)], "v double")
    got = [r[0] for r in df.select(L.gradient_position("v", F.lit(0.0), F.lit(10.0))).collect()]
    assert got == [0.0, 0.5, 1.0]
    inv = [r[0] for r in df.select(L.gradient_position("v", F.lit(0.0), F.lit(10.0), low_is_good=True)).collect()]
    assert inv == [1.0, 0.5, 0.0]
    div = [r[0] for r in df.select(L.diverging_position("v", F.lit(10.0))).collect()]
    assert div == [0.5, 0.75, 1.0]


def test_round_table_and_month_key(spark):
    df = spark.createDataFrame([(1.23456, 12.345, "2024-10-03")], "m double, p double, d string")
    r = L.round_table(df, money=["m"], pct=["p"]).first()
    assert (r.m, r.p) == (1.23, 12.3)
    assert df.select(L.month_key_text("d")).first()[0] == "2024-10"


def test_count_where_and_group_agg(spark, enriched_small):
    n = C.count_where(enriched_small, F.col("Profit") < 0).first().n
    assert n == enriched_small.where(F.col("Profit") < 0).count()
    g = C.group_agg(enriched_small, "Sport", {"rev": ("sum", "SaleTotal"), "q": ("mean", "Quantity"),
                                              "n": ("count", "InvoiceID")})
    assert g.agg(F.sum("n")).first()[0] == enriched_small.where(F.col("Sport").isNotNull()).count()
    with pytest.raises(ValueError):
        C.group_agg(enriched_small, "Sport", {"x": ("median", "SaleTotal")})


def test_money_and_pct_labels(spark):
    df = spark.createDataFrame([(1234.4, 12.34), (-1234.6, -0.05), (None, None)], "v double, p double")
    rows = df.select(L.money("v").alias("m"), L.pct("p").alias("p"), L.pct("p", signed=True).alias("s"),
                     L.integer("v").alias("i")).collect()
    assert [tuple(r) for r in rows] == [("$1,234", "12.3%", "+12.3%", "1,234"),
                                        ("-$1,235", "-0.1%", "-0.1%", "-1,235"),
                                        ("—", "—", "—", "—")]


def test_materialize_roundtrip_and_pruning(spark, enriched_small):
    import io
    from contextlib import redirect_stdout

    from marginmart.sources.sinks import materialize

    fact = materialize(enriched_small)
    assert fact.columns == enriched_small.columns
    assert fact.count() == enriched_small.count()
    assert fact.where(F.col("YearLabel").isNull()).count() == enriched_small.where(F.col("YearLabel").isNull()).count()
    buf = io.StringIO()
    with redirect_stdout(buf):
        fact.where(F.col("YearLabel") == "This Year").select("CompanyName", "SaleTotal").explain("formatted")
    plan = buf.getvalue()
    assert "PartitionFilters: [isnotnull(YearLabel" in plan
    assert "ReadSchema: struct<SaleTotal:decimal(21,4),CompanyName:string>" in plan


def test_ratio_metric_grid(spark, enriched_small):
    ty = enriched_small.where(F.col("YearLabel") == "This Year")
    g = G.heatmap_grid(ty, "CompanyName", "Sport", "Margin").collect()
    assert g and all(-1e9 < r.value < 1e9 for r in g)
    orders = sorted({(r.row_order, r.row_label) for r in g})
    assert [o for o, _ in orders] == list(range(len(orders)))


def test_dense_histogram(spark):
    from marginmart.operators import distributions as D
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", 5.0)], "g string, v double")
    sparse = D.histogram(df, "v", 5, by=["g"]).collect()
    dense = D.histogram(df, "v", 5, by=["g"], dense=True).collect()
    assert sum(r["count"] for r in sparse) == 3 and len(sparse) == 3
    assert len(dense) == 10 and sum(r["count"] for r in dense) == 3
    assert {(r.g, r.bin) for r in dense} == {(g, b) for g in "ab" for b in range(5)}


def test_either_of_two_filters_skips_row_groups(spark, enriched_small, tmp_path):
    """Row groups that a filter leaves, in a fact sorted by affiliate alone and in an interleaved one."""
    from urllib.parse import unquote, urlparse

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from marginmart.sources.sinks import materialize, materialize_interleaved

    names = [f"A{k:03d}" for k in range(60)]
    sports = ["MLB", "NBA", "NFL", "NHL", "Other"]
    pick = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), c)
    df = spark.range(40_000).select(
        F.col("id").alias("InvoiceID"), F.when(F.col("id") % 40 != 0, pick(names, (F.xxhash64("id") % 60 + 60).cast("int") % 60 + 1)).alias("CompanyName"),
        pick(sports, F.when(F.col("id") % 3 == 0, 1).otherwise((F.col("id") % 5 + 1).cast("int"))).alias("Sport"), F.lit("This Year").alias("YearLabel"))
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plain = materialize(df.repartitionByRange(32, "CompanyName", "InvoiceID"))
        both = materialize_interleaved(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert sorted(map(tuple, both.collect()), key=str) == sorted(map(tuple, df.select(*both.columns).collect()), key=str)

    def read(frame, column, value):
        hit = total = 0
        for f in frame.inputFiles():
            meta = pq.ParquetFile(unquote(urlparse(f).path)).metadata
            for g in range(meta.num_row_groups):
                columns = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i).statistics for i in range(meta.num_columns)}
                s = columns[column]
                total += 1
                hit += s is not None and s.has_min_max and s.min <= value <= s.max
        return hit / total

    shares = {(kind, c): read(f, c, v) for kind, f in (("plain", plain), ("both", both)) for c, v in (("CompanyName", "A017"), ("Sport", "NFL"))}
    assert shares["plain", "Sport"] > 0.9, "sorted by affiliate alone, a sport is in every row group"
    assert shares["both", "Sport"] < 0.5 and shares["both", "CompanyName"] < 0.5
    print("row groups read:", shares)
