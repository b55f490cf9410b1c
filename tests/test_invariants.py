"""Invariants on the sf0.001 mart: shares sum to 100, parts sum to wholes, dense grids."""

import pytest
from pyspark.sql import functions as F

from marginmart.operators import compare as C
from marginmart.operators import grids as G
from marginmart.operators import ranking as R
from marginmart.operators import scope as S
from marginmart.operators import shares as SH


def test_shares_sum_to_100(enriched_small):
    ty = S.split_years(enriched_small)[0]
    for df in (SH.share_by(ty, "Sport"), SH.order_share_by(ty, "Sport"), SH.share_by(ty, "MarketplaceTier", "Profit")):
        assert df.agg(F.sum("share_pct")).first()[0] == pytest.approx(100.0)


def test_group_sums_equal_total(enriched_small):
    t = C.yoy_table(enriched_small, "Sport").agg(F.sum("revenue_ty"), F.sum("orders_ty")).first()
    k = C.kpi_block(enriched_small).where(F.col("year_label") == "This Year").first()
    assert t[0] == pytest.approx(k.revenue) and t[1] == k.orders


def test_pareto_ends_at_100(enriched_small):
    p = R.pareto(enriched_small).orderBy(F.col("rank").desc()).first()
    assert p.cum_share_pct == pytest.approx(100.0)


def test_day_hour_grid_dense(enriched_small):
    g = G.day_hour_grid(enriched_small)
    assert g.count() == 168
    assert g.select("day", "hour").distinct().count() == 168


def test_year_rows_add_up(enriched_small):
    c = S.scope_counts(enriched_small).where(F.col("affiliate") == "All Affiliates").first()
    labeled = enriched_small.where(F.col("YearLabel").isNotNull()).count()
    assert c.ty_rows + c.ly_rows == labeled and c.rows == enriched_small.count()


def test_scope_filters(enriched_small):
    name = enriched_small.select("CompanyName").first()[0]
    one = S.scope(enriched_small, name, ["NBA", "NFL"])
    assert one.select("CompanyName").distinct().count() == 1
    assert set(r[0] for r in one.select("Sport").distinct().collect()) <= {"NBA", "NFL"}
    assert S.scope(enriched_small, "All Affiliates", []).count() == enriched_small.count()


def test_head_to_head_named(enriched_small):
    names = [r[0] for r in enriched_small.select("CompanyName").dropna().distinct().orderBy("CompanyName").limit(2).collect()]
    h = C.head_to_head(enriched_small, names[0], names[1]).collect()
    assert len(h) == 6 and h[0].affiliate_a == names[0]
    for r in h:
        assert r.delta == pytest.approx(r.value_a - r.value_b)


def test_worst_affiliate_null_for_single(spark):
    from decimal import Decimal
    df = spark.createDataFrame(
        [("T1", "A", "NBA", Decimal("10"), Decimal("5"), 1, "This Year"),
         ("T2", "A", "NBA", Decimal("10"), Decimal("5"), 1, "This Year"),
         ("T2", "B", "NFL", Decimal("10"), Decimal("15"), 1, "This Year")],
        "HomeTeam string, CompanyName string, Sport string, SaleTotal decimal(21,4), TicketCost decimal(21,4), "
        "TicketsSold int, YearLabel string").withColumn("Profit", F.col("SaleTotal") - F.col("TicketCost"))
    rows = {r.team: r for r in R.team_breakdown(df).collect()}
    assert rows["T1"].worst_affiliate is None and rows["T1"].top_affiliate == "A"
    assert (rows["T2"].top_affiliate, rows["T2"].worst_affiliate) == ("A", "B")
    assert rows["T2"].sport == "NBA"  # tie on count -> smallest


def test_share_null_label(enriched_small):
    with_null = SH.order_share_by(enriched_small, "State", null_label="Unknown")
    labels = {r.category for r in with_null.collect()}
    assert "Unknown" in labels
    assert with_null.agg(F.sum("orders")).first()[0] == enriched_small.count()
    assert "Unknown" not in {r.category for r in SH.order_share_by(enriched_small, "State").collect()}


def test_empty_scope(enriched_small):
    empty = S.scope(enriched_small, "No Such Affiliate")
    k = {r.year_label: r for r in C.kpi_block(empty).collect()}
    assert set(k) == {"This Year", "Last Year"}
    for r in k.values():
        assert (r.revenue, r.profit, r.margin, r.orders, r.avg_order, r.loss_share) == (0.0, 0.0, 0.0, 0, 0.0, 0.0)
    assert C.yoy_table(empty, "Sport").count() == 0
    assert G.day_hour_grid(empty).count() == 168
    d = C.kpi_deltas(empty).first()
    assert d.revenue_yoy_pct is None and d.margin_delta_pts == 0.0
