"""The store of monthly components: replacing months, tables from the store, sketches within their bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginmart.operators import compare as C
from marginmart.operators.components import HLL_LG_K, KLL_K, Store


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), ["CompanyName", "Sport", "State"])


def rows(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=str)


def test_a_replaced_month_equals_a_full_rebuild(spark, store, enriched_small, tmp_path):
    wrong = enriched_small.withColumn("SaleTotal", F.when(F.col("SellMonth") == "1996-02", F.col("SaleTotal") * 3).otherwise(F.col("SaleTotal")).cast("decimal(21,4)"))
    store.replace(wrong)
    assert rows(store.yoy_table("Sport")) != rows(C.yoy_table(enriched_small, "Sport"))
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    store.replace(enriched_small, ["1996-02"])
    now = {f: f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    changed = {f.parent.name for f in files.keys() ^ now.keys()}
    assert changed == {"month=1996-02"} and all(now[f] == files[f] for f in files.keys() & now.keys())
    for dimension in ("CompanyName", "Sport", "State"):
        assert rows(store.yoy_table(dimension)) == rows(C.yoy_table(enriched_small, dimension))
        assert rows(store.yoy_compare(dimension, "Ratio")) == rows(C.yoy_compare(enriched_small, dimension, "Ratio"))
    assert rows(store.kpi_deltas()) == rows(C.kpi_deltas(enriched_small))
    monthly = C.monthly_trend(enriched_small)
    assert store.monthly().count() == monthly.count()


def test_a_month_without_orders_goes_and_orders_without_a_month_stay(spark, store, enriched_small):
    store.replace(enriched_small)
    store.replace(enriched_small.where("SellMonth <> '1995-01' or SellMonth is null"), ["1995-01"])
    left = enriched_small.where("SellMonth <> '1995-01' or SellMonth is null")
    assert left.count() < enriched_small.count() and left.where("SellMonth is null").count() > 0
    assert rows(store.kpi_deltas()) == rows(C.kpi_deltas(left)) and rows(store.yoy_table("Sport")) == rows(C.yoy_table(left, "Sport"))
    with pytest.raises(ValueError):
        store.read("VenueName")


def test_merged_sketches_stay_within_their_bounds(spark, tmp_path):
    rng = np.random.default_rng(4)
    n = 30_000
    margins = np.concatenate([rng.lognormal(3, 2, n - 9000), np.full(6000, 12.5), -rng.lognormal(2, 1, 3000)])
    data = [("hot" if k % 3 else f"s{k % 7}", f"2024-{k % 12 + 1:02d}", float(m), k // 2) for k, m in enumerate(margins)]
    df = spark.createDataFrame(data, "Sport string, SellMonth string, ProfitMargin double, InvoiceID long")
    df = df.selectExpr("*", "'This Year' as YearLabel", "cast(1 as decimal(21,4)) as SaleTotal", "cast(1 as decimal(21,4)) as Profit", "cast(0 as decimal(21,4)) as TicketCost", "1 as TicketsSold")
    store = Store(spark, str(tmp_path / "s"), ["Sport"])
    store.replace(df)
    store.replace(df, ["2024-05"])
    probs, bound = [0.01, 0.1, 0.5, 0.9, 0.99], 2.3 / KLL_K ** 0.9
    for months, keep in ((None, lambda m: True), (("2024-03", "2024-07"), lambda m: "2024-03" <= m <= "2024-07")):
        for r in store.margin_quantiles("Sport", probs, months).collect():
            xs = np.array([m for s, month, m, _ in data if s == r.value and keep(month)])
            assert r.n == len(xs)
            for p in probs:
                q = r[f"p{round(100 * p):02d}"]
                assert (xs < q).mean() - bound <= p <= (xs <= q).mean() + bound
        for r in store.distinct_invoices("Sport", months).collect():
            exact = len({i for s, month, _, i in data if s == r.value and keep(month)})
            assert abs(r.invoices - exact) <= 4 * 1.04 / 2 ** (HLL_LG_K / 2) * exact
