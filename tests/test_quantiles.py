"""Distributed exact quantiles against numpy on a skewed fixture (one group holds a third)."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from marginmart.operators.quantiles import quantiles, value_bin


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    groups = ["hot"] * 3000 + [f"g{i % 7}" for i in range(6000)]
    vals = rng.normal(size=len(groups)).round(3)  # rounding creates ties
    pdf_rows = list(zip(groups, vals.tolist()))
    pdf_rows += [("hot", None), ("solo", 5.0)]
    df = spark.createDataFrame(pdf_rows, "g string, v double").repartition(5)
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r.g: r for r in quantiles(df, ["g"], "v", probs, digits=None).collect()}
    for g in set(groups) | {"solo"}:
        xs = np.array([v for gg, v in pdf_rows if gg == g and v is not None])
        for name, p in probs.items():
            assert getattr(got[g], name) == pytest.approx(float(np.quantile(xs, p)), abs=1e-12)


def test_global_quantile_and_empty_group(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "v double")
    r = quantiles(df, [], "v", {"m": 0.5, "q": 0.25}).first()
    assert (r.m, r.q) == (2.0, 1.5)


def test_hot_value_and_hot_group(spark):
    """A third of all rows share one group AND one value: still exact."""
    rows = [("hot", 0.0)] * 4000 + [("hot", float(i)) for i in range(2000)] + [(f"g{i % 5}", float(i % 97)) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r for r in quantiles(df, ["g"], "v", {"p25": 0.25, "p50": 0.5, "p99": 0.99}, digits=None).collect()}
    for g in {r[0] for r in rows}:
        xs = np.array([v for gg, v in rows if gg == g])
        for name, p in (("p25", 0.25), ("p50", 0.5), ("p99", 0.99)):
            assert getattr(got[g], name) == pytest.approx(float(np.quantile(xs, p)), abs=1e-9)


@pytest.mark.parametrize("refine_rows", [0, 3, 50])
def test_large_bins_are_cut_further(spark, refine_rows):
    """Bins over the limit are cut into steps of their own range until they are small; results do not change."""
    rng = np.random.default_rng(5)
    rows = [("a" if i % 3 else "b", float(x)) for i, x in enumerate([*rng.normal(1000, 1e-3, 2000), *(-rng.lognormal(0, 9, 1500)), *[0.0] * 40])]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    probs = {f"p{k}": k / 100 for k in (0, 1, 37, 50, 81, 99, 100)}
    got = {r.g: r for r in quantiles(df, ["g"], "v", probs, digits=None, refine_rows=refine_rows).collect()}
    for g in ("a", "b"):
        xs = np.array([v for gg, v in rows if gg == g])
        for name, p in probs.items():
            assert getattr(got[g], name) == pytest.approx(float(np.quantile(xs, p)), rel=1e-12, abs=1e-300)


def test_extreme_values(spark):
    tiny, inf = 5e-324, float("inf")
    values = [-inf, -1.7e308, -1.0, -tiny, -0.0, 0.0, tiny, 2.2e-308, 1.0, 1.0000000000000002, 1.7e308, inf, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    keep = sorted(v for v in values if v is not None and v == v)
    probs = {f"p{k}": k / (len(keep) - 1) for k in range(len(keep))}
    row = quantiles(df, [], "v", probs, digits=None).first()
    assert [row[f"p{k}"] for k in range(len(keep))] == keep


def test_bins_keep_the_order(spark):
    rng = np.random.default_rng(1)
    values = sorted([*rng.normal(0, 1, 500), *rng.lognormal(0, 50, 500), *(-rng.lognormal(0, 50, 500)), 0.0])
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    bins = [r.b for r in rows.select("i", value_bin(F.col("v")).alias("b")).orderBy("i").collect()]
    assert bins == sorted(bins)


def test_sums_travel_with_the_quantiles(spark):
    rows = [("a", 1.0, 10), ("a", None, 5), ("b", None, 7), (None, 3.0, 2), (None, 4.0, 1), ("a", 2.0, 1)]
    df = spark.createDataFrame(rows, "g string, v double, w int")
    got = {r.g: (r.m, r.w, r.n) for r in quantiles(df, ["g"], "v", {"m": 0.5}, sums={"w": F.col("w"), "n": F.lit(1)}).collect()}
    assert got == {"a": (1.5, 16, 3), "b": (None, 7, 1), None: (3.5, 3, 2)}
    empty = df.where("w > 100")
    assert quantiles(empty, ["g"], "v", {"m": 0.5}, sums={"n": F.lit(1)}).collect() == []
    assert quantiles(empty, [], "v", {"m": 0.5}).first().m is None


def test_the_fact_is_scanned_twice_and_its_column_never_ranged(spark, tmp_path):
    """The plan of the final job: one scan of the rows, no range partitioning of the column."""
    path = str(tmp_path / "fact")
    spark.range(5000).selectExpr("id % 5 as g", "cast(id * 37 % 1009 as double) as v").write.parquet(path)
    out = quantiles(spark.read.parquet(path), ["g"], "v", {"m": 0.5})
    plan = out._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("FileScan parquet") == 1 and "rangepartitioning" not in physical


def test_quantile_bounded_histograms_equal_numpy(spark):
    """A10 and A11 from fine bins, against values counted one by one; ties on the edges, a hot value, negatives."""
    from marginmart.operators.distributions import clipped_histograms, order_size_histogram

    rng = np.random.default_rng(9)
    n = 4000
    sale = np.round(np.concatenate([rng.lognormal(4, 1.2, n - 1500), np.full(1000, 50.0), np.zeros(500)]), 2)
    cost = np.round(rng.lognormal(4, 1, n), 2)
    years = ["This Year" if k % 3 else "Last Year" for k in range(n)]
    df = spark.createDataFrame([(y, float(a), float(b), float(a - b)) for y, a, b in zip(years, sale, cost)],
                               "YearLabel string, SaleTotal double, TicketCost double, Profit double").repartition(4)

    def bars(x, lo, hi, nbins):
        w = (hi - lo) / nbins
        at = np.minimum(np.floor((x - lo) / w), nbins - 1).astype(int)
        return {int(b): (lo + b * w, lo + (b + 1) * w, int((at == b).sum())) for b in np.unique(at)}

    p99 = np.quantile(sale, 0.99)
    less = sale < p99
    got = {(r.YearLabel, r.bin): (r.bin_lo, r.bin_hi, r["count"]) for r in order_size_histogram(df).collect()}
    want = {(y, b): x for y in set(years) for b, x in bars(sale[less & (np.array(years) == y)], sale[less].min(), sale[less].max(), 50).items()}
    assert got == want
    got = {(r.column_name, r.bin): (r.bin_lo, r.bin_hi, r["count"]) for r in clipped_histograms(df).collect()}
    want = {}
    for name, x in (("SaleTotal", sale), ("TicketCost", cost), ("Profit", sale - cost)):
        p1, p99 = (round(float(np.quantile(x, p)), 6) for p in (0.01, 0.99))
        c = np.minimum(np.maximum(x, p1 if name == "Profit" else 0.0), p99)
        want |= {(name, b): v for b, v in bars(c, c.min(), c.max(), 60).items()}
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_approx_method_is_an_argument(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1001)], "v double")
    assert abs(quantiles(df, [], "v", {"m": 0.5}, method="approx").first().m - 500.0) <= 2.0
