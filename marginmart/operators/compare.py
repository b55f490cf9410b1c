"""This-year vs last-year comparisons.

The source scans the rows once per group and year; here every comparison is one
hash aggregate with conditional sums (``sum(CASE WHEN year = ..)``), so one shuffle
of partial aggregates keyed by the group, whatever the number of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.enrich import LAST_YEAR, THIS_YEAR
from .joins import join_on
from .quantiles import _pin, quantiles

TY, LY = M.is_this_year, M.is_last_year


def _yoy_columns(include_ratio: bool = True) -> list[Column]:
    cols = [
        F.col("rev_ty").cast("double").alias("revenue_ty"),
        F.col("rev_ly").cast("double").alias("revenue_ly"),
        M.revenue_yoy_pct(F.col("rev_ty"), F.col("rev_ly")).alias("revenue_yoy_pct"),
        F.col("prof_ty").cast("double").alias("profit_ty"),
        F.col("prof_ly").cast("double").alias("profit_ly"),
        M.profit_yoy_pct(F.col("prof_ty"), F.col("prof_ly")).alias("profit_yoy_pct"),
        M.guarded_pct(F.col("prof_ty"), F.col("rev_ty")).alias("margin_ty"),
        M.guarded_pct(F.col("prof_ly"), F.col("rev_ly")).alias("margin_ly"),
    ]
    if include_ratio:
        cols += [M.guarded_pct(F.col("prof_ty"), F.col("cost_ty")).alias("ratio_ty"),
                 M.guarded_pct(F.col("prof_ly"), F.col("cost_ly")).alias("ratio_ly")]
    cols += [F.col("orders_ty"), F.col("orders_ly")]
    return cols


def yoy_table(df: DataFrame, group_col: str, top_n: int | None = None,
              sort_by: str = "revenue_ty", include_ratio: bool = True) -> DataFrame:
    """A24 (A25 with ``include_ratio=False``): per group, both years and YoY deltas.

    Groups are the non-null values of ``group_col`` in ``df``; a group without rows in a
    year shows zeros for it.  Sorted by ``sort_by`` descending (group name breaks ties);
    ``top_n`` keeps the first rows of that order (T8).
    """
    # F6 (null groups dropped); J6: both years aligned per group in one aggregate.
    g = (df.where(F.col(group_col).isNotNull())
           .groupBy(group_col)
           .agg(*M.component_aggs(TY(), "_ty"), *M.component_aggs(LY(), "_ly")))
    out = g.select(F.col(group_col), *_yoy_columns(include_ratio))
    out = out.orderBy(F.col(sort_by).desc(), F.col(group_col))  # T1
    return out.limit(top_n) if top_n else out


def yoy_tables(df: DataFrame, dimensions: dict[str, str], top_n: int | None = None) -> DataFrame:
    """The YoY tables of many dimensions ({name: column}) from one scan: dimension, group_value, the table's columns.

    Grouping sets give every dimension's sums in one aggregation, pinned.  ``top_n`` keeps the
    first rows of each table: an ordered limit per dimension over the pinned sums (the first rows of
    each partition, merged), not a window that takes a whole dimension into one task."""
    cols = list(dimensions.values())
    sets = [[F.col(c)] for c in cols]
    g = df.groupingSets(sets, *cols).agg(F.grouping_id(*cols).alias("_gid"), *M.component_aggs(TY(), "_ty"), *M.component_aggs(LY(), "_ly"))
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (label, c) in enumerate(dimensions.items()):
        own = F.col("_gid").bitwiseAND(F.lit(1 << (len(cols) - 1 - i))) == 0
        name, value = F.when(own, F.lit(label)).otherwise(name), F.when(own, F.col(c).cast("string")).otherwise(value)
    out = g.select(name.alias("dimension"), value.alias("group_value"), *_yoy_columns()).where(F.col("group_value").isNotNull())
    if not top_n:
        return out
    out = _pin(out)
    first = [out.where(F.col("dimension") == label).orderBy(F.col("revenue_ty").desc(), "group_value").limit(top_n) for label in dimensions]
    both = first[0]
    for part in first[1:]:
        both = both.unionByName(part)
    return both


def state_yoy(df: DataFrame) -> DataFrame:
    """The YoY table by State, without the cost-ratio columns."""
    return yoy_table(df, "State", include_ratio=False)


def leaderboard(df: DataFrame) -> DataFrame:
    """A26 (legacy affiliate leaderboard): guards test for a non-zero base."""
    g = (df.where(F.col("CompanyName").isNotNull()).groupBy("CompanyName")
           .agg(*M.component_aggs(TY(), "_ty"), *M.component_aggs(LY(), "_ly")))
    rev_ty, rev_ly = F.col("rev_ty").cast("double"), F.col("rev_ly").cast("double")
    prof_ty, prof_ly = F.col("prof_ty").cast("double"), F.col("prof_ly").cast("double")
    return g.select(
        F.col("CompanyName").alias("affiliate"),
        rev_ty.alias("revenue_this"), rev_ly.alias("revenue_last"),
        F.when(F.col("rev_ly") != 0, (rev_ty - rev_ly) / rev_ly * 100).alias("revenue_yoy_pct"),
        prof_ty.alias("profit_this"), prof_ly.alias("profit_last"),
        F.when(F.col("rev_ty") != 0, prof_ty / rev_ty * 100).otherwise(0.0).alias("margin_this"),
        F.when(F.col("rev_ly") != 0, prof_ly / rev_ly * 100).otherwise(0.0).alias("margin_last"),
        F.col("orders_ty").alias("orders_this"), F.col("orders_ly").alias("orders_last"),
    ).orderBy(F.col("revenue_this").desc(), F.col("affiliate"))


# --- KPI blocks ---------------------------------------------------------------------

KPI_NAMES = ("revenue", "profit", "margin", "tickets", "orders", "avg_order", "loss_orders", "loss_share")


def _kpi_aggs(cond: Column | None, suffix: str) -> list[Column]:
    def when(c: Column) -> Column:
        return F.when(cond, c) if cond is not None else c
    return [
        M.dsum("SaleTotal", cond).alias(f"rev{suffix}"),
        M.dsum("Profit", cond).alias(f"prof{suffix}"),
        F.coalesce(F.sum(when(F.col("TicketsSold").cast("bigint"))), F.lit(0).cast("bigint")).alias(f"tickets{suffix}"),
        (F.count_if(cond) if cond is not None else F.count(F.lit(1))).alias(f"orders{suffix}"),
        F.count_if((F.col("Profit") < 0) & cond if cond is not None else F.col("Profit") < 0).alias(f"loss{suffix}"),
    ]


def _kpi_values(suffix: str) -> dict[str, Column]:
    rev, prof = F.col(f"rev{suffix}"), F.col(f"prof{suffix}")
    orders, loss = F.col(f"orders{suffix}"), F.col(f"loss{suffix}")
    return {
        "revenue": rev.cast("double"),
        "profit": prof.cast("double"),
        "margin": M.guarded_pct(prof, rev),
        "tickets": F.col(f"tickets{suffix}"),
        "orders": orders,
        "avg_order": F.when(orders > 0, rev.cast("double") / orders).otherwise(0.0),
        "loss_orders": loss,
        "loss_share": F.when(orders > 0, loss / orders * 100).otherwise(0.0),
    }


def kpi_block(df: DataFrame) -> DataFrame:
    """A2 for both years: one row per year label, zeros for a year without rows.
    One aggregation; the two rows come from ``inline`` over it (no union, one scan)."""
    agg = df.agg(*_kpi_aggs(TY(), "_ty"), *_kpi_aggs(LY(), "_ly"))
    rows = []
    for label, suffix in ((THIS_YEAR, "_ty"), (LAST_YEAR, "_ly")):
        vals = _kpi_values(suffix)
        rows.append(F.struct(F.lit(label).alias("year_label"), *[vals[k].alias(k) for k in KPI_NAMES]))
    return agg.select(F.inline(F.array(*rows)))


def kpi_deltas(df: DataFrame) -> DataFrame:
    """A3: this vs last for revenue, profit, orders, tickets (YoY %) and margin (points)."""
    return kpi_deltas_of(df.agg(*_kpi_aggs(TY(), "_ty"), *_kpi_aggs(LY(), "_ly")))


def kpi_deltas_of(agg: DataFrame) -> DataFrame:
    """A3 of one row of both years' components."""
    t, l = _kpi_values("_ty"), _kpi_values("_ly")
    cols = []
    for k in ("revenue", "profit", "orders", "tickets"):
        cols += [t[k].alias(f"{k}_ty"), l[k].alias(f"{k}_ly"), M.yoy_pct(t[k], l[k]).alias(f"{k}_yoy_pct")]
    cols += [t["margin"].alias("margin_ty"), l["margin"].alias("margin_ly"),
             (t["margin"] - l["margin"]).alias("margin_delta_pts")]
    return agg.select(*cols)


def headline(df: DataFrame) -> DataFrame:
    """LY, TY and YoY % for five KPIs; the margin row's change is in points.
    One aggregation, five rows via ``inline``."""
    agg = df.agg(*_kpi_aggs(TY(), "_ty"), *_kpi_aggs(LY(), "_ly"))
    t, l = _kpi_values("_ty"), _kpi_values("_ly")
    rows = []
    for pos, (name, key) in enumerate((("Revenue", "revenue"), ("Profit", "profit"), ("Margin %", "margin"),
                                       ("Orders", "orders"), ("Tickets Sold", "tickets"))):
        ty, ly = t[key].cast("double"), l[key].cast("double")
        change = (ty - ly) if key == "margin" else M.yoy_pct(ty, ly)
        rows.append(F.struct(F.lit(pos).alias("position"), F.lit(name).alias("metric"),
                             ly.alias("last_year"), ty.alias("this_year"), change.alias("yoy_pct")))
    return agg.select(F.inline(F.array(*rows)))


# --- trends -----------------------------------------------------------------------------

def monthly_trend(df: DataFrame) -> DataFrame:
    """Per calendar month of the sale, every metric, chronological."""
    month = F.date_trunc("month", F.col("SellDate_dt")).cast("timestamp_ntz")
    g = (df.where(F.col("SellDate_dt").isNotNull())
           .groupBy(month.alias("month_start"))
           .agg(*M.component_aggs()))
    return g.select(
        F.date_format("month_start", "yyyy-MM").alias("year_month"),
        F.date_format("month_start", "MMM yy").alias("label"),
        F.col("rev").cast("double").alias("revenue"),
        F.col("prof").cast("double").alias("profit"),
        F.col("cost").cast("double").alias("cost"),
        F.col("orders"),
        M.guarded_pct(F.col("prof"), F.col("rev")).alias("margin"),
        M.guarded_pct(F.col("prof"), F.col("cost")).alias("ratio"),
    ).orderBy("year_month")


def monthly_kpi(df: DataFrame) -> DataFrame:
    """Monthly table with revenue YoY against the same month a year earlier.

    The prior month is found with a range frame over a month index (12 preceding to 12
    preceding), which is exact over gaps in the months, unlike ``lag(12)``.  The window
    has no partition key, so it runs on the aggregated months only (one row per month).
    """
    month = F.date_trunc("month", F.col("SellDate_dt")).cast("timestamp_ntz")
    g = (df.where(F.col("SellDate_dt").isNotNull())
           .groupBy(month.alias("month_start"))
           .agg(*M.component_aggs()))
    idx = F.year("month_start") * 12 + F.month("month_start")
    w = Window.orderBy("month_idx").rangeBetween(-12, -12)  # J5 / W4
    g = g.withColumn("month_idx", idx).withColumn("prior_rev", F.max("rev").over(w))
    return g.select(
        F.date_format("month_start", "yyyy-MM").alias("year_month"),
        F.date_format("month_start", "MMM yy").alias("month"),
        F.col("rev").cast("double").alias("revenue"),
        F.col("prof").cast("double").alias("profit"),
        M.guarded_pct(F.col("prof"), F.col("rev")).alias("margin"),
        M.guarded_pct(F.col("prof"), F.col("cost")).alias("ratio"),
        F.col("orders"),
        M.revenue_yoy_pct(F.col("rev"), F.col("prior_rev")).alias("revenue_yoy_pct"),
    ).orderBy("year_month")


def yoy_compare(df: DataFrame, group_col: str, metric: str = "SaleTotal", top_n: int | None = None) -> DataFrame:
    """A5 (+T2): metric per (group, year), dense over both years; optional top-N groups
    by the sum over years of the absolute value (ties by group name)."""
    g = (df.where(F.col(group_col).isNotNull()).groupBy(group_col)
           .agg(M.metric_agg(metric, TY()).alias("v_ty"), M.metric_agg(metric, LY()).alias("v_ly")))
    if top_n:
        g = (g.withColumn("_abs", F.abs("v_ty") + F.abs("v_ly"))
               .orderBy(F.col("_abs").desc(), F.col(group_col)).limit(top_n).drop("_abs"))
    # U4: long form (one row per group and year) by unpivoting the two year columns.
    return g.select(F.col(group_col).alias("group_value"),
                    F.expr(f"stack(2, '{LAST_YEAR}', v_ly, '{THIS_YEAR}', v_ty) as (year_label, value)"))


def affiliate_yoy(df: DataFrame, affiliate: str | None = None) -> DataFrame:
    """Five metrics by year, long form, for one affiliate or every affiliate."""
    if affiliate is not None:
        df = df.where(F.col("CompanyName") == affiliate)
    g = (df.where(F.col("CompanyName").isNotNull()).groupBy("CompanyName")
           .agg(*M.component_aggs(TY(), "_ty"), *M.component_aggs(LY(), "_ly")))
    vals = []
    for label, s in ((THIS_YEAR, "_ty"), (LAST_YEAR, "_ly")):
        rev, prof, cost, orders = (F.col(f"{c}{s}") for c in ("rev", "prof", "cost", "orders"))
        vals += [("Revenue", label, rev.cast("double")), ("Profit", label, prof.cast("double")),
                 ("Margin %", label, M.guarded_pct(prof, rev)),
                 ("P/Cost Ratio %", label, M.guarded_pct(prof, cost)),
                 ("Orders", label, orders.cast("double"))]
    structs = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(y).alias("year_label"), v.alias("value"))
                        for m, y, v in vals])
    return (g.select(F.col("CompanyName").alias("affiliate"), F.inline(structs)))


def _affiliate_components(df: DataFrame) -> DataFrame:
    """This-year components per affiliate (the null-name group included, for portfolio
    totals), pinned: one fact scan, then every total and comparison reads this table."""
    return _pin(df.where(TY()).groupBy("CompanyName").agg(*M.component_aggs()))


def _portfolio(comp: DataFrame) -> Column:
    """Portfolio totals from the per-affiliate table as ONE struct scalar subquery."""
    return comp.agg(F.struct(F.sum("rev").alias("rev"), F.sum("prof").alias("prof"),
                             F.sum("cost").alias("cost"), F.sum("orders").alias("n"),
                             F.count("CompanyName").alias("n_aff")).alias("p")).select("p").scalar()


def affiliate_vs_portfolio(df: DataFrame, affiliate: str | None = None) -> DataFrame:
    """A21 (+A59 count distinct): an affiliate's this-year revenue, profit, average order and
    margin against the portfolio, whose revenue and profit are divided by the number of
    distinct affiliates.  Portfolio values are a scalar subquery over the per-affiliate table."""
    comp = _affiliate_components(df)
    g = comp.where(F.col("CompanyName").isNotNull()).withColumn("_p", _portfolio(comp))
    p = F.col("_p")
    p_rev, p_prof, p_n = p["rev"], p["prof"], p["n"]
    n_aff = F.greatest(p["n_aff"], F.lit(1))
    if affiliate is not None:
        g = g.where(F.col("CompanyName") == affiliate)
    rows = [
        ("Revenue", F.col("rev").cast("double"), p_rev.cast("double") / n_aff),
        ("Profit", F.col("prof").cast("double"), p_prof.cast("double") / n_aff),
        ("Avg Order", F.when(F.col("orders") > 0, F.col("rev").cast("double") / F.col("orders")).otherwise(0.0),
         F.when(p_n > 0, p_rev.cast("double") / p_n)),
        ("Margin %", M.guarded_pct(F.col("prof"), F.col("rev")), M.guarded_pct(p_prof, p_rev)),
    ]
    structs = F.array(*[F.struct(F.lit(m).alias("metric"), a.alias("affiliate_value"), v.alias("portfolio_value"))
                        for m, a, v in rows])
    return g.select(F.col("CompanyName").alias("affiliate"), F.inline(structs))


def affiliate_vs_portfolio_per_order(df: DataFrame, affiliate: str | None = None) -> DataFrame:
    """Per-order averages, margin and cost ratio of an affiliate vs all this-year orders."""
    comp = _affiliate_components(df)
    g = comp.where(F.col("CompanyName").isNotNull()).withColumn("_p", _portfolio(comp))
    p = F.col("_p")
    p_rev, p_prof, p_cost, p_n = p["rev"], p["prof"], p["cost"], p["n"]
    if affiliate is not None:
        g = g.where(F.col("CompanyName") == affiliate)
    rows = [
        ("Avg Revenue", F.col("rev").cast("double") / F.col("orders"), F.when(p_n > 0, p_rev.cast("double") / p_n)),
        ("Avg Profit", F.col("prof").cast("double") / F.col("orders"), F.when(p_n > 0, p_prof.cast("double") / p_n)),
        ("Margin %", M.guarded_pct(F.col("prof"), F.col("rev")), M.guarded_pct(p_prof, p_rev)),
        ("P/Cost Ratio %", M.guarded_pct(F.col("prof"), F.col("cost")), M.guarded_pct(p_prof, p_cost)),
    ]
    structs = F.array(*[F.struct(F.lit(m).alias("metric"), a.alias("affiliate_value"), v.alias("portfolio_value"))
                        for m, a, v in rows])
    return g.select(F.col("CompanyName").alias("affiliate"), F.inline(structs))


H2H_METRICS = ("Revenue", "Profit", "Margin %", "Orders", "Avg Order $", "Loss-order %")


def _h2h_values(rev: Column, prof: Column, n: Column, loss: Column) -> list[Column]:
    return [rev.cast("double"), prof.cast("double"), M.guarded_pct(prof, rev), n.cast("double"),
            F.when(n > 0, rev.cast("double") / n).otherwise(0.0),
            F.when(n > 0, loss / n * 100).otherwise(0.0)]


def head_to_head(df: DataFrame, name_a: str | Column | None = None, name_b: str | Column | None = None) -> DataFrame:
    """Six this-year KPIs for affiliates A and B and A minus B, one row per metric.

    Without names, A and B are the two affiliates with the highest this-year revenue
    (ties by name), chosen inside the plan (no driver round trip).
    """
    if (name_a is None) != (name_b is None):
        raise ValueError("name both affiliates or none")
    ty = df.where(TY() & F.col("CompanyName").isNotNull())
    per = _pin(ty.groupBy("CompanyName")
                 .agg(M.dsum("SaleTotal").alias("rev"), M.dsum("Profit").alias("prof"),
                      F.count(F.lit(1)).alias("n"), F.count_if(F.col("Profit") < 0).alias("loss")))
    if name_a is None:
        ranked = per.orderBy(F.col("rev").desc(), F.col("CompanyName")).limit(2)
        a = ranked.orderBy(F.col("rev").desc(), F.col("CompanyName")).limit(1)
        b = join_on(ranked, a.select("CompanyName"), ["CompanyName"], "left_anti")
    else:
        a = per.where(F.col("CompanyName") == name_a)
        b = per.where(F.col("CompanyName") == name_b)
    # One struct scalar subquery per side, evaluated once into a column.
    cols = ("rev", "prof", "n", "loss")
    base = (df.sparkSession.range(1)
              .withColumn("_a", a.select(F.struct("CompanyName", *cols).alias("s")).select("s").scalar())
              .withColumn("_b", b.select(F.struct("CompanyName", *cols).alias("s")).select("s").scalar()))
    va = _h2h_values(*(F.col("_a")[c] for c in cols))
    vb = _h2h_values(*(F.col("_b")[c] for c in cols))
    if name_a is None:
        a_name, b_name = F.col("_a")["CompanyName"], F.col("_b")["CompanyName"]
    else:
        a_name, b_name = F.lit(name_a), F.lit(name_b)
    parts = []
    for i, m in enumerate(H2H_METRICS):
        x, y = F.coalesce(va[i], F.lit(0.0)), F.coalesce(vb[i], F.lit(0.0))
        parts.append(F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"),
                              x.alias("value_a"), y.alias("value_b"), (x - y).alias("delta")))
    return base.select(a_name.alias("affiliate_a"), b_name.alias("affiliate_b"), F.inline(F.array(*parts)))


# --- order size and mix ---------------------------------------------------------------------

def order_size_shift(df: DataFrame) -> DataFrame:
    """Mean, median and p90 order revenue per year and the % change."""
    yr = df.where(F.col("YearLabel").isin(THIS_YEAR, LAST_YEAR))
    stats = quantiles(yr, ["YearLabel"], "SaleTotal", {"median": 0.5, "p90": 0.9},
                      sums={"rev": F.coalesce(F.col("SaleTotal"), M.zero()), "n": F.lit(1)})
    stats = stats.withColumn("mean", F.col("rev").cast("double") / F.col("n"))
    wide = stats.agg(*[F.max(F.when(F.col("YearLabel") == lab, F.col(s))).alias(f"{s}{suf}")
                       for s in ("mean", "median", "p90") for lab, suf in ((THIS_YEAR, "_ty"), (LAST_YEAR, "_ly"))])
    rows = []
    for pos, s in enumerate(("mean", "median", "p90")):
        ty, ly = F.col(f"{s}_ty"), F.col(f"{s}_ly")
        rows.append(F.struct(F.lit(pos).alias("position"), F.lit(s).alias("stat"), ly.alias("last_year"),
                             ty.alias("this_year"),
                             F.when(ly != 0, (ty / ly - 1) * 100).alias("change_pct")))
    return wide.select(F.inline(F.array(*rows)))


def mix_shift(df: DataFrame) -> DataFrame:
    """Per sport, revenue both years, YoY %, each year's share and the share change in
    points.  One aggregation; the year totals are a window over its rows (one per sport
    plus the null-sport group, a fixed vocabulary), so the fact is scanned once."""
    g = (df.groupBy("Sport")
           .agg(M.dsum("SaleTotal", TY()).alias("ty"), M.dsum("SaleTotal", LY()).alias("ly"),
                F.count_if(TY() | LY()).alias("n")))
    everything = Window.partitionBy()
    g = g.withColumn("t_ty", F.sum("ty").over(everything)).withColumn("t_ly", F.sum("ly").over(everything))
    g = g.where(F.col("Sport").isNotNull() & (F.col("n") > 0))
    t_ty, t_ly = F.col("t_ty"), F.col("t_ly")
    ty, ly = F.col("ty").cast("double"), F.col("ly").cast("double")
    ly_share = F.when(t_ly != 0, ly / t_ly.cast("double") * 100)
    ty_share = F.when(t_ty != 0, ty / t_ty.cast("double") * 100)
    return g.select(F.col("Sport").alias("sport"), ly.alias("last_year"), ty.alias("this_year"),
                    F.when(F.col("ly") != 0, (ty - ly) / ly * 100).alias("yoy_pct"),
                    ly_share.alias("ly_share_pct"), ty_share.alias("ty_share_pct"),
                    (ty_share - ly_share).alias("share_delta_pts"))


# --- generic helpers --------------------------------------------------------------------------

def group_agg(df: DataFrame, key: str, spec: dict[str, tuple[str, str]]) -> DataFrame:
    """A51 / A52 (U5 grouping): ``{output: (sum | mean | count, source column)}`` per
    non-null, non-empty key (F12).

    Decimal sums stay exact; means are of the finite values (nulls skipped by Spark)."""
    k = F.col(key)
    d = df.where(k.isNotNull() & (k.cast("string") != ""))
    aggs = []
    for out, (fn, src) in spec.items():
        c = F.col(src)
        if fn == "sum":
            aggs.append(F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(out))
        elif fn == "mean":
            aggs.append(F.avg(c).alias(out))
        elif fn == "count":
            aggs.append(F.count(c).alias(out))
        else:
            raise ValueError(f"unknown aggregate {fn!r}")
    return d.groupBy(k.alias(key)).agg(*aggs)


def count_where(df: DataFrame, cond) -> DataFrame:
    """Number of rows meeting a predicate."""
    return df.agg(F.count_if(cond).alias("n"))
