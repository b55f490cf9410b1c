"""Metric framework: money sums, sum-then-divide ratios, YoY deltas.

Money stays ``decimal`` through every sum (exact and order independent, so a
re-executed task or a different partitioning gives the same bits), and becomes
``double`` only at the end.  Ratios are always ratios of sums, never means of row
ratios.  All aggregates here are algebraic, so Spark runs them as partial
(map-side) + final hash aggregates: a hot key is pre-combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .enrich import LAST_YEAR, MONEY_TYPE, THIS_YEAR

# FIXED VALUES — which metrics are ratios of sums.
METRIC_IS_RATIO = {"SaleTotal": False, "Profit": False, "Margin": True, "Ratio": True, "Orders": False}

def zero() -> Column:
    return F.lit(0).cast(MONEY_TYPE)


def dsum(c: str | Column, cond: Column | None = None) -> Column:
    """Exact decimal sum (optionally conditional), 0 for no rows."""
    col = F.col(c) if isinstance(c, str) else c
    if cond is not None:
        col = F.when(cond, col)
    return F.coalesce(F.sum(col), zero())


def to_double(c: Column) -> Column:
    return c.cast("double")


def guarded_pct(num: Column, den: Column) -> Column:
    """Num / den * 100 when den > 0, else 0 (as double)."""
    return F.when(den > 0, num.cast("double") / den.cast("double") * 100).otherwise(F.lit(0.0))


def metric_from(metric: str, rev: Column, prof: Column, cost: Column, orders: Column | None = None) -> Column:
    """A1 on already-summed components."""
    if metric == "SaleTotal":
        return rev.cast("double")
    if metric == "Profit":
        return prof.cast("double")
    if metric == "Margin":
        return guarded_pct(prof, rev)
    if metric == "Ratio":
        return guarded_pct(prof, cost)
    if metric == "Orders":
        if orders is None:
            raise ValueError("Orders needs a count column")
        return orders.cast("double")
    raise ValueError(f"Unknown metric: {metric}")


def component_aggs(cond: Column | None = None, suffix: str = "") -> list[Column]:
    """Sum components (rev, prof, cost, orders) as aggregate expressions."""
    return [
        dsum("SaleTotal", cond).alias(f"rev{suffix}"),
        dsum("Profit", cond).alias(f"prof{suffix}"),
        dsum("TicketCost", cond).alias(f"cost{suffix}"),
        (F.count_if(cond) if cond is not None else F.count(F.lit(1))).alias(f"orders{suffix}"),
    ]


def metric_agg(metric: str, cond: Column | None = None) -> Column:
    """A1 as one aggregate expression: any metric for a (conditional) group."""
    rev, prof, cost = dsum("SaleTotal", cond), dsum("Profit", cond), dsum("TicketCost", cond)
    orders = F.count_if(cond) if cond is not None else F.count(F.lit(1))
    return metric_from(metric, rev, prof, cost, orders)


def is_this_year() -> Column:
    return F.col("YearLabel") == THIS_YEAR


def is_last_year() -> Column:
    return F.col("YearLabel") == LAST_YEAR


def yoy_pct(this: Column, last: Column) -> Column:
    """(t - l) / |l| * 100; null when the base is null or 0."""
    return F.when(last.isNotNull() & (last != 0),
                  (this.cast("double") - last.cast("double")) / F.abs(last.cast("double")) * 100)


def revenue_yoy_pct(this: Column, last: Column) -> Column:
    """X2 (revenue): base must be > 0; divides by the base."""
    return F.when(last > 0, (this.cast("double") - last.cast("double")) / last.cast("double") * 100)


def profit_yoy_pct(this: Column, last: Column) -> Column:
    """X2 (profit): base must be non-zero; divides by its absolute value."""
    return F.when(last != 0, (this.cast("double") - last.cast("double")) / F.abs(last.cast("double")) * 100)
