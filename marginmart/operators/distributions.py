"""Distributions: histograms, margin boxes and summaries, quantiles, ranges (A8-A12, A19,
A20, A43, A53-A55, scatter frame, T12).

Histograms use equal-width bins computed from scalar-subquery bounds: each row maps to a
bin with arithmetic, then one grouped count (partial aggregation, so skew-free).  All
quantiles go through :mod:`marginmart.operators.quantiles`: order-preserving bins counted in one
scan, and a second scan of the few bins that matter.  Histograms whose range depends on a quantile
share that scan: a fine bin that lies in one histogram bar whatever the exact quantile is
counted as a whole, and only the bins at the bars' edges are read again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import metrics as M
from ..functions.enrich import LAST_YEAR, THIS_YEAR, fine_lead_bucket, fine_lead_order
from .joins import join_on
from .ordering import global_order
from . import quantiles as Q
from .quantiles import _pin, quantiles


def histogram(df: DataFrame, value: str | Column, nbins: int = 50, lo: float | Column | None = None,
              hi: float | Column | None = None, by: Sequence[str] = (), dense: bool = False) -> DataFrame:
    """Equal-width histogram of ``value`` over [lo, hi] (the data's min / max when not
    given), ``nbins`` bins, last bin closed; values outside [lo, hi] and nulls are dropped.

    Returns ``by`` + ``bin`` (0-based), ``bin_lo``, ``bin_hi``, ``count`` for non-empty bins
    (every bin with ``dense=True``).
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    d = df.select(*by, v.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    if lo is None or hi is None:
        # Both bounds from ONE scalar subquery (a struct), reused wherever it appears.
        b = d.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi")).alias("b")).select("b").scalar()
        lo = b["lo"] if lo is None else lo
        hi = b["hi"] if hi is None else hi
    lo_c = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi_c = hi if isinstance(hi, Column) else F.lit(float(hi))
    # Bounds (possibly scalar subqueries) are evaluated once into columns.
    d = d.withColumn("_lo", lo_c).withColumn("_hi", hi_c)
    lo_c, hi_c = F.col("_lo"), F.col("_hi")
    width = (hi_c - lo_c) / nbins
    raw = F.when(width > 0, F.floor((F.col("_x") - lo_c) / width)).otherwise(F.lit(0))
    b = F.least(raw, F.lit(nbins - 1)).cast("int")
    inside = (F.col("_x") >= lo_c) & (F.col("_x") <= hi_c)
    # The bin is projected first: bounds may come from a quantile subquery, which Spark
    # treats as non-deterministic and so keeps out of grouping expressions.
    g = (d.where(inside).withColumn("bin", b)
           .groupBy(*by, "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("count")))
    if dense:
        # Every bin of every ``by`` group, empty ones with count 0: the bins are generated
        # per distinct group (``explode(sequence(..))``), then the counts are joined on.
        axis = (d.select(*by, "_lo", "_hi").distinct()
                 .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(nbins - 1)))))
        g = (join_on(axis, g.drop("_lo", "_hi"), [*by, "bin"], "left")
             .withColumn("count", F.coalesce(F.col("count"), F.lit(0).cast("bigint"))))
    return g.select(*by, "bin", (lo_c + F.col("bin") * width).alias("bin_lo"),
                    (lo_c + (F.col("bin") + 1) * width).alias("bin_hi"), "count")


def _labeled(df: DataFrame) -> DataFrame:
    return df.where(F.col("YearLabel").isin(THIS_YEAR, LAST_YEAR))


def margin_histogram(df: DataFrame, nbins: int = 50) -> DataFrame:
    """Row margin per year, nulls dropped, ``nbins`` bins over the data range."""
    return histogram(_labeled(df), "ProfitMargin", nbins, by=["YearLabel"])


def lead_time_histogram(df: DataFrame, lo: int = -30, hi: int = 365, nbins: int = 60) -> DataFrame:
    """A9 (F7 inclusive range): lead-time days within [lo, hi] per year, ``nbins`` bins over that range."""
    d = _labeled(df).where(F.col("LeadTimeDays").between(lo, hi))
    return histogram(d, "LeadTimeDays", nbins, lo=float(lo), hi=float(hi), by=["YearLabel"])


# Bins per factor of e of the two histograms below: a bin spans a thousandth of its values.
FINE_BINS = 1024
# Rounding of a bar's position, and of a quantile, that the choice of edge bins allows for.
SLACK = 1e-6


def _bars(whole: DataFrame, edges: DataFrame, rows: DataFrame, by: Sequence[str], nbins: int) -> DataFrame:
    """Bars over [lo, hi] of (by, lo, hi, value, count) rows: fine bins that are no edge bins count as a
    whole at their least value, the others value by value."""
    kept = join_on(whole, edges, edges.columns, "left_anti")
    d = kept.select(*by, "lo", "hi", F.col("_at").alias("_v"), F.col("_cnt").alias("_c")).unionByName(rows.select(*by, "lo", "hi", "_v", "_c"))
    width = (F.col("hi") - F.col("lo")) / nbins
    raw = F.when(width > 0, F.floor((F.col("_v") - F.col("lo")) / width)).otherwise(F.lit(0))
    d = d.withColumn("bin", F.least(raw, F.lit(nbins - 1)).cast("int"))
    return (d.groupBy(*by, "bin", "lo", "hi").agg(F.sum("_c").alias("count"))
             .select(*by, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                     (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"), "count"))


def order_size_histogram(df: DataFrame, nbins: int = 50) -> DataFrame:
    """A10 (legacy): order revenue below its 99th percentile (F8), per year, in two scans.

    The first scan's fine bins bound the percentile, and so the largest order below it and the bars'
    edges; the second reads the bins that one of these may lie in."""
    probs, one = {"p99": 0.99}, [F.lit(0).alias("_g"), "_b"]
    folded = _pin(Q.fold(df, ["YearLabel"], "SaleTotal", bins=FINE_BINS).where(F.col("_cnt") > 0))
    both = folded.groupBy(*one).agg(F.sum("_cnt").alias("_cnt"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    want = _pin(Q.wanted(both, ["_g"], probs))
    reach = want.agg(F.struct(F.min("_b").alias("first"), F.max("_b").alias("last")).alias("r")).select("r").scalar()
    b = _labeled(folded).withColumn("_r", reach)
    # Every value of a bin before the percentile's first is below it; none after its last is.
    ends = b.agg(F.struct(F.min("_lo").alias("lo"),
                          F.max(F.when(F.col("_b") < F.col("_r.first"), F.col("_hi"))).alias("under"),
                          F.max(F.when(F.col("_b") <= F.col("_r.last"), F.col("_hi"))).alias("most")).alias("e")).select("e").scalar()
    b = _pin(b.withColumn("_e", ends).where(F.col("_b") <= F.col("_r.last")))
    at = lambda v, hi: (v - F.col("_e.lo")) / (hi - F.col("_e.lo")) * nbins
    split = F.floor(at(F.col("_lo"), F.col("_e.most")) - SLACK) != F.floor(at(F.col("_hi"), F.col("_e.under")) + SLACK)
    unsure = (F.col("_b") >= F.col("_r.first")) | (F.col("_e.under") <= F.col("_e.lo")) | split
    edges = _pin(b.where(F.coalesce(unsure, F.lit(True))).select("_b").union(want.select("_b")).distinct())
    # Fine bins have a fixed number, so the broadcast has a bound.
    rows = _pin(Q.runs(df, ["YearLabel"], "SaleTotal", edges, [], True, FINE_BINS))
    values = rows.groupBy(*one, "_v").agg(F.sum("_c").alias("_c"))
    p99 = Q.interpolated(want, Q.pick(want, values, ["_g"]), ["_g"], probs, None).select("p99").scalar()
    less = _labeled(rows).withColumn("_p", p99).where(F.col("_v") < F.col("_p"))
    whole = b.where(F.col("_b") < F.col("_r.first")).withColumn("_at", F.col("_lo"))
    top = less.agg(F.max("_v").alias("m")).select("m").scalar()
    # The largest below is a value of the edge bins or the end of a whole bin.
    spanned = lambda d: d.withColumn("_e", ends).withColumns({"lo": F.col("_e.lo"), "hi": F.greatest(F.col("_e.under"), top)})
    return _bars(spanned(whole), edges, spanned(less), ["YearLabel"], nbins)


def clipped_histograms(df: DataFrame, nbins: int = 60) -> DataFrame:
    """SaleTotal, TicketCost and Profit clipped to [0 (Profit: p1), p99], ``nbins`` bars
    over each clipped range; long form with a ``column_name`` field; two scans.

    The first scan counts the three columns' fine bins; these bound the quantiles and the bars'
    edges, and the second scan reads the bins that one of them may lie in.  The tables per column
    (3 rows) and per fine bin (a fixed number) are broadcast.
    """
    cols, by = ("SaleTotal", "TicketCost", "Profit"), ["column_name"]
    probs = {"p1": 0.01, "p99": 0.99}
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {pairs}) as (column_name, x)")
    folded = _pin(Q.fold(long, by, "x", bins=FINE_BINS).where(F.col("_cnt") > 0))
    want = _pin(Q.wanted(folded, by, probs))
    found = want.select(*by, "_lo", "_hi", F.explode("_hits").alias("h"))
    near = found.groupBy(*by).agg(*[e for q in probs for e in (
        F.min(F.when(F.col("h.q") == q, F.col("_lo"))).alias(f"{q}_least"), F.max(F.when(F.col("h.q") == q, F.col("_hi"))).alias(f"{q}_most"))])
    span = folded.groupBy(*by).agg(F.min("_lo").alias("low"), F.max("_hi").alias("high"))
    b = join_on(join_on(folded, near, by, broadcast=True), span, by, broadcast=True)

    def clip(v: Column, p1: Column, p99: Column) -> Column:
        return F.least(F.greatest(v, F.when(F.col("column_name") == "Profit", p1).otherwise(F.lit(0.0))), p99)

    def place(v: str, p1: Column, p99: Column) -> Column:
        lo, hi = clip(F.col("low"), p1, p99), clip(F.col("high"), p1, p99)
        return F.when(hi > lo, (clip(F.col(v), p1, p99) - lo) / (hi - lo) * nbins).otherwise(0.0)

    corners = [(F.col(f"p1_{x}") + d1, F.col(f"p99_{y}") + d2) for x, d1 in (("least", -SLACK), ("most", SLACK)) for y, d2 in (("least", -SLACK), ("most", SLACK))]
    first = F.floor(F.least(*[place("_lo", *c) for c in corners]) - SLACK)
    last = F.floor(F.greatest(*[place("_hi", *c) for c in corners]) + SLACK)
    edges = _pin(b.where((F.col("_lo") < F.col("_hi")) & (first != last)).select(*by, "_b").union(want.select(*by, "_b")).distinct())
    rows = _pin(Q.runs(long, by, "x", edges, by, True, FINE_BINS))
    q = Q.interpolated(want, Q.pick(want, rows, by), by, probs)
    limits = _pin(join_on(q, span, by))

    def spanned(d: DataFrame, v: str, out: str) -> DataFrame:
        own = join_on(d, limits, by, broadcast=True)
        return own.withColumns({out: clip(F.col(v), F.col("p1"), F.col("p99")), "lo": clip(F.col("low"), F.col("p1"), F.col("p99")),
                                "hi": clip(F.col("high"), F.col("p1"), F.col("p99"))})
    return _bars(spanned(folded, "_lo", "_at"), edges, spanned(rows, "_v", "_v"), by, nbins)


FIVE = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}


def margin_box(df: DataFrame, group_col: str) -> DataFrame:
    """A19 + T9: five-number summary of the row margin per group, ranked by median (desc)."""
    d = df.where(F.col(group_col).isNotNull() & F.col("ProfitMargin").isNotNull())
    q = quantiles(d, [group_col], "ProfitMargin", FIVE, sums={"n": F.lit(1)})
    out = global_order(q, [F.col("median").desc(), F.col(group_col).asc()], "_mr")
    return out.select(F.col(group_col).alias("group_value"), *FIVE, "n", (F.col("_mr") - 1).cast("int").alias("median_rank"))


def margin_summary(df: DataFrame, group_col: str) -> DataFrame:
    """Revenue, median / p25 / p75 row margin (0 without margins), loss orders and share."""
    d = df.where(F.col(group_col).isNotNull())
    out = quantiles(d, [group_col], "ProfitMargin", {"median": 0.5, "p25": 0.25, "p75": 0.75},
                    sums={"rev": F.coalesce(F.col("SaleTotal"), M.zero()), "orders": F.lit(1), "loss": F.when(F.col("Profit") < 0, 1).otherwise(0)})
    return out.select(F.col(group_col).alias("group_value"), F.col("rev").cast("double").alias("revenue"),
                      *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"{c}_margin") for c in ("median", "p25", "p75")],
                      F.col("loss").alias("loss_orders"), (F.col("loss") / F.col("orders") * 100).alias("loss_pct"),
                      "orders").orderBy(F.col("revenue").desc(), "group_value")


def lead_bucket_margin(df: DataFrame) -> DataFrame:
    """Per fine lead-time bucket (observed only): orders, median row margin and the
    aggregate margin sum(profit) / sum(revenue)."""
    d = (df.where(F.col("LeadTimeDays").isNotNull() & F.col("ProfitMargin").isNotNull())
           .withColumn("bucket", fine_lead_bucket("LeadTimeDays"))
           .withColumn("bucket_order", fine_lead_order("LeadTimeDays"))
           .where(F.col("bucket").isNotNull()))
    out = quantiles(d, ["bucket", "bucket_order"], "ProfitMargin", {"median_margin": 0.5},
                    sums={"orders": F.lit(1), "rev": F.col("SaleTotal"), "prof": F.col("Profit")})
    return out.select("bucket", "bucket_order", "orders", "median_margin",
                      F.when(F.col("rev") != 0, F.col("prof").cast("double") / F.col("rev").cast("double") * 100)
                      .alias("agg_margin"))


def _long(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    return table.selectExpr(f"stack({len(columns)}, {pairs}) as (column_name, value)")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def robust_ranges(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(p10, p90) of each column's finite values; null when fewer than 2 or equal."""
    long = _long(_pin(table), columns).where(_finite(F.col("value")))
    out = quantiles(long, ["column_name"], "value", {"p10": 0.1, "p90": 0.9}, sums={"n": F.lit(1)})
    ok = (F.col("n") >= 2) & (F.col("p10") != F.col("p90"))
    return out.select("column_name", F.when(ok, F.col("p10")).alias("lo"), F.when(ok, F.col("p90")).alias("hi"))


def diverging_bounds(table: DataFrame, columns: Sequence[str], method: str = "p90") -> DataFrame:
    """Symmetric bound per column: 90th percentile of |v| (or the max of |v|); null
    when fewer than 2 finite values or the bound is 0."""
    table = table if method == "max" else _pin(table)
    long = _long(table, columns).where(_finite(F.col("value"))).withColumn("value", F.abs("value"))
    if method == "max":
        out = long.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("b"))
    else:
        out = quantiles(long, ["column_name"], "value", {"b": 0.9}, sums={"n": F.lit(1)})
    ok = (F.col("n") >= 2) & (F.col("b") != 0)
    return out.select("column_name", F.when(ok, F.col("b")).alias("bound"))


def scatter_frame(df: DataFrame) -> DataFrame:
    """Cost vs revenue points (F9: both positive) with the break-even line's upper end."""
    d = df.where((F.col("SaleTotal") > 0) & (F.col("TicketCost") > 0))
    upper = d.agg(F.greatest(F.max("SaleTotal"), F.max("TicketCost")).cast("double").alias("u")).select("u").scalar()
    return d.select(F.col("TicketCost").cast("double").alias("cost"), F.col("SaleTotal").cast("double").alias("revenue"),
                    F.col("Sport").alias("sport"), F.col("TicketsSold").alias("tickets"),
                    F.col("CompanyName").alias("affiliate"), F.col("EventName").alias("event"),
                    F.col("ProfitMargin").alias("margin"), upper.alias("upper"))


# FIXED VALUES — modulus and step of the sample's draw.
SAMPLE_PRIME, SAMPLE_STEP = 2_147_483_647, 48_271


def scatter_sample(df: DataFrame, n: int = 5000, by: str | None = None) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), or ``n`` of each value of ``by``, with the break-even side flag.

    The rows with the least draws: arithmetic on the order key (a multiplicative step modulo a prime),
    so the sample is the same on every run and in every engine; equal draws go by the key and the
    row's values.  Each partition keeps its first ``n`` rows and these are merged, whatever the size."""
    draw = F.col("InvoiceID").cast("long") % F.lit(SAMPLE_PRIME) * F.lit(SAMPLE_STEP) % F.lit(SAMPLE_PRIME)
    points = df.select(draw.alias("_draw"), F.col("InvoiceID").alias("_id"), F.col("TicketCost").cast("double").alias("cost"),
                       F.col("SaleTotal").cast("double").alias("revenue"), F.col("Sport").alias("sport"),
                       F.col("CompanyName").alias("affiliate"), L.break_even_side("Profit").alias("profit_side"),
                       *([F.col(by).alias("_by")] if by else []))
    order = ["_draw", "_id", "cost", "revenue", "sport", "affiliate", "profit_side"]
    if by:
        place = F.row_number().over(Window.partitionBy("_by").orderBy(*order))
        points = points.withColumn("_place", place).where(F.col("_place") <= n)
    else:
        points = points.orderBy(*order).limit(n)
    return points.select("cost", "revenue", "sport", "affiliate", "profit_side")
