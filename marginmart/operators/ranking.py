"""Rankings and concentration.

Top-k is ``orderBy(...).limit(k)``, which Spark plans as a per-partition top-k and a
k-row merge (``TakeOrderedAndProject``), never a global sort of the input.  Windows
without a partition key (Pareto ranks, cumulative shares) only ever run on aggregated
rows (one per affiliate), not on the fact table.  Ties are broken on the group key, so
every result is deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.enrich import THIS_YEAR
from . import compare as C
from .joins import join_on
from .ordering import global_order
from .quantiles import _pin

EVENT_KEYS = ("EventName", "VenueName", "EventDate_dt")


def team_breakdown(df: DataFrame, years: Sequence[str] | None = (THIS_YEAR,)) -> DataFrame:
    """A28 (+ A58, W6): per home team the metrics, average order, orders, tickets, the most
    frequent sport (smallest on ties) and the best / worst affiliate by profit.

    Best = highest profit (smallest name on ties); worst = lowest profit (largest name on
    ties), only when the team has more than one affiliate.  Both are ``min_by`` /
    ``max_by`` aggregates over per-(team, affiliate) sums: partial aggregation, no window.
    """
    if years:
        df = df.where(F.col("YearLabel").isin(list(years)))
    d = df.where(F.col("HomeTeam").isNotNull())
    # One scan of the fact: (team, affiliate, sport) partial sums, pinned; everything else is
    # aggregated from that small table.
    base = _pin(d.groupBy("HomeTeam", "CompanyName", "Sport").agg(
        *M.component_aggs(), F.coalesce(F.sum(F.col("TicketsSold").cast("bigint")), F.lit(0).cast("bigint")).alias("tickets")))
    sport_counts = (base.where(F.col("Sport").isNotNull()).groupBy("HomeTeam", "Sport")
                        .agg(F.sum("orders").alias("_c")))
    modes = sport_counts.groupBy("HomeTeam").agg(
        F.min_by("Sport", F.struct((-F.col("_c")).alias("nc"), F.col("Sport").alias("s"))).alias("sport"))
    teams = join_on(base.groupBy("HomeTeam").agg(*[F.sum(c).alias(c) for c in ("rev", "prof", "cost", "orders", "tickets")]),
                    modes, ["HomeTeam"], "left")
    per_aff = (base.where(F.col("CompanyName").isNotNull()).groupBy("HomeTeam", "CompanyName")
                   .agg(F.sum("prof").alias("p")))
    key = F.struct((-F.col("p")).alias("np"), F.col("CompanyName").alias("n"))
    affs = per_aff.groupBy("HomeTeam").agg(F.min_by("CompanyName", key).alias("top_affiliate"),
                                           F.max_by("CompanyName", key).alias("worst"),
                                           F.count(F.lit(1)).alias("n_aff"))
    out = join_on(teams, affs, ["HomeTeam"], "left")
    return out.select(
        F.col("HomeTeam").alias("team"), "sport",
        F.col("rev").cast("double").alias("revenue"), F.col("prof").cast("double").alias("profit"),
        M.guarded_pct(F.col("prof"), F.col("rev")).alias("margin"),
        M.guarded_pct(F.col("prof"), F.col("cost")).alias("ratio"),
        (F.col("rev").cast("double") / F.col("orders")).alias("avg_order"),
        "orders", "tickets", "top_affiliate",
        F.when(F.col("n_aff") > 1, F.col("worst")).alias("worst_affiliate"),
    ).orderBy(F.col("profit").desc(), "team")


def event_rollup(df: DataFrame) -> DataFrame:
    """Per (event, venue, event date), rows with a null key dropped: revenue, cost,
    profit, orders (non-null invoice ids), tickets, margin and cost ratio."""
    d = df.where(F.col("EventName").isNotNull() & F.col("VenueName").isNotNull() & F.col("EventDate_dt").isNotNull())
    g = d.groupBy(*EVENT_KEYS).agg(
        M.dsum("SaleTotal").alias("rev"), M.dsum("TicketCost").alias("cost"), M.dsum("Profit").alias("prof"),
        F.count("InvoiceID").alias("orders"),
        F.coalesce(F.sum(F.col("TicketsSold").cast("bigint")), F.lit(0).cast("bigint")).alias("tickets"))
    return g.select(
        F.col("EventName").alias("event"), F.col("VenueName").alias("venue"), F.col("EventDate_dt").alias("event_date"),
        F.col("rev").cast("double").alias("revenue"), F.col("cost").cast("double").alias("cost"),
        F.col("prof").cast("double").alias("profit"), "orders", "tickets",
        M.guarded_pct(F.col("prof"), F.col("rev")).alias("margin"),
        M.guarded_pct(F.col("prof"), F.col("cost")).alias("ratio"))


RANK_COLUMNS = {"SaleTotal": "revenue", "Profit": "profit", "Margin": "margin", "Ratio": "ratio", "Orders": "orders"}


def top_events(df: DataFrame, n: int = 20, by: str = "Profit") -> DataFrame:
    """T4 / T5: the ``n`` events ranked highest by a metric (keys break ties)."""
    col = RANK_COLUMNS.get(by, by)
    return event_rollup(df).orderBy(F.col(col).desc(), "event", "venue", "event_date").limit(n)


def bottom_events(df: DataFrame, n: int = 15) -> DataFrame:
    """T4: the ``n`` events with the lowest profit."""
    return event_rollup(df).orderBy(F.col("profit").asc(), "event", "venue", "event_date").limit(n)


def worst_loss_orders(df: DataFrame, n: int = 20) -> DataFrame:
    """T6 + E28 (+F10): the ``n`` loss orders with the lowest profit, report columns renamed."""
    d = df.where(F.col("Profit") < 0)
    cols = [F.col("YearLabel").alias("year"), F.col("CompanyName").alias("affiliate"),
            F.col("EventName").alias("event"), F.col("VenueName").alias("venue"),
            F.col("SaleTotal").cast("double").alias("revenue"), F.col("TicketCost").cast("double").alias("cost"),
            F.col("Profit").cast("double").alias("profit"), F.col("ProfitMargin").alias("margin"),
            F.col("ShippingCompany").alias("marketplace")]
    out = d.select(*cols)
    return out.orderBy("profit", "revenue", "affiliate", "event", "venue", "year", "marketplace").limit(n)


def pareto(df: DataFrame) -> DataFrame:
    """W1 + W2 + W5: affiliates by this-year revenue (desc, name), rank, share and
    cumulative share of revenue (exact decimal running sum).  Ranks and running sums come
    from :func:`global_order`, so no single task holds every affiliate."""
    g = (df.where((F.col("YearLabel") == THIS_YEAR) & F.col("CompanyName").isNotNull())
           .groupBy("CompanyName").agg(M.dsum("SaleTotal").alias("rev")))
    # One row per affiliate, read three times below (size check, total, ranking): pinned
    # once so the fact is scanned once.
    g = _pin(g)
    total = g.agg(F.sum("rev").alias("t")).select("t").scalar()
    ranked = global_order(g, [F.col("rev").desc(), F.col("CompanyName").asc()], "rank", {"_run": "rev"})
    return ranked.select(F.col("CompanyName").alias("affiliate"), F.col("rev").cast("double").alias("revenue"),
                         F.col("rank").cast("int").alias("rank"),
                         F.when(total != 0, F.col("rev").cast("double") / total.cast("double") * 100).alias("share_pct"),
                         F.when(total != 0, F.col("_run").cast("double") / total.cast("double") * 100)
                         .alias("cum_share_pct"))


def pareto_80(df: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Number of affiliates, first rank whose cumulative share reaches the threshold,
    and the largest single share."""
    p = pareto(df)
    return p.agg(F.count(F.lit(1)).alias("affiliates"),
                  F.min(F.when(F.col("cum_share_pct") >= threshold, F.col("rank"))).alias("rank_at_threshold"),
                  F.max("share_pct").alias("top_share_pct"))


def winners_losers(df: DataFrame, n: int = 10, min_base: float = 1000.0, best: bool = True) -> DataFrame:
    """T7 (+F13): affiliates with a last-year revenue base above ``min_base``, the ``n``
    largest (or smallest) revenue YoY %."""
    t = C.yoy_table(df, "CompanyName").where(F.col("revenue_yoy_pct").isNotNull() & (F.col("revenue_ly") > min_base))
    order = F.col("revenue_yoy_pct").desc() if best else F.col("revenue_yoy_pct").asc()
    return t.orderBy(order, "CompanyName").limit(n)


def loss_concentration(df: DataFrame, k: int = 5) -> DataFrame:
    """Total loss over loss-making orders, their count and average, and the ``k``
    affiliates with the largest losses with their combined share of the total."""
    # Loss per affiliate (null-name group included for the totals), pinned: one fact scan.
    per = _pin(df.where(F.col("Profit") < 0).groupBy("CompanyName")
                 .agg(M.dsum("Profit").alias("l"), F.count(F.lit(1)).alias("c")))
    tot = per.agg(F.struct(F.sum("l").alias("t"), F.sum("c").alias("n")).alias("s")).select("s").scalar()
    top = (per.where(F.col("CompanyName").isNotNull()).select("CompanyName", "l")
              .orderBy(F.col("l").asc(), "CompanyName").limit(k)).withColumn("_t", tot)
    t, n = F.col("_t")["t"], F.col("_t")["n"]
    rank = F.row_number().over(Window.orderBy(F.col("l").asc(), "CompanyName"))
    top_sum = F.sum("l").over(Window.partitionBy(F.lit(1)))
    return top.select(F.col("CompanyName").alias("affiliate"), F.col("l").cast("double").alias("loss_dollars"),
                      rank.alias("loss_rank"), t.cast("double").alias("total_loss"), n.alias("loss_orders"),
                      F.when(n > 0, t.cast("double") / n).alias("avg_loss"),
                      F.when(t != 0, top_sum.cast("double") / t.cast("double") * 100).alias("top_share_pct"))


def worst_pairs(df: DataFrame, n: int = 10, min_revenue: float = 5000.0) -> DataFrame:
    """A48 (+F13): this-year (affiliate, sport) pairs with revenue >= ``min_revenue`` and the
    ``n`` lowest aggregate margins."""
    g = (df.where((F.col("YearLabel") == THIS_YEAR) & F.col("CompanyName").isNotNull() & F.col("Sport").isNotNull())
           .groupBy("CompanyName", "Sport").agg(*M.component_aggs()))
    g = g.where(F.col("rev") >= min_revenue)
    out = g.select(F.col("CompanyName").alias("affiliate"), F.col("Sport").alias("sport"),
                   F.col("rev").cast("double").alias("revenue"), F.col("prof").cast("double").alias("profit"),
                   "orders", M.guarded_pct(F.col("prof"), F.col("rev")).alias("margin"))
    return out.orderBy("margin", "affiliate", "sport").limit(n)


MARGIN_DIMENSIONS = ("Sport", "ShippingCompany", "SectionNumTier", "LeadTimeBucket")


def margin_by_dimension(df: DataFrame, dims: Sequence[str] = MARGIN_DIMENSIONS,
                        heads: dict[str, int] | None = None) -> DataFrame:
    """Revenue, profit, cost, orders, margin and cost ratio for several dimensions in
    ONE aggregation (grouping sets), long form; ``heads`` keeps the largest-revenue rows
    of a dimension (default: 8 marketplaces)."""
    heads = {"ShippingCompany": 8} if heads is None else heads
    # One aggregation of the fact, pinned: every dimension's rows are read from it.
    g = _pin(df.groupingSets([[d] for d in dims], *dims).agg(*M.component_aggs(), F.grouping_id().alias("_gid")))
    n = len(dims)
    gids = {d: (1 << n) - 1 - (1 << (n - 1 - i)) for i, d in enumerate(dims)}
    name = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for d, gid in gids.items():
        name = F.when(F.col("_gid") == gid, F.lit(d)).otherwise(name)
        value = F.when(F.col("_gid") == gid, F.col(d).cast("string")).otherwise(value)
    out = g.select(name.alias("dimension"), value.alias("value"), "rev", "prof", "cost", "orders").where(F.col("value").isNotNull())
    # Largest rows are taken of the headed dimensions alone, each by a distributed top-k.
    best = out.where(~F.col("dimension").isin(list(heads)))
    for d, k in heads.items():
        best = best.unionByName(out.where(F.col("dimension") == d).orderBy(F.col("rev").desc(), "value").limit(k))
    out = best
    return out.select(
        "dimension", "value", F.col("rev").cast("double").alias("revenue"), F.col("prof").cast("double").alias("profit"),
        F.col("cost").cast("double").alias("cost"), "orders",
        M.guarded_pct(F.col("prof"), F.col("rev")).alias("margin"),
        M.guarded_pct(F.col("prof"), F.col("cost")).alias("ratio"))


def section_codes(df: DataFrame) -> DataFrame:
    """A33 (+F12 non-empty): per raw section letter code: revenue, profit, orders and the MEAN
    row margin (the one place the source averages row margins), rounded to 6 decimals."""
    d = df.where(F.col("Section_Type").isNotNull() & (F.col("Section_Type") != ""))
    g = d.groupBy("Section_Type").agg(M.dsum("SaleTotal").alias("rev"), M.dsum("Profit").alias("prof"),
                                      F.count("InvoiceID").alias("orders"), F.avg("ProfitMargin").alias("m"))
    return g.select(F.col("Section_Type").alias("section_type"), F.col("rev").cast("double").alias("revenue"),
                    F.col("prof").cast("double").alias("profit"), "orders", F.round("m", 6).alias("avg_margin")
                    ).orderBy(F.col("revenue").desc(), "section_type")


def sort_table(table: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """Re-sort a finished table by one column, missing values last either way."""
    c = F.col(column)
    return table.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last())
