"""Report bundles: the source application's pages as dictionaries of lazy DataFrames.

Each bundle applies the global scope (affiliate, sports) once and hands the scoped frame to
the operators.  Building a bundle pins some small aggregates (quantiles, grid cells), which runs jobs;
the rest runs when the caller acts on a result.  Persist the enriched fact
first (:func:`marginmart.sources.sinks.materialize`) when many bundles share it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare as C
from ..operators import distributions as D
from ..operators import grids as G
from ..operators import profile as P
from ..operators import ranking as R
from ..operators import risk as K
from ..operators import scope as S
from ..operators import shares as SH
from ..operators.quantiles import _pin
from .catalog import YOY_DIMENSIONS

Bundle = dict[str, DataFrame]

# FIXED VALUES — margin-page group choices.
MARGIN_GROUPS = {"Sport": "Sport", "Affiliate": "CompanyName", "Marketplace": "ShippingCompany",
                 "Section tier": "SectionNumTier"}


def _scoped(df: DataFrame, affiliate: str | None, sports: Sequence[str] | None):
    fdf = S.scope(df, affiliate, sports)
    ty, ly = S.split_years(fdf)
    return fdf, ty, ly


def executive_summary(df: DataFrame, affiliate=None, sports=None) -> Bundle:
    """KPI row, monthly trend, and the (unscoped) affiliate YoY table."""
    fdf, _, _ = _scoped(df, affiliate, sports)
    return {"kpis": C.kpi_deltas(fdf), "monthly": C.monthly_trend(fdf),
            "affiliates": C.yoy_table(df, "CompanyName")}


def yoy_trends(df: DataFrame, dimension: str = "Sport", metric: str = "SaleTotal", affiliate=None, sports=None) -> Bundle:
    """R2: KPI row, YoY bars by a dimension (top 25 for affiliate / state), YoY table, monthly KPIs."""
    fdf, _, _ = _scoped(df, affiliate, sports)
    col = YOY_DIMENSIONS.get(dimension, dimension)
    top = 25 if col in ("CompanyName", "State") else None
    return {"kpis": C.kpi_deltas(fdf), "bars": C.yoy_compare(fdf, col, metric, top_n=top),
            "table": C.yoy_table(fdf, col), "monthly": C.monthly_kpi(fdf)}


def affiliate_performance(df: DataFrame, affiliate: str, sports=None) -> Bundle:
    """One affiliate vs the portfolio and vs last year, its trend, mixes and sport table."""
    fdf, ty, _ = _scoped(df, affiliate, sports)
    port = S.scope(df, None, sports)
    return {"kpis": C.kpi_deltas(fdf), "vs_portfolio": C.affiliate_vs_portfolio(port, affiliate),
            "vs_portfolio_per_order": C.affiliate_vs_portfolio_per_order(port, affiliate),
            "yoy": C.affiliate_yoy(fdf), "monthly": C.monthly_trend(fdf),
            "sport_mix": SH.share_by(ty, "Sport", "SaleTotal"),
            "marketplace_mix": SH.share_by(ty, "ShippingCompany", "SaleTotal"),
            "by_sport": C.yoy_table(fdf, "Sport")}


def affiliate_leaderboard(df: DataFrame) -> Bundle:
    """Unscoped affiliate YoY table."""
    return {"table": C.yoy_table(df, "CompanyName")}


def head_to_head(df: DataFrame, a: str, b: str, sports=None, metric: str = "SaleTotal") -> Bundle:
    """Two affiliates side by side."""
    fdf = S.scope(df, None, sports)
    both = S.pair(fdf, a, b)
    return {"kpis_a": C.kpi_deltas(S.scope(fdf, a)), "kpis_b": C.kpi_deltas(S.scope(fdf, b)),
            "bars": C.yoy_compare(both, "CompanyName", metric),
            "mix_a": SH.share_by(S.split_years(S.scope(fdf, a))[0], "Sport"),
            "mix_b": SH.share_by(S.split_years(S.scope(fdf, b))[0], "Sport"),
            "table": C.head_to_head(fdf, a, b)}


def sport_breakdown(df: DataFrame, affiliate=None, sports=None) -> Bundle:
    """R6."""
    fdf, ty, _ = _scoped(df, affiliate, sports)
    return {"kpis": C.kpi_deltas(fdf), "revenue_share": SH.share_by(ty, "Sport"),
            "order_share": SH.order_share_by(ty, "Sport"), "table": C.yoy_table(fdf, "Sport")}


def team_performance(df: DataFrame, sport_filter: Sequence[str] | None = None, top_n: int = 20,
                     affiliate=None, sports=None, years=("This Year",), metric: str = "SaleTotal") -> Bundle:
    """Team breakdown (page-local sport filter, F5) and YoY bars of a metric for the top teams."""
    fdf, _, _ = _scoped(df, affiliate, sports)
    if sport_filter:
        fdf = fdf.where(F.col("Sport").isin(list(sport_filter)))
    return {"teams": R.team_breakdown(fdf, years), "bars": C.yoy_compare(fdf, "HomeTeam", metric, top_n=top_n)}


def marketplace(df: DataFrame, affiliate=None, sports=None) -> Bundle:
    """R8."""
    fdf, ty, _ = _scoped(df, affiliate, sports)
    return {"tier_share": SH.share_by(ty, "MarketplaceTier"), "marketplace_share": SH.share_by(ty, "ShippingCompany"),
            "delivery_share": SH.share_by(ty, "DeliveryType"), "margin_box": D.margin_box(ty, "ShippingCompany"),
            "table": C.yoy_table(fdf, "ShippingCompany")}


def margin_deep_dive(df: DataFrame, group: str = "Sport", affiliate=None, sports=None) -> Bundle:
    """KPIs, margin histogram, scatter, margin box, worst loss orders, summaries."""
    fdf, ty, _ = _scoped(df, affiliate, sports)
    col = MARGIN_GROUPS.get(group, group)
    return {"kpis": C.kpi_deltas(fdf), "histogram": D.margin_histogram(fdf), "scatter": D.scatter_frame(ty),
            "scatter_sample": D.scatter_sample(ty), "margin_box": D.margin_box(ty, col),
            "worst_losses": R.worst_loss_orders(fdf), "summary_affiliate": D.margin_summary(ty, "CompanyName"),
            "summary_sport": D.margin_summary(ty, "Sport")}


def ticket_type(df: DataFrame, tier: str = "SectionNumTier", metric: str = "SaleTotal", affiliate=None, sports=None) -> Bundle:
    """Tier and quantity mixes (order counts for Orders; ratio metrics fall back to profit), box, codes, table."""
    fdf, ty, _ = _scoped(df, affiliate, sports)
    share_metric = metric if metric in ("SaleTotal", "Profit") else "Profit"

    def mix(col: str) -> DataFrame:
        return SH.order_share_by(ty, col) if metric == "Orders" else SH.share_by(ty, col, share_metric)
    return {"tier_share": mix(tier), "quantity_share": mix("QuantityBucket"),
            "tier_orders": SH.order_share_by(ty, tier), "margin_box": D.margin_box(ty, tier),
            "section_codes": R.section_codes(ty), "table": C.yoy_table(fdf, tier)}


def geography(df: DataFrame, affiliate=None, sports=None) -> Bundle:
    """Shared map range, per-state metrics per year, state YoY table."""
    fdf, ty, ly = _scoped(df, affiliate, sports)
    return {"range": G.state_shared_range(fdf),
            "this_year": G.state_metric(ty), "last_year": G.state_metric(ly), "table": C.state_yoy(fdf)}


def heatmap_hub(df: DataFrame, metric: str = "SaleTotal", affiliate=None, sports=None) -> Bundle:
    """Three grids, each with its range and its cells' colour positions and labels, and the cross-tab.

    For sum metrics the sport and tier grids share one range; for ratios, and for the team grid, the
    range is the grid's own."""
    _, ty, _ = _scoped(df, affiliate, sports)
    grids = {"sport": G.heatmap_grid(ty, "CompanyName", "Sport", metric),
             "marketplace": G.heatmap_grid(ty, "CompanyName", "MarketplaceTier", metric),
             "teams": G.heatmap_grid(ty, "CompanyName", "HomeTeam", metric, top_cols=15)}
    # Cells of a ratio grid that have no orders are 0 in the source's grid, and 0 takes no part in a range.
    cells = {name: _pin(g.select("row_label", "col_label", "value")) for name, g in grids.items()}
    ranges = {name: G.shared_range([c]) for name, c in cells.items() if name == "teams" or metric not in G.SUM_METRICS}
    if metric in G.SUM_METRICS:
        ranges["shared"] = G.shared_range([cells["sport"], cells["marketplace"]])
    out = {**grids, "cross_tab": G.cross_tab(ty), **{f"{name}_range": r for name, r in ranges.items()}}
    for name, c in cells.items():
        out[f"{name}_intensity"] = G.intensity(c, ranges.get(name, ranges.get("shared")).select("zmax").scalar(), metric)
    return out


def time_patterns(df: DataFrame, affiliate=None, sports=None) -> Bundle:
    """R13."""
    fdf, ty, _ = _scoped(df, affiliate, sports)
    return {"day_hour": G.day_hour_grid(fdf), "lead_time": D.lead_time_histogram(fdf),
            "margin_box": D.margin_box(ty, "LeadTimeBucket")}


def top_events(df: DataFrame, by: str = "Profit", n: int = 20, affiliate=None, sports=None) -> Bundle:
    """Event rollup, top n by a metric, bottom 15 by profit."""
    fdf, _, _ = _scoped(df, affiliate, sports)
    return {"events": R.event_rollup(fdf), "top": R.top_events(fdf, n, by), "bottom": R.bottom_events(fdf)}


def risk_delivery(df: DataFrame, affiliate=None, sports=None) -> Bundle:
    """R15."""
    _, ty, ly = _scoped(df, affiliate, sports)
    return {"kpis": K.delivery_kpis(ty), "undelivered": K.undelivered_by_affiliate(ty),
            "cancellations": K.cancellations_by_affiliate(ly), "delivery_rate": K.delivery_rate_by_affiliate(ty)}


def eda_pack(df: DataFrame) -> Bundle:
    """The notebook's profile, headline, concentration, margin, risk and shift tables."""
    ty = S.split_years(df)[0]
    return {"profile": P.profile_dates(df), "missing": P.missingness(df), "distributions": D.clipped_histograms(df),
            "headline": C.headline(df), "monthly": C.monthly_trend(df), "affiliates": C.yoy_table(df, "CompanyName"),
            "winners": R.winners_losers(df, best=True), "losers": R.winners_losers(df, best=False),
            "pareto": R.pareto(df), "pareto_80": R.pareto_80(df), "margin_by_dimension": R.margin_by_dimension(ty),
            "lead_buckets": D.lead_bucket_margin(ty), "loss_profile": K.loss_profile(df),
            "loss_concentration": R.loss_concentration(df), "undelivered": K.undelivered_by_affiliate(ty),
            "order_size": C.order_size_shift(df), "mix_shift": C.mix_shift(df), "worst_pairs": R.worst_pairs(df),
            "export": P.export_rollup(df), "export_total": P.filtered_total(df)}


PAGES = {
    "Executive Summary": executive_summary, "YoY Trend Analysis": yoy_trends,
    "Affiliate Performance": affiliate_performance, "Affiliate Leaderboard": affiliate_leaderboard,
    "Affiliate Head-to-Head": head_to_head, "Sport Breakdown": sport_breakdown,
    "Team Performance": team_performance, "Marketplace & Channel": marketplace,
    "Profit Margin Deep Dive": margin_deep_dive, "Ticket Type & Inventory": ticket_type,
    "Geographic Map": geography, "Heatmap Hub": heatmap_hub, "Time Patterns": time_patterns,
    "Top Events": top_events, "Risk & Delivery": risk_delivery, "EDA": eda_pack,
}
