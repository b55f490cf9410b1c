"""One registered query per page (R1-R16): every frame of the page's bundle, cell by cell.

A page's frames differ in their columns, so the query gives them in long form: frame, row_key (the
text columns of a row, by name), field and number.  A page reads its columns of the cached mart (S5); where
the whole mart is cached already, they come from there.  The SQL of each frame re-derives it from the raw
tables; a page's filters are put into the SQL's enriched rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.cache import cached_mart
from . import reports as R
from .oracle import ORACLE, box_sql, compact_money_sql, share_sql, wrap_quantiles
from .oracle_base import LY, TY, dsum, gpct, with_enriched

A, B = "Supplier#000000001", "Supplier#000000002"


def long_form(bundle: dict[str, DataFrame], keys: dict[str, tuple[str, ...]]) -> DataFrame:
    """frame, row_key, field, number of every cell of every frame; all columns but the keys are numbers or flags."""
    out = None
    for frame, df in bundle.items():
        own = keys[frame]
        key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in own]) if own else F.lit("")
        cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("number")) for c in df.columns if c not in own])
        part = df.select(F.lit(frame).alias("frame"), key.alias("row_key"), F.inline(cells))
        out = part if out is None else out.unionByName(part)
    return out


def long_sql(frames: dict[str, tuple[tuple[str, ...], str]]) -> str:
    """The same of each frame's SQL."""
    parts = []
    for frame, (own, sql) in frames.items():
        key = " || '|' || ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in own) or "''"
        rest = f"* EXCLUDE ({', '.join(own)})" if own else "*"
        parts.append(f"SELECT '{frame}' AS frame, row_key, field, number FROM (SELECT {key} AS row_key, COLUMNS({rest})::DOUBLE FROM ({sql}) q) w "
                     f"UNPIVOT INCLUDE NULLS (number FOR field IN (COLUMNS(* EXCLUDE (row_key))))")
    return " UNION ALL ".join(parts)


def only(sql: str, where: str) -> str:
    """The frame's SQL over the enriched rows that meet ``where``."""
    return sql.replace("  FROM e1\n)", f"  FROM e1 WHERE {where}\n)")


def bars_sql(group: str, value: Callable[[str], str], top: int | None = None) -> str:
    limit = f" ORDER BY abs(v_ty) + abs(v_ly) DESC, grp LIMIT {top}" if top else ""
    return with_enriched("SELECT grp AS group_value, 'Last Year' AS year_label, v_ly AS value FROM t UNION ALL SELECT grp, 'This Year', v_ty FROM t",
                         f"t AS (SELECT {group} AS grp, {value(TY)} AS v_ty, {value(LY)} AS v_ly FROM e WHERE {group} IS NOT NULL GROUP BY 1{limit})")


def order_share_sql(group: str) -> str:
    return ORACLE["share_orders"].replace("SELECT Sport AS category", f"SELECT {group} AS category").replace(
        "FROM e WHERE Sport IS NOT NULL", f"FROM e WHERE {group} IS NOT NULL").replace("g AS (SELECT Sport,", f"g AS (SELECT {group},")


def range_sql(*grids: str) -> str:
    """0 and the 98th percentile of the non-zero cells (else their maximum, else 1) of grids' SQL."""
    cells = " UNION ALL ".join(f"SELECT value FROM ({g}) g" for g in grids)
    z = "round(quantile_cont(value, 0.98), 6)"
    return (f"SELECT 0.0::DOUBLE AS zmin, CASE WHEN {z} > 0 THEN {z} WHEN max(value) IS NOT NULL AND max(value) <> 0 THEN max(value) "
            f"ELSE 1.0 END AS zmax FROM ({cells}) WHERE value <> 0 AND NOT isnan(value) AND NOT isinf(value)")


def intensity_sql(grid: str, span: str) -> str:
    inside = "CASE WHEN zmax > 0 THEN value / zmax ELSE 0.0 END"
    shown = "(value <> 0 AND NOT isnan(value) AND abs(value) >= CASE WHEN zmax > 0 THEN zmax * 0.03 ELSE 0.0 END)"
    return (f"SELECT row_label, col_label, value, {inside} AS intensity, {shown} AS labeled, CASE WHEN {shown} THEN {compact_money_sql('value')} END AS label, "
            f"({inside}) > 0.5 AS light_text FROM ({grid}) g CROSS JOIN ({span}) z")


def margin(c: str) -> str:
    return gpct(dsum("Profit", c), dsum("SaleTotal", c))


def orders(c: str) -> str:
    return f"CAST(count(CASE WHEN {c} THEN 1 END) AS DOUBLE)"


def _is(name: str) -> str:
    return f"CompanyName = '{name}'"


_SPORT, _TIER, _TEAMS = ORACLE["grid_affiliate_sport"], ORACLE["grid_affiliate_tier"], ORACLE["grid_top_teams"]
_SHARED, _CELL, _EVENT = range_sql(_SPORT, _TIER), ("row_label", "col_label"), ("event", "venue", "event_date")
_PAIR = f"CompanyName IN ('{A}', '{B}')"
_MIX, _BAR = ("category",), ("group_value", "year_label")

# Per page: how its bundle is called, and each frame's key columns and SQL.
PAGE_FRAMES: dict[str, tuple[Callable[[DataFrame], dict[str, DataFrame]], dict[str, tuple[tuple[str, ...], str]]]] = {
    "r1_executive_summary": (R.executive_summary, {
        "kpis": ((), ORACLE["kpi_deltas"]), "monthly": (("year_month", "label"), ORACLE["monthly_trend"]),
        "affiliates": (("CompanyName",), ORACLE["yoy_by_affiliate"])}),
    "r2_yoy_trends": (lambda e: R.yoy_trends(e, "State", "Margin"), {
        "kpis": ((), ORACLE["kpi_deltas"]), "bars": (_BAR, bars_sql("State", margin, 25)),
        "table": (("State",), ORACLE["yoy_by_state"]), "monthly": (("year_month", "month"), ORACLE["monthly_kpi"])}),
    "r3_affiliate_performance": (lambda e: R.affiliate_performance(e, A), {
        "kpis": ((), only(ORACLE["kpi_deltas"], _is(A))),
        "vs_portfolio": (("affiliate", "metric"), f"SELECT * FROM ({ORACLE['affiliate_vs_portfolio']}) x WHERE affiliate = '{A}'"),
        "vs_portfolio_per_order": (("affiliate", "metric"), f"SELECT * FROM ({ORACLE['affiliate_vs_portfolio_per_order']}) x WHERE affiliate = '{A}'"),
        "yoy": (("affiliate", "metric", "year_label"), only(ORACLE["affiliate_yoy"], _is(A))),
        "monthly": (("year_month", "label"), only(ORACLE["monthly_trend"], _is(A))),
        "sport_mix": (_MIX, only(ORACLE["share_revenue"], _is(A))), "marketplace_mix": (_MIX, only(share_sql("ShippingCompany", "SaleTotal", TY), _is(A))),
        "by_sport": (("Sport",), only(ORACLE["yoy_by_sport"], _is(A)))}),
    "r4_affiliate_leaderboard": (R.affiliate_leaderboard, {"table": (("CompanyName",), ORACLE["yoy_by_affiliate"])}),
    "r5_head_to_head": (lambda e: R.head_to_head(e, A, B, metric="Margin"), {
        "kpis_a": ((), only(ORACLE["kpi_deltas"], _is(A))), "kpis_b": ((), only(ORACLE["kpi_deltas"], _is(B))),
        "bars": (_BAR, only(bars_sql("CompanyName", margin), _PAIR)),
        "mix_a": (_MIX, only(ORACLE["share_revenue"], _is(A))), "mix_b": (_MIX, only(ORACLE["share_revenue"], _is(B))),
        "table": (("affiliate_a", "affiliate_b", "metric"), only(ORACLE["head_to_head"].replace("(ORDER BY rev DESC, CompanyName)", "(ORDER BY CompanyName)"), _PAIR))}),
    "r6_sport_breakdown": (R.sport_breakdown, {
        "kpis": ((), ORACLE["kpi_deltas"]), "revenue_share": (_MIX, ORACLE["share_revenue"]), "order_share": (_MIX, ORACLE["share_orders"]),
        "table": (("Sport",), ORACLE["yoy_by_sport"])}),
    "r7_team_performance": (lambda e: R.team_performance(e, ["NBA", "NFL"], 15, metric="Orders"), {
        "teams": (("team", "sport", "top_affiliate", "worst_affiliate"), only(ORACLE["team_breakdown"], "Sport IN ('NBA', 'NFL')")),
        "bars": (_BAR, only(bars_sql("HomeTeam", orders, 15), "Sport IN ('NBA', 'NFL')"))}),
    "r8_marketplace": (R.marketplace, {
        "tier_share": (_MIX, share_sql("MarketplaceTier", "SaleTotal", TY)), "marketplace_share": (_MIX, share_sql("ShippingCompany", "SaleTotal", TY)),
        "delivery_share": (_MIX, ORACLE["share_delivery"]), "margin_box": (("group_value",), wrap_quantiles(box_sql("ShippingCompany", TY))),
        "table": (("ShippingCompany",), ORACLE["yoy_by_shipping_company"])}),
    "r9_margin_deep_dive": (R.margin_deep_dive, {
        "kpis": ((), ORACLE["kpi_deltas"]), "histogram": (("YearLabel",), ORACLE["hist_margin"]),
        "scatter": (("sport", "affiliate", "event"), ORACLE["scatter_frame"]),
        "scatter_sample": (("sport", "affiliate"), only(ORACLE["scatter_sample"], TY)), "margin_box": (("group_value",), ORACLE["margin_box"]),
        "worst_losses": (("year", "affiliate", "event", "venue", "marketplace"), ORACLE["worst_loss_orders"]),
        "summary_affiliate": (("group_value",), ORACLE["margin_summary"]), "summary_sport": (("group_value",), ORACLE["margin_summary_sport"])}),
    "r10_ticket_type": (lambda e: R.ticket_type(e, "SectionTypeTier", "Orders"), {
        "tier_share": (_MIX, order_share_sql("SectionTypeTier")), "quantity_share": (_MIX, order_share_sql("QuantityBucket")),
        "tier_orders": (_MIX, order_share_sql("SectionTypeTier")), "margin_box": (("group_value",), wrap_quantiles(box_sql("SectionTypeTier", TY))),
        "section_codes": (("section_type",), ORACLE["section_codes"]), "table": (("SectionTypeTier",), ORACLE["yoy_by_section_type_tier"])}),
    "r11_geography": (R.geography, {
        "range": (("metric",), ORACLE["state_shared_range"]), "this_year": (("state",), ORACLE["state_metric"]),
        "last_year": (("state",), ORACLE["state_metric"].replace(TY, LY)), "table": (("State",), ORACLE["state_yoy"])}),
    "r12_two_way_grids": (R.heatmap_hub, {
        "sport": (_CELL, _SPORT), "marketplace": (_CELL, _TIER), "teams": (_CELL, _TEAMS), "cross_tab": (("affiliate",), ORACLE["cross_tab"]),
        "teams_range": ((), range_sql(_TEAMS)), "shared_range": ((), _SHARED), "sport_intensity": ((*_CELL, "label"), intensity_sql(_SPORT, _SHARED)),
        "marketplace_intensity": ((*_CELL, "label"), intensity_sql(_TIER, _SHARED)), "teams_intensity": ((*_CELL, "label"), intensity_sql(_TEAMS, range_sql(_TEAMS)))}),
    "r13_time_patterns": (R.time_patterns, {
        "day_hour": (("day",), ORACLE["day_hour_grid"]), "lead_time": (("YearLabel",), ORACLE["hist_lead_time"]),
        "margin_box": (("group_value",), ORACLE["margin_box_lead"])}),
    "r14_top_events": (R.top_events, {
        "events": (_EVENT, ORACLE["event_rollup"]), "top": (_EVENT, ORACLE["top_events"]), "bottom": (_EVENT, ORACLE["bottom_events"])}),
    "r15_risk_delivery": (R.risk_delivery, {
        "kpis": ((), ORACLE["delivery_kpis"]), "undelivered": (("affiliate",), ORACLE["undelivered"]),
        "cancellations": (("affiliate",), ORACLE["cancellations"]), "delivery_rate": (("affiliate",), ORACLE["delivery_rate"])}),
    "r16_eda": (R.eda_pack, {
        "profile": (("sell_min", "sell_max", "event_min", "event_max"), ORACLE["profile_dates"]), "missing": (("column_name",), ORACLE["missingness"]),
        "distributions": (("column_name",), ORACLE["hist_clipped"]), "headline": (("metric",), ORACLE["headline"]),
        "monthly": (("year_month", "label"), ORACLE["monthly_trend"]), "affiliates": (("CompanyName",), ORACLE["yoy_by_affiliate"]),
        "winners": (("CompanyName",), ORACLE["winners"]), "losers": (("CompanyName",), ORACLE["losers"]), "pareto": (("affiliate",), ORACLE["pareto"]),
        "pareto_80": ((), ORACLE["pareto_80"]), "margin_by_dimension": (("dimension", "value"), ORACLE["margin_by_dimension"]),
        "lead_buckets": (("bucket",), ORACLE["lead_bucket_margin"]), "loss_profile": (("affiliate",), ORACLE["loss_profile"]),
        "loss_concentration": (("affiliate",), ORACLE["loss_concentration"]), "undelivered": (("affiliate",), ORACLE["undelivered"]),
        "order_size": (("stat",), ORACLE["order_size_shift"]), "mix_shift": (("sport",), ORACLE["mix_shift"]),
        "worst_pairs": (("affiliate", "sport"), ORACLE["worst_pairs"]),
        "export": (("CompanyName", "PrimaryPerformerName", "YEAR"), ORACLE["export_rollup"]), "export_total": ((), ORACLE["filtered_total"])}),
}


_MONEY = ("SaleTotal", "TicketCost", "Profit")
# Per page: the columns of the enriched mart that its operators read, with the year label. The page's cached load holds these
# alone. The EDA page looks at every column.
PAGE_COLUMNS: dict[str, tuple[str, ...]] = {
    "r1_executive_summary": (*_MONEY, "SellDate_dt", "CompanyName", "TicketsSold"),
    "r2_yoy_trends": (*_MONEY, "SellDate_dt", "State", "TicketsSold"),
    "r3_affiliate_performance": (*_MONEY, "SellDate_dt", "CompanyName", "ShippingCompany", "Sport", "TicketsSold"),
    "r4_affiliate_leaderboard": (*_MONEY, "CompanyName"),
    "r5_head_to_head": (*_MONEY, "CompanyName", "Sport", "TicketsSold"),
    "r6_sport_breakdown": (*_MONEY, "Sport", "TicketsSold"),
    "r7_team_performance": (*_MONEY, "CompanyName", "Sport", "TicketsSold", "HomeTeam"),
    "r8_marketplace": (*_MONEY, "ShippingCompany", "DeliveryType", "MarketplaceTier", "ProfitMargin"),
    "r9_margin_deep_dive": (*_MONEY, "InvoiceID", "CompanyName", "VenueName", "EventName", "ShippingCompany", "Sport", "TicketsSold", "ProfitMargin"),
    "r10_ticket_type": (*_MONEY, "InvoiceID", "Section_Type", "ProfitMargin", "SectionTypeTier", "QuantityBucket"),
    "r11_geography": (*_MONEY, "State"),
    "r12_two_way_grids": (*_MONEY, "CompanyName", "Sport", "MarketplaceTier", "HomeTeam"),
    "r13_time_patterns": (*_MONEY, "SellDate_dt", "SellDayOfWeek", "SellHour", "LeadTimeDays", "ProfitMargin", "LeadTimeBucket"),
    "r14_top_events": (*_MONEY, "InvoiceID", "EventDate_dt", "VenueName", "EventName", "TicketsSold"),
    "r15_risk_delivery": ("SaleTotal", "InvoiceID", "CompanyName", "IsDelivered", "IsCancelled", "IsExpired"),
}


def _page(name: str) -> Callable[[SparkSession, str], DataFrame]:
    call, frames = PAGE_FRAMES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return long_form(call(cached_mart(spark, sf_dir, columns=PAGE_COLUMNS.get(name))), {f: keys for f, (keys, _) in frames.items()})
    run.__name__ = f"q_page_{name}"
    run.__doc__ = f"{name.split('_')[0].upper()}{', F5' if name.startswith('r7_') else ''}: every frame of the page {name.split('_', 1)[1].replace('_', ' ')}."
    return run


PAGE_QUERIES = {f"page_{name}": _page(name) for name in PAGE_FRAMES}
PAGE_ORACLE = {f"page_{name}": long_sql(frames) for name, (_, frames) in PAGE_FRAMES.items()}
