"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each callable reads the star tables of ``sf_dir`` (through the sales mart), enriches
them and runs one operator of the library on the whole data.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..functions import enrich as E
from ..functions import labels as L
from ..functions import metrics as M
from ..operators import compare as C
from ..operators import distributions as D
from ..operators import profile as P
from ..operators import ranking as R
from ..operators import risk as K
from ..operators import grids as G
from ..operators import scope as S
from ..operators import shares as SH
from ..operators.components import HLL_LG_K, KLL_K, Store
from ..operators.joins import join_on
from ..operators.quantiles import _pin
from ..session import ensure_checkpoint_dir
from ..sources import csv as CSV
from ..sources import load_enriched
from ..sources.cache import cached_mart
from ..sources.dims import SPORTS
from ..sources.sinks import materialize, write_csv
from .text_export import TEXT_QUERIES

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str, year: str | None = None):
    """Register a query on the enriched mart; ``year`` names the only year label that it reads."""
    def deco(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        def on_enriched(e: DataFrame) -> DataFrame:
            return fn(e)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return on_enriched(load_enriched(spark, sf_dir, year, droppable=True))
        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        run.on_enriched = on_enriched  # type: ignore[attr-defined]
        QUERIES[name] = run
        return fn
    return deco


def _kept(e: DataFrame, *columns: str) -> DataFrame:
    """The named columns, written once and read back: what scans them twice does not join the mart twice."""
    return materialize(e.select(*columns), "columns", partition_by=None, cluster_by=())


# FIXED VALUES — the ten dimensions of the YoY page, with their query suffixes.
YOY_DIMENSIONS = {
    "affiliate": "CompanyName",
    "sport": "Sport",
    "shipping_company": "ShippingCompany",
    "marketplace_tier": "MarketplaceTier",
    "section_num_tier": "SectionNumTier",
    "section_type_tier": "SectionTypeTier",
    "quantity_bucket": "QuantityBucket",
    "delivery_type": "DeliveryType",
    "lead_time_bucket": "LeadTimeBucket",
    "state": "State",
}


def _register_yoy(suffix: str, col: str) -> None:
    def fn(e: DataFrame) -> DataFrame:
        return C.yoy_table(e, col)
    fn.__doc__ = f"A24: YoY table by {col}."
    query(f"yoy_by_{suffix}")(fn)


for _s, _c in YOY_DIMENSIONS.items():
    _register_yoy(_s, _c)


# --- comparisons (compare.py) --------------------------------------------------------

@query("kpi_block")
def _kpi_block(e: DataFrame) -> DataFrame:
    """A2: headline KPIs per year."""
    return C.kpi_block(e)


@query("kpi_deltas")
def _kpi_deltas(e: DataFrame) -> DataFrame:
    """A3: KPI row with YoY deltas."""
    return C.kpi_deltas(e)


@query("headline")
def _headline(e: DataFrame) -> DataFrame:
    """Headline table."""
    return C.headline(e)


@query("monthly_trend")
def _monthly_trend(e: DataFrame) -> DataFrame:
    """Monthly metrics, chronological."""
    return C.monthly_trend(e)


@query("monthly_kpi")
def _monthly_kpi(e: DataFrame) -> DataFrame:
    """Monthly KPI table with same-month-last-year revenue YoY."""
    return C.monthly_kpi(e)


@query("yoy_top_n")
def _yoy_top_n(e: DataFrame) -> DataFrame:
    """A5 + T2: revenue per affiliate and year for the 25 largest affiliates."""
    return C.yoy_compare(e, "CompanyName", "SaleTotal", top_n=25)


@query("state_yoy")
def _state_yoy(e: DataFrame) -> DataFrame:
    """State YoY table."""
    return C.state_yoy(e)


@query("leaderboard")
def _leaderboard(e: DataFrame) -> DataFrame:
    """Affiliate leaderboard."""
    return C.leaderboard(e)


@query("affiliate_yoy")
def _affiliate_yoy(e: DataFrame) -> DataFrame:
    """Five metrics by year for every affiliate."""
    return C.affiliate_yoy(e)


@query("affiliate_vs_portfolio")
def _affiliate_vs_portfolio(e: DataFrame) -> DataFrame:
    """Every affiliate against the per-affiliate portfolio average."""
    return C.affiliate_vs_portfolio(e)


@query("affiliate_vs_portfolio_per_order")
def _affiliate_vs_portfolio_per_order(e: DataFrame) -> DataFrame:
    """Every affiliate against the portfolio, per order."""
    return C.affiliate_vs_portfolio_per_order(e)


@query("head_to_head")
def _head_to_head(e: DataFrame) -> DataFrame:
    """Head-to-head of the two largest affiliates this year."""
    return C.head_to_head(e)


@query("order_size_shift")
def _order_size_shift(e: DataFrame) -> DataFrame:
    """Order-size mean / median / p90 shift."""
    return C.order_size_shift(_kept(e, "YearLabel", "SaleTotal"))


@query("mix_shift")
def _mix_shift(e: DataFrame) -> DataFrame:
    """Sport mix shift."""
    return C.mix_shift(e)


# --- enrichment checks ------------------------------------------------------------------

@query("enrich_sections")
def _enrich_sections(e: DataFrame) -> DataFrame:
    """Section digits / letters, seat fallback, number and type tiers, per distinct input."""
    return (e.groupBy("Section", "Seats", "Section_Num", "Section_Type", "SectionNumTier", "SectionTypeTier")
             .agg(F.count(F.lit(1)).alias("orders")))


@query("enrich_lead_time")
def _enrich_lead_time(e: DataFrame) -> DataFrame:
    """Lead-time days, bucket and fine bucket."""
    return (e.groupBy("LeadTimeDays", "LeadTimeBucket", E.fine_lead_bucket("LeadTimeDays").alias("fine_bucket"))
             .agg(F.count(F.lit(1)).alias("orders")))


@query("enrich_quantity")
def _enrich_quantity(e: DataFrame) -> DataFrame:
    """Quantity and its bucket."""
    return e.groupBy("Quantity", "QuantityBucket").agg(F.count(F.lit(1)).alias("orders"))


@query("enrich_calendar")
def _enrich_calendar(e: DataFrame) -> DataFrame:
    """Calendar attributes of sale and event."""
    return (e.groupBy("YearLabel", "YEAR", "SellMonth", "SellMonthName", "SellMonthNum", "SellDayOfWeek",
                      "SellHour", "EventMonth", "EventDayOfWeek")
             .agg(F.count(F.lit(1)).alias("orders")))


@query("enrich_flags")
def _enrich_flags(e: DataFrame) -> DataFrame:
    """Flags, profit sign and null margins per year label."""
    return (e.groupBy("YearLabel")
             .agg(F.count(F.lit(1)).alias("orders"),
                  F.count_if("IsDelivered").alias("delivered"),
                  F.count_if("IsCancelled").alias("cancelled"),
                  F.count_if("IsExpired").alias("expired"),
                  F.count_if(F.col("Profit") < 0).alias("loss_orders"),
                  F.count_if(F.col("ProfitMargin").isNull()).alias("null_margins")))


@query("lookup_dims")
def _lookup_dims(e: DataFrame) -> DataFrame:
    """Sport by type id, else by team, else Other; state by team; tier by marketplace."""
    return (e.groupBy("RequestedPerformerTypeId", "PrimaryPerformerName", "ShippingCompany", "Sport", "State",
                      "MarketplaceTier").agg(F.count(F.lit(1)).alias("orders")))


# --- scope ----------------------------------------------------------------------------------

@query("scope_counts")
def _scope_counts(e: DataFrame) -> DataFrame:
    """F2 + A57: counts for every affiliate choice with the four league sports selected."""
    return S.scope_counts(S.scope(e, sports=["MLB", "NBA", "NFL", "NHL"]))


@query("affiliate_list")
def _affiliate_list(e: DataFrame) -> DataFrame:
    """Affiliate picker values."""
    return S.affiliate_list(e)


@query("sport_list")
def _sport_list(e: DataFrame) -> DataFrame:
    """Sport picker values."""
    return S.distinct_values(e, "Sport")


@query("venue_rollup")
def _venue_rollup(e: DataFrame) -> DataFrame:
    """Generic group aggregate by venue: revenue sum, mean quantity, invoice count."""
    return C.group_agg(e, "VenueName", {"revenue": ("sum", "SaleTotal"), "avg_quantity": ("mean", "Quantity"),
                                        "orders": ("count", "InvoiceID")})


@query("share_revenue", E.THIS_YEAR)
def _share_revenue(e: DataFrame) -> DataFrame:
    """This-year revenue share by sport."""
    return SH.share_by(S.split_years(e)[0], "Sport", "SaleTotal")


@query("share_profit", E.THIS_YEAR)
def _share_profit(e: DataFrame) -> DataFrame:
    """This-year profit share by marketplace tier."""
    return SH.share_by(S.split_years(e)[0], "MarketplaceTier", "Profit")


@query("share_orders", E.THIS_YEAR)
def _share_orders(e: DataFrame) -> DataFrame:
    """This-year order share by sport."""
    return SH.order_share_by(S.split_years(e)[0], "Sport")


# --- grids ------------------------------------------------------------------------------------

def _ty(e: DataFrame) -> DataFrame:
    return S.split_years(e)[0]


@query("grid_affiliate_sport", E.THIS_YEAR)
def _grid_affiliate_sport(e: DataFrame) -> DataFrame:
    """This-year revenue, affiliate x sport."""
    return G.heatmap_grid(_ty(e), "CompanyName", "Sport", "SaleTotal")


@query("grid_affiliate_tier", E.THIS_YEAR)
def _grid_affiliate_tier(e: DataFrame) -> DataFrame:
    """This-year revenue, affiliate x marketplace tier."""
    return G.heatmap_grid(_ty(e), "CompanyName", "MarketplaceTier", "SaleTotal")


@query("grid_top_teams", E.THIS_YEAR)
def _grid_top_teams(e: DataFrame) -> DataFrame:
    """A13 + T3: this-year revenue, affiliate x the 15 largest home teams."""
    return G.heatmap_grid(_ty(e), "CompanyName", "HomeTeam", "SaleTotal", top_cols=15)


@query("grid_top_rows_cols", E.THIS_YEAR)
def _grid_top_rows_cols(e: DataFrame) -> DataFrame:
    """A13 + T3: this-year profit, the 25 largest affiliates x the 15 largest home teams."""
    return G.heatmap_grid(_ty(e), "CompanyName", "HomeTeam", "Profit", top_rows=25, top_cols=15)


def _grid_base(e: DataFrame) -> DataFrame:
    """This-year sums by affiliate, sport and tier, pinned: both grids' cells come from this one scan."""
    sums = [M.dsum(c).alias(c) for c in ("SaleTotal", "Profit", "TicketCost")]
    return _pin(_ty(e).groupBy("CompanyName", "Sport", "MarketplaceTier").agg(*sums))


def _shared(base: DataFrame) -> DataFrame:
    return G.shared_range([G.grid_cells(base, "CompanyName", "Sport", "SaleTotal"),
                           G.grid_cells(base, "CompanyName", "MarketplaceTier", "SaleTotal")])


@query("grid_shared_range", E.THIS_YEAR)
def _grid_shared_range(e: DataFrame) -> DataFrame:
    """Shared colour range of the affiliate x sport and affiliate x tier revenue grids."""
    return _shared(_grid_base(e))


@query("grid_intensity", E.THIS_YEAR)
def _grid_intensity(e: DataFrame) -> DataFrame:
    """Colour position and labels of the affiliate x sport revenue grid on the shared range."""
    base = _grid_base(e)
    zmax = _shared(base).select("zmax").scalar()
    return G.intensity(G.grid_cells(base, "CompanyName", "Sport", "SaleTotal"), zmax, "SaleTotal")


@query("day_hour_grid")
def _day_hour_grid(e: DataFrame) -> DataFrame:
    """Dense day x hour grid of every metric."""
    return G.day_hour_grid(e)


@query("time_pivot")
def _time_pivot(e: DataFrame) -> DataFrame:
    """Day x hour revenue, rounded."""
    return G.time_pivot(e)


@query("state_metric", E.THIS_YEAR)
def _state_metric(e: DataFrame) -> DataFrame:
    """This-year metrics per state."""
    return G.state_metric(_ty(e))


@query("state_shared_range")
def _state_shared_range(e: DataFrame) -> DataFrame:
    """Shared state map range over both years."""
    return G.state_shared_range(e)


@query("cross_tab", E.THIS_YEAR)
def _cross_tab(e: DataFrame) -> DataFrame:
    """Affiliate x sport revenue and margin cross-tab (this year)."""
    return G.cross_tab(_ty(e))


# --- distributions ------------------------------------------------------------------------

@query("hist_margin")
def _hist_margin(e: DataFrame) -> DataFrame:
    """Row-margin histogram per year, 50 bins."""
    return D.margin_histogram(_kept(e, "YearLabel", "ProfitMargin"))


@query("hist_lead_time")
def _hist_lead_time(e: DataFrame) -> DataFrame:
    """Lead-time histogram per year, -30..365 days, 60 bins."""
    return D.lead_time_histogram(e)


@query("hist_order_size")
def _hist_order_size(e: DataFrame) -> DataFrame:
    """A10 + F8: order-size histogram below the 99th percentile, 50 bins."""
    return D.order_size_histogram(_kept(e, "YearLabel", "SaleTotal"))


@query("hist_clipped")
def _hist_clipped(e: DataFrame) -> DataFrame:
    """Clipped revenue / cost / profit histograms, 60 bins."""
    return D.clipped_histograms(_kept(e, "SaleTotal", "TicketCost", "Profit"))


@query("margin_box", E.THIS_YEAR)
def _margin_box(e: DataFrame) -> DataFrame:
    """This-year row-margin five-number summary by sport."""
    return D.margin_box(_kept(_ty(e), "Sport", "ProfitMargin"), "Sport")


@query("margin_box_lead", E.THIS_YEAR)
def _margin_box_lead(e: DataFrame) -> DataFrame:
    """This-year row-margin five-number summary by lead-time bucket."""
    return D.margin_box(_kept(_ty(e), "LeadTimeBucket", "ProfitMargin"), "LeadTimeBucket")


@query("margin_summary", E.THIS_YEAR)
def _margin_summary(e: DataFrame) -> DataFrame:
    """This-year margin summary by affiliate."""
    return D.margin_summary(_kept(_ty(e), "CompanyName", "SaleTotal", "Profit", "ProfitMargin"), "CompanyName")


@query("margin_summary_sport", E.THIS_YEAR)
def _margin_summary_sport(e: DataFrame) -> DataFrame:
    """This-year margin summary by sport."""
    return D.margin_summary(_kept(_ty(e), "Sport", "SaleTotal", "Profit", "ProfitMargin"), "Sport")


@query("lead_bucket_margin", E.THIS_YEAR)
def _lead_bucket_margin(e: DataFrame) -> DataFrame:
    """This-year margin profile by fine lead-time bucket."""
    return D.lead_bucket_margin(_kept(_ty(e), "LeadTimeDays", "SaleTotal", "Profit", "ProfitMargin"))


YOY_VALUE_COLUMNS = ("revenue_ty", "revenue_ly", "profit_ty", "profit_ly", "margin_ty", "margin_ly",
                     "ratio_ty", "ratio_ly", "orders_ty", "orders_ly")
YOY_PCT_COLUMNS = ("revenue_yoy_pct", "profit_yoy_pct")


@query("robust_ranges")
def _robust_ranges(e: DataFrame) -> DataFrame:
    """Colour ranges of the affiliate YoY table's value columns."""
    return D.robust_ranges(C.yoy_table(e, "CompanyName"), YOY_VALUE_COLUMNS)


@query("diverging_bounds")
def _diverging_bounds(e: DataFrame) -> DataFrame:
    """Diverging bounds of the affiliate YoY table's percent-change columns."""
    return D.diverging_bounds(C.yoy_table(e, "CompanyName"), YOY_PCT_COLUMNS)


@query("scatter_frame", E.THIS_YEAR)
def _scatter_frame(e: DataFrame) -> DataFrame:
    """R9 scatter: this-year orders with positive cost and revenue, plus the break-even bound."""
    return D.scatter_frame(_ty(e))


@query("scatter_sample")
def _scatter_sample(e: DataFrame) -> DataFrame:
    """5000 orders, drawn by order key, with the break-even side."""
    return D.scatter_sample(e)


@query("scatter_sample_by_sport")
def _scatter_sample_by_sport(e: DataFrame) -> DataFrame:
    """200 orders of each sport, drawn by order key."""
    return D.scatter_sample(e, 200, "Sport")


# --- rankings -------------------------------------------------------------------------------

@query("team_breakdown")
def _team_breakdown(e: DataFrame) -> DataFrame:
    """This-year team breakdown with mode sport and best / worst affiliate."""
    return R.team_breakdown(e)


@query("event_rollup")
def _event_rollup(e: DataFrame) -> DataFrame:
    """Per-event rollup over every order."""
    return R.event_rollup(e)


@query("top_events")
def _top_events(e: DataFrame) -> DataFrame:
    """T4: the 20 most profitable events."""
    return R.top_events(e, 20, "Profit")


@query("top_events_by_margin")
def _top_events_by_margin(e: DataFrame) -> DataFrame:
    """T4: the 20 events with the highest margin."""
    return R.top_events(e, 20, "Margin")


@query("bottom_events")
def _bottom_events(e: DataFrame) -> DataFrame:
    """T4: the 15 least profitable events."""
    return R.bottom_events(e, 15)


@query("worst_loss_orders")
def _worst_loss_orders(e: DataFrame) -> DataFrame:
    """The 20 worst loss orders."""
    return R.worst_loss_orders(e, 20)


@query("pareto")
def _pareto(e: DataFrame) -> DataFrame:
    """W1 + W2: affiliate revenue concentration."""
    return R.pareto(e)


@query("pareto_80")
def _pareto_80(e: DataFrame) -> DataFrame:
    """Affiliates needed for 80 % of revenue."""
    return R.pareto_80(e)


@query("winners")
def _winners(e: DataFrame) -> DataFrame:
    """10 largest revenue YoY % (last-year base over 1000)."""
    return R.winners_losers(e, best=True)


@query("losers")
def _losers(e: DataFrame) -> DataFrame:
    """10 smallest revenue YoY % (last-year base over 1000)."""
    return R.winners_losers(e, best=False)


@query("loss_concentration")
def _loss_concentration(e: DataFrame) -> DataFrame:
    """Loss concentration in the five largest loss affiliates."""
    return R.loss_concentration(e)


@query("worst_pairs")
def _worst_pairs(e: DataFrame) -> DataFrame:
    """Ten lowest-margin material affiliate x sport pairs."""
    return R.worst_pairs(e)


@query("margin_by_dimension", E.THIS_YEAR)
def _margin_by_dimension(e: DataFrame) -> DataFrame:
    """This-year margin by four dimensions in one grouping-sets aggregation."""
    return R.margin_by_dimension(_ty(e))


@query("section_codes", E.THIS_YEAR)
def _section_codes(e: DataFrame) -> DataFrame:
    """This-year section letter codes."""
    return R.section_codes(_ty(e))


# --- risk -----------------------------------------------------------------------------------

@query("delivery_kpis", E.THIS_YEAR)
def _delivery_kpis(e: DataFrame) -> DataFrame:
    """This-year delivery KPIs."""
    return K.delivery_kpis(_ty(e))


@query("undelivered", E.THIS_YEAR)
def _undelivered(e: DataFrame) -> DataFrame:
    """This-year undelivered orders by affiliate."""
    return K.undelivered_by_affiliate(_ty(e))


@query("cancellations", E.LAST_YEAR)
def _cancellations(e: DataFrame) -> DataFrame:
    """Last-year cancellations by affiliate."""
    return K.cancellations_by_affiliate(S.split_years(e)[1])


@query("delivery_rate", E.THIS_YEAR)
def _delivery_rate(e: DataFrame) -> DataFrame:
    """This-year delivery rate by affiliate."""
    return K.delivery_rate_by_affiliate(_ty(e))


@query("loss_profile")
def _loss_profile(e: DataFrame) -> DataFrame:
    """Loss profile of affiliates with at least 50 orders."""
    return K.loss_profile(_kept(e, "CompanyName", "Profit"))


# --- profile --------------------------------------------------------------------------------

@query("profile_dates")
def _profile_dates(e: DataFrame) -> DataFrame:
    """Dataset profile."""
    return P.profile_dates(e)


@query("missingness")
def _missingness(e: DataFrame) -> DataFrame:
    """Missing values per column."""
    return P.missingness(e)


@query("export_rollup")
def _export_rollup(e: DataFrame) -> DataFrame:
    """Multi-key export rollup."""
    return P.export_rollup(e)


@query("filtered_total")
def _filtered_total(e: DataFrame) -> DataFrame:
    """Last-year revenue of the export rollup."""
    return P.filtered_total(e)


# --- labels ----------------------------------------------------------------------------------

@query("labels")
def _labels(e: DataFrame) -> DataFrame:
    """Display labels of the monthly KPI table."""
    m = C.monthly_kpi(e)
    return m.select("year_month", L.month_label(F.to_timestamp_ntz(F.concat("year_month", F.lit("-01")))).alias("month_label"),
                    L.money("revenue").alias("revenue_text"), L.compact_money("profit").alias("profit_compact"),
                    L.pct("margin").alias("margin_text"), L.pct("revenue_yoy_pct", signed=True).alias("yoy_text"),
                    L.integer("orders").alias("orders_text"))


# --- choices a caller makes -----------------------------------------------------------------

@query("share_delivery", E.THIS_YEAR)
def _share_delivery(e: DataFrame) -> DataFrame:
    """This-year revenue by delivery type."""
    return SH.share_by(_ty(e), "DeliveryType", "SaleTotal")


@query("share_home_team", E.THIS_YEAR)
def _share_home_team(e: DataFrame) -> DataFrame:
    """This-year revenue by home team (any number of categories)."""
    return SH.share_by(_ty(e), "HomeTeam", "SaleTotal")


@query("yoy_by_affiliate_top")
def _yoy_by_affiliate_top(e: DataFrame) -> DataFrame:
    """The first ten rows of the affiliate YoY table."""
    return C.yoy_table(e, "CompanyName", top_n=10)


@query("yoy_scoped")
def _yoy_scoped(e: DataFrame) -> DataFrame:
    """YoY table by sport of one affiliate."""
    return C.yoy_table(S.scope(e, "Supplier#000000001"), "Sport")


@query("yoy_pair")
def _yoy_pair(e: DataFrame) -> DataFrame:
    """YoY table of a pair of affiliates."""
    return C.yoy_table(S.pair(e, "Supplier#000000001", "Supplier#000000002"), "CompanyName")


@query("yoy_bars_margin")
def _yoy_bars_margin(e: DataFrame) -> DataFrame:
    """A1, A5: margin by sport and year."""
    return C.yoy_compare(e, "Sport", "Margin")


@query("yoy_bars_ratio")
def _yoy_bars_ratio(e: DataFrame) -> DataFrame:
    """A1, A5: profit over cost by sport and year."""
    return C.yoy_compare(e, "Sport", "Ratio")


@query("yoy_bars_orders")
def _yoy_bars_orders(e: DataFrame) -> DataFrame:
    """A1, A5: orders by sport and year."""
    return C.yoy_compare(e, "Sport", "Orders")


@query("count_losses")
def _count_losses(e: DataFrame) -> DataFrame:
    """Cancelled orders at a loss."""
    return C.count_where(e, (F.col("Profit") < 0) & F.col("IsCancelled"))


@query("positions")
def _positions(e: DataFrame) -> DataFrame:
    """Gradient and diverging positions, clipped and rounded values by sport."""
    g = e.groupBy("Sport").agg(M.metric_agg("Margin").alias("margin"), M.metric_agg("SaleTotal").alias("revenue"))
    low, high, bound = F.lit(-50.0), F.lit(100.0), F.lit(200.0)
    out = g.select("Sport", L.gradient_position("margin", low, high).alias("margin_position"),
                   L.gradient_position("margin", low, high, low_is_good=True).alias("inverted_position"),
                   L.diverging_position("margin", bound).alias("diverging_position"),
                   L.clip("margin", F.lit(-10.0), F.lit(10.0)).alias("clipped"), "revenue", "margin")
    return L.round_table(out, money=["revenue"], pct=["margin"])


@query("grid_max_range", E.THIS_YEAR)
def _grid_max_range(e: DataFrame) -> DataFrame:
    """Colour range from the largest absolute cell of the affiliate x sport grid."""
    return G.max_abs_range([G.grid_cells(_ty(e), "CompanyName", "Sport", "Profit")])


@query("grid_margin_cells", E.THIS_YEAR)
def _grid_margin_cells(e: DataFrame) -> DataFrame:
    """Margin by affiliate and sport, with intensity and labels over its own range."""
    cells = _pin(G.grid_cells(_ty(e), "CompanyName", "Sport", "Margin").select("row_label", "col_label", "value"))
    zmax = G.shared_range([cells]).select("zmax").scalar()
    return G.intensity(cells, zmax, "Margin").select("row_label", "col_label", "value", "intensity", "labeled", "label")


@query("day_hour_intensity", E.THIS_YEAR)
def _day_hour_intensity(e: DataFrame) -> DataFrame:
    """The day x hour grid's revenue over its own largest cell, labels from 4%."""
    grid = G.day_hour_grid(_ty(e)).select(F.col("day").alias("row_label"), F.col("hour").cast("string").alias("col_label"),
                                          F.col("revenue").alias("value"))
    zmax = grid.agg(F.max(F.abs("value")).alias("m")).select("m").scalar()
    return G.intensity(grid, zmax, "SaleTotal", label_share=0.04).select("row_label", "col_label", "value", "intensity", "labeled")


@query("yoy_all_dimensions")
def _yoy_all_dimensions(e: DataFrame) -> DataFrame:
    """The YoY tables of all ten dimensions from one scan."""
    return C.yoy_tables(e, YOY_DIMENSIONS)


@query("yoy_all_top")
def _yoy_all_top(e: DataFrame) -> DataFrame:
    """The first 25 rows of the YoY table of each of the ten dimensions."""
    return C.yoy_tables(e, YOY_DIMENSIONS, top_n=25)


# --- cached load and the store of components ------------------------------------------------

def _cached_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YoY table by sport from the cached mart, loaded a second time from the cache."""
    cached_mart(spark, sf_dir)
    return C.yoy_table(cached_mart(spark, sf_dir), "Sport")


QUERIES["cached_yoy"] = _cached_yoy
STORE_DIMENSIONS = ("CompanyName", "Sport", "MarketplaceTier", "State")


# The columns that a store is made of.
STORE_COLUMNS = ("SellMonth", "YearLabel", "SaleTotal", "Profit", "TicketCost", "TicketsSold", "InvoiceID", "ProfitMargin", *STORE_DIMENSIONS)


def _store(rows: DataFrame) -> Store:
    """A store first filled with a wrong month (its orders twice), which its right rows then replace."""
    spark = rows.sparkSession
    store = Store(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/marginmart-store-{uuid.uuid4().hex}", STORE_DIMENSIONS)
    store.replace(rows.unionByName(rows.where(F.col("SellMonth") == "1997-03")))
    store.replace(rows, ["1997-03"])
    return store


@query("store_yoy_affiliate")
def _store_yoy_affiliate(e: DataFrame) -> DataFrame:
    """YoY table by affiliate from the store of monthly components, one month replaced."""
    return _store(_kept(e, *STORE_COLUMNS)).yoy_table("CompanyName")


@query("store_kpi_deltas")
def _store_kpi_deltas(e: DataFrame) -> DataFrame:
    """KPIs from the store of monthly components, one month replaced."""
    return _store(_kept(e, *STORE_COLUMNS)).kpi_deltas()


@query("store_yoy_bars")
def _store_yoy_bars(e: DataFrame) -> DataFrame:
    """Margin by sport and year from the store of monthly components, one month replaced."""
    return _store(_kept(e, *STORE_COLUMNS)).yoy_compare("Sport", "Margin")


@query("store_monthly")
def _store_monthly(e: DataFrame) -> DataFrame:
    """The months from the store of monthly components, one month replaced."""
    return _store(_kept(e, *STORE_COLUMNS)).monthly()


@query("store_margin_sketch")
def _store_margin_sketch(e: DataFrame) -> DataFrame:
    """Median row margin by sport from merged sketches; whether its rank in the data is within the sketch's bound of a half."""
    rows = _kept(e, *STORE_COLUMNS)
    sketch = _store(rows).margin_quantiles("Sport", [0.5])
    ranked = join_on(rows.where(F.col("ProfitMargin").isNotNull()).select(F.col("Sport").alias("value"), "ProfitMargin"), sketch, ["value"], broadcast=True)
    g = ranked.groupBy("value", "n").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("ProfitMargin") < F.col("p50")).alias("less"),
                                         F.count_if(F.col("ProfitMargin") <= F.col("p50")).alias("upto"))
    bound = 2.3 / KLL_K ** 0.9
    inside = (F.col("less") / F.col("rows") <= 0.5 + bound) & (F.col("upto") / F.col("rows") >= 0.5 - bound)
    return g.select(F.col("value").alias("sport"), "n", "rows", inside.alias("within_bound"))


@query("store_invoice_sketch")
def _store_invoice_sketch(e: DataFrame) -> DataFrame:
    """Invoices by sport from united sketches; whether they are within four standard errors of the exact count."""
    rows = _kept(e, *STORE_COLUMNS)
    sketch = _store(rows).distinct_invoices("Sport")
    exact = rows.groupBy(F.col("Sport").alias("value")).agg(F.count_distinct("InvoiceID").alias("invoices_exact"))
    both = join_on(exact, sketch, ["value"])
    error = F.abs(F.col("invoices") - F.col("invoices_exact")) / F.col("invoices_exact")
    return both.select(F.col("value").alias("sport"), "invoices_exact", (error <= 4 * 1.04 / 2 ** (HLL_LG_K / 2)).alias("within_bound"))


# --- tables at the edge ----------------------------------------------------------------------

@query("sorted_table")
def _sorted_table(e: DataFrame) -> DataFrame:
    """The five affiliates with the least revenue growth (missing growth last)."""
    return R.sort_table(C.yoy_table(e, "CompanyName"), "revenue_yoy_pct", descending=False).limit(5)


@query("wide_grid", E.THIS_YEAR)
def _wide_grid(e: DataFrame) -> DataFrame:
    """This-year revenue by affiliate, a column per sport, zero filled."""
    return G.pivot_wide(G.grid_cells(_ty(e), "CompanyName", "Sport", "SaleTotal"), SPORTS)


@query("month_key_text")
def _month_key_text(e: DataFrame) -> DataFrame:
    """Orders by the month key of the sale date's text."""
    text = F.date_format("SellDate_dt", "yyyy-MM-dd HH:mm:ss")
    return e.select(L.month_key_text(text).alias("month_key")).groupBy("month_key").agg(F.count(F.lit(1)).alias("orders"))


@query("csv_sink")
def _csv_sink(e: DataFrame) -> DataFrame:
    """The YoY table by sport written as CSV and read back by name."""
    table = C.yoy_table(e, "Sport")
    path = f"{ensure_checkpoint_dir(e.sparkSession).rstrip('/')}/marginmart-csv-{uuid.uuid4().hex}"
    write_csv(table, path)
    back = CSV.read_raw(e.sparkSession, path)
    return back.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields])


for _name, _fn in TEXT_QUERIES.items():
    QUERIES[_name] = _fn
