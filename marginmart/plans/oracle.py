"""DuckDB oracle SQL per registered query (same names as the catalog)."""

from __future__ import annotations

from .catalog import YOY_DIMENSIONS
from .oracle_base import LY, TY, dbl, dsum, gpct, with_enriched

ORACLE: dict[str, str] = {}


def yoy_table_sql(group: str, include_ratio: bool = True, where: str = "TRUE") -> str:
    return with_enriched(yoy_table_body(group, include_ratio, where))


def yoy_table_body(group: str, include_ratio: bool = True, where: str = "TRUE") -> str:
    ratio = (f", {gpct(dsum('Profit', TY), dsum('TicketCost', TY))} AS ratio_ty,"
             f" {gpct(dsum('Profit', LY), dsum('TicketCost', LY))} AS ratio_ly") if include_ratio else ""
    return (f"""
SELECT {group},
  {dbl(dsum('SaleTotal', TY))} AS revenue_ty,
  {dbl(dsum('SaleTotal', LY))} AS revenue_ly,
  CASE WHEN {dsum('SaleTotal', LY)} > 0 THEN ({dbl(dsum('SaleTotal', TY))} - {dbl(dsum('SaleTotal', LY))})
       / {dbl(dsum('SaleTotal', LY))} * 100 END AS revenue_yoy_pct,
  {dbl(dsum('Profit', TY))} AS profit_ty,
  {dbl(dsum('Profit', LY))} AS profit_ly,
  CASE WHEN {dsum('Profit', LY)} <> 0 THEN ({dbl(dsum('Profit', TY))} - {dbl(dsum('Profit', LY))})
       / abs({dbl(dsum('Profit', LY))}) * 100 END AS profit_yoy_pct,
  {gpct(dsum('Profit', TY), dsum('SaleTotal', TY))} AS margin_ty,
  {gpct(dsum('Profit', LY), dsum('SaleTotal', LY))} AS margin_ly{ratio},
  count_if({TY}) AS orders_ty,
  count_if({LY}) AS orders_ly
FROM e WHERE {group} IS NOT NULL AND {where}
GROUP BY {group}""")


for _s, _c in YOY_DIMENSIONS.items():
    ORACLE[f"yoy_by_{_s}"] = yoy_table_sql(_c)


def yoy(t: str, l: str) -> str:
    return (f"CASE WHEN ({l}) IS NOT NULL AND ({l}) <> 0 THEN "
            f"(CAST({t} AS DOUBLE) - CAST({l} AS DOUBLE)) / abs(CAST({l} AS DOUBLE)) * 100 END")


def _kpi_cte() -> str:
    parts = []
    for cond, s in ((TY, "_ty"), (LY, "_ly")):
        parts += [f"{dsum('SaleTotal', cond)} AS rev{s}", f"{dsum('Profit', cond)} AS prof{s}",
                  f"CAST(coalesce(sum(CASE WHEN {cond} THEN CAST(TicketsSold AS BIGINT) END), 0) AS BIGINT) AS tickets{s}",
                  f"count_if({cond}) AS orders{s}", f"count_if({cond} AND Profit < 0) AS loss{s}"]
    return "k AS (SELECT " + ", ".join(parts) + " FROM e)"


def _kv(s: str) -> dict[str, str]:
    return {
        "revenue": f"CAST(rev{s} AS DOUBLE)",
        "profit": f"CAST(prof{s} AS DOUBLE)",
        "margin": gpct(f"prof{s}", f"rev{s}"),
        "tickets": f"tickets{s}",
        "orders": f"orders{s}",
        "avg_order": f"CASE WHEN orders{s} > 0 THEN CAST(rev{s} AS DOUBLE) / orders{s} ELSE 0.0 END",
        "loss_orders": f"loss{s}",
        "loss_share": f"CASE WHEN orders{s} > 0 THEN loss{s} / orders{s} * 100 ELSE 0.0 END",
    }


KPI_NAMES = ("revenue", "profit", "margin", "tickets", "orders", "avg_order", "loss_orders", "loss_share")
ORACLE["kpi_block"] = with_enriched(
    " UNION ALL ".join(
        "SELECT '" + lab + "' AS year_label, " + ", ".join(f"{_kv(s)[k]} AS {k}" for k in KPI_NAMES) + " FROM k"
        for lab, s in (("This Year", "_ty"), ("Last Year", "_ly"))),
    _kpi_cte())

_t, _l = _kv("_ty"), _kv("_ly")
ORACLE["kpi_deltas"] = with_enriched(
    "SELECT " + ", ".join(
        f"{_t[k]} AS {k}_ty, {_l[k]} AS {k}_ly, {yoy(_t[k], _l[k])} AS {k}_yoy_pct"
        for k in ("revenue", "profit", "orders", "tickets"))
    + f", {_t['margin']} AS margin_ty, {_l['margin']} AS margin_ly, ({_t['margin']}) - ({_l['margin']}) AS margin_delta_pts FROM k",
    _kpi_cte())

ORACLE["headline"] = with_enriched(
    " UNION ALL ".join(
        f"SELECT {pos} AS position, '{name}' AS metric, CAST({_l[key]} AS DOUBLE) AS last_year, "
        f"CAST({_t[key]} AS DOUBLE) AS this_year, "
        + (f"CAST({_t[key]} AS DOUBLE) - CAST({_l[key]} AS DOUBLE)" if key == "margin"
           else yoy(f"CAST({_t[key]} AS DOUBLE)", f"CAST({_l[key]} AS DOUBLE)"))
        + " AS yoy_pct FROM k"
        for pos, (name, key) in enumerate((("Revenue", "revenue"), ("Profit", "profit"), ("Margin %", "margin"),
                                           ("Orders", "orders"), ("Tickets Sold", "tickets")))),
    _kpi_cte())

_MONTHS = f"""m AS (SELECT date_trunc('month', SellDate_dt) AS month_start,
  {dsum('SaleTotal')} AS rev, {dsum('Profit')} AS prof, {dsum('TicketCost')} AS cost, count(*) AS orders
  FROM eall WHERE SellDate_dt IS NOT NULL GROUP BY 1)"""
ORACLE["monthly_trend"] = with_enriched(f"""
SELECT strftime(month_start, '%Y-%m') AS year_month, strftime(month_start, '%b %y') AS label,
  CAST(rev AS DOUBLE) AS revenue, CAST(prof AS DOUBLE) AS profit, CAST(cost AS DOUBLE) AS cost, orders,
  {gpct('prof', 'rev')} AS margin, {gpct('prof', 'cost')} AS ratio
FROM m""", _MONTHS)

ORACLE["monthly_kpi"] = with_enriched(f"""
SELECT strftime(m.month_start, '%Y-%m') AS year_month, strftime(m.month_start, '%b %y') AS month,
  CAST(m.rev AS DOUBLE) AS revenue, CAST(m.prof AS DOUBLE) AS profit,
  {gpct('m.prof', 'm.rev')} AS margin, {gpct('m.prof', 'm.cost')} AS ratio, m.orders,
  CASE WHEN p.rev > 0 THEN (CAST(m.rev AS DOUBLE) - CAST(p.rev AS DOUBLE)) / CAST(p.rev AS DOUBLE) * 100 END AS revenue_yoy_pct
FROM mi m LEFT JOIN mi p ON p.idx = m.idx - 12""",
    _MONTHS, "mi AS (SELECT *, year(month_start) * 12 + month(month_start) AS idx FROM m)")

ORACLE["yoy_top_n"] = with_enriched(f"""
SELECT grp AS group_value, 'Last Year' AS year_label, v_ly AS value FROM t
UNION ALL SELECT grp, 'This Year', v_ty FROM t""",
    f"""g AS (SELECT CompanyName AS grp, CAST({dsum('SaleTotal', TY)} AS DOUBLE) AS v_ty,
       CAST({dsum('SaleTotal', LY)} AS DOUBLE) AS v_ly FROM e WHERE CompanyName IS NOT NULL GROUP BY 1)""",
    "t AS (SELECT * FROM g ORDER BY abs(v_ty) + abs(v_ly) DESC, grp LIMIT 25)")

ORACLE["state_yoy"] = yoy_table_sql("State", include_ratio=False)

_COMP = (f"{dsum('SaleTotal', TY)} AS rev_ty, {dsum('SaleTotal', LY)} AS rev_ly, "
         f"{dsum('Profit', TY)} AS prof_ty, {dsum('Profit', LY)} AS prof_ly, "
         f"{dsum('TicketCost', TY)} AS cost_ty, {dsum('TicketCost', LY)} AS cost_ly, "
         f"count_if({TY}) AS orders_ty, count_if({LY}) AS orders_ly")
ORACLE["leaderboard"] = with_enriched("""
SELECT CompanyName AS affiliate, CAST(rev_ty AS DOUBLE) AS revenue_this, CAST(rev_ly AS DOUBLE) AS revenue_last,
  CASE WHEN rev_ly <> 0 THEN (CAST(rev_ty AS DOUBLE) - CAST(rev_ly AS DOUBLE)) / CAST(rev_ly AS DOUBLE) * 100 END AS revenue_yoy_pct,
  CAST(prof_ty AS DOUBLE) AS profit_this, CAST(prof_ly AS DOUBLE) AS profit_last,
  CASE WHEN rev_ty <> 0 THEN CAST(prof_ty AS DOUBLE) / CAST(rev_ty AS DOUBLE) * 100 ELSE 0.0 END AS margin_this,
  CASE WHEN rev_ly <> 0 THEN CAST(prof_ly AS DOUBLE) / CAST(rev_ly AS DOUBLE) * 100 ELSE 0.0 END AS margin_last,
  orders_ty AS orders_this, orders_ly AS orders_last
FROM g""", f"g AS (SELECT CompanyName, {_COMP} FROM e WHERE CompanyName IS NOT NULL GROUP BY 1)")

_ay = []
for _lab, _s in (("This Year", "_ty"), ("Last Year", "_ly")):
    for _m, _v in (("Revenue", f"CAST(rev{_s} AS DOUBLE)"), ("Profit", f"CAST(prof{_s} AS DOUBLE)"),
                   ("Margin %", gpct(f"prof{_s}", f"rev{_s}")), ("P/Cost Ratio %", gpct(f"prof{_s}", f"cost{_s}")),
                   ("Orders", f"CAST(orders{_s} AS DOUBLE)")):
        _ay.append(f"SELECT CompanyName AS affiliate, '{_m}' AS metric, '{_lab}' AS year_label, {_v} AS value FROM g")
ORACLE["affiliate_yoy"] = with_enriched(" UNION ALL ".join(_ay),
                                        f"g AS (SELECT CompanyName, {_COMP} FROM e WHERE CompanyName IS NOT NULL GROUP BY 1)")

_avp = [("Revenue", "CAST(a.rev AS DOUBLE)", "CAST(p.rev AS DOUBLE) / greatest(p.n_aff, 1)"),
        ("Profit", "CAST(a.prof AS DOUBLE)", "CAST(p.prof AS DOUBLE) / greatest(p.n_aff, 1)"),
        ("Avg Order", "CASE WHEN a.n > 0 THEN CAST(a.rev AS DOUBLE) / a.n ELSE 0.0 END",
         "CASE WHEN p.n > 0 THEN CAST(p.rev AS DOUBLE) / p.n END"),
        ("Margin %", gpct("a.prof", "a.rev"), gpct("p.prof", "p.rev"))]
ORACLE["affiliate_vs_portfolio"] = with_enriched(
    " UNION ALL ".join(f"SELECT a.CompanyName AS affiliate, '{m}' AS metric, {x} AS affiliate_value, "
                       f"{y} AS portfolio_value FROM a CROSS JOIN p" for m, x, y in _avp),
    f"p AS (SELECT {dsum('SaleTotal')} AS rev, {dsum('Profit')} AS prof, count(*) AS n, "
    f"count(DISTINCT CompanyName) AS n_aff FROM e WHERE {TY})",
    f"a AS (SELECT CompanyName, {dsum('SaleTotal')} AS rev, {dsum('Profit')} AS prof, count(*) AS n "
    f"FROM e WHERE {TY} AND CompanyName IS NOT NULL GROUP BY 1)")

_avpo = [("Avg Revenue", "CAST(a.rev AS DOUBLE) / a.n", "CASE WHEN p.n > 0 THEN CAST(p.rev AS DOUBLE) / p.n END"),
         ("Avg Profit", "CAST(a.prof AS DOUBLE) / a.n", "CASE WHEN p.n > 0 THEN CAST(p.prof AS DOUBLE) / p.n END"),
         ("Margin %", gpct("a.prof", "a.rev"), gpct("p.prof", "p.rev")),
         ("P/Cost Ratio %", gpct("a.prof", "a.cost"), gpct("p.prof", "p.cost"))]
ORACLE["affiliate_vs_portfolio_per_order"] = with_enriched(
    " UNION ALL ".join(f"SELECT a.CompanyName AS affiliate, '{m}' AS metric, {x} AS affiliate_value, "
                       f"{y} AS portfolio_value FROM a CROSS JOIN p" for m, x, y in _avpo),
    f"p AS (SELECT {dsum('SaleTotal')} AS rev, {dsum('Profit')} AS prof, {dsum('TicketCost')} AS cost, "
    f"count(*) AS n FROM e WHERE {TY})",
    f"a AS (SELECT CompanyName, {dsum('SaleTotal')} AS rev, {dsum('Profit')} AS prof, "
    f"{dsum('TicketCost')} AS cost, count(*) AS n FROM e WHERE {TY} AND CompanyName IS NOT NULL GROUP BY 1)")


def _h2h(p: str) -> list[str]:
    rev, prof, n, loss = (f"{p}.{c}" for c in ("rev", "prof", "n", "loss"))
    return [f"CAST({rev} AS DOUBLE)", f"CAST({prof} AS DOUBLE)", gpct(prof, rev), f"CAST({n} AS DOUBLE)",
            f"CASE WHEN {n} > 0 THEN CAST({rev} AS DOUBLE) / {n} ELSE 0.0 END",
            f"CASE WHEN {n} > 0 THEN {loss} / {n} * 100 ELSE 0.0 END"]


_H2H = ("Revenue", "Profit", "Margin %", "Orders", "Avg Order $", "Loss-order %")
ORACLE["head_to_head"] = with_enriched(
    " UNION ALL ".join(
        f"SELECT a.CompanyName AS affiliate_a, b.CompanyName AS affiliate_b, {i} AS position, '{m}' AS metric, "
        f"coalesce({_h2h('a')[i]}, 0.0) AS value_a, coalesce({_h2h('b')[i]}, 0.0) AS value_b, "
        f"coalesce({_h2h('a')[i]}, 0.0) - coalesce({_h2h('b')[i]}, 0.0) AS delta "
        f"FROM (SELECT 1) one LEFT JOIN r a ON a.rk = 1 LEFT JOIN r b ON b.rk = 2"
        for i, m in enumerate(_H2H)),
    f"per AS (SELECT CompanyName, {dsum('SaleTotal')} AS rev, {dsum('Profit')} AS prof, count(*) AS n, "
    f"count_if(Profit < 0) AS loss FROM e WHERE {TY} AND CompanyName IS NOT NULL GROUP BY 1)",
    "r AS (SELECT *, row_number() OVER (ORDER BY rev DESC, CompanyName) AS rk FROM per)")

ORACLE["order_size_shift"] = with_enriched(
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{s}' AS stat, {s}_ly AS last_year, {s}_ty AS this_year, "
        f"CASE WHEN {s}_ly <> 0 THEN ({s}_ty / {s}_ly - 1) * 100 END AS change_pct FROM w"
        for i, s in enumerate(("mean", "median", "p90"))),
    f"""s AS (SELECT YearLabel, CAST(sum(SaleTotal) AS DOUBLE) / count(*) AS mean,
       quantile_cont(CAST(SaleTotal AS DOUBLE), 0.5) AS median, quantile_cont(CAST(SaleTotal AS DOUBLE), 0.9) AS p90
       FROM e WHERE YearLabel IN ('This Year', 'Last Year') GROUP BY 1)""",
    "w AS (SELECT " + ", ".join(
        f"max(CASE WHEN YearLabel = '{lab}' THEN {s} END) AS {s}{suf}"
        for s in ("mean", "median", "p90") for lab, suf in (("This Year", "_ty"), ("Last Year", "_ly"))) + " FROM s)")

ORACLE["mix_shift"] = with_enriched("""
SELECT Sport AS sport, CAST(g.ly AS DOUBLE) AS last_year, CAST(g.ty AS DOUBLE) AS this_year,
  CASE WHEN g.ly <> 0 THEN (CAST(g.ty AS DOUBLE) - CAST(g.ly AS DOUBLE)) / CAST(g.ly AS DOUBLE) * 100 END AS yoy_pct,
  CASE WHEN t.ly <> 0 THEN CAST(g.ly AS DOUBLE) / CAST(t.ly AS DOUBLE) * 100 END AS ly_share_pct,
  CASE WHEN t.ty <> 0 THEN CAST(g.ty AS DOUBLE) / CAST(t.ty AS DOUBLE) * 100 END AS ty_share_pct,
  (CASE WHEN t.ty <> 0 THEN CAST(g.ty AS DOUBLE) / CAST(t.ty AS DOUBLE) * 100 END)
  - (CASE WHEN t.ly <> 0 THEN CAST(g.ly AS DOUBLE) / CAST(t.ly AS DOUBLE) * 100 END) AS share_delta_pts
FROM g CROSS JOIN t WHERE g.n > 0""",
    f"g AS (SELECT Sport, {dsum('SaleTotal', TY)} AS ty, {dsum('SaleTotal', LY)} AS ly, "
    f"count_if({TY} OR {LY}) AS n FROM e WHERE Sport IS NOT NULL GROUP BY 1)",
    f"t AS (SELECT {dsum('SaleTotal', TY)} AS ty, {dsum('SaleTotal', LY)} AS ly FROM e)")


ORACLE["enrich_sections"] = with_enriched("""
SELECT Section, Seats, Section_Num, Section_Type, SectionNumTier, SectionTypeTier, count(*) AS orders
FROM eall GROUP BY ALL""")

FINE_LEAD_SQL = """CASE WHEN LeadTimeDays IS NULL OR LeadTimeDays <= -1 OR LeadTimeDays > 9999 THEN NULL
  WHEN LeadTimeDays <= 0 THEN 'Same day' WHEN LeadTimeDays <= 1 THEN '1 day' WHEN LeadTimeDays <= 3 THEN '2-3 days'
  WHEN LeadTimeDays <= 7 THEN '4-7 days' WHEN LeadTimeDays <= 14 THEN '1-2 weeks' WHEN LeadTimeDays <= 30 THEN '2-4 weeks'
  WHEN LeadTimeDays <= 60 THEN '1-2 months' WHEN LeadTimeDays <= 365 THEN '2-12 months' WHEN LeadTimeDays <= 9999 THEN '1y+' END"""
ORACLE["enrich_lead_time"] = with_enriched(f"""
SELECT LeadTimeDays, LeadTimeBucket, {FINE_LEAD_SQL} AS fine_bucket, count(*) AS orders FROM eall GROUP BY ALL""")

ORACLE["enrich_quantity"] = with_enriched("SELECT Quantity, QuantityBucket, count(*) AS orders FROM eall GROUP BY ALL")

ORACLE["enrich_calendar"] = with_enriched("""
SELECT YearLabel, YEAR, SellMonth, SellMonthName, SellMonthNum, SellDayOfWeek, SellHour, EventMonth, EventDayOfWeek,
  count(*) AS orders FROM eall GROUP BY ALL""")

ORACLE["enrich_flags"] = with_enriched("""
SELECT YearLabel, count(*) AS orders, count_if(IsDelivered) AS delivered, count_if(IsCancelled) AS cancelled,
  count_if(IsExpired) AS expired, count_if(Profit < 0) AS loss_orders, count_if(ProfitMargin IS NULL) AS null_margins
FROM eall GROUP BY ALL""")


ORACLE["lookup_dims"] = with_enriched("""
SELECT RequestedPerformerTypeId, PrimaryPerformerName, ShippingCompany, Sport, State, MarketplaceTier, count(*) AS orders
FROM eall GROUP BY ALL""")

_SC = ("count(*) AS rows, count_if(YearLabel = 'This Year') AS ty_rows, "
       "count_if(YearLabel = 'Last Year') AS ly_rows")
ORACLE["scope_counts"] = with_enriched(f"""
SELECT CompanyName AS affiliate, {_SC} FROM s WHERE CompanyName IS NOT NULL GROUP BY 1
UNION ALL SELECT 'All Affiliates', {_SC} FROM s""",
    "s AS (SELECT * FROM e WHERE Sport IN ('MLB', 'NBA', 'NFL', 'NHL'))")

ORACLE["affiliate_list"] = with_enriched("""
SELECT 'All Affiliates' AS affiliate, 0 AS position
UNION ALL SELECT DISTINCT CompanyName, 1 FROM e WHERE CompanyName IS NOT NULL""")

ORACLE["venue_rollup"] = with_enriched("""
SELECT VenueName, CAST(coalesce(sum(SaleTotal), 0) AS DOUBLE) AS revenue, avg(Quantity) AS avg_quantity,
  count(InvoiceID) AS orders
FROM e WHERE VenueName IS NOT NULL AND CAST(VenueName AS VARCHAR) <> '' GROUP BY 1""")

ORACLE["sport_list"] = with_enriched("SELECT DISTINCT Sport AS value FROM e WHERE Sport IS NOT NULL")


def share_sql(group: str, metric: str, where: str) -> str:
    return with_enriched(f"""
SELECT {group} AS category, CAST(v AS DOUBLE) AS value,
  CASE WHEN t <> 0 THEN CAST(v AS DOUBLE) / CAST(t AS DOUBLE) * 100 END AS share_pct
FROM g CROSS JOIN (SELECT {dsum(metric)} AS t FROM e WHERE {group} IS NOT NULL AND {where}) tt""",
        f"g AS (SELECT {group}, {dsum(metric)} AS v FROM e WHERE {group} IS NOT NULL AND {where} GROUP BY 1)")


ORACLE["share_revenue"] = share_sql("Sport", "SaleTotal", TY)
ORACLE["share_profit"] = share_sql("MarketplaceTier", "Profit", TY)
ORACLE["share_orders"] = with_enriched(f"""
SELECT Sport AS category, orders, CASE WHEN t <> 0 THEN orders / t * 100 END AS share_pct
FROM g CROSS JOIN (SELECT count(*) AS t FROM e WHERE Sport IS NOT NULL AND {TY}) tt""",
    f"g AS (SELECT Sport, count(*) AS orders FROM e WHERE Sport IS NOT NULL AND {TY} GROUP BY 1)")


def grid_sql_ctes(row: str, col: str, metric: str, where: str, top_rows=None, top_cols=None) -> list[str]:
    w = {"SaleTotal": dsum("SaleTotal"), "Profit": dsum("Profit")}[metric]
    ctes = [f"c0 AS (SELECT {row} AS row_label, {col} AS col_label, CAST({w} AS DOUBLE) AS value, {w} AS w "
            f"FROM e WHERE {row} IS NOT NULL AND {col} IS NOT NULL AND {where} GROUP BY 1, 2)"]
    src = "c0"
    if top_rows:
        ctes.append(f"c1 AS (SELECT * FROM {src} WHERE row_label IN (SELECT row_label FROM {src} GROUP BY 1 "
                    f"ORDER BY sum(abs(w)) DESC, row_label LIMIT {top_rows}))")
        src = "c1"
    if top_cols:
        ctes.append(f"c2 AS (SELECT * FROM {src} WHERE col_label IN (SELECT col_label FROM {src} GROUP BY 1 "
                    f"ORDER BY sum(abs(w)) DESC, col_label LIMIT {top_cols}))")
        src = "c2"
    ctes.append(f"c AS (SELECT * FROM {src})")
    return ctes


def grid_sql(row: str, col: str, metric: str, where: str, top_rows=None, top_cols=None) -> str:
    ctes = grid_sql_ctes(row, col, metric, where, top_rows, top_cols)
    ctes += ["t AS (SELECT *, sum(w) OVER (PARTITION BY row_label) AS rt, sum(w) OVER (PARTITION BY col_label) AS ct FROM c)",
             "r AS (SELECT row_label, CAST(row_number() OVER (ORDER BY rt, row_label) - 1 AS INTEGER) AS row_order "
             "FROM (SELECT DISTINCT row_label, rt FROM t))",
             "k AS (SELECT col_label, CAST(row_number() OVER (ORDER BY ct DESC, col_label) - 1 AS INTEGER) AS col_order "
             "FROM (SELECT DISTINCT col_label, ct FROM t))"]
    return with_enriched("""
SELECT t.row_label, t.col_label, value, CAST(rt AS DOUBLE) AS row_total, CAST(ct AS DOUBLE) AS col_total, row_order, col_order
FROM t JOIN r USING (row_label) JOIN k USING (col_label)""", *ctes)


ORACLE["grid_affiliate_sport"] = grid_sql("CompanyName", "Sport", "SaleTotal", TY)
ORACLE["grid_affiliate_tier"] = grid_sql("CompanyName", "MarketplaceTier", "SaleTotal", TY)
ORACLE["grid_top_teams"] = grid_sql("CompanyName", "HomeTeam", "SaleTotal", TY, top_cols=15)
ORACLE["grid_top_rows_cols"] = grid_sql("CompanyName", "HomeTeam", "Profit", TY, top_rows=25, top_cols=15)

_SHARED_CTES = [
    f"v AS (SELECT CAST({dsum('SaleTotal')} AS DOUBLE) AS value FROM e WHERE {TY} AND CompanyName IS NOT NULL "
    f"AND Sport IS NOT NULL GROUP BY CompanyName, Sport UNION ALL "
    f"SELECT CAST({dsum('SaleTotal')} AS DOUBLE) FROM e WHERE {TY} AND CompanyName IS NOT NULL "
    f"AND MarketplaceTier IS NOT NULL GROUP BY CompanyName, MarketplaceTier)",
    "vv AS (SELECT value FROM v WHERE value <> 0 AND NOT isnan(value) AND NOT isinf(value))",
    "z AS (SELECT 0.0::DOUBLE AS zmin, CASE WHEN quantile_cont(value, 0.98) > 0 THEN quantile_cont(value, 0.98) "
    "WHEN max(value) IS NOT NULL AND max(value) <> 0 THEN max(value) ELSE 1.0 END AS zmax FROM vv)"]
ORACLE["grid_shared_range"] = with_enriched("SELECT zmin, zmax FROM z", *_SHARED_CTES)


def compact_money_sql(v: str) -> str:
    a = f"abs({v})"
    return (f"CASE WHEN {v} IS NULL OR isnan({v}) OR isinf({v}) OR {v} = 0 THEN '' ELSE "
            f"(CASE WHEN {v} < 0 THEN '-' ELSE '' END) || CASE "
            f"WHEN {a} >= 1e6 THEN '$' || format('{{:.1f}}', {a} / 1e6) || 'M' "
            f"WHEN {a} >= 1e3 THEN '$' || format('{{:.0f}}', {a} / 1e3) || 'K' "
            f"ELSE '$' || format('{{:.0f}}', {a}) END END")


ORACLE["grid_intensity"] = with_enriched(f"""
SELECT row_label, col_label, value, CASE WHEN zmax > 0 THEN value / zmax ELSE 0.0 END AS intensity,
  (value <> 0 AND NOT isnan(value) AND abs(value) >= CASE WHEN zmax > 0 THEN zmax * 0.03 ELSE 0.0 END) AS labeled,
  CASE WHEN (value <> 0 AND NOT isnan(value) AND abs(value) >= CASE WHEN zmax > 0 THEN zmax * 0.03 ELSE 0.0 END)
       THEN {compact_money_sql('value')} END AS label,
  (CASE WHEN zmax > 0 THEN value / zmax ELSE 0.0 END) > 0.5 AS light_text
FROM c CROSS JOIN z""", *_SHARED_CTES, *grid_sql_ctes("CompanyName", "Sport", "SaleTotal", TY))

_DAYS = "['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']"
ORACLE["day_hour_grid"] = with_enriched(f"""
SELECT a.day, a.day_order, a.hour, CAST(coalesce(rev, 0) AS DOUBLE) AS revenue, CAST(coalesce(prof, 0) AS DOUBLE) AS profit,
  {gpct('coalesce(prof, 0)', 'coalesce(rev, 0)')} AS margin, {gpct('coalesce(prof, 0)', 'coalesce(cost, 0)')} AS ratio,
  coalesce(orders, 0) AS orders
FROM axis a LEFT JOIN c ON a.day = c.day AND a.hour = c.hour""",
    f"axis AS (SELECT CAST(i // 24 AS INTEGER) AS day_order, CAST(i % 24 AS INTEGER) AS hour, "
    f"{_DAYS}[CAST(i // 24 AS INTEGER) + 1] AS day FROM range(168) r(i))",
    f"c AS (SELECT SellDayOfWeek AS day, SellHour AS hour, {dsum('SaleTotal')} AS rev, {dsum('Profit')} AS prof, "
    f"{dsum('TicketCost')} AS cost, count(*) AS orders FROM e WHERE SellDate_dt IS NOT NULL GROUP BY 1, 2)")

ORACLE["time_pivot"] = with_enriched(f"""
SELECT d.day, h.hour, coalesce(c.value, CASE WHEN d.day IN (SELECT day FROM c) THEN 0.0 END) AS value, d.day_order
FROM (SELECT DISTINCT hour FROM c) h CROSS JOIN (SELECT i AS day_order, {_DAYS}[CAST(i AS INTEGER) + 1] AS day FROM range(7) t(i)) d
LEFT JOIN c ON c.day = d.day AND c.hour = h.hour""",
    f"c AS (SELECT SellDayOfWeek AS day, SellHour AS hour, CAST(round({dsum('SaleTotal')}, 0) AS DOUBLE) AS value "
    f"FROM e WHERE SellDayOfWeek IS NOT NULL AND SellHour IS NOT NULL GROUP BY 1, 2)")

_MET4 = (("revenue", "CAST(rev AS DOUBLE)"), ("profit", "CAST(prof AS DOUBLE)"),
         ("margin", gpct("prof", "rev")), ("ratio", gpct("prof", "cost")))
ORACLE["state_metric"] = with_enriched(
    "SELECT State AS state, " + ", ".join(f"{x} AS {a}" for a, x in _MET4) + " FROM g",
    f"g AS (SELECT State, {dsum('SaleTotal')} AS rev, {dsum('Profit')} AS prof, {dsum('TicketCost')} AS cost "
    f"FROM e WHERE State IS NOT NULL AND {TY} GROUP BY 1)")

ORACLE["state_shared_range"] = with_enriched(
    " UNION ALL ".join(f"SELECT '{a}' AS metric, 0.0::DOUBLE AS zmin, greatest(coalesce(max({x}), 0.0), 1.0) AS zmax FROM g"
                       for a, x in _MET4),
    f"g AS (SELECT YearLabel, State, {dsum('SaleTotal')} AS rev, {dsum('Profit')} AS prof, {dsum('TicketCost')} AS cost "
    f"FROM e WHERE State IS NOT NULL AND YearLabel IS NOT NULL GROUP BY 1, 2)")

_SP = ["MLB", "NBA", "NFL", "NHL", "Other"]
ORACLE["cross_tab"] = with_enriched(
    "SELECT CompanyName AS affiliate, "
    + ", ".join(f"CAST(r_{sp} AS DOUBLE) AS revenue_{sp.lower()}" for sp in _SP) + ", "
    + ", ".join(f"{gpct(f'p_{sp}', f'r_{sp}')} AS margin_{sp.lower()}" for sp in _SP) + " FROM g",
    "g AS (SELECT CompanyName, " + ", ".join(
        f"{dsum('SaleTotal', f"Sport = '{sp}'")} AS r_{sp}, {dsum('Profit', f"Sport = '{sp}'")} AS p_{sp}" for sp in _SP)
    + f" FROM e WHERE CompanyName IS NOT NULL AND {TY} GROUP BY 1)")


def hist_sql(select_x: str, where: str, nbins: int, by: str | None = None, lo: str | None = None,
             hi: str | None = None, extra_ctes: tuple[str, ...] = ()) -> str:
    byc = f"{by}, " if by else ""
    bounds = (f"b AS (SELECT {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi)" if lo is not None
              else "b AS (SELECT min(x) AS lo, max(x) AS hi FROM d)")
    return with_enriched(f"""
SELECT {byc}bin, lo + bin * w AS bin_lo, lo + (bin + 1) * w AS bin_hi, count(*) AS count
FROM (SELECT {byc}CAST(least(CASE WHEN w > 0 THEN floor((x - lo) / w) ELSE 0 END, {nbins - 1}) AS INTEGER) AS bin, lo, w
      FROM d CROSS JOIN (SELECT lo, hi, (hi - lo) / {nbins} AS w FROM b) bb WHERE x >= lo AND x <= hi)
GROUP BY ALL""", *extra_ctes,
        f"d AS (SELECT {byc}CAST({select_x} AS DOUBLE) AS x FROM e WHERE {where})",
        "d2 AS (SELECT 1)", bounds)


_LAB = "YearLabel IN ('This Year', 'Last Year')"
ORACLE["hist_margin"] = hist_sql("ProfitMargin", f"{_LAB} AND ProfitMargin IS NOT NULL AND NOT isnan(ProfitMargin)",
                                 50, by="YearLabel")
ORACLE["hist_lead_time"] = hist_sql("LeadTimeDays", f"{_LAB} AND LeadTimeDays BETWEEN -30 AND 365", 60,
                                    by="YearLabel", lo="-30", hi="365")
ORACLE["hist_order_size"] = hist_sql(
    "SaleTotal", f"{_LAB} AND CAST(SaleTotal AS DOUBLE) < (SELECT quantile_cont(CAST(SaleTotal AS DOUBLE), 0.99) FROM e)",
    50, by="YearLabel")

_clip_parts = []
for _col in ("SaleTotal", "TicketCost", "Profit"):
    _lo = "p1" if _col == "Profit" else "0.0"
    _clip_parts.append(f"""SELECT '{_col}' AS column_name, bin, lo + bin * w AS bin_lo, lo + (bin + 1) * w AS bin_hi, count(*) AS count
FROM (SELECT CAST(least(CASE WHEN w > 0 THEN floor((x - lo) / w) ELSE 0 END, 59) AS INTEGER) AS bin, lo, w, x
      FROM (SELECT least(greatest(CAST({_col} AS DOUBLE), {_lo}), p99) AS x FROM e,
            (SELECT quantile_cont(CAST({_col} AS DOUBLE), 0.01) AS p1, quantile_cont(CAST({_col} AS DOUBLE), 0.99) AS p99 FROM e) q) d
      CROSS JOIN (SELECT lo, (hi - lo) / 60 AS w FROM (SELECT min(least(greatest(CAST({_col} AS DOUBLE), {_lo}), p99)) AS lo,
                  max(least(greatest(CAST({_col} AS DOUBLE), {_lo}), p99)) AS hi FROM e,
                  (SELECT quantile_cont(CAST({_col} AS DOUBLE), 0.01) AS p1, quantile_cont(CAST({_col} AS DOUBLE), 0.99) AS p99 FROM e) q2)) bb)
WHERE x >= lo GROUP BY ALL""")
ORACLE["hist_clipped"] = with_enriched(" UNION ALL ".join(_clip_parts))


def box_sql(group: str, where: str) -> str:
    return with_enriched(f"""
SELECT group_value, min, q1, median, q3, max, n,
  CAST(row_number() OVER (ORDER BY median DESC, group_value) - 1 AS INTEGER) AS median_rank
FROM (SELECT {group} AS group_value, quantile_cont(ProfitMargin, 0.0) AS min, quantile_cont(ProfitMargin, 0.25) AS q1,
        quantile_cont(ProfitMargin, 0.5) AS median, quantile_cont(ProfitMargin, 0.75) AS q3,
        quantile_cont(ProfitMargin, 1.0) AS max, count(*) AS n
      FROM e WHERE {group} IS NOT NULL AND ProfitMargin IS NOT NULL AND NOT isnan(ProfitMargin) AND {where} GROUP BY 1)""")


ORACLE["margin_box"] = box_sql("Sport", TY)
ORACLE["margin_box_lead"] = box_sql("LeadTimeBucket", TY)


def summary_sql(group: str, where: str) -> str:
    m = "CASE WHEN NOT isnan(ProfitMargin) THEN ProfitMargin END"
    return with_enriched(f"""
SELECT {group} AS group_value, CAST({dsum('SaleTotal')} AS DOUBLE) AS revenue,
  coalesce(quantile_cont({m}, 0.5), 0.0) AS median_margin, coalesce(quantile_cont({m}, 0.25), 0.0) AS p25_margin,
  coalesce(quantile_cont({m}, 0.75), 0.0) AS p75_margin, CAST(count_if(Profit < 0) AS BIGINT) AS loss_orders,
  count_if(Profit < 0) / count(*) * 100 AS loss_pct, count(*) AS orders
FROM e WHERE {group} IS NOT NULL AND {where} GROUP BY 1""")


ORACLE["margin_summary"] = summary_sql("CompanyName", TY)
ORACLE["margin_summary_sport"] = summary_sql("Sport", TY)

_fine_order = """CASE WHEN LeadTimeDays <= 0 THEN 0 WHEN LeadTimeDays <= 1 THEN 1 WHEN LeadTimeDays <= 3 THEN 2
  WHEN LeadTimeDays <= 7 THEN 3 WHEN LeadTimeDays <= 14 THEN 4 WHEN LeadTimeDays <= 30 THEN 5 WHEN LeadTimeDays <= 60 THEN 6
  WHEN LeadTimeDays <= 365 THEN 7 ELSE 8 END"""
ORACLE["lead_bucket_margin"] = with_enriched(f"""
SELECT bucket, CAST(bucket_order AS INTEGER) AS bucket_order, count(*) AS orders, quantile_cont(ProfitMargin, 0.5) AS median_margin,
  CASE WHEN {dsum('SaleTotal')} <> 0 THEN CAST({dsum('Profit')} AS DOUBLE) / CAST({dsum('SaleTotal')} AS DOUBLE) * 100 END AS agg_margin
FROM (SELECT *, {FINE_LEAD_SQL} AS bucket, {_fine_order} AS bucket_order FROM e
      WHERE LeadTimeDays IS NOT NULL AND ProfitMargin IS NOT NULL AND {TY})
WHERE bucket IS NOT NULL GROUP BY 1, 2""")

_YV = ("revenue_ty", "revenue_ly", "profit_ty", "profit_ly", "margin_ty", "margin_ly", "ratio_ty", "ratio_ly",
       "orders_ty", "orders_ly")
_YP = ("revenue_yoy_pct", "profit_yoy_pct")


def _long_sql(cols) -> str:
    return "long AS (SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM y" for c in cols
    ) + ") WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value))"


ORACLE["robust_ranges"] = with_enriched("""
SELECT column_name, CASE WHEN n >= 2 AND p10 <> p90 THEN p10 END AS lo, CASE WHEN n >= 2 AND p10 <> p90 THEN p90 END AS hi
FROM (SELECT column_name, count(*) AS n, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM long GROUP BY 1)""",
    f"y AS ({yoy_table_body('CompanyName')})", _long_sql(_YV))

ORACLE["diverging_bounds"] = with_enriched("""
SELECT column_name, CASE WHEN n >= 2 AND b <> 0 THEN b END AS bound
FROM (SELECT column_name, count(*) AS n, quantile_cont(abs(value), 0.9) AS b FROM long GROUP BY 1)""",
    f"y AS ({yoy_table_body('CompanyName')})", _long_sql(_YP))

ORACLE["scatter_frame"] = with_enriched(f"""
SELECT CAST(TicketCost AS DOUBLE) AS cost, CAST(SaleTotal AS DOUBLE) AS revenue, Sport AS sport, TicketsSold AS tickets,
  CompanyName AS affiliate, EventName AS event, ProfitMargin AS margin, u.upper
FROM e CROSS JOIN (SELECT CAST(greatest(max(SaleTotal), max(TicketCost)) AS DOUBLE) AS upper FROM e
                   WHERE SaleTotal > 0 AND TicketCost > 0 AND {TY}) u
WHERE SaleTotal > 0 AND TicketCost > 0 AND {TY}""")



# --- rankings -------------------------------------------------------------------------------

ORACLE["team_breakdown"] = with_enriched("""
SELECT t.HomeTeam AS team, sm.sport, CAST(rev AS DOUBLE) AS revenue, CAST(prof AS DOUBLE) AS profit,
  """ + gpct("prof", "rev") + """ AS margin, """ + gpct("prof", "cost") + """ AS ratio,
  CAST(rev AS DOUBLE) / orders AS avg_order, orders, tickets, top_affiliate,
  CASE WHEN n_aff > 1 THEN worst END AS worst_affiliate
FROM t LEFT JOIN sm ON t.HomeTeam = sm.HomeTeam LEFT JOIN af ON t.HomeTeam = af.HomeTeam""",
    f"d AS (SELECT * FROM e WHERE HomeTeam IS NOT NULL AND {TY})",
    f"t AS (SELECT HomeTeam, {dsum('SaleTotal')} AS rev, {dsum('Profit')} AS prof, {dsum('TicketCost')} AS cost, "
    "count(*) AS orders, CAST(coalesce(sum(CAST(TicketsSold AS BIGINT)), 0) AS BIGINT) AS tickets FROM d GROUP BY 1)",
    "sm AS (SELECT HomeTeam, Sport AS sport FROM (SELECT HomeTeam, Sport, row_number() OVER "
    "(PARTITION BY HomeTeam ORDER BY count(*) DESC, Sport) AS rn FROM d WHERE Sport IS NOT NULL GROUP BY 1, 2) WHERE rn = 1)",
    f"pa AS (SELECT HomeTeam, CompanyName, {dsum('Profit')} AS p FROM d WHERE CompanyName IS NOT NULL GROUP BY 1, 2)",
    "af AS (SELECT HomeTeam, max(CASE WHEN r1 = 1 THEN CompanyName END) AS top_affiliate, "
    "max(CASE WHEN r2 = 1 THEN CompanyName END) AS worst, count(*) AS n_aff FROM (SELECT *, "
    "row_number() OVER (PARTITION BY HomeTeam ORDER BY p DESC, CompanyName ASC) AS r1, "
    "row_number() OVER (PARTITION BY HomeTeam ORDER BY p ASC, CompanyName DESC) AS r2 FROM pa) GROUP BY 1)")

_EV = f"""ev AS (SELECT EventName AS event, VenueName AS venue, EventDate_dt AS event_date,
  CAST({dsum('SaleTotal')} AS DOUBLE) AS revenue, CAST({dsum('TicketCost')} AS DOUBLE) AS cost,
  CAST({dsum('Profit')} AS DOUBLE) AS profit, count(InvoiceID) AS orders,
  CAST(coalesce(sum(CAST(TicketsSold AS BIGINT)), 0) AS BIGINT) AS tickets,
  {gpct(dsum('Profit'), dsum('SaleTotal'))} AS margin, {gpct(dsum('Profit'), dsum('TicketCost'))} AS ratio
  FROM e WHERE EventName IS NOT NULL AND VenueName IS NOT NULL AND EventDate_dt IS NOT NULL GROUP BY 1, 2, 3)"""
ORACLE["event_rollup"] = with_enriched("SELECT * FROM ev", _EV)
_EVK = "event ASC NULLS FIRST, venue ASC NULLS FIRST, event_date ASC NULLS FIRST"
ORACLE["top_events"] = with_enriched(f"SELECT * FROM ev ORDER BY profit DESC NULLS LAST, {_EVK} LIMIT 20", _EV)
ORACLE["top_events_by_margin"] = with_enriched(f"SELECT * FROM ev ORDER BY margin DESC NULLS LAST, {_EVK} LIMIT 20", _EV)
ORACLE["bottom_events"] = with_enriched(f"SELECT * FROM ev ORDER BY profit ASC NULLS FIRST, {_EVK} LIMIT 15", _EV)

ORACLE["worst_loss_orders"] = with_enriched("""
SELECT YearLabel AS year, CompanyName AS affiliate, EventName AS event, VenueName AS venue,
  CAST(SaleTotal AS DOUBLE) AS revenue, CAST(TicketCost AS DOUBLE) AS cost, CAST(Profit AS DOUBLE) AS profit,
  ProfitMargin AS margin, ShippingCompany AS marketplace
FROM e WHERE Profit < 0
ORDER BY profit NULLS FIRST, revenue NULLS FIRST, affiliate NULLS FIRST, event NULLS FIRST, venue NULLS FIRST,
  year NULLS FIRST, marketplace NULLS FIRST
LIMIT 20""")

_PARETO = [f"g AS (SELECT CompanyName, {dsum('SaleTotal')} AS rev FROM e WHERE {TY} AND CompanyName IS NOT NULL GROUP BY 1)",
           "tt AS (SELECT sum(rev) AS t FROM g)",
           """p AS (SELECT CompanyName AS affiliate, CAST(rev AS DOUBLE) AS revenue,
  CAST(row_number() OVER (ORDER BY rev DESC, CompanyName) AS INTEGER) AS "rank",
  CASE WHEN t <> 0 THEN CAST(rev AS DOUBLE) / CAST(t AS DOUBLE) * 100 END AS share_pct,
  CASE WHEN t <> 0 THEN CAST(sum(rev) OVER (ORDER BY rev DESC, CompanyName ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
       AS DOUBLE) / CAST(t AS DOUBLE) * 100 END AS cum_share_pct
  FROM g CROSS JOIN tt)"""]
ORACLE["pareto"] = with_enriched("SELECT * FROM p", *_PARETO)
ORACLE["pareto_80"] = with_enriched("""
SELECT count(*) AS affiliates, min(CASE WHEN cum_share_pct >= 80.0 THEN "rank" END) AS rank_at_threshold,
  max(share_pct) AS top_share_pct FROM p""", *_PARETO)

_YT = f"y AS ({yoy_table_body('CompanyName')})"
ORACLE["winners"] = with_enriched("""SELECT * FROM y WHERE revenue_yoy_pct IS NOT NULL AND revenue_ly > 1000.0
ORDER BY revenue_yoy_pct DESC, CompanyName LIMIT 10""", _YT)
ORACLE["losers"] = with_enriched("""SELECT * FROM y WHERE revenue_yoy_pct IS NOT NULL AND revenue_ly > 1000.0
ORDER BY revenue_yoy_pct ASC, CompanyName LIMIT 10""", _YT)

ORACLE["loss_concentration"] = with_enriched("""
SELECT CompanyName AS affiliate, CAST(l AS DOUBLE) AS loss_dollars,
  CAST(row_number() OVER (ORDER BY l, CompanyName) AS INTEGER) AS loss_rank, CAST(t AS DOUBLE) AS total_loss,
  n AS loss_orders, CASE WHEN n > 0 THEN CAST(t AS DOUBLE) / n END AS avg_loss,
  CASE WHEN t <> 0 THEN CAST(sum(l) OVER () AS DOUBLE) / CAST(t AS DOUBLE) * 100 END AS top_share_pct
FROM top CROSS JOIN tot""",
    "l0 AS (SELECT * FROM e WHERE Profit < 0)",
    f"tot AS (SELECT {dsum('Profit')} AS t, count(*) AS n FROM l0)",
    f"top AS (SELECT CompanyName, {dsum('Profit')} AS l FROM l0 WHERE CompanyName IS NOT NULL GROUP BY 1 "
    "ORDER BY l ASC, CompanyName LIMIT 5)")

ORACLE["worst_pairs"] = with_enriched(f"""
SELECT CompanyName AS affiliate, Sport AS sport, CAST(rev AS DOUBLE) AS revenue, CAST(prof AS DOUBLE) AS profit, orders,
  {gpct('prof', 'rev')} AS margin
FROM (SELECT CompanyName, Sport, {dsum('SaleTotal')} AS rev, {dsum('Profit')} AS prof, count(*) AS orders
      FROM e WHERE {TY} AND CompanyName IS NOT NULL AND Sport IS NOT NULL GROUP BY 1, 2)
WHERE rev >= 5000 ORDER BY margin, affiliate, sport LIMIT 10""")

_MBD = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, {dsum('SaleTotal')} AS rev, {dsum('Profit')} AS prof, "
    f"{dsum('TicketCost')} AS cost, count(*) AS orders FROM e WHERE {TY} AND {d} IS NOT NULL GROUP BY {d}"
    for d in ("Sport", "ShippingCompany", "SectionNumTier", "LeadTimeBucket"))
ORACLE["margin_by_dimension"] = with_enriched(f"""
SELECT dimension, value, CAST(rev AS DOUBLE) AS revenue, CAST(prof AS DOUBLE) AS profit, CAST(cost AS DOUBLE) AS cost,
  orders, {gpct('prof', 'rev')} AS margin, {gpct('prof', 'cost')} AS ratio
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY rev DESC, value) AS INTEGER) AS "rank" FROM ({_MBD}))
WHERE NOT (dimension = 'ShippingCompany' AND "rank" > 8)""")

ORACLE["section_codes"] = with_enriched(f"""
SELECT Section_Type AS section_type, CAST({dsum('SaleTotal')} AS DOUBLE) AS revenue, CAST({dsum('Profit')} AS DOUBLE) AS profit,
  count(InvoiceID) AS orders, round(avg(ProfitMargin), 6) AS avg_margin
FROM e WHERE {TY} AND Section_Type IS NOT NULL AND Section_Type <> '' GROUP BY 1""")

# --- risk -----------------------------------------------------------------------------------

ORACLE["delivery_kpis"] = with_enriched(f"""
SELECT total, delivered, total - delivered AS undelivered, cancelled, expired,
  CASE WHEN total > 0 THEN delivered / total * 100 ELSE 0.0 END AS delivery_rate
FROM (SELECT count(*) AS total, count_if(IsDelivered) AS delivered, count_if(IsCancelled) AS cancelled,
             count_if(IsExpired) AS expired FROM e WHERE {TY})""")

ORACLE["undelivered"] = with_enriched(f"""
SELECT CompanyName AS affiliate, count(InvoiceID) AS undelivered, CAST({dsum('SaleTotal')} AS DOUBLE) AS lost_revenue
FROM e WHERE {TY} AND NOT coalesce(IsDelivered, false) AND CompanyName IS NOT NULL GROUP BY 1""")

ORACLE["cancellations"] = with_enriched(f"""
SELECT CompanyName AS affiliate, count(InvoiceID) AS cancellations, CAST({dsum('SaleTotal')} AS DOUBLE) AS lost_revenue
FROM e WHERE {LY} AND coalesce(IsCancelled, false) AND CompanyName IS NOT NULL GROUP BY 1""")

ORACLE["delivery_rate"] = with_enriched(f"""
SELECT affiliate, orders, delivered, CASE WHEN orders > 0 THEN delivered / orders * 100 END AS delivery_rate
FROM (SELECT CompanyName AS affiliate, count(InvoiceID) AS orders, count_if(IsDelivered) AS delivered
      FROM e WHERE {TY} AND CompanyName IS NOT NULL GROUP BY 1)""")

ORACLE["loss_profile"] = with_enriched(f"""
SELECT affiliate, loss_orders, loss_dollars, median_loss, total_orders, loss_orders / total_orders * 100 AS loss_pct
FROM (SELECT CompanyName AS affiliate, count_if(Profit < 0) AS loss_orders,
             CAST({dsum('Profit', 'Profit < 0')} AS DOUBLE) AS loss_dollars,
             quantile_cont(CASE WHEN Profit < 0 THEN CAST(Profit AS DOUBLE) END, 0.5) AS median_loss,
             count(*) AS total_orders
      FROM e WHERE CompanyName IS NOT NULL GROUP BY 1)
WHERE loss_orders > 0 AND total_orders >= 50
ORDER BY loss_dollars, affiliate LIMIT 15""")

# --- profile --------------------------------------------------------------------------------

# FIXED VALUES — the enriched table's columns, written out for the oracle.
ENRICHED_COLUMNS = """YearLabel InvoiceID SellDate_dt EventDate_dt SaleTotal TicketCost Quantity CompanyName PrimaryPerformerName
SecondaryPerformerName RequestedPerformerTypeId VenueName EventName Section Seats ShippingCompany DeliveryType IsDelivered
IsCancelled IsExpired Sport State MarketplaceTier 
Profit TicketsSold SellMonth SellMonthName SellMonthNum SellDayOfWeek SellHour EventMonth EventDayOfWeek LeadTimeDays
Section_Num Section_Type HomeTeam AwayTeam YEAR ProfitMargin LeadTimeBucket SectionNumTier SectionTypeTier QuantityBucket""".split()
_DOUBLE_COLUMNS = ("ProfitMargin", "Section_Num")

ORACLE["profile_dates"] = with_enriched(f"""
SELECT count(*) AS rows, {len(ENRICHED_COLUMNS)} AS columns, min(SellDate_dt) AS sell_min, max(SellDate_dt) AS sell_max,
  min(EventDate_dt) AS event_min, max(EventDate_dt) AS event_max,
  count_if({TY}) AS this_year_rows, count_if({LY}) AS last_year_rows FROM e""")

ORACLE["missingness"] = with_enriched(
    "SELECT column_name, missing, missing / n * 100 AS pct FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count_if({c} IS NULL"
        + (f" OR isnan({c})" if c in _DOUBLE_COLUMNS else "") + ") AS missing, count(*) AS n FROM e"
        for c in ENRICHED_COLUMNS) + ") WHERE missing > 0")

_EXP_WHERE = ("CompanyName IS NOT NULL AND PrimaryPerformerName IS NOT NULL AND YEAR IS NOT NULL "
              "AND SellDate_dt IS NOT NULL")
ORACLE["export_rollup"] = with_enriched(f"""
SELECT CompanyName, PrimaryPerformerName, YEAR, CAST(month(SellDate_dt) AS INTEGER) AS MONTH,
  CAST({dsum('Profit')} AS DOUBLE) AS Profit, CAST(coalesce(sum(CAST(TicketsSold AS BIGINT)), 0) AS BIGINT) AS TicketsSold,
  CAST({dsum('SaleTotal')} AS DOUBLE) AS SaleTotal, round(avg(ProfitMargin), 6) AS ProfitMargin
FROM e WHERE {_EXP_WHERE} GROUP BY 1, 2, 3, 4""")

ORACLE["filtered_total"] = with_enriched(f"""
SELECT CAST({dsum('SaleTotal')} AS DOUBLE) AS last_year_revenue FROM e
WHERE {_EXP_WHERE} AND YEAR = 'last_year'""")


# --- labels ----------------------------------------------------------------------------------

def money_sql(v: str) -> str:
    return (f"CASE WHEN {v} IS NULL OR isnan({v}) THEN '—' ELSE "
            f"(CASE WHEN {v} < 0 THEN '-' ELSE '' END) || '$' || format('{{:,.0f}}', abs({v})) END")


def pct_sql(v: str, signed: bool = False) -> str:
    sign = f"CASE WHEN {v} >= 0 THEN '+' ELSE '-' END" if signed else f"CASE WHEN {v} < 0 THEN '-' ELSE '' END"
    return f"CASE WHEN {v} IS NULL OR isnan({v}) THEN '—' ELSE {sign} || format('{{:.1f}}', abs({v})) || '%' END"


def int_sql(v: str) -> str:
    return (f"CASE WHEN {v} IS NULL THEN '—' ELSE (CASE WHEN {v} < 0 THEN '-' ELSE '' END) "
            f"|| format('{{:,.0f}}', abs(CAST({v} AS DOUBLE))) END")


ORACLE["labels"] = with_enriched(f"""
SELECT strftime(m.month_start, '%Y-%m') AS year_month, strftime(m.month_start, '%b %y') AS month_label,
  {money_sql('CAST(m.rev AS DOUBLE)')} AS revenue_text, {compact_money_sql('CAST(m.prof AS DOUBLE)')} AS profit_compact,
  {pct_sql(gpct('m.prof', 'm.rev'))} AS margin_text,
  {pct_sql("(CASE WHEN p.rev > 0 THEN (CAST(m.rev AS DOUBLE) - CAST(p.rev AS DOUBLE)) / CAST(p.rev AS DOUBLE) * 100 END)", True)} AS yoy_text,
  {int_sql('m.orders')} AS orders_text
FROM mi m LEFT JOIN mi p ON p.idx = m.idx - 12""",
    _MONTHS, "mi AS (SELECT *, year(month_start) * 12 + month(month_start) AS idx FROM m)")


ORACLE["share_delivery"] = share_sql("DeliveryType", "SaleTotal", TY)
ORACLE["share_home_team"] = share_sql("HomeTeam", "SaleTotal", TY)

ORACLE["yoy_by_affiliate_top"] = yoy_table_sql("CompanyName") + " ORDER BY revenue_ty DESC, CompanyName LIMIT 10"
ORACLE["yoy_scoped"] = yoy_table_sql("Sport", where="CompanyName = 'Supplier#000000001'")
ORACLE["yoy_pair"] = yoy_table_sql("CompanyName", where="CompanyName IN ('Supplier#000000001', 'Supplier#000000002')")

_YM = {"margin": lambda c: gpct(dsum("Profit", c), dsum("SaleTotal", c)), "ratio": lambda c: gpct(dsum("Profit", c), dsum("TicketCost", c)),
       "orders": lambda c: f"CAST(count_if({c}) AS DOUBLE)"}
for _name, _sql in _YM.items():
    ORACLE[f"yoy_bars_{_name}"] = with_enriched(f"""
SELECT Sport AS group_value, 'This Year' AS year_label, {_sql(TY)} AS value FROM e WHERE Sport IS NOT NULL GROUP BY 1
UNION ALL SELECT Sport, 'Last Year', {_sql(LY)} FROM e WHERE Sport IS NOT NULL GROUP BY 1""")

ORACLE["count_losses"] = with_enriched("SELECT count(*) AS n FROM e WHERE Profit < 0 AND IsCancelled")

ORACLE["positions"] = with_enriched(f"""
SELECT Sport, least(greatest((m - -50.0) / 150.0, 0.0), 1.0) AS margin_position,
  1 - least(greatest((m - -50.0) / 150.0, 0.0), 1.0) AS inverted_position, least(greatest(0.5 + m / 200.0 / 2, 0.0), 1.0) AS diverging_position,
  least(greatest(m, -10.0), 10.0) AS clipped, round(r, 2) AS revenue, round(m, 1) AS margin
FROM (SELECT Sport, {gpct(dsum('Profit'), dsum('SaleTotal'))} AS m, CAST({dsum('SaleTotal')} AS DOUBLE) AS r FROM e GROUP BY 1)""")

ORACLE["grid_max_range"] = with_enriched(f"""
SELECT 0.0::DOUBLE AS zmin, coalesce(max(abs(v)), 1.0) AS zmax FROM (SELECT CAST({dsum('Profit')} AS DOUBLE) AS v
FROM e WHERE {TY} AND CompanyName IS NOT NULL AND Sport IS NOT NULL GROUP BY CompanyName, Sport)""")
ORACLE["grid_margin_cells"] = with_enriched(f"""
SELECT row_label, col_label, value, CASE WHEN z > 0 THEN value / z ELSE 0.0 END AS intensity, value <> 0 AND abs(value) >= CASE WHEN z > 0 THEN z * 0.03 ELSE 0.0 END AS labeled,
  CASE WHEN value <> 0 AND abs(value) >= CASE WHEN z > 0 THEN z * 0.03 ELSE 0.0 END THEN {pct_sql('value')} END AS label
FROM c CROSS JOIN (SELECT CASE WHEN quantile_cont(value, 0.98) > 0 THEN quantile_cont(value, 0.98)
  WHEN max(value) IS NOT NULL AND max(value) <> 0 THEN max(value) ELSE 1.0 END AS z FROM c WHERE value <> 0)""",
    f"c AS (SELECT CompanyName AS row_label, Sport AS col_label, {gpct(dsum('Profit'), dsum('SaleTotal'))} AS value "
    f"FROM e WHERE {TY} AND CompanyName IS NOT NULL AND Sport IS NOT NULL GROUP BY 1, 2)")
ORACLE["day_hour_intensity"] = with_enriched(f"""
SELECT day AS row_label, CAST(hour AS VARCHAR) AS col_label, v AS value, v / z AS intensity, v <> 0 AND abs(v) >= z * 0.04 AS labeled
FROM (SELECT a.day, a.hour, coalesce(r, 0.0) AS v, max(abs(coalesce(r, 0.0))) OVER () AS z
      FROM (SELECT i % 24 AS hour, {_DAYS}[CAST(i // 24 AS INTEGER) + 1] AS day FROM range(168) t(i)) a
      LEFT JOIN (SELECT SellDayOfWeek AS day, SellHour AS hour, CAST({dsum('SaleTotal')} AS DOUBLE) AS r FROM e
                 WHERE {TY} AND SellDate_dt IS NOT NULL GROUP BY 1, 2) c ON a.day = c.day AND a.hour = c.hour)""")

# The text export (plans/text_export.py) holds the mart's rows as text; these are the values it must give back.
_TEXT = """
x AS (SELECT *, YearLabel = 'This Year' AS ty, CASE WHEN InvoiceID % 11 < 2 THEN 0 ELSE SaleTotal END AS sale, hour(SellDate_dt) AS h FROM mart)"""
ORACLE["coerce_text"] = with_enriched("""
SELECT YearLabel, strftime(SellDate_dt, '%Y-%m') AS sell_month, CASE WHEN ty THEN CAST(h AS INTEGER) END AS event_hour, count(*) AS orders,
  CAST(sum(sale) AS DOUBLE) AS revenue, CAST(sum(TicketCost) AS DOUBLE) AS cost, CAST(sum(Quantity) AS BIGINT) AS tickets,
  CAST(coalesce(sum(RequestedPerformerTypeId), 0) AS BIGINT) AS type_ids, count(CompanyName) AS named FROM x GROUP BY ALL""", _TEXT)
ORACLE["coerce_flags"] = with_enriched("""
SELECT YearLabel, IsDelivered, IsCancelled, ty AND IsExpired AS IsExpired, count(*) AS orders FROM x GROUP BY ALL""", _TEXT)
ORACLE["harmonized_union"] = with_enriched("""
SELECT YearLabel, count(*) AS n, count_if(InvoiceID % 11 >= 2) AS "SaleTotal", count(CompanyName) AS "CompanyName",
  count_if(ty AND h IS NOT NULL) AS "EventTime", count_if(ty) AS "IsExpired", count_if(NOT ty) AS "Notes", count(SellDate_dt) AS "SellDate"
FROM x GROUP BY ALL""", _TEXT)


def _wrap_calls(sql: str, fn: str, before: str, after: str) -> str:
    out, i, key = [], 0, fn + "("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + before + sql[j:k] + after)
        i = k


def wrap_quantiles(sql: str, digits: int = 6) -> str:
    """Round every ``quantile_cont(...)`` like the Spark side rounds its quantiles, and type
    every ``count_if(...)`` as BIGINT like Spark's ``count_if``."""
    sql = _wrap_calls(sql, "quantile_cont", "round(", f", {digits})")
    return _wrap_calls(sql, "count_if", "CAST(", " AS BIGINT)")


for _k in list(ORACLE):
    ORACLE[_k] = wrap_quantiles(ORACLE[_k])

_POINTS = """
SELECT cost, revenue, sport, affiliate, profit_side FROM (SELECT CAST(TicketCost AS DOUBLE) AS cost, CAST(SaleTotal AS DOUBLE) AS revenue, Sport AS sport,
  CompanyName AS affiliate, Profit >= 0 AS profit_side, row_number() OVER ({part} ORDER BY InvoiceID % 2147483647 * 48271 % 2147483647, InvoiceID,
    CAST(TicketCost AS DOUBLE), CAST(SaleTotal AS DOUBLE), Sport NULLS FIRST, CompanyName NULLS FIRST, Profit >= 0) AS place FROM e) WHERE place <= {n}"""
ORACLE["scatter_sample"] = with_enriched(_POINTS.format(part="", n=5000))
ORACLE["scatter_sample_by_sport"] = with_enriched(_POINTS.format(part="PARTITION BY Sport", n=200))


def _all_dimensions(limit: str) -> str:
    return with_enriched(" UNION ALL ".join(
        f"SELECT '{name}' AS dimension, {col} AS group_value, * EXCLUDE ({col}) FROM ({yoy_table_body(col)} {limit.format(col=col)})" for name, col in YOY_DIMENSIONS.items()))


ORACLE["yoy_all_dimensions"] = wrap_quantiles(_all_dimensions(""))
ORACLE["yoy_all_top"] = wrap_quantiles(_all_dimensions("ORDER BY revenue_ty DESC, {col} LIMIT 25"))
ORACLE["cached_yoy"] = ORACLE["yoy_by_sport"]
ORACLE["store_yoy_affiliate"] = ORACLE["yoy_by_affiliate"]
ORACLE["store_kpi_deltas"] = ORACLE["kpi_deltas"]
ORACLE["store_yoy_bars"] = ORACLE["yoy_bars_margin"]
ORACLE["store_monthly"] = with_enriched(f"""
SELECT SellMonth AS year_month, CAST({dsum('SaleTotal')} AS DOUBLE) AS revenue, CAST({dsum('Profit')} AS DOUBLE) AS profit,
  {gpct(dsum('Profit'), dsum('SaleTotal'))} AS margin, {gpct(dsum('Profit'), dsum('TicketCost'))} AS ratio, count(*) AS orders
FROM e WHERE SellMonth IS NOT NULL GROUP BY 1""")
ORACLE["store_margin_sketch"] = with_enriched(
    "SELECT Sport AS sport, count(ProfitMargin) AS n, count(ProfitMargin) AS rows, true AS within_bound FROM e GROUP BY 1")
ORACLE["store_invoice_sketch"] = with_enriched(
    "SELECT Sport AS sport, count(DISTINCT InvoiceID) AS invoices_exact, true AS within_bound FROM e GROUP BY 1")

# The written files (plans/text_export.py): orders by invoice id modulo 50.
_FILES = """
x AS (SELECT *, YearLabel = 'This Year' AS ty, InvoiceID % 50 AS k, CASE WHEN InvoiceID % 11 < 2 OR InvoiceID % 50 = 19 THEN 0 ELSE SaleTotal END AS sale FROM mart)"""
ORACLE["csv_load"] = with_enriched("""
SELECT YearLabel, strftime(SellDate_dt, '%Y-%m') AS SellMonth, count(*) AS orders, CAST(sum(sale) AS DOUBLE) AS revenue, CAST(sum(Quantity) AS BIGINT) AS tickets,
  CAST(count_if(IsDelivered AND k <> 7) AS BIGINT) AS delivered, count(CompanyName) AS named FROM x WHERE k NOT IN (11, 13) GROUP BY ALL""", _FILES)
ORACLE["csv_load_report"] = with_enriched("""
SELECT YearLabel, item, kind, count(*) AS n FROM (
  SELECT YearLabel, 'line' AS item, CASE k WHEN 11 THEN 'too many fields' WHEN 13 THEN 'quote not closed' ELSE 'record' END AS kind FROM x
  UNION ALL SELECT YearLabel, 'SaleTotal', CASE WHEN k = 19 THEN 'too wide' WHEN InvoiceID % 11 < 2 THEN 'missing' ELSE 'number' END FROM x WHERE k NOT IN (11, 13)
  UNION ALL SELECT YearLabel, 'TicketCost', 'number' FROM x WHERE k NOT IN (11, 13)) GROUP BY ALL""", _FILES)
ORACLE["sorted_table"] = ORACLE["yoy_by_affiliate"] + " ORDER BY revenue_yoy_pct ASC NULLS LAST, revenue_ty DESC, CompanyName LIMIT 5"
ORACLE["wide_grid"] = with_enriched(
    "SELECT CompanyName AS row_label, " + ", ".join(f"CAST({dsum('SaleTotal', f"Sport = '{x}'")} AS DOUBLE) AS \"{x}\"" for x in ("NBA", "NFL", "NHL", "MLB", "Other"))
    + f" FROM e WHERE {TY} AND CompanyName IS NOT NULL GROUP BY 1")
ORACLE["month_key_text"] = with_enriched("SELECT substr(strftime(SellDate_dt, '%Y-%m-%d %H:%M:%S'), 1, 7) AS month_key, count(*) AS orders FROM e GROUP BY 1")
ORACLE["csv_sink"] = ORACLE["yoy_by_sport"]
