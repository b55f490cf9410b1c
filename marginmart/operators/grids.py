"""Two-way grids.

Grids stay in long form ``(row, col, value, totals, order)``: one aggregation of the cell
components, then windows over the *aggregated cells* only (bounded by the label
cardinalities, never by the fact size).  Pivoting into a wide table is left to the edge
(``pivot_wide``) and always receives explicit pivot values, so Spark never collects the
distinct labels to the driver.  Dense axes (7 days x 24 hours) come from a fixed axis
joined to the cells, never from a cross join of data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.enrich import DAYS_ORDER
from ..functions.labels import compact_money, pct
from ..sources.dims import SPORTS
from .joins import join_on
from .ordering import global_order
from .quantiles import _pin, quantiles

SUM_METRICS = ("SaleTotal", "Profit")
# Dimensions whose values are a fixed list, whatever the size of the data.
FEW_LABELS = ("Sport", "MarketplaceTier", "SectionNumTier", "SectionTypeTier", "QuantityBucket", "LeadTimeBucket", "YearLabel")


def grid_cells(df: DataFrame, row_col: str, col_col: str, metric: str = "SaleTotal") -> DataFrame:
    """Per (row, col) components and the metric value ``v`` (plus an exact ``_w`` for sums)."""
    g = (df.where(F.col(row_col).isNotNull() & F.col(col_col).isNotNull())
           .groupBy(F.col(row_col).alias("row_label"), F.col(col_col).alias("col_label"))
           .agg(*M.component_aggs()))
    v = M.metric_from(metric, F.col("rev"), F.col("prof"), F.col("cost"), F.col("orders"))
    w = {"SaleTotal": F.col("rev"), "Profit": F.col("prof")}.get(metric, v)
    return g.select("row_label", "col_label", v.alias("value"), w.alias("_w"))


def _top(cells: DataFrame, axis: str, n: int) -> DataFrame:
    """T3 + F14 / J8: keep the cells of the top-N labels (left semi join to the top-N set)."""
    keep = (cells.groupBy(axis).agg(F.sum(F.abs("_w")).alias("_a"))
                 .orderBy(F.col("_a").desc(), F.col(axis)).limit(n).select(axis))
    return join_on(cells, keep, [axis], "left_semi")


def _places(totals: DataFrame, order: Sequence[Column], out: str, few: bool) -> DataFrame:
    """0-based place of each label: one window where labels are few by a fixed bound, else the distributed order."""
    if few:
        return totals.withColumn(out, (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))
    return global_order(totals, order, "_place").withColumn(out, (F.col("_place") - 1).cast("int")).drop("_place")


def heatmap_grid(df: DataFrame, row_col: str, col_col: str, metric: str = "SaleTotal",
                 top_rows: int | None = None, top_cols: int | None = None) -> DataFrame:
    """Metric per cell with top-N rows then top-N columns (T3), row / column totals and
    axis order (rows ascending, columns descending by total, label breaks ties: T10)."""
    # The cells (bounded by the label cardinalities) are read several times below: pinned
    # once so the fact is scanned once.
    cells = _pin(grid_cells(df, row_col, col_col, metric))
    if top_rows:
        cells = _top(cells, "row_label", top_rows)
    if top_cols:
        cells = _top(cells, "col_label", top_cols)
    # Axis totals are aggregates (partial + final), not windows: a few columns (sports) may
    # each span every affiliate, which a window partitioned by the column would put in one task.
    rows = cells.groupBy("row_label").agg(F.sum("_w").alias("_rt"))
    cols = cells.groupBy("col_label").agg(F.sum("_w").alias("_ct"))
    rows = _places(rows, [F.col("_rt").asc(), F.col("row_label").asc()], "row_order", top_rows is not None or row_col in FEW_LABELS)
    cols = _places(cols, [F.col("_ct").desc(), F.col("col_label").asc()], "col_order", top_cols is not None or col_col in FEW_LABELS)
    out = join_on(join_on(cells, rows, ["row_label"]), cols, ["col_label"])
    return out.select("row_label", "col_label", "value",
                      F.col("_rt").cast("double").alias("row_total"), F.col("_ct").cast("double").alias("col_total"),
                      "row_order", "col_order")


def shared_range(cell_frames: Sequence[DataFrame]) -> DataFrame:
    """(0, zmax) over the non-zero finite cells of several grids; zmax is their 98th
    percentile when positive, else their maximum, else 1."""
    vals = None
    for c in cell_frames:
        part = c.select(F.col("value").cast("double").alias("value"))
        vals = part if vals is None else vals.unionByName(part)
    vals = _pin(vals.where((F.col("value") != 0) & ~F.isnan("value")
                           & (F.abs("value") != F.lit(float("inf")))))
    p98 = quantiles(vals, [], "value", {"p98": 0.98}).select("p98").scalar()
    mx = vals.agg(F.max("value").alias("m")).select("m").scalar()
    zmax = (F.when(p98 > 0, p98).when(mx.isNotNull() & (mx != 0), mx).otherwise(F.lit(1.0)))
    return vals.sparkSession.range(1).select(F.lit(0.0).alias("zmin"), zmax.alias("zmax"))


def max_abs_range(cell_frames: Sequence[DataFrame]) -> DataFrame:
    """A17 (alternative): (0, max |v|) over the cells, 1 when there are none."""
    vals = None
    for c in cell_frames:
        part = c.select(F.abs(F.col("value").cast("double")).alias("a"))
        vals = part if vals is None else vals.unionByName(part)
    return vals.agg(F.lit(0.0).alias("zmin"), F.coalesce(F.max("a"), F.lit(1.0)).alias("zmax"))


def intensity(cells: DataFrame, zmax: Column, metric: str = "SaleTotal", label_share: float = 0.03) -> DataFrame:
    """Colour position ``v / zmax``, whether the cell gets a label (|v| at least
    ``label_share`` of zmax, non-zero), the label text and whether the text is light."""
    # The scalar subquery is evaluated once into a column and referenced from there.
    cells = cells.withColumn("_z", zmax)
    zmax = F.col("_z")
    v = F.col("value")
    inten = F.when(zmax > 0, v / zmax).otherwise(F.lit(0.0))
    threshold = F.when(zmax > 0, zmax * label_share).otherwise(F.lit(0.0))
    shown = (v != 0) & ~F.isnan(v) & (F.abs(v) >= threshold)
    text = (pct(v) if M.METRIC_IS_RATIO.get(metric) else compact_money(v))
    return cells.select("row_label", "col_label", "value", inten.alias("intensity"),
                        shown.alias("labeled"), F.when(shown, text).alias("label"),
                        (inten > 0.5).alias("light_text"))


def day_hour_grid(df: DataFrame) -> DataFrame:
    """Dense 7 x 24 grid (Monday first) with every metric; empty cells are 0."""
    cells = (df.where(F.col("SellDate_dt").isNotNull())
               .groupBy(F.col("SellDayOfWeek").alias("day"), F.col("SellHour").alias("hour"))
               .agg(*M.component_aggs()))
    days = F.array(*[F.lit(d) for d in DAYS_ORDER])
    axis = (df.sparkSession.range(len(DAYS_ORDER) * 24)
              .select((F.col("id") / 24).cast("int").alias("day_order"), (F.col("id") % 24).cast("int").alias("hour"))
              .withColumn("day", F.element_at(days, F.col("day_order") + 1)))
    out = axis.join(F.broadcast(cells), ["day", "hour"], "left")
    zero = M.zero()
    rev, prof, cost = (F.coalesce(F.col(c), zero) for c in ("rev", "prof", "cost"))
    return out.select("day", "day_order", "hour",
                      rev.cast("double").alias("revenue"), prof.cast("double").alias("profit"),
                      M.guarded_pct(prof, rev).alias("margin"), M.guarded_pct(prof, cost).alias("ratio"),
                      F.coalesce(F.col("orders"), F.lit(0).cast("bigint")).alias("orders"))


def time_pivot(df: DataFrame, value_col: str = "SaleTotal") -> DataFrame:
    """A32 (legacy): day x hour sums rounded to whole units, long form, Monday first.

    A row for each day of the week and each hour that has orders; a day's hours without orders are
    0, and all hours of a day without orders are null."""
    cells = (df.where(F.col("SellDayOfWeek").isNotNull() & F.col("SellHour").isNotNull())
               .groupBy(F.col("SellDayOfWeek").alias("day"), F.col("SellHour").alias("hour"))
               .agg(F.round(M.dsum(value_col), 0).cast("double").alias("_v")))
    days = F.array(*[F.lit(d) for d in DAYS_ORDER])
    # At most 24 hours: the sums are collected per hour into a map by day, then read for all seven days.
    hours = cells.groupBy("hour").agg(F.map_from_entries(F.collect_list(F.struct("day", "_v"))).alias("_by_day"))
    seen = cells.agg(F.collect_set("day").alias("d")).select("d").scalar()
    rows = hours.withColumn("_seen", seen).select("hour", "_by_day", "_seen", F.posexplode(days).alias("day_order", "day"))
    value = F.coalesce(F.try_element_at("_by_day", F.col("day")), F.when(F.array_contains("_seen", F.col("day")), 0.0))
    return rows.select("day", "hour", value.alias("value"), F.col("day_order").cast("bigint").alias("day_order"))


def state_metric(df: DataFrame) -> DataFrame:
    """Every metric per (non-null) state."""
    g = df.where(F.col("State").isNotNull()).groupBy("State").agg(*M.component_aggs())
    return g.select(F.col("State").alias("state"), *[
        M.metric_from(m, F.col("rev"), F.col("prof"), F.col("cost")).alias(a)
        for m, a in (("SaleTotal", "revenue"), ("Profit", "profit"), ("Margin", "margin"), ("Ratio", "ratio"))])


def state_shared_range(df: DataFrame, slice_col: str = "YearLabel") -> DataFrame:
    """Per metric, (0, max(1, largest per-state value over the slices))."""
    g = (df.where(F.col("State").isNotNull() & F.col(slice_col).isNotNull())
           .groupBy(slice_col, "State").agg(*M.component_aggs()))
    mets = (("SaleTotal", "revenue"), ("Profit", "profit"), ("Margin", "margin"), ("Ratio", "ratio"))
    mx = g.agg(*[F.max(M.metric_from(m, F.col("rev"), F.col("prof"), F.col("cost"))).alias(a) for m, a in mets])
    rows = F.array(*[F.struct(F.lit(a).alias("metric"), F.lit(0.0).alias("zmin"),
                              F.greatest(F.coalesce(F.col(a), F.lit(0.0)), F.lit(1.0)).alias("zmax"))
                     for _, a in mets])
    return mx.select(F.inline(rows))


def cross_tab(df: DataFrame, sports: Sequence[str] = SPORTS) -> DataFrame:
    """Per affiliate, revenue per sport and margin per sport (0 where no revenue).

    The sport vocabulary is fixed, so the pivot needs no distinct pass."""
    aggs = []
    for sp in sports:
        cond = F.col("Sport") == sp
        aggs += [M.dsum("SaleTotal", cond).alias(f"_r_{sp}"), M.dsum("Profit", cond).alias(f"_p_{sp}")]
    g = df.where(F.col("CompanyName").isNotNull()).groupBy("CompanyName").agg(*aggs)
    cols = [F.col("CompanyName").alias("affiliate")]
    cols += [F.col(f"_r_{sp}").cast("double").alias(f"revenue_{sp.lower()}") for sp in sports]
    cols += [M.guarded_pct(F.col(f"_p_{sp}"), F.col(f"_r_{sp}")).alias(f"margin_{sp.lower()}") for sp in sports]
    return g.select(*cols)


def pivot_wide(cells: DataFrame, col_values: Sequence[str], value: str = "value") -> DataFrame:
    """U3 at the edge: long cells to one column per label, with explicit values, zero filled."""
    return (cells.groupBy("row_label").pivot("col_label", list(col_values)).agg(F.first(value))
                 .na.fill(0.0))
