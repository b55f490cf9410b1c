"""Category shares (A6, A7, W5): value or order count per category and its share of the total.

One aggregation per share table, pinned, so the fact is scanned once; the total is an aggregate of
its rows, with partial sums, so a column with any number of categories is fine.  Null categories
are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from .quantiles import _pin


def _categories(df: DataFrame, group_col: str, null_label: str | None) -> DataFrame:
    """Null categories are dropped, or shown under ``null_label`` (the browser variant)."""
    if null_label is None:
        return df.where(F.col(group_col).isNotNull())
    return df.withColumn(group_col, F.coalesce(F.col(group_col).cast("string"), F.lit(null_label)))


def share_by(df: DataFrame, group_col: str, metric: str = "SaleTotal", null_label: str | None = None) -> DataFrame:
    """Sum of ``metric`` (SaleTotal or Profit) per category, with its share in percent."""
    g = _categories(df, group_col, null_label).groupBy(group_col).agg(M.dsum(metric).alias("_v"))
    g = _pin(g)
    total = g.agg(F.sum("_v").alias("t")).select("t").scalar()
    return g.select(F.col(group_col).alias("category"), F.col("_v").cast("double").alias("value"),
                    F.when(total != 0, F.col("_v").cast("double") / total.cast("double") * 100).alias("share_pct"))


def order_share_by(df: DataFrame, group_col: str, null_label: str | None = None) -> DataFrame:
    """Rows per category, with its share in percent."""
    g = _categories(df, group_col, null_label).groupBy(group_col).agg(F.count(F.lit(1)).alias("orders"))
    g = _pin(g)
    total = g.agg(F.sum("orders").alias("t")).select("t").scalar()
    return g.select(F.col(group_col).alias("category"), "orders",
                    F.when(total != 0, F.col("orders") / total * 100).alias("share_pct"))
