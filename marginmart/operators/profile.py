"""Dataset profile and exports.

The missingness scan is ONE aggregation with a ``count_if(isnull)`` per column, then an
unpivot of that single row; it never scans once per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions import metrics as M
from ..functions.enrich import LAST_YEAR, THIS_YEAR
from ..sources.sinks import write_csv


def profile_dates(df: DataFrame) -> DataFrame:
    """Rows, columns, sale / event date range, rows per year."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
                  F.min("SellDate_dt").alias("sell_min"), F.max("SellDate_dt").alias("sell_max"),
                  F.min("EventDate_dt").alias("event_min"), F.max("EventDate_dt").alias("event_max"),
                  F.count_if(F.col("YearLabel") == THIS_YEAR).alias("this_year_rows"),
                  F.count_if(F.col("YearLabel") == LAST_YEAR).alias("last_year_rows"))


def missingness(df: DataFrame) -> DataFrame:
    """Null (or NaN) count and percent per column, only columns with any, most first."""
    cols = df.columns

    def missing(c: str):
        col = F.col(f"`{c}`")
        if isinstance(df.schema[c].dataType, (DoubleType, FloatType)):
            return F.count_if(col.isNull() | F.isnan(col))
        return F.count_if(col.isNull())
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[missing(c).alias(f"m{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"'{c}', m{i}" for i, c in enumerate(cols))
    long = one.selectExpr("_rows", f"stack({len(cols)}, {pairs}) as (column_name, missing)")
    return (long.where(F.col("missing") > 0)
                .select("column_name", "missing", (F.col("missing") / F.col("_rows") * 100).alias("pct"))
                .orderBy(F.col("missing").desc(), "column_name"))


def export_rollup(df: DataFrame) -> DataFrame:
    """By (affiliate, performer, YEAR, MONTH) with null keys dropped: profit, tickets
    and revenue sums and the mean row margin (rounded to 6 decimals)."""
    d = (df.withColumn("MONTH", F.month("SellDate_dt"))
           .where(F.col("CompanyName").isNotNull() & F.col("PrimaryPerformerName").isNotNull()
                  & F.col("YEAR").isNotNull() & F.col("MONTH").isNotNull()))
    g = d.groupBy("CompanyName", "PrimaryPerformerName", "YEAR", "MONTH").agg(
        M.dsum("Profit").cast("double").alias("Profit"),
        F.coalesce(F.sum(F.col("TicketsSold").cast("bigint")), F.lit(0).cast("bigint")).alias("TicketsSold"),
        M.dsum("SaleTotal").cast("double").alias("SaleTotal"),
        F.round(F.avg("ProfitMargin"), 6).alias("ProfitMargin"))
    return g


def filtered_total(df: DataFrame) -> DataFrame:
    """Total revenue of the export rollup's last-year rows (exact sum)."""
    d = (df.withColumn("MONTH", F.month("SellDate_dt"))
           .where(F.col("CompanyName").isNotNull() & F.col("PrimaryPerformerName").isNotNull()
                  & (F.col("YEAR") == "last_year") & F.col("MONTH").isNotNull()))
    return d.agg(M.dsum("SaleTotal").cast("double").alias("last_year_revenue"))


def export_csv(df: DataFrame, path: str) -> None:
    """Write the export rollup as header CSV."""
    write_csv(export_rollup(df), path)
