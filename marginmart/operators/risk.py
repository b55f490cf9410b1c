"""Delivery, cancellation and loss risk.

All one-pass conditional aggregates (``count_if``, conditional sums), so a hot affiliate
is pre-combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from .quantiles import quantiles


def delivery_kpis(df: DataFrame) -> DataFrame:
    """Total, delivered, undelivered, cancelled, expired and delivery rate."""
    g = df.agg(F.count(F.lit(1)).alias("total"), F.count_if("IsDelivered").alias("delivered"),
               F.count_if("IsCancelled").alias("cancelled"), F.count_if("IsExpired").alias("expired"))
    return g.select("total", "delivered", (F.col("total") - F.col("delivered")).alias("undelivered"),
                    "cancelled", "expired",
                    F.when(F.col("total") > 0, F.col("delivered") / F.col("total") * 100).otherwise(0.0)
                    .alias("delivery_rate"))


def undelivered_by_affiliate(df: DataFrame) -> DataFrame:
    """A35 (F11): undelivered orders (non-null invoice ids) and lost revenue per affiliate."""
    d = df.where(~F.coalesce(F.col("IsDelivered"), F.lit(False)) & F.col("CompanyName").isNotNull())
    return (d.groupBy("CompanyName").agg(F.count("InvoiceID").alias("undelivered"),
                                         M.dsum("SaleTotal").cast("double").alias("lost_revenue"))
             .withColumnRenamed("CompanyName", "affiliate").orderBy(F.col("lost_revenue").desc(), "affiliate"))


def cancellations_by_affiliate(df: DataFrame) -> DataFrame:
    """Cancelled orders and lost revenue per affiliate."""
    d = df.where(F.coalesce(F.col("IsCancelled"), F.lit(False)) & F.col("CompanyName").isNotNull())
    return (d.groupBy("CompanyName").agg(F.count("InvoiceID").alias("cancellations"),
                                         M.dsum("SaleTotal").cast("double").alias("lost_revenue"))
             .withColumnRenamed("CompanyName", "affiliate").orderBy(F.col("cancellations").desc(), "affiliate"))


def delivery_rate_by_affiliate(df: DataFrame) -> DataFrame:
    """Orders, delivered orders and delivery rate per affiliate (lowest rate first)."""
    g = (df.where(F.col("CompanyName").isNotNull()).groupBy("CompanyName")
           .agg(F.count("InvoiceID").alias("orders"), F.count_if("IsDelivered").alias("delivered")))
    return (g.select(F.col("CompanyName").alias("affiliate"), "orders", "delivered",
                     F.when(F.col("orders") > 0, F.col("delivered") / F.col("orders") * 100).alias("delivery_rate"))
             .orderBy("delivery_rate", "affiliate"))


def loss_profile(df: DataFrame, min_orders: int = 50, n: int = 15) -> DataFrame:
    """A44 (+F10, F13, J4 in one pass): per affiliate with at least ``min_orders`` orders: loss orders, loss
    dollars, median loss, total orders and loss share; the ``n`` largest losses first."""
    d = df.where(F.col("CompanyName").isNotNull())
    loss = F.col("Profit") < 0
    out = quantiles(d, ["CompanyName"], F.when(loss, F.col("Profit")), {"median_loss": 0.5},
                    sums={"loss_orders": F.when(loss, 1).otherwise(0), "l": F.when(loss, F.col("Profit")).otherwise(M.zero()), "total_orders": F.lit(1)})
    out = out.where((F.col("loss_orders") > 0) & (F.col("total_orders") >= min_orders))
    return (out.select(F.col("CompanyName").alias("affiliate"), "loss_orders",
                       F.col("l").cast("double").alias("loss_dollars"), "median_loss", "total_orders",
                       (F.col("loss_orders") / F.col("total_orders") * 100).alias("loss_pct"))
               .orderBy("loss_dollars", "affiliate").limit(n))
