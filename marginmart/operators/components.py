"""A store of additive components per month (A1-A5, A24, A27, A53, A59 over U1, S4).

An export that comes late or corrected changes one month, not two years.  The store keeps, per
(month, year label, dimension, value), what every table is made of: sums of revenue, profit, cost
and tickets, counts of orders and loss orders, and two mergeable sketches (a KLL sketch of the row
margin and a HyperLogLog sketch of the invoice ids).  One scan of the fact's few columns per
dimension fills it; a changed month replaces its own partitions and reads nothing else.  All
tables are sums, and sketch merges, over the store's few rows.

The store is a Parquet table partitioned by ``month``; replacing months uses dynamic partition
overwrite, and a month without rows left is deleted.  Sums stay exact decimals, so a table from the
store equals the table from the fact to the last digit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.enrich import LAST_YEAR, THIS_YEAR
from . import compare as C

# The dimension name of a month's total.
TOTAL = ""
# Size parameters of the sketches: KLL's k (the normalised rank error is about 2.3 / k ** 0.9, for
# k = 400 about 1 % with two-sided 99 % confidence) and HyperLogLog's lg k (relative standard error 1.04 / sqrt(2 ** lg k), 1.6 %).
KLL_K, HLL_LG_K = 400, 12
# Values and months of one dimension that a task combines in memory before it sorts the rest of its rows: Spark's
# 128 are fewer than two years of months of five sports.  A pair of sketches has at most about 14 KB.
HASHED_GROUPS = 4096
HASHED_CONF = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
SUMS = ("rev", "prof", "cost", "tickets", "orders", "loss")


def components(df: DataFrame, dimensions: Sequence[str], sketches: bool = True) -> DataFrame:
    """month, year_label, dimension, value and the components; ``df`` is scanned once for the totals and once a dimension.

    A dimension of few values is combined in its scan's hash maps; grouping sets would share these among
    all dimensions, and one of many values would send the rows of all of them through a sort."""
    aggs = [M.dsum("SaleTotal").alias("rev"), M.dsum("Profit").alias("prof"), M.dsum("TicketCost").alias("cost"),
            F.coalesce(F.sum(F.col("TicketsSold").cast("bigint")), F.lit(0)).cast("bigint").alias("tickets"),
            F.count(F.lit(1)).alias("orders"), F.count_if(F.col("Profit") < 0).alias("loss")]
    if sketches:
        aggs += [F.kll_sketch_agg_double("ProfitMargin", F.lit(KLL_K)).alias("margin_sketch"),
                 F.hll_sketch_agg(F.col("InvoiceID").cast("bigint"), HLL_LG_K).alias("invoice_sketch")]
    out = None
    for name in (TOTAL, *dimensions):
        value = F.col(name).cast("string") if name != TOTAL else F.lit(None).cast("string")
        part = (df.groupBy(F.coalesce("SellMonth", F.lit("none")).alias("month"), F.coalesce("YearLabel", F.lit("none")).alias("year_label"),
                           F.lit(name).alias("dimension"), value.alias("value")).agg(*aggs))
        out = part if out is None else out.unionByName(part)
    return out


class Store:
    """The components table in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, dimensions: Sequence[str]):
        self.spark, self.path, self.dimensions = spark, path.rstrip("/"), list(dimensions)

    def replace(self, orders: DataFrame, months: Sequence[str] | None = None) -> None:
        """Put the months of ``orders`` in place of the store's; ``orders`` holds all rows of these months.  It is scanned once
        a dimension, so rows that are dear to compute should lie in files.

        ``months`` names the months meant, and rows of others are left out; one of them without rows goes."""
        if months is not None:
            orders = orders.where(F.coalesce("SellMonth", F.lit("none")).isin(list(months)))
        # Few rows a month, so one file each.
        rows = components(orders, self.dimensions).repartition("month")
        conf, before = self.spark.conf, self.spark.conf.get(HASHED_CONF, None)
        conf.set(HASHED_CONF, str(max(HASHED_GROUPS, int(before or 0))))
        try:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(self.path)
        finally:
            conf.unset(HASHED_CONF) if before is None else conf.set(HASHED_CONF, before)
        if months is not None:
            left = {r.month for r in orders.select(F.coalesce("SellMonth", F.lit("none")).alias("month")).distinct().collect()}
            for month in set(months) - left:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/month={month}")
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def read(self, dimension: str = TOTAL, months: tuple[str, str] | None = None) -> DataFrame:
        """The rows of one dimension (the totals by default), of the months from the first to the last named."""
        if dimension != TOTAL and dimension not in self.dimensions:
            raise ValueError(f"the store has no dimension {dimension!r}")
        d = self.spark.read.option("basePath", self.path).parquet(self.path).withColumn("month", F.col("month").cast("string"))
        d = d.where(F.col("dimension") == dimension)
        return d.where(F.col("month").between(*months)) if months else d

    def _by_year(self, d: DataFrame, *keys: str) -> DataFrame:
        aggs = []
        for label, s in ((THIS_YEAR, "_ty"), (LAST_YEAR, "_ly")):
            own = F.col("year_label") == label
            zero = {"rev": M.zero(), "prof": M.zero(), "cost": M.zero()}
            aggs += [F.coalesce(F.sum(F.when(own, F.col(c))), zero.get(c, F.lit(0).cast("bigint"))).alias(f"{c}{s}") for c in SUMS]
        return d.groupBy(*keys).agg(*aggs) if keys else d.agg(*aggs)

    def kpi_deltas(self) -> DataFrame:
        """A2, A3 from the totals."""
        return C.kpi_deltas_of(self._by_year(self.read()))

    def yoy_table(self, dimension: str) -> DataFrame:
        """A24 from the dimension's rows."""
        d = self.read(dimension).where(F.col("value").isNotNull())
        g = self._by_year(d, "value")
        return g.select(F.col("value").alias(dimension), *C._yoy_columns()).orderBy(F.col("revenue_ty").desc(), dimension)

    def yoy_compare(self, dimension: str, metric: str = "SaleTotal") -> DataFrame:
        """A5 from the dimension's rows."""
        g = self._by_year(self.read(dimension).where(F.col("value").isNotNull()), "value")
        of = lambda s: M.metric_from(metric, *(F.col(f"{c}{s}") for c in ("rev", "prof", "cost", "orders")))
        g = g.select("value", of("_ty").alias("v_ty"), of("_ly").alias("v_ly"))
        return g.select(F.col("value").alias("group_value"), F.expr(f"stack(2, '{LAST_YEAR}', v_ly, '{THIS_YEAR}', v_ty) as (year_label, value)"))

    def monthly(self) -> DataFrame:
        """The months' components in order."""
        d = self.read().where(F.col("month") != "none")
        g = d.groupBy("month").agg(*[F.sum(c).alias(c) for c in SUMS])
        return g.select(F.col("month").alias("year_month"), F.col("rev").cast("double").alias("revenue"), F.col("prof").cast("double").alias("profit"),
                        M.guarded_pct(F.col("prof"), F.col("rev")).alias("margin"), M.guarded_pct(F.col("prof"), F.col("cost")).alias("ratio"),
                        F.col("orders")).orderBy("year_month")

    def margin_quantiles(self, dimension: str = TOTAL, probs: Sequence[float] = (0.1, 0.5, 0.9), months: tuple[str, str] | None = None) -> DataFrame:
        """A53 (approximate): quantiles of the row margin per value, from merged sketches; the rank error is KLL's for k = ``KLL_K``."""
        d = self.read(dimension, months)
        g = d.groupBy("value").agg(F.kll_merge_agg_double("margin_sketch").alias("s"))
        n = F.kll_sketch_get_n_double("s")
        return g.select("value", n.alias("n"), *[F.when(n > 0, F.kll_sketch_get_quantile_double("s", F.lit(float(p)))).alias(f"p{round(100 * p):02d}") for p in probs])

    def distinct_invoices(self, dimension: str = TOTAL, months: tuple[str, str] | None = None) -> DataFrame:
        """A59 (approximate): different invoices per value over any months, from united sketches."""
        d = self.read(dimension, months)
        return d.groupBy("value").agg(F.hll_sketch_estimate(F.hll_union_agg("invoice_sketch")).alias("invoices"))
