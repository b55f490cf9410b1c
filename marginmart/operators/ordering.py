"""Global rank and running sums over a table of any size.

``row_number() over (order by ..)`` without a partition key moves every row into one task.
That is fine for a dozen months but not for one row per affiliate when affiliates number
in the millions.  ``global_order`` gives the same result with bounded tasks:

1. range-partition by the (total) order and sort within partitions, pinned by a reliable
   checkpoint so every later step sees the same cut;
2. per partition, the row count and the sums (one row per partition), turned into offsets by
   a prefix sum over those few rows (broadcast);
3. inside each partition, ``row_number`` / running sums over a window partitioned by the
   partition id (each task holds one range partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_on
from .quantiles import _num_partitions, _pin


def global_order(df: DataFrame, order: Sequence[Column], rank_col: str = "rank",
                 running: dict[str, str] | None = None, num_partitions: int | None = None) -> DataFrame:
    """Add ``rank_col`` (1-based position in ``order``, which must be a total order) and, for
    each ``{out: source}`` in ``running``, the running sum of ``source`` up to and including
    the row.
    """
    running = running or {}
    n = num_partitions or _num_partitions(df)
    s = _pin(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
               .withColumn("_pid", F.spark_partition_id()))
    tot = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"),
                                *[F.sum(src).alias(f"_s_{out}") for out, src in running.items()])
    prev = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tot.select("_pid", F.coalesce(F.sum("_n").over(prev), F.lit(0)).alias("_off_n"),
                         *[F.coalesce(F.sum(f"_s_{out}").over(prev), F.lit(0)).alias(f"_off_{out}")
                           for out in running])
    within = Window.partitionBy("_pid").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = s.withColumn("_rn", F.row_number().over(within))
    for out, src in running.items():
        local = local.withColumn(f"_r_{out}", F.sum(src).over(upto))
    out_df = join_on(local, offsets, ["_pid"], broadcast=True)
    cols = [c for c in df.columns]
    extra = [(F.col("_off_n") + F.col("_rn")).alias(rank_col)]
    extra += [(F.col(f"_off_{out}") + F.col(f"_r_{out}")).alias(out) for out in running]
    return out_df.select(*cols, *extra)
