"""Sinks and materialisation.

``materialize`` is the cached-load step: the enriched fact is written once as Parquet,
partitioned by ``YearLabel`` (so year-sliced queries prune whole directories), under the
shared checkpoint folder the cluster names in ``spark.checkpoint.dir``, then read back.
That cuts the lineage (a lost executor re-reads files instead of re-running the joins)
and never uses a machine-local folder on a cluster.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_on
from ..operators.ordering import global_order
from ..session import ensure_checkpoint_dir

# Codec of the tables that are written to be read again.
COMPRESSION = "zstd"


def materialize(df: DataFrame, name: str = "enriched", partition_by: str | None = "YearLabel",
                cluster_by: tuple[str, ...] = ("CompanyName",)) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Rows are sorted within each write task by ``cluster_by`` (the affiliate, the source's
    main filter), so each Parquet row group holds a narrow affiliate range and an affiliate
    scope skips most row groups through the pushed-down filter's min / max statistics.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/marginmart-{name}-{uuid.uuid4().hex}"
    keys = [c for c in ((partition_by,) if partition_by else ()) + tuple(cluster_by) if c in df.columns]
    if keys:
        df = df.sortWithinPartitions(*keys)
    writer = df.write.mode("overwrite").option("compression", COMPRESSION)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.parquet(path)
    # Keep the original column order (partition columns come back last).
    return out.select(*df.columns)


# Bits of each column's rank in an interleaved key.
RANK_BITS = 10


def interleaved(df: DataFrame, first: str, second: str, bits: int = RANK_BITS) -> tuple[DataFrame, Column]:
    """``df`` with the ranks of two columns' values (``_r1``, ``_r2``, scaled to ``bits`` bits by the values' order),
    and the key that interleaves their bits.

    The distinct values are ranked by the distributed order; they join back under Spark's size check.
    A null has rank 0."""
    out = df
    for name, c in (("_r1", first), ("_r2", second)):
        # The share of rows before a value, so that a common value takes more of the key's range.
        totals = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        placed = global_order(totals, [F.col(c).asc()], "_place", {"_upto": "_n"})
        rows = placed.agg(F.max("_upto").alias("n")).select("n").scalar()
        rank = F.floor((F.col("_upto") - F.col("_n")) / rows * (1 << bits)).cast("bigint")
        out = join_on(out, placed.select(c, rank.alias(name)), [c], "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    bit = lambda r, k: F.shiftright(F.col(r), k).bitwiseAND(F.lit(1))
    key = sum((F.shiftleft(bit("_r1", k), 2 * k + 1) + F.shiftleft(bit("_r2", k), 2 * k) for k in range(bits)), F.lit(0).cast("bigint"))
    return out, key


def materialize_interleaved(df: DataFrame, first: str = "CompanyName", second: str = "Sport", name: str = "interleaved",
                            partition_by: str | None = "YearLabel") -> DataFrame:
    """:func:`materialize`, clustered for two filters at once.

    Rows are range-partitioned and sorted by (year label, interleaved bits of the two columns' ranks), so a
    row group holds a narrow range of both columns, and a filter on either skips row groups by their
    minima and maxima; a sort by one column serves that column alone.  A value with many rows spans
    many partitions, as the key goes on with the other column's rank and the invoice id.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/marginmart-{name}-{uuid.uuid4().hex}"
    keyed, key = interleaved(df, first, second)
    order = [*([partition_by] if partition_by else []), "_z", first, second, *(["InvoiceID"] if "InvoiceID" in df.columns else [])]
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    keyed = keyed.withColumn("_z", key).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_r1", "_r2", "_z")
    writer = keyed.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.parquet(path).select(*df.columns)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV export, written in parallel by the executors."""
    df.write.mode(mode).option("header", True).csv(path)
