"""Sources: the star-table sales mart, raw CSV exports, dimension tables, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.enrich import enrich
from .csv import lookup_dims
from .mart import sales_mart


def load_enriched(spark: SparkSession, sf_dir: str, year: str | None = None, droppable: bool = False) -> DataFrame:
    """Sales mart of ``sf_dir`` (or one year label of it) with the looked-up and every derived column (one lazy plan).

    ``droppable``: Spark leaves out lookups that the caller does not read (:func:`csv.lookup_dims`)."""
    return enrich(lookup_dims(sales_mart(spark, sf_dir, year), droppable=droppable))


__all__ = ["load_enriched", "sales_mart"]
