"""Global filters and scope facts.

A scope is a lazy filter: Catalyst pushes the equality / IN predicates down to the
Parquet scan of a materialised fact (``PushedFilters``), and partition pruning skips
whole ``YearLabel`` directories for year slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.enrich import LAST_YEAR, THIS_YEAR

ALL_AFFILIATES = "All Affiliates"


def scope(df: DataFrame, affiliate: str | None = None, sports: Sequence[str] | None = None) -> DataFrame:
    """F1 + F2: affiliate equality (``None`` / 'All Affiliates' = no filter), then sport IN.

    An empty sport choice means no filter, as does choosing every sport (IN over all the
    values present keeps every row, so no distinct pass is needed to detect it).
    """
    if affiliate and affiliate != ALL_AFFILIATES:
        df = df.where(F.col("CompanyName") == affiliate)
    if sports:
        df = df.where(F.col("Sport").isin(list(sports)))
    return df


def split_years(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(this year, last year) slices."""
    return (df.where(F.col("YearLabel") == THIS_YEAR), df.where(F.col("YearLabel") == LAST_YEAR))


def pair(df: DataFrame, a: str, b: str, col: str = "CompanyName") -> DataFrame:
    """rows of two chosen values."""
    return df.where(F.col(col).isin(a, b))


def affiliate_list(df: DataFrame) -> DataFrame:
    """A56: 'All Affiliates' first, then every distinct affiliate name sorted (nulls dropped)."""
    names = df.where(F.col("CompanyName").isNotNull()).select(F.col("CompanyName").alias("affiliate")).distinct()
    first = df.sparkSession.range(1).select(F.lit(ALL_AFFILIATES).alias("affiliate"))
    return (first.withColumn("position", F.lit(0))
                 .unionByName(names.withColumn("position", F.lit(1)))
                 .orderBy("position", "affiliate"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """A56 (U2 distinct): sorted distinct non-null values of a column (e.g. the sport picker)."""
    return df.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct().orderBy("value")


def scope_counts(df: DataFrame) -> DataFrame:
    """A57 for every affiliate choice at once: rows in scope, this-year and last-year rows.

    ``rollup`` adds the 'All Affiliates' total in the same aggregation.
    """
    g = (df.rollup("CompanyName")
           .agg(F.grouping("CompanyName").alias("_all"),
                F.count(F.lit(1)).alias("rows"),
                F.count_if(F.col("YearLabel") == THIS_YEAR).alias("ty_rows"),
                F.count_if(F.col("YearLabel") == LAST_YEAR).alias("ly_rows")))
    return (g.where((F.col("_all") == 1) | F.col("CompanyName").isNotNull())
             .select(F.when(F.col("_all") == 1, F.lit(ALL_AFFILIATES)).otherwise(F.col("CompanyName")).alias("affiliate"),
                     "rows", "ty_rows", "ly_rows"))
