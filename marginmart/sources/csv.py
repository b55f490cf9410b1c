"""Raw CSV exports: two yearly files -> one typed, enriched DataFrame.

S1 ``load_one``: header CSV read with every column as text, selected *by name* (Spark
applies an explicit schema by position, which silently scrambles files whose column
order differs), stamped with ``YearLabel``.
U1 ``harmonize``: union by name, missing columns null, columns sorted.
S4 ``load_combined``: S1 twice + U1 + coercion + dimension lookups + enrichment.
S7 ``check_inputs``: both inputs present and non-empty (one ``limit(1)`` probe each).

A line that is no record of the export does not stop a load: it is set aside (``bad_records``) with
its file and the reason, and counted; a line that only ends early is a record whose last columns
are null.  Each export's own dates decide whether its numeric dates put the day or the month first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import enrich as E
from . import dims

# FIXED VALUES — the raw export's column contract (extra columns are ignored by
# the enrichment but kept by the union).
RAW_COLUMNS = ("SellDate", "EventDate", "EventTime", "SaleTotal", "TicketCost", "Quantity",
               "CompanyName", "PrimaryPerformerName", "SecondaryPerformerName",
               "RequestedPerformerTypeId", "VenueName", "Section", "Seats", "ShippingCompany",
               "DeliveryType", "IsDelivered", "IsCancelled", "IsExpired", "InvoiceID", "EventName")
FLAG_COLUMNS = ("IsCancelled", "IsDelivered", "IsExpired", "IsConsecutive")
STRAY_COLUMN = "Unnamed: 0"


class InputError(ValueError):
    """Raised when an input export is missing or has no rows."""


# Compression codecs whose files Spark cannot split: one task would read (and, without a
# shuffle, process) the whole file.
UNSPLITTABLE = (".gz", ".gzip", ".zst", ".zstd", ".lz4", ".snappy", ".deflate")


# FIXED VALUES — texts that stand for a missing value.
NULL_TEXTS = ("", "NA", "N/A", "NULL", "null", "NaN", "nan", "n/a", "#N/A", "None", "<NA>")


# Columns of a read that the loader itself uses.
BAD, FILE = "_bad_record", "_file"
DATE_COLUMNS = ("SellDate", "EventDate")


@dataclass(frozen=True)
class Export:
    """One export: its records, and the lines that are none (file, line, reason)."""

    rows: DataFrame
    bad: DataFrame


def read_export(spark: SparkSession, path: str, multi_line: bool = False) -> Export:
    """Header CSV, all columns as text (no inference), blank lines skipped.

    Quoted fields may hold separators and doubled quotes.  With ``multi_line`` they may hold line
    breaks too, and a file is then read by one task.  A line with the header's number of fields is a
    record; one with fewer is filled up with nulls, unless a quote does not close on it: then, and
    with more fields, it is set aside.  A line of separators alone is an order without values and stays.

    Plain and bzip2 files are split by Spark across tasks.  A file in an unsplittable codec
    is read by one task, so its rows are spread round-robin over the shuffle partitions
    right after the read (one exchange) instead of leaving all enrichment work in that task.
    """
    def reader():
        return (spark.read.option("header", True).option("inferSchema", False)
                .option("quote", '"').option("escape", '"').option("multiLine", multi_line))
    names = reader().csv(path).columns
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, BAD])
    # A line's fields are counted only when no column is pruned from the parser.
    df = (reader().schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
          .option("columnPruning", False).csv(path).withColumn(FILE, F.col("_metadata.file_path")))
    if multi_line or str(path).lower().endswith(UNSPLITTABLE):
        df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    # Outside of quoted parts: a quote that is left has no partner, and separators count the fields.
    bare = F.regexp_replace(BAD, '"([^"]|"")*"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(","))) + 1
    # Spark reads the set-aside text only along with a column of the file, so the test names one; a parsed text is never that.
    other = F.coalesce(F.col(f"`{names[0]}`") == "\0", F.lit(False))
    reason = (F.when(F.col(BAD).isNull() & ~other, F.lit(None)).when(F.contains(bare, F.lit('"')), "quote not closed")
              .when(fields > len(names), "too many fields"))
    marked = df.withColumn("_reason", reason)
    bad = marked.where(F.col("_reason").isNotNull()).select(F.col(FILE).alias("file"), F.col(BAD).alias("line"), F.col("_reason").alias("reason"))
    rows = marked.where(F.col("_reason").isNull()).drop(BAD, FILE, "_reason", STRAY_COLUMN)     # S2
    return Export(missing_to_null(rows), bad)


def read_raw(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The records of one export (see :func:`read_export`)."""
    return read_export(spark, path, multi_line).rows


def bad_records(spark: SparkSession, this_path: str, last_path: str, multi_line: bool = False) -> DataFrame:
    """The lines of both exports that are no records: YearLabel, file, line, reason."""
    parts = [read_export(spark, path, multi_line).bad.withColumn("YearLabel", F.lit(label))
             for path, label in ((this_path, E.THIS_YEAR), (last_path, E.LAST_YEAR))]
    return parts[0].unionByName(parts[1]).select("YearLabel", "file", "line", "reason")


def load_report(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """What became of a load's lines and values, counted: YearLabel, item, kind, n.

    Items are ``line`` (records, and set-aside lines by reason) and each money column (by
    :func:`marginmart.functions.enrich.number_kind`)."""
    lines = bad.groupBy("YearLabel", F.lit("line").alias("item"), F.col("reason").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    items = F.array(F.struct(F.lit("line").alias("item"), F.lit("record").alias("kind")),
                    *[F.struct(F.lit(c).alias("item"), E.number_kind(c).alias("kind")) for c in ("SaleTotal", "TicketCost")])
    kinds = rows.select("YearLabel", F.inline(items)).groupBy("YearLabel", "item", "kind").agg(F.count(F.lit(1)).alias("n"))
    return kinds.unionByName(lines)


def missing_to_null(df: DataFrame) -> DataFrame:
    """Texts that stand for a missing value become null, in every column."""
    return df.withColumns({c: F.when(~F.trim(F.col(f"`{c}`")).isin(*NULL_TEXTS), F.col(f"`{c}`")) for c in df.columns})


def load_one(spark: SparkSession, path: str, year_label: str, multi_line: bool = False) -> DataFrame:
    """Read one export and stamp it; any year column in the file is ignored."""
    return stamp(read_raw(spark, path, multi_line), year_label)


def stamp(rows: DataFrame, year_label: str) -> DataFrame:
    """The year label, and for each date column the order of day and month that this export's dates vote for."""
    dates = [c for c in DATE_COLUMNS if c in rows.columns]
    out = rows.withColumn("YearLabel", F.lit(year_label))
    if dates:
        votes = rows.agg(F.struct(*[E.prefers_day_first(c).alias(c) for c in dates]).alias("v")).select("v").scalar()
        out = out.withColumns({f"_day_first_{c}": votes[c] for c in dates})
    return out


def harmonize(this_df: DataFrame, last_df: DataFrame) -> DataFrame:
    """Union by name, missing columns as null, columns in sorted order."""
    cols = sorted(set(this_df.columns) | set(last_df.columns))
    return this_df.unionByName(last_df, allowMissingColumns=True).select(*cols)


def check_inputs(this_df: DataFrame, last_df: DataFrame) -> None:
    """Both inputs must hold at least one row (a bounded probe, not a count)."""
    for label, df in (("this year", this_df), ("last year", last_df)):
        if not df.limit(1).take(1):
            raise InputError(f"the {label} file has no rows")


def coerce(df: DataFrame) -> DataFrame:
    """Text columns to typed ones. Missing contract columns are null; flags
    that are not in the input stay out."""
    for c in RAW_COLUMNS:
        if c not in df.columns and c not in FLAG_COLUMNS:
            df = df.withColumn(c, F.lit(None).cast("string"))
    dates = {c: F.col(f"_day_first_{c}") if f"_day_first_{c}" in df.columns else None for c in DATE_COLUMNS} | {"EventTime": None}
    df = E.date_parts(df, dates)
    typed = {
        "SaleTotal": E.money("SaleTotal"),
        "TicketCost": E.money("TicketCost"),
        "Quantity": E.int_trunc("Quantity"),
        "RequestedPerformerTypeId": E.type_id("RequestedPerformerTypeId"),
        **{f"{c}_dt": E.timestamp(c, dates[c], parts=True) for c in DATE_COLUMNS},
        "EventHour": F.hour(E.timestamp("EventTime", parts=True)),
    }
    for c in FLAG_COLUMNS:
        if c in df.columns:
            typed[c] = E.flag(c)
    # Empty text is missing text, as in a CSV reader that maps empty fields to null.
    for c in ("CompanyName", "PrimaryPerformerName", "SecondaryPerformerName", "VenueName",
              "ShippingCompany", "DeliveryType", "EventName", "InvoiceID"):
        typed[c] = F.when(F.trim(F.col(c)) != "", F.col(c))
    return E.without_date_parts(df.withColumns(typed), dates).drop(*[f"_day_first_{c}" for c in DATE_COLUMNS])


def lookup_dims(df: DataFrame, spark: SparkSession | None = None, droppable: bool = False) -> DataFrame:
    """E21-E23 via J1-J3: sport (type id, else team, else Other), state by home team, tier by marketplace.

    The three dimension tables are fixed-size, so each is a broadcast hash join; their
    keys are unique, so the joins never multiply rows.  With ``droppable`` each is grouped by its key, which tells
    Spark so: it leaves out a lookup that a query does not read, and with it the columns that the lookup would
    carry through every join.
    """
    spark = spark or df.sparkSession
    unique = lambda dim, key: F.broadcast(dim.coalesce(1).dropDuplicates([key]) if droppable else dim)
    sport = unique(dims.sport_dim(spark), "type_id")
    team = unique(dims.team_dim(spark), "team")
    market = unique(dims.marketplace_dim(spark), "marketplace")
    out = (df.join(sport, F.col("RequestedPerformerTypeId") == F.col("type_id"), "left")
             .join(team, F.col("PrimaryPerformerName") == F.col("team"), "left")
             .join(market, F.col("ShippingCompany") == F.col("marketplace"), "left"))
    out = out.withColumns({
        "Sport": F.coalesce(F.col("type_sport"), F.col("team_sport"), F.lit("Other")),
        "State": F.col("team_state"),
        "MarketplaceTier": F.coalesce(F.col("tier"), F.lit("Other")),
    })
    return out.drop("type_id", "type_sport", "team", "team_sport", "team_state", "marketplace", "tier")


def load_combined(spark: SparkSession, this_path: str, last_path: str, check: bool = True,
                  multi_line: bool = False) -> DataFrame:
    """Both exports, unioned, coerced, looked up and enriched (one lazy plan)."""
    raw = [read_raw(spark, path, multi_line) for path in (this_path, last_path)]
    if check:       # before the stamp, which would count the votes of a whole file for the probe
        check_inputs(*raw)
    combined = harmonize(*[stamp(rows, label) for rows, label in zip(raw, (E.THIS_YEAR, E.LAST_YEAR))])
    return E.enrich(lookup_dims(coerce(combined), spark))
