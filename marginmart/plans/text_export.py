"""Queries over the text path: the mart's rows as two exports' text columns, parsed again.

``text_exports`` only renders rows as text, the way two yearly exports hold them (numbers that are
none, blanks, missing-value spellings, several date styles, month first in one export and day first
in the other, mixed-case flags, and columns that only one of the files has).  ``written_exports`` writes them
as CSV files with lines that are too short, too long, empty or have an open quote.  The queries then
run the library's own reader, union and coercion on it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import enrich as E
from ..session import ensure_checkpoint_dir, settings
from ..sources import csv as CSV
from ..sources.mart import sales_mart

_TEXT = {
    "SaleTotal": "case InvoiceID % 11 when 0 then 'n/a' when 1 then '' when 2 then concat(' ', string(SaleTotal), ' ') else string(SaleTotal) end",
    "TicketCost": "string(TicketCost)",
    "Quantity": "case when InvoiceID % 3 = 0 then concat(string(Quantity), '.0') else string(Quantity) end",
    "CompanyName": "coalesce(CompanyName, case InvoiceID % 3 when 0 then 'NULL' when 1 then ' ' else 'N/A' end)",
    "RequestedPerformerTypeId": "concat(string(RequestedPerformerTypeId), '.0')",
    "SellDate": "case InvoiceID % 3 when 0 then date_format(SellDate_dt, 'yyyy-MM-dd HH:mm:ss') "
                "when 1 then date_format(SellDate_dt, 'M/d/yyyy H:mm') else date_format(SellDate_dt, 'M/d/yyyy h:mm a') end",
    "IsDelivered": "case when IsDelivered then case InvoiceID % 2 when 0 then ' TRUE' else 'True' end "
                   "else case InvoiceID % 2 when 0 then 'false' else '' end end",
    "IsCancelled": "string(IsCancelled)",
    "InvoiceID": "string(InvoiceID)",
}
_THIS = {"EventTime": "date_format(SellDate_dt, 'yyyy-MM-dd HH:mm:ss')", "IsExpired": "upper(string(IsExpired))"}
_LAST = {"Notes": "'x'", CSV.STRAY_COLUMN: "string(InvoiceID)",
         "SellDate": "case when InvoiceID % 7 = 0 then date_format(SellDate_dt, 'yyyyMMdd') when InvoiceID % 3 = 0 then date_format(SellDate_dt, 'yyyy-MM-dd HH:mm:ss') "
                     "when InvoiceID % 3 = 1 then date_format(SellDate_dt, 'd/M/yyyy H:mm') else date_format(SellDate_dt, 'd.M.yyyy h:mm a') end"}


def text_exports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """This year's and last year's rows as text."""
    mart = sales_mart(spark, sf_dir)
    frames = []
    for label, more in ((E.THIS_YEAR, _THIS), (E.LAST_YEAR, _LAST)):
        own = mart.where(F.col("YearLabel") == label)
        frames.append(own.select(*[F.expr(x).alias(c) for c, x in {**_TEXT, **more}.items()]))
    return frames[0], frames[1]


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both exports as a reader gives them, stamped and united by name."""
    frames = [CSV.stamp(CSV.missing_to_null(df.drop(CSV.STRAY_COLUMN)), label)
              for df, label in zip(text_exports(spark, sf_dir), (E.THIS_YEAR, E.LAST_YEAR))]
    return CSV.harmonize(*frames)


# What the written files do to an order, by its invoice id modulo 50.
SHORT, LONG, OPEN_QUOTE, AFTER_BLANK, TOO_WIDE = 7, 11, 13, 17, 19


def written_exports(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Both exports as CSV files in the shared folder, each file with its header; returns the folders to read.

    The mart is joined once for both, and the task that joins a row writes it, into a file for each export: the text
    is as wide as the mart's rows, so it is neither shuffled nor sorted.  A task's first row brings both headers along."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/marginmart-text-{uuid.uuid4().hex}"
    last = ["IsDelivered", "IsCancelled"]
    case = F.col("InvoiceID").cast("bigint") % 50
    sale = F.when(case == TOO_WIDE, "1e30").otherwise(F.col("SaleTotal"))
    csv = lambda names, own: F.to_csv(F.struct(*[sale.alias(c) if c == "SaleTotal" else F.col(own.get(c, c)).alias(c) for c in names]), {"escape": '"'})
    # Columns that each export writes in a way of its own, made for its rows alone.
    varied = {**_THIS, **_LAST}
    texts, lines, heads = {c: F.expr(x) for c, x in _TEXT.items() if c not in varied}, {}, []
    for name, label, more in (("this", E.THIS_YEAR, _THIS), ("last", E.LAST_YEAR, _LAST)):
        exprs = {**_TEXT, **more}
        own = {c: f"_{name}_{c}" for c in exprs if c in varied}
        texts |= {own[c]: F.when(F.col("YearLabel") == label, F.expr(exprs[c])) for c in own}
        cols = [c for c in exprs if c not in last]
        lines[name] = (F.when(case == SHORT, csv(cols, own)).when(case == LONG, F.concat(csv([*cols, *last], own), F.lit(",more")))
                       .when(case == OPEN_QUOTE, F.concat(csv(cols, own), F.lit(',"open')))
                       .when(case == AFTER_BLANK, F.concat(F.lit("\n"), csv([*cols, *last], own))).otherwise(csv([*cols, *last], own)))
        heads.append(F.struct(F.lit(name).alias("export"), F.lit(",".join([*cols, *last])).alias("value")))
    is_this = F.col("YearLabel") == E.THIS_YEAR
    rows = sales_mart(spark, sf_dir).select("YearLabel", *[x.alias(c) for c, x in texts.items()])
    line = F.struct(F.when(is_this, "this").otherwise("last").alias("export"), F.when(is_this, lines["this"]).otherwise(lines["last"]).alias("value"))
    # The rows of a task are numbered from 0 in the lower 33 bits.
    rows = rows.select(line.alias("line"), (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0).alias("first"))
    rows = rows.select(F.inline(F.when(F.col("first"), F.array(*heads, F.col("line"))).otherwise(F.array(F.col("line")))))
    # An export without rows has a file too.
    files = rows.unionByName(spark.range(1, numPartitions=1).select(F.inline(F.array(*heads))))
    # With a writer open for each export, Spark sorts no task's rows by export, and headers stay in front.
    with settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": "2"}):
        files.write.partitionBy("export").text(base)
    return f"{base}/export=this", f"{base}/export=last"


def csv_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written exports loaded; orders, revenue and deliveries by year and month."""
    e = CSV.load_combined(spark, *written_exports(spark, sf_dir))
    return e.groupBy("YearLabel", "SellMonth").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("SaleTotal").cast("double").alias("revenue"), F.sum("TicketsSold").cast("bigint").alias("tickets"),
        F.count_if("IsDelivered").alias("delivered"), F.count("CompanyName").alias("named"))


def csv_load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written exports' lines and money texts by what became of them."""
    this_path, last_path = written_exports(spark, sf_dir)
    rows = CSV.harmonize(CSV.load_one(spark, this_path, E.THIS_YEAR), CSV.load_one(spark, last_path, E.LAST_YEAR))
    return CSV.load_report(rows, CSV.bad_records(spark, this_path, last_path))


def coerce_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed numbers and dates by year and month."""
    typed = CSV.coerce(combined(spark, sf_dir))
    return (typed.groupBy("YearLabel", F.date_format("SellDate_dt", "yyyy-MM").alias("sell_month"), F.col("EventHour").alias("event_hour"))
                 .agg(F.count(F.lit(1)).alias("orders"), F.sum("SaleTotal").cast("double").alias("revenue"),
                      F.sum("TicketCost").cast("double").alias("cost"), F.sum("Quantity").cast("bigint").alias("tickets"),
                      F.coalesce(F.sum("RequestedPerformerTypeId"), F.lit(0)).cast("bigint").alias("type_ids"),
                      F.count("CompanyName").alias("named")))


def coerce_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by parsed flags; a flag that only this year's export has is false for last year's rows."""
    typed = CSV.coerce(combined(spark, sf_dir))
    return typed.groupBy("YearLabel", "IsDelivered", "IsCancelled", "IsExpired").agg(F.count(F.lit(1)).alias("orders"))


def harmonized_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled values of some columns by year, after the union by name."""
    both = combined(spark, sf_dir)
    filled = [F.count(c).alias(c) for c in ("SaleTotal", "CompanyName", "EventTime", "IsExpired", "Notes", "SellDate")]
    return both.groupBy("YearLabel").agg(F.count(F.lit(1)).alias("n"), *filled)


TEXT_QUERIES = {"coerce_text": coerce_text, "coerce_flags": coerce_flags, "harmonized_union": harmonized_union,
                "csv_load": csv_load, "csv_load_report": csv_load_report}
