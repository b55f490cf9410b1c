"""Sales mart built from the star tables of a scale-factor folder.

One row per ``lineitem`` row, shaped like the raw order export the enrichment expects
(``SaleTotal``, ``TicketCost``, ``Quantity``, ``Section``, ``Seats``, flags, dates, ...).
The mart only renames and re-types star-schema attributes into that schema; every
derived business column (profit, margins, calendar, lead time, sections, buckets) is
computed afterwards by :func:`marginmart.functions.enrich.enrich`.

Scale notes
-----------
* Every table is read with only the columns used, so the Parquet scans prune columns.
* ``nation`` (25 rows) and ``region`` (5 rows) are fixed-size and are broadcast explicitly.
* ``customer``, ``part`` and ``supplier`` grow with the data: no hint is given, so Spark's
  size-checked ``autoBroadcastJoinThreshold`` and AQE choose between broadcast and
  shuffle joins at run time.
* ``customer`` joins ``orders`` before ``lineitem`` does: where ``customer`` is too large to
  broadcast, the orders cross the network on the customer key, not the several times as many
  and wider line items.
* A line item crosses the network once for each table too large to broadcast, with the columns of
  the joins before.  ``supplier`` adds one column and ``orders`` (with ``customer``) the most, so they
  join first and last; with a year, ``orders`` joins first, as it drops the other year's line items.
* What one table's columns make (money, counts, flags, names) is made before that table's rows join, so
  a line item travels with the few columns that the query reads, not with those that they are made of.
* ``lineitem`` x ``orders`` is a big-big equi-join on the order key and shuffles on it
  (sort-merge or, after AQE, shuffled hash).  An order key holds few line items, so the
  key itself cannot be hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.enrich import THIS_YEAR
from .dims import MARKETPLACE_TIER, team_rows

# Columns read from each star table (column pruning reaches the scan).
STAR_COLUMNS = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_nationkey", "c_mktsegment"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "supplier": ["s_suppkey", "s_name"],
}

# Fixture choices.  Orders from the cut date on are this year's export, earlier ones last
# year's, so every order has a label, as every row of the two exports does.  Part keys name home
# teams (some keys beyond the list keep the part's name, which no lookup knows) and customer keys
# name marketplaces.
CUT_DATE = "1998-07-01"
TEAMS = [team for team, _, _ in team_rows()]
MARKETPLACES = list(MARKETPLACE_TIER)


def _pick(names: list[str], key: str, other: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"coalesce(try_element_at(array({listed}), cast({key} + 1 as int)), {other})"


# Mart column expressions (Spark SQL).  These are the fixture definitions the DuckDB
# oracle repeats, so both engines see the same input rows.
MART_EXPRS = {
    "YearLabel": f"case when o_orderdate >= timestamp_ntz '{CUT_DATE} 00:00:00' then 'This Year' else 'Last Year' end",
    "InvoiceID": "l_orderkey",
    "SellDate_dt": "case when l_orderkey % 97 <> 0 then "
                   "timestampadd(HOUR, cast(l_orderkey % 24 as int), cast(o_orderdate as timestamp_ntz)) end",
    "EventDate_dt": "case when l_partkey % 89 <> 0 then timestampadd(DAY, cast(l_partkey % 13 * 30 as int), "
                    "cast(date_trunc('month', o_orderdate) as timestamp_ntz)) end",
    "SaleTotal": "case when l_returnflag = 'R' and l_linenumber = 1 then cast(0 as decimal(21,4)) "
                 "else cast(cast(l_extendedprice as decimal(15,2)) * (1 - cast(l_discount as decimal(4,2))) "
                 "as decimal(21,4)) end",
    "TicketCost": "cast(cast(p_retailprice as decimal(15,2)) * cast(l_quantity as int) as decimal(21,4))",
    "Quantity": "case when l_linenumber = 7 then 0 else cast(l_quantity as int) % 12 end",
    "CompanyName": "case when s_suppkey % 50 <> 0 then s_name end",
    "PrimaryPerformerName": _pick(TEAMS, "l_partkey % 140", "p_name"),
    "SecondaryPerformerName": "nullif(p_brand, 'Brand#1')",
    "RequestedPerformerTypeId": "case p_type when 'STANDARD' then 38 when 'PROMO' then 42 "
                                "when 'ECONOMY' then 43 end",
    "VenueName": "concat('Venue ', r_name)",
    "EventName": "concat(p_type, ' Night')",
    "Section": "concat(case l_linenumber when 1 then 'Club ' when 2 then 'Lot' when 3 then 'Bal' "
               "when 4 then 'A' when 5 then '' else concat(p_name, ' ') end, "
               "case when p_size < 45 then cast(p_size * 10 as string) else '' end)",
    "Seats": "concat(cast(l_linenumber as string), '-', cast(l_linenumber + 1 as string))",
    "ShippingCompany": _pick(MARKETPLACES, "c_custkey % 11", "c_mktsegment"),
    "DeliveryType": "o_orderpriority",
    "IsDelivered": "l_linestatus = 'F'",
    "IsCancelled": "l_returnflag = 'R'",
    "IsExpired": "o_orderstatus = 'P'",
}

MART_COLUMNS = list(MART_EXPRS)

# What a table's columns make by themselves, made before its rows join ("part": line items with their parts): these
# travel in place of wider columns, and of each only what a query reads.
OWN = {
    "lineitem": ["SaleTotal", "Quantity", "IsDelivered", "IsCancelled"],
    "part": ["TicketCost", "PrimaryPerformerName", "SecondaryPerformerName"],
    "orders": ["YearLabel", "IsExpired"],
}
# Money travels in 8 bytes where it fits; what does not fit (a null here) goes on beside it in full width.
NARROW, NARROW_TYPE, MONEY = "{}_narrow", "decimal(18,4)", ("SaleTotal", "TicketCost")
WIDE = "{}_wide"
# Days from the order's month to the event; a null, and so no event date, for the same keys as in MART_EXPRS.
EVENT_DAYS = "case when l_partkey % 89 <> 0 then cast(l_partkey % 13 * 30 as int) end"
EVENT_DATE = "timestampadd(DAY, event_days, cast(date_trunc('month', o_orderdate) as timestamp_ntz))"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet table of ``sf_dir``, projected to the used columns."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cols = columns if columns is not None else STAR_COLUMNS.get(name)
    return df.select(*cols) if cols else df


def _own(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the mart's columns of one table, its money in a narrow column and one for what does not fit."""
    out = df.withColumns({c: F.expr(MART_EXPRS[c]) for c in OWN[table]})
    for c in set(MONEY) & set(OWN[table]):
        narrow = F.col(c).try_cast(NARROW_TYPE)
        out = out.withColumns({NARROW.format(c): narrow, WIDE.format(c): F.when(narrow.isNull(), F.col(c))}).drop(c)
    return out


def star_rows(spark: SparkSession, sf_dir: str, year: str | None = None, early: bool = False) -> DataFrame:
    """The star tables of ``sf_dir`` joined, one row per line item, in their own columns, with the two names that one
    dimension's columns make (``CompanyName``, ``ShippingCompany``): these travel in place of the columns.

    ``year`` (a year label) takes that export alone: a plain comparison of the order date, which reaches
    the orders scan and shrinks every join after it.  ``early`` adds the mart's columns of one table (``OWN``)
    before that table's rows join."""
    t = {name: read_table(spark, sf_dir, name) for name in STAR_COLUMNS}
    if year:
        cut = F.to_timestamp_ntz(F.lit(f"{CUT_DATE} 00:00:00"))
        # Orders without a date are last year's, as their label says.
        t["orders"] = t["orders"].where(F.col("o_orderdate") >= cut if year == THIS_YEAR
                                        else (F.col("o_orderdate") < cut) | F.col("o_orderdate").isNull())
    geo = (t["nation"].join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "n_name", "r_name"))
    cust = (t["customer"].withColumn("ShippingCompany", F.expr(MART_EXPRS["ShippingCompany"]))
            .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey")))
    supplier = t["supplier"].withColumn("CompanyName", F.expr(MART_EXPRS["CompanyName"]))
    orders = (_own(t["orders"], "orders") if early else t["orders"]).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    joined = _own(t["lineitem"], "lineitem").withColumn("event_days", F.expr(EVENT_DAYS)) if early else t["lineitem"]
    for step in (("orders", "supplier", "part") if year else ("supplier", "part", "orders")):
        if step == "orders":
            joined = joined.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        elif step == "part":
            joined = joined.join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
            joined = _own(joined, "part") if early else joined
        else:
            joined = joined.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined


def mart_columns(joined: DataFrame, *more: str) -> DataFrame:
    """The mart's columns of joined star rows, and ``more`` of theirs; those that are there already stay as they are."""
    exprs = dict(MART_EXPRS)
    if "event_days" in joined.columns:
        exprs |= {"EventDate_dt": EVENT_DATE, **{c: f"coalesce(cast({NARROW.format(c)} as decimal(21,4)), {WIDE.format(c)})" for c in MONEY}}
    return joined.select(*[c if c in joined.columns else F.expr(e).alias(c) for c, e in exprs.items()], *more)


def sales_mart(spark: SparkSession, sf_dir: str, year: str | None = None) -> DataFrame:
    """Raw-order-shaped rows (one per line item) from the star tables in ``sf_dir``, or from one ``year`` (:func:`star_rows`)."""
    return mart_columns(star_rows(spark, sf_dir, year, early=True))
