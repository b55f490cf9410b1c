"""Raw CSV pair: load, union, coercion, lookups, flags, refusal of empty input (fixture B)."""

import pytest
from pyspark.sql import functions as F

from marginmart.sources import csv as CSV

THIS = """Unnamed: 0,SellDate,EventDate,EventTime,SaleTotal,TicketCost,Quantity,CompanyName,PrimaryPerformerName,SecondaryPerformerName,RequestedPerformerTypeId,VenueName,Section,Seats,ShippingCompany,DeliveryType,IsDelivered,IsCancelled,IsExpired,InvoiceID,EventName
0,2024-10-03 10:00:00,2024-10-03,1900-01-01T19:30:00,120.50,100,2,Affiliate A,Boston Celtics,,38,TD Garden,GOLD1,1-2,StubHub,Mobile,True,false,FALSE,1001,Celtics vs Nets
1,2024-10-05 09:00:00,2024-11-20,1900-01-01T13:05:00,abc,50,2.0,Affiliate B,New York Yankees,Boston Red Sox,,Yankee Stadium,Black,9-9,Vivid Seats,Email, true ,,,1002,Yankees vs Red Sox

2,not a date,2024-12-01,,80,90,,Affiliate A,Unknown Team,,38.0,Somewhere,BAL301,,Nowhere,Mobile,false,TRUE,true,,Other Game
"""

LAST = """YEAR,SellDate,EventDate,EventTime,TicketCost,SaleTotal,Quantity,CompanyName,PrimaryPerformerName,SecondaryPerformerName,RequestedPerformerTypeId,VenueName,Section,Seats,ShippingCompany,DeliveryType,IsDelivered,IsCancelled,IsExpired,InvoiceID,EventName,IsConsecutive
last,2023-10-03 10:00:00,2023-10-04,1900-01-01T19:00:00,40,60,4,Affiliate A,Dallas Stars,,43,Arena,106,,SeatGeek,Mobile,TRUE,False,false,9001,Stars Night,true
"""


@pytest.fixture()
def pair(tmp_path):
    t, lst = tmp_path / "this.csv", tmp_path / "last.csv"
    t.write_text(THIS)
    lst.write_text(LAST)
    return str(t), str(lst)


def test_load_combined(spark, pair):
    df = CSV.load_combined(spark, *pair)
    rows = {r.InvoiceID: r for r in df.collect()}
    assert len(rows) == 4  # blank line skipped, both files unioned
    assert "Unnamed: 0" not in df.columns and "IsConsecutive" in df.columns
    a, b, c, d = rows["1001"], rows["1002"], rows[None], rows["9001"]
    assert (a.YearLabel, a.YEAR, d.YearLabel, d.YEAR) == ("This Year", "current", "Last Year", "last_year")
    # coercion
    assert float(a.SaleTotal) == 120.5 and float(b.SaleTotal) == 0.0 and b.Quantity == 2 and c.Quantity == 0
    assert float(a.Profit) == 20.5 and abs(a.ProfitMargin - 20.5 / 120.5 * 100) < 1e-12
    assert b.ProfitMargin is None  # zero revenue
    assert c.SellDate_dt is None and c.LeadTimeBucket == "Unknown"
    assert a.EventHour == 19 and b.EventHour == 13 and c.EventHour is None
    # columns come by name although the last-year file orders them differently
    assert float(d.SaleTotal) == 60 and float(d.TicketCost) == 40
    # lookups: type id, team fallback, Other; state; marketplace tier
    assert (a.Sport, a.State, a.MarketplaceTier) == ("NBA", "MA", "Tier 1 - Major")
    assert (b.Sport, b.State, b.MarketplaceTier) == ("MLB", "NY", "Tier 1 - Major")
    assert (c.Sport, c.State, c.MarketplaceTier) == ("NBA", None, "Other")  # 38.0 parses as 38
    assert (d.Sport, d.State) == ("NHL", "TX")
    # flags
    assert (a.IsDelivered, b.IsDelivered, c.IsDelivered, b.IsCancelled, c.IsExpired) == (True, True, False, False, True)
    assert d.IsConsecutive is True and a.IsConsecutive is False
    # sections
    assert (a.Section_Num, a.Section_Type, a.SectionTypeTier) == (1.0, "GOLD", "Parking / Lot")
    assert (b.Section_Num, b.SectionNumTier) == (9.0, "Floor / Low (<100)")
    assert (d.Section_Num, d.SectionTypeTier, d.SectionNumTier) == (106.0, "Numeric Only", "Lower Bowl (100s)")
    assert a.LeadTimeDays == -1 and a.LeadTimeBucket == "Post-event sale"


def test_empty_file_refused(spark, tmp_path):
    t, lst = tmp_path / "this.csv", tmp_path / "last.csv"
    t.write_text(THIS)
    lst.write_text(LAST.splitlines()[0] + "\n")
    with pytest.raises(CSV.InputError):
        CSV.load_combined(spark, str(t), str(lst))


def test_harmonize_sorted_columns(spark, pair):
    a = CSV.load_one(spark, pair[0], "This Year")
    b = CSV.load_one(spark, pair[1], "Last Year")
    h = CSV.harmonize(a, b)
    assert h.columns == sorted(h.columns)
    assert h.where(F.col("YEAR").isNotNull()).count() == 1


def test_csv_roundtrip_matches_mart(spark, tmp_path):
    """Export the sf0.001 mart as a raw CSV pair (text columns) and load it back through the
    CSV path: revenue, profit and orders per affiliate and year are unchanged."""
    from marginmart.operators import compare as C
    from marginmart.sources import load_enriched, sales_mart

    mart = sales_mart(spark, "/root/testdata/sf0.001")
    raw = mart.select(
        F.date_format("SellDate_dt", "yyyy-MM-dd HH:mm:ss").alias("SellDate"),
        F.date_format("EventDate_dt", "yyyy-MM-dd").alias("EventDate"),
        F.lit("1900-01-01T19:30:00").alias("EventTime"),
        F.col("SaleTotal").cast("string").alias("SaleTotal"), F.col("TicketCost").cast("string").alias("TicketCost"),
        F.col("Quantity").cast("string").alias("Quantity"), "CompanyName", "PrimaryPerformerName",
        "SecondaryPerformerName", F.col("RequestedPerformerTypeId").cast("string").alias("RequestedPerformerTypeId"),
        "VenueName", "Section", "Seats", "ShippingCompany", "DeliveryType",
        F.when(F.col("IsDelivered"), "True").otherwise("False").alias("IsDelivered"),
        F.when(F.col("IsCancelled"), "true").otherwise("false").alias("IsCancelled"),
        F.when(F.col("IsExpired"), "TRUE").otherwise("FALSE").alias("IsExpired"),
        F.col("InvoiceID").cast("string").alias("InvoiceID"), "EventName", "YearLabel")
    this_p, last_p = str(tmp_path / "this"), str(tmp_path / "last")
    for label, path in (("This Year", this_p), ("Last Year", last_p)):
        (raw.where(F.col("YearLabel") == label).drop("YearLabel")
            .write.option("header", True).csv(path))
    loaded = CSV.load_combined(spark, this_p, last_p)
    want = C.yoy_table(load_enriched(spark, "/root/testdata/sf0.001").where(F.col("YearLabel").isNotNull()),
                       "CompanyName")
    got = C.yoy_table(loaded, "CompanyName")
    cols = ["CompanyName", "revenue_ty", "revenue_ly", "profit_ty", "profit_ly", "orders_ty", "orders_ly"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    # Lookups ran: type ids 38/42/43 resolve, other parts fall back to Other.
    sports = {r[0] for r in loaded.select("Sport").distinct().collect()}
    assert sports <= {"NBA", "NFL", "NHL", "MLB", "Other"} and {"NBA", "NFL", "NHL"} <= sports


def test_gzip_export_is_spread(spark, tmp_path):
    import gzip

    t, lst = tmp_path / "this.csv.gz", tmp_path / "last.csv"
    with gzip.open(t, "wt") as fh:
        fh.write(THIS)
    lst.write_text(LAST)
    df = CSV.load_combined(spark, str(t), str(lst))
    assert df.count() == 4
    assert CSV.read_raw(spark, str(t)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_lines_that_are_no_records_are_set_aside(spark, tmp_path):
    t, lst = tmp_path / "this.csv", tmp_path / "last.csv"
    head = "InvoiceID,SaleTotal,TicketCost,CompanyName\n"
    t.write_text(head + '1,10,5,"A, B ""C"""\n2,20\n\n3,30,5,X,too,many\n4,40,"open,x\n5,1e30,abc,Y\n,,,\n6,7,"5,8\n')
    lst.write_text(head + "7,1,1,Z\n")
    e = CSV.load_combined(spark, str(t), str(lst))
    got = {r.InvoiceID: (float(r.SaleTotal), float(r.TicketCost), r.CompanyName) for r in e.collect()}
    # A short line is filled up, separators alone are an order, a number too wide is 0.
    assert got["1"] == (10.0, 5.0, 'A, B "C"') and got["2"] == (20.0, 0.0, None) and got["5"] == (0.0, 0.0, "Y") and got["7"][2] == "Z"
    assert set(got) == {"1", "2", "5", "7", None}
    bad = CSV.bad_records(spark, str(t), str(lst))
    assert {(r.YearLabel, r.line, r.reason) for r in bad.collect()} == {
        ("This Year", "3,30,5,X,too,many", "too many fields"), ("This Year", '4,40,"open,x', "quote not closed"),
        ("This Year", '6,7,"5,8', "quote not closed")}
    assert all(r.file.endswith("this.csv") for r in bad.collect()) and bad.count() == 3
    rows = CSV.harmonize(CSV.load_one(spark, str(t), "This Year"), CSV.load_one(spark, str(lst), "Last Year"))
    report = {(r.YearLabel, r.item, r.kind): r.n for r in CSV.load_report(rows, bad).collect()}
    assert report["This Year", "line", "record"] == 4 and report["This Year", "line", "too many fields"] == 1
    assert report["This Year", "SaleTotal", "too wide"] == 1 and report["This Year", "TicketCost", "no number"] == 1
    assert report["This Year", "TicketCost", "missing"] == 2 and report["This Year", "SaleTotal", "missing"] == 1


def test_each_export_votes_on_day_and_month(spark, tmp_path):
    t, lst = tmp_path / "this.csv", tmp_path / "last.csv"
    t.write_text("InvoiceID,SellDate,EventDate\n1,13/05/2024,05/13/2024\n2,01/02/2024,01/02/2024\n3,20241005,2024-03-04\n4,05/13/2024,3.4.24 1:05 PM\n")
    lst.write_text("InvoiceID,SellDate,EventDate\n7,01/02/2023,31-12-2023 23:10\n8,02/01/2023,01-02-2023\n")
    e = CSV.load_combined(spark, str(t), str(lst))
    got = {r.InvoiceID: tuple(None if x is None else x.strftime("%Y-%m-%d %H:%M") for x in (r.SellDate_dt, r.EventDate_dt)) for r in e.collect()}
    # One date each way is a tie in this year's sale dates: month first, and what is no date then is missing.
    assert got["1"] == (None, "2024-05-13 00:00") and got["4"] == ("2024-05-13 00:00", "2024-03-04 13:05")
    assert got["2"] == ("2024-01-02 00:00", "2024-01-02 00:00") and got["3"] == ("2024-10-05 00:00", "2024-03-04 00:00")
    # Last year's event dates are day first; its sale dates do not tell, so month first.
    assert got["7"] == ("2023-01-02 00:00", "2023-12-31 23:10") and got["8"] == ("2023-02-01 00:00", "2023-02-01 00:00")
    t.write_text("InvoiceID,SellDate,EventDate\n1,13/05/2024,\n2,01/02/2024,\n")
    first = CSV.load_combined(spark, str(t), str(lst)).where("InvoiceID in ('1', '2') and YearLabel = 'This Year'").orderBy("InvoiceID").collect()
    assert [r.SellDate_dt.strftime("%m-%d") for r in first] == ["05-13", "02-01"]


def versions(spark):
    from pathlib import Path

    from marginmart.session import ensure_checkpoint_dir
    base = Path(ensure_checkpoint_dir(spark).removeprefix("file:")) / "marginmart-cache"
    return {e.name: sorted(v.name for v in e.iterdir() if not v.name.startswith(".")) for e in base.iterdir()}


def test_cached_load_reuses_and_replaces_versions(spark, pair, monkeypatch):
    from marginmart.sources import cache

    built = []
    load = CSV.load_combined
    monkeypatch.setattr(cache.csv, "load_combined", lambda *a, **k: built.append(1) or load(*a, **k))
    entries = set(versions(spark)) if built else set()
    first = cache.cached_load(spark, *pair)
    want = sorted(map(str, load(spark, *pair).collect()))
    assert sorted(map(str, first.collect())) == want and first.columns == load(spark, *pair).columns
    again = cache.cached_load(spark, *pair)
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert len(built) == 1 and "Join" not in plan and sorted(map(str, again.collect())) == want
    (name,) = [n for n, v in versions(spark).items() if n.startswith("exports-") and n not in entries]
    before = versions(spark)[name]
    assert len(before) == 1 and before[0].startswith("v-")
    with open(pair[1], "a") as f:
        f.write("last,2023-11-03 10:00:00,2023-11-04,1900-01-01T19:00:00,1,2,4,Affiliate A,Dallas Stars,,43,Arena,106,,SeatGeek,Mobile,TRUE,False,false,9002,Stars Night,true\n")
    changed = cache.cached_load(spark, *pair)
    assert len(built) == 2 and changed.count() == len(want) + 1
    after = versions(spark)[name]
    assert len(after) == 1 and after != before, "the stale version and every draft are gone"


def test_cache_keeps_versions_if_asked_and_survives_an_unfinished_build(spark, tmp_path):
    from marginmart.sources import cache

    src = tmp_path / "in"
    build = lambda: spark.read.parquet(str(src)).withColumn("YearLabel", F.lit("This Year")).withColumn("CompanyName", F.lit("A"))
    for n in (3, 5, 7):
        spark.range(n).write.mode("overwrite").parquet(str(src))
        assert cache.cached(spark, "kept", [str(src)], build, keep=2).count() == n
    (name,) = [n for n in versions(spark) if n.startswith("kept-")]
    assert len(versions(spark)[name]) == 2
    with pytest.raises(ZeroDivisionError):
        cache.cached(spark, "broken", [str(src)], lambda: 1 / 0)
    assert cache.cached(spark, "broken", [str(src)], build).count() == 7
