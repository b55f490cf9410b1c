"""Dates of text: only formats of a text's shape are tried, with what all of them tried in turn give; the input probe counts no votes."""
import pytest
from pyspark.sql import functions as F

from marginmart.functions import enrich as E
from marginmart.sources import csv as CSV

CLOCKS = (" H:mm:ss", " H:mm", " h:mm:ss a", " h:mm a", "")
PLAIN = ("yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd", "MMM d, yyyy h:mm a", "MMM d, yyyy", "d MMM yyyy", "MMMM d, yyyy")
ORDERS = {True: "d/M", False: "M/d"}
TEXTS = [
    None, "", " ", "2024-10-05", "2024-10-05 01:02:03", "2024/03/04", "2024/03/04 05:06:07", "2024/3/4", "20241005", "Oct 5, 2024", "oct 5, 2024 1:05 pm",
    "5 Oct 2024", "October 5, 2024", "1/2/2024", "13/2/2024", "2/13/2024", "13.2.2024", "2-13-24", "1.2-2024", "1/2-2024", "1/2/24", "1/2/024", "001/2/2024", "0012/3/2024",
    "0012/03/2024", "+1/2/2024", "-1/2/2024", "1/-2/2024", "1/2/2024 3:04", " 13/2/2024 3:04 ", "1/2/2024 13:04:05", "1/2/2024 3:04 PM", "13.2.24 3:04:05 am", "1/2/2024 3:04:05:06",
    "1/2/2024 13:04 PM", "1/2/2024 x", "1/2/2024 3", "31/12/2024 23:59", "12/31/2024 12:00 AM", "30/2/2024", "epoch", "not a date", "1//2/2024", "99/99/9999",
]


def in_turn(text, first=None):
    """Every format tried, in the order of the rules."""
    tries = lambda formats: ", ".join(f"cast(try_to_timestamp({text}, '{f}') as timestamp_ntz)" for f in formats)
    numbers = {day: tries([f"{order}/{y}{t}" for y in ("yyyy", "yy") for t in CLOCKS]) for day, order in ORDERS.items()}
    rest = f"{numbers[False]}, {numbers[True]}" if first is None else f"case when {first} then coalesce({numbers[True]}) else coalesce({numbers[False]}) end"
    return F.expr(f"coalesce(try_cast(nullif(trim(x), '') as timestamp_ntz), {tries(PLAIN)}, {rest})")


def test_formats_of_a_shape_give_what_all_formats_give(spark):
    df = spark.createDataFrame([(t, d) for t in TEXTS for d in (True, False)], "x string, d boolean")
    df = df.withColumn("slashed", F.regexp_replace(F.trim("x"), "^([0-9]{1,2})[.-]([0-9]{1,2})[.-]([0-9])", "$1/$2/$3"))
    voted, free = E.date_parts(df, {"x": F.col("d")}), E.date_parts(df, {"x": None})
    for rows, want, got in ((voted, in_turn("slashed", "d"), E.timestamp("x", F.col("d"), parts=True)), (voted, in_turn("slashed", "d"), E.timestamp("x", F.col("d"))),
                            (free, in_turn("slashed"), E.timestamp("x", parts=True)), (free, in_turn("slashed"), E.timestamp("x"))):
        out = rows.select("x", "d", want.alias("want"), got.alias("got")).collect()
        assert [(r.x, r.d, r.got) for r in out] == [(r.x, r.d, r.want) for r in out]
        assert sum(r.got is not None for r in out) > 30


@pytest.mark.parametrize(("texts", "day_first"), [
    (["13/5/2024", "1/2/2024"], True), (["5/13/2024"], False), (["13/5/2024", "5/13/2024"], False), (["13/13/2024", "1/2/2024"], False), ([" 13.05-24", "x"], True),
    (["13/05-24"], False), (["13/5/2"], False), (["2024-13-05", None, ""], False), (["99-00-2024"], True), (["013/5/2024"], False), (["13/5/2024 1:00", "31.12.24", "1/13/24"], True)])
def test_votes_on_the_order_of_day_and_month(spark, texts, day_first):
    assert spark.createDataFrame([(t,) for t in texts], "x string").agg(E.prefers_day_first("x")).first()[0] is day_first


def test_a_load_reads_each_date_once_and_probes_without_votes(spark, tmp_path, monkeypatch):
    for name in ("this", "last"):
        (tmp_path / f"{name}.csv").write_text("InvoiceID,SellDate\n1,13/05/2024 1:05 PM\n2,1.2.2024\n")
    probed, check = [], CSV.check_inputs
    monkeypatch.setattr(CSV, "check_inputs", lambda *frames: (probed.extend(frames), check(*frames)))
    e = CSV.load_combined(spark, str(tmp_path / "this.csv"), str(tmp_path / "last.csv"))
    assert len(probed) == 2 and not any(c.startswith("_day_first") for df in probed for c in df.columns)
    assert not any(c.startswith(("_text_", "_shape_", "_numbers_", "_day_first_")) for c in e.columns)
    got = {(r.YearLabel, r.InvoiceID, r.SellDate_dt.strftime("%Y-%m-%d %H:%M")) for r in e.collect()}
    assert got == {(y, k, at) for y in ("This Year", "Last Year") for k, at in (("1", "2024-05-13 13:05"), ("2", "2024-02-01 00:00"))}
    plan = e.select("SellDate_dt")._jdf.queryExecution().optimizedPlan().toString()
    # Once for each export, not once for each format.
    assert plan.count("([0-9]{1,2})[.-]([0-9]{1,2})[.-]([0-9])") == 2
