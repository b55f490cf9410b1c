"""The written exports: one pass over the mart, no shuffle or sort of the text, every row and its header in the files."""
import datetime as dt
import re
from pathlib import Path

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from marginmart.plans import text_export as T
from marginmart.sources import csv as CSV
from marginmart.sources import sales_mart

DAYS = {1: dt.datetime(1998, 8, 1), 2: dt.datetime(1997, 3, 1), 3: None}


def write_star(spark, folder, orders):
    tables = {
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                     "l_returnflag string, l_linestatus string",
                     [(k, 1, 1 + k % 2, n, 2.0, 50.0 + k, 0.1, "N" if k % 5 else None, "F" if k % 3 else "O") for k in orders for n in (1, 2)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
                   [(k, 1, "P", orders[k], "5-LOW") for k in orders]),
        "customer": ("c_custkey long, c_nationkey int, c_mktsegment string", [(1, 0, "A")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N", 0)]),
        "region": ("r_regionkey int, r_name string", [(0, "R")]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", [(1, "ring", "Brand#2", "PROMO", 5, 10.0)]),
        "supplier": ("s_suppkey long, s_name string", [(1, "S, \"1\""), (2, "S2")]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture()
def frames(monkeypatch):
    """The frames that are written as text."""
    seen, text = [], DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, *a, **k: (seen.append(self._df), text(self, *a, **k))[1])
    return seen


def test_exports_are_written_in_one_pass(spark, tmp_path, frames):
    # Joins that shuffle, as large tables have them: several tasks write.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = write_star(spark, tmp_path / "in", {k: DAYS[1 + k % 3] for k in range(100)})
        this, last = T.written_exports(spark, d)
        want = sales_mart(spark, d).groupBy("YearLabel").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(frames) == 1, "one write, so one pass over the mart"
    plan = frames[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan and "Sort" not in plan
    # The orders of a null date are last year's.
    assert {r["YearLabel"]: r["count"] for r in want} == {"This Year": 68, "Last Year": 132}
    for path, head, n in ((this, "EventTime", 68), (last, "Notes", 132)):
        files = [f.read_text().splitlines() for f in Path(path.removeprefix("file:")).rglob("part-*")]
        assert len(files) > 1 and all(f[0].startswith("SaleTotal,") and head in f[0] for f in files)
        assert not any(x.startswith("SaleTotal,") for f in files for x in f[1:])
        assert sum(bool(x) for f in files for x in f[1:]) == n
        # Orders 7 and 57 end early, 11 and 61 are too long, 13 and 63 have an open quote, a blank line is before 17 and 67.
        export = CSV.read_export(spark, path)
        assert export.rows.count() + export.bad.count() == n
    assert set(CSV.read_raw(spark, this).columns) >= {"EventTime", "IsExpired"} and "Notes" not in CSV.read_raw(spark, this).columns
    assert {r.InvoiceID for r in CSV.read_raw(spark, last).collect()} == {str(k) for k in range(100) if k % 3 and k % 50 not in (11, 13)}


def test_large_tasks_are_not_sorted_by_export(spark, tmp_path):
    """Both exports' rows alternate in a task, and the headers stay first: the write itself adds no sort either."""
    d = write_star(spark, tmp_path / "in", {k: DAYS[1 + k % 2] for k in range(600)})
    for path in T.written_exports(spark, d):
        files = [f.read_text().splitlines() for f in Path(path.removeprefix("file:")).rglob("part-*")]
        assert all(f[0].startswith("SaleTotal,") for f in files) and max(map(len, files)) > 100
        rows = [x for f in files for x in f[1:] if x]
        assert len(rows) == 600 and all(re.search(r",", x) for x in rows)


def test_an_export_without_rows_is_refused(spark, tmp_path):
    for name, orders in (("none", {}), ("this", {1: DAYS[1]})):
        d = write_star(spark, tmp_path / name, orders)
        assert len(CSV.read_raw(spark, T.written_exports(spark, d)[1]).columns) > 5
        with pytest.raises(CSV.InputError, match="this year" if name == "none" else "last year"):
            T.csv_load(spark, d)
