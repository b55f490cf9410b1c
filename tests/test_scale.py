"""What moves between tasks: join order of the mart, the cached load's sort, columns kept for two scans, the store's groups."""
import datetime as dt
from urllib.parse import unquote

from pyspark.sql import functions as F

from marginmart.operators import components as S
from marginmart.plans import catalog
from marginmart.plans.pages import PAGE_COLUMNS
from marginmart.sources import cache, load_enriched, mart
from marginmart.sources.cache import cached
from marginmart.sources.mart import sales_mart

STAR = {
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                 "l_returnflag string, l_linestatus string", [(1, 1, 1, 1, 2.0, 50.0, 0.1, "N", "F"), (1, 1, 1, 2, 3.0, 70.0, 0.0, "N", "O"), (2, 1, 1, 1, 1.0, 9.0, 0.0, "N", "F"),
                                                          (None, 1, 1, 1, 1.0, 9.0, 0.0, "N", "F")]),
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
               [(1, 1, "F", dt.datetime(1998, 8, 1), "1-URGENT"), (1, 2, "P", dt.datetime(1997, 3, 1), "5-LOW"), (2, None, "F", dt.datetime(1997, 3, 2), "5-LOW")]),
    "customer": ("c_custkey long, c_nationkey int, c_mktsegment string", [(1, 0, "A"), (2, 0, "B"), (2, 0, "C")]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N", 0)]),
    "region": ("r_regionkey int, r_name string", [(0, "R")]),
    "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", [(1, "ring", "Brand#2", "PROMO", 5, 10.0)]),
    "supplier": ("s_suppkey long, s_name string", [(1, "S1")]),
}


def test_customer_joins_orders_not_line_items(spark, tmp_path):
    for name, (schema, rows) in STAR.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    mart = sales_mart(spark, str(tmp_path))
    # Two line items of order 1, whose key comes twice, with one and with two customers; none without a customer.
    assert mart.count() == 6
    lines = mart._jdf.queryExecution().analyzed().toString().splitlines()
    at = next(i for i, x in enumerate(lines) if "Join" in x and "c_custkey" in x)
    depth = lines[at].index("Join")
    below = [x for x in lines[at + 1:]]
    inside = below[:next((i for i, x in enumerate(below) if len(x) - len(x.lstrip(" :+-")) <= depth), len(below))]
    assert any("o_custkey" in x for x in inside) and not any("l_orderkey" in x for x in inside)


def test_cached_load_sorts_before_it_derives(spark, tmp_path):
    rows = spark.createDataFrame([("This Year", "B", 1), ("This Year", "A", 2), ("Last Year", None, 3)], "YearLabel string, CompanyName string, n int")
    rows.write.parquet(f"{tmp_path}/in")
    plans = []

    def derive(d):
        plans.append(d._jdf.queryExecution().optimizedPlan().toString())
        return d.withColumn("twice", F.col("n") * 2)
    out = cached(spark, "sorted", [f"{tmp_path}/in"], lambda: spark.read.parquet(f"{tmp_path}/in"), derive=derive)
    assert plans[0].startswith("Sort [YearLabel") and "CompanyName" in plans[0].splitlines()[0]
    assert out.columns == ["YearLabel", "CompanyName", "n", "twice"]
    assert sorted(tuple(r)[2:] for r in out.collect()) == [(1, 2), (2, 4), (3, 6)]


def test_two_scans_read_kept_columns(spark, tmp_path):
    rows = spark.createDataFrame([("This Year", float(i), "x") for i in range(10)] + [("Last Year", None, "y")], "YearLabel string, ProfitMargin double, other string")
    rows.write.parquet(f"{tmp_path}/in")
    out = catalog.QUERIES["hist_margin"].on_enriched(spark.read.parquet(f"{tmp_path}/in"))
    assert out.agg(F.sum("count")).first()[0] == 10
    assert out.inputFiles() and all("marginmart-columns" in f for f in out.inputFiles())


def test_store_groups_one_dimension_at_a_time(spark, tmp_path):
    schema = ("SellMonth string, YearLabel string, SaleTotal decimal(21,4), Profit decimal(22,4), TicketCost decimal(21,4), TicketsSold int, InvoiceID long, "
              "ProfitMargin double, CompanyName string, Sport string")
    rows = [(f"1997-{i % 12 + 1:02d}" if i % 7 else None, "Last Year", 10, -1 if i % 3 else 1, 9, 2, i, float(i), f"C{i % 40}" if i % 5 else None, "NBA") for i in range(400)]
    df = spark.createDataFrame([(*r[:2], *[__import__("decimal").Decimal(x) for x in r[2:5]], *r[5:]) for r in rows], schema)
    c = S.components(df, ["CompanyName", "Sport"])
    assert "Expand" not in c._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.dimension, r.month, r.value): (r.orders, r.loss, r.rev) for r in c.collect()}
    assert len(found) == c.count()
    for dimension, at in (("", None), ("CompanyName", 8), ("Sport", 9)):
        mine = {}
        for r in rows:
            key = (dimension, r[0] or "none", None if at is None else r[at])
            n, loss, rev = mine.get(key, (0, 0, 0))
            mine[key] = (n + 1, loss + (r[3] < 0), rev + r[2])
        assert {k: v for k, v in found.items() if k[0] == dimension} == mine
    before = spark.conf.get(S.HASHED_CONF, None)
    S.Store(spark, f"{tmp_path}/store", ["Sport"]).replace(df)
    assert spark.conf.get(S.HASHED_CONF, None) == before


def _star(spark, path):
    for name, (schema, rows) in STAR.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def _below_orders(mart):
    """Lines of the analyzed plan below the join on the order key."""
    lines = mart._jdf.queryExecution().analyzed().toString().splitlines()
    at = next(i for i, x in enumerate(lines) if "Join" in x and "l_orderkey" in x and "o_orderkey" in x)
    depth = lines[at].index("Join")
    below = lines[at + 1:]
    return below[:next((i for i, x in enumerate(below) if len(x) - len(x.lstrip(" :+-")) <= depth), len(below))]


def test_orders_join_last_and_first_with_a_year(spark, tmp_path):
    path = _star(spark, tmp_path)
    every, this = sales_mart(spark, path), sales_mart(spark, path, "This Year")
    assert any("s_suppkey" in x and "Join" in x for x in _below_orders(every)) and any("p_partkey" in x and "Join" in x for x in _below_orders(every))
    assert not any("s_suppkey" in x for x in _below_orders(this))
    # Order 1 has a row of each year and two line items; the row of last year has two customers.
    assert sorted(r.YearLabel for r in every.collect()) == ["Last Year"] * 4 + ["This Year"] * 2
    assert this.count() == 2
    # The names that one dimension makes travel in place of its columns.
    joined = every._jdf.queryExecution().optimizedPlan().toString()
    assert not any("c_custkey" in x and "l_orderkey" in x for x in joined.splitlines() if "Project" in x)


def test_cached_mart_sorts_star_columns(spark, tmp_path):
    path = _star(spark, tmp_path)
    narrow = cache._narrow_mart(spark, path)
    assert not {"SaleTotal", "TicketCost", "Section", "EventName", "SellDate_dt", "PrimaryPerformerName"} & set(narrow.columns)
    before = {k: spark.conf.get(k, None) for k in cache.WRITER_CONF}
    got, plain = cache.cached_mart(spark, path), load_enriched(spark, path)
    assert {k: spark.conf.get(k, None) for k in cache.WRITER_CONF} == before
    assert got.columns == plain.columns and got.count() == 6
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_cached_mart_keeps_affiliates_together(spark):
    """Each file of the cache is in order of the affiliate: the sort outlives the derived columns and the folders of the years."""
    got = cache.cached_mart(spark, "/root/testdata/sf0.001")
    for f in got.inputFiles():
        names = [r[0] for r in spark.read.parquet(unquote(f)).select("CompanyName").collect()]
        assert names == sorted(names, key=lambda n: (n is not None, n or ""))


def test_unread_lookups_and_their_columns_do_not_travel(spark, tmp_path):
    """A query of sale totals joins no lookup, and no part, customer or order text crosses a join."""
    plan = load_enriched(spark, _star(spark, tmp_path), droppable=True).select("YearLabel", "SaleTotal")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "Join Inner" in plan
    made = [x for x in plan.splitlines() if "Project" in x]
    assert made and not any(c in x for x in made for c in ("PrimaryPerformerName", "ShippingCompany", "p_type"))


def test_columns_made_before_the_joins_are_the_same(spark, tmp_path):
    """Null keys, keys that come twice, and money too wide for the narrow type."""
    lines = [*STAR["lineitem"][1], (1, 1, 1, 7, 5.0, 9e12, -50.0, "R", "F"), (1, 89, None, 3, None, None, 0.0, None, None), (1, 89, 1, 3, 4.0, 8.0, 0.0, "R", None), (1, None, 1, 1, 1.0, 1.0, 0.0, "N", "F")]
    tables = {**STAR, "lineitem": (STAR["lineitem"][0], lines), "part": (STAR["part"][0], [*STAR["part"][1], (89, "oak", "Brand#1", "ECONOMY", 50, 9e12), (89, None, None, None, None, None)])}
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    plain, early = mart.mart_columns(mart.star_rows(spark, str(tmp_path))), mart.mart_columns(mart.star_rows(spark, str(tmp_path), early=True))
    assert plain.schema.simpleString() == early.schema.simpleString()
    got = sorted(map(str, early.collect()))
    assert len(got) > 6 and got == sorted(map(str, plain.collect())) and any("459000000000000" in r for r in got)


def test_page_caches_its_columns_or_reads_the_whole_mart(spark, tmp_path):
    """A page's load writes what the page reads (F3, F4); where the whole mart is cached, nothing more is written."""
    path = _star(spark, tmp_path)
    own = cache.cached_mart(spark, path, columns=PAGE_COLUMNS["r11_geography"])
    stored = spark.read.parquet(own.inputFiles()[0].rpartition("/YearLabel=")[0])
    assert set(stored.columns) == {"YearLabel", "SaleTotal", "TicketCost", "Profit", "State"}
    whole = cache.cached_mart(spark, path)
    again = cache.cached_mart(spark, path, columns=PAGE_COLUMNS["r11_geography"])
    assert set(again.inputFiles()) <= set(whole.inputFiles()) and again.columns == own.columns
    assert sorted(map(str, again.collect())) == sorted(map(str, own.collect())) and own.count() == 6
