"""Every report bundle builds lazily and every frame in it runs on sf0.001."""

import pytest

from marginmart.operators import scope, shares
from marginmart.plans import reports


@pytest.mark.parametrize("page", sorted(reports.PAGES))
def test_bundle_runs(spark, enriched_small, page):
    fn = reports.PAGES[page]
    kwargs = {}
    if page in ("Affiliate Performance",):
        kwargs["affiliate"] = enriched_small.select("CompanyName").dropna().first()[0]
    if page == "Affiliate Head-to-Head":
        names = [r[0] for r in enriched_small.select("CompanyName").dropna().distinct().orderBy("CompanyName").limit(2).collect()]
        kwargs = {"a": names[0], "b": names[1]}
    bundle = fn(enriched_small, **kwargs)
    assert bundle
    for key, df in bundle.items():
        df.limit(5).collect()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_bundles_hold_the_pages_frames(enriched_small):
    ty = scope.split_years(enriched_small)[0]
    name = enriched_small.select("CompanyName").dropna().first()[0]
    own = reports.affiliate_performance(enriched_small, name)
    assert rows(own["marketplace_mix"]) == rows(shares.share_by(scope.split_years(scope.scope(enriched_small, name))[0], "ShippingCompany"))
    market = reports.marketplace(enriched_small)
    assert rows(market["delivery_share"]) == rows(shares.share_by(ty, "DeliveryType"))
    assert {r["grp"] if "grp" in r else r[0] for r in market["margin_box"].collect()} <= {r[0] for r in ty.select("ShippingCompany").distinct().collect()}
    tickets = reports.ticket_type(enriched_small, metric="Orders")
    assert rows(tickets["quantity_share"]) == rows(shares.order_share_by(ty, "QuantityBucket"))
    teams = reports.team_performance(enriched_small, top_n=40, metric="Orders")
    assert teams["bars"].count() == 80
    assert reports.top_events(enriched_small, n=70)["top"].count() == 70


@pytest.mark.parametrize("metric", ["SaleTotal", "Margin"])
def test_two_way_grids_have_their_ranges(enriched_small, metric):
    import numpy as np

    bundle = reports.heatmap_hub(enriched_small, metric)
    values = {name: [r.value for r in bundle[name].collect()] for name in ("sport", "marketplace", "teams")}

    def zmax(*names):
        xs = [v for n in names for v in values[n] if v != 0]
        p = round(float(np.quantile(xs, 0.98)), 6)
        return p if p > 0 else max(xs)

    own = metric == "Margin"
    assert ("shared_range" in bundle) != own and ("sport_range" in bundle) == own
    for name in values:
        names = [name] if own or name == "teams" else ["sport", "marketplace"]
        z = bundle[f"{name}_range" if own or name == "teams" else "shared_range"].first().zmax
        assert z == pytest.approx(zmax(*names), rel=1e-9)
        cells = bundle[f"{name}_intensity"].collect()
        assert len(cells) == len(values[name]) and all(r.intensity == r.value / z for r in cells)
        assert all((r.label is not None) == r.labeled == (r.value != 0 and abs(r.value) >= z * 0.03) for r in cells)


def test_all_dimensions_equal_the_single_tables(spark, enriched_small):
    from marginmart.operators import compare
    from marginmart.plans.catalog import YOY_DIMENSIONS

    both = compare.yoy_tables(enriched_small, YOY_DIMENSIONS)
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem") <= plan.count("Expand") * 20 and plan.count("Aggregate") == 1, "one aggregation of one scan"
    got = rows(both)
    want = []
    for name, col in YOY_DIMENSIONS.items():
        want += [(name, *r) for r in map(tuple, compare.yoy_table(enriched_small, col).collect())]
    assert got == sorted(want, key=str)
    top = compare.yoy_tables(enriched_small, YOY_DIMENSIONS, top_n=3)
    first = []
    for name, col in YOY_DIMENSIONS.items():
        first += [(name, *r) for r in map(tuple, compare.yoy_table(enriched_small, col, top_n=3).collect())]
    assert rows(top) == sorted(first, key=str)
