"""Property tests (hypothesis): enrichment text rules and exact quantiles against plain Python."""

import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marginmart.functions import enrich as E
from marginmart.operators.quantiles import quantiles

SECTION_TEXT = st.text(alphabet="abcXYZ019- .#", max_size=12)


def model_section(section, seats):
    s = (section or "").upper()
    digits = "".join(re.findall(r"[0-9]+", s))
    letters = "".join(re.findall(r"[A-Z]+", s))
    text = digits if digits else (seats or "").split("-")[0].strip(" ")
    try:
        num = float(text)
    except ValueError:
        num = None
    return num, letters


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), SECTION_TEXT), st.one_of(st.none(), SECTION_TEXT)),
                min_size=1, max_size=20))
def test_section_rules_match_model(spark, rows):
    df = spark.createDataFrame(rows, "Section string, Seats string")
    got = df.select(E.section_number("Section", "Seats").alias("n"), E.section_letters("Section").alias("t")).collect()
    for (section, seats), r in zip(rows, got):
        num, letters = model_section(section, seats)
        assert r.t == letters
        if num is None or np.isinf(num):
            assert r.n is None or np.isinf(r.n)
        else:
            assert r.n == pytest.approx(num)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(-50, 50)), min_size=1, max_size=60))
def test_quantiles_match_numpy_property(spark, rows):
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g string, v double")
    probs = {"p0": 0.0, "p33": 0.33, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: r for r in quantiles(df, ["g"], "v", probs, digits=None).collect()}
    for g in {g for g, _ in rows}:
        xs = np.array([v for gg, v in rows if gg == g], dtype=float)
        for name, p in probs.items():
            assert getattr(got[g], name) == pytest.approx(float(np.quantile(xs, p)), abs=1e-9)


def model_lead_bucket(d):
    if d is None:
        return "Unknown"
    if d < 0:
        return "Post-event sale"
    if d == 0:
        return "Same day"
    for hi, label in ((3, "1-3 days"), (7, "4-7 days"), (30, "1-4 weeks"), (90, "1-3 months")):
        if d <= hi:
            return label
    return "3+ months"


def model_num_tier(n):
    if n is None:
        return "Unknown"
    for hi, label in ((100, "Floor / Low (<100)"), (200, "Lower Bowl (100s)"), (300, "Mid Level (200s)"),
                      (400, "Upper Mid (300s)")):
        if int(n) < hi:
            return label
    return "Upper Deck (400s+)"


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-400, 400)),
                          st.one_of(st.none(), st.floats(-50, 900, allow_nan=False))), min_size=1, max_size=30))
def test_bucket_rules_match_model(spark, rows):
    df = spark.createDataFrame(rows, "d bigint, n double")
    got = df.select(E.lead_time_bucket("d").alias("b"), E.section_num_tier("n").alias("t")).collect()
    for (d, n), r in zip(rows, got):
        assert r.b == model_lead_bucket(d)
        assert r.t == model_num_tier(n)


def test_timestamp_formats(spark):
    import datetime as dt
    vals = ["2024-10-03 10:00:00", "2024-10-03", "10/3/2024 10:05", "10/3/2024", "2024/10/03", "garbage", None]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    got = [r[0] for r in df.select(E.timestamp("x")).collect()]
    assert got == [dt.datetime(2024, 10, 3, 10), dt.datetime(2024, 10, 3), dt.datetime(2024, 10, 3, 10, 5),
                   dt.datetime(2024, 10, 3), dt.datetime(2024, 10, 3), None, None]
