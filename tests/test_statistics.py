"""Quantiles, modes, fills, outliers and profiles against pandas and numpy."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lustra.operators import missing, outliers, profile, stats
from lustra.plans import advice, rules
from lustra.sources.readers import null_tokens

# Salaries and ages whose statistics are known.
SALARY = [72000, 85000, -5000, 72000, 90000, 67000, 78000, None, 62000, 95000, -5000, 73000, 69000, 110000, 74000, 81000, 77000, 88000, 65000, 79000]


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    rows = []
    for i in range(5000):
        spread = rng.lognormvariate(2, 1) if i % 3 else 7.0  # a third of the rows share a value
        rows.append((i, spread if i % 11 else None, float("nan") if i % 13 == 0 else rng.uniform(-5, 5), rng.randrange(50)))
    return spark.createDataFrame(rows, "i long, spread double, holes double, whole long")


def test_quantiles_agree_with_pandas_on_every_path(numbers):
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    names = ["spread", "holes", "whole"]
    frame = numbers.toPandas()
    want = {c: frame[c].quantile(probs).tolist() for c in names}
    ways = (
        {}, {"bracket": 500, "accuracy": 100}, {"bracket": 1, "accuracy": 20}, {"bracket": 50, "accuracy": 1000}, {"rows": 5000}, {"rows": 10**9},
    )
    for way in ways:
        found = stats.quantiles(numbers, names, probs, **way)
        for c in names:
            assert found[c] == pytest.approx(want[c], rel=1e-12), (way, c)


def test_approximate_quantiles_stay_within_their_error(numbers):
    found = stats.quantiles(numbers, ["holes"], [0.25, 0.5, 0.75], exact=False, accuracy=200)["holes"]
    values = np.sort(numbers.toPandas()["holes"].dropna())
    for p, v in zip((0.25, 0.5, 0.75), found):
        assert abs(np.searchsorted(values, v) / len(values) - p) <= 2 / 200


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "x double")
    assert stats.quantiles(empty, ["x"], [0.5]) == {"x": [None]}
    assert stats.quantiles(empty, [], [0.5]) == {}


def test_modes_take_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", 10, 1.0), ("a", 9, float("nan")), ("b", 9, float("nan")), ("a", 10, 2.0), (None, None, 2.0)], "s string, n long, d double")
    assert stats.modes(df, ["s", "n", "d"]) == {"s": "a", "n": 9, "d": 2.0}
    assert stats.modes(df.filter("s IS NULL").select("s"), ["s"]) == {}


def column(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).collect()]


def frame(spark, values, kind):
    return spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")


def test_fills(spark):
    money = frame(spark, [50000.0, None, 80000.0, None, 70000.0], "double")
    assert column(missing.fill_median(money, "x"), "x")[1] == 70000.0
    assert column(missing.fill_mean(money, "x"), "x")[1] == pytest.approx(200000 / 3)
    dept = frame(spark, ["Eng", "Eng", None, "HR", None], "string")
    assert column(missing.fill_mode(dept, "x"), "x") == ["Eng", "Eng", "Eng", "HR", "Eng"]
    assert column(missing.fill_mean(dept, "x"), "x")[2] is None
    assert column(missing.fill_constant(dept, "x"), "x")[2] == "unknown"
    flags = frame(spark, [True, None], "boolean")
    assert column(missing.fill_constant(flags, "x"), "x") == ["true", "unknown"]
    whole = frame(spark, [1, None, 2], "long")
    assert column(missing.fill_median(whole, "x"), "x") == [1.0, 1.5, 2.0]
    assert column(missing.fill_constant(whole, "x", 0), "x") == [1, 0, 2]
    assert column(missing.fill_mode(frame(spark, [None, None], "string"), "x"), "x") == [None, None]


def test_dropping_missing(spark):
    df = spark.createDataFrame([(1, 1), (None, 2), (None, 3), (None, 4)], "a int, b int")
    assert missing.drop_missing_cols(df, 0.5).columns == ["b"]
    assert missing.drop_missing_rows(df, "a").count() == 1
    assert missing.drop_missing_rows(df, threshold=0.5).count() == 4
    assert missing.drop_missing_rows(df, threshold=0.0).count() == 1
    assert missing.drop_missing_cols(df.limit(0), 0.5).columns == ["a", "b"]


def test_iqr_and_zscore(spark):
    ages = frame(spark, [25, 30, 28, 999, 27, 32, None], "long")
    assert outliers.fit_iqr(ages, "x")["x"] == (20.875, 37.875)
    assert column(outliers.cap_iqr(ages, "x"), "x") == [25, 30, 28, 37.875, 27, 32, None]
    assert outliers.remove_iqr(ages, "x").count() == 5
    known = pd.Series([25, 30, 28, 999, 27, 32.0])
    high = known.mean() + 1.0 * known.std()
    assert max(v for v in column(outliers.cap_zscore(ages, "x", 1.0), "x") if v is not None) == pytest.approx(high)
    flat = frame(spark, [5.0, 5.0, None], "double")
    assert column(outliers.cap_zscore(flat, "x"), "x") == [5.0, 5.0, None]
    assert column(outliers.cap_zscore(frame(spark, [5.0], "double"), "x"), "x") == [5.0]
    texts = frame(spark, ["a", "b"], "string")
    assert outliers.cap_iqr(texts, "x").columns == outliers.remove_iqr(texts, "x").columns == ["i", "x"]


@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), min_size=1, max_size=30))
@settings(max_examples=8, deadline=None, database=None)
def test_clipping_keeps_nulls_and_bounds(spark, values):
    df = frame(spark, values, "double")
    bounds = outliers.fit_iqr(df, "x")
    once = outliers.apply_clip(df, bounds)
    clipped = column(once, "x")
    assert [v is None for v in clipped] == [v is None for v in values]
    for v in clipped:
        if v is not None:
            low, high = bounds["x"]
            assert low <= v <= high
    assert column(outliers.apply_clip(once, bounds), "x") == clipped


def test_low_variance(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (1, 1.001, "b"), (1, 9.0, "c")], "flat int, wide double, s string")
    assert outliers.drop_low_variance(df, 0.01).columns == ["wide", "s"]
    assert outliers.drop_low_variance(df.limit(1), 0.01).columns == ["flat", "wide", "s"]


def test_profile_of_known_salaries(spark):
    df = spark.createDataFrame([(i + 1, v, f"n{i % 3}") for i, v in enumerate(SALARY)], "id long, salary long, s string")
    rows = {r["column"]: r for r in profile.profile(df, ["id"]).collect()}
    money = rows["salary"]
    assert (money["null_count"], money["null_pct"], money["unique_count"]) == (1, 5.0, 17)
    assert (money["mean"], money["median"], money["std"]) == (69842.105263, 74000.0, 28742.657338)
    assert (money["min"], money["max"], money["q1"], money["q3"], money["outlier_count_iqr"]) == (-5000, 110000, 68000, 83000, 3)
    assert money["distribution"]["counts"] == [2, 0, 0, 0, 0, 1, 7, 5, 3, 1]
    assert money["distribution"]["edges"][:2] == [-5000.0, 6500.0]
    assert money["sample_values"] == ["72000", "85000", "-5000", "72000", "90000"]
    assert (rows["id"]["mean"], rows["id"]["std"], rows["id"]["q1"], rows["id"]["q3"]) == (10.5, 5.91608, 5.75, 15.25)
    assert [(t["value"], t["n"]) for t in rows["s"]["top_values"]] == [("n0", 7), ("n1", 7), ("n2", 6)]
    assert rows["s"]["mean"] is None and rows["s"]["numeric_text_pct"] == 0.0


def test_profile_copes_with_odd_columns(spark):
    df = spark.createDataFrame([(True, [1], {"a": 1}, None, 3.0), (None, [2], {"b": 2}, None, 3.0)], "f boolean, l array<int>, m map<string,int>, e string, one double")
    rows = {r["column"]: r for r in profile.profile(df, ["one"]).collect()}
    assert rows["f"]["unique_count"] == 1 and rows["f"]["mean"] is None
    assert rows["l"]["unique_count"] is None and rows["m"]["null_count"] == 0
    assert rows["e"]["unique_count"] == 0 and rows["e"]["top_values"] is None
    # A single value is put in the middle bin.
    assert rows["one"]["distribution"]["counts"] == np.histogram([3.0, 3.0], bins=10)[0].tolist()
    assert profile.shape(df).first().asDict() == {"rows": 2, "columns": 5, "total_missing": 3, "missing_pct": 30.0}
    approx = {r["column"]: r["unique_count"] for r in profile.profile(df, exact=False).collect()}
    assert approx["one"] == 1


def test_histogram_counts_equal_numpy(numbers):
    found = profile.histograms(numbers, ["holes"]).orderBy("bin").collect()
    counts, edges = np.histogram(numbers.toPandas()["holes"].dropna(), bins=10)
    assert [r["n"] for r in found] == counts.tolist()
    assert [r["low"] for r in found] == [round(e, 4) for e in edges[:-1]]


def test_duplicate_rows_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert profile.count_duplicate_rows(df).first()[0] == 1


def test_advice_feeds_the_rules(spark):
    rows = [(i, None if i < 19 else "z", str(i) if i else "n/k", 1000.0 if i == 3 else (None if i == 4 else float(i))) for i in range(20)]
    df = spark.createDataFrame(rows, "i long, empty string, digits string, x double")
    found = advice.advice_dict(advice.suggest_rules(profile.profile(df)))
    assert found["drop_columns"] == ["empty"]
    assert found["cast_types"] == {"digits": "numeric"}
    assert found["fill_missing"] == {"x": "median"} and found["outlier_strategy"] == "cap_iqr"
    base = rules.rules_with()
    merged = rules.merge_advice(found, base)
    assert merged["drop_columns"] == ["empty"] and merged["fill_missing"]["x"] == "median"
    assert base["drop_columns"] == [] and "x" not in base["fill_missing"]


def test_null_tokens(spark):
    df = spark.createDataFrame([("NA", float("nan"), "ok"), ("", 1.0, None), ("None", 2.0, "n/a")], "a string, b double, c string")
    assert [tuple(r) for r in null_tokens(df).collect()] == [(None, None, "ok"), (None, 1.0, None), (None, 2.0, None)]
    assert not any(math.isnan(r["b"]) for r in null_tokens(df).collect() if r["b"] is not None)


INF = float("inf")


@pytest.mark.parametrize("extra", [[INF], [-INF], [INF, -INF], [float("nan")], [INF] * 5])
def test_infinite_values_wipe_nothing(spark, extra):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, *extra]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    kept = [v for v in values if v == v]
    for done in (outliers.cap_iqr(df, "x"), outliers.cap_zscore(df, "x")):
        got = [r["x"] for r in done.collect() if r["x"] is not None]
        assert len(got) == len(kept) and all(v == v for v in got) and {1.0, 8.0} <= set(got)
    row = profile.column_numbers(df).collect()[0]
    assert row["outlier_count_iqr"] <= len(extra)
    assert profile.profile(df).collect()[0]["outlier_count_iqr"] == row["outlier_count_iqr"]
    bins = profile.histograms(df).collect()
    assert sum(r["n"] for r in bins) in (0, len(kept)) and all(r["low"] == r["low"] for r in bins)


def test_quantiles_do_not_depend_on_the_bracket(spark):
    rows = [((k * 7919) % 40_009 / 100,) for k in range(3000)]
    df = spark.createDataFrame(rows, "x double")
    found = [stats.quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.9], bracket=b)["x"] for b in (10, 100, 100_000)]
    assert found[0] == found[1] == found[2] == stats.quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.9], rows=3000)["x"]
    empty = spark.createDataFrame([(None,)], "x double")
    assert stats.quantiles(empty, ["x"], [0.5], rows=1) == {"x": [None]}


def test_one_rounding_rule(spark):
    df = spark.createDataFrame([(None if k == 0 else 1,) for k in range(800)], "x int")
    assert profile.profile(df).collect()[0]["null_pct"] == profile.column_nulls(df).collect()[0]["null_pct"] == 0.13
