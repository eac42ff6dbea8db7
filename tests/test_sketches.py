"""Frequent and distinct texts by key, samples of the first rows, and profiles that merge, against plain counts."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from lustra.operators import profile, sketches, stats
from lustra.session import stage


def texts_around_the_limit():
    """Short and long texts, many with the same beginning, with ties in every position."""
    rng = random.Random(5)
    head = "x" * stats.SHORT
    pool = ["", "a", head, head[:-1], head + "a", head + "b", head + "b" * 500, head[:-1] + "y" + "z" * 100, "é" * 64, "é" * 65, "é" * 66, None]
    pool += [head + chr(97 + k) * 3 for k in range(12)]
    return [rng.choice(pool) for _ in range(400)] + ["long " * 50 + str(k) for k in range(60)]


def plain_top(values, k):
    counts = Counter(v for v in values if v is not None)
    # Code-point order is the order of the encoded bytes.
    return [(r + 1, v, n) for r, (v, n) in enumerate(sorted(counts.items(), key=lambda c: (-c[1], c[0].encode()))[:k])]


@pytest.mark.parametrize("k", [1, 5, 9, 40, 1000])
def test_top_values_of_long_texts(spark, k):
    values = texts_around_the_limit()
    other = ["t" * 80 + str(i % 3) if i % 4 else None for i in range(len(values))]
    df = spark.createDataFrame(list(zip(values, other)), "s string, t string").repartition(3)
    found = sorted((r["column"], r["rank"], r["value"], r["n"]) for r in profile.top_values(df, ["s", "t"], k).collect())
    assert found == [("s", *t) for t in plain_top(values, k)] + [("t", *t) for t in plain_top(other, k)]


def test_top_values_when_every_text_begins_alike(spark, monkeypatch):
    """All texts are candidates for the last places; beyond the limit they are joined, not broadcast."""
    monkeypatch.setattr(stats, "LOOKED_UP", 10)
    values = ["License " * 20 + f"{k * 7919 % 1000:03d}" for k in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    assert [(r["rank"], r["value"], r["n"]) for r in profile.top_values(df, ["s"], 4).orderBy("rank").collect()] == plain_top(values, 4)


def test_unique_counts_and_modes_of_long_texts(spark):
    values = texts_around_the_limit()
    df = spark.createDataFrame([(v, i % 7) for i, v in enumerate(values)], "s string, n int")
    found = {r["column"]: r["unique_count"] for r in profile.column_uniques(df).collect()}
    assert found == {"s": len({v for v in values if v is not None}), "n": 7}
    assert stats.modes(df, ["s"])["s"] == plain_top(values, 1)[0][1]
    assert profile.count_duplicate_rows(df.select("s")).first()[0] == len(values) - len(set(values))


def test_duplicate_rows_of_nested_columns(spark):
    rows = [({"a": 1}, [1, 2], "x"), ({"a": 1}, [1, 2], "x"), ({"a": 1}, None, "x"), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "m map<string,int>, l array<int>, s string")
    assert profile.dataset(df).first().asDict() == {"rows": 5, "columns": 3, "total_missing": 7, "missing_pct": 46.67, "duplicate_rows": 2}


def test_keys_stay_short(spark):
    df = spark.createDataFrame([(v,) for v in texts_around_the_limit()], "s string")
    longest = stats.key_counts(df, ["s"]).selectExpr("max(char_length(value)) AS n").first()["n"]
    assert longest == stats.SHORT + 32


def test_approximate_profile_counts_its_winners(spark):
    rng = random.Random(2)
    values = [rng.choice("aaaabbbcc") if rng.random() < 0.7 else None if rng.random() < 0.3 else "L" * 70 + str(rng.randrange(300)) for _ in range(2000)]
    numbers = [float("nan") if i % 50 == 0 else -0.0 if i % 3 == 0 else 0.0 if i % 3 == 1 else float(i) for i in range(2000)]
    df = spark.createDataFrame(list(zip(values, numbers)), "s string, x double")
    found = [(r["rank"], r["value"], r["n"]) for r in profile.top_values(df, ["s", "x"], 3, exact=False).filter("column = 's'").orderBy("rank").collect()]
    assert found == plain_top(values, 3)
    zero = profile.top_values(df, ["x"], 1, exact=False).first()
    assert (zero["value"], zero["n"]) == ("0.0", sum(x == 0 for x in numbers))
    rows = {r["column"]: r for r in profile.profile(df, exact=False).collect()}
    assert abs(rows["s"]["unique_count"] - len(set(values) - {None})) <= 30 and [t["value"] for t in rows["s"]["top_values"]][:3] == ["a", "b", "c"]


def test_samples_look_at_first_rows_then_once_more(spark):
    rows = [(k, k % 3, None if k % 400 else f"r{k}", None if k < 3000 else "late", None) for k in range(5000)]
    df = spark.createDataFrame(rows, "k long, a int, sparse string, late string, none string")
    staged = stage(df.repartition(6))
    found = profile.sample_values(staged, ["k"], k=4)
    got = {}
    for r in found.orderBy("column", "rank").collect():
        got.setdefault(r["column"], []).append(r["value"])
    assert got == {"k": list("0123"), "a": list("0120"), "sparse": ["r0", "r400", "r800", "r1200"], "late": ["late"] * 4}
    wide = staged.selectExpr("k", *[f"a + {i} AS a{i}" for i in range(20)], *["sparse AS s1", "sparse AS s2", "none AS s3"])
    plan = profile.sample_values(wide, ["k"])._jdf.queryExecution().executedPlan().toString()
    # The first rows, and one scan for all columns that are empty there.
    assert plan.count("FileScan parquet") == 2 and plan.count("WindowGroupLimit") >= 1


def test_summary_lines_of_the_table(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    lines = profile.profile_summary(profile.profile(df), profile.dataset(df)).orderBy("position").collect()
    assert [r["summary"] for r in lines[:3]] == ["3 rows, 2 columns", "2 cells missing (33.33%)", "1 duplicate rows"]
    assert [r["column"] for r in lines] == [None, None, None, "a", "b"]


@pytest.fixture(scope="module")
def parts(spark):
    rng = random.Random(9)
    rows = []
    for i in range(30_000):
        x = None if i % 17 == 0 else float("nan") if i % 19 == 0 else rng.lognormvariate(3, 2)
        rows.append((i % 4, x, rng.randrange(5000), rng.choice(["p"] * 5 + ["q"] * 3 + ["L" * 99, None])))
    return spark.createDataFrame(rows, "day int, x double, n long, s string")


def test_merged_profile_equals_that_of_the_union(spark, parts):
    stored = stage(sketches.sketch(parts, ["day"]))
    assert stored.count() == 4 * 4
    merged = {r["column"]: r for r in sketches.profile_of(sketches.merge(stored)).collect()}
    whole = {r["column"]: r for r in profile.profile(parts.drop("day")).collect()}
    frame = parts.toPandas()
    for c in ("x", "n", "s"):
        assert (merged[c]["rows"], merged[c]["null_count"]) == (30_000, whole[c]["null_count"])
        assert abs(merged[c]["unique_count"] / whole[c]["unique_count"] - 1) < 0.05
    for c in ("x", "n"):
        for k in ("mean", "std", "min", "max"):
            assert merged[c][k] == pytest.approx(whole[c][k], rel=1e-6)
        values = frame[c].dropna().round(6)
        for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            assert (values < merged[c][q]).mean() - sketches.RANK_ERROR <= p <= (values <= merged[c][q]).mean() + sketches.RANK_ERROR
    assert [(t["value"], t["n"]) for t in merged["s"]["top_values"][:2]] == [(t["value"], t["n"]) for t in whole["s"]["top_values"][:2]]
    assert merged["s"]["mean"] is None and merged["x"]["top_values"] is None


def test_merging_in_steps_and_by_group(spark, parts):
    stored = stage(sketches.sketch(parts, ["day"]).withColumn("half", sketches.F.expr("day DIV 2")))
    by_half = sketches.merge(stored, ["half"])
    twice = {r["column"]: r for r in sketches.profile_of(sketches.merge(by_half.drop("half"))).collect()}
    once = {r["column"]: r for r in sketches.profile_of(sketches.merge(stored.drop("half"))).collect()}
    for c in ("x", "n"):
        assert twice[c]["mean"] == pytest.approx(once[c]["mean"]) and twice[c]["std"] == pytest.approx(once[c]["std"])
        assert (twice[c]["rows"], twice[c]["min"], twice[c]["unique_count"]) == (once[c]["rows"], once[c]["min"], once[c]["unique_count"])
    halves = sketches.profile_of(by_half).filter("column = 'n'").collect()
    assert sorted((r["half"], r["rows"]) for r in halves) == [(0, 15_000), (1, 15_000)]


def test_merged_dataset_numbers(spark, parts):
    exact = profile.dataset(parts.drop("day")).first()
    found = sketches.dataset_of(sketches.merge(sketches.sketch(parts, ["day"]))).first()
    assert (found["rows"], found["columns"], found["total_missing"]) == (exact["rows"], exact["columns"], exact["total_missing"])
    assert abs(found["duplicate_rows"] - exact["duplicate_rows"]) <= 0.03 * exact["rows"]


def test_sketches_of_odd_tables(spark):
    kinds = "d int, m map<string,int>, l array<int>, b boolean, e string, f double"
    df = spark.createDataFrame([(1, {"a": 1}, [1], True, None, float("nan")), (2, None, None, None, None, None)], kinds)
    found = {r["column"]: r for r in sketches.profile_of(sketches.merge(sketches.sketch(df, ["d"]))).collect()}
    assert found["m"]["unique_count"] is None and found["b"]["unique_count"] == 1 and found["m"]["null_count"] == 1
    assert (found["e"]["unique_count"], found["e"]["top_values"], found["f"]["median"], found["f"]["min"]) == (0, [], None, None)
    none = sketches.merge(sketches.sketch(df.limit(0), ["d"]))
    assert none.collect() == []
    wide = spark.range(20).selectExpr(*[f"id % {i + 2} AS c{i}" for i in range(60)])
    assert {r["unique_count"] for r in sketches.profile_of(sketches.merge(sketches.sketch(wide))).collect()} == {min(i + 2, 20) for i in range(60)}
