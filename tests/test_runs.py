"""Files, cleaning runs and streams."""

from __future__ import annotations

import datetime as dt
import json

import pandas as pd
import pytest

from lustra import session
from lustra.operators import casting, textual
from lustra.plans.clean import clean, job_summary
from lustra.plans.rules import DEFAULT_RULES, rules_with
from lustra.sources import readers, writers
from lustra.streaming import clean_stream as streaming

CSV = ''' id ,name,age,salary,active,code
1,Ann,30,1000,true,007
2,"Lee, ""Bo""",NA,2000,false,x
3,Kim,thirty,NaN,,NULL
4,,41,1e3,True,9
'''


def test_csv_types_and_nulls(spark, tmp_path):
    (tmp_path / "a.CSV").write_text(CSV)
    df = readers.read_any(spark, str(tmp_path / "a.CSV"))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "age": "string", "salary": "double", "active": "boolean", "code": "string"}
    got = [tuple(r) for r in df.orderBy("id").collect()]
    assert got[1] == (2, 'Lee, "Bo"', None, 2000.0, False, "x") and got[2] == (3, "Kim", "thirty", None, None, None)
    assert set(dict(readers.read_csv(spark, str(tmp_path / "a.CSV"), infer=False).dtypes).values()) == {"string"}
    fixed = readers.read_csv(spark, str(tmp_path / "a.CSV"), schema="id long, name string, age string, salary double, active boolean, code string")
    assert fixed.count() == 4


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', 1.5), (2, "c\td", None)], "id long, s string, x double")
    writers.write_csv(df, str(tmp_path / "t.csv"))
    writers.write_tsv(df, str(tmp_path / "t.tsv"))
    df.write.parquet(str(tmp_path / "t.parquet"))
    for name in ("t.csv", "t.tsv", "t.parquet"):
        back = readers.read_any(spark, str(tmp_path / name))
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect())), name


def test_json_documents_and_lines(spark, tmp_path):
    rows = [{"a ": 1, "b": "x"}, {"a ": 2, "b": None}]
    (tmp_path / "d.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "l.jsonl").write_text("\n".join(map(json.dumps, rows)))
    for name in ("d.json", "l.jsonl"):
        df = readers.read_any(spark, str(tmp_path / name))
        assert sorted(map(tuple, df.select("a", "b").collect())) == [(1, "x"), (2, None)]


def test_unknown_formats_and_colliding_names(spark):
    with pytest.raises(ValueError):
        readers.read_any(spark, "/tmp/x.docx")
    with pytest.raises(ValueError):
        readers.normalize_columns(spark.createDataFrame([(1, 2)], ["a", "a "]))


def test_reports(spark, tmp_path):
    from lustra.operators.profile import profile

    df = spark.createDataFrame([(1, "a")], "id long, s string")
    for job in ("j1", "j2"):
        writers.write_profile(profile(df), str(tmp_path / "profiles"), job)
    back = spark.read.json(str(tmp_path / "profiles"))
    assert back.groupBy("job_id").count().count() == 2
    _, audit = clean(df)
    writers.write_audit(audit, str(tmp_path / "audit"), "j1")
    assert "written_at" in spark.read.json(str(tmp_path / "audit")).columns
    assert writers.flat(profile(df)).schema["top_values"].dataType.simpleString() == "string"


def test_cast_types_keeps_what_it_does_not_know(spark):
    df = spark.createDataFrame([("1", "yes", "2021-01-02", "z")], "n string, b string, d string, o string")
    out = casting.cast_types(df, {"n": "int", "b": "boolean", "d": "date", "o": "strange", "gone": "int"})
    assert [t for _, t in out.dtypes] == ["double", "boolean", "timestamp", "string"]


def test_canonical_labels_from_a_table(spark):
    df = spark.createDataFrame([("ENG ",), ("new lab",), (None,)], "d string")
    aliases = spark.createDataFrame([("eng", "Engineering"), (" Eng", "Engineering")], "alias string, label string")
    assert {r["d"] for r in textual.canonical_from_table(df, "d", aliases).collect()} == {"Engineering", "New Lab", None}


# Ages and salaries whose cleaned values are known.
AGES = ["28", None, "35", "28", "42", "999", "31", "29", "26", "38", "35", None, "27", "45", "thirty", "33", "29", "36", None, "31"]
SALARIES = [72000, 85000, -5000, 72000, 90000, 67000, 78000, None, 62000, 95000, -5000, 73000, 69000, 110000, 74000, 81000, 77000, 88000, 65000, 79000]


def staff(spark):
    rows = [
        (i + 1, f"  Name {i} ", age, None if i == 6 else f"U{i}@X.com", None if i == 11 else "555-1234", salary, None if i == 5 else i != 17)
        for i, (age, salary) in enumerate(zip(AGES, SALARIES))
    ]
    return spark.createDataFrame(rows, "id long, name string, age string, email string, phone string, salary long, is_active boolean")


def test_default_cleaning(spark):
    raw = staff(spark)
    cleaned, audit = clean(raw)
    out = {int(r["id"]): r for r in cleaned.collect()}
    assert len(out) == 20 and cleaned.columns == raw.columns
    assert (out[3]["salary"], out[14]["salary"], out[8]["salary"]) == (48250.0, 102250.0, 74000.0)
    assert out[6]["age"] == 48.125 and sorted(i for i in out if out[i]["age"] is None) == [2, 12, 15, 19]
    assert (out[7]["email"], out[12]["phone"], out[6]["is_active"]) == ("unknown@example.com", "000-000-0000", "unknown")
    assert out[1]["name"] == "name 0" and out[1]["email"] == "u0@x.com"
    steps = [(r["step"], r["column"], r["rows_affected"]) for r in audit.orderBy("seq").collect()]
    assert steps == [
        ("fill_missing", "age", 0), ("fill_missing", "email", 1), ("fill_missing", "phone", 1), ("fill_missing", "salary", 1),
        ("fill_missing", "is_active", 1), ("cast_type", "age", 0), ("cast_type", "salary", 0), ("cast_type", "id", 0),
        ("normalize_text", "name", 0), ("normalize_text", "email", 0), ("outlier_cap_iqr", "age", 0), ("outlier_cap_iqr", "salary", 0),
        ("summary", None, 0),
    ]
    summary = audit.filter("step = 'summary'").first()["detail"]
    assert summary == "20 of 20 rows left, nulls from 7 to 4"
    report = job_summary(raw, cleaned, audit, cleaned.limit(0)).first()
    assert (report["original_rows"], report["rows_removed"], report["cleaning_steps"]) == (20, 0, 13)


def test_cleaning_steps_in_sequence_equal_pandas(spark):
    rows = [(i, None if i % 7 == 0 else float(i % 13), None if i % 5 == 0 else f"t{i % 3}", None if i % 10 else 1.0) for i in (j % 120 for j in range(200))]
    df = spark.createDataFrame(rows, "k long, x double, s string, sparse double")
    rules = {
        "drop_columns_missing_above": 0.8, "fill_missing": {"x": "median", "s": "drop"},
        "outliers": {"strategy": "remove_iqr", "iqr_factor": 0.5, "skip_columns": ["k"]}, "drop_columns": ["nowhere"],
    }
    pdf = pd.DataFrame(rows, columns=["k", "x", "s", "sparse"]).drop(columns=["sparse"]).drop_duplicates()
    before = len(pdf)
    pdf["x"] = pdf["x"].fillna(pdf["x"].median())
    pdf = pdf.dropna(subset=["s"])
    q1, q3 = pdf["x"].quantile(0.25), pdf["x"].quantile(0.75)
    kept = pdf[(pdf["x"] >= q1 - 0.5 * (q3 - q1)) & (pdf["x"] <= q3 + 0.5 * (q3 - q1))]
    cleaned, audit = clean(df, rules)
    assert sorted(map(tuple, cleaned.collect())) == sorted(kept.itertuples(index=False, name=None))
    steps = {r["step"]: r["rows_affected"] for r in audit.collect()}
    assert steps["duplicates"] == 200 - before and steps["outlier_remove_iqr"] == len(pdf) - len(kept)
    assert steps["drop_rows"] == before - len(pdf) and steps["drop_cols"] == 0


def test_other_strategies(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, None, None), (3, 5.0, "a")], "id long, x double, s string")
    out, _ = clean(df, {"default_fill_strategy": "constant_unknown", "outliers": {"strategy": "none"}, "drop_low_variance": True})
    assert {r["x"] for r in out.collect()} == {"5.0", "unknown"}
    out, audit = clean(df, {"fill_missing": {"x": 0}, "outliers": {"strategy": "cap_zscore"}, "duplicates": {"remove": False}, "drop_low_variance": True})
    assert {r["s"] for r in out.collect()} == {"a"}
    assert "outlier_cap_zscore" in {r["step"] for r in audit.collect()}


def test_rules_are_not_shared():
    mine = rules_with({"normalize_text": ["x"]})
    mine["outliers"]["strategy"] = "none"
    assert DEFAULT_RULES["outliers"]["strategy"] == "cap_iqr" and mine["normalize_text"] == ["x"]


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id long, at timestamp, x string, s string"
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), None if i % 9 == 0 else str(i % 50), f" S{i % 4} ") for i in range(300)]
    df = spark.createDataFrame(rows, schema)
    rules = {
        "null_tokens": True, "required": ["x"], "cast_types": {"x": "numeric"}, "normalize_text": ["s"], "clip": {"x": (5, 40)},
        "schema": {"columns": {"s": {"allowed_values": ["s0", "s1", "s2"]}}},
    }
    df.filter("id < 150").repartition(3).write.json(landing)
    streaming.clean_stream(spark, landing, schema, rules, out, state, "json", "id").awaitTermination()
    df.filter("id >= 150").write.mode("append").json(landing)
    for _ in range(2):  # the second start finds nothing new
        streaming.clean_stream(spark, landing, schema, rules, out, state, "json", "id").awaitTermination()
    batch = streaming.checked(df, rules, "id")
    valid = streaming.read_valid(spark, out)
    assert sorted(map(tuple, valid.select("id", "x", "s").collect())) == sorted(map(tuple, batch.filter("is_valid").select("id", "x", "s").collect()))
    assert streaming.read_quarantine(spark, out).count() == batch.filter("NOT is_valid").count() > 0


def test_fitted_rules_are_literals(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, 100.0)], "id long, x double")
    fitted = streaming.fit_row_rules(df, {"x": "median"}, ["x"])
    assert fitted["fill"] == {"x": 3.0}
    low, high = fitted["clip"]["x"]
    assert [r["x"] for r in streaming.apply_row_rules(df, fitted).orderBy("id").collect()] == [1.0, 3.0, 3.0, min(100.0, high)] and low <= 1.0


def test_shared_folder(spark):
    assert session.shared_dir(spark)
    df = spark.createDataFrame([(1, None)], "a int, b void")
    back = session.stage(df)
    assert [tuple(r) for r in back.collect()] == [(1, None)]


def test_stream_of_no_files(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    landing.mkdir()
    schema = "id long, age int"
    rules = {"schema": {"columns": {"age": {"min": 0}}}}
    streaming.clean_stream(spark, str(landing), schema, rules, out, str(tmp_path / "check")).awaitTermination()
    assert streaming.read_valid(spark, out, schema).columns == ["id", "age"]
    assert streaming.read_quarantine(spark, out, schema).count() == 0


def test_release_deletes_staged_tables(spark):
    import os

    from lustra.session import release, shared_dir, stage

    staged = stage(spark.range(5).selectExpr("id", "NULL AS `a``b`"))
    folder = os.path.join(shared_dir(spark).removeprefix("file:"), "lustra", spark.sparkContext.applicationId)
    assert staged.count() == 5 and os.listdir(folder)
    release(spark)
    assert not os.path.exists(folder)
