"""Duplicates, validation, issues, repairs and scores against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from lustra.functions.people import ISSUES, PEOPLE
from lustra.operators import dedup, issues, repair, rows, score, validate
from lustra.sources import people as generated

CELLS = list(PEOPLE)
ROW = ["k", "copy_no"]
PEOPLE_DDL = "k long, copy_no int, " + ", ".join(f"{c} string" for c in CELLS)
ACTION_DDL = "k long, copy_no int, seq long, action_type string, column_name string, new_value string, reason string"


def person(k, copy_no=0, **cells):
    base = {
        "id": str(1000 + k), "name": "Ada Kim", "age": "30", "email": f"u{k}@x.com", "phone": "555-123-4567",
        "salary": "72000", "hire_date": "2021-03-15", "department": "HR", "is_active": "true",
    }
    return (k, copy_no, *(base | cells).values())


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one key, and many of those are equal."""
    rng = random.Random(5)
    data = []
    for i in range(3000):
        key = 7 if i % 3 == 0 else rng.randrange(1000)
        data.append((i, key, rng.randrange(3) if key == 7 else rng.randrange(50), None if i % 17 == 0 else f"v{i % 4}"))
    return spark.createDataFrame(data, "i long, key int, a int, b string").repartition(7), data


def test_whole_row_duplicates(hot):
    df, data = hot
    groups = Counter(r[1:] for r in data)
    plain = df.drop("i")
    assert Counter(map(tuple, dedup.remove_duplicates(plain).collect())) == Counter(list(groups))
    single = dedup.remove_duplicates(plain, keep=False)
    assert Counter(map(tuple, single.collect())) == Counter(g for g, n in groups.items() if n == 1)
    again = dedup.remove_duplicates(dedup.remove_duplicates(plain))
    assert again.count() == len(groups)


@pytest.mark.parametrize("keep", ["first", "last", False])
def test_subset_duplicates(hot, keep):
    df, data = hot
    groups = defaultdict(list)
    for r in data:
        groups[r[1]].append(r)
    if keep is False:
        want = {g[0] for g in groups.values() if len(g) == 1}
    else:
        want = {(min if keep == "first" else max)(g) for g in groups.values()}
    assert set(map(tuple, dedup.remove_duplicates(df, ["key"], keep, "i").collect())) == want


def test_subset_needs_an_order(hot):
    with pytest.raises(ValueError):
        dedup.remove_duplicates(hot[0], ["key"])
    with pytest.raises(ValueError):
        dedup.remove_duplicates(hot[0], keep="middle")


def test_subset_dedup_is_limited_before_the_shuffle(hot):
    plan = dedup.remove_duplicates(hot[0], ["key"], "first", "i")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_flags_and_copies(hot):
    df, data = hot
    whole, keys = Counter(r[1:] for r in data), Counter(r[1] for r in data)
    flagged = dedup.flag_near_duplicate_rows(df, "i", "key")
    assert {r["i"]: r["is_near_duplicate"] for r in flagged.collect()} == {r[0]: keys[r[1]] > 1 for r in data}
    plain = dedup.flag_rows(df, "i", {"same": ["key", "a", "b"], "near": ["key"]})
    assert {r["i"]: (r["same"], r["near"]) for r in plain.collect()} == {r[0]: (whole[r[1:]] > 1, keys[r[1]] > 1) for r in data}
    seen, later = set(), set()
    for r in data:
        (later.add(r[0]) if r[1:] in seen else seen.add(r[1:]))
    assert {r["i"] for r in dedup.later_copies(df, "i").collect()} == later
    assert sum(n - 1 for n in whole.values()) == len(later)
    pair = df.withColumn("j", df.i % 2)
    assert {r["i"] for r in dedup.later_copies(pair, ["i", "j"], ["key", "a", "b"]).collect()} == later


def test_row_numbers_are_consecutive_in_order(hot):
    df, data = hot
    found = sorted((r["row_number"], r["key"], r["i"]) for r in rows.number_rows(df, ["key", "i"]).collect())
    assert found == [(n, key, i) for n, (key, i) in enumerate(sorted((r[1], r[0]) for r in data))]
    assert sorted(r["n"] for r in rows.number_rows(df, name="n").collect()) == list(range(len(data)))


def test_parquet_row_id(spark, tmp_path, hot):
    hot[0].write.parquet(str(tmp_path / "t"))
    df = rows.read_parquet_with_row_id(spark, str(tmp_path / "t"))
    assert df.select("row_file", "row_index").distinct().count() == len(hot[1])


SCHEMA = {
    "columns": {
        "email": {"required": True, "pattern": r"(?P<user>[a-z]+)@"},
        "age": {"type": "numeric", "min": 0, "max": 120},
        "status": {"allowed_values": ["active", "o'k", 3]},
        "absent": {"required": True},
    }
}


def test_validation_rules(spark):
    data = [
        (1, "a@b.com", "25", "active"), (2, None, "999", "gone"), (3, "1@b", "x", "o'k"), (4, "ab@", "nan", None),
        (5, "ab@c\n", "-1", "3"), (6, "ab@c", "1_000", "active"),
    ]
    df = spark.createDataFrame(data, "i int, email string, age string, status string")
    valid, errors = validate.validate(df, SCHEMA, "i")
    found = {(r["i"], r["column"], r["rule"]) for r in errors.collect()}
    assert found == {
        (2, "email", "required"), (2, "age", "max"), (2, "status", "allowed_values"), (3, "email", "pattern"),
        (3, "age", "type"), (5, "age", "min"), (6, "age", "type"), (None, "absent", "missing_column"),
    }
    assert {r["i"] for r in valid.collect()} == {1, 4}
    quarantined = validate.quarantine(df, SCHEMA, "i")
    assert {r["i"] for r in quarantined.collect()} == {2, 3, 5, 6}
    assert {r["i"]: len(r["errors"]) for r in quarantined.collect()} == {2: 3, 3: 2, 5: 1, 6: 1}
    messages = {r["message"] for r in errors.collect() if r["i"] == 2}
    assert "Row 2: 'age' is above 120: 999" in messages and "Row 2: 'email' must not be empty" in messages


def test_validation_of_numbers(spark):
    df = spark.createDataFrame([(25.0,), (float("nan"),), (None,), (999.0,)], "age double")
    schema = {"columns": {"age": {"type": "numeric", "max": 120}}}
    assert validate.valid_rows(df, schema).count() == 3
    assert validate.valid_rows(df, {"columns": {"age": {"required": True}}}).count() == 2
    assert validate.valid_rows(df, {"columns": {"age": {"allowed_values": [25.0]}}}).count() == 3
    assert validate.valid_rows(df, {}).count() == 4
    assert validate.validation_errors(df, {}).count() == 0
    assert [r["errors"] for r in validate.with_errors(df, {}).collect()] == [[]] * 4


def test_bad_patterns_are_found_before_running(spark):
    df = spark.createDataFrame([("a",)], "x string")
    with pytest.raises(Exception):
        validate.valid_rows(df, {"columns": {"x": {"pattern": "("}}})


def test_validation_does_not_shuffle(spark):
    df = spark.createDataFrame([("a", "1", "b")], "email string, age string, status string")
    for found in (validate.valid_rows(df, SCHEMA), validate.quarantine(df, SCHEMA)):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_issue_counts(spark):
    data = [
        person(1), person(1, 1), person(2, name="ADA KIM", age="thirty"), person(2, 1, name="Ada Kim"),
        person(3, email="nope", phone="", salary="-1", hire_date="2021/03/15", is_active="yes", department="hr"),
        person(4, age=None),
    ]
    df = spark.createDataFrame(data, PEOPLE_DDL)
    found = issues.detect_issues(df).first().asDict()
    assert found == {
        "missing_values": 2, "duplicates": 1, "wrong_format": 1, "wrong_type": 1, "invalid_email": 1, "outliers": 1,
        "near_duplicates": 1, "inconsistent_values": 3,
    }
    assert issues.total_issues(issues.detect_issues(df)).first()[0] == 11
    long = issues.issue_counts_long(issues.detect_issues(df)).collect()
    assert {r["issue"]: r["n"] for r in long} == found
    empty = issues.detect_issues(df.limit(0)).first()
    assert [empty[i] for i in ISSUES] == [0] * 8


def test_clean_rows_have_no_issues_and_injected_ones_are_found(spark):
    truth = generated.synthesize_people(spark, 400)
    assert issues.total_issues(issues.detect_issues(truth)).first()[0] == 0
    none = dict.fromkeys(generated.ISSUE_RATES, 0.0)
    kinds = {"age_null": "missing_values", "age_word": "wrong_type", "email_broken": "invalid_email", "salary_outlier": "outliers",
             "phone_digits": "wrong_format", "date_slashes": "wrong_format", "exact_copy": "duplicates", "flag_word": "inconsistent_values"}
    for rate, issue in kinds.items():
        dirty = generated.inject_issues(truth, rates=none | {rate: 0.3})
        found = issues.detect_issues(dirty).first().asDict()
        changed = dirty.count() - 400
        if issue != "duplicates":
            changed = dirty.drop("copy_no").exceptAll(truth).count()
        assert changed > 60 and found[issue] == changed, rate
        assert sum(found.values()) == changed, rate


def test_repairs_follow_the_actions(spark):
    data = [
        person(1, age=""), person(2, age="999"), person(3, age="thirty", phone="5551234567"), person(4, age=None),
        person(5), person(5, 1), person(6), person(6, 1), person(7, hire_date="2021/3/5"), person(8, salary="-5"),
    ]
    actions = [
        (1, 0, 1, "fix_missing", "age", None, ""), (1, 0, 2, "fix_missing", "age", "41.7", ""), (1, 0, 3, "fix_missing", "age", "50", ""),
        (2, 0, 1, "fix_missing", "age", "41", "not missing"), (2, 0, 2, "fix_outlier", "age", "500", "still outside"), (2, 0, 3, "fix_outlier", "age", "35", ""),
        (3, 0, 1, "fix_type", "age", "31.0", ""), (3, 0, 2, "fix_type", "age", "33", "the later wins"), (3, 0, 3, "fix_format", "phone", None, ""),
        (4, 0, 1, "no_op", "age", "9", ""), (4, 0, 1, "fix_missing", "shoe", "9", "no column"), (4, 0, 1, "polish", "age", "9", "no action"),
        (5, 0, 1, "remove_duplicate", "id", None, ""),
        (6, 0, 1, "remove_duplicate", "id", None, "both asked for"), (6, 1, 2, "remove_duplicate", "id", None, "the last stays"),
        (7, 0, 1, "remove_duplicate", "id", None, "no duplicate"), (99, 0, 1, "fix_missing", "age", "9", "no row"),
        (None, None, 9, "fix_format", "hire_date", None, "whole column"),
    ]
    df, todo = spark.createDataFrame(data, PEOPLE_DDL), spark.createDataFrame(actions, ACTION_DDL)
    fixed = repair.apply_repairs(df, todo, ROW)
    assert fixed.columns == df.columns
    found = {(r["k"], r["copy_no"]): r for r in fixed.collect()}
    assert set(found) == {(1, 0), (2, 0), (3, 0), (4, 0), (5, 1), (6, 1), (7, 0), (8, 0)}
    assert [found[k, 0]["age"] for k in (1, 2, 3, 4)] == ["41", "35", "33", None]
    assert found[3, 0]["phone"] == "555-123-4567" and found[7, 0]["hire_date"] == "2021-03-05"

    audit = {(r["k"], r["copy_no"], r["seq"], r["action_type"]): (r["valid"], r["correct"]) for r in repair.repair_audit(df, fixed, todo, ROW).collect()}
    assert audit[1, 0, 2, "fix_missing"] == (True, True)
    assert audit[2, 0, 3, "fix_outlier"] == (True, True) and audit[3, 0, 2, "fix_type"] == (True, True)
    assert audit[5, 0, 1, "remove_duplicate"] == (True, True) and audit[6, 1, 2, "remove_duplicate"] == (False, False)
    assert audit[7, 0, 1, "remove_duplicate"] == (False, False) and audit[4, 0, 1, "no_op"] == (True, False)
    assert audit[99, 0, 1, "fix_missing"] == (False, False) and audit[4, 0, 1, "polish"] == (False, False)


def test_destructive_repairs_are_marked(spark):
    df = spark.createDataFrame([person(1), person(2, age="")], PEOPLE_DDL)
    truth = spark.createDataFrame([person(1), person(2)], PEOPLE_DDL).select(*CELLS)
    todo = spark.createDataFrame(
        [(1, 0, 1, "fix_format", "name", "nobody else", ""), (2, 0, 1, "fix_missing", "age", "44", "wrong but filled")], ACTION_DDL
    )
    audit = repair.repair_audit(df, repair.apply_repairs(df, todo, ROW), todo, ROW, truth=truth)
    assert {r["k"]: r["destructive"] for r in audit.collect()} == {1: True, 2: False}


def test_each_repair_is_judged_on_its_own_step(spark):
    df = spark.createDataFrame([person(1, age=""), person(2, age="999"), person(3, phone="5551234567"), person(4), person(4, 1)], PEOPLE_DDL)
    truth = spark.createDataFrame([person(k) for k in (1, 2, 3, 4)] * 2, PEOPLE_DDL).select(*CELLS)
    actions = [
        (1, 0, 1, "fix_missing", "age", "30", "acts"), (1, 0, 2, "fix_missing", "age", "40", "too late"), (1, 0, 3, "fix_outlier", "age", "50", "no outlier"),
        (2, 0, 1, "fix_outlier", "age", "33", "acts"), (2, 0, 2, "fix_type", "age", "34", "changes, clears nothing"),
        (3, 0, 1, "fix_format", "name", "someone else", "destroys"), (4, 1, 1, "remove_duplicate", "id", None, "copy"),
        (4, 1, 2, "fix_format", "name", "gone", "row is removed"),
        (None, None, 5, "fix_format", "phone", None, "one cell"), (None, None, 6, "fix_missing", "email", "x@y.zz", "none missing"),
        (None, None, 7, "fix_type", "salary", "7", "overwrites all"), (1, 0, 9, "no_op", None, None, ""),
    ]
    todo = spark.createDataFrame(actions, ACTION_DDL)
    fixed = repair.apply_repairs(df, todo, ROW)
    audit = repair.repair_audit(df, fixed, todo, ROW, truth=truth).collect()
    assert len(audit) == len(actions)
    found = {(r["k"], r["seq"]): (r["valid"], r["correct"], r["destructive"], r["rows_changed"]) for r in audit}
    assert found[1, 1] == (True, True, False, 1)
    assert found[1, 2] == found[1, 3] == (False, False, False, 0)
    assert found[2, 1][:2] == (True, True) and found[2, 2][:2] == (True, False)
    assert found[3, 1] == (True, False, True, 1)
    assert found[4, 1] == (True, True, False, 1) and found[4, 2] == (False, False, False, 0)
    assert found[None, 5] == (True, True, False, 1)
    assert found[None, 6] == (False, False, False, 0)
    assert found[None, 7] == (True, False, True, 4)
    assert (found[1, 9][0], found[1, 9][3]) == (True, 0)
    values = {(r["k"], r["seq"]): (r["value_before"], r["value_after"]) for r in audit}
    assert values[2, 1] == ("999", "33") and values[2, 2] == ("33", "34") and values[1, 2] == ("", "")


def test_no_op_is_correct_once_nothing_is_left(spark):
    todo = spark.createDataFrame([(1, 0, 1, "no_op", None, None, ""), (None, None, 2, "no_op", None, None, "")], ACTION_DDL)
    for people, correct in (([person(1)], True), ([person(1, age="")], False), ([person(1), person(1, 1)], False)):
        df = spark.createDataFrame(people, PEOPLE_DDL)
        audit = repair.repair_audit(df, df, todo, ROW).collect()
        assert [(r["valid"], r["correct"], r["rows_changed"]) for r in audit] == [(True, correct, 0)] * 2


def test_true_values_repair_everything(spark):
    truth = generated.synthesize_people(spark, 200)
    dirty = generated.inject_issues(truth, rates={"exact_copy": 0.0, "near_copy": 0.0})
    marked = issues.cell_issues(dirty, ROW)
    kind = """CASE issue WHEN 'missing_values' THEN 'fix_missing' WHEN 'outliers' THEN 'fix_outlier'
      WHEN 'wrong_type' THEN 'fix_type' WHEN 'invalid_email' THEN 'fix_type' ELSE 'fix_format' END"""
    long = truth.unpivot(["k"], CELLS, "column", "new_value")
    todo = marked.join(long, ["k", "column"]).selectExpr(
        "k", "copy_no", "k AS seq", f"{kind} AS action_type", "column AS column_name", "new_value", "'' AS reason"
    )
    fixed = repair.apply_repairs(dirty, todo, ROW)
    assert issues.total_issues(issues.detect_issues(fixed)).first()[0] == 0
    assert score.cell_match_ratio(fixed, truth, CELLS).first()["ratio"] == 1.0
    assert score.cell_match_ratio(dirty, truth, CELLS).first()["ratio"] < 1.0
    assert repair.table_diff(fixed.select(*CELLS), truth.select(*CELLS), "id").count() == 0


def test_proposals_and_automatic_cleaning(spark):
    df = spark.createDataFrame(
        [person(1, age="20"), person(2, age="41"), person(2, 1, age="41"), person(3, age=""), person(4, age="x", email=None, hire_date="2021/03/15")],
        PEOPLE_DDL,
    )
    found = {(r["k"], r["copy_no"], r["action_type"], r["column_name"]): r["new_value"] for r in repair.propose_repairs(df, ROW).collect()}
    assert found == {
        (2, 1, "remove_duplicate", "id"): None, (3, 0, "fix_missing", "age"): "30",
        (4, 0, "fix_missing", "email"): "ada.kim@example.com", (4, 0, "fix_format", "hire_date"): "2021-03-15",
    }
    cleaned = repair.auto_clean(df, ROW)
    assert cleaned.count() == 4
    assert issues.total_issues(issues.detect_issues(cleaned)).first()[0] == 0
    unknown = spark.createDataFrame([person(1, age="")], PEOPLE_DDL)
    assert repair.propose_repairs(unknown, ROW).first()["new_value"] == "30"


def test_table_diff(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 5), (3, "z", 1)], "id int, s string, n int")
    b = spark.createDataFrame([(1, "x", 7), (2, "q", 5), (4, "new", None)], "id int, s string, n int")
    found = {tuple(r) for r in repair.table_diff(a, b, "id").collect()}
    assert found == {
        (1, "n", "changed", None, "7"), (2, "s", "changed", "y", "q"), (3, "s", "removed", "z", None), (3, "n", "removed", "1", None),
        (4, "s", "added", None, "new"),
    }


def test_match_ratio_by_position(spark):
    truth = spark.createDataFrame([("1", "a", None), ("2", "b", "x")], "id string, name string, email string")
    same = score.cell_match_ratio(truth.orderBy("name", ascending=False), truth).first()
    assert (same["matches"], same["cells"], same["ratio"]) == (6, 6, 1.0)
    # The row beyond the end of the truth counts its null cell as equal to an absent one.
    longer = spark.createDataFrame([("1", "a", None), ("2", "b", "x"), ("3", "c", None)], truth.schema)
    assert score.cell_match_ratio(longer, truth).first()["matches"] == 7
    shifted = spark.createDataFrame([("0", "z", "y"), ("1", "a", None), ("2", "b", "x")], truth.schema)
    assert score.cell_match_ratio(shifted, truth).first()["matches"] == 0
    assert score.cell_match_by_key(shifted, truth, "id", ["name"]).first()["matches"] == 6
    assert score.cell_match_ratio(truth.limit(0), truth.limit(0)).first()["ratio"] == 0.0


def test_table_diff_pairs_rows_of_a_repeated_key_once(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "x")], "id int, v string")
    b = spark.createDataFrame([(1, "a"), (1, "c"), (2, "x"), (2, None)], "id int, v string")
    found = sorted(tuple(r) for r in repair.table_diff(a, b, "id").collect())
    # Nulls come first, so the null of key 2 meets x and the x after it is alone.
    assert found == [(1, "v", "changed", "b", "c"), (1, "v", "removed", "b", None), (2, "v", "added", None, "x"), (2, "v", "changed", "x", None)]


def test_allowed_values_from_a_table(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c"), (5, "a")], "k int, v string")
    rules = {"columns": {"v": {"allowed_values": spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "w string")}}}
    valid, errors = validate.validate(df, rules, "k")
    assert valid.columns == df.columns and sorted(r["k"] for r in valid.collect()) == [1, 3, 4, 5]
    assert [(r["k"], r["rule"], r["value"]) for r in errors.collect()] == [(2, "allowed_values", "b")]
    held = validate.quarantine(df, rules, "k")
    assert held.columns == ["k", "v", "errors"] and [(r["k"], len(r["errors"])) for r in held.collect()] == [(2, 1)]


def grade(spark, expression, **counters):
    names = {f"{side}_{i}": 0 for side in ("original", "fixed") for i in ISSUES} | counters
    row = spark.createDataFrame([tuple(names.values())], ", ".join(f"{n} long" for n in names))
    return row.selectExpr(f"{expression} AS g").first()["g"]


def test_grades(spark):
    all_done = {"fixed_missing_values": 9, "original_missing_values": 9, "fixed_duplicates": 3, "original_duplicates": 3}
    assert grade(spark, score.grade_easy("0", "20"), **all_done) == 1.0
    assert grade(spark, score.grade_easy("20", "20"), original_missing_values=9, original_duplicates=3) == 0.0
    third = {"fixed_missing_values": 3, "original_missing_values": 9, "fixed_duplicates": 1, "original_duplicates": 3}
    # A third of each part; unused steps add up to a tenth.
    assert grade(spark, score.grade_easy("20", "20"), **third) == pytest.approx(1 / 3)
    assert grade(spark, score.grade_easy("5", "20"), **third) == pytest.approx(1 / 3 + 0.075)
    assert grade(spark, score.grade_medium(), **third) == pytest.approx(grade(spark, score.grade_medium(), **all_done) / 3)
    careful, rash = (grade(spark, score.grade_hard("0.25D", "10", "40", n), **third) for n in ("0", "1"))
    assert careful - rash == pytest.approx(0.05)
    assert grade(spark, score.grade_hard("0D", "40", "40", "30")) == 0.0


def test_rewards_and_run_summary(spark):
    log = [
        ("r", 1, "fix_missing", True, True, 5, 4, 0.2), ("r", 2, "fix_type", True, False, 5, 5, 0.2), ("r", 3, "no_op", True, False, 3, 3, 0.3),
        ("r", 4, "fix_missing", False, False, 4, 4, 0.3), ("r", 5, "fix_outlier", True, True, 8, 2, 0.5), ("r", 6, "no_op", True, True, 1, 1, 0.5),
        ("r", 7, "fix_format", True, True, 1, 0, 0.9), ("s", 1, "no_op", False, False, 2, 2, 0.1),
    ]
    df = spark.createDataFrame(log, "run_id string, step long, action_type string, valid boolean, correct boolean, issues_before long, issues_after long, score double")
    scored = score.score_actions(df)
    rewards = [r["reward"] for r in scored.orderBy("run_id", "step").collect()]
    assert rewards == [0.14, -0.09, -0.06, -0.21, 0.34, 0.04, 0.47, -0.18]
    found = {r["run_id"]: r for r in score.run_summary(scored).collect()}
    assert (found["r"]["steps"], found["r"]["final_score"], found["r"]["completed"]) == (7, 0.9, True)
    assert found["r"]["total_reward"] == pytest.approx(sum(rewards[:7])) and found["s"]["completed"] is False
