"""How often tables are read, and results that must not depend on how rows are dealt out."""

from __future__ import annotations

import datetime as dt
import json
import random
from collections import defaultdict

import pytest

from lustra.operators import repair, score, validate
from lustra.plans.clean import clean
from lustra.sources import readers, writers
from lustra.streaming import ordered

CELLS = ["id", "name", "age", "email", "phone", "salary", "hire_date", "department", "is_active"]
PEOPLE = "k long, copy_no int, " + ", ".join(f"{c} string" for c in CELLS)
ACTIONS = "k long, copy_no int, seq long, action_type string, column_name string, new_value string, reason string"


@pytest.fixture
def counted(spark):
    """A table that counts its rows each time it is read, and what tells how often that was."""

    def make(rows, kind):
        seen, n = spark.sparkContext.accumulator(0), len(rows)

        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        df = spark.createDataFrame(rows, kind)
        return df.mapInArrow(count, df.schema), lambda: seen.value / n

    return make


def people(n):
    return [(i, 0, str(1000 + i), "Ada Kim", "" if i % 3 == 0 else "30", "a@b.cc", "5551234567", "70000", "2021/03/15", "hr", "yes") for i in range(n)]


def test_repairs_and_audit_read_the_table_once(spark, counted):
    df, scans = counted(people(60), PEOPLE)
    todo = spark.createDataFrame([(i, 0, 1, "fix_missing", "age", "40", "") for i in range(0, 60, 2)] + [(5, 0, 2, "remove_duplicate", "id", None, ""), (None, None, 3, "fix_format", "phone", None, "")], ACTIONS)
    done = repair.run_repairs(df, todo, ["k", "copy_no"])
    assert done.table().count() == 60 and done.audit().count() == 32
    assert scans() == 1


def test_removal_counts_keys_of_the_table_before(spark):
    """A key that an action changes still groups its rows; null keys are one key."""
    rows = [(1, 0, "7"), (2, 0, "7"), (3, 0, "8"), (4, 0, None), (5, 0, None), (6, 0, None)]
    df = spark.createDataFrame([(k, c, i, *["x"] * 8) for k, c, i in rows], PEOPLE)
    todo = spark.createDataFrame([(1, 0, 1, "remove_duplicate", "id", None, ""), (2, 0, 2, "fix_type", "id", "9", ""), (3, 0, 3, "remove_duplicate", "id", None, ""),
                                  (4, 0, 4, "remove_duplicate", "id", None, ""), (5, 0, 5, "remove_duplicate", "id", None, ""), (6, 0, 6, "remove_duplicate", "id", None, "")], ACTIONS)
    assert sorted(r["k"] for r in repair.apply_repairs(df, todo, ["k", "copy_no"]).collect()) == [2, 3, 6]


def test_validation_reads_the_table_once(spark, counted):
    df, scans = counted([(i, i % 7, None if i % 5 == 0 else "x") for i in range(70)], "i long, errors long, s string")
    allowed = spark.createDataFrame([(v,) for v in range(5)], "v long")
    found = validate.validated(df, {"columns": {"errors": {"allowed_values": allowed}, "s": {"required": True}, "t": {"required": True}}}, "i")
    valid, held, errors = found.valid().collect(), found.quarantine().collect(), found.errors().collect()
    assert scans() == 1 and found.valid().columns == ["i", "errors", "s"]
    bad = {i for i in range(70) if i % 7 > 4 or i % 5 == 0}
    assert {r["i"] for r in valid} == set(range(70)) - bad and {r["i"] for r in held} == bad
    assert {(r["i"], r["column"]) for r in errors} == {(i, "errors") for i in range(70) if i % 7 > 4} | {(i, "s") for i in range(0, 70, 5)} | {(None, "t")}


@pytest.mark.parametrize("remove, scans_wanted", [(True, 2), (False, 1)])
def test_cleaning_reads_the_table(spark, counted, remove, scans_wanted):
    """Once to count nulls, once to take duplicates out; without the latter, once in all."""
    rows = [(i % 90, None if i % 7 == 0 else float(i % 13), None if i % 5 == 0 else f"t{i % 3}") for i in range(100)]
    df, scans = counted(rows, "k long, x double, s string")
    rules = {"duplicates": {"remove": remove}, "fill_missing": {"x": "median", "s": "drop"}, "outliers": {"strategy": "remove_iqr", "iqr_factor": 0.2, "skip_columns": ["k"]}}
    cleaned, audit = clean(df, rules)
    assert cleaned.count() == cleaned.count() > 0 and audit.count() >= 4
    assert scans() == scans_wanted


def test_cleaning_drops_rows_column_by_column(spark):
    """Nulls and lost rows are those left when a column's turn comes."""
    rows = [(None if i % 2 else i, None if i % 3 else i, None if i % 4 else i, i) for i in range(120)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    for remove in (True, False):
        _, audit = clean(df, {"duplicates": {"remove": remove}, "fill_missing": {"a": "drop", "b": 0, "c": "drop"}, "outliers": {"strategy": "none"}, "drop_columns_missing_above": 1.0})
        found = {r["column"]: (r["step"], r["rows_affected"]) for r in audit.collect()}
        assert found["a"] == ("drop_rows", 60) and found["b"] == ("fill_missing", 40) and found["c"] == ("drop_rows", 30)
    empty, audit = clean(df.limit(0), {"fill_missing": {"a": "drop"}})
    assert empty.count() == 0 and "0 of 0 rows left" in audit.filter("step = 'summary'").first()["detail"]
    # A column that is too sparse is gone before its turn.
    _, audit = clean(df, {"duplicates": {"remove": False}, "fill_missing": {"c": "drop", "b": 0}, "outliers": {"strategy": "none"}, "drop_columns_missing_above": 0.7})
    found = {r["column"]: (r["step"], r["rows_affected"]) for r in audit.collect()}
    assert "c" not in found and found["b"] == ("fill_missing", 80)


def plain_diff(before, after):
    """Rows of a key side by side in order of their cells, nulls first."""
    sides = defaultdict(lambda: ([], []))
    for side, rows in enumerate((before, after)):
        for key, *cells in rows:
            sides[key][side].append(tuple(None if c is None else str(c) for c in cells))
    out = []
    order = lambda cells: tuple((c is not None, c) for c in cells)
    for key, (old, new) in sides.items():
        old, new = sorted(old, key=order), sorted(new, key=order)
        for i in range(max(len(old), len(new))):
            a, b = old[i] if i < len(old) else None, new[i] if i < len(new) else None
            change = "added" if a is None else "removed" if b is None else "changed"
            for c, name in enumerate(("v", "w")):
                x, y = a and a[c], b and b[c]
                if x != y:
                    out.append((key, name, change, x, y))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [0, 1_000_000])
def test_table_diff_by_either_way(spark, hot):
    rng = random.Random(11)
    make = lambda n: [(rng.choice([None, 1, 2, 3, *range(10, 40)]), rng.choice([None, "a", "b"]), rng.choice([None, 1, 2])) for _ in range(n)]
    before, after = make(300) + [(99, "x", 1)] * 2500, make(280) + [(99, "x", 1)] * 1200 + [(98, "only", None)]
    kind = "id int, v string, w int"
    found = repair.table_diff(spark.createDataFrame(before, kind), spark.createDataFrame(after, kind), "id", hot=hot)
    assert sorted(map(tuple, found.collect()), key=str) == plain_diff(before, after)


def test_table_diff_shuffles_differing_keys_only(spark):
    same = spark.range(500).selectExpr("id", "concat('v', id) AS v")
    assert repair.table_diff(same, same.repartition(7), "id").collect() == []
    assert repair.table_diff(same.limit(0), same.limit(0), "id").collect() == []
    other = same.withColumn("v", validate.F.expr("IF(id = 17, 'new', v)"))
    assert [tuple(r) for r in repair.table_diff(same, other, "id").collect()] == [(17, "v", "changed", "v17", "new")]


def plain_match(left, right, width):
    order = lambda r: tuple("None" if c is None else c for c in r[:2]) + tuple((c is not None, c) for c in r)
    left, right = sorted(left, key=order), sorted(right, key=order)
    n = max(len(left), len(right))
    absent = (None,) * width
    pairs = [(left[i] if i < len(left) else absent, right[i] if i < len(right) else absent) for i in range(n)]
    return sum(a == b for x, y in pairs for a, b in zip(x, y)), max(n * width, 1)


@pytest.mark.parametrize("stride", [3, 64, 1 << 16])
def test_positional_match_by_ranges(spark, monkeypatch, stride):
    """Rows that fill many positions, tables of different lengths, nulls, strides shorter than a range."""
    monkeypatch.setattr(score, "STRIDE", stride)
    rng = random.Random(stride)
    cell = lambda: rng.choice([None, "a", "b", "c"])
    left = [(rng.choice("1234"), cell(), cell()) for _ in range(60)] + [("2", "hot", None)] * 700
    right = [(rng.choice("1234"), cell(), cell()) for _ in range(70)] + [("2", "hot", None)] * 500 + [("3", "hot", "x")] * 90
    kind = "id string, name string, v string"
    for a, b in ((left, right), (right, left), (left, left), (left[:0], right), (left[:5], left[:9])):
        found = score.cell_match_ratio(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)).first()
        assert (found["matches"], found["cells"]) == plain_match(a, b, 3)


def test_a_repeated_row_is_one_row_to_match(spark):
    """A row in nine tenths of the table: what is sorted and compared is as small as the distinct rows and strides."""
    df = spark.range(200_000).selectExpr("IF(id < 180000, 'hot', CAST(id AS STRING)) AS id", "'n' AS name")
    found = score.cell_match_ratio(df, df.repartition(5)).first()
    assert (found["matches"], found["ratio"]) == (400_000, 1.0)
    placed = score.sums_before(df.groupBy("id", "name").count(), ["id"], {"before": "count"})
    assert placed.count() == 20_001 and placed.filter("id = 'hot'").first()["before"] == 20_000


def test_sums_before(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(20), i, rng.randrange(5)) for i in range(400)]
    found = score.sums_before(spark.createDataFrame(rows, "g int, i int, n int").repartition(6), ["g", "i"], {"s": "n", "c": "1"}).collect()
    at, total = {}, 0
    for k, (g, i, n) in enumerate(sorted(rows)):
        at[i] = (total, k)
        total += n
    assert {r["i"]: (r["s"], r["c"]) for r in found} == at


def test_run_summary_of_levels(spark):
    rows = [("r1", 1, "easy", 0.5, 0.1, False), ("r1", 2, "easy", 0.25, 0.4, True), ("r2", 1, "easy", -0.25, 0.2, False), ("r3", 1, "hard", 1.0, 0.9, True), (None, 1, None, 0.0, 0.0, False)]
    df = spark.createDataFrame(rows, "run_id string, step int, level string, reward double, score double, completed boolean")
    found = {(r["grouped"], r["run_id"], r["level"]): r for r in score.run_summary(df, level="level").collect()}
    assert len(found) == 4 + 3 + 1
    easy, every = found["level", None, "easy"], found["all", None, None]
    assert (easy["runs"], easy["steps"], easy["mean_reward"], easy["final_score"], easy["completed_share"]) == (2, 3, 0.1667, 0.3, 0.5)
    assert (every["runs"], every["steps"], every["total_reward"]) == (4, 5, 1.5) and found["run", "r1", "easy"]["final_score"] == 0.4
    assert found["run", None, None]["runs"] == found["level", None, None]["runs"] == 1


# ------------------------------------------------------------------ files


def test_malformed_records_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text(' id ,name,n\n1,"x, y",3\n2,short\n3,z,4,more\n4,NA,5\n')
    found = readers.read_checked(spark, str(tmp_path / "a.csv"))
    assert sorted(map(tuple, found.rows.collect())) == [(1, "x, y", 3), (4, None, 5)] and dict(found.rows.dtypes)["n"] == "bigint"
    bad = found.malformed.orderBy("record").collect()
    assert [r["record"] for r in bad] == ["2,short", "3,z,4,more"] and all(r["file"].endswith("a.csv") and r["block_start"] == 0 for r in bad)
    (tmp_path / "b.tsv").write_text("id\tn\n1\tx\n2\t3\n")
    typed = readers.read_checked(spark, str(tmp_path / "b.tsv"), "tsv", "id int, n int")
    assert [tuple(r) for r in typed.rows.collect()] == [(2, 3)] and typed.malformed.first()["record"] == "1\tx"
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n{"a": \n{"a": 2}\n')
    lines = readers.read_checked(spark, str(tmp_path / "c.jsonl"), "jsonl")
    assert sorted(r["a"] for r in lines.rows.collect()) == [1, 2] and lines.malformed.count() == 1
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "good.json").write_text(json.dumps([{"a": 1}, {"a": 2}], indent=2))
    (folder / "bad.json").write_text('[{"a": 3},\n {"a"')
    docs = readers.read_checked(spark, str(folder), "json", "a int")
    assert docs.rows.filter("a IN (1, 2)").count() == 2 and docs.malformed.first()["file"].endswith("bad.json")
    with pytest.raises(ValueError):
        readers.read_checked(spark, str(folder), "parquet")


def test_reports_of_a_retried_job_replace_themselves(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "column string, n int")
    for kind, path in (("json", str(tmp_path / "j")), ("parquet", str(tmp_path / "p"))):
        for job in ("one", "two", "two"):
            writers.write_report(df, path, job, kind)
        writers.write_report(df, path, "one", kind, mode="append")
        assert {r["job_id"]: r["count"] for r in spark.read.format(kind).load(path).groupBy("job_id").count().collect()} == {"one": 4, "two": 2}


def test_json_and_parquet_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], None), (2, None, "x")], "id long, l array<long>, s string")
    writers.write_json(df, str(tmp_path / "a.jsonl"))
    writers.write_parquet(df, str(tmp_path / "a.parquet"))
    for name in ("a.jsonl", "a.parquet"):
        assert sorted(map(tuple, readers.read_any(spark, str(tmp_path / name)).select("id", "l", "s").collect())) == sorted(map(tuple, df.collect()))


# ------------------------------------------------------------------ streams

EVENTS = "id long, ts timestamp, k string"


def plain_stream(files, delay):
    """Kinds of all rows: the watermark of a file is the latest time of the files before it, less the delay."""
    known, mark, latest, out = {}, None, None, {}
    for rows in files:
        seen = set()
        for i, ts, k in sorted(rows, key=lambda r: (r[1], r[0])):
            if mark is not None and ts < mark:
                out[i] = "late"
                continue
            out[i] = "repeat" if k in seen or k in known else "new"
            seen.add(k)
        for i, ts, k in rows:
            latest = ts if latest is None or ts > latest else latest
            if out[i] != "late":
                known[k] = max(known.get(k, ts), ts)
        mark = latest - delay
        known = {k: t for k, t in known.items() if t + delay >= mark}
    return out


def test_ordered_stream_expires_keys_and_keeps_late_rows(spark, tmp_path):
    rng = random.Random(4)
    start, delay = dt.datetime(2024, 1, 1), dt.timedelta(hours=6)
    files = []
    for f in range(6):
        rows = [(100 * f + i, start + dt.timedelta(hours=8 * f, minutes=rng.randrange(480)) - dt.timedelta(hours=rng.choice([0] * 8 + [20])), rng.choice(["a", "b", None, *"cdefghijklmnop"])) for i in range(25)]
        files.append(rows)
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        ordered.dedup_stream(spark, landing, EVENTS, ["k"], "ts", "6 hours", out, state, ["id"]).awaitTermination()

    def kinds():
        return {r["id"]: kind for kind in ordered.KINDS for r in ordered.read_kind(spark, out, kind, EVENTS, "ts").collect()}

    (tmp_path / "in").mkdir()
    run()
    assert kinds() == {}
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(landing)
        if n in (2, 5):
            run()
    want = plain_stream(files, delay)
    assert kinds() == want and set(want.values()) == set(ordered.KINDS)
    # The last batch is done again when its commit is lost: the same files, not more.
    commits = sorted((p for p in (tmp_path / "state" / "stream" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run()
    assert kinds() == want
    assert len([p for p in (tmp_path / "state" / "keys").iterdir() if p.name.startswith("batch=")]) <= 2
    with pytest.raises(ValueError):
        ordered.read_kind(spark, out, "other", EVENTS, "ts")
