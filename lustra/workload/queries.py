"""One query per operator: ``name -> f(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lustra.functions import people as cells
from lustra.functions import text
from lustra.operators import casting, dedup, issues, missing, outliers, profile, repair, score, sketches, stats, textual, validate
from lustra.plans import advice
from lustra.plans import clean as runs
from lustra.plans.clean import clean
from lustra.session import new_shared_path, stage
from lustra.sources import people as generated
from lustra.sources import readers, writers
from lustra.streaming import clean_stream as streaming
from lustra.streaming import ordered
from lustra.workload.tables import DATA, ROW_ID, people, people_truth, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ROW = list(ROW_ID)
CELLS = list(DATA)
ACTION_DDL = "k long, copy_no int, seq long, action_type string, column_name string, new_value string, reason string"

ORDER_RULES = {
    "columns": {
        "o_totalprice": {"type": "numeric", "required": True, "min": 5000, "max": 300000},
        "o_orderstatus": {"allowed_values": ["O", "F"]},
        "o_orderpriority": {"required": True, "pattern": "[1-4]-"},
        "o_comment": {"required": True},
    }
}
PEOPLE_RULES = {
    "columns": {
        "id": {"type": "numeric", "required": True},
        "age": {"type": "numeric", "required": True, "min": 0, "max": 120},
        "email": {"required": True, "pattern": r"[^@\s]+@[^@\s]+\.[a-z]+$"},
        "salary": {"type": "numeric", "min": 0},
        "department": {"allowed_values": ["Engineering", "Finance", "Sales", "HR", "Operations"]},
    }
}
EVENT_RULES = {
    "fill": {"value": 0.0},
    "clip": {"value": (0.0, 60.0)},
    "normalize_text": ["event_type"],
    "schema": {"columns": {"event_type": {"allowed_values": ["click", "view", "purchase"]}, "user_id": {"min": 2}}},
}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in names})


def _people(spark: SparkSession, sf: str) -> DataFrame:
    """People with missing-value texts as nulls."""
    return readers.null_tokens(people(spark, sf))


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    """People with age and salary as numbers."""
    return casting.cast_types(people(spark, sf), {"age": "numeric", "salary": "numeric"})


# ---------------------------------------------------------------- profiles


@query
def profile_shape(spark: SparkSession, sf: str) -> DataFrame:
    df = _people(spark, sf).select(*CELLS)
    return profile.shape(df).crossJoin(F.broadcast(profile.count_duplicate_rows(df)))


@query
def profile_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return profile.column_nulls(_people(spark, sf).select(*CELLS))


@query
def profile_numeric(spark: SparkSession, sf: str) -> DataFrame:
    lines = profile.column_numbers(
        table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    )
    events = profile.column_numbers(table(spark, sf, "events"), ["value"])
    orders = profile.column_numbers(table(spark, sf, "orders"), ["o_totalprice"])
    found = lines.unionByName(events).unionByName(orders)
    return rounded(found, "mean", "std", "min", "max", "median", "q1", "q3")


@query
def profile_unique(spark: SparkSession, sf: str) -> DataFrame:
    return profile.column_uniques(table(spark, sf, "customer")).unionByName(
        profile.column_uniques(table(spark, sf, "part"))
    )


@query
def profile_histogram(spark: SparkSession, sf: str) -> DataFrame:
    events = profile.histograms(table(spark, sf, "events"), ["value"])
    lines = profile.histograms(table(spark, sf, "lineitem"), ["l_extendedprice"])
    return events.unionByName(lines)


@query
def profile_top_values(spark: SparkSession, sf: str) -> DataFrame:
    part = profile.top_values(table(spark, sf, "part"), ["p_brand", "p_type"])
    return profile.top_values(_people(spark, sf), ["name", "department", "hire_date"]).unionByName(part)


@query
def profile_sample(spark: SparkSession, sf: str) -> DataFrame:
    return profile.sample_values(table(spark, sf, "part"), ["p_partkey"], ["p_partkey", "p_name", "p_brand", "p_size"])


def _profiled(df: DataFrame) -> DataFrame:
    return profile.profile(df.select(*ROW, *CELLS), ROW)


@query
def profile_full(spark: SparkSession, sf: str) -> DataFrame:
    df = casting.cast_types(_people(spark, sf), {"age": "numeric", "salary": "numeric"})
    found = _profiled(df).filter(~F.col("column").isin(*ROW))
    tops = F.transform("top_values", lambda t: F.concat_ws(":", t["value"], t["n"].cast("string")))
    counts = F.transform("distribution.counts", lambda n: n.cast("string"))
    out = found.withColumns(
        {
            "sample_values": F.array_join("sample_values", "|"),
            "top_values": F.array_join(tops, "|"),
            "distribution": F.array_join(counts, "|"),
        }
    )
    return rounded(out, "mean", "std", "min", "max", "median", "q1", "q3")


@query
def profile_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Lines about the table, then one per column."""
    part = table(spark, sf, "part")
    found = rounded(profile.profile(part), "mean", "std", "min", "max", places=2)
    return profile.profile_summary(found, profile.dataset(part)).select("column", "summary")


@query
def profile_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct and frequent values of whole texts, told by digests."""
    docs = table(spark, sf, "documents").select("text", "lang", "source")
    tops = profile.top_values(docs).withColumn("value", F.md5("value"))
    return tops.join(F.broadcast(profile.column_uniques(docs)), "column")


@query
def profile_sample_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(*SAMPLED, F.expr("IF(l_orderkey % 400 = 0, l_returnflag, NULL) AS rare"))
    return profile.sample_values(lines, SAMPLED, [*SAMPLED, "rare"])


SAMPLED = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query
def profile_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Line items profiled flag by flag, the stored sketches summed up; estimates are held against exact values."""
    columns = ["l_returnflag", "l_extendedprice", "l_quantity", "l_linestatus"]
    lines = table(spark, sf, "lineitem").select(*columns)
    parts = stage(sketches.sketch(lines, ["l_returnflag"]), "sketches")
    merged = stage(sketches.merge(parts), "merged")
    found = {r["column"]: r for r in sketches.profile_of(merged).collect()}
    uniques = {r["column"]: r["unique_count"] for r in profile.column_uniques(lines).collect()}
    rows = []
    for c in columns[1:]:
        r, close = found[c], abs(found[c]["unique_count"] - uniques[c]) <= 0.05 * uniques[c]
        if r["median"] is not None:
            below = [F.expr(f"count_if({c} < {r[q]!r}D) / count(1)") for q in ("q1", "median", "q3")]
            upto = [F.expr(f"count_if({c} <= {r[q]!r}D) / count(1)") for q in ("q1", "median", "q3")]
            shares = lines.agg(*below, *upto).first()
            close = close and all(shares[i] - sketches.RANK_ERROR <= p <= shares[i + 3] + sketches.RANK_ERROR for i, p in enumerate((0.25, 0.5, 0.75)))
        rows.append((c, r["rows"], r["null_count"], r["mean"], r["std"], r["min"], r["max"], close))
    kind = "column string, rows long, null_count long, mean double, std double, min double, max double, estimates_close boolean"
    return rounded(spark.createDataFrame(rows, kind), "mean", "std", "min", "max")


@query
def profile_merged_dataset(spark: SparkSession, sf: str) -> DataFrame:
    parts = sketches.sketch(_people(spark, sf).select(*ROW, *CELLS).withColumn("part", F.expr("k % 5")), ["part"])
    found = sketches.dataset_of(sketches.merge(stage(parts, "sketches")))
    return found.select("rows", "columns", "total_missing", "missing_pct")


@query
def profile_diff(spark: SparkSession, sf: str) -> DataFrame:
    before = _typed(spark, sf).select("age", "salary", "department")
    after = missing.fill_median(textual.canonical_value(before, "department"), ["age", "salary"]).drop("salary")
    found = profile.profile_diff(profile.profile(before), profile.profile(after))
    return rounded(found, *[f"{f}_{s}" for f in ("mean", "std", "min", "max") for s in ("before", "after", "change")])


@query
def suggest_rules(spark: SparkSession, sf: str) -> DataFrame:
    df = casting.cast_types(_people(spark, sf), {"salary": "numeric"})
    empty = F.when(F.col("k") % 20 == 0, F.col("name"))
    return advice.suggest_rules(profile.profile(df.select(*CELLS, empty.alias("nickname"))))


# ---------------------------------------------------------------- missing values


@query
def null_tokens(spark: SparkSession, sf: str) -> DataFrame:
    padded = people(spark, sf).withColumnRenamed("age", " age ")
    return readers.null_tokens(readers.normalize_columns(padded))


@query
def fill_mean(spark: SparkSession, sf: str) -> DataFrame:
    df = missing.fill_mean(_typed(spark, sf).select(*ROW, "age", "salary", "name"), ["age", "salary", "name"])
    return rounded(df, "age", "salary")


@query
def fill_median(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(missing.fill_median(_typed(spark, sf).select(*ROW, "age", "salary"), ["age", "salary"]), "age", "salary")


@query
def fill_median_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    holes = F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice"))
    df = lines.select("l_orderkey", "l_linenumber", "l_partkey", holes.alias("price"))
    return rounded(missing.fill_median(df, "price"), "price")


@query
def fill_mode(spark: SparkSession, sf: str) -> DataFrame:
    df = _people(spark, sf).select(*ROW, "age", "email", "phone", "salary")
    return missing.fill_mode(df, ["age", "email", "phone", "salary"])


@query
def fill_constant(spark: SparkSession, sf: str) -> DataFrame:
    df = _people(spark, sf).select(*ROW, "email", (F.col("k") % 3 == 0).alias("flag"), "salary")
    flagged = df.withColumn("flag", F.when(F.col("salary").isNotNull(), F.col("flag")))
    return missing.fill_constant(missing.fill_constant(flagged, ["email", "flag"]), "salary", 0)


@query
def drop_missing_rows(spark: SparkSession, sf: str) -> DataFrame:
    return missing.drop_missing_rows(_people(spark, sf), "age")


@query
def drop_missing_rows_threshold(spark: SparkSession, sf: str) -> DataFrame:
    df = _people(spark, sf).select(*ROW, "age", "email", "phone", "salary")
    return missing.drop_missing_rows(df, threshold=0.15)


@query
def drop_missing_cols(spark: SparkSession, sf: str) -> DataFrame:
    empty = F.when(F.col("k") % 10 == 0, F.col("name"))
    return missing.drop_missing_cols(_people(spark, sf).withColumn("nickname", empty), 0.5)


# ---------------------------------------------------------------- duplicates


@query
def dedup_exact(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.remove_duplicates(people(spark, sf).select(*CELLS))


@query
def dedup_keep_none(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.remove_duplicates(people(spark, sf).select(*CELLS), keep=False)


LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]


@query
def dedup_subset_first(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.remove_duplicates(table(spark, sf, "lineitem"), LINE_KEY, "first", LINE_ORDER)


@query
def dedup_subset_last(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.remove_duplicates(table(spark, sf, "lineitem"), LINE_KEY, "last", LINE_ORDER)


@query
def dedup_subset_none(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.remove_duplicates(table(spark, sf, "lineitem"), LINE_KEY, False)


@query
def dedup_documents(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.remove_duplicates(table(spark, sf, "documents"), ["text"], "first", ["doc_id"])


@query
def dup_counts(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.duplicate_counts(people(spark, sf))


@query
def dup_flags(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.flag_duplicates(people(spark, sf), ROW).select(*ROW, "is_duplicate", "is_near_duplicate")


@query
def dup_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.later_copies(people(spark, sf), ROW)


@query
def dup_documents(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.later_copies(table(spark, sf, "documents"), "doc_id", ["text"])


# ---------------------------------------------------------------- type repair


@query
def cast_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return casting.cast_numeric(people(spark, sf).select(*ROW, "age", "name"), "age")


@query
def cast_datetime(spark: SparkSession, sf: str) -> DataFrame:
    df = people(spark, sf).select(*ROW, F.col("hire_date").alias("iso"), F.col("hire_date").alias("listed"))
    both = casting.cast_datetime(casting.cast_datetime(df, "iso"), "listed", text.DATE_FORMATS)
    return both.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("iso", "listed")})


@query
def cast_boolean(spark: SparkSession, sf: str) -> DataFrame:
    return casting.cast_boolean(people(spark, sf).select(*ROW, "is_active"), "is_active")


@query
def cast_types(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"id": "int", "age": "numeric", "salary": "float", "is_active": "boolean", "absent": "numeric"}
    return casting.cast_types(people(spark, sf), kinds)


@query
def cast_schema(spark: SparkSession, sf: str) -> DataFrame:
    return casting.cast_to_schema(people(spark, sf))


# ---------------------------------------------------------------- text


def _padded(spark: SparkSession, sf: str) -> DataFrame:
    messy = F.concat(F.lit("  "), F.col("name"), F.lit("\t  "), F.col("department"), F.lit(" \n"))
    return people(spark, sf).select(*ROW, messy.alias("label"))


@query
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return textual.normalize_text(_padded(spark, sf), "label")


@query
def normalize_documents(spark: SparkSession, sf: str) -> DataFrame:
    return textual.normalize_text(table(spark, sf, "documents").select("doc_id", "text", "source"), ["text", "source"])


@query
def strip_whitespace(spark: SparkSession, sf: str) -> DataFrame:
    return textual.strip_whitespace(_padded(spark, sf), "label")


@query
def fix_email(spark: SparkSession, sf: str) -> DataFrame:
    return textual.fix_email(people(spark, sf).select(*ROW, "email"), "email")


@query
def normalize_email(spark: SparkSession, sf: str) -> DataFrame:
    shouted = F.concat(F.lit(" "), F.upper("email"), F.lit(" "))
    return textual.normalize_email(people(spark, sf).select(*ROW, shouted.alias("email")), "email")


@query
def derive_email(spark: SparkSession, sf: str) -> DataFrame:
    return textual.derive_email(people(spark, sf).select(*ROW, "name", "email"), "name", "email")


@query
def title_case(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.concat("name", F.lit(" o'NEIL mary-"), F.lower("department"), F.lit("3rd"))
    return textual.title_case(people(spark, sf).select(*ROW, odd.alias("name")), "name")


@query
def canonical_department(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.when(F.col("k") % 4 == 0, F.concat(F.lit(" "), F.lower("department"), F.lit("  "))).when(
        F.col("k") % 4 == 1, F.lit("data science")
    )
    df = people(spark, sf).select(*ROW, F.coalesce(odd, F.col("department")).alias("department"))
    return textual.canonical_value(df, "department")


@query
def canonical_from_table(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select(F.upper("n_name").alias("alias"), F.col("n_name").alias("label"))
    keys = table(spark, sf, "nation").select("n_nationkey", F.lower("n_name").alias("place"))
    suppliers = table(spark, sf, "supplier").join(keys, F.col("s_nationkey") == F.col("n_nationkey"))
    return textual.canonical_from_table(suppliers.select("s_suppkey", "place"), "place", nations)


@query
def format_date(spark: SparkSession, sf: str) -> DataFrame:
    broken = F.when(F.col("k") % 6 == 0, F.lit("2021-02-30")).otherwise(F.col("hire_date"))
    return textual.format_date(people(spark, sf).select(*ROW, broken.alias("hire_date")), "hire_date")


@query
def format_phone(spark: SparkSession, sf: str) -> DataFrame:
    short = F.expr("IF(k % 6 = 0, substring(phone, 1, 9), phone)")
    return textual.format_phone(people(spark, sf).select(*ROW, short.alias("phone")), "phone")


@query
def normalized_row(spark: SparkSession, sf: str) -> DataFrame:
    return textual.normalized_row(people(spark, sf))


# ---------------------------------------------------------------- outliers


@query
def cap_iqr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(outliers.cap_iqr(table(spark, sf, "events").select("event_id", "value"), "value"), "value")


@query
def remove_iqr(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.remove_iqr(table(spark, sf, "events").select("event_id", "user_id", "value"), "value")


@query
def cap_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(outliers.cap_zscore(table(spark, sf, "events").select("event_id", "value"), "value"), "value")


@query
def range_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.flag_range(people(spark, sf).select(*ROW, "age", "salary"), cells.PEOPLE)


@query
def drop_low_variance(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.drop_low_variance(outliers.drop_column(table(spark, sf, "lineitem"), "l_shipdate"), 0.05)


# ---------------------------------------------------------------- validation


@query
def validate_valid(spark: SparkSession, sf: str) -> DataFrame:
    return validate.valid_rows(table(spark, sf, "orders"), ORDER_RULES)


@query
def validate_errors(spark: SparkSession, sf: str) -> DataFrame:
    return validate.validation_errors(table(spark, sf, "orders"), ORDER_RULES, "o_orderkey")


@query
def validate_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    found = validate.quarantine(table(spark, sf, "orders"), ORDER_RULES, "o_orderkey")
    broken = F.array_join(F.transform("errors", lambda e: F.concat_ws("/", e["column"], e["rule"])), ",")
    return found.withColumn("errors", broken)


@query
def validate_once(spark: SparkSession, sf: str) -> DataFrame:
    """Valid rows, errors and quarantine of orders, all from one scan."""
    found = validate.validated(table(spark, sf, "orders"), ORDER_RULES, "o_orderkey")
    valid = found.valid().selectExpr("o_orderkey", "o_totalprice", "'valid' AS part", "NULL AS rule")
    held = found.quarantine().selectExpr("o_orderkey", "o_totalprice", "'quarantine' AS part", "array_join(errors.rule, ',') AS rule")
    return valid.unionAll(held).unionAll(found.errors().selectExpr("o_orderkey", "NULL AS o_totalprice", "'errors' AS part", "rule"))


@query
def validate_people_valid(spark: SparkSession, sf: str) -> DataFrame:
    return validate.valid_rows(_people(spark, sf), PEOPLE_RULES)


@query
def validate_people_errors(spark: SparkSession, sf: str) -> DataFrame:
    return validate.validation_errors(_people(spark, sf), PEOPLE_RULES, ROW)


# ---------------------------------------------------------------- issues


@query
def issue_counts(spark: SparkSession, sf: str) -> DataFrame:
    return issues.detect_issues(people(spark, sf))


@query
def total_issues(spark: SparkSession, sf: str) -> DataFrame:
    return issues.total_issues(issues.detect_issues(people(spark, sf)))


@query
def cell_issues(spark: SparkSession, sf: str) -> DataFrame:
    return issues.cell_issues(people(spark, sf), ROW)


@query
def validate_against_table(spark: SparkSession, sf: str) -> DataFrame:
    """Line items whose supplier is not among those in credit."""
    rules = {"columns": {"l_suppkey": {"allowed_values": table(spark, sf, "supplier").filter("s_acctbal > 0").select("s_suppkey")}}}
    return validate.validation_errors(table(spark, sf, "lineitem"), rules, ["l_orderkey", "l_linenumber"])


# ---------------------------------------------------------------- repairs


@query
def propose_repairs(spark: SparkSession, sf: str) -> DataFrame:
    return repair.propose_repairs(people(spark, sf), ROW)


def _proposed(spark: SparkSession, sf: str) -> DataFrame:
    """The proposed actions as a table, because applying reads them several times."""
    return stage(repair.propose_repairs(people(spark, sf), ROW), "actions")


@query
def apply_repairs(spark: SparkSession, sf: str) -> DataFrame:
    return repair.apply_repairs(people(spark, sf), _proposed(spark, sf), ROW)


# Which action clears which issue when the right value is known.
ACTION_FOR = {
    "missing_values": "fix_missing",
    "wrong_format": "fix_format",
    "inconsistent_values": "fix_format",
    "wrong_type": "fix_type",
    "invalid_email": "fix_type",
    "outliers": "fix_outlier",
}


def _truth_actions(spark: SparkSession, sf: str) -> DataFrame:
    """One action per cell issue with the value of the truth table, plus useless ones."""
    dirty = people(spark, sf)
    found = issues.cell_issues(dirty, ROW).withColumn("id", (1000 + F.col("k")).cast("string"))
    true = people_truth(spark, sf)
    long = true.select("id", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("new_value")) for c in CELLS])))
    kind = F.lit("no_op")
    for issue, action in ACTION_FOR.items():
        kind = F.when(F.col("issue") == issue, action).otherwise(kind)
    return found.join(long, ["id", "column"]).select(
        *ROW, F.col("k").alias("seq"), kind.alias("action_type"), F.col("column").alias("column_name"), "new_value",
        F.lit("known value").alias("reason"),
    )


@query
def apply_known_values(spark: SparkSession, sf: str) -> DataFrame:
    return repair.apply_repairs(people(spark, sf), stage(_truth_actions(spark, sf), "actions"), ROW)


@query
def apply_column_repairs(spark: SparkSession, sf: str) -> DataFrame:
    """Actions on whole columns, and an unknown column and action that change nothing."""
    rows = [
        (None, None, 1, "fix_format", "hire_date", None, "layout"),
        (None, None, 2, "fix_format", "phone", None, "layout"),
        (None, None, 3, "fix_missing", "age", "30", "default"),
        (None, None, 4, "fix_type", "age", None, "type"),
        (None, None, 5, "fix_outlier", "salary", "60000", "default"),
        (None, None, 6, "fix_type", "is_active", None, "type"),
        (None, None, 7, "fix_format", "nowhere", None, "no such column"),
        (None, None, 8, "polish", "name", "x", "no such action"),
    ]
    return repair.apply_repairs(people(spark, sf), spark.createDataFrame(rows, ACTION_DDL), ROW)


@query
def repair_audit(spark: SparkSession, sf: str) -> DataFrame:
    done = repair.run_repairs(people(spark, sf), _proposed(spark, sf), ROW)
    return done.audit(people_truth(spark, sf))


def _mixed_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Several actions on a cell, one that is outdone, one that destroys, whole columns and a ``no_op``."""
    asked = [
        ("age IS NULL OR age = ''", 1, "fix_missing", "age", "30", "acts"),
        ("age IS NULL OR age = ''", 2, "fix_missing", "age", "40", "too late"),
        ("age = '999'", 3, "fix_outlier", "age", "35", "acts"),
        ("copy_no = 0 AND k % 61 = 0 AND k % 19 <> 0 AND k % 23 <> 0", 4, "fix_format", "name", "Someone Else", "destroys"),
    ]
    whole = [
        ("fix_missing", "phone", "000-000-0000", "acts on some"),
        ("fix_missing", "is_active", "true", "none is missing"),
        ("no_op", None, None, "issues are left"),
    ]
    dirty = people(spark, sf)
    rows = [
        F.expr(f"IF({when}, struct({seq}L AS seq, '{kind}' AS action_type, '{c}' AS column_name, '{value}' AS new_value, '{why}' AS reason), NULL)")
        for when, seq, kind, c, value, why in asked
    ]
    single = dirty.select(*ROW, F.explode(F.array(*rows)).alias("a")).filter("a IS NOT NULL").select(*ROW, "a.*")
    columns = [(None, None, 10 + i, *a) for i, a in enumerate(whole)]
    return stage(single.unionByName(spark.createDataFrame(columns, ACTION_DDL)), "actions")


def _mixed_audit(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The table repaired by the mixed actions, and their audit."""
    done = repair.run_repairs(people(spark, sf), _mixed_actions(spark, sf), ROW)
    return done.table(), done.audit(people_truth(spark, sf))


@query
def repair_audit_known(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed_audit(spark, sf)[1]


@query
def auto_clean(spark: SparkSession, sf: str) -> DataFrame:
    return repair.auto_clean(people(spark, sf), ROW)


@query
def table_diff(spark: SparkSession, sf: str) -> DataFrame:
    dirty = people(spark, sf).drop("k", "copy_no")
    return repair.table_diff(dirty, people_truth(spark, sf), "id")


# ---------------------------------------------------------------- scores


@query
def cell_match(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(score.cell_match_ratio(people(spark, sf), people_truth(spark, sf), CELLS, row_id=ROW), "ratio", places=8)


@query
def cell_match_keyed(spark: SparkSession, sf: str) -> DataFrame:
    found = score.cell_match_by_key(people(spark, sf), people_truth(spark, sf), "id", ROW, CELLS)
    return rounded(found, "ratio", places=8)


@query
def match_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(score.dataset_match_score(people(spark, sf), people_truth(spark, sf), row_id=ROW), "ratio", places=8)


def _repaired(spark: SparkSession, sf: str) -> DataFrame:
    """The repaired table, staged because it is counted and scored."""
    return stage(apply_repairs(spark, sf), "repaired")


@query
def issues_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return score.issues_fixed(issues.detect_issues(people(spark, sf)), issues.detect_issues(_repaired(spark, sf)))


@query
def grades(spark: SparkSession, sf: str) -> DataFrame:
    """Grades of the mixed actions, steps and destructive ones counted in their audit."""
    after, audit = _mixed_audit(spark, sf)
    match = score.cell_match_ratio(after, people_truth(spark, sf), CELLS, row_id=ROW)
    found = score.audited_grades(issues.detect_issues(people(spark, sf)), issues.detect_issues(after), match, audit, 100_000)
    return rounded(found, "easy", "medium", "hard", places=8)


def _action_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log of actions derived from the events table."""
    return table(spark, sf, "events").selectExpr(
        "user_id AS run_id",
        "event_id AS step",
        "CASE event_id % 7 WHEN 0 THEN 'fix_missing' WHEN 1 THEN 'remove_duplicate' WHEN 2 THEN 'fix_format' "
        "WHEN 3 THEN 'fix_type' WHEN 4 THEN 'fix_outlier' WHEN 5 THEN 'no_op' ELSE 'polish' END AS action_type",
        "event_id % 11 <> 0 AS valid",
        "event_id % 3 = 0 AS correct",
        "event_id % 6 + 2 AS issues_before",
        "event_id % 5 AS issues_after",
        "value AS score",
    )


@query
def action_scores(spark: SparkSession, sf: str) -> DataFrame:
    return score.score_actions(_action_log(spark, sf))


@query
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return score.run_summary(score.score_actions(_action_log(spark, sf)))


@query
def run_summary_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Runs, their levels and all of them, in one aggregation."""
    log = score.score_actions(_action_log(spark, sf))
    return score.run_summary(log.withColumn("level", F.expr("element_at(array('easy', 'medium', 'hard'), CAST(run_id % 3 AS INT) + 1)")), level="level")


# ---------------------------------------------------------------- cleaning runs


def _as_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """People as a CSV reader would deliver them: nulls recognised, types inferred."""
    return casting.infer_types(_people(spark, sf).select(*CELLS))


@query
def infer_types(spark: SparkSession, sf: str) -> DataFrame:
    return _as_loaded(spark, sf)


@query
def clean_people(spark: SparkSession, sf: str) -> DataFrame:
    cleaned, _ = clean(_as_loaded(spark, sf))
    return rounded(cleaned, "id", "age", "salary")


@query
def clean_audit(spark: SparkSession, sf: str) -> DataFrame:
    _, audit = clean(_as_loaded(spark, sf))
    return audit


@query
def clean_events_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The log of a run that drops rows, removes outliers column by column and keeps repeated rows."""
    df = table(spark, sf, "events").selectExpr(
        "event_id", "IF(event_id % 50 = 0, NULL, user_id) AS user_id", "IF(event_id % 7 = 0, NULL, value) AS value", "IF(event_id % 40 = 0, NULL, event_type) AS event_type",
        "CAST(event_id % 1000 AS DOUBLE) AS place",
    )
    rules = {
        "duplicates": {"remove": False}, "fill_missing": {"user_id": "drop", "value": 1.5, "event_type": "drop"},
        "outliers": {"strategy": "remove_iqr", "iqr_factor": 0.3, "skip_columns": ["event_id", "user_id"]},
    }
    return clean(df, rules)[1]


@query
def clean_events(spark: SparkSession, sf: str) -> DataFrame:
    """Other strategies of a cleaning run: dropped rows, removed outliers, flat columns."""
    df = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), "event_type",
        F.when(F.col("event_id") % 50 != 0, F.col("user_id")).alias("user_id"), F.lit(1).alias("flat"),
    )
    rules = {
        "fill_missing": {"user_id": "drop", "value": "mean"},
        "outliers": {"strategy": "remove_iqr", "skip_columns": ["event_id", "user_id", "flat"]},
        "drop_low_variance": True,
    }
    cleaned, _ = clean(df, rules)
    return rounded(cleaned, "value")


@query
def job_summary(spark: SparkSession, sf: str) -> DataFrame:
    raw = _as_loaded(spark, sf)
    cleaned, audit = clean(raw)
    rules = {"columns": {"age": {"required": True, "max": 45}}}
    return runs.job_summary(raw, validate.valid_rows(cleaned, rules), audit, validate.validation_errors(cleaned, rules))


# ---------------------------------------------------------------- generated tables


@query
def synthesize_people(spark: SparkSession, sf: str) -> DataFrame:
    return generated.people_from_keys(table(spark, sf, "customer").select("c_custkey"), "c_custkey")


@query
def inject_issues(spark: SparkSession, sf: str) -> DataFrame:
    return generated.inject_issues(synthesize_people(spark, sf))


# ---------------------------------------------------------------- files and streams


@query
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "parts") + ".csv"
    writers.write_csv(table(spark, sf, "part"), path)
    return readers.read_any(spark, path)


@query
def tsv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "customers") + ".tsv"
    writers.write_tsv(table(spark, sf, "customer"), path)
    return readers.read_any(spark, path)


@query
def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "suppliers") + ".jsonl"
    writers.write_json(table(spark, sf, "supplier"), path)
    return readers.read_any(spark, path)


@query
def json_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that each hold an array of records, one per nation; every seventh is cut short and goes to the quarantine."""
    path = new_shared_path(spark, "documents")
    records = "to_json(collect_list(struct(s_suppkey, s_name, s_acctbal)), map('ignoreNullFields', 'false'))"
    texts = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.expr(f"{records} AS text"))
    cut = "IF(s_nationkey % 7 = 3, substring(text, 1, char_length(text) - 5), replace(text, '},{', '},\n {')) AS value"
    texts.selectExpr(cut, "s_nationkey").write.partitionBy("s_nationkey").text(path)
    found = readers.read_checked(spark, f"{path}/*", "json", "s_suppkey long, s_name string, s_acctbal double")
    broken = found.malformed.selectExpr("NULL AS s_suppkey", "NULL AS s_name", "NULL AS s_acctbal", "CAST(regexp_extract(file, 's_nationkey=([0-9]+)', 1) AS BIGINT) AS broken")
    return found.rows.selectExpr("*", "CAST(NULL AS BIGINT) AS broken").unionAll(broken)


@query
def csv_malformed(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as delimited text, some lines short of a field, with one too many, or with a text for a number."""
    path = new_shared_path(spark, "parts") + ".csv"
    line = """concat_ws(',', CAST(p_partkey AS STRING), concat('"', p_name, '"'), IF(p_partkey % 31 = 0, 'much', CAST(p_retailprice AS STRING)),
        IF(p_partkey % 17 = 0, NULL, CAST(p_size AS STRING)), IF(p_partkey % 23 = 0, 'extra', NULL)) AS value"""
    table(spark, sf, "part").selectExpr(line).write.text(path)
    found = readers.read_checked(spark, path, "csv", "p_partkey long, p_name string, p_retailprice double, p_size int", header=False)
    bad = found.malformed.selectExpr("CAST(split_part(record, ',', 1) AS BIGINT) AS p_partkey", "NULL AS p_name", "NULL AS p_retailprice", "NULL AS p_size", "record", "block_start = 0 AND file LIKE '%.csv/%' AS placed")
    return found.rows.selectExpr("*", "NULL AS record", "NULL AS placed").unionAll(bad)


@query
def parquet_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "orders") + ".parquet"
    writers.write_parquet(table(spark, sf, "orders"), path)
    return readers.read_any(spark, path)


@query
def report_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "errors")
    errors = validate.validation_errors(table(spark, sf, "orders"), ORDER_RULES, "o_orderkey")
    writers.write_errors(errors, path, "job-1", "parquet")
    return spark.read.parquet(path).groupBy("job_id", "column", "rule").agg(F.count(F.lit(1)).alias("n"))


@query
def reports_retried(spark: SparkSession, sf: str) -> DataFrame:
    """Profile, audit and errors of two jobs; the second job is run twice and leaves one report of each kind."""
    path = new_shared_path(spark, "reports")
    raw = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    found = profile.profile(raw, ["o_orderkey"])
    audit, errors = clean(raw)[1], validate.validation_errors(raw, ORDER_RULES, "o_orderkey")
    for job in ("job-1", "job-2", "job-2"):
        writers.write_profile(found, f"{path}/profile", job)
        writers.write_audit(audit, f"{path}/audit", job)
        writers.write_errors(errors, f"{path}/errors", job, "parquet")
    read = {"profile": spark.read.json(f"{path}/profile"), "audit": spark.read.json(f"{path}/audit"), "errors": spark.read.parquet(f"{path}/errors")}
    told = {"profile": "concat(column, '/', dtype, '/', null_count)", "audit": "concat_ws('/', step, column)", "errors": "concat(column, '/', rule)"}
    parts = [df.selectExpr("job_id", f"'{name}' AS report", f"{told[name]} AS entry").groupBy("job_id", "report", "entry").agg(F.count(F.lit(1)).alias("n")) for name, df in read.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


# Every eleventh event comes two files late.
LANDED = "CAST(least(CAST(8 * percent_rank() OVER (ORDER BY ts, event_id) AS INT), 7) + IF(event_id % 11 = 0, 2, 0) AS INT)"


@query
def stream_dedup_late(spark: SparkSession, sf: str) -> DataFrame:
    """Ten files in time order, some rows late; keys are forgotten two days after they were seen; the stream is stopped half way."""
    path = new_shared_path(spark, "events")
    events = table(spark, sf, "events").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", "user_id", "event_type", "value")
    # The ranks of the whole table say which file a row is in; one task sorts ids and times only.
    placed = events.join(events.selectExpr("event_id AS __id", f"{LANDED} AS file"), F.expr("event_id = __id")).drop("__id")
    placed = stage(placed, "landed", "file")
    schema, out = events.schema, f"{path}-out"
    for files in (range(5), range(5, 10)):
        for i in files:
            placed.filter(f"file = {i}").drop("file").coalesce(1).write.mode("append").parquet(f"{path}-in")
        ordered.dedup_stream(spark, f"{path}-in", schema, ["user_id", "event_type"], "ts", "2 days", out, f"{path}-state", ["event_id"]).awaitTermination()
    kinds = [ordered.read_kind(spark, out, kind, schema, "ts").withColumn("kind", F.lit(kind)) for kind in ordered.KINDS]
    return kinds[0].unionAll(kinds[1]).unionAll(kinds[2]).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _streamed(spark: SparkSession, sf: str) -> str:
    out = new_shared_path(spark, "stream")
    schema = table(spark, sf, "events").schema
    streaming.clean_stream(
        spark, sf, schema, EVENT_RULES, out, f"{out}-state", row_id="event_id", options={"pathGlobFilter": "events.parquet"}
    ).awaitTermination()
    return out


@query
def stream_clean(spark: SparkSession, sf: str) -> DataFrame:
    return streaming.read_valid(spark, _streamed(spark, sf)).select("event_id", "user_id", "event_type", "value")


@query
def stream_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    found = streaming.read_quarantine(spark, _streamed(spark, sf))
    return found.select("event_id", F.inline("errors"))


@query
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = new_shared_path(spark, "stream")
    schema = table(spark, sf, "events").schema
    streaming.clean_stream(
        spark, sf, schema, {}, out, f"{out}-state", options={"pathGlobFilter": "events.parquet"},
        repeats=(["user_id", "event_type"], "ts", "400 days"),
    ).awaitTermination()
    return streaming.read_valid(spark, out).select("user_id", "event_type")


# ---------------------------------------------------------------- infinite values, searched quantiles


def _reaching(spark: SparkSession, sf: str, every: int) -> DataFrame:
    """Events with an infinite value in one of ``every`` rows."""
    return table(spark, sf, "events").selectExpr("event_id", f"if(event_id % {every} = 0, double('Infinity'), value) AS value")


def _told(df: DataFrame) -> DataFrame:
    return df.selectExpr("event_id", "value = double('Infinity') AS endless", "if(value = double('Infinity'), NULL, value) AS value")


@query
def cap_iqr_infinite(spark: SparkSession, sf: str) -> DataFrame:
    return _told(outliers.cap_iqr(_reaching(spark, sf, 3), "value"))


@query
def cap_zscore_infinite(spark: SparkSession, sf: str) -> DataFrame:
    return _told(outliers.cap_zscore(_reaching(spark, sf, 7), "value"))


@query
def quantiles_searched(spark: SparkSession, sf: str) -> DataFrame:
    """Quartiles found by searching: no task may rank more than 500 values."""
    columns = ["l_extendedprice", "l_quantity"]
    found = stats.quantiles(table(spark, sf, "lineitem"), columns, [0.25, 0.5, 0.75], bracket=500)
    rows = [(c, *[float(q) for q in found[c]]) for c in columns]
    return rounded(spark.createDataFrame(rows, "column string, q1 double, median double, q3 double"), "q1", "median", "q3")
