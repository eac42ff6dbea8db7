"""Rule-driven validation without a shuffle.

``validate`` scans the table once for all it returns; the single results each take a scan of
their own and are not written anywhere.  Every rule compiles to a test and an error.  The same compiled rules give the valid rows, the
long error table and the quarantine table, in batch and on streams.  ``allowed_values`` is a
short list, which becomes a literal, or a table, whose first column is joined.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lustra.functions import types
from lustra.functions.columns import any_of, as_list, dtype, is_numeric, lit, lits, ref
from lustra.functions.frames import pick, with_exprs
from lustra.session import stage

ERROR = "column: string, rule: string, value: string, message: string"


@dataclass(frozen=True)
class _Check:
    """A rule on a column: ``failed`` is never null."""

    column: str
    rule: str
    failed: str
    message: str

    @property
    def error(self) -> str:
        fields = f"{lit(self.column)} AS column, {lit(self.rule)} AS rule"
        value = f"CAST({ref(self.column)} AS STRING) AS value"
        return f"CASE WHEN {self.failed} THEN struct({fields}, {value}, {self.message} AS message) END"


def java_pattern(pattern: str, spark: SparkSession | None = None) -> str:
    """Start-anchored Java form of a Python pattern, checked before any data is read."""
    re.compile(pattern)
    body = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<")).replace(r"\Z", r"\z")
    anchored = rf"\A(?U:{body})"
    if spark is not None:
        spark.sql(f"SELECT regexp_like('', {lit(anchored)})").collect()
    return anchored


def _checks(df: DataFrame, schema: Mapping, row_id: Sequence[str]) -> list[_Check]:
    at = f"'Row ', concat_ws('/', {', '.join(f'CAST({ref(c)} AS STRING)' for c in row_id)}), ': ', " if row_id else ""
    out = []
    for name, rules in schema.get("columns", {}).items():
        if name not in df.columns:
            continue
        c = ref(name)
        shown, present, value = f"CAST({c} AS STRING)", f"{c} IS NOT NULL", types.to_number(c, dtype(df, name))
        readable = "true" if is_numeric(dtype(df, name)) else types.matches(shown, types.FLOAT_WORD_PATTERN)
        if is_numeric(dtype(df, name)):
            present = f"{value} IS NOT NULL"

        def add(rule: str, failed: str, before: str, after: str | None = None) -> None:
            text = lit(before) if after is None else f"{lit(before)}, {shown}, {lit(after)}"
            out.append(_Check(name, rule, f"coalesce({failed}, false)", f"concat({at}{text})"))

        if rules.get("required", False):
            add("required", f"NOT ({present})", f"'{name}' must not be empty")
        if rules.get("type") == "numeric":
            add("type", f"{present} AND NOT {readable}", f"'{name}' holds no number: '", "'")
        if "min" in rules:
            add("min", f"{value} < {lit(rules['min'])}", f"'{name}' is below {rules['min']}: ", "")
        if "max" in rules:
            add("max", f"{value} > {lit(rules['max'])}", f"'{name}' is above {rules['max']}: ", "")
        if "pattern" in rules:
            found = types.matches(shown, java_pattern(rules["pattern"], df.sparkSession))
            add("pattern", f"{present} AND NOT {found}", f"'{name}' lacks the form {rules['pattern']}: '", "'")
        if isinstance(rules.get("allowed_values"), DataFrame):
            add("allowed_values", f"{present} AND {ref('__allowed_' + name)} IS NULL", f"'{name}' is not in the table of values: '", "'")
        elif "allowed_values" in rules:
            known = f"{shown} IN ({lits(str(v) for v in rules['allowed_values'])})"
            add("allowed_values", f"{present} AND NOT {known}", f"'{name}' is none of {rules['allowed_values']}: '", "'")
    return out


def missing_columns(df: DataFrame, schema: Mapping) -> DataFrame:
    """One error row per required column the table does not have; needs no data."""
    rows = [
        (name, "missing_column", None, f"Column '{name}' is required and absent")
        for name, rules in schema.get("columns", {}).items()
        if rules.get("required", False) and name not in df.columns
    ]
    return df.sparkSession.createDataFrame(rows, ERROR)


def _marked(df: DataFrame, schema: Mapping) -> DataFrame:
    """Rows with the value found in each table of allowed values, null if it is not there.

    Such a table may hold any number of values; the join is left to adaptive execution.
    """
    for name, rules in schema.get("columns", {}).items():
        allowed, mark = rules.get("allowed_values"), ref(f"__allowed_{name}")
        if isinstance(allowed, DataFrame) and name in df.columns:
            values = allowed.selectExpr(f"CAST({ref(allowed.columns[0])} AS STRING) AS {mark}").distinct()
            df = df.join(values, F.expr(f"CAST({ref(name)} AS STRING) = {mark}"), "left")
    return df


def _failed(marked: DataFrame, schema: Mapping) -> str:
    return any_of([check.failed for check in _checks(marked, schema, ())])


def valid_rows(df: DataFrame, schema: Mapping) -> DataFrame:
    """Rows that break no rule."""
    marked = _marked(df, schema)
    return pick(marked.filter(f"NOT ({_failed(marked, schema)})"), df.columns)


def validation_errors(df: DataFrame, schema: Mapping, row_id: str | Sequence[str] = ()) -> DataFrame:
    """Long ``(row id, column, rule, value, message)``; one cell may break several rules."""
    row_id = as_list(row_id)
    marked = _marked(df, schema)
    checks = _checks(marked, schema, row_id)
    nulls = [f"CAST(NULL AS {dtype(df, c).simpleString()}) AS {ref(c)}" for c in row_id]
    absent = missing_columns(df, schema).selectExpr(*nulls, "*")
    if not checks:
        return absent
    ids = [ref(c) for c in row_id]
    broken = marked.filter(any_of([check.failed for check in checks]))
    long = broken.selectExpr(*ids, f"explode(array({', '.join(check.error for check in checks)})) AS __e")
    return long.filter("__e IS NOT NULL").selectExpr(*ids, "__e.*").unionByName(absent)


def _errors(marked: DataFrame, schema: Mapping, row_id: Sequence[str]) -> str:
    """The array of rules a marked row breaks, empty for a valid one."""
    checks = _checks(marked, schema, row_id)
    found = f"array_compact(array({', '.join(check.error for check in checks)}))" if checks else "array()"
    return f"CAST({found} AS ARRAY<STRUCT<{ERROR}>>)"


def with_errors(df: DataFrame, schema: Mapping, row_id: str | Sequence[str] = (), name: str = "errors") -> DataFrame:
    """Add the array of broken rules per row; empty for a valid row."""
    marked = _marked(df, schema)
    return pick(with_exprs(marked, {name: _errors(marked, schema, as_list(row_id))}), [*[c for c in df.columns if c != name], name])


def quarantine(df: DataFrame, schema: Mapping, row_id: str | Sequence[str] = ()) -> DataFrame:
    """Rows that break a rule, with what they broke."""
    marked = _marked(df, schema)
    broken = marked.filter(_failed(marked, schema))
    return pick(with_exprs(broken, {"errors": _errors(marked, schema, as_list(row_id))}), [*[c for c in df.columns if c != "errors"], "errors"])


@dataclass(frozen=True)
class Validated:
    """A table validated once: valid rows, error table and quarantine read the one staged table, by its partitions."""

    rows: DataFrame
    absent: DataFrame
    columns: tuple[str, ...]
    row_id: tuple[str, ...]

    def valid(self) -> DataFrame:
        return pick(self.rows.filter("__broken = 0"), self.columns)

    def quarantine(self) -> DataFrame:
        kept = [c for c in self.columns if c != "errors"]
        return self.rows.filter("__broken = 1").selectExpr(*[ref(c) for c in kept], "__errors AS errors")

    def errors(self) -> DataFrame:
        ids = [ref(c) for c in self.row_id]
        long = self.rows.filter("__broken = 1").selectExpr(*ids, "inline(__errors)")
        return long.unionByName(self.absent.selectExpr(*[f"CAST(NULL AS {dtype(self.rows, c).simpleString()}) AS {ref(c)}" for c in self.row_id], "*"))


def validated(df: DataFrame, schema: Mapping, row_id: str | Sequence[str] = ()) -> Validated:
    """Validate in one scan: every row is written once with what it broke, partitioned by whether it broke anything."""
    row_id = as_list(row_id)
    marked = _marked(df, schema)
    found = with_exprs(marked, {"__errors": _errors(marked, schema, row_id)})
    found = pick(found, [*df.columns, "__errors"]).withColumn("__broken", F.expr("IF(size(__errors) > 0, 1, 0)"))
    return Validated(stage(found, "validated", "__broken"), missing_columns(df, schema), tuple(df.columns), tuple(row_id))


def validate(df: DataFrame, schema: Mapping, row_id: str | Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Valid rows and error table, from one scan of ``df``."""
    found = validated(df, schema, row_id)
    return found.valid(), found.errors()
