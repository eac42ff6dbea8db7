"""Profiles that merge: one row of sketches per part and column, kept as a table, summed up without rescanning.

A part is whatever the table is grouped by, a file or a day.  Counts, moments and extremes merge
exactly; distinct counts, quantiles and frequent values come from mergeable sketches.  Only
sketches are shuffled, a few kilobytes per part and column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.functions.columns import dtype, is_fractional, is_groupable, is_numeric, is_text, lit, number, ref
from lustra.functions.frames import aggregate_by
from lustra.operators import stats
from lustra.operators.profile import tidy

HLL_BITS = 14  # relative error of distinct counts about 0.8 %
KLL_SIZE = 4096  # rank error of quantiles below 0.2 %
TRACKED = 1024  # values the count of frequent values keeps track of
TOP = 5
RANK_ERROR = 0.002
# Keeps the generated code of one aggregation within what the JVM compiles.
_COLUMNS_PER_JOB = 24

_FIELDS = ("position", "column", "dtype", "rows", "nulls", "n", "mean", "m2", "low", "high", "distinct", "quantiles", "frequent")


def _hashable(df: DataFrame, c: str) -> str:
    """Column as text that is equal where values are; zeros and missing numbers are made one."""
    if is_fractional(dtype(df, c)):
        return f"CAST({number(df, c)} + 0 AS STRING)"
    return stats.text_key(ref(c)) if is_text(dtype(df, c)) else f"CAST({ref(c)} AS STRING)"


def sketch(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per part and column, plus one per part about whole rows (``column`` is null).

    Columns: ``by``, position, column, dtype, rows, nulls, n (readable numbers), mean, m2 (squared deviations),
    low, high, and binary sketches distinct, quantiles and frequent, null where the type has none.
    """
    by = list(by)
    named = [(i, c) for i, c in enumerate(df.columns) if c not in by]
    whole = ", ".join(f"xxhash64({_hashable(df, c) if is_groupable(dtype(df, c)) else f'to_json({ref(c)})'}, '{i}')" for i, c in named)
    tables = []
    for at in range(0, len(named), _COLUMNS_PER_JOB):
        asked, fields = {"rows": "count(1)"}, []
        if not at:
            asked["whole"] = f"hll_sketch_agg(xxhash64({whole}), {HLL_BITS})"
            fields.append(_struct(-1, None, None, "rows", "0L", None, "whole", None, None))
        for i, c in named[at : at + _COLUMNS_PER_JOB]:
            kind = dtype(df, c)
            asked[f"null{i}"] = f"count_if({ref(c)} IS NULL)"
            numbers = distinct = quantiles = frequent = None
            if is_numeric(kind):
                x = number(df, c)
                asked |= {f"n{i}": f"count({x})", f"mean{i}": f"avg({x})", f"m2{i}": f"var_pop({x}) * count({x})", f"low{i}": f"min({x})", f"high{i}": f"max({x})"}
                asked[f"kll{i}"] = f"kll_sketch_agg_double({x}, {KLL_SIZE})"
                numbers, quantiles = i, f"kll{i}"
            if is_groupable(kind):
                asked[f"hll{i}"] = f"hll_sketch_agg({_hashable(df, c)}, {HLL_BITS})"
                distinct = f"hll{i}"
            if is_text(kind):
                asked[f"top{i}"] = f"approx_top_k_accumulate({stats.text_key(ref(c))}, {TRACKED})"
                frequent = f"top{i}"
            fields.append(_struct(i, c, kind.simpleString(), "rows", f"null{i}", numbers, distinct, quantiles, frequent))
        found = aggregate_by(df, by, asked)
        tables.append(found.selectExpr(*[ref(c) for c in by], f"inline(array({', '.join(fields)}))"))
    return reduce(DataFrame.unionByName, tables)


def _struct(position: int, column: str | None, kind: str | None, rows: str, nulls: str, numbers: int | None, distinct: str | None, quantiles: str | None, frequent: str | None) -> str:
    def number_field(name: str, as_: str) -> str:
        return f"CAST({f'{name}{numbers}' if numbers is not None else 'NULL'} AS {as_})"

    values = [
        f"{position}", f"CAST({lit(column)} AS STRING)", f"CAST({lit(kind)} AS STRING)", rows, nulls, number_field("n", "BIGINT"),
        *[number_field(name, "DOUBLE") for name in ("mean", "m2", "low", "high")],
        f"CAST({distinct or 'NULL'} AS BINARY)", f"CAST({quantiles or 'NULL'} AS BINARY)", f"{frequent or _NO_SKETCH}",
    ]
    return f"struct({', '.join(f'{v} AS {ref(n)}' for v, n in zip(values, _FIELDS))})"


# The state of the count of frequent values is a struct, of texts here.
_NO_SKETCH = "CAST(NULL AS STRUCT<sketch: BINARY, maxItemsTracked: INT, itemDataType: STRING, itemDataTypeDDL: STRING>)"


def merge(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of :func:`sketch` of several parts as one per column, or one per ``by`` and column; may be merged again."""
    by = list(by)
    keys = [*by, "position", "column", "dtype"]
    middle = aggregate_by(sketches, keys, {"__mean": "sum(n * mean) / sum(n)"})
    # A row per merged part and column: as many as the result.
    same = " AND ".join(f"{ref(k)} <=> {ref('__' + k)}" for k in keys)
    middle = middle.selectExpr(*[f"{ref(k)} AS {ref('__' + k)}" for k in keys], "__mean")
    joined = sketches.join(middle, F.expr(same), "left")
    exact = {
        "rows": "sum(rows)", "nulls": "sum(nulls)", "n": "sum(n)", "mean": "max(__mean)",
        "m2": "sum(coalesce(m2, 0D) + coalesce(n * (mean - __mean) * (mean - __mean), 0D))",
        "low": "min(low)", "high": "max(high)", "distinct": "IF(count(`distinct`) > 0, hll_union_agg(`distinct`, true), NULL)",
        "quantiles": f"IF(count(quantiles) > 0, kll_merge_agg_double(quantiles, {KLL_SIZE}), NULL)",
    }

    def merged(part: DataFrame, frequent: str) -> DataFrame:
        return aggregate_by(part, keys, exact | {"frequent": frequent})

    # States of frequent values cannot be combined where there are none.
    texts = merged(joined.filter("frequent IS NOT NULL"), f"approx_top_k_combine(frequent, {TRACKED})")
    return texts.unionByName(merged(joined.filter("frequent IS NULL"), "any_value(frequent)"))


def profile_of(sketches: DataFrame) -> DataFrame:
    """Profile rows from sketches, one per row of ``sketches``: null share, distinct count, moments, quartiles, top values.

    Quartiles are within ``RANK_ERROR`` of their rank.  Texts longer than ``stats.SHORT`` are shown by their key.
    """

    def quantile(p: float) -> str:
        return f"CASE WHEN n > 0 THEN kll_sketch_get_quantile_double(quantiles, {p}D) END"

    numbers = {"mean": "mean", "std": "sqrt(m2 / nullif(n - 1, 0))", "min": "low", "max": "high"}
    numbers |= {"q1": quantile(0.25), "median": quantile(0.5), "q3": quantile(0.75)}
    # Null is an item of the sketch like any other.
    found = f"transform(filter(approx_top_k_estimate(frequent, {TOP + 1}), t -> t.item IS NOT NULL), t -> struct(t.item AS value, t.count AS n))"

    return sketches.filter("column IS NOT NULL").selectExpr(
        *[ref(c) for c in sketches.columns if c not in _FIELDS], "position", "column", "dtype", "rows",
        "nulls AS null_count", "round(nulls / greatest(rows, 1) * 100, 2) AS null_pct", "hll_sketch_estimate(distinct) AS unique_count",
        *[f"{tidy(x)} AS {name}" for name, x in numbers.items()],
        f"CASE WHEN frequent IS NOT NULL THEN slice({found}, 1, {TOP}) END AS top_values",
    )


def dataset_of(sketches: DataFrame) -> DataFrame:
    """The dataset numbers of merged sketches, as ``profile.dataset``; duplicate rows are an estimate."""
    by = [ref(c) for c in sketches.columns if c not in _FIELDS]
    totals = sketches.groupBy(*by).agg(
        F.expr("max(rows) AS rows"), F.expr("CAST(count(column) AS INT) AS columns"), F.expr("sum(nulls) AS total_missing"),
        F.expr("max(if(column IS NULL, greatest(rows - hll_sketch_estimate(distinct), 0), 0)) AS duplicate_rows"),
    )
    return totals.selectExpr(*by, "rows", "columns", "total_missing", "round(total_missing / greatest(rows * columns, 1) * 100, 2) AS missing_pct", "duplicate_rows")
