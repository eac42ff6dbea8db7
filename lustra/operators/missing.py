"""Imputation and removal of missing values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lustra.functions.columns import as_list, dtype, is_fractional, is_numeric, lit, number, ref
from lustra.functions.frames import with_exprs
from lustra.operators import stats

STATISTICS = ("mean", "median", "mode")


def fit_fill(
    df: DataFrame, strategies: Mapping[str, str], exact: bool = True, rows: int | None = None
) -> dict[str, object]:
    """Fill value per column for ``mean``, ``median`` and ``mode``.

    Columns a strategy cannot serve (mean of text, mode of an all-null column) are left out.  ``rows``, if
    known, saves medians of short tables a scan.
    """
    unknown = {s for s in strategies.values() if s not in STATISTICS}
    if unknown:
        raise ValueError(f"unknown fill statistics: {sorted(unknown)}")

    def asked(strategy: str) -> list[str]:
        return [c for c, s in strategies.items() if s == strategy]

    numeric = [c for c in strategies if is_numeric(dtype(df, c))]
    means = stats.moments(df, [c for c in asked("mean") if c in numeric])
    medians = stats.quantiles(df, [c for c in asked("median") if c in numeric], [0.5], exact=exact, rows=rows)
    values: dict[str, object] = {c: m.mean for c, m in means.items()}
    values |= {c: q[0] for c, q in medians.items()}
    values |= stats.modes(df, asked("mode"))
    return {c: v for c, v in values.items() if v is not None}


def _fits(value: object, data_type: T.DataType) -> bool:
    if isinstance(data_type, T.BooleanType):
        return isinstance(value, bool)
    if is_numeric(data_type):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return not isinstance(data_type, T.StringType) and not isinstance(value, (str, int, float))


def _filled(df: DataFrame, name: str, value: object) -> str:
    """Column with nulls replaced; the column becomes text when the value is not of its type."""
    data_type, c = dtype(df, name), ref(name)
    if not _fits(value, data_type):
        return f"coalesce(CAST({c} AS STRING), {lit(str(value))})"
    if is_fractional(data_type) or (isinstance(value, float) and is_numeric(data_type)):
        # A fractional fill turns a whole-number column into a double column.
        return f"coalesce({number(df, name)}, {lit(float(value))})"
    return f"coalesce({c}, CAST({lit(value)} AS {data_type.simpleString()}))"


def apply_fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return with_exprs(df, {c: _filled(df, c, v) for c, v in values.items()})


def fill_mean(df: DataFrame, columns: str | list[str]) -> DataFrame:
    return apply_fill(df, fit_fill(df, {c: "mean" for c in as_list(columns)}))


def fill_median(df: DataFrame, columns: str | list[str], exact: bool = True) -> DataFrame:
    return apply_fill(df, fit_fill(df, {c: "median" for c in as_list(columns)}, exact))


def fill_mode(df: DataFrame, columns: str | list[str]) -> DataFrame:
    return apply_fill(df, fit_fill(df, {c: "mode" for c in as_list(columns)}))


def fill_constant(df: DataFrame, columns: str | list[str], value: object = "unknown") -> DataFrame:
    return apply_fill(df, {c: value for c in as_list(columns)})


def drop_missing_rows(df: DataFrame, column: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Drop rows null in ``column``, or with fewer than ``(1 - threshold)`` of their cells."""
    if column is not None:
        return df.filter(f"{ref(column)} IS NOT NULL")
    needed = int(len(df.columns) * (1 - threshold))
    present = " + ".join(f"CAST({ref(c)} IS NOT NULL AS INT)" for c in df.columns)
    return df.filter(f"{present} >= {needed}") if needed > 0 else df


def sparse_columns(rows: int, nulls: Mapping[str, int], threshold: float) -> list[str]:
    """Columns whose null share is above the threshold; an empty table keeps all."""
    return [c for c, n in nulls.items() if rows and n / rows > threshold]


def drop_missing_cols(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.drop(*sparse_columns(*stats.null_counts(df), threshold))
