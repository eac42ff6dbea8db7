"""Outlier bounds, clipping, removal, and column pruning."""

from __future__ import annotations

from collections.abc import Mapping
from math import isfinite

from pyspark.sql import DataFrame

from lustra.functions.columns import as_list, dtype, is_numeric, lit, number, numeric_columns, ref
from lustra.functions.frames import with_exprs
from lustra.functions.people import CellSpec, out_of_range
from lustra.operators import stats

Bounds = Mapping[str, tuple[float, float]]


def _numeric(df: DataFrame, columns: str | list[str]) -> list[str]:
    return [c for c in as_list(columns) if is_numeric(dtype(df, c))]


def _finite(bounds: Bounds) -> dict[str, tuple[float, float]]:
    """Bounds that infinite values leave without a number limit nothing."""
    return {c: pair for c, pair in bounds.items() if all(map(isfinite, pair))}


def fit_iqr(
    df: DataFrame, columns: str | list[str], factor: float = 1.5, exact: bool = True, rows: int | None = None
) -> dict[str, tuple[float, float]]:
    """``q1 - f * iqr`` and ``q3 + f * iqr`` of each numeric column holding values, where both are finite.

    ``rows``, if known, saves short tables a scan.
    """
    found = stats.quantiles(df, _numeric(df, columns), [0.25, 0.75], exact=exact, rows=rows)
    return _finite({c: iqr_bounds(q1, q3, factor) for c, (q1, q3) in found.items() if q1 is not None})


def iqr_bounds(q1: float, q3: float, factor: float = 1.5) -> tuple[float, float]:
    return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)


def fit_zscore(df: DataFrame, columns: str | list[str], threshold: float = 3.0) -> dict[str, tuple[float, float]]:
    """``mean +- t * std``; columns without spread (or a single row) or without finite bounds are left out."""
    found = stats.moments(df, _numeric(df, columns))
    return _finite({c: (m.mean - threshold * m.std, m.mean + threshold * m.std) for c, m in found.items() if m.std})


def apply_clip(df: DataFrame, bounds: Bounds) -> DataFrame:
    """Clip to the bounds; null stays null (``greatest`` alone would fill it)."""
    clipped = {}
    for c, (low, high) in bounds.items():
        x = number(df, c)
        clipped[c] = f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {lit(float(low))}), {lit(float(high))}) END"
    return with_exprs(df, clipped)


def cap_iqr(df: DataFrame, columns: str | list[str], factor: float = 1.5, exact: bool = True) -> DataFrame:
    return apply_clip(df, fit_iqr(df, columns, factor, exact))


def cap_zscore(df: DataFrame, columns: str | list[str], threshold: float = 3.0) -> DataFrame:
    return apply_clip(df, fit_zscore(df, columns, threshold))


def inside_iqr(df: DataFrame, column: str, factor: float = 1.5, exact: bool = True, rows: int | None = None) -> str:
    """Whether a cell lies inside the bounds of its column, as an expression; null is not inside.

    Without finite bounds every cell that is not null is inside.
    """
    bounds = fit_iqr(df, column, factor, exact, rows)
    if not bounds:
        return f"{number(df, column)} IS NOT NULL"
    low, high = bounds[column]
    return f"{ref(column)} BETWEEN {lit(low)} AND {lit(high)}"


def remove_iqr(df: DataFrame, column: str, factor: float = 1.5, exact: bool = True) -> DataFrame:
    """Keep rows inside the bounds; rows null in the column go as well.

    The bounds are literals, so the comparison reaches the parquet scan.  Without finite
    bounds only the rows null in the column go.
    """
    return df.filter(inside_iqr(df, column, factor, exact)) if is_numeric(dtype(df, column)) else df


def flag_range(df: DataFrame, spec: Mapping[str, CellSpec]) -> DataFrame:
    """Add ``<column>_outlier`` for every column with an accepted range."""
    ranged = {c: s for c, s in spec.items() if s.low is not None or s.high is not None}
    return with_exprs(df, {f"{c}_outlier": out_of_range(ref(c), s) for c, s in ranged.items()})


def drop_column(df: DataFrame, column: str) -> DataFrame:
    return df.drop(column)


def low_variance_columns(df: DataFrame, threshold: float = 0.01) -> list[str]:
    """Numeric columns whose sample deviation is below the threshold."""
    found = stats.moments(df, numeric_columns(df))
    return [c for c, m in found.items() if m.std is not None and m.std < threshold]


def drop_low_variance(df: DataFrame, threshold: float = 0.01) -> DataFrame:
    return df.drop(*low_variance_columns(df, threshold))
