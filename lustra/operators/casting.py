"""Column type repair."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame

from lustra.functions import text, types
from lustra.functions.columns import dtype, ref, text_columns
from lustra.functions.frames import fetch, with_exprs
from lustra.functions.people import PEOPLE, Spec, cast_cell

# Accepted names of the three target types.
CAST_KINDS = {
    "int": "numeric",
    "float": "numeric",
    "numeric": "numeric",
    "datetime": "datetime",
    "date": "datetime",
    "boolean": "boolean",
    "bool": "boolean",
}


WHOLE_PATTERN = r"\A\s*[+-]?\d+\s*\z"


def cast_numeric(df: DataFrame, column: str) -> DataFrame:
    return cast_types(df, {column: "numeric"})


def cast_datetime(df: DataFrame, column: str, formats: Sequence[str] | str | None = None) -> DataFrame:
    return with_exprs(df, {column: types.to_timestamp(ref(column), dtype(df, column), formats)})


def cast_boolean(
    df: DataFrame,
    column: str,
    true_words: Iterable[str] = types.TRUE_WORDS,
    false_words: Iterable[str] = types.FALSE_WORDS,
) -> DataFrame:
    return with_exprs(df, {column: types.to_boolean(ref(column), true_words, false_words)})


def cast_types(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Cast columns as configured; columns the table does not have are skipped."""
    casts = {}
    for name, kind in kinds.items():
        if name not in df.columns:
            continue
        target, data_type = CAST_KINDS.get(kind), dtype(df, name)
        if target == "numeric":
            casts[name] = types.to_number(ref(name), data_type)
        elif target == "datetime":
            casts[name] = types.to_timestamp(ref(name), data_type)
        elif target == "boolean":
            casts[name] = types.to_boolean(ref(name))
    return with_exprs(df, casts)


def cast_to_schema(df: DataFrame, spec: Spec = PEOPLE) -> DataFrame:
    """Text table with every cell in its kind's canonical text where it fits."""
    return with_exprs(df, {c: cast_cell(ref(c), s) for c, s in spec.items() if c in df.columns})


def infer_types(df: DataFrame) -> DataFrame:
    """Give text columns the narrowest of boolean, long and double all their values fit.

    One scan for the whole table.  Dates stay text; all-null columns stay text.
    """
    names = text_columns(df)
    if not names:
        return df
    asked = {}
    for i, name in enumerate(names):
        c = ref(name)
        whole = f"{types.matches(c, WHOLE_PATTERN)} AND try_cast({c} AS BIGINT) IS NOT NULL"
        asked |= {
            f"n{i}": f"count({c})",
            f"b{i}": f"count_if(lower({c}) IN ('true', 'false'))",
            f"l{i}": f"count_if({whole})",
            f"d{i}": f"count({types.text_to_number(c)})",
        }
    row = fetch(df, asked)
    casts = {}
    for i, name in enumerate(names):
        total = row[f"n{i}"]
        if total and row[f"b{i}"] == total:
            casts[name] = f"try_cast(lower({ref(name)}) AS BOOLEAN)"
        elif total and row[f"l{i}"] == total:
            casts[name] = f"try_cast({text.strip(ref(name))} AS BIGINT)"
        elif total and row[f"d{i}"] == total:
            casts[name] = types.text_to_number(ref(name))
    return with_exprs(df, casts)
