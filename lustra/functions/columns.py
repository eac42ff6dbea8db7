"""Column references, literals and type tests shared by all modules."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ref(name: str) -> str:
    """A top-level column whatever characters its name holds."""
    return "`" + name.replace("`", "``") + "`"


def refs(names: Iterable[str]) -> str:
    return ", ".join(ref(n) for n in names)


def lit(value: object) -> str:
    """A Python value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"double('{value!r}')"
    if isinstance(value, int):
        return str(value)
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def lits(values: Iterable[object]) -> str:
    return ", ".join(lit(v) for v in values)


def any_of(conditions: Sequence[str]) -> str:
    return " OR ".join(f"({c})" for c in conditions) if conditions else "false"


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(data_type: T.DataType) -> bool:
    """Numbers only; booleans are treated as categories."""
    return isinstance(data_type, T.NumericType)


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.StringType)


def is_fractional(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DoubleType, T.FloatType))


def is_groupable(data_type: T.DataType) -> bool:
    """Types whose values can be counted and compared."""
    return isinstance(data_type, T.AtomicType) and not isinstance(data_type, T.VariantType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def number(df: DataFrame, name: str) -> str:
    """Numeric column as double with NaN read as missing."""
    value = f"CAST({ref(name)} AS DOUBLE)"
    return f"nullif({value}, double('NaN'))" if is_fractional(dtype(df, name)) else value


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)
