"""DataFrame forms of the text rules."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.functions import text
from lustra.functions.columns import as_list, ref
from lustra.functions.frames import with_exprs
from lustra.functions.people import PEOPLE, Spec, is_missing, normal_cell


def _each(df: DataFrame, columns: str | list[str], rule: Callable[[str], str]) -> DataFrame:
    return with_exprs(df, {c: rule(f"CAST({ref(c)} AS STRING)") for c in as_list(columns)})


def normalize_text(df: DataFrame, columns: str | list[str]) -> DataFrame:
    return _each(df, columns, text.normalize_text)


def strip_whitespace(df: DataFrame, columns: str | list[str]) -> DataFrame:
    return _each(df, columns, text.strip)


def fix_email(df: DataFrame, columns: str | list[str]) -> DataFrame:
    """Malformed addresses become null, ready to be filled."""
    return _each(df, columns, text.valid_email_or_null)


def normalize_email(df: DataFrame, columns: str | list[str]) -> DataFrame:
    return _each(df, columns, text.normalize_email)


def title_case(df: DataFrame, columns: str | list[str]) -> DataFrame:
    return _each(df, columns, text.title_case)


def canonical_value(
    df: DataFrame, columns: str | list[str], labels: Mapping[str, str] = text.DEPARTMENT_LABELS
) -> DataFrame:
    return _each(df, columns, lambda c: text.canonical_label(c, labels))


def canonical_from_table(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Canonical labels from an ``(alias, label)`` table of any size.

    The join is left to the planner: a small table is broadcast by its measured size, a
    large one is shuffled with skewed values split at run time.
    """
    key, found = text.normalize_email("alias"), text.normalize_email(ref(column))
    known = aliases.groupBy(F.expr(f"{key} AS __alias")).agg(F.expr("min(label) AS __label"))
    joined = df.join(known, F.expr(f"{found} = __alias"), "left")
    label = f"coalesce(__label, {text.title_case(text.strip(ref(column)))})"
    return with_exprs(joined, {column: label}).drop("__alias", "__label")


def format_date(df: DataFrame, columns: str | list[str], formats: Sequence[str] = text.DATE_FORMATS) -> DataFrame:
    return _each(df, columns, lambda c: text.format_date(c, formats))


def format_phone(df: DataFrame, columns: str | list[str]) -> DataFrame:
    return _each(df, columns, text.format_phone)


def derive_email(df: DataFrame, name: str, email: str) -> DataFrame:
    """Fill missing or blank addresses from the name."""
    found = f"CASE WHEN {is_missing(ref(email))} THEN {text.derive_email(ref(name))} ELSE {ref(email)} END"
    return with_exprs(df, {email: found})


def normalized_row(df: DataFrame, spec: Spec = PEOPLE) -> DataFrame:
    """Replace every specified column by the form used for comparing rows."""
    return with_exprs(df, {c: normal_cell(ref(c), s) for c, s in spec.items() if c in df.columns})
