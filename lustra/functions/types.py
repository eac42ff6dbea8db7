"""Tolerant type repair: a value that does not fit becomes null or stays as it was."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import types as T

from lustra.functions import text
from lustra.functions.columns import is_fractional, lit, lits

# Words read as booleans by the general cast and by the stricter schema cast.
TRUE_WORDS = ("true", "1", "yes", "y", "on")
FALSE_WORDS = ("false", "0", "no", "n", "off")
SCHEMA_TRUE_WORDS = ("true", "1", "yes")
SCHEMA_FALSE_WORDS = ("false", "0", "no")

_NUMBER = r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|(?i:inf|infinity))"
NUMBER_PATTERN = rf"\A\s*{_NUMBER}\s*\z"
FLOAT_WORD_PATTERN = rf"\A\s*(?:{_NUMBER}|[+-]?(?i:nan))\s*\z"
INTEGER_PATTERN = r"\A[+-]?\d+\z"
# Whole numbers already written the shortest way.
PLAIN_PATTERN = r"\A(?:0|-?[1-9]\d{0,14})\z"
ISO_TIME_PATTERN = r"\A\s*\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)?\s*\z"


def matches(x: str, pattern: str) -> str:
    return f"({x} RLIKE {lit(pattern)})"


def text_to_number(x: str) -> str:
    """Decimal text as double; null for anything else, including Java-only forms like ``25d``."""
    return f"CASE WHEN {matches(x, NUMBER_PATTERN)} THEN try_cast({x} AS DOUBLE) END"


def to_number(x: str, data_type: T.DataType) -> str:
    if isinstance(data_type, T.StringType):
        return text_to_number(x)
    value = f"try_cast({x} AS DOUBLE)"
    return f"nullif({value}, double('NaN'))" if is_fractional(data_type) else value


def to_timestamp(x: str, data_type: T.DataType, formats: Sequence[str] | str | None = None) -> str:
    """Timestamp from ISO text, or from the first matching ``%Y``/``%m``/``%d`` layout."""
    if not isinstance(data_type, T.StringType):
        return f"try_cast({x} AS TIMESTAMP)"
    if formats is None:
        return f"CASE WHEN {matches(x, ISO_TIME_PATTERN)} THEN try_cast({x} AS TIMESTAMP) END"
    formats = [formats] if isinstance(formats, str) else formats
    return f"CAST({text.parse_date(x, *formats)} AS TIMESTAMP)"


def to_boolean(x: str, true_words: Iterable[str] = TRUE_WORDS, false_words: Iterable[str] = FALSE_WORDS) -> str:
    word = f"lower({text.strip(f'CAST({x} AS STRING)')})"
    return f"CASE WHEN {word} IN ({lits(true_words)}) THEN true WHEN {word} IN ({lits(false_words)}) THEN false END"


def integer_text(x: str) -> str:
    """Number truncated toward zero, as text; null when it is not a number."""
    whole = f"CAST(try_cast({text_to_number(x)} AS BIGINT) AS STRING)"
    return f"CASE WHEN {matches(x, PLAIN_PATTERN)} THEN {x} ELSE {whole} END"


def money_text(x: str) -> str:
    """Number rounded to two places (halves away from zero), shortest text."""
    fixed = f"CAST(try_cast(round({text_to_number(x)}, 2) AS DECIMAL(38,2)) AS STRING)"
    short = f"regexp_replace({fixed}, {lit(r'\.?0+\z')}, '')"
    return f"CASE WHEN {matches(x, PLAIN_PATTERN)} THEN {x} ELSE {short} END"


def flag_text(x: str) -> str:
    word = to_boolean(x, SCHEMA_TRUE_WORDS, SCHEMA_FALSE_WORDS)
    return f"CASE WHEN {x} IN ('true', 'false') THEN {x} ELSE CAST({word} AS STRING) END"
