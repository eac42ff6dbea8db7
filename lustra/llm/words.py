"""Words of whole texts as SQL expressions, and helpers every operator here shares."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lustra.functions.columns import ref

# Words are maximal runs of anything but the six ASCII white-space characters.
BLANKS = "\\t\\n\\u000B\\u000C\\r"
WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"


def word_list(text: str) -> str:
    """Array of words of a text expression; null gives no words."""
    trimmed = f"trim(BOTH ' {BLANKS}' FROM coalesce({text}, ''))"
    return f"if({trimmed} = '', CAST(array() AS ARRAY<STRING>), split({trimmed}, '[\\\\x20\\\\x09-\\\\x0D]+'))"


def has_word(text: str) -> str:
    return f"{text} rlike '[^\\\\x20\\\\x09-\\\\x0D]'"


def word_count(text: str) -> str:
    return f"CAST(coalesce(regexp_count({text}, '{WORD}'), 0) AS BIGINT)"


def renamed_in(df: DataFrame, reserved: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns whose name an operator uses under names of no column, and what leads back."""
    taken = {n.lower() for n in reserved}
    back, used = {}, {c.lower() for c in df.columns} | taken
    for c in df.columns:
        if c.lower() in taken:
            name = next(n for i in range(len(used) + 1) if (n := f"__own{i}") not in used)
            used.add(name)
            back[name] = c
    return df.withColumnsRenamed({c: n for n, c in back.items()}), back


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without columns of these names in any case: results replace input columns of the same name."""
    taken = {n.lower() for n in names}
    return df.select(*[df[ref(c)] for c in df.columns if c.lower() not in taken])


def computed(df: DataFrame, exprs: Mapping[str, str]) -> DataFrame:
    """``df`` with the named expressions, each evaluated once a row.

    A filter on a plain projected column is pushed below the projection with the expression in place of the
    name, again and again down a chain, and inside a lambda it is then evaluated for every element.
    Columns that a generator makes stay where they are.
    """
    rows = F.array(F.struct(*[F.expr(e).alias(n) for n, e in exprs.items()]))
    return df.select("*", F.inline(rows))


def schema_with(df: DataFrame, extra: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(extra).fields])
