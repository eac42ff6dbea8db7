"""Projections and aggregations from expression text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.functions.columns import ref

# Keeps the generated code of one aggregation within what the JVM compiles.
AGGREGATES_PER_JOB = 256


def with_exprs(df: DataFrame, exprs: Mapping[str, str]) -> DataFrame:
    """Replace or add columns; all expressions see the input row."""
    return df.withColumns({name: F.expr(text) for name, text in exprs.items()}) if exprs else df


def aggregate(df: DataFrame, exprs: Mapping[str, str]) -> DataFrame:
    """One row with the named aggregates; very many of them take one scan per ``AGGREGATES_PER_JOB``."""
    named = [F.expr(f"{text} AS {ref(name)}") for name, text in exprs.items()]
    parts = [df.agg(*named[at : at + AGGREGATES_PER_JOB]) for at in range(0, len(named), AGGREGATES_PER_JOB)]
    out = parts[0]
    for part in parts[1:]:
        # One row each.
        out = out.crossJoin(F.broadcast(part))
    return out


def aggregate_by(df: DataFrame, keys: Sequence[str], exprs: Mapping[str, str]) -> DataFrame:
    """Named aggregates per group of plain columns."""
    return df.groupBy(*[F.expr(ref(k)) for k in keys]).agg(*[F.expr(f"{text} AS {ref(name)}") for name, text in exprs.items()])


def fetch(df: DataFrame, exprs: Mapping[str, str]) -> dict[str, object]:
    """The named aggregates of the whole table.

    Very wide tables take one scan per ``AGGREGATES_PER_JOB``, each reading its columns only.
    """
    names, out = list(exprs), {}
    for at in range(0, len(names), AGGREGATES_PER_JOB):
        part = {name: exprs[name] for name in names[at : at + AGGREGATES_PER_JOB]}
        out |= aggregate(df, part).first().asDict(recursive=False)
    return out


def fetch_from(row: DataFrame, exprs: Mapping[str, str]) -> dict[str, object]:
    """The named expressions over a table of one row."""
    return row.selectExpr(*[f"{text} AS {ref(name)}" for name, text in exprs.items()]).first().asDict(recursive=False)


def pick(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[F.expr(ref(n)) for n in names])
