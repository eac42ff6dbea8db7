"""Duplicate counting, flagging and removal.

A value may be shared by a third of all rows, so rows are never sent to one task by value.
Groups are counted with partial aggregation, and results are joined back on the row id,
which is unique and therefore spreads evenly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.functions.columns import as_list, ref, refs
from lustra.functions.frames import aggregate, aggregate_by, pick
from lustra.functions.people import PEOPLE, Spec, normal_cell


def remove_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str | bool = "first",
    order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Drop duplicate rows, whole-row or by ``subset``.

    ``keep`` is ``first``, ``last`` or ``False`` (drop every member of a repeated group).
    With a subset, first and last refer to the columns ``order_by``, which should be unique
    per group.
    """
    keep = False if keep in (False, "false", "none") else keep
    if keep not in ("first", "last", False):
        raise ValueError(f"keep must be 'first', 'last' or False, not {keep!r}")
    if subset is None or set(subset) == set(df.columns):
        if keep is False:
            return aggregate_by(df, df.columns, {"__n": "count(1)"}).filter("__n = 1").drop("__n")
        return df.dropDuplicates()
    subset = list(subset)
    if keep is False:
        rest = refs(c for c in df.columns if c not in subset)
        groups = aggregate_by(df, subset, {"__n": "count(1)", "__row": f"any_value(struct({rest}))"})
        single = groups.filter("__n = 1").selectExpr(*[ref(c) for c in subset], "__row.*")
        return pick(single, df.columns)
    if order_by is None:
        raise ValueError("keep='first' or 'last' by subset needs order_by")
    # The planner keeps one row per group in every task before the shuffle (WindowGroupLimit).
    way = "DESC NULLS LAST" if keep == "last" else "ASC NULLS FIRST"
    order = ", ".join(f"{ref(c)} {way}" for c in as_list(order_by))
    rank = f"row_number() OVER (PARTITION BY {refs(subset)} ORDER BY {order})"
    return df.withColumn("__rn", F.expr(rank)).filter("__rn = 1").drop("__rn")


def signatures(df: DataFrame, spec: Spec = PEOPLE, extra: Mapping[str, str] | None = None) -> DataFrame:
    """Distinct normalised rows with their number ``n`` of occurrences."""
    normal = [F.expr(f"{normal_cell(ref(c), s)} AS {ref(c)}") for c, s in spec.items()]
    counts = {"n": "count(1)"} | dict(extra or {})
    return df.groupBy(*normal).agg(*[F.expr(f"{text} AS {ref(name)}") for name, text in counts.items()])


def count_from_signatures(found: DataFrame, key: str = "id", extra: Sequence[str] = ()) -> DataFrame:
    """One row ``(duplicates, near_duplicates, *extra)`` from counted signatures."""
    sums = {c: f"sum({ref(c)})" for c in extra}
    per_key = aggregate_by(found, [key], {"rows": "sum(n)", "variants": "count(1)", "duplicates": "sum(n - 1)"} | sums)
    near = "sum(CASE WHEN variants > 1 THEN rows - 1 ELSE 0 END)"
    totals = {"duplicates": "sum(duplicates)", "near_duplicates": near} | sums
    return aggregate(per_key, {c: f"coalesce({total}, 0)" for c, total in totals.items()})


def duplicate_counts(df: DataFrame, key: str = "id", spec: Spec = PEOPLE) -> DataFrame:
    """One row ``(duplicates, near_duplicates)``.

    Duplicates are rows beyond the first of each normalised row.  Near duplicates are rows
    beyond the first of each key that has more than one normalised form.
    """
    return count_from_signatures(signatures(df, spec), key)


def count_duplicates(df: DataFrame, spec: Spec = PEOPLE) -> DataFrame:
    return aggregate(signatures(df, spec), {"duplicates": "coalesce(sum(n - 1), 0)"})


def count_near_duplicates(df: DataFrame, key: str = "id", spec: Spec = PEOPLE) -> DataFrame:
    return duplicate_counts(df, key, spec).select("near_duplicates")


def flag_rows(df: DataFrame, row_id: str | list[str], groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add one flag per named grouping: true where the row is not alone in its group.

    Rows alone in their group are found with partial aggregation and joined on the row id, so
    a group of any size stays spread; all flags share the shuffle of the rows by their id.
    """
    row_id = as_list(row_id)
    ids = [F.expr(f"min({ref(c)}) AS {ref(c)}") for c in row_id]
    out = df
    for name, group in groups.items():
        keys = [F.expr(f"{g} AS __g{i}") for i, g in enumerate(group)]
        counted = df.groupBy(*keys).agg(F.expr("count(1) AS __n"), *ids).filter("__n = 1")
        alone = counted.selectExpr(*[ref(c) for c in row_id], "true AS __alone")
        out = out.join(alone, row_id, "left").withColumn(name, F.expr("__alone IS NULL")).drop("__alone")
    return out


def _signature(spec: Spec) -> list[str]:
    return [normal_cell(ref(c), s) for c, s in spec.items()]


def flag_duplicate_rows(
    df: DataFrame, row_id: str | list[str], spec: Spec = PEOPLE, name: str = "is_duplicate"
) -> DataFrame:
    """Flag rows whose normalised form occurs more than once."""
    return flag_rows(df, row_id, {name: _signature(spec)})


def flag_near_duplicate_rows(
    df: DataFrame, row_id: str | list[str], key: str = "id", name: str = "is_near_duplicate"
) -> DataFrame:
    """Flag rows whose key occurs more than once."""
    return flag_rows(df, row_id, {name: [ref(key)]})


def flag_duplicates(df: DataFrame, row_id: str | list[str], key: str = "id", spec: Spec = PEOPLE) -> DataFrame:
    """Both flags at once."""
    return flag_rows(df, row_id, {"is_duplicate": _signature(spec), "is_near_duplicate": [ref(key)]})


def first_rows(
    df: DataFrame, row_id: str | list[str], columns: Sequence[str], carry: Sequence[str] = ()
) -> DataFrame:
    """Row ids of the first of each set of identical raw rows, with the ``carry`` columns."""
    row_id = as_list(row_id)
    if len(row_id) == 1:
        groups, ids = aggregate_by(df, columns, {"__first": f"min({ref(row_id[0])})"}), f"__first AS {ref(row_id[0])}"
    else:
        groups, ids = aggregate_by(df, columns, {"__first": f"min(struct({refs(row_id)}))"}), "__first.*"
    return groups.selectExpr(ids, *[ref(c) for c in carry])


def later_copies(df: DataFrame, row_id: str | list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Row ids of every copy of an identical raw row after the first by row id."""
    row_id = as_list(row_id)
    columns = [c for c in df.columns if c not in row_id] if columns is None else list(columns)
    return pick(df, row_id).join(first_rows(df, row_id, columns), row_id, "left_anti")
