"""Counting and listing of quality issues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.functions.columns import as_list, lit, ref
from lustra.functions.people import CELL_ISSUES, ISSUES, PEOPLE, Spec, cell_issue, possible_issues
from lustra.operators.dedup import count_from_signatures, signatures


def detect_issues(df: DataFrame, key: str = "id", spec: Spec = PEOPLE) -> DataFrame:
    """One row with all eight counters, from one scan.

    Cell counters ride along with the grouping by normalised row that duplicates need.
    """
    named = [f"{cell_issue(ref(c), s)} AS {ref(f'__i_{c}')}" for c, s in spec.items()]
    found = df.selectExpr(*[ref(c) for c in spec], *named)

    def hits(issue: str) -> str:
        able = [c for c, s in spec.items() if issue in possible_issues(s)]
        return " + ".join(f"CAST({ref(f'__i_{c}')} <=> {lit(issue)} AS BIGINT)" for c in able) or "0"

    counted = count_from_signatures(signatures(found, spec, {i: f"sum({hits(i)})" for i in CELL_ISSUES}), key, CELL_ISSUES)
    return counted.selectExpr(*[f"CAST({i} AS BIGINT) AS {i}" for i in ISSUES])


def cell_issues(df: DataFrame, row_id: str | list[str], spec: Spec = PEOPLE) -> DataFrame:
    """Long ``(row id, column, issue, value)`` with at most one issue per cell; no shuffle."""
    cells = ", ".join(
        f"struct({lit(c)} AS column, {cell_issue(ref(c), s)} AS issue, {ref(c)} AS value)" for c, s in spec.items()
    )
    return df.selectExpr(*[ref(c) for c in as_list(row_id)], f"inline(array({cells}))").filter("issue IS NOT NULL")


def issue_counts_long(counts: DataFrame, issues: Sequence[str] = ISSUES) -> DataFrame:
    return counts.unpivot([], [F.col(i) for i in issues], "issue", "n")


def total_issues(counts: DataFrame, issues: Sequence[str] = ISSUES) -> DataFrame:
    return counts.selectExpr(" + ".join(f"greatest({i}, 0)" for i in issues) + " AS total_issues")
