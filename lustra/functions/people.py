"""What a cell of the nine-column people table should look like.

All columns are text ("bronze"), because a typed column could not hold a wrong type.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from lustra.functions import text, types
from lustra.functions.columns import lit


@dataclass(frozen=True)
class CellSpec:
    """Kind of a column, its accepted range and its label aliases."""

    kind: str
    low: float | None = None
    high: float | None = None
    low_open: bool = False
    labels: Mapping[str, str] = field(default_factory=dict)


# Column kinds, accepted ranges and aliases of the people table.
PEOPLE = {
    "id": CellSpec("key"),
    "name": CellSpec("name"),
    "age": CellSpec("integer", low=18, high=80),
    "email": CellSpec("email"),
    "phone": CellSpec("phone"),
    "salary": CellSpec("money", low=0, high=300000, low_open=True),
    "hire_date": CellSpec("date"),
    "department": CellSpec("label", labels=text.DEPARTMENT_LABELS),
    "is_active": CellSpec("flag"),
}
Spec = Mapping[str, CellSpec]

# Issue names, in report order.
ISSUES = (
    "missing_values",
    "duplicates",
    "wrong_format",
    "wrong_type",
    "invalid_email",
    "outliers",
    "near_duplicates",
    "inconsistent_values",
)
CELL_ISSUES = tuple(i for i in ISSUES if not i.endswith("duplicates"))

# Shapes a correct cell has.
DATE_SHAPE = r"\A\d{4}-\d{2}-\d{2}\z"
PHONE_SHAPE = r"\A\d{3}-\d{3}-\d{4}\z"
EMAIL_SHAPE = r"\A[^@\s]+@[^@\s]+\.[^@\s]+\z"


def is_missing(x: str) -> str:
    return f"({x} IS NULL OR {x} = '')"


def out_of_range(x: str, spec: CellSpec) -> str:
    """A readable number outside the accepted range; never null."""
    limits = []
    if spec.low is not None:
        limits.append(f"try_cast({x} AS DOUBLE) {'<=' if spec.low_open else '<'} {lit(float(spec.low))}")
    if spec.high is not None:
        limits.append(f"try_cast({x} AS DOUBLE) > {lit(float(spec.high))}")
    if not limits:
        return "false"
    shape = types.INTEGER_PATTERN if spec.kind == "integer" else types.NUMBER_PATTERN
    return f"coalesce({types.matches(x, shape)} AND ({' OR '.join(limits)}), false)"


def _issue_tests(x: str, spec: CellSpec) -> list[tuple[str, str]]:
    """Tests and issues of a cell in the order they are tried."""
    checks = {
        "date": (f"NOT {types.matches(x, DATE_SHAPE)}", "wrong_format"),
        "phone": (f"NOT {types.matches(x, PHONE_SHAPE)}", "wrong_format"),
        "integer": (f"NOT {types.matches(x, types.INTEGER_PATTERN)}", "wrong_type"),
        "email": (f"NOT {types.matches(x, EMAIL_SHAPE)}", "invalid_email"),
        "label": (f"{text.canonical_label(x, spec.labels)} <> {x}", "inconsistent_values"),
        "name": (f"{text.title_case(x)} <> {x}", "inconsistent_values"),
        "flag": (f"{x} NOT IN ('true', 'false')", "inconsistent_values"),
    }
    chain = [(is_missing(x), "missing_values")]
    if spec.kind in checks:
        chain.append(checks[spec.kind])
    if spec.kind in ("integer", "money"):
        chain.append((out_of_range(x, spec), "outliers"))
    return chain


def possible_issues(spec: CellSpec) -> list[str]:
    return [issue for _, issue in _issue_tests("x", spec)]


def cell_issue(x: str, spec: CellSpec) -> str:
    """Name of the first issue a cell has, null when it has none."""
    return f"CASE {' '.join(f'WHEN {test} THEN {lit(issue)}' for test, issue in _issue_tests(x, spec))} END"


def cast_cell(x: str, spec: CellSpec) -> str:
    """Cell as its kind's canonical text; a value that does not fit stays unchanged."""
    if spec.kind in ("integer", "key"):
        return f"coalesce({types.integer_text(x)}, {x})"
    if spec.kind == "money":
        return f"coalesce({types.money_text(x)}, {x})"
    if spec.kind == "flag":
        return f"coalesce({types.flag_text(x)}, {x})"
    return text.canonical_label(x, spec.labels) if spec.kind == "label" else x


def format_cell(x: str, spec: CellSpec) -> str:
    """Cell in its kind's layout; kinds without a layout stay unchanged."""
    if spec.kind == "date":
        return text.format_date(x)
    if spec.kind == "phone":
        return text.format_phone(x)
    if spec.kind == "label":
        return text.canonical_label(x, spec.labels)
    return text.title_case(x) if spec.kind == "name" else x


def normal_cell(x: str, spec: CellSpec) -> str:
    """The form in which two cells are compared for duplicates and for scoring."""
    if spec.kind == "name":
        return f"coalesce({text.strip(x)}, 'None')"
    if spec.kind == "email":
        return text.normalize_email(x)
    if spec.kind in ("date", "phone", "label"):
        return format_cell(x, spec)
    return cast_cell(x, spec) if spec.kind in ("integer", "money", "flag") else x
