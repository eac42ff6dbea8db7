"""Cleaning rules as plain dictionaries."""

from __future__ import annotations

from collections.abc import Mapping
from copy import deepcopy

# The default cleaning rules.
DEFAULT_RULES = {
    "duplicates": {"remove": True, "keep": "first"},
    "fill_missing": {
        "age": "median",
        "salary": "median",
        "is_active": "unknown",
        "email": "unknown@example.com",
        "phone": "000-000-0000",
    },
    "default_fill_strategy": "mode",
    "drop_columns_missing_above": 0.9,
    "drop_columns": [],
    "cast_types": {"age": "numeric", "salary": "numeric", "id": "numeric"},
    "normalize_text": ["name", "department", "email"],
    "outliers": {"strategy": "cap_iqr", "iqr_factor": 1.5, "zscore_threshold": 3.0, "skip_columns": ["id"]},
    "drop_low_variance": False,
    "variance_threshold": 0.01,
}


def rules_with(overrides: Mapping | None = None, base: Mapping = DEFAULT_RULES) -> dict:
    """Base rules with top-level entries replaced; inputs stay untouched."""
    return deepcopy(dict(base)) | deepcopy(dict(overrides or {}))


def merge_advice(advice: Mapping, rules: Mapping) -> dict:
    """Rules extended by suggestions; inputs stay untouched."""
    merged = deepcopy(dict(rules))
    for name in ("drop_columns", "normalize_text"):
        if advice.get(name):
            old = merged.get(name, [])
            merged[name] = old + [c for c in advice[name] if c not in old]
    for name in ("fill_missing", "cast_types"):
        if advice.get(name):
            merged[name] = merged.get(name, {}) | dict(advice[name])
    strategy = advice.get("outlier_strategy")
    if strategy and strategy != "none":
        merged["outliers"] = merged.get("outliers", {}) | {"strategy": strategy}
    return merged
