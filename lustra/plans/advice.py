"""Cleaning suggestions computed from a profile by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame

DROP_ABOVE = 90.0
CAST_ABOVE = 90.0


def suggest_rules(profile: DataFrame) -> DataFrame:
    """One row per profiled column with what the profile suggests for it.

    Mostly empty columns are dropped; numbers are filled by the median when they have
    outliers, by the mean otherwise; text that mostly reads as numbers is cast; other text is
    normalised and filled by its mode.
    """
    drop = f"null_pct > {DROP_ABOVE}"
    outlying = "coalesce(outlier_count_iqr, 0) > 0"
    numeric_text = f"coalesce(numeric_text_pct >= {CAST_ABOVE}, false)"
    fill = f"""CASE WHEN {drop} OR null_count = 0 THEN NULL
        WHEN mean IS NULL THEN 'mode' WHEN {outlying} THEN 'median' ELSE 'mean' END"""
    notes = f"""nullif(concat_ws('; ',
        CASE WHEN {drop} THEN concat('mostly empty: ', null_pct, '% null') END,
        CASE WHEN {outlying} THEN concat(outlier_count_iqr, ' values outside the quartile range') END,
        CASE WHEN {numeric_text} AND numeric_text_pct < 100 THEN 'numbers mixed with text' END,
        CASE WHEN unique_count = 1 THEN 'one value only' END), '')"""
    return profile.selectExpr(
        "column",
        f"{drop} AS drop_column",
        f"{fill} AS fill_strategy",
        f"CASE WHEN NOT ({drop}) AND {numeric_text} THEN 'numeric' END AS cast_type",
        f"NOT ({drop}) AND dtype = 'string' AND NOT {numeric_text} AS normalize_text",
        f"CASE WHEN {outlying} THEN 'cap_iqr' ELSE 'none' END AS outlier_strategy",
        f"NOT ({drop}) AND coalesce(unique_count > 1, false) AS informative",
        f"{notes} AS anomaly",
    )


def advice_dict(suggestions: DataFrame) -> dict:
    """Suggestions as one dictionary for ``merge_advice``; one row per column is gathered."""
    rows = suggestions.collect()
    return {
        "drop_columns": [r["column"] for r in rows if r["drop_column"]],
        "fill_missing": {r["column"]: r["fill_strategy"] for r in rows if r["fill_strategy"]},
        "outlier_strategy": "cap_iqr" if any(r["outlier_strategy"] == "cap_iqr" for r in rows) else "none",
        "cast_types": {r["column"]: r["cast_type"] for r in rows if r["cast_type"]},
        "normalize_text": [r["column"] for r in rows if r["normalize_text"]],
        "anomalies": [f"{r['column']}: {r['anomaly']}" for r in rows if r["anomaly"]],
        "feature_importance_hints": [r["column"] for r in rows if r["informative"]],
        "notes": f"{len(rows)} columns profiled",
    }
