"""Column profiles as a long table with one row per column.

The work is a fixed number of scans, whatever the number of columns: null counts, moments,
quantiles, one pass for histograms and outliers, value counts, and one look at the first rows
for sample values.  Long texts are counted by digest, so they are never shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import ROUND_HALF_UP, Context, Decimal
from functools import reduce
from math import isfinite

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lustra.functions import types
from lustra.functions.columns import dtype, is_fractional, is_groupable, is_numeric, is_text, lit, lits, number, numeric_columns, ref, refs, text_columns
from lustra.functions.frames import aggregate, aggregate_by, fetch
from lustra.operators import stats
from lustra.operators.outliers import iqr_bounds
from lustra.session import stage

BINS = 10
TOP = 5
SAMPLES = 5
# Rows looked at first for sample values.
FIRST_ROWS = 200
# Items an approximate count of frequent values keeps track of, a power of two.
TRACKED = 16_384
_DIGITS = Context(prec=400)  # room for every double

SCHEMA = (
    "position int, column string, dtype string, null_count long, null_pct double, unique_count long, "
    "sample_values array<string>, mean double, median double, std double, min double, max double, "
    "q1 double, q3 double, outlier_count_iqr long, "
    "distribution struct<counts: array<long>, edges: array<double>>, "
    "top_values array<struct<value: string, n: long>>, numeric_text_pct double"
)


def _share(part: str, whole: str) -> str:
    return f"round({part} / greatest({whole}, 1) * 100, 2)"


def _rounded(x: float, places: int) -> float:
    """Half away from zero on the decimal text, as Spark's round does."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP, _DIGITS)) if isfinite(x) else x


def tidy(x: str) -> str:
    """Six decimals; infinities and NaN become null."""
    return f"CASE WHEN NOT isnan({x}) AND abs({x}) <> double('Infinity') THEN round({x}, 6) END"


def shape(df: DataFrame) -> DataFrame:
    """One row: rows, columns, total_missing, missing_pct."""
    missing = " + ".join(f"count_if({ref(c)} IS NULL)" for c in df.columns)
    counted = aggregate(df, {"rows": "count(1)", "total_missing": missing})
    share = _share("total_missing", f"rows * {len(df.columns)}")
    return counted.selectExpr("rows", f"{len(df.columns)} AS columns", "total_missing", f"{share} AS missing_pct")


def count_duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: rows beyond the first of each identical row; null equals null.

    Long texts are compared by digest and are not shuffled; maps, arrays and structs are compared as JSON text.
    """
    columns = list(columns or df.columns)

    def key(c: str) -> str:
        if not is_groupable(dtype(df, c)):
            return stats.text_key(f"to_json({ref(c)})")
        return stats.text_key(ref(c)) if is_text(dtype(df, c)) else ref(c)

    short = [f"{key(c)} AS {ref(c)}" for c in columns]
    groups = aggregate_by(df.selectExpr(*short), columns, {"__n": "count(1)"})
    return aggregate(groups, {"duplicate_rows": "coalesce(sum(__n - 1), 0)"})


def dataset(df: DataFrame) -> DataFrame:
    """One row about the whole table: rows, columns, total_missing, missing_pct, duplicate_rows."""
    # Two one-row aggregates.
    return shape(df).crossJoin(F.broadcast(count_duplicate_rows(df)))


def _per_column(row: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Turn a one-row aggregate into one row per column."""
    structs = ", ".join(f"struct({lit(name)} AS column, {parts})" for name, parts in fields.items())
    return row.selectExpr(f"inline(array({structs}))")


def column_nulls(df: DataFrame) -> DataFrame:
    """``(column, dtype, null_count, null_pct)`` in one scan."""
    nulls = {f"n{i}": f"count_if({ref(c)} IS NULL)" for i, c in enumerate(df.columns)}
    fields = {
        c: f"{lit(dtype(df, c).simpleString())} AS dtype, n{i} AS null_count, {_share(f'n{i}', 'rows')} AS null_pct"
        for i, c in enumerate(df.columns)
    }
    return _per_column(aggregate(df, {"rows": "count(1)"} | nulls), fields)


def column_numbers(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """``(column, mean, std, min, max, median, q1, q3, outlier_count_iqr)`` of numeric columns."""
    columns = numeric_columns(df) if columns is None else list(columns)
    found = stats.quantiles(df, columns, [0.25, 0.5, 0.75], exact=exact)
    aggs, fields = {}, {}
    for i, c in enumerate(columns):
        x, (q1, q2, q3) = number(df, c), found[c]
        outside = "0"
        if q1 is not None and all(map(isfinite, iqr_bounds(q1, q3))):
            low, high = map(lit, iqr_bounds(q1, q3))
            outside = f"count_if({x} < {low} OR {x} > {high})"
        aggs |= {f"mean{i}": f"avg({x})", f"std{i}": f"stddev_samp({x})", f"min{i}": f"min({x})", f"max{i}": f"max({x})"}
        aggs[f"out{i}"] = outside
        parts = [f"{tidy(f'{k}{i}')} AS {k}" for k in ("mean", "std", "min", "max")]
        parts += [f"{tidy(f'CAST({lit(v)} AS DOUBLE)')} AS {k}" for k, v in (("median", q2), ("q1", q1), ("q3", q3))]
        fields[c] = ", ".join([*parts, f"CAST(out{i} AS BIGINT) AS outlier_count_iqr"])
    return _per_column(aggregate(df, aggs), fields)


def _counted(df: DataFrame, columns: Sequence[str]) -> list[DataFrame]:
    """Value counts per column type, long texts by their keys."""
    return [stats.key_counts(df, same) for same in stats.by_type(df, columns)]


def column_uniques(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """``(column, unique_count)`` of distinct non-null values; without ``exact`` only sketches are shuffled."""
    columns = [c for c in columns or df.columns if is_groupable(dtype(df, c))]
    if not exact:
        sketched = aggregate(df, {f"u{i}": f"approx_count_distinct({ref(c)})" for i, c in enumerate(columns)})
        return _per_column(sketched, {c: f"u{i} AS unique_count" for i, c in enumerate(columns)})
    parts = [aggregate_by(counts, ["column"], {"n": "count(1)"}) for counts in _counted(df, columns)]
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    # One row per column on both sides; columns without values get a row as well.
    joined = names.join(reduce(DataFrame.unionByName, parts), "column", "left")
    return joined.selectExpr("column", "coalesce(n, 0) AS unique_count")


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = TOP, exact: bool = True) -> DataFrame:
    """``(column, rank, value, n)``: the most frequent values, smaller value first on ties.

    Without ``exact`` the winners come from sketches that keep track of ``TRACKED`` values a column, and only
    those are shuffled; how often the winners occur is counted all the same.
    """
    columns = text_columns(df) if columns is None else list(columns)
    if not exact:
        return _top_sketched(df, columns, k)
    parts = []
    for same in stats.by_type(df, columns):
        texts = is_text(dtype(df, same[0]))
        best = stats.ranked(stats.key_counts(df, same), k, keys=texts)
        best = stats.with_texts(df, stage(best, "frequent"), k) if texts else best
        parts.append(best.withColumn("value", F.expr("CAST(value AS STRING)")))
    return reduce(DataFrame.unionByName, parts)


def _top_sketched(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """Winners by sketch, as keys of text, then one scan that counts the cells with one of these keys."""
    shown = {c: "nullif(CAST(CAST({0} AS DOUBLE) + 0 AS STRING), 'NaN')" if is_fractional(dtype(df, c)) else "CAST({0} AS STRING)" for c in columns}
    texts = df.selectExpr(*[f"{shown[c].format(ref(c))} AS {ref(c)}" for c in columns])
    # Null is an item of the sketch like any other, hence one more.
    asked = {f"t{i}": f"approx_top_k({stats.text_key(ref(c))}, {k + 1}, {TRACKED})" for i, c in enumerate(columns)}
    row = fetch(texts, asked)
    rows = [(c, item["item"]) for i, c in enumerate(columns) for item in row[f"t{i}"] or () if item["item"] is not None]
    # At most k keys a column.
    keys = F.broadcast(df.sparkSession.createDataFrame(rows, "__column string, __key string"))
    cells = texts.unpivot([], [F.expr(ref(c)) for c in columns], "column", "value")
    found = cells.selectExpr("column", f"{stats.text_key('value')} AS key", "value").join(keys, F.expr("column = __column AND key = __key"))
    counts = found.groupBy("column", "key").agg(F.expr("any_value(value) AS value"), F.expr("count(1) AS n"))
    return stats.ranked(counts.drop("key"), k)


def sample_values(
    df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None, k: int = SAMPLES
) -> DataFrame:
    """``(column, rank, value)``: the first non-null values in the given order.

    The first rows of the table serve all columns that are filled there; only the others are looked for in a
    second scan, which keeps the first ``k`` per column in every task.
    """
    columns = [c for c in df.columns if is_groupable(dtype(df, c))] if columns is None else list(columns)
    order = [F.expr(ref(c)) for c in order_by]
    at = f"struct({refs(order_by)}) AS __at"
    cells = df.selectExpr(at, *[f"CAST({ref(c)} AS STRING) AS {ref(c)}" for c in columns])
    shown = ", ".join(f"struct({lit(c)} AS column, {ref(c)} AS value)" for c in columns)

    def long(rows: DataFrame) -> DataFrame:
        return rows.selectExpr("__at", f"inline(array({shown}))").filter("value IS NOT NULL")

    first = stage(df.orderBy(*order).limit(FIRST_ROWS).selectExpr(at, *[f"CAST({ref(c)} AS STRING) AS {ref(c)}" for c in columns]), "first")
    seen = aggregate(first, {"rows": "count(1)"} | {f"n{i}": f"count({ref(c)})" for i, c in enumerate(columns)}).first()
    sparse = [c for i, c in enumerate(columns) if seen["rows"] == FIRST_ROWS and seen[f"n{i}"] < k]
    found = long(first)
    if sparse:
        rest = cells.selectExpr("__at", f"inline(array({', '.join(f'struct({lit(c)} AS column, {ref(c)} AS value)' for c in sparse)}))")
        found = found.filter(f"column NOT IN ({lits(sparse)})").unionByName(rest.filter("value IS NOT NULL"))
    rank = "CAST(row_number() OVER (PARTITION BY column ORDER BY __at) AS INT) AS rank"
    return found.selectExpr("column", rank, "value").filter(f"rank <= {k}")


def _edges(low: float, high: float, bins: int) -> list[float]:
    """Bin edges from minimum to maximum; a single value gets one unit of width around it."""
    if low == high:
        low, high = low - 0.5, high + 0.5
    return [low + (high - low) * b / bins for b in range(bins)] + [high]


def _bin_counts(x: str, edges: Sequence[float]) -> list[str]:
    """Values per bin; the last bin is closed."""
    bins = len(edges) - 1
    at = f"width_bucket({x}, {lit(edges[0])}, {lit(edges[-1])}, {bins})"
    # The maximum falls into a bin of its own after the last; least() would count nulls there.
    return [f"count_if({at} {'=' if b < bins else '>='} {b})" for b in range(1, bins + 1)]


def histograms(df: DataFrame, columns: Sequence[str] | None = None, bins: int = BINS) -> DataFrame:
    """``(column, bin, low, high, n)`` of equal-width bins from minimum to maximum."""
    columns = numeric_columns(df) if columns is None else list(columns)
    aggs, fields = {}, []
    for i, (c, m) in enumerate(stats.moments(df, columns).items()):
        # A column reaching to infinity has no bins of equal width, here as in the profile.
        if not m.count or not (isfinite(m.low) and isfinite(m.high)):
            continue
        edges = _edges(m.low, m.high, bins)
        for b, counted in enumerate(_bin_counts(number(df, c), edges)):
            aggs[f"b{i}_{b}"] = counted
            low, high = lit(_rounded(edges[b], 4)), lit(_rounded(edges[b + 1], 4))
            fields.append(f"struct({lit(c)} AS column, {b + 1} AS bin, {low} AS low, {high} AS high, b{i}_{b} AS n)")
    if not fields:
        return df.sparkSession.createDataFrame([], "column string, bin int, low double, high double, n long")
    return aggregate(df, aggs).selectExpr(f"inline(array({', '.join(fields)}))")


def profile(df: DataFrame, order_by: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Full profile, one row per column (see ``SCHEMA``).

    The scans run here and their few numbers per column become the result, so that a profile
    can be summarised, compared and advised on without scanning again.  ``order_by`` names
    the columns that define "first" for sample values; without it there are none, because
    rows have no order.  Columns that cannot be compared (maps, arrays, structs) get null
    counts only.
    """
    numeric = [c for c in df.columns if is_numeric(dtype(df, c))]
    texts = text_columns(df)
    countable = [c for c in df.columns if is_groupable(dtype(df, c))]
    found: dict[str, dict] = {
        c: {"position": i, "column": c, "dtype": dtype(df, c).simpleString()} for i, c in enumerate(df.columns)
    }
    rows, spread = _scan_counts(df, texts, numeric, found)
    _scan_numbers(df, spread, rows, exact, found)
    if countable:
        _scan_values(df, countable, texts, exact, found)
    if order_by is not None and countable:
        for r in sorted(sample_values(df, order_by, countable).collect(), key=lambda r: r["rank"]):
            found[r["column"]].setdefault("sample_values", []).append(r["value"])
    names = [f.name for f in T.StructType.fromDDL(SCHEMA).fields]
    rows = [tuple(entry.get(name) for name in names) for entry in found.values()]
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def _scan_counts(
    df: DataFrame, texts: Sequence[str], numeric: Sequence[str], found: dict[str, dict]
) -> tuple[int, dict[str, stats.Moments]]:
    """Rows, nulls of every column, number-like values of text columns, moments of numbers."""
    asked = {"rows": "count(1)"} | {f"null{i}": f"count_if({ref(c)} IS NULL)" for i, c in enumerate(df.columns)}
    asked |= {f"like{i}": f"count_if({types.matches(ref(c), types.NUMBER_PATTERN)})" for i, c in enumerate(texts)}
    row = fetch(df, asked | stats.moment_exprs(df, numeric))
    rows = row["rows"]
    for i, c in enumerate(df.columns):
        found[c] |= {"null_count": row[f"null{i}"], "null_pct": _rounded(row[f"null{i}"] / max(rows, 1) * 100, 2)}
    for i, c in enumerate(texts):
        present = rows - found[c]["null_count"]
        found[c]["numeric_text_pct"] = _rounded(row[f"like{i}"] / max(present, 1) * 100, 2)
    return rows, stats.moments_of(row, numeric)


def tidy_number(x: float | None) -> float | None:
    return _rounded(x, 6) if x is not None and isfinite(x) else None


def _scan_numbers(df: DataFrame, spread: Mapping[str, stats.Moments], rows: int, exact: bool, found: dict[str, dict]) -> None:
    """Quartiles, then outliers and histogram between the bounds they give."""
    numeric = list(spread)
    quartiles = stats.quantiles(df, numeric, [0.25, 0.5, 0.75], exact=exact, rows=rows)
    asked, edges = {}, {}
    for i, c in enumerate(numeric):
        m, (q1, q2, q3) = spread[c], quartiles[c]
        values = {"mean": m.mean, "std": m.std, "min": m.low, "max": m.high, "q1": q1, "median": q2, "q3": q3}
        found[c] |= {k: tidy_number(v) for k, v in values.items()} | {"outlier_count_iqr": 0}
        if not m.count:
            continue
        x, bounds = number(df, c), iqr_bounds(q1, q3)
        if all(map(isfinite, bounds)):
            asked[f"o{i}"] = f"count_if({x} < {lit(bounds[0])} OR {x} > {lit(bounds[1])})"
        if isfinite(m.low) and isfinite(m.high):
            edges[c] = _edges(m.low, m.high, BINS)
            asked |= {f"b{i}_{b}": n for b, n in enumerate(_bin_counts(x, edges[c]))}
    if not asked:
        return
    row = fetch(df, asked)
    for i, c in enumerate(numeric):
        if f"o{i}" in asked:
            found[c]["outlier_count_iqr"] = row[f"o{i}"]
        if c in edges:
            found[c]["distribution"] = ([row[f"b{i}_{b}"] for b in range(BINS)], [_rounded(e, 4) for e in edges[c]])


def _scan_values(
    df: DataFrame, countable: Sequence[str], texts: Sequence[str], exact: bool, found: dict[str, dict]
) -> None:
    """Distinct counts of all columns and frequent values of text columns, sharing one count."""
    for c in countable:
        found[c]["unique_count"] = 0
    if not exact:
        for r in column_uniques(df, countable, exact=False).collect():
            found[r["column"]]["unique_count"] = r["unique_count"]
        best = top_values(df, texts, exact=False) if texts else None
    else:
        parts, best = [], None
        for counts, same in zip(_counted(df, countable), stats.by_type(df, countable)):
            # Reading n keeps this side equal to the ranking side, so both reuse one shuffle.
            distinct = aggregate_by(counts, ["column"], {"n": "count_if(n > 0)"})
            parts.append(distinct.selectExpr("column", "0 AS rank", "CAST(NULL AS STRING) AS value", "n"))
            if same[0] in texts:
                parts.append(stats.ranked(counts, TOP, keys=True))
        both = stage(reduce(DataFrame.unionByName, parts), "values")
        for r in both.filter("rank = 0").collect():
            found[r["column"]]["unique_count"] = r["n"]
        best = stats.with_texts(df, both.filter("rank > 0"), TOP) if texts else None
    if best is not None:
        for r in sorted(best.collect(), key=lambda r: r["rank"]):
            found[r["column"]].setdefault("top_values", []).append((r["value"], r["n"]))


def profile_summary(found: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """``(position, column, summary)``: one text line per column, with statistics only and no further data.

    With ``whole``, the row of ``dataset``, three lines about the table come first; they name no column.
    """
    numbers = ", ".join(f"concat('{k}=', coalesce(CAST({k} AS STRING), 'None'))" for k in ("mean", "std", "min", "max"))
    parts = ", ".join(
        (
            "concat('null=', null_pct, '%')",
            "concat('unique=', coalesce(CAST(unique_count AS STRING), '?'))",
            f"CASE WHEN mean IS NOT NULL THEN concat_ws(', ', {numbers}) END",
            "CASE WHEN outlier_count_iqr > 0 THEN concat('IQR_outliers=', outlier_count_iqr) END",
            "CASE WHEN size(top_values) > 0 THEN concat('top_vals=[', array_join(slice(top_values.value, 1, 3), ', '), ']') END",
        )
    )
    lines = found.selectExpr("position", "column", f"concat(column, ' [', dtype, ']: ', concat_ws(', ', {parts})) AS summary")
    if whole is None:
        return lines
    texts = ("concat(rows, ' rows, ', columns, ' columns')", "concat(total_missing, ' cells missing (', missing_pct, '%)')", "concat(duplicate_rows, ' duplicate rows')")
    head = whole.selectExpr(f"posexplode(array({', '.join(texts)})) AS (position, summary)")
    return head.selectExpr(f"position - {len(texts)} AS position", "CAST(NULL AS STRING) AS column", "summary").unionByName(lines)


DIFF_FIELDS = ("null_count", "unique_count", "mean", "std", "min", "max", "outlier_count_iqr")


def profile_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two profiles side by side with the change of every number."""

    def side(found: DataFrame, mark: str) -> DataFrame:
        return found.selectExpr("column", *[f"{f} AS {f}_{mark}" for f in ("dtype", *DIFF_FIELDS)])

    status = "CASE WHEN dtype_after IS NULL THEN 'dropped' WHEN dtype_before IS NULL THEN 'added' ELSE 'kept' END AS status"
    change = [f"{f}_after - {f}_before AS {f}_change" for f in DIFF_FIELDS]
    return side(before, "before").join(side(after, "after"), "column", "full").selectExpr("*", status, *change)
