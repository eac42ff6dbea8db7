"""Column statistics fitted in a bounded number of aggregation jobs.

Everything returned here is a few numbers per column, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lustra.functions.columns import any_of, dtype, is_fractional, is_groupable, is_text, lit, lits, number, ref
from lustra.functions.frames import aggregate, fetch, fetch_from
from lustra.session import stage

# Values per column an exact ranking may hold in one task.
BRACKET_LIMIT = 100_000
# Rank error of the approximate percentile is 1 / SKETCH_ACCURACY of the rows.
SKETCH_ACCURACY = 10_000
_COLUMNS_PER_JOB = 16
# Longer texts are counted by their first characters and a digest of 128 bits.
SHORT = 64
# Keys of texts that are looked up by broadcast.
LOOKED_UP = 10_000


@dataclass(frozen=True)
class Moments:
    count: int
    mean: float | None
    std: float | None
    low: float | None
    high: float | None


def null_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Row count and null count of every column, in one scan."""
    row = fetch(df, {"rows": "count(1)"} | {f"n{i}": f"count_if({ref(c)} IS NULL)" for i, c in enumerate(df.columns)})
    return row["rows"], {c: row[f"n{i}"] for i, c in enumerate(df.columns)}


_MOMENTS = ("count", "avg", "stddev_samp", "min", "max")


def moment_exprs(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    return {f"{f}{i}": f"{f}({number(df, c)})" for i, c in enumerate(columns) for f in _MOMENTS}


def moments_of(row: Mapping[str, object], columns: Sequence[str]) -> dict[str, Moments]:
    return {c: Moments(*[row[f"{f}{i}"] for f in _MOMENTS]) for i, c in enumerate(columns)}


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, Moments]:
    """Count, mean, sample deviation, minimum and maximum of numeric columns."""
    return moments_of(fetch(df, moment_exprs(df, columns)), columns) if columns else {}


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    exact: bool = True,
    bracket: int = BRACKET_LIMIT,
    accuracy: int = SKETCH_ACCURACY,
    rows: int | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of numeric columns.

    Who knows that the table has no more than ``rows`` rows, and these are within ``bracket``, saves the sketch:
    one scan ranks all columns.

    An exact percentile has to hold every distinct value in one task.  So beyond ``bracket``
    values the wanted order statistics are searched for: a sketch proposes cut points around
    them, counts between the cuts verify where they lie, and the search goes on there until
    few enough values are left to rank exactly.  Each round is two scans of the columns and
    narrows the search by about ``accuracy / 4``; a value held by many rows is a cut itself.
    Order statistics are interpolated here alone, so the result does not depend on ``bracket``.
    """
    wanted = f"array({lits(float(p) for p in probs)})"
    out: dict[str, list[float | None]] = {}
    for at in range(0, len(columns), _COLUMNS_PER_JOB):
        part = list(columns[at : at + _COLUMNS_PER_JOB])
        if not exact:
            out |= _called(df, part, f"percentile_approx({{x}}, {wanted}, {accuracy})", len(probs))
        elif rows is not None and rows <= bracket:
            out |= _at_once(df, part, probs)
        else:
            out |= _exact(df, part, probs, bracket, accuracy)
    return out


def _called(df: DataFrame, columns: Sequence[str], call: str, width: int) -> dict[str, list[float | None]]:
    row = fetch(df, {f"q{i}": call.format(x=number(df, c)) for i, c in enumerate(columns)})
    return {c: list(row[f"q{i}"] or [None] * width) for i, c in enumerate(columns)}


@dataclass(frozen=True)
class _Bracket:
    """Open interval of a column holding the wanted zero-based ranks.

    ``below`` values of the column lie before it and ``inside`` values in it.
    """

    column: str
    ranks: tuple[int, ...]
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None

    def test(self, x: str) -> str:
        limits = [f"{x} > {lit(self.low)}"] if self.low is not None else []
        limits += [f"{x} < {lit(self.high)}"] if self.high is not None else []
        return " AND ".join(limits)

    def values(self, x: str) -> str:
        """The column's value where it lies in the interval, null elsewhere."""
        return f"CASE WHEN {self.test(x)} THEN {x} END" if self.test(x) else x

    def pieces(self, cuts: Sequence[float]) -> list[tuple[float | None, float | None]]:
        """Intervals and cut points in order: before the first cut, the cut, up to the next, ..."""
        ends = [self.low, *cuts, self.high]
        gaps = list(zip(ends, ends[1:]))
        return [p for gap, cut in zip(gaps, cuts) for p in (gap, (cut, cut))] + [gaps[-1]]


def _around(shares: Sequence[float], accuracy: int) -> list[float]:
    """Shares just before and just after the given ones; neighbours share theirs."""
    margin = 2.0 / accuracy
    cuts: list[float] = []
    for at in sorted(shares):
        if cuts and at - margin <= cuts[-1]:
            cuts[-1] = min(1.0, at + margin)
        else:
            cuts += [max(0.0, at - margin), min(1.0, at + margin)]
    return cuts


def _within(df: DataFrame, brackets: Sequence[_Bracket], x: Mapping[str, str]) -> DataFrame:
    """Only rows some bracket looks at; the limits are literals, so scans can skip data."""
    if any(b.low is None and b.high is None for b in brackets):
        return df
    return df.filter(any_of([b.test(x[b.column]) for b in brackets]))


def _piece_test(x: str, piece: tuple[float | None, float | None]) -> str:
    low, high = piece
    if low is not None and low == high:
        return f"{x} = {lit(low)}"
    tests = [f"{x} > {lit(low)}"] if low is not None else []
    tests += [f"{x} < {lit(high)}"] if high is not None else []
    return " AND ".join(tests)


def _exact(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], limit: int, accuracy: int
) -> dict[str, list[float | None]]:
    x = {c: number(df, c) for c in columns}
    # The first sketch of the whole columns shares a scan with their counts.
    shares = f"array({lits(_around(probs, accuracy))})"
    asked = {f"n{i}": f"count({x[c]})" for i, c in enumerate(columns)}
    asked |= {f"s{i}": f"percentile_approx({x[c]}, {shares}, {accuracy})" for i, c in enumerate(columns)}
    row = fetch(df, asked)
    wanted = {c: [p * (row[f"n{i}"] - 1) for p in probs] for i, c in enumerate(columns) if row[f"n{i}"]}
    brackets, cuts = [], {}
    for i, c in enumerate(columns):
        if c in wanted:
            ranks = tuple(sorted({f(at) for at in wanted[c] for f in (floor, ceil)}))
            brackets.append(_Bracket(c, ranks, row[f"n{i}"]))
            cuts[brackets[-1]] = row[f"s{i}"]
    value: dict[tuple[str, int], float] = {}

    while wide := [b for b in brackets if b.inside > limit]:
        if fresh := [b for b in wide if b not in cuts]:
            parts = [(b, [(rank - b.below) / b.inside for rank in b.ranks]) for b in fresh]
            sketch = fetch(
                _within(df, fresh, x),
                {
                    f"s{i}": f"percentile_approx({b.values(x[b.column])}, array({lits(_around(at, accuracy))}), {accuracy})"
                    for i, (b, at) in enumerate(parts)
                },
            )
            cuts |= {b: sketch[f"s{i}"] for i, b in enumerate(fresh)}
        pieces = {b: b.pieces(sorted(set(cuts[b]))) for b in wide}
        sizes = fetch(
            _within(df, wide, x),
            {
                f"n{i}_{j}": f"count_if({_piece_test(x[b.column], piece)})"
                for i, b in enumerate(wide)
                for j, piece in enumerate(pieces[b])
            },
        )
        brackets = [b for b in brackets if b.inside <= limit]
        for i, b in enumerate(wide):
            at = b.below
            for j, (low, high) in enumerate(pieces[b]):
                size = sizes[f"n{i}_{j}"]
                held = tuple(rank for rank in b.ranks if at <= rank < at + size)
                if held and low is not None and low == high:
                    value |= {(b.column, rank): low for rank in held}
                elif held:
                    brackets.append(_Bracket(b.column, held, size, at, low, high))
                at += size

    if brackets:
        picks = {}
        for i, b in enumerate(brackets):
            at = f"array({lits((rank - b.below + 0.5) / b.inside for rank in b.ranks)})"
            picks[f"v{i}"] = f"percentile_disc({at}) WITHIN GROUP (ORDER BY {b.values(x[b.column])})"
        found = fetch(_within(df, brackets, x), picks)
        for i, b in enumerate(brackets):
            value |= {(b.column, rank): v for rank, v in zip(b.ranks, found[f"v{i}"])}

    return _interpolated(columns, len(probs), wanted, value)


def _at_once(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles of columns short enough to be sorted in one task, in one scan."""
    held = fetch_from(
        aggregate(df, {f"a{i}": f"collect_list({number(df, c)})" for i, c in enumerate(columns)}).selectExpr(
            *[f"array_sort(a{i}) AS a{i}" for i in range(len(columns))]
        ),
        {f"n{i}": f"size(a{i})" for i in range(len(columns))}
        | {
            f"v{i}": f"transform(array({lits(float(p) for p in probs)}), p -> array({', '.join(f'get(a{i}, CAST({f}((size(a{i}) - 1) * p) AS INT))' for f in ('floor', 'ceil'))}))"
            for i in range(len(columns))
        },
    )
    wanted = {c: [p * (held[f"n{i}"] - 1) for p in probs] for i, c in enumerate(columns) if held[f"n{i}"]}
    value: dict[tuple[str, int], float] = {}
    for i, c in enumerate(columns):
        for at, ends in zip(wanted.get(c, ()), held[f"v{i}"]):
            value |= {(c, floor(at)): ends[0], (c, ceil(at)): ends[1]}
    return _interpolated(columns, len(probs), wanted, value)


def _interpolated(
    columns: Sequence[str], width: int, wanted: Mapping[str, list[float]], value: Mapping[tuple[str, int], float]
) -> dict[str, list[float | None]]:
    """Quantiles from the order statistics around the wanted places."""
    out: dict[str, list[float | None]] = {c: [None] * width for c in columns}
    for c, places in wanted.items():
        ends = [(value[c, floor(at)], value[c, ceil(at)], at - floor(at)) for at in places]
        # Equal ends need no arithmetic, which between infinities gives NaN.
        out[c] = [left if left == right or not part else left + (right - left) * part for left, right, part in ends]
    return out


def _countable(df: DataFrame, name: str) -> str:
    """Column in the widest type of its family; adding 0 merges negative and positive zero."""
    if is_fractional(dtype(df, name)):
        return f"{number(df, name)} + 0"
    return f"CAST({ref(name)} AS BIGINT)" if isinstance(dtype(df, name), T.IntegralType) else ref(name)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long ``(column, value, n)`` of non-null values of columns of one family (``by_type``).

    Counting combines inside each task first, so a value held by most rows is one row per
    task when it is shuffled.
    """
    cells = df.selectExpr(*[f"{_countable(df, c)} AS {ref(c)}" for c in columns])
    long = cells.unpivot([], [F.expr(ref(c)) for c in columns], "column", "value")
    return long.filter("value IS NOT NULL").groupBy("column", "value").agg(F.expr("count(1) AS n"))


def text_key(x: str) -> str:
    """A short text itself, a longer one as its first ``SHORT`` characters and a digest.

    Keys are equal where texts are, are never longer than ``SHORT`` + 32 characters, and sort like the texts up
    to those with the same first characters.
    """
    return f"if(char_length({x}) <= {SHORT}, {x}, concat(substring({x}, 1, {SHORT}), md5({x})))"


def key_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """As ``value_counts`` with texts replaced by their keys, so that no long text is shuffled."""
    same = by_type(df, columns)
    if len(same) != 1 or not is_text(dtype(df, same[0][0])):
        return value_counts(df, columns)
    return value_counts(df.selectExpr(*[f"{text_key(ref(c))} AS {ref(c)}" for c in columns]), columns)


def ranked(counts: DataFrame, k: int, keys: bool = False) -> DataFrame:
    """``(column, rank, value, n)`` of the ``k`` most frequent values per column, smaller value first on ties.

    Each task keeps its own best per column before the shuffle (WindowGroupLimit).  Where values are ``keys``,
    ties that only the rest of the texts can break are all kept, under one rank.
    """
    head = f"substring(value, 1, {SHORT}), char_length(value) > {SHORT}" if keys else "value"
    call = "rank()" if keys else "row_number()"
    rank = f"CAST({call} OVER (PARTITION BY column ORDER BY n DESC, {head}) AS INT) AS rank"
    return counts.selectExpr("column", rank, "value", "n").filter(f"rank <= {k}")


def with_texts(df: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """``ranked`` keys as the texts they stand for; ``best`` is staged.

    Only if long texts are among them is the table scanned once more, for the cells with one of their keys.
    """
    long = best.filter(f"char_length(value) > {SHORT}").selectExpr("column AS __column", "value AS __key", "n")
    size = long.count()
    if not size:
        return best
    columns = [r[0] for r in long.select("__column").distinct().collect()]
    cells = df.selectExpr(*[ref(c) for c in columns]).unpivot([], [F.expr(ref(c)) for c in columns], "column", "value")
    cells = cells.filter(f"char_length(value) > {SHORT}").selectExpr("column", f"{text_key('value')} AS key", "value")
    # Unless very many texts share their beginning and their count, these are k keys a column.
    side = F.broadcast(long) if size <= LOOKED_UP else long
    found = cells.join(side, F.expr("column = __column AND key = __key")).groupBy("column", "key").agg(F.expr("any_value(value) AS value"), F.expr("any_value(n) AS n"))
    short = best.filter(f"char_length(value) <= {SHORT}").select("column", "value", "n")
    return ranked(short.unionByName(found.drop("key")), k)


def by_type(df: DataFrame, columns: Iterable[str]) -> list[list[str]]:
    """Group countable columns by family (whole, fractional, or their type), keeping their order."""
    groups: dict[str, list[str]] = {}
    for c in columns:
        kind = dtype(df, c)
        if is_groupable(kind):
            family = "fractional" if is_fractional(kind) else "whole" if isinstance(kind, T.IntegralType) else kind.simpleString()
            groups.setdefault(family, []).append(c)
    return list(groups.values())


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent non-null value per column, the smallest one on ties."""
    found: dict[str, object] = {}
    for same in by_type(df, columns):
        if is_text(dtype(df, same[0])):
            best = with_texts(df, stage(ranked(key_counts(df, same), 1, keys=True), "modes"), 1)
            found |= {r["column"]: r["value"] for r in best.collect()}
        else:
            best = value_counts(df, same).groupBy("column").agg(F.expr("min_by(value, struct(-n, value)) AS mode"))
            found |= {r["column"]: r["mode"] for r in best.collect()}
    return found
