"""Scoring against a known-good table and over logs of actions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.functions.columns import as_list, lit, ref
from lustra.functions.frames import aggregate, aggregate_by, pick, with_exprs
from lustra.functions.people import ISSUES, PEOPLE, Spec
from lustra.operators.dedup import remove_duplicates
from lustra.operators.rows import sums_before
from lustra.operators.textual import normalized_row
from lustra.session import stage

# Reward per correct action and the other terms of an action's reward.
REWARDS = {"fix_missing": 0.15, "remove_duplicate": 0.12, "fix_format": 0.18, "fix_type": 0.15, "fix_outlier": 0.20}
OTHER_REWARD = 0.10
EXTRA_PER_ISSUE, EXTRA_LIMIT = 0.05, 3
WRONG, IDLE, INVALID, STEP = -0.08, -0.05, -0.12, -0.01
REWARD_RANGE = (-0.3, 0.5)
COMPLETION_BONUS, COMPLETION_LIMIT = 0.30, 0.8
SORT_KEY = ("id", "name", "email")
STRIDE = 1 << 16  # positions that one task compares


def _ratio(counted: DataFrame, width: int) -> DataFrame:
    """Score of one row with ``hits`` and the row counts ``l`` and ``r`` of both sides."""
    cells = f"greatest(greatest(coalesce(l, 0), coalesce(r, 0)) * {max(width, 1)}, 1)"
    scored = counted.selectExpr("coalesce(hits, 0) AS matches", f"{cells} AS cells")
    return scored.selectExpr("matches", "cells", "matches / cells AS ratio")


def _compared(left: DataFrame, right: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Equal cells and row counts of two tables joined on unique keys."""

    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.selectExpr(*[ref(k) for k in keys], *[f"{ref(c)} AS {ref(mark + c)}" for c in columns], f"1 AS {mark}")

    hits = " + ".join(f"CAST({ref('__l_' + c)} <=> {ref('__r_' + c)} AS BIGINT)" for c in columns)
    joined = side(left, "__l_").join(side(right, "__r_"), list(keys), "full")
    return aggregate(joined, {"hits": f"sum({hits})", "l": "sum(__l_)", "r": "sum(__r_)"})


def cell_match_ratio(
    df: DataFrame,
    truth: DataFrame,
    columns: Sequence[str] | None = None,
    sort_key: Sequence[str] = SORT_KEY,
    row_id: Sequence[str] = (),
) -> DataFrame:
    """One row ``(matches, cells, ratio)`` comparing both tables by sorted position.

    Rows equal in the sort key are ordered by their other columns.  A cell absent on one side equals null.

    Equal rows are counted first, so a row that occurs very often is one row here: a range of positions on each side.
    Ranges are cut at every ``STRIDE`` positions, and where the range of one side meets that of the other their cells are
    compared once for all positions they share.  ``row_id`` is not needed any more and ignored.
    """
    columns = list(truth.columns) if columns is None else list(columns)
    order = [f"coalesce(CAST({ref(c)} AS STRING), 'None')" for c in sort_key if c in columns] + [ref(c) for c in columns]
    both = pick(df, columns).withColumn("__l", F.lit(True)).unionAll(pick(truth, columns).withColumn("__l", F.lit(False)))
    counted = aggregate_by(both, columns, {"__ln": "count_if(__l)", "__rn": "count_if(NOT __l)"})
    placed = stage(sums_before(counted, order, {"__l0": "__ln", "__r0": "__rn"}), "placed")
    rows = aggregate(placed, {"l": "coalesce(sum(__ln), 0)", "r": "coalesce(sum(__rn), 0)"}).first()
    end = max(rows["l"], rows["r"])
    cells = f"struct({', '.join(ref(c) for c in columns)}) AS cells"

    def runs(side: str) -> DataFrame:
        blocks = f"explode(sequence(__{side}0 DIV {STRIDE}, (__{side}0 + __{side}n - 1) DIV {STRIDE})) AS block"
        cut = placed.filter(f"__{side}n > 0").selectExpr(f"__{side}0 AS first", cells, blocks)
        return cut.selectExpr("block", f"greatest(first, block * {STRIDE}L) AS at", f"'{side}' AS side", "cells")

    parts = [runs("l"), runs("r")]
    if rows["l"] != rows["r"]:
        # Behind its end the shorter side has absent cells only.
        side, least = ("l", rows["l"]) if rows["l"] < rows["r"] else ("r", rows["r"])
        absent = f"CAST(NULL AS {parts[0].schema['cells'].dataType.simpleString()})"
        blocks = df.sparkSession.range(least // STRIDE, (end - 1) // STRIDE + 1)
        parts.append(blocks.selectExpr("id AS block", f"greatest({least}L, id * {STRIDE}L) AS at", f"'{side}' AS side", f"{absent} AS cells"))
    events = reduce(DataFrame.unionAll, parts)
    # Null cells still tell that there is a run, hence the struct around them.
    latest = "max_by(IF(side = '{0}', struct(cells), NULL), IF(side = '{0}', at, NULL)) OVER (PARTITION BY block ORDER BY at) AS {0}"
    until = f"coalesce(lead(at) OVER (PARTITION BY block ORDER BY at), least({end}L, (block + 1) * {STRIDE}L)) AS until"
    met = events.selectExpr("at", latest.format("l"), latest.format("r"), until).filter("until > at")
    hits = " + ".join(f"CAST(l.cells.{ref(c)} <=> r.cells.{ref(c)} AS BIGINT)" for c in columns)
    found = aggregate(met, {"hits": f"sum((until - at) * ({hits}))", "l": f"{rows['l']}L", "r": f"{rows['r']}L"})
    return _ratio(found, len(columns))


def cell_match_by_key(
    df: DataFrame, truth: DataFrame, key: str | list[str], order_by: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """As ``cell_match_ratio`` but comparing rows of the same key: the first row of a key by
    ``order_by`` is compared, its further copies count as rows without a match."""
    key = as_list(key)
    columns = list(truth.columns) if columns is None else list(columns)

    def keyed(side: DataFrame) -> DataFrame:
        return side.selectExpr(*[f"{ref(k)} AS {ref('__k_' + k)}" for k in key], *[ref(c) for c in columns])

    firsts = remove_duplicates(df, key, "first", order_by)
    found = _compared(keyed(firsts), keyed(truth), columns, [f"__k_{k}" for k in key])
    # Two one-row aggregates.
    return _ratio(found.drop("l").crossJoin(F.broadcast(aggregate(df, {"l": "count(1)"}))), len(columns))


def dataset_match_score(
    df: DataFrame, truth: DataFrame, spec: Spec = PEOPLE, row_id: Sequence[str] = ()
) -> DataFrame:
    """Positional match of the normalised tables over the specified columns."""
    return cell_match_ratio(normalized_row(df, spec), normalized_row(truth, spec), list(spec), row_id=row_id)


def issues_fixed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counters ``original_<issue>`` and ``fixed_<issue>``; a rise is not a negative fix."""
    left = before.selectExpr(*[f"{i} AS original_{i}" for i in ISSUES])
    right = after.selectExpr(*[f"{i} AS __{i}" for i in ISSUES])
    fixed = [f"greatest(original_{i} - __{i}, 0) AS fixed_{i}" for i in ISSUES]
    # Both sides are one aggregate row.
    return left.crossJoin(F.broadcast(right)).selectExpr(*[f"original_{i}" for i in ISSUES], *fixed)


def _part(issue: str) -> str:
    return f"CASE WHEN original_{issue} > 0 THEN fixed_{issue} / original_{issue} ELSE 0D END"


def _saved_steps(steps: str, max_steps: str) -> str:
    return f"greatest(0D, 0.1D * (1 - {steps} / {max_steps}))"


def _clamp(x: str) -> str:
    return f"greatest(0D, least(1D, {x}))"


def grade_easy(steps: str, max_steps: str) -> str:
    """Grade over a table of ``original_*`` / ``fixed_*`` counters, as an expression."""
    earned = f"0.5D * {_part('missing_values')} + 0.5D * {_part('duplicates')}"
    return f"least(1D, {earned} + {_saved_steps(steps, max_steps)})"


def grade_medium() -> str:
    """The step penalty of this level never lowers the grade, so steps do not enter."""
    weights = {"missing_values": 0.25, "duplicates": 0.20, "wrong_format": 0.30, "wrong_type": 0.25}
    return _clamp(" + ".join(f"{w}D * {_part(issue)}" for issue, w in weights.items()))


def grade_hard(match: str, steps: str, max_steps: str, destructive: str) -> str:
    original = " + ".join(f"original_{i}" for i in ISSUES)
    fixed = " + ".join(f"fixed_{i}" for i in ISSUES)
    share = f"CASE WHEN {original} > 0 THEN ({fixed}) / ({original}) ELSE 0D END"
    return _clamp(f"0.7D * {match} + 0.2D * {share} + {_saved_steps(steps, max_steps)} - 0.05D * {destructive}")


def grades(
    before: DataFrame, after: DataFrame, match: DataFrame, steps: int, max_steps: int, destructive: int = 0
) -> DataFrame:
    """One row with the three grades from two issue counts and one match score."""
    table = issues_fixed(before, after).selectExpr("*", f"{steps} AS steps", f"{destructive} AS destructive")
    return _graded(table, match, max_steps)


def audited_grades(before: DataFrame, after: DataFrame, match: DataFrame, audit: DataFrame, max_steps: int) -> DataFrame:
    """As ``grades``, with the steps and the destructive actions counted in the audit of the repairs."""
    taken = aggregate(audit, {"steps": "count(1)", "destructive": "coalesce(sum(CAST(destructive AS BIGINT)), 0)"})
    # One aggregate row each.
    return _graded(issues_fixed(before, after).crossJoin(F.broadcast(taken)), match, max_steps)


def _graded(table: DataFrame, match: DataFrame, max_steps: int) -> DataFrame:
    most = str(max_steps)
    # One aggregate row each.
    return table.crossJoin(F.broadcast(match.select("ratio"))).selectExpr(
        f"{grade_easy('steps', most)} AS easy",
        f"{grade_medium()} AS medium",
        f"{grade_hard('ratio', 'steps', most, 'destructive')} AS hard",
    )


def action_reward() -> str:
    """Reward of one logged action, rounded to four places and clamped, as an expression
    over ``(action_type, valid, correct, issues_before, issues_after)``."""
    by_type = " ".join(f"WHEN {lit(kind)} THEN {reward}D" for kind, reward in REWARDS.items())
    drop = "(issues_before - issues_after)"
    earned = f"CASE action_type {by_type} ELSE {OTHER_REWARD}D END + IF({drop} > 1, {EXTRA_PER_ISSUE}D * least({drop}, {EXTRA_LIMIT}), 0D)"
    outcome = f"CASE WHEN correct THEN {earned} WHEN action_type <> 'no_op' THEN {WRONG}D ELSE 0D END"
    reward = f"{outcome} + IF(action_type = 'no_op', {IDLE}D, 0D) + IF(NOT valid, {INVALID}D, 0D) + {STEP}D"
    low, high = REWARD_RANGE
    return f"greatest({low}D, least({high}D, round({reward}, 4)))"


def score_actions(log: DataFrame) -> DataFrame:
    """Add ``reward`` and ``completed`` to a log of actions, one row per action.

    The action that clears the last issue earns a bonus.
    """
    base = action_reward()
    bonus = f"round(least({COMPLETION_LIMIT}D, {base} + {COMPLETION_BONUS}D), 4)"
    return with_exprs(log, {"reward": f"IF(issues_after = 0, {bonus}, {base})", "completed": "issues_after = 0"})


def run_summary(scored: DataFrame, run: str | list[str] = "run_id", step: str = "step", level: str | None = None) -> DataFrame:
    """Per run: steps, mean and total reward, last score, whether it was completed.

    With ``level``, a column that groups runs by difficulty, the same rows per run and level come with one per level
    and one of all runs, in one aggregation.  ``grouped`` says which (``run``, ``level``, ``all``), ``runs`` counts
    the runs, and a level's final score and completion are the means of its runs'.
    """
    run = as_list(run)
    per_run = {
        "steps": "count(1)",
        "total_reward": "sum(reward)",
        "final_score": f"max_by(score, {ref(step)})",
        "completed": "bool_or(completed)",
    }
    if level is None:
        found = aggregate_by(scored, run, per_run | {"mean_reward": "round(avg(reward), 4)"})
        return found.withColumn("total_reward", F.round("total_reward", 4)).select(*run, "steps", "mean_reward", "total_reward", "final_score", "completed")
    runs = aggregate_by(scored, [*run, level], per_run)
    keys = [F.expr(ref(c)) for c in (*run, level)]
    grouped = runs.groupingSets([keys, [keys[-1]], []], *keys).agg(
        F.expr(f"CASE WHEN grouping({ref(run[0])}) = 0 THEN 'run' WHEN grouping({ref(level)}) = 0 THEN 'level' ELSE 'all' END AS grouped"),
        F.expr("count(1) AS runs"), F.expr("sum(steps) AS steps"), F.expr("round(sum(total_reward) / sum(steps), 4) AS mean_reward"),
        F.expr("round(sum(total_reward), 4) AS total_reward"), F.expr("round(avg(final_score), 4) AS final_score"),
        F.expr("round(avg(CAST(completed AS INT)), 4) AS completed_share"),
    )
    return grouped
