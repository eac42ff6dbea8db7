"""Repairs applied from a table of actions, all at once.

An action table has the row-id columns of the data plus
``(seq, action_type, column_name, new_value, reason)``.  An action whose row id is null
applies to the whole column.  Unknown action types, columns and rows change nothing.

Per cell and action type one representative acts, the others could not have had an effect:
``fix_missing`` and ``fix_outlier`` stop applying after the first usable value,
``fix_format`` and ``fix_type`` are overwritten by the last given value.  Representatives of
one cell run in ``seq`` order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.functions import text, types
from lustra.functions.columns import as_list, lit, lits, ref, refs
from lustra.functions.frames import aggregate_by, pick, with_exprs
from lustra.functions.people import (
    PEOPLE,
    CellSpec,
    Spec,
    cast_cell,
    cell_issue,
    format_cell,
    is_missing,
    normal_cell,
    out_of_range,
)
from lustra.operators import missing, stats
from lustra.operators.dedup import first_rows, later_copies
from lustra.operators.issues import detect_issues, total_issues
from lustra.operators.rows import sums_before
from lustra.session import stage

# Action names, and the issues each of them is meant to clear.
CELL_ACTIONS = ("fix_missing", "fix_format", "fix_type", "fix_outlier")
CLEARS = {
    "fix_missing": ("missing_values",),
    "fix_format": ("wrong_format", "inconsistent_values"),
    "fix_type": ("wrong_type",),
    "fix_outlier": ("outliers",),
}
# Fixed value: age proposed when no row has a readable age.
DEFAULT_AGE = 30
# Rows of one key whose places one task may count.
HOT_KEY = 1_000_000

_ACTIONS = "ARRAY<STRUCT<seq: BIGINT, action_type: STRING, new_value: STRING, whole: BOOLEAN>>"
_STEP = "STRUCT<column_name: STRING, seq: BIGINT, action_type: STRING, new_value: STRING, whole: BOOLEAN, old: STRING, new: STRING>"


def _next(x: str, spec: CellSpec) -> str:
    """Cell ``x`` after action ``a``."""
    return f"""CASE
        WHEN a.action_type = 'fix_missing' AND {is_missing(x)} THEN {cast_cell('a.new_value', spec)}
        WHEN a.action_type = 'fix_format' THEN {format_cell(f'coalesce(a.new_value, {x})', spec)}
        WHEN a.action_type = 'fix_type' THEN {cast_cell(f'coalesce(a.new_value, {x})', spec)}
        WHEN a.action_type = 'fix_outlier' AND {out_of_range(x, spec)} THEN {cast_cell('a.new_value', spec)}
        ELSE {x} END"""


def _steps(todo: str, column: str, cell: str, spec: CellSpec) -> str:
    """The actions of an array that changed the cell, each with the cell before and after it."""
    step = f"struct({lit(column)} AS column_name, a.seq, a.action_type, a.new_value, a.whole, s.x AS old, y AS new)"
    taken = f"IF(y <=> s.x, s, struct(y AS x, concat(s.done, array({step})) AS done))"
    start = f"struct(CAST({cell} AS STRING) AS x, CAST(array() AS ARRAY<{_STEP}>) AS done)"
    return f"aggregate(array_sort({todo}), {start}, (s, a) -> transform(array({_next('s.x', spec)}), y -> {taken})[0]).done"


def _representatives(actions: DataFrame, by: Sequence[str], spec: Spec) -> DataFrame:
    """At most one action per group, column and action type, and the last ``remove_duplicate``; combines inside tasks first.

    Actions of no known type or column share one row per group, without a column.
    """
    ranged = {c: s for c, s in spec.items() if s.low is not None or s.high is not None}
    outlying = " OR ".join(f"(column_name = {lit(c)} AND {out_of_range(cast_cell('new_value', s), s)})" for c, s in ranged.items())
    usable = f"NOT {is_missing('new_value')} AND NOT (action_type = 'fix_outlier' AND ({outlying or 'false'}))"
    known = f"action_type IN ({lits(CELL_ACTIONS)}) AND column_name IN ({lits(spec)})"
    prepared = actions.selectExpr(
        *[ref(c) for c in by], "CAST(seq AS BIGINT) AS seq", "new_value",
        f"IF({known}, action_type, NULL) AS action_type", f"IF({known}, column_name, NULL) AS column_name",
        "action_type IN ('fix_missing', 'fix_outlier') AS first",
        f"CASE WHEN action_type IN ('fix_missing', 'fix_outlier') THEN {usable} ELSE new_value IS NOT NULL END AS given",
        "CASE WHEN action_type = 'remove_duplicate' THEN CAST(seq AS BIGINT) END AS removal",
    )
    # Usable values first; among them the earliest, or the latest for overwriting actions.
    rank = "struct(NOT given, IF(first AND given, seq, -seq))"
    chosen = f"min_by(struct(seq, action_type, new_value, {lit(not by)} AS whole), {rank})"
    return aggregate_by(prepared, [*by, "column_name", "action_type"], {"action": chosen, "removal": "max(removal)"}).drop("action_type")


def _single(actions: DataFrame, row_id: Sequence[str]) -> DataFrame:
    return actions.filter(f"NOT ({_whole(row_id)})")


def _whole(row_id: Sequence[str]) -> str:
    return " AND ".join(f"{ref(c)} IS NULL" for c in row_id)


def _planned(df: DataFrame, actions: DataFrame, row_id: list[str], spec: Spec) -> tuple[DataFrame, dict[str, str]]:
    """Rows with their own actions, and per column the array of actions to run, null where there are none.

    ``__touched`` marks rows that an action names, ``__asked`` is the last place at which one is to be removed.
    """
    # Bounded by columns x action types, so it can be turned into literals.
    literal: dict[str, list[str]] = {c: [] for c in spec}
    for r in _representatives(actions.filter(_whole(row_id)), [], spec).filter("column_name IS NOT NULL").collect():
        literal[r["column_name"]].append(f"struct({lits(r['action'])})")

    # At most one entry per action type and column is collected for a row.
    collected = {f"__a_{c}": f"collect_list(CASE WHEN column_name = {lit(c)} THEN action END)" for c in spec}
    per_row = aggregate_by(_representatives(_single(actions, row_id), row_id, spec), row_id, collected | {"__asked": "max(removal)", "__touched": "true"})
    todo = {}
    for c in spec:
        own = f"CAST({ref(f'__a_{c}')} AS {_ACTIONS})"
        if literal[c]:
            todo[c] = f"concat(coalesce({own}, CAST(array() AS {_ACTIONS})), CAST(array({', '.join(literal[c])}) AS {_ACTIONS}))"
        else:
            todo[c] = f"CASE WHEN size({own}) > 0 THEN {own} END"
    return df.join(per_row, row_id, "left"), todo


@dataclass(frozen=True)
class Repairs:
    """An action table applied: every row as it is afterwards, with the steps that changed it.

    ``rows`` is staged and has the columns of the table, ``__steps``, ``__touched`` and ``__gone``.  The repaired
    table and the audit both read it, so the table is joined with its actions once.
    """

    rows: DataFrame
    columns: tuple[str, ...]
    actions: DataFrame
    row_id: tuple[str, ...]
    spec: Spec
    key: str

    def table(self) -> DataFrame:
        return pick(self.rows.filter("NOT __gone"), self.columns)

    def audit(self, truth: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
        """See ``repair_audit``."""
        return _audit(self, truth, self.table() if after is None else after)


def run_repairs(df: DataFrame, actions: DataFrame, row_id: str | list[str], spec: Spec = PEOPLE, key: str = "id") -> Repairs:
    """Join the table with its actions on the unique row id, once, and write the result in the shared folder.

    A row asked to be removed goes when its key occurs more than once; when every row of a key is asked for,
    the last one asked for stays.  Rows are counted only for keys that an action asks for.
    """
    row_id = as_list(row_id)
    ids = [ref(c) for c in row_id]
    joined, todo = _planned(df, actions, row_id, spec)
    done = {f"__s_{c}": f"coalesce({_steps(todo[c], c, ref(c), s)}, CAST(array() AS ARRAY<{_STEP}>))" for c, s in spec.items()}
    stepped = with_exprs(joined, done)
    last = {c: f"CASE WHEN size({ref('__s_' + c)}) > 0 THEN element_at({ref('__s_' + c)}, -1).new ELSE {ref(c)} END" for c in spec}
    cells = [f"{last.get(c, ref(c))} AS {ref(c)}" for c in df.columns]
    steps = f"concat({', '.join(ref('__s_' + c) for c in spec)}) AS __steps"
    rows = stage(stepped.selectExpr(*cells, steps, "coalesce(__touched, false) AS __touched", "__asked"), "repaired")
    asked = rows.filter("__asked IS NOT NULL")
    if asked.isEmpty():
        gone = rows.withColumn("__gone", F.lit(False))
    else:
        own = _cell_before(key) if key in spec else ref(key)
        keyed = rows.selectExpr(*ids, f"{own} AS __key", "__asked")
        named = keyed.filter("__asked IS NOT NULL").selectExpr("__key AS __named").distinct()
        of_key = keyed.join(named, F.expr("__key <=> __named"), "left_semi")
        latest = f"max(CASE WHEN __asked IS NOT NULL THEN struct(__asked, struct({refs(row_id)}) AS id) END)"
        groups = aggregate_by(of_key, ["__key"], {"__n": "count(1)", "__of": "count(__asked)", "__last": latest})
        full = groups.filter("__of = __n").selectExpr("__key AS __full", "__last.id AS __stays")
        marked = rows.join(full, F.expr(f"__asked IS NOT NULL AND {own} <=> __full"), "left")
        gone = marked.withColumn("__gone", F.expr(f"__asked IS NOT NULL AND NOT coalesce(struct({refs(row_id)}) = __stays, false)"))
    return Repairs(gone, tuple(df.columns), actions, tuple(row_id), spec, key)


def _cell_before(c: str) -> str:
    """Cell before all actions: as the first step on its column found it."""
    first = f"get(filter(__steps, d -> d.column_name = {lit(c)}), 0)"
    return f"IF({first} IS NULL, {ref(c)}, {first}.old)"


def apply_repairs(
    df: DataFrame,
    actions: DataFrame,
    row_id: str | list[str],
    spec: Spec = PEOPLE,
    key: str = "id",
) -> DataFrame:
    """The table after its actions, see ``run_repairs``."""
    return run_repairs(df, actions, row_id, spec, key).table()


def removed_rows(df: DataFrame, actions: DataFrame, row_id: str | list[str], key: str = "id") -> DataFrame:
    """Row ids that ``remove_duplicate`` actions delete.

    A row goes when its key occurs more than once; when every row of a key is asked for, the
    last one asked for stays.
    """
    row_id = as_list(row_id)
    asked = aggregate_by(actions.filter("action_type = 'remove_duplicate'"), row_id, {"__seq": "max(seq)"})
    marked = df.selectExpr(*[ref(c) for c in row_id], f"{ref(key)} AS __key").join(asked, row_id, "left")
    last = f"max(CASE WHEN __seq IS NOT NULL THEN struct(__seq, struct({refs(row_id)}) AS id) END)"
    groups = aggregate_by(marked, ["__key"], {"__rows": "count(1)", "__asked": "count(__seq)", "__last": last})
    stay = groups.filter("__asked = __rows").selectExpr("__last.id.*")
    return pick(marked.filter("__seq IS NOT NULL"), row_id).join(stay, row_id, "left_anti")


def _named_cell(prefix: str, spec: Spec, build: Callable[[str, CellSpec], str]) -> str:
    """Value computed from the column an action names."""
    cases = " ".join(f"WHEN {lit(c)} THEN {build(ref(prefix + c), s)}" for c, s in spec.items())
    return f"CASE column_name {cases} END"


def _cases(spec: Spec, build: Callable[[str, CellSpec], str]) -> str:
    """A rule of the column an action names, over ``x``."""
    return f"CASE column_name {' '.join(f'WHEN {lit(c)} THEN {build("x", s)}' for c, s in spec.items())} END"


def repair_audit(
    before: DataFrame,
    after: DataFrame,
    actions: DataFrame,
    row_id: str | list[str],
    spec: Spec = PEOPLE,
    truth: DataFrame | None = None,
    key: str = "id",
) -> DataFrame:
    """All actions, each judged on its own step: the cell just before and just after it.

    * ``valid``: it changed a cell of a row that stays, or removed its row; ``no_op`` always is.
    * ``correct``: the issue it is meant to clear is gone; for a whole column, fewer cells have
      it; for ``no_op``, no issue is left in ``after``.
    * ``destructive``: valid, not correct, and more cells stopped agreeing with the truth than
      began to.  Of truth rows with the same key the smallest counts.
    * ``rows_changed``: cells changed, or rows removed.  ``value_before`` and ``value_after``
      are null for whole columns; an action without effect shows the cell as it was.

    An action is known by row id, ``seq``, type, column and value.  Single actions join on the
    unique row id the rows they name; whole columns are counted per action, with partial aggregation.
    ``after`` is the repaired table; who has the ``Repairs`` asks them for their audit.
    """
    return run_repairs(before, actions, row_id, spec, key).audit(truth, after)


def _audit(done: Repairs, truth: DataFrame | None, after: DataFrame) -> DataFrame:
    actions, spec, key, row_id = done.actions, done.spec, done.key, list(done.row_id)
    ids = [ref(c) for c in row_id]
    cells = [f"{_cell_before(c)} AS {ref('__b_' + c)}" for c in spec]
    seen = done.rows.filter("__touched OR size(__steps) > 0").selectExpr(*ids, *cells, "__steps", "__touched", "true AS __b_", "IF(__gone, NULL, true) AS __c_")

    def with_truth(df: DataFrame) -> DataFrame:
        if truth is None:
            return df.withColumn("value_true", F.lit(None).cast("string"))
        one = f"min(struct({', '.join(f'CAST({ref(c)} AS STRING) AS {ref(c)}' for c in spec)}))"
        true = aggregate_by(truth, [key], {"__true": one}).selectExpr(f"{ref(key)} AS __key", "__true")
        joined = df.join(true, F.expr(f"{ref('__b_' + key)} = __key"), "left").drop("__key")
        return with_exprs(joined, {"value_true": f"CASE column_name {' '.join(f'WHEN {lit(c)} THEN __true.{ref(c)}' for c in spec)} END"})

    # Issue and comparable form of the cell before, after and in truth, by its column's rules.
    judge = f"struct({_cases(spec, cell_issue)} AS issue, {_cases(spec, normal_cell)} AS normal)"
    judged = {"__cells": f"transform(array(value_before, value_after, value_true), x -> {judge})"}
    known = "false" if truth is None else "true"
    lost = f"{known} AND __cells[0].normal <=> __cells[2].normal AND NOT (__cells[1].normal <=> __cells[2].normal)"
    found = f"{known} AND __cells[1].normal <=> __cells[2].normal AND NOT (__cells[0].normal <=> __cells[2].normal)"
    verdict = ["value_before", "value_after", "valid", "correct", "valid AND NOT correct AND lost > 0 AS destructive", "rows_changed"]

    def fewer(issue: str) -> str:
        return f"CAST(__cells[0].issue <=> {lit(issue)} AS INT) - CAST(__cells[1].issue <=> {lit(issue)} AS INT)"

    single = _single(actions, row_id)
    mine = "d.seq = seq AND d.action_type = action_type AND d.column_name = column_name AND d.new_value <=> new_value AND NOT d.whole"
    # The names of the lambda variable's fields are those of the action's columns.
    looked = single.join(seen.filter("__touched"), row_id, "left").withColumn("__step", F.expr(f"get(filter(__steps, d -> {mine}), 0)"))
    cell = _named_cell("__b_", spec, lambda c, s: c)
    looked = with_exprs(
        looked,
        {
            "__gone": "__b_ IS NOT NULL AND __c_ IS NULL",
            "value_before": f"IF(__step IS NULL, {cell}, __step.old)",
            "value_after": f"CASE WHEN __c_ IS NULL THEN NULL WHEN __step IS NULL THEN {cell} ELSE __step.new END",
        },
    )
    clears = " ".join(f"WHEN {lit(kind)} THEN {' OR '.join(f'{fewer(i)} > 0' for i in issues)}" for kind, issues in CLEARS.items())
    clean = _nothing_left(actions, after, spec, key)
    looked = with_exprs(with_exprs(with_truth(looked), judged), {"__changed": "__step IS NOT NULL AND __c_ IS NOT NULL"})
    of_rows = with_exprs(
        looked,
        {
            "valid": "CASE action_type WHEN 'no_op' THEN true WHEN 'remove_duplicate' THEN __gone ELSE __changed END",
            "correct": f"CASE action_type WHEN 'no_op' THEN {clean} WHEN 'remove_duplicate' THEN __gone ELSE __changed AND coalesce(CASE action_type {clears} END, false) END",
            "lost": f"CAST(__changed AND {lost} AS BIGINT)",
            "rows_changed": "CAST(__changed OR (action_type = 'remove_duplicate' AND __gone) AS BIGINT)",
        },
    )

    changes = seen.filter("__c_").selectExpr(ref("__b_" + key), "inline(filter(__steps, d -> d.whole))")
    changes = with_exprs(with_truth(changes.withColumnsRenamed({"old": "value_before", "new": "value_after"})), judged)
    every = sorted({i for issues in CLEARS.values() for i in issues})
    counts = {"rows_changed": "count(1)", "lost": f"sum(CAST({lost} AS INT) - CAST({found} AS INT))"} | {f"__{i}": f"sum({fewer(i)})" for i in every}
    counted = aggregate_by(changes, ["seq", "action_type", "column_name", "new_value"], counts)
    counted = counted.withColumnsRenamed({"seq": "__seq", "action_type": "__type", "column_name": "__column", "new_value": "__value"})
    same = "seq = __seq AND action_type = __type AND column_name = __column AND new_value <=> __value"
    # At most one row per column and action type.
    columns = actions.filter(_whole(row_id)).join(F.broadcast(counted), F.expr(same), "left")
    cleared = " ".join(f"WHEN {lit(kind)} THEN {' OR '.join(f'__{i} > 0' for i in issues)}" for kind, issues in CLEARS.items())
    of_columns = with_exprs(
        columns,
        {
            "valid": "action_type <=> 'no_op' OR __seq IS NOT NULL",
            "correct": f"CASE action_type WHEN 'no_op' THEN {clean} ELSE coalesce(CASE action_type {cleared} END, false) END",
            "value_before": "CAST(NULL AS STRING)",
            "value_after": "CAST(NULL AS STRING)",
            "lost": "coalesce(lost, 0L)",
            "rows_changed": "coalesce(rows_changed, 0L)",
        },
    )
    given = [ref(c) for c in actions.columns]
    return of_rows.selectExpr(*given, *verdict).unionByName(of_columns.selectExpr(*given, *verdict))


def _nothing_left(actions: DataFrame, after: DataFrame, spec: Spec, key: str) -> str:
    """Whether no issue is left, as a literal; counted only if an action asks for it."""
    if actions.filter("action_type = 'no_op'").isEmpty():
        return "false"
    return lit(total_issues(detect_issues(after, key, spec)).first()["total_issues"] == 0)


def median_of_readable(df: DataFrame, column: str, spec: CellSpec) -> float | None:
    """Exact median of the cells that are readable and of the right shape."""
    shape = types.INTEGER_PATTERN if spec.kind == "integer" else types.NUMBER_PATTERN
    value = f"CASE WHEN {types.matches(ref(column), shape)} THEN try_cast({ref(column)} AS DOUBLE) END AS v"
    return stats.quantiles(df.selectExpr(value), ["v"], [0.5])["v"][0]


def propose_repairs(df: DataFrame, row_id: str | list[str], spec: Spec = PEOPLE) -> DataFrame:
    """Rule-based action table: later exact copies, missing ages, missing e-mails, slash dates.

    Copies are removed first, so the other rules look at the remaining rows only.  The first
    rows are staged: finding them is the one shuffle of whole rows.
    """
    row_id = as_list(row_id)
    firsts = stage(first_rows(df, row_id, list(spec), carry=["age"]), "firsts")
    median = median_of_readable(firsts, "age", spec["age"])
    age = DEFAULT_AGE if median is None else int(median)
    iso = text.parse_date("hire_date", "%Y/%m/%d")

    def action(seq: int, kind: str, column: str, value: str, reason: str, when: str) -> str:
        fields = f"{seq}L AS seq, {lit(kind)} AS action_type, {lit(column)} AS column_name"
        return f"CASE WHEN {when} THEN struct({fields}, CAST({value} AS STRING) AS new_value, {lit(reason)} AS reason) END"

    first = "__first IS NOT NULL"
    found = (
        action(1, "remove_duplicate", "id", "NULL", "exact copy of an earlier row", f"NOT ({first})"),
        action(2, "fix_missing", "age", lit(str(age)), "median age", f"{first} AND {is_missing('age')}"),
        action(
            3, "fix_missing", "email", text.derive_email("coalesce(name, 'None')"), "derived from the name",
            f"{first} AND {is_missing('email')}",
        ),
        action(4, "fix_format", "hire_date", iso, "ISO date", f"{first} AND {iso} IS NOT NULL"),
    )
    ids = [ref(c) for c in row_id]
    marked = df.join(firsts.selectExpr(*ids, "true AS __first"), row_id, "left")
    long = marked.selectExpr(*ids, f"explode(array({', '.join(found)})) AS __a")
    return long.filter("__a IS NOT NULL").selectExpr(*ids, "__a.*")


def auto_clean(df: DataFrame, row_id: str | list[str], spec: Spec = PEOPLE) -> DataFrame:
    """Whole-table cleaning: missing, duplicates, format, type, outliers, in this order.

    Missing or unreadable numbers and outliers take the median of the readable cells inside
    the accepted range, missing e-mails are derived, other missing cells take the mode.  The table is
    staged, so its own plan runs once and the fits read their columns only.
    """
    row_id = as_list(row_id)
    df = stage(df, "dirty")
    measured = [c for c, s in spec.items() if s.kind in ("integer", "money")]
    numbers = {}
    for c in measured:
        shape = types.INTEGER_PATTERN if spec[c].kind == "integer" else types.NUMBER_PATTERN
        good = f"{types.matches(ref(c), shape)} AND NOT {out_of_range(ref(c), spec[c])}"
        numbers[c] = f"CASE WHEN {good} THEN try_cast({ref(c)} AS DOUBLE) END"
    middles = stats.quantiles(with_exprs(pick(df, measured), numbers), measured, [0.5])
    medians = {c: _number_text(q[0], spec[c]) for c, q in middles.items() if q[0] is not None}
    others = [c for c, s in spec.items() if s.kind not in ("key", "email", "integer", "money")]
    present = with_exprs(pick(df, others), {c: f"nullif({ref(c)}, '')" for c in others})
    values = medians | missing.fit_fill(present, {c: "mode" for c in others})

    filled = {c: lit(v) for c, v in values.items()}
    filled |= {c: text.derive_email("name") for c, s in spec.items() if s.kind == "email"}
    out = with_exprs(df, {c: f"CASE WHEN {is_missing(ref(c))} THEN {v} ELSE {ref(c)} END" for c, v in filled.items()})

    normal = out.selectExpr(*[ref(c) for c in row_id], *[f"{normal_cell(ref(c), s)} AS {ref(c)}" for c, s in spec.items()])
    out = out.join(later_copies(normal, row_id, list(spec)), row_id, "left_anti")

    out = with_exprs(out, {c: format_cell(ref(c), s) for c, s in spec.items()})
    out = with_exprs(out, {c: cast_cell(ref(c), s) for c, s in spec.items() if s.kind != "label"})
    repaired = {}
    for c, middle in medians.items():
        bad = out_of_range(ref(c), spec[c])
        if spec[c].kind == "integer":
            bad += f" OR NOT {types.matches(ref(c), types.INTEGER_PATTERN)}"
        repaired[c] = f"CASE WHEN {bad} THEN {lit(middle)} ELSE {ref(c)} END"
    return with_exprs(out, repaired)


def _number_text(value: float, spec: CellSpec) -> str:
    return str(int(value)) if spec.kind == "integer" else f"{value:.2f}".rstrip("0").rstrip(".")


def table_diff(
    before: DataFrame, after: DataFrame, key: str | list[str], columns: Sequence[str] | None = None, hot: int = HOT_KEY
) -> DataFrame:
    """Changed cells side by side: ``(key, column, change, before, after)``.

    Rows on one side only give one line per non-null cell, as ``added`` or ``removed``.  Rows
    that repeat a key are compared in order of their cells as text, the first with the first;
    the others of the longer side are on one side only.  Null keys equal each other.

    Keys whose rows are the same on both sides go first, by counts and 128 bits of digests, so that whole rows are
    only shuffled for the others.  There equal rows are counted, and a group of them is a range of places
    among the rows of its key; where the ranges of both sides overlap nothing has changed.  If a key holds more than ``hot``
    rows, places come from a range sort, which splits it.
    """
    key = as_list(key)
    ids = [ref(c) for c in key]
    columns = [c for c in before.columns if c in after.columns and c not in key] if columns is None else list(columns)
    packed = f"struct({', '.join(f'CAST({ref(c)} AS STRING) AS {ref(c)}' for c in columns)}) AS __cells"
    sides = before.selectExpr(*ids, packed, "true AS __old").unionAll(after.selectExpr(*ids, packed, "false AS __old"))
    signed = "sum(if(__old, 1, -1) * CAST({} AS DECIMAL(20, 0)))"
    marks = {"__b": "count_if(__old)", "__a": "count_if(NOT __old)", "__x": signed.format("xxhash64(__cells)"), "__y": signed.format("xxhash64(7, __cells)")}
    differing = aggregate_by(sides, key, marks).filter("__b <> __a OR __x <> 0 OR __y <> 0")
    differing = stage(differing.selectExpr(*[f"{ref(c)} AS {ref('__k_' + c)}" for c in key], "__b + __a AS __rows"), "differing")
    same = F.expr(" AND ".join(f"{ref(c)} <=> {ref('__k_' + c)}" for c in key))
    counted = aggregate_by(sides.join(differing, same, "left_semi"), [*key, "__cells"], {"__b": "count_if(__old)", "__a": "count_if(NOT __old)"})
    if differing.filter(f"__rows > {hot}").isEmpty():
        places = "coalesce(sum({}) OVER (PARTITION BY {} ORDER BY __cells ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        counted = counted.selectExpr("*", *[f"{places.format(n, ', '.join(ids))} AS {n}0" for n in ("__b", "__a")])
    else:
        counted = sums_before(counted, [*ids, "__cells"], {"__b0": "__b", "__a0": "__a"})
        firsts = aggregate_by(counted, key, {"__bf": "min(__b0)", "__af": "min(__a0)"})
        firsts = firsts.selectExpr(*[f"{ref(c)} AS {ref('__k_' + c)}" for c in key], "__bf", "__af")
        counted = counted.join(firsts, same).withColumns({"__b0": F.expr("__b0 - __bf"), "__a0": F.expr("__a0 - __af")})
    low, high = "greatest(__b0, __a0)", "least(__b0 + __b, __a0 + __a)"

    def around(first: str, n: str, old: str) -> str:
        """The places of a side outside the overlap, as up to two ranges."""
        end = f"{first} + {n}"
        overlap = f"{high} > {low}"
        ranges = f"struct({first} AS lo, IF({overlap}, {low}, {end}) AS hi, {old} AS old), struct(IF({overlap}, {high}, {end}) AS lo, {end} AS hi, {old} AS old)"
        return f"filter(array({ranges}), r -> r.hi > r.lo)"

    ranges = counted.selectExpr(*ids, "__cells", f"inline(concat({around('__b0', '__b', 'true')}, {around('__a0', '__a', 'false')}))")
    # A row that occurs very often becomes places a thousand at a time.
    ranges = ranges.selectExpr(*ids, "__cells", "lo", "hi", "old", "explode(sequence(0L, (hi - lo - 1) DIV 1000)) AS __chunk")
    places = ranges.selectExpr(*ids, "__cells", "old", "explode(sequence(lo + 1000 * __chunk, least(hi, lo + 1000 * __chunk + 1000) - 1)) AS __place")
    side = "max(IF({}, __cells, NULL))"
    joined = aggregate_by(places, [*key, "__place"], {"__b": side.format("old"), "__a": side.format("NOT old")})
    change = "CASE WHEN __b IS NULL THEN 'added' WHEN __a IS NULL THEN 'removed' ELSE 'changed' END AS change"
    cells = ", ".join(
        f"struct({lit(c)} AS column, __b.{ref(c)} AS before, __a.{ref(c)} AS after)" for c in columns
    )
    long = joined.selectExpr(*ids, change, f"inline(array({cells}))").filter("NOT (before <=> after)")
    return long.selectExpr(*ids, "column", "change", "before", "after")
