"""The registered queries in plain SQL over the same tables, written independently.

Streams and file round trips are stated as the batch query they must equal.
"""

from __future__ import annotations

from lustra.workload.tables import BASE, DATA, DIRTY, TRUTH

# ---------------------------------------------------------------- shared pieces

CELLS = ", ".join(DATA)
# Texts read as missing.
TOKENS = (
    "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', "
    "'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
)
_DIRTY_CELLS = ", ".join(DIRTY[1:])

PEOPLE = f"""base AS (SELECT {', '.join(BASE)} FROM customer),
truth AS (SELECT {', '.join(TRUTH)} FROM base),
m AS (SELECT k, {_DIRTY_CELLS} FROM base),
people AS (
  SELECT k, 0 AS copy_no, {CELLS} FROM m
  UNION ALL SELECT k, 1, {CELLS} FROM m WHERE k % 20 = 0
  UNION ALL SELECT k, 2, {CELLS.replace('name', "name || ' Jr' AS name")} FROM m WHERE k % 50 = 25),
pn AS (SELECT k, copy_no, {', '.join(f'CASE WHEN {c} NOT IN {TOKENS} THEN {c} END AS {c}' for c in DATA)} FROM people),
typed AS (SELECT k, copy_no, id, name, TRY_CAST(age AS DOUBLE) AS age, email, phone,
  TRY_CAST(salary AS DOUBLE) AS salary, hire_date, department, is_active FROM people)"""


def with_people(sql: str, *ctes: str) -> str:
    return f"WITH {', '.join((PEOPLE, *ctes))}\n{sql}"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def title(x: str) -> str:
    runs = f"regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+')"
    return f"array_to_string(list_transform({runs}, lambda t: upper(t[1]) || lower(t[2:])), '')"


def label(x: str) -> str:
    # The departments and their other names.
    return f"""CASE lower({strip(x)}) WHEN 'engineering' THEN 'Engineering' WHEN 'eng' THEN 'Engineering'
      WHEN 'finance' THEN 'Finance' WHEN 'sales' THEN 'Sales' WHEN 'hr' THEN 'HR' WHEN 'operations' THEN 'Operations'
      WHEN 'ops' THEN 'Operations' WHEN 'marketing' THEN 'Marketing' ELSE {title(strip(x))} END"""


def date(x: str) -> str:
    # The layouts of dates.
    return f"coalesce(strftime(try_strptime({x}, ['%Y-%m-%d', '%Y/%m/%d', '%d-%m-%Y', '%m/%d/%Y']), '%Y-%m-%d'), {x})"


def phone(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return f"CASE WHEN length({d}) = 10 THEN {d}[1:3] || '-' || {d}[4:6] || '-' || {d}[7:10] ELSE {x} END"


def whole(x: str) -> str:
    return f"coalesce(CAST(CAST(trunc(TRY_CAST({x} AS DOUBLE)) AS BIGINT) AS VARCHAR), {x})"


def money(x: str) -> str:
    fixed = f"CAST(CAST(round(TRY_CAST({x} AS DOUBLE), 2) AS DECIMAL(18, 2)) AS VARCHAR)"
    return f"coalesce(regexp_replace({fixed}, '\\.?0+$', ''), {x})"


def flag(x: str) -> str:
    return f"""CASE WHEN lower(trim({x})) IN ('true', '1', 'yes') THEN 'true'
      WHEN lower(trim({x})) IN ('false', '0', 'no') THEN 'false' ELSE {x} END"""


def derived(name: str) -> str:
    words = f"string_split_regex(lower({strip(f"replace({name}, chr(39), '')")}), '\\s+')"
    return f"{words}[1] || CASE WHEN len({words}) > 1 THEN '.' || {words}[-1] ELSE '' END || '@example.com'"


# Cell rules: column -> (issue test, issue) in order, after the test for missing cells.
# The patterns, the accepted ranges and the names of issues.
RULES = {
    "hire_date": [("NOT regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')", "wrong_format")],
    "phone": [("NOT regexp_full_match({x}, '[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}')", "wrong_format")],
    "age": [
        ("NOT regexp_full_match({x}, '[+-]?[0-9]+')", "wrong_type"),
        ("TRY_CAST({x} AS INT) < 18 OR TRY_CAST({x} AS INT) > 80", "outliers"),
    ],
    "email": [("NOT regexp_full_match({x}, '[^@ ]+@[^@ ]+\\.[^@ ]+')", "invalid_email")],
    "salary": [("TRY_CAST({x} AS DOUBLE) <= 0 OR TRY_CAST({x} AS DOUBLE) > 300000", "outliers")],
    "department": [("{label} <> {x}", "inconsistent_values")],
    "name": [("{title} <> {x}", "inconsistent_values")],
    "is_active": [("{x} NOT IN ('true', 'false')", "inconsistent_values")],
}


def issue(c: str) -> str:
    tests = "".join(
        f" WHEN {test.format(x=c, label=label(c), title=title(c))} THEN '{found}'" for test, found in RULES.get(c, [])
    )
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN 'missing_values'{tests} END"


NORMAL = {
    "id": "id",
    "name": f"coalesce({strip('name')}, 'None')",
    "age": whole("age"),
    "email": f"lower({strip('email')})",
    "phone": phone("phone"),
    "salary": money("salary"),
    "hire_date": date("hire_date"),
    "department": label("department"),
    "is_active": flag("is_active"),
}
NORMAL_CELLS = ", ".join(f"{x} AS {c}" for c, x in NORMAL.items())
CELL_ISSUES = ("missing_values", "wrong_format", "wrong_type", "invalid_email", "outliers", "inconsistent_values")


def issue_counts(source: str) -> str:
    """Eight counters of a table of people."""
    long = " UNION ALL ".join(f"SELECT {issue(c)} AS issue FROM {source}" for c in DATA)
    cells = ", ".join(f"(SELECT count(*) FROM long WHERE issue = '{i}') AS {i}" for i in CELL_ISSUES)
    return f"""(WITH long AS ({long}), norm AS (SELECT {NORMAL_CELLS} FROM {source}),
      sig AS (SELECT *, count(*) AS n FROM norm GROUP BY ALL),
      keys AS (SELECT id, CAST(sum(n) AS BIGINT) AS rows, count(*) AS variants FROM sig GROUP BY id)
      SELECT {cells}, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM sig) AS duplicates,
        (SELECT CAST(coalesce(sum(rows - 1), 0) AS BIGINT) FROM keys WHERE variants > 1) AS near_duplicates)"""


def number_row(source: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
      round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(max(q2), 4) AS median, round(max(q1), 4) AS q1,
      round(max(q3), 4) AS q3,
      count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outlier_count_iqr
      FROM {source}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM {source})"""


def union(parts) -> str:
    return "\nUNION ALL ".join(parts)


def bins(source: str, c: str) -> str:
    """Ten counts between minimum and maximum, one row per bin."""
    return f"""SELECT '{c}' AS "column", CAST(b + 1 AS INT) AS bin, round(lo + (hi - lo) * b / 10, 4) AS low,
      round(CASE WHEN b = 9 THEN hi ELSE lo + (hi - lo) * (b + 1) / 10 END, 4) AS high,
      (SELECT count(*) FROM {source} WHERE {c} IS NOT NULL AND least(floor(10 * ({c} - lo) / (hi - lo)), 9) = b) AS n
      FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM {source}), range(10) AS r(b)"""


def top(source: str, c: str, k: int = 5) -> str:
    return f"""SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INT) AS rank,
      {c} AS value, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY rank <= {k}"""


def mode(source: str, c: str) -> str:
    return f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def replaced(source: str, **cells: str) -> str:
    """All people columns of a source with some replaced."""
    return f"SELECT k, copy_no, {', '.join(f'{cells.get(c, c)} AS {c}' for c in DATA)} FROM {source}"


ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------- profiles

ORACLE["profile_shape"] = with_people(
    f"""SELECT count(*) AS rows, 9 AS columns, CAST(sum(miss) AS BIGINT) AS total_missing,
      round(sum(miss) / (count(*) * 9) * 100, 2) AS missing_pct,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT {CELLS} FROM pn)) AS duplicate_rows
    FROM (SELECT {' + '.join(f'CAST({c} IS NULL AS INT)' for c in DATA)} AS miss FROM pn)"""
)
ORACLE["profile_nulls"] = with_people(
    union(
        f"""SELECT '{c}' AS "column", 'string' AS dtype, count(*) - count({c}) AS null_count,
          round((count(*) - count({c})) / count(*) * 100, 2) AS null_pct FROM pn"""
        for c in DATA
    )
)
ORACLE["profile_numeric"] = union(
    [number_row("lineitem", c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    + [number_row("events", "value"), number_row("orders", "o_totalprice")]
)
ORACLE["profile_unique"] = union(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count FROM {t}"""
    for t, columns in (
        ("customer", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
        ("part", ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
    )
    for c in columns
)
ORACLE["profile_histogram"] = union([bins("events", "value"), bins("lineitem", "l_extendedprice")])
ORACLE["profile_top_values"] = with_people(
    union([f"({top('pn', c)})" for c in ("name", "department", "hire_date")] + [f"({top('part', c)})" for c in ("p_brand", "p_type")])
)
ORACLE["profile_sample"] = union(
    f"""(SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY p_partkey) AS INT) AS rank, CAST({c} AS VARCHAR) AS value
      FROM part WHERE {c} IS NOT NULL QUALIFY rank <= 5)"""
    for c in ("p_partkey", "p_name", "p_brand", "p_size")
)

NUMBER = "'\\s*[+-]?([0-9]+\\.?[0-9]*([eE][+-]?[0-9]+)?|\\.[0-9]+([eE][+-]?[0-9]+)?)\\s*'"


def _profile_row(at: int, c: str) -> str:
    numeric = c in ("age", "salary")
    base = f"""SELECT CAST({at + 2} AS INT) AS position, '{c}' AS "column", '{'double' if numeric else 'string'}' AS dtype,
      count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*) * 100, 2) AS null_pct,
      count(DISTINCT {c}) AS unique_count,
      (SELECT string_agg(CAST({c} AS VARCHAR), '|' ORDER BY k, copy_no)
        FROM (SELECT {c}, k, copy_no FROM ready WHERE {c} IS NOT NULL ORDER BY k, copy_no LIMIT 5)) AS sample_values"""
    if numeric:
        return f"""{base}, s.* EXCLUDE ("column"),
          (SELECT string_agg(CAST(n AS VARCHAR), '|' ORDER BY bin) FROM ({bins('ready', c)})) AS distribution,
          NULL AS top_values, NULL AS numeric_text_pct FROM ready, ({number_row('ready', c)}) s GROUP BY ALL"""
    empty = ", ".join(f"NULL AS {n}" for n in ("mean", "std", "min", "max", "median", "q1", "q3", "outlier_count_iqr", "distribution"))
    return f"""{base}, {empty},
      (SELECT string_agg(value || ':' || n, '|' ORDER BY rank) FROM ({top('ready', c)})) AS top_values,
      round(count(*) FILTER (WHERE regexp_full_match({c}, {NUMBER})) / count({c}) * 100, 2) AS numeric_text_pct FROM ready"""


ORACLE["profile_full"] = with_people(
    union(_profile_row(i, c) for i, c in enumerate(DATA)),
    "ready AS (SELECT * REPLACE (TRY_CAST(age AS DOUBLE) AS age, TRY_CAST(salary AS DOUBLE) AS salary) FROM pn)",
)


def _summary_row(c: str, kind: str) -> str:
    if kind == "string":
        tail = f"', top_vals=[' || (SELECT string_agg(value, ', ' ORDER BY rank) FROM ({top('part', c, 3)})) || ']'"
    else:
        tail = f"""(SELECT ', mean=' || round(mean, 2) || ', std=' || round(std, 2) || ', min=' || round(min, 2) || ', max=' || round(max, 2)
          || CASE WHEN outlier_count_iqr > 0 THEN ', IQR_outliers=' || outlier_count_iqr ELSE '' END
          FROM ({number_row('(SELECT CAST(' + c + ' AS DOUBLE) AS ' + c + ' FROM part)', c)}))"""
    return f"""SELECT '{c}' AS "column", '{c} [{kind}]: null=0.0%, unique=' || (SELECT count(DISTINCT {c}) FROM part) || {tail} AS summary"""


_PART = (("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double"))
ORACLE["profile_summary"] = union(
    [
        "SELECT NULL AS \"column\", count(*) || ' rows, 6 columns' AS summary FROM part",
        f"SELECT NULL, sum({' + '.join(f'CAST({c} IS NULL AS INT)' for c, _ in _PART)}) || ' cells missing (0.0%)' FROM part",
        "SELECT NULL, (SELECT count(*) FROM part) - (SELECT count(*) FROM (SELECT DISTINCT * FROM part)) || ' duplicate rows'",
        *(_summary_row(c, kind) for c, kind in _PART),
    ]
)
ORACLE["profile_documents"] = union(
    f"""SELECT "column", rank, md5(value) AS value, n, (SELECT count(DISTINCT {c}) FROM documents) AS unique_count FROM ({top('documents', c)})"""
    for c in ("text", "lang", "source")
)
_SAMPLED = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
ORACLE["profile_sample_lineitem"] = union(
    f"""(SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY {', '.join(_SAMPLED)}) AS INT) AS rank, CAST({x} AS VARCHAR) AS value
      FROM lineitem WHERE {x} IS NOT NULL QUALIFY rank <= 5)"""
    for c, x in (*((c, c) for c in _SAMPLED), ("rare", "CASE WHEN l_orderkey % 400 = 0 THEN l_returnflag END"))
)


def _merged_row(c: str, numeric: bool) -> str:
    numbers = ("avg", "stddev_samp", "min", "max")
    shown = ", ".join(f"round({f}({c}), 4)" if numeric else "NULL::DOUBLE" for f in numbers)
    names = ("mean", "std", "min", "max")
    return f"""SELECT '{c}' AS "column", rows, null_count, {', '.join(names)}, true AS estimates_close
      FROM (SELECT count(*) AS rows, count(*) - count({c}) AS null_count, {shown} FROM lineitem) t(rows, null_count, {', '.join(names)})"""


ORACLE["profile_merged"] = union([_merged_row("l_extendedprice", True), _merged_row("l_quantity", True), _merged_row("l_linestatus", False)])
ORACLE["profile_merged_dataset"] = with_people(
    f"""SELECT count(*) AS rows, 11 AS columns, CAST(sum(miss) AS BIGINT) AS total_missing, round(sum(miss) / (count(*) * 11) * 100, 2) AS missing_pct
    FROM (SELECT {' + '.join(f'CAST({c} IS NULL AS INT)' for c in DATA)} AS miss FROM pn)"""
)


def _diff_row(c: str, numeric: bool, kept: bool) -> str:
    def side(source: str, mark: str) -> str:
        numbers = f"round(avg({c}), 6), round(stddev_samp({c}), 6), round(min({c}), 6), round(max({c}), 6)"
        outliers = f"(SELECT outlier_count_iqr FROM ({number_row(source, c)}))"
        if not numeric:
            numbers, outliers = "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE", "NULL::BIGINT"
        return f"""(SELECT '{'double' if numeric else 'string'}', count(*) - count({c}), count(DISTINCT {c}), {numbers}, {outliers}
          FROM {source}) AS {mark}(dtype_{mark}, {', '.join(f'{f}_{mark}' for f in _DIFF)})"""

    shown = ", ".join(f"{r(f, f'{f}_before')} AS {f}_before" for f in _DIFF)
    if kept:
        shown += "".join(f", {r(f, f'{f}_after')} AS {f}_after, {r(f, f'{f}_after - {f}_before')} AS {f}_change" for f in _DIFF)
        return f"""SELECT '{c}' AS "column", dtype_before, dtype_after, 'kept' AS status, {shown}
          FROM {side('first', 'before')}, {side('second', 'after')}"""
    shown += "".join(f", NULL AS {f}_after, NULL AS {f}_change" for f in _DIFF)
    return f"""SELECT '{c}' AS "column", dtype_before, NULL AS dtype_after, 'dropped' AS status, {shown} FROM {side('first', 'before')}"""


_DIFF = ("null_count", "unique_count", "mean", "std", "min", "max", "outlier_count_iqr")


_DIFF_COLUMNS = ", ".join(
    ['"column"', "dtype_before", "dtype_after", "status", *[f"{f}_{mark}" for f in _DIFF for mark in ("before", "after", "change")]]
)


def r(field: str, x: str) -> str:
    return f"round({x}, 4)" if field in ("mean", "std", "min", "max") else x


ORACLE["profile_diff"] = with_people(
    union(
        f"SELECT {_DIFF_COLUMNS} FROM ({_diff_row(c, numeric, kept)})"
        for c, numeric, kept in (("age", True, True), ("salary", True, False), ("department", False, True))
    ),
    "first AS (SELECT age, salary, department FROM typed)",
    f"second AS (SELECT coalesce(age, (SELECT quantile_cont(age, 0.5) FROM typed)) AS age, {label('department')} AS department FROM typed)",
)


def _advice_row(c: str) -> str:
    numeric = c == "salary"
    outliers = f"(SELECT outlier_count_iqr FROM ({number_row('ready', c)}))" if numeric else "0"
    text = "NULL" if numeric else f"round(count(*) FILTER (WHERE regexp_full_match({c}, {NUMBER})) / count({c}) * 100, 2)"
    return f"""SELECT '{c}' AS "column", {numeric} AS numeric, count(*) - count({c}) AS nulls,
      round((count(*) - count({c})) / count(*) * 100, 2) AS null_pct, count(DISTINCT {c}) AS uniq,
      {outliers} AS outliers, {text} AS text_pct FROM ready"""


ORACLE["suggest_rules"] = with_people(
    """SELECT "column", null_pct > 90 AS drop_column,
      CASE WHEN null_pct > 90 OR nulls = 0 THEN NULL WHEN NOT numeric THEN 'mode' WHEN outliers > 0 THEN 'median' ELSE 'mean' END AS fill_strategy,
      CASE WHEN null_pct <= 90 AND text_pct >= 90 THEN 'numeric' END AS cast_type,
      null_pct <= 90 AND NOT numeric AND NOT coalesce(text_pct >= 90, false) AS normalize_text,
      CASE WHEN outliers > 0 THEN 'cap_iqr' ELSE 'none' END AS outlier_strategy,
      null_pct <= 90 AND uniq > 1 AS informative,
      nullif(concat_ws('; ', CASE WHEN null_pct > 90 THEN 'mostly empty: ' || null_pct || '% null' END,
        CASE WHEN outliers > 0 THEN outliers || ' values outside the quartile range' END,
        CASE WHEN text_pct >= 90 AND text_pct < 100 THEN 'numbers mixed with text' END,
        CASE WHEN uniq = 1 THEN 'one value only' END), '') AS anomaly FROM stats""",
    "ready AS (SELECT *, CASE WHEN k % 20 = 0 THEN name END AS nickname FROM (SELECT * REPLACE (TRY_CAST(salary AS DOUBLE) AS salary) FROM pn))",
    f"stats AS ({union(_advice_row(c) for c in (*DATA, 'nickname'))})",
)

# ---------------------------------------------------------------- missing values

ORACLE["null_tokens"] = with_people("SELECT * FROM pn")
ORACLE["fill_mean"] = with_people(
    """SELECT k, copy_no, round(coalesce(age, (SELECT avg(age) FROM typed)), 4) AS age,
      round(coalesce(salary, (SELECT avg(salary) FROM typed)), 4) AS salary, name FROM typed"""
)
ORACLE["fill_median"] = with_people(
    """SELECT k, copy_no, round(coalesce(age, (SELECT quantile_cont(age, 0.5) FROM typed)), 4) AS age,
      round(coalesce(salary, (SELECT quantile_cont(salary, 0.5) FROM typed)), 4) AS salary FROM typed"""
)
ORACLE["fill_median_lineitem"] = """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey,
    CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS price FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey,
    round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM t)), 4) AS price FROM t"""
ORACLE["fill_mode"] = with_people(
    f"SELECT k, copy_no, {', '.join(f'coalesce({c}, {mode("pn", c)}) AS {c}' for c in ('age', 'email', 'phone', 'salary'))} FROM pn"
)
ORACLE["fill_constant"] = with_people(
    """SELECT k, copy_no, coalesce(email, 'unknown') AS email,
      CASE WHEN salary IS NULL THEN 'unknown' WHEN k % 3 = 0 THEN 'true' ELSE 'false' END AS flag,
      coalesce(salary, '0') AS salary FROM pn"""
)
ORACLE["drop_missing_rows"] = with_people("SELECT * FROM pn WHERE age IS NOT NULL")
ORACLE["drop_missing_rows_threshold"] = with_people(
    """SELECT k, copy_no, age, email, phone, salary FROM pn WHERE 2 + CAST(age IS NOT NULL AS INT)
      + CAST(email IS NOT NULL AS INT) + CAST(phone IS NOT NULL AS INT) + CAST(salary IS NOT NULL AS INT) >= 5"""
)
ORACLE["drop_missing_cols"] = with_people("SELECT * FROM pn")

# ---------------------------------------------------------------- duplicates

_LINES = "l_shipdate {w}, l_partkey {w}, l_suppkey {w}, l_extendedprice {w}"
ORACLE["dedup_exact"] = with_people(f"SELECT DISTINCT {CELLS} FROM people")
ORACLE["dedup_keep_none"] = with_people(f"SELECT {CELLS} FROM people GROUP BY ALL HAVING count(*) = 1")
for _name, _way in (("first", "ASC"), ("last", "DESC")):
    ORACLE[f"dedup_subset_{_name}"] = f"""SELECT * FROM lineitem QUALIFY row_number()
      OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINES.format(w=_way)}) = 1"""
ORACLE["dedup_subset_none"] = (
    "SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1"
)
ORACLE["dedup_documents"] = "SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"
ORACLE["dup_counts"] = with_people(f"SELECT duplicates, near_duplicates FROM {issue_counts('people')}")
ORACLE["dup_flags"] = with_people(
    """SELECT k, copy_no, count(*) OVER (PARTITION BY n.*) > 1 AS is_duplicate,
      count(*) OVER (PARTITION BY key) > 1 AS is_near_duplicate FROM norm""".replace(
        "n.*", ", ".join(f"n_{c}" for c in DATA)
    ),
    f"norm AS (SELECT k, copy_no, id AS key, {', '.join(f'{x} AS n_{c}' for c, x in NORMAL.items())} FROM people)",
)
_COPIES = f"SELECT k, copy_no FROM people QUALIFY row_number() OVER (PARTITION BY {CELLS} ORDER BY k, copy_no) > 1"
ORACLE["dup_ordinals"] = with_people(_COPIES)
ORACLE["dup_documents"] = "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1"

# ---------------------------------------------------------------- type repair

ORACLE["cast_numeric"] = with_people("SELECT k, copy_no, age, name FROM typed")
ORACLE["cast_datetime"] = with_people(
    f"""SELECT k, copy_no, strftime(try_strptime(hire_date, '%Y-%m-%d'), '%Y-%m-%d %H:%M:%S') AS iso,
      strftime(try_strptime({date('hire_date')}, '%Y-%m-%d'), '%Y-%m-%d %H:%M:%S') AS listed FROM people"""
)
_BOOL = """CASE WHEN lower(trim(is_active)) IN ('true', '1', 'yes', 'y', 'on') THEN true
  WHEN lower(trim(is_active)) IN ('false', '0', 'no', 'n', 'off') THEN false END"""
ORACLE["cast_boolean"] = with_people(f"SELECT k, copy_no, {_BOOL} AS is_active FROM people")
ORACLE["cast_types"] = with_people(
    replaced("people", id="CAST(id AS DOUBLE)", age="TRY_CAST(age AS DOUBLE)", salary="TRY_CAST(salary AS DOUBLE)", is_active=_BOOL)
)
_CAST = {"age": whole("age"), "salary": money("salary"), "is_active": flag("is_active"), "department": label("department")}
ORACLE["cast_schema"] = with_people(replaced("people", **_CAST))

# ---------------------------------------------------------------- text

_PADDED = "padded AS (SELECT k, copy_no, '  ' || name || chr(9) || '  ' || department || ' ' || chr(10) AS label FROM people)"
ORACLE["normalize_text"] = with_people(
    f"SELECT k, copy_no, regexp_replace(lower({strip('label')}), '\\s+', ' ', 'g') AS label FROM padded", _PADDED
)
ORACLE["normalize_documents"] = f"""SELECT doc_id, regexp_replace(lower({strip('text')}), '\\s+', ' ', 'g') AS text, lower(trim(source)) AS source FROM documents"""
ORACLE["strip_whitespace"] = with_people(f"SELECT k, copy_no, {strip('label')} AS label FROM padded", _PADDED)
ORACLE["fix_email"] = with_people(
    """SELECT k, copy_no, CASE WHEN regexp_full_match(email, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z]{2,}')
      THEN email END AS email FROM people"""
)
ORACLE["normalize_email"] = with_people("SELECT k, copy_no, lower(trim(email)) AS email FROM people")
ORACLE["derive_email"] = with_people(
    f"SELECT k, copy_no, name, CASE WHEN email IS NULL OR email = '' THEN {derived('name')} ELSE email END AS email FROM people"
)
ORACLE["title_case"] = with_people(
    f"""SELECT k, copy_no, {title('odd')} AS name FROM
      (SELECT *, name || ' o''NEIL mary-' || lower(department) || '3rd' AS odd FROM people)"""
)
ORACLE["canonical_department"] = with_people(
    f"""SELECT k, copy_no, {label('odd')} AS department FROM (SELECT *, CASE k % 4
      WHEN 0 THEN ' ' || lower(department) || '  ' WHEN 1 THEN 'data science' ELSE department END AS odd FROM people)"""
)
ORACLE["canonical_from_table"] = "SELECT s_suppkey, n_name AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey"
ORACLE["format_date"] = with_people(
    f"""SELECT k, copy_no, {date('odd')} AS hire_date FROM
      (SELECT *, CASE WHEN k % 6 = 0 THEN '2021-02-30' ELSE hire_date END AS odd FROM people)"""
)
ORACLE["format_phone"] = with_people(
    f"""SELECT k, copy_no, {phone('odd')} AS phone FROM
      (SELECT *, CASE WHEN k % 6 = 0 THEN substr(phone, 1, 9) ELSE phone END AS odd FROM people)"""
)
ORACLE["normalized_row"] = with_people(f"SELECT k, copy_no, {NORMAL_CELLS} FROM people")

# ---------------------------------------------------------------- outliers

_IQR = "(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)"
ORACLE["cap_iqr"] = f"""SELECT event_id, round(least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 4) AS value
  FROM events, {_IQR}"""
ORACLE["remove_iqr"] = f"""SELECT event_id, user_id, value FROM events, {_IQR}
  WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"""
ORACLE["cap_zscore"] = """SELECT event_id, round(least(greatest(value, m - 3 * s), m + 3 * s), 4) AS value
  FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)"""
ORACLE["range_outliers"] = with_people(
    f"""SELECT k, copy_no, age, salary, coalesce({issue('age')} = 'outliers', false) AS age_outlier,
      coalesce({issue('salary')} = 'outliers', false) AS salary_outlier FROM people"""
)
ORACLE["drop_low_variance"] = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  l_returnflag, l_linestatus FROM lineitem"""

# ---------------------------------------------------------------- validation

_PRICE_LOW, _PRICE_HIGH = "o_totalprice < 5000", "o_totalprice > 300000"
_STATUS, _PRIORITY = "o_orderstatus NOT IN ('O', 'F')", "NOT regexp_matches(o_orderpriority, '^[1-4]-')"
_BROKEN = " OR ".join((_PRICE_LOW, _PRICE_HIGH, _STATUS, _PRIORITY))


def _error(test: str, c: str, rule: str, message: str, source: str = "orders", ids: str = "o_orderkey", row: str = "o_orderkey") -> str:
    return f"""SELECT {ids}, '{c}' AS "column", '{rule}' AS rule, CAST({c} AS VARCHAR) AS value,
      'Row ' || {row} || ': ' || {message} AS message FROM {source} WHERE {test}"""


_ORDER_ERRORS = union(
    (
        _error(_PRICE_LOW, "o_totalprice", "min", "'''o_totalprice'' is below 5000: ' || o_totalprice"),
        _error(_PRICE_HIGH, "o_totalprice", "max", "'''o_totalprice'' is above 300000: ' || o_totalprice"),
        _error(_STATUS, "o_orderstatus", "allowed_values", "'''o_orderstatus'' is none of [''O'', ''F'']: ''' || o_orderstatus || ''''"),
        _error(
            _PRIORITY, "o_orderpriority", "pattern",
            "'''o_orderpriority'' lacks the form [1-4]-: ''' || o_orderpriority || ''''",
        ),
        "SELECT NULL, 'o_comment', 'missing_column', NULL, 'Column ''o_comment'' is required and absent'",
    )
)
ORACLE["validate_valid"] = f"SELECT * FROM orders WHERE NOT ({_BROKEN})"
ORACLE["validate_errors"] = _ORDER_ERRORS
ORACLE["validate_quarantine"] = f"""SELECT *, concat_ws(',', CASE WHEN {_PRICE_LOW} THEN 'o_totalprice/min' END,
    CASE WHEN {_PRICE_HIGH} THEN 'o_totalprice/max' END, CASE WHEN {_STATUS} THEN 'o_orderstatus/allowed_values' END,
    CASE WHEN {_PRIORITY} THEN 'o_orderpriority/pattern' END) AS errors FROM orders WHERE {_BROKEN}"""
ORACLE["validate_once"] = f"""SELECT o_orderkey, o_totalprice, 'valid' AS part, NULL AS rule FROM orders WHERE NOT ({_BROKEN})
  UNION ALL SELECT o_orderkey, o_totalprice, 'quarantine', concat_ws(',', CASE WHEN {_PRICE_LOW} THEN 'min' END, CASE WHEN {_PRICE_HIGH} THEN 'max' END,
    CASE WHEN {_STATUS} THEN 'allowed_values' END, CASE WHEN {_PRIORITY} THEN 'pattern' END) FROM orders WHERE {_BROKEN}
  UNION ALL SELECT o_orderkey, NULL, 'errors', rule FROM ({_ORDER_ERRORS})"""
_PEOPLE_TESTS = {
    ("age", "required"): ("age IS NULL", "'''age'' must not be empty'"),
    ("age", "type"): ("age IS NOT NULL AND TRY_CAST(age AS DOUBLE) IS NULL", "'''age'' holds no number: ''' || age || ''''"),
    ("age", "min"): ("TRY_CAST(age AS DOUBLE) < 0", "'''age'' is below 0: ' || age"),
    ("age", "max"): ("TRY_CAST(age AS DOUBLE) > 120", "'''age'' is above 120: ' || age"),
    ("email", "required"): ("email IS NULL", "'''email'' must not be empty'"),
    ("email", "pattern"): (
        "NOT regexp_matches(email, '^[^@ ]+@[^@ ]+\\.[a-z]+$')",
        "'''email'' lacks the form [^@\\s]+@[^@\\s]+\\.[a-z]+$: ''' || email || ''''",
    ),
    ("salary", "min"): ("TRY_CAST(salary AS DOUBLE) < 0", "'''salary'' is below 0: ' || salary"),
    ("department", "allowed_values"): (
        "department NOT IN ('Engineering', 'Finance', 'Sales', 'HR', 'Operations')",
        "'''department'' is none of [''Engineering'', ''Finance'', ''Sales'', ''HR'', ''Operations'']: ''' || department || ''''",
    ),
}
ORACLE["validate_people_errors"] = with_people(
    union(
        _error(test, c, rule, message, "pn", "k, copy_no", "k || '/' || copy_no")
        for (c, rule), (test, message) in _PEOPLE_TESTS.items()
    )
)
ORACLE["validate_people_valid"] = with_people(
    f"SELECT * FROM pn WHERE NOT coalesce({') AND NOT coalesce('.join(f'{test}, false' for test, _ in _PEOPLE_TESTS.values())})"
    .replace("coalesce(age IS NOT NULL AND", "coalesce(age IS NOT NULL AND")
)

# ---------------------------------------------------------------- issues

ORACLE["issue_counts"] = with_people(f"SELECT * FROM {issue_counts('people')}")
ORACLE["total_issues"] = with_people(
    f"SELECT {' + '.join((*CELL_ISSUES, 'duplicates', 'near_duplicates'))} AS total_issues FROM {issue_counts('people')}"
)
ORACLE["cell_issues"] = with_people(
    f"""SELECT * FROM ({union(f"SELECT k, copy_no, '{c}' AS column, {issue(c)} AS issue, {c} AS value FROM people".replace(' AS column', ' AS "column"') for c in DATA)})
    WHERE issue IS NOT NULL"""
)

ORACLE["validate_against_table"] = """SELECT l_orderkey, l_linenumber, 'l_suppkey' AS "column", 'allowed_values' AS rule, CAST(l_suppkey AS VARCHAR) AS value,
  'Row ' || l_orderkey || '/' || l_linenumber || ': ''l_suppkey'' is not in the table of values: ' || chr(39) || l_suppkey || chr(39) AS message
  FROM lineitem WHERE l_suppkey IS NOT NULL AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"""

# ---------------------------------------------------------------- repairs

_INT_AGE = "CASE WHEN regexp_full_match(age, '[+-]?[0-9]+') THEN CAST(age AS DOUBLE) END"
_MIDDLE = f"middle AS (SELECT CAST(CAST(trunc(quantile_cont(v, 0.5)) AS BIGINT) AS VARCHAR) AS age FROM (SELECT {_INT_AGE} AS v FROM (SELECT DISTINCT {CELLS} FROM people)))"
_REST = f"copies AS ({_COPIES}), rest AS (SELECT * FROM people ANTI JOIN copies USING (k, copy_no))"
_SLASHED = "strftime(try_strptime(hire_date, '%Y/%m/%d'), '%Y-%m-%d')"
_ACTIONS = f"""actions AS (
  SELECT k, copy_no, 1::BIGINT AS seq, 'remove_duplicate' AS action_type, 'id' AS column_name, NULL AS new_value, 'exact copy of an earlier row' AS reason FROM copies
  UNION ALL SELECT k, copy_no, 2, 'fix_missing', 'age', (SELECT age FROM middle), 'median age' FROM rest WHERE age IS NULL OR age = ''
  UNION ALL SELECT k, copy_no, 3, 'fix_missing', 'email', {derived('name')}, 'derived from the name' FROM rest WHERE email IS NULL OR email = ''
  UNION ALL SELECT k, copy_no, 4, 'fix_format', 'hire_date', {_SLASHED}, 'ISO date' FROM rest WHERE {_SLASHED} IS NOT NULL)"""
_FIXED = replaced(
    "rest",
    age="CASE WHEN age IS NULL OR age = '' THEN (SELECT age FROM middle) ELSE age END",
    email=f"CASE WHEN email IS NULL OR email = '' THEN {derived('name')} ELSE email END",
    hire_date=f"coalesce({_SLASHED}, hire_date)",
)
ORACLE["propose_repairs"] = with_people("SELECT * FROM actions", _MIDDLE, _REST, _ACTIONS)
ORACLE["apply_repairs"] = with_people(_FIXED, _MIDDLE, _REST)
ORACLE["apply_known_values"] = with_people(
    f"""SELECT p.k, p.copy_no, {', '.join(f'CASE WHEN p.i_{c} IS NOT NULL THEN t.{c} ELSE p.{c} END AS {c}' for c in DATA)}
    FROM judged p JOIN truth t ON t.id = CAST(1000 + p.k AS VARCHAR)""",
    f"judged AS (SELECT *, {', '.join(f'{issue(c)} AS i_{c}' for c in DATA)} FROM people)",
)
_AGE30 = "CASE WHEN age IS NULL OR age = '' THEN '30' ELSE age END"
ORACLE["apply_column_repairs"] = with_people(
    replaced(
        "people",
        hire_date=date("hire_date"), phone=phone("phone"), age=whole(_AGE30),
        salary="CASE WHEN TRY_CAST(salary AS DOUBLE) <= 0 THEN '60000' ELSE salary END", is_active=flag("is_active"),
    )
)
ORACLE["repair_audit"] = with_people(
    """SELECT a.k, a.copy_no, a.seq, a.action_type, a.column_name, a.new_value, a.reason,
      CASE a.column_name WHEN 'id' THEN b.id WHEN 'age' THEN b.age WHEN 'email' THEN b.email WHEN 'hire_date' THEN b.hire_date END AS value_before,
      CASE a.column_name WHEN 'id' THEN c.id WHEN 'age' THEN c.age WHEN 'email' THEN c.email WHEN 'hire_date' THEN c.hire_date END AS value_after,
      CASE WHEN action_type = 'remove_duplicate' THEN c.id IS NULL ELSE value_before IS DISTINCT FROM value_after END AS valid,
      valid AS correct, false AS destructive, CAST(valid AS BIGINT) AS rows_changed
    FROM actions a JOIN people b USING (k, copy_no) LEFT JOIN fixed c USING (k, copy_no)""",
    _MIDDLE, _REST, _ACTIONS, f"fixed AS ({_FIXED})",
)
_PRISTINE = "copy_no = 0 AND k % 61 = 0 AND k % 19 <> 0 AND k % 23 <> 0"


def _acts(seq: int, kind: str, column: str, value: str, why: str, after: str, valid: bool, correct: bool, destructive: bool, when: str) -> str:
    return f"""SELECT k, copy_no, {seq}::BIGINT AS seq, '{kind}' AS action_type, '{column}' AS column_name, '{value}' AS new_value, '{why}' AS reason,
      {column} AS value_before, {after} AS value_after, {valid} AS valid, {correct} AS correct, {destructive} AS destructive,
      {int(valid)}::BIGINT AS rows_changed FROM people WHERE {when}"""


def _on_column(seq: int, kind: str, column: str, value: str, why: str, when: str) -> str:
    return f"""SELECT NULL, NULL, {seq}, '{kind}', {column}, {value}, '{why}', NULL, NULL, count(*) > 0 OR '{kind}' = 'no_op', count(*) > 0, false, count(*)
      FROM people WHERE {when}"""


_MIXED_AUDIT = union((
    _acts(1, "fix_missing", "age", "30", "acts", "'30'", True, True, False, "age IS NULL OR age = ''"),
    _acts(2, "fix_missing", "age", "40", "too late", "age", False, False, False, "age IS NULL OR age = ''"),
    _acts(3, "fix_outlier", "age", "35", "acts", "'35'", True, True, False, "age = '999'"),
    _acts(4, "fix_format", "name", "Someone Else", "destroys", "'Someone Else'", True, False, True, _PRISTINE),
    _on_column(10, "fix_missing", "'phone'", "'000-000-0000'", "acts on some", "phone IS NULL OR phone = ''"),
    _on_column(11, "fix_missing", "'is_active'", "'true'", "none is missing", "is_active IS NULL OR is_active = ''"),
    _on_column(12, "no_op", "NULL", "NULL", "issues are left", "false"),
))
_MIXED = replaced(
    "people",
    age="CASE WHEN age IS NULL OR age = '' THEN '30' WHEN age = '999' THEN '35' ELSE age END",
    name=f"CASE WHEN {_PRISTINE} THEN 'Someone Else' ELSE name END",
    phone="CASE WHEN phone IS NULL OR phone = '' THEN '000-000-0000' ELSE phone END",
)
ORACLE["repair_audit_known"] = with_people(_MIXED_AUDIT)
_GOOD_SALARY = "CASE WHEN TRY_CAST(salary AS DOUBLE) > 0 AND TRY_CAST(salary AS DOUBLE) <= 300000 THEN TRY_CAST(salary AS DOUBLE) END"
_GOOD_AGE = "CASE WHEN regexp_full_match(age, '[+-]?[0-9]+') AND TRY_CAST(age AS INT) BETWEEN 18 AND 80 THEN TRY_CAST(age AS DOUBLE) END"
_FILLED = replaced(
    "people",
    **{c: f"CASE WHEN {c} IS NULL OR {c} = '' THEN {mode('blank', c)} ELSE {c} END" for c in ("name", "phone", "hire_date", "department", "is_active")},
    age="CASE WHEN age IS NULL OR age = '' THEN (SELECT age FROM middles) ELSE age END",
    salary="CASE WHEN salary IS NULL OR salary = '' THEN (SELECT salary FROM middles) ELSE salary END",
    email=f"CASE WHEN email IS NULL OR email = '' THEN {derived('name')} ELSE email END",
)
ORACLE["auto_clean"] = with_people(
    """SELECT * REPLACE (
      CASE WHEN NOT regexp_full_match(age, '[+-]?[0-9]+') OR TRY_CAST(age AS INT) NOT BETWEEN 18 AND 80 THEN (SELECT age FROM middles) ELSE age END AS age,
      CASE WHEN TRY_CAST(salary AS DOUBLE) <= 0 OR TRY_CAST(salary AS DOUBLE) > 300000 THEN (SELECT salary FROM middles) ELSE salary END AS salary) FROM formed""",
    f"blank AS (SELECT {', '.join(f"nullif({c}, '') AS {c}" for c in DATA)} FROM people)",
    f"""middles AS (SELECT CAST(CAST(trunc(quantile_cont({_GOOD_AGE}, 0.5)) AS BIGINT) AS VARCHAR) AS age,
      regexp_replace(CAST(CAST(quantile_cont({_GOOD_SALARY}, 0.5) AS DECIMAL(18, 2)) AS VARCHAR), '\\.?0+$', '') AS salary FROM people)""",
    f"filled AS ({_FILLED})",
    f"norm AS (SELECT k, copy_no, {NORMAL_CELLS} FROM filled)",
    f"kept AS (SELECT k, copy_no FROM norm QUALIFY row_number() OVER (PARTITION BY {CELLS} ORDER BY k, copy_no) = 1)",
    "formed AS (" + replaced(
        "filled SEMI JOIN kept USING (k, copy_no)",
        name=title("name"), age=whole("age"), phone=phone("phone"), salary=money("salary"),
        hire_date=date("hire_date"), department=label("department"), is_active=flag("is_active"),
    ) + ")",
)
ORACLE["table_diff"] = with_people(
    union(
        f"""SELECT p.id, '{c}' AS "column", CASE WHEN nth = 1 THEN 'changed' ELSE 'removed' END AS change, p.{c} AS before, t.{c} AS after
          FROM placed p LEFT JOIN truth t ON t.id = p.id AND nth = 1 WHERE p.{c} IS DISTINCT FROM t.{c}"""
        for c in DATA[1:]
    ),
    f"""placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {', '.join(f'{c} NULLS FIRST' for c in DATA[1:])}) AS nth FROM people)""",
)

# ---------------------------------------------------------------- scores

_SORTED = f"""row_number() OVER (ORDER BY coalesce(id, 'None'), coalesce(name, 'None'), coalesce(email, 'None'),
  {', '.join(f'{c} NULLS FIRST' for c in DATA)}) AS place"""


def positional(left: str, right: str) -> str:
    hits = " + ".join(f"CAST(l.{c} IS NOT DISTINCT FROM r.{c} AS BIGINT)" for c in DATA)
    return f"""(SELECT *, matches / cells AS ratio FROM (SELECT CAST(sum({hits}) AS BIGINT) AS matches, count(*) * 9 AS cells
      FROM (SELECT *, {_SORTED} FROM ({left})) l FULL JOIN (SELECT *, {_SORTED} FROM ({right})) r ON l.place = r.place))"""


def scored(source: str) -> str:
    return f"SELECT matches, cells, round(ratio, 8) AS ratio FROM {source}"


ORACLE["cell_match"] = with_people(scored(positional(f"SELECT {CELLS} FROM people", f"SELECT {CELLS} FROM truth")))
ORACLE["match_score"] = with_people(
    scored(positional(f"SELECT {NORMAL_CELLS} FROM people", f"SELECT {NORMAL_CELLS} FROM truth"))
)
ORACLE["cell_match_keyed"] = with_people(
    f"""SELECT matches, cells, round(matches / cells, 8) AS ratio FROM (
      SELECT CAST(sum({' + '.join(f'CAST(l.{c} IS NOT DISTINCT FROM r.{c} AS BIGINT)' for c in DATA)}) AS BIGINT) AS matches,
        greatest((SELECT count(*) FROM people), (SELECT count(*) FROM truth)) * 9 AS cells
      FROM (SELECT * FROM people QUALIFY row_number() OVER (PARTITION BY id ORDER BY k, copy_no) = 1) l FULL JOIN truth r ON l.id = r.id)"""
)
_ALL_ISSUES = (*CELL_ISSUES, "duplicates", "near_duplicates")


def _counters(fixed: str) -> tuple[str, ...]:
    """Issues of the people before and after repair."""
    return (
        f"fixed AS ({fixed})", f"b AS (SELECT * FROM {issue_counts('people')})", f"a AS (SELECT * FROM {issue_counts('fixed')})",
        f"""counters AS (SELECT {', '.join(f'b.{i} AS original_{i}' for i in _ALL_ISSUES)},
          {', '.join(f'greatest(b.{i} - a.{i}, 0) AS fixed_{i}' for i in _ALL_ISSUES)} FROM a, b)""",
    )


ORACLE["issues_fixed"] = with_people("SELECT * FROM counters", _MIDDLE, _REST, *_counters(_FIXED))


def _earned(issue_name: str) -> str:
    return f"CASE WHEN original_{issue_name} > 0 THEN fixed_{issue_name} / original_{issue_name} ELSE 0 END"


ORACLE["grades"] = with_people(
    f"""SELECT round(least(1, 0.5 * {_earned('missing_values')} + 0.5 * {_earned('duplicates')} + saved), 8) AS easy,
      round(least(1, 0.25 * {_earned('missing_values')} + 0.2 * {_earned('duplicates')} + 0.3 * {_earned('wrong_format')} + 0.25 * {_earned('wrong_type')}), 8) AS medium,
      round(greatest(0, least(1, 0.7 * ratio + 0.2 * ({' + '.join(f'fixed_{i}' for i in _ALL_ISSUES)}) / ({' + '.join(f'original_{i}' for i in _ALL_ISSUES)})
        + saved - 0.05 * destroyed)), 8) AS hard
    FROM counters, {positional(f'SELECT {CELLS} FROM fixed', f'SELECT {CELLS} FROM truth')},
      (SELECT greatest(0, 0.1 * (1 - count(*) / 100000)) AS saved, count(*) FILTER (WHERE destructive) AS destroyed FROM audit)""",
    *_counters(_MIXED), f"audit AS ({_MIXED_AUDIT})",
)
# Rewards, their limits and the names of actions.
_LOG = """log AS (SELECT user_id AS run_id, event_id AS step,
    CASE event_id % 7 WHEN 0 THEN 'fix_missing' WHEN 1 THEN 'remove_duplicate' WHEN 2 THEN 'fix_format'
      WHEN 3 THEN 'fix_type' WHEN 4 THEN 'fix_outlier' WHEN 5 THEN 'no_op' ELSE 'polish' END AS action_type,
    event_id % 11 <> 0 AS valid, event_id % 3 = 0 AS correct, event_id % 6 + 2 AS issues_before,
    event_id % 5 AS issues_after, value AS score FROM events),
  rewarded AS (SELECT *, greatest(-0.3, least(0.5, round(
      CASE WHEN correct THEN CASE action_type WHEN 'fix_missing' THEN 0.15 WHEN 'remove_duplicate' THEN 0.12 WHEN 'fix_format' THEN 0.18
          WHEN 'fix_type' THEN 0.15 WHEN 'fix_outlier' THEN 0.2 ELSE 0.1 END
          + CASE WHEN issues_before - issues_after > 1 THEN 0.05 * least(issues_before - issues_after, 3) ELSE 0 END
        WHEN action_type <> 'no_op' THEN -0.08 ELSE 0 END
      + CASE WHEN action_type = 'no_op' THEN -0.05 ELSE 0 END + CASE WHEN valid THEN 0 ELSE -0.12 END - 0.01, 4))) AS plain FROM log),
  scored AS (SELECT * EXCLUDE (plain), CAST(CASE WHEN issues_after = 0 THEN round(least(0.8, plain + 0.3), 4) ELSE plain END AS DOUBLE) AS reward,
    issues_after = 0 AS completed FROM rewarded)"""
ORACLE["action_scores"] = f"WITH {_LOG} SELECT * FROM scored"
ORACLE["run_summary"] = f"""WITH {_LOG} SELECT run_id, count(*) AS steps, round(avg(reward), 4) AS mean_reward,
  round(sum(reward), 4) AS total_reward, max_by(score, step) AS final_score, bool_or(completed) AS completed FROM scored GROUP BY run_id"""

ORACLE["run_summary_levels"] = f"""WITH {_LOG}, runs AS (SELECT run_id, ['easy', 'medium', 'hard'][run_id % 3 + 1] AS level, count(*) AS steps,
    sum(reward) AS total_reward, max_by(score, step) AS final_score, bool_or(completed) AS completed FROM scored GROUP BY run_id)
  SELECT run_id, level, CASE WHEN grouping(run_id) = 0 THEN 'run' WHEN grouping(level) = 0 THEN 'level' ELSE 'all' END AS grouped, count(*) AS runs,
    CAST(sum(steps) AS BIGINT) AS steps, round(sum(total_reward) / sum(steps), 4) AS mean_reward, round(sum(total_reward), 4) AS total_reward,
    round(avg(final_score), 4) AS final_score, round(avg(CAST(completed AS INT)), 4) AS completed_share
  FROM runs GROUP BY GROUPING SETS ((run_id, level), (level), ())"""

# ---------------------------------------------------------------- cleaning runs

_LOADED = """loaded AS (SELECT CAST(id AS BIGINT) AS id, name, age, email, phone, CAST(salary AS BIGINT) AS salary, hire_date, department, is_active FROM pn),
  single AS (SELECT DISTINCT * FROM loaded)"""
_CLEANED = """filled AS (SELECT CAST(id AS DOUBLE) AS id, coalesce(name, '') AS name, TRY_CAST(age AS DOUBLE) AS age,
    coalesce(email, 'unknown@example.com') AS email, coalesce(phone, '000-000-0000') AS phone,
    CAST(coalesce(salary, (SELECT quantile_cont(CAST(salary AS DOUBLE), 0.5) FROM single)) AS DOUBLE) AS salary, hire_date, department, is_active FROM single),
  q AS (SELECT quantile_cont(age, 0.25) AS a1, quantile_cont(age, 0.75) AS a3, quantile_cont(salary, 0.25) AS s1, quantile_cont(salary, 0.75) AS s3 FROM filled),
  cleaned AS (SELECT round(id, 4) AS id, lower(name) AS name,
    round(CASE WHEN age IS NOT NULL THEN least(greatest(age, a1 - 1.5 * (a3 - a1)), a3 + 1.5 * (a3 - a1)) END, 4) AS age, lower(email) AS email, phone,
    round(least(greatest(salary, s1 - 1.5 * (s3 - s1)), s3 + 1.5 * (s3 - s1)), 4) AS salary, hire_date, lower(department) AS department, is_active FROM filled, q)"""
ORACLE["infer_types"] = with_people("SELECT * FROM loaded", _LOADED)
ORACLE["clean_people"] = with_people("SELECT * FROM cleaned", _LOADED, _CLEANED)


def _nulls_of(c: str) -> str:
    return f"(SELECT count(*) - count({c}) FROM single)"


_TAKEN = "((SELECT count(*) FROM loaded) - (SELECT count(*) FROM single))"
_GIVEN = {"age": "median", "email": "unknown@example.com", "phone": "000-000-0000", "salary": "median"}


def _all_nulls(source: str) -> str:
    return f"(SELECT CAST(sum({' + '.join(f'CAST({c} IS NULL AS INT)' for c in DATA)}) AS BIGINT) FROM {source})"


_STEPS = (
    ("duplicates", None, _TAKEN, f"{_TAKEN} || ' repeated rows taken out'"),
    *(("fill_missing", c, "0" if c == "age" else _nulls_of(c), f"'{c}: ' || {_nulls_of(c)} || ' nulls given the {_GIVEN[c]}'") for c in _GIVEN),
    *(("cast_type", c, "0", f"'{c} read as numeric'") for c in ("age", "salary", "id")),
    *(("normalize_text", c, "0", f"'{c} trimmed and in lower case'") for c in ("name", "department", "email")),
    *(("outlier_cap_iqr", c, "0", f"'{c} limited by quartiles'") for c in ("age", "salary")),
    (
        "summary", None, "0",
        f"(SELECT count(*) FROM cleaned) || ' of ' || (SELECT count(*) FROM loaded) || ' rows left, nulls from ' || {_all_nulls('loaded')} || ' to ' || {_all_nulls('cleaned')}",
    ),
)
ORACLE["clean_audit"] = with_people(
    union(
        f"""SELECT CAST({i + 1} AS INT) AS seq, '{step}' AS step, {f"'{c}'" if c else 'NULL'} AS "column", {detail} AS detail, CAST({n} AS BIGINT) AS rows_affected"""
        for i, (step, c, n, detail) in enumerate(_STEPS)
    ),
    _LOADED, _CLEANED,
)
_INSIDE = "BETWEEN q1 - 0.3 * (q3 - q1) AND q3 + 0.3 * (q3 - q1)"
ORACLE["clean_events_audit"] = f"""WITH t AS (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value,
    CASE WHEN event_id % 40 <> 0 THEN event_type END AS event_type, CAST(event_id % 1000 AS DOUBLE) AS place FROM events),
  a AS (SELECT * FROM t WHERE user_id IS NOT NULL), b AS (SELECT * REPLACE (coalesce(value, 1.5) AS value) FROM a WHERE event_type IS NOT NULL),
  q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM b), c AS (SELECT b.* FROM b, q WHERE value {_INSIDE}),
  r AS (SELECT quantile_cont(place, 0.25) AS q1, quantile_cont(place, 0.75) AS q3 FROM c), d AS (SELECT c.* FROM c, r WHERE place {_INSIDE}),
  n AS (SELECT (SELECT count(*) FROM t) AS nt, (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM c) AS nc, (SELECT count(*) FROM d) AS nd,
    (SELECT count(*) - count(value) FROM a) AS holes, (SELECT 3 * count(*) - count(user_id) - count(value) - count(event_type) FROM t) AS nulls)
  SELECT CAST(seq AS INT) AS seq, step, "column", detail, CAST(rows_affected AS BIGINT) AS rows_affected FROM (
    SELECT 1 AS seq, 'drop_rows' AS step, 'user_id' AS "column", (nt - na) || ' rows without user_id taken out' AS detail, nt - na AS rows_affected FROM n
    UNION ALL SELECT 2, 'fill_missing', 'value', 'value: ' || holes || ' nulls given the 1.5', holes FROM n
    UNION ALL SELECT 3, 'drop_rows', 'event_type', (na - nb) || ' rows without event_type taken out', na - nb FROM n
    UNION ALL SELECT 4, 'outlier_remove_iqr', 'value', (nb - nc) || ' rows beyond the quartile limits of value taken out', nb - nc FROM n
    UNION ALL SELECT 5, 'outlier_remove_iqr', 'place', (nc - nd) || ' rows beyond the quartile limits of place taken out', nc - nd FROM n
    UNION ALL SELECT 6, 'summary', NULL, nd || ' of ' || nt || ' rows left, nulls from ' || nulls || ' to 0', 0 FROM n)"""
ORACLE["clean_events"] = """WITH t AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, event_type,
    CASE WHEN event_id % 50 <> 0 THEN user_id END AS user_id FROM events),
  f AS (SELECT event_id, coalesce(value, (SELECT avg(value) FROM t)) AS value, event_type, user_id FROM t),
  d AS (SELECT * FROM f WHERE user_id IS NOT NULL),
  q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM d)
  SELECT event_id, round(value, 4) AS value, event_type, user_id FROM d, q
  WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"""
ORACLE["job_summary"] = with_people(
    f"""SELECT (SELECT count(*) FROM loaded) AS original_rows, count(*) FILTER (WHERE age <= 45) AS cleaned_rows,
      (SELECT count(*) FROM loaded) - count(*) FILTER (WHERE age <= 45) AS rows_removed,
      CAST({len(_STEPS)} AS BIGINT) AS cleaning_steps, count(*) FILTER (WHERE age IS NULL OR age > 45) AS validation_errors FROM cleaned""",
    _LOADED, _CLEANED,
)

# ---------------------------------------------------------------- generated tables


def _draw(key: str, seed: int, at: int) -> str:
    return f"CAST('0x' || substr(md5({key} || ':{seed}:{at // 10}'), {3 * (at % 10) + 1}, 3) AS BIGINT)"


def _pad(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS VARCHAR), {n}, '0')"


_D = [_draw("c_custkey", 7, i) for i in range(13)]
_MADE = f"""named AS (SELECT c_custkey, ['Ada', 'Bela', 'Chen', 'Dora', 'Emil', 'Fay', 'Gus', 'Hana'][{_D[0]} % 8 + 1] || ' ' ||
    ['Adams', 'Brown', 'Diaz', 'Evans', 'Kim', 'Lee', 'Novak', 'White'][{_D[1]} % 8 + 1] AS name FROM customer),
  made AS (SELECT c_custkey AS k, CAST(1000 + c_custkey AS VARCHAR) AS id, name, CAST(24 + {_D[2]} % 35 AS VARCHAR) AS age,
    lower(replace(name, ' ', '.')) || '@example.com' AS email,
    {_pad(f'200 + {_D[5]} % 800', 3)} || '-' || {_pad(f'{_D[6]} % 1000', 3)} || '-' || {_pad(f'({_D[5]} * 13 + {_D[7]}) % 10000', 4)} AS phone,
    CAST(55000 + ({_D[3]} * 4096 + {_D[4]}) % 125001 AS VARCHAR) AS salary,
    CAST(2015 + {_D[8]} % 10 AS VARCHAR) || '-' || {_pad(f'1 + {_D[9]} % 12', 2)} || '-' || {_pad(f'1 + {_D[10]} % 28', 2)} AS hire_date,
    ['Engineering', 'Finance', 'Sales', 'HR', 'Operations', 'Marketing'][{_D[11]} % 6 + 1] AS department,
    CASE WHEN {_D[12]} % 2 = 0 THEN 'true' ELSE 'false' END AS is_active FROM named)"""
ORACLE["synthesize_people"] = f"WITH {_MADE} SELECT * FROM made"
_H = [_draw("k", 11, i) for i in range(19)]
# Limits out of 4096 for the shares of rows each issue hits.
_L = [round(x * 4096) for x in (.04, .03, .02, .02, .02, .04, .02, .02, .05, .05, .02, .02, .06, .04, .05, .04, .05, .03)]


def _hit(i: int) -> str:
    return f"{_H[i]} < {_L[i]}"


ORACLE["inject_issues"] = f"""WITH {_MADE},
  broken AS (SELECT k, id, name,
    CASE WHEN {_hit(0)} THEN NULL WHEN {_hit(1)} THEN '' WHEN {_hit(2)} THEN 'forty-two' WHEN {_hit(3)} THEN age || '.0' WHEN {_hit(4)} THEN '431' ELSE age END AS age,
    CASE WHEN {_hit(5)} THEN '' WHEN {_hit(6)} THEN replace(email, '@', '.') ELSE email END AS email,
    CASE WHEN {_hit(7)} THEN NULL WHEN {_hit(8)} THEN replace(phone, '-', '') WHEN {_hit(9)} THEN replace(phone, '-', ' ') ELSE phone END AS phone,
    CASE WHEN {_hit(10)} THEN '' WHEN {_hit(11)} THEN '-7250' ELSE salary END AS salary,
    CASE WHEN {_hit(12)} THEN hire_date[1:4] || '/' || hire_date[6:7] || '/' || hire_date[9:10]
      WHEN {_hit(13)} THEN hire_date[9:10] || '-' || hire_date[6:7] || '-' || hire_date[1:4] ELSE hire_date END AS hire_date,
    CASE WHEN {_hit(14)} THEN CASE department WHEN 'Engineering' THEN 'Eng' WHEN 'HR' THEN 'hr' WHEN 'Operations' THEN 'ops' ELSE lower(department) END ELSE department END AS department,
    CASE WHEN {_hit(15)} THEN CASE is_active WHEN 'true' THEN 'yes' ELSE '0' END ELSE is_active END AS is_active FROM made)
  SELECT *, 0 AS copy_no FROM broken UNION ALL SELECT *, 1 FROM broken WHERE {_hit(16)}
  UNION ALL SELECT * REPLACE (CASE {_H[18]} % 3 WHEN 0 THEN replace(name, ' ', '  ') WHEN 1 THEN lower(name) ELSE upper(name) END AS name,
    CASE WHEN {_H[18]} % 3 <> 1 THEN lower(department) ELSE department END AS department,
    CASE WHEN {_H[18]} % 3 = 1 THEN 'yes' ELSE is_active END AS is_active), 2 FROM broken WHERE {_hit(17)}"""

# ---------------------------------------------------------------- files and streams

ORACLE["csv_roundtrip"] = "SELECT * REPLACE (CAST(p_size AS BIGINT) AS p_size) FROM part"
ORACLE["tsv_roundtrip"] = "SELECT * REPLACE (CAST(c_nationkey AS BIGINT) AS c_nationkey) FROM customer"
ORACLE["json_roundtrip"] = "SELECT * REPLACE (CAST(s_nationkey AS BIGINT) AS s_nationkey) FROM supplier"
ORACLE["json_documents"] = """SELECT s_suppkey, s_name, s_acctbal, NULL::BIGINT AS broken FROM supplier WHERE s_nationkey % 7 <> 3
  UNION ALL SELECT DISTINCT NULL, NULL, NULL, CAST(s_nationkey AS BIGINT) FROM supplier WHERE s_nationkey % 7 = 3"""
_ILL = "p_partkey % 31 = 0 OR (p_partkey % 17 = 0) <> (p_partkey % 23 = 0) OR (p_partkey % 17 = 0 AND p_partkey % 23 = 0)"
ORACLE["csv_malformed"] = f"""SELECT p_partkey, p_name, p_retailprice, p_size, NULL AS record, NULL::BOOLEAN AS placed FROM part WHERE NOT ({_ILL})
  UNION ALL SELECT p_partkey, NULL, NULL, NULL, concat_ws(',', CAST(p_partkey AS VARCHAR), '"' || p_name || '"',
    CASE WHEN p_partkey % 31 = 0 THEN 'much' ELSE CAST(p_retailprice AS VARCHAR) END, CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_size AS VARCHAR) END,
    CASE WHEN p_partkey % 23 = 0 THEN 'extra' END), true FROM part WHERE {_ILL}"""
ORACLE["parquet_roundtrip"] = "SELECT * FROM orders"
_REPORTED = ("o_orderkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderpriority", "string")
ORACLE["reports_retried"] = f"""SELECT * FROM (VALUES ('job-1'), ('job-2')) j(job_id), (
    {union(f"SELECT 'profile' AS report, '{c}/{kind}/' || (count(*) - count({c})) AS entry, 1::BIGINT AS n FROM orders" for c, kind in _REPORTED)}
    UNION ALL SELECT 'audit', entry, 1 FROM (VALUES ('outlier_cap_iqr/o_orderkey'), ('outlier_cap_iqr/o_totalprice'), ('summary')) a(entry)
    UNION ALL SELECT 'errors', "column" || '/' || rule, count(*) FROM ({_ORDER_ERRORS}) GROUP BY "column", rule)"""
_LATE_FILES = """landed AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value,
    CAST(least(trunc(8 * percent_rank() OVER (ORDER BY ts, event_id)), 7) + CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0 END AS INT) AS file FROM events),
  marks AS (SELECT file, max(max(ts)) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS mark FROM landed GROUP BY file),
  marked AS (SELECT *, coalesce(ts < mark, false) AS late FROM landed JOIN marks USING (file)),
  seen AS (SELECT *, max(ts) FILTER (NOT late) OVER earlier AS last_time, max(file) FILTER (NOT late) OVER earlier AS last_file FROM marked
    WINDOW earlier AS (PARTITION BY user_id, event_type ORDER BY file, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
ORACLE["stream_dedup_late"] = f"""WITH {_LATE_FILES}
  SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type, value,
    CASE WHEN late THEN 'late' WHEN last_file = file OR last_time + INTERVAL 2 DAY >= coalesce(mark, last_time) THEN 'repeat' ELSE 'new' END AS kind FROM seen"""
ORACLE["report_roundtrip"] = f"""SELECT 'job-1' AS job_id, "column", rule, count(*) AS n FROM ({_ORDER_ERRORS}) GROUP BY ALL"""
_KINDS = "('click', 'view', 'purchase')"
ORACLE["stream_clean"] = f"""SELECT event_id, user_id, lower(event_type) AS event_type, least(greatest(value, 0), 60) AS value
  FROM events WHERE lower(event_type) IN {_KINDS} AND user_id >= 2"""
ORACLE["stream_quarantine"] = f"""SELECT event_id, 'event_type' AS "column", 'allowed_values' AS rule, lower(event_type) AS value,
    'Row ' || event_id || ': ''event_type'' is none of [''click'', ''view'', ''purchase'']: ''' || lower(event_type) || '''' AS message
  FROM events WHERE lower(event_type) NOT IN {_KINDS}
  UNION ALL SELECT event_id, 'user_id', 'min', CAST(user_id AS VARCHAR), 'Row ' || event_id || ': ''user_id'' is below 2: ' || user_id
  FROM events WHERE user_id < 2"""
ORACLE["stream_dedup"] = "SELECT DISTINCT user_id, event_type FROM events"

ORACLE |= {
    f"cap_{how}_infinite": f"""SELECT event_id, event_id % {every} = 0 AS endless,
        CASE WHEN event_id % {every} <> 0 THEN value END AS value FROM events"""
    for how, every in (("iqr", 3), ("zscore", 7))
}
ORACLE["quantiles_searched"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median,
        round(quantile_cont({c}, 0.75), 4) AS q3 FROM lineitem"""
    for c in ("l_extendedprice", "l_quantity")
)
