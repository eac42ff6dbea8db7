"""Generated people tables: clean rows, and clean rows with injected issues.

Choices come from digests of the row key, so the same key gives the same row in any
partitioning and any run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lustra.functions.columns import lit, lits, ref
from lustra.functions.frames import with_exprs

FIRST_NAMES = ("Ada", "Bela", "Chen", "Dora", "Emil", "Fay", "Gus", "Hana")
LAST_NAMES = ("Adams", "Brown", "Diaz", "Evans", "Kim", "Lee", "Novak", "White")
# Departments and value ranges of clean rows.
DEPARTMENTS = ("Engineering", "Finance", "Sales", "HR", "Operations", "Marketing")
AGE_RANGE = (24, 58)
SALARY_RANGE = (55000, 180000)

# Share of rows hit by each kind of issue.
ISSUE_RATES = {
    "age_null": 0.04,
    "age_blank": 0.03,
    "age_word": 0.02,
    "age_decimal": 0.02,
    "age_outlier": 0.02,
    "email_blank": 0.04,
    "email_broken": 0.02,
    "phone_null": 0.02,
    "phone_digits": 0.05,
    "phone_spaces": 0.05,
    "salary_blank": 0.02,
    "salary_outlier": 0.02,
    "date_slashes": 0.06,
    "date_reversed": 0.04,
    "department_alias": 0.05,
    "flag_word": 0.04,
    "exact_copy": 0.05,
    "near_copy": 0.03,
}
# Aliases that break a department label, and words that break a flag.
ALIASES = {"Engineering": "Eng", "HR": "hr", "Operations": "ops"}
FLAG_WORDS = {"true": "yes", "false": "0"}
_STEPS = 4096


class _Draws:
    """Independent draws from 0..4095, three hex digits of a digest of key and seed each."""

    def __init__(self, key: str, seed: int):
        self.key, self.seed = key, seed

    def __getitem__(self, at: int) -> str:
        digest = f"md5(concat(CAST({self.key} AS STRING), ':{self.seed}:{at // 10}'))"
        return f"CAST(conv(substring({digest}, {3 * (at % 10) + 1}, 3), 16, 10) AS BIGINT)"

    def pick(self, at: int, values: Sequence[str]) -> str:
        return f"array({lits(values)})[CAST({self[at]} % {len(values)} AS INT)]"


def people_from_keys(keys: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """One clean row per key, all columns text but the key."""
    d = _Draws(ref(key), seed)
    name = f"concat({d.pick(0, FIRST_NAMES)}, ' ', {d.pick(1, LAST_NAMES)})"
    (young, old), (low, high) = AGE_RANGE, SALARY_RANGE

    def digits(value: str, width: int) -> str:
        return f"lpad(CAST({value} AS STRING), {width}, '0')"

    phone = (digits(f"200 + {d[5]} % 800", 3), digits(f"{d[6]} % 1000", 3), digits(f"({d[5]} * 13 + {d[7]}) % 10000", 4))
    hired = (f"CAST(2015 + {d[8]} % 10 AS STRING)", digits(f"1 + {d[9]} % 12", 2), digits(f"1 + {d[10]} % 28", 2))
    return keys.selectExpr(
        f"CAST({ref(key)} AS BIGINT) AS k",
        f"CAST(1000 + {ref(key)} AS STRING) AS id",
        f"{name} AS name",
        f"CAST({young} + {d[2]} % {old - young + 1} AS STRING) AS age",
        f"concat(lower(replace({name}, ' ', '.')), '@example.com') AS email",
        f"concat_ws('-', {', '.join(phone)}) AS phone",
        f"CAST({low} + ({d[3]} * {_STEPS} + {d[4]}) % {high - low + 1} AS STRING) AS salary",
        f"concat_ws('-', {', '.join(hired)}) AS hire_date",
        f"{d.pick(11, DEPARTMENTS)} AS department",
        f"IF({d[12]} % 2 = 0, 'true', 'false') AS is_active",
    )


def synthesize_people(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    return people_from_keys(spark.range(1, n + 1), "id", seed)


def inject_issues(people: DataFrame, key: str = "k", seed: int = 11, rates: dict[str, float] | None = None) -> DataFrame:
    """Break cells and add copies; adds ``copy_no`` (0 original, 1 exact, 2 near copy).

    Copies are made of the broken row.  Near copies differ in the case or spacing of the name
    and in a second column.  One scan: copies come from a per-row array.
    """
    d = _Draws(ref(key), seed)
    rates = ISSUE_RATES | (rates or {})
    place = {issue: i for i, issue in enumerate(ISSUE_RATES)}

    def hit(issue: str) -> str:
        return f"{d[place[issue]]} < {round(rates[issue] * _STEPS)}"

    def broken(column: str, **values: str) -> str:
        cases = " ".join(f"WHEN {hit(issue)} THEN {value}" for issue, value in values.items())
        return f"CASE {cases} ELSE {column} END"

    parts = [f"substring(hire_date, {at}, {n})" for at, n in ((1, 4), (6, 2), (9, 2))]
    alias = " ".join(f"WHEN {lit(label)} THEN {lit(word)}" for label, word in ALIASES.items())
    flag = " ".join(f"WHEN {lit(value)} THEN {lit(word)}" for value, word in FLAG_WORDS.items())
    # Our own bad values: an unreadable age, and an age and a salary out of range.
    rows = with_exprs(
        people,
        {
            "age": broken(
                "age", age_null="NULL", age_blank="''", age_word="'forty-two'",
                age_decimal="concat(age, '.0')", age_outlier="'431'",
            ),
            "email": broken("email", email_blank="''", email_broken="replace(email, '@', '.')"),
            "phone": broken(
                "phone", phone_null="NULL", phone_digits="replace(phone, '-', '')", phone_spaces="replace(phone, '-', ' ')"
            ),
            "salary": broken("salary", salary_blank="''", salary_outlier="'-7250'"),
            "hire_date": broken(
                "hire_date", date_slashes=f"concat_ws('/', {', '.join(parts)})", date_reversed=f"concat_ws('-', {', '.join(parts[::-1])})"
            ),
            "department": broken("department", department_alias=f"CASE department {alias} ELSE lower(department) END"),
            "is_active": broken("is_active", flag_word=f"CASE is_active {flag} END"),
        },
    )
    copies = f"concat(array(0), IF({hit('exact_copy')}, array(1), array()), IF({hit('near_copy')}, array(2), array()))"
    style = f"{d[len(place)]} % 3"
    return with_exprs(
        rows.withColumn("copy_no", F.expr(f"explode({copies})")),
        {
            "name": f"CASE WHEN copy_no <> 2 THEN name WHEN {style} = 0 THEN replace(name, ' ', '  ') "
            f"WHEN {style} = 1 THEN lower(name) ELSE upper(name) END",
            "department": f"IF(copy_no = 2 AND {style} <> 1, lower(department), department)",
            "is_active": f"IF(copy_no = 2 AND {style} = 1, 'yes', is_active)",
        },
    )
