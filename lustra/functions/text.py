"""Text, date, phone and e-mail normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from lustra.functions.columns import lit, lits

# The characters Unicode-aware stripping removes.
WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Department aliases and their canonical labels.
DEPARTMENT_LABELS = {
    "engineering": "Engineering",
    "eng": "Engineering",
    "finance": "Finance",
    "sales": "Sales",
    "hr": "HR",
    "operations": "Operations",
    "ops": "Operations",
    "marketing": "Marketing",
}

# Date layouts tried in this order.
DATE_FORMATS = ("%Y-%m-%d", "%Y/%m/%d", "%d-%m-%Y", "%m/%d/%Y")

ISO_SHAPE = r"\A\d{4}-\d{2}-\d{2}\z"

# Fixed value: addresses that survive the e-mail repair rule (case-insensitive).
MAILBOX_PATTERN = r"(?iU)\A[\w.+-]+@[\w-]+\.[a-z]{2,}\n?\z"

# Takes no part in any real text; marks the spaces that title casing adds and removes.
_MARK = "\u0001"


def strip(x: str) -> str:
    return f"btrim({x}, {lit(WHITESPACE)})"


def normalize_text(x: str) -> str:
    """Strip, lower-case, and collapse inner whitespace; null stays null."""
    return f"regexp_replace(lower({strip(x)}), {lit(f'[{WHITESPACE}]+')}, ' ')"


def normalize_email(x: str) -> str:
    return f"lower({strip(x)})"


def _marked_title(x: str) -> str:
    """Title case of any text.

    ``initcap`` only starts a word after a space, so a marked space is put before every
    other run of cased letters and taken out again afterwards.
    """
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    split = f"regexp_replace({x}, {lit(f'(?<=[^{cased}])(?=[{cased}])')}, {lit(_MARK + ' ')})"
    return f"replace(initcap({split}), {lit(_MARK + ' ')}, '')"


def title_case(x: str) -> str:
    """Capital after every character that has no case, lower elsewhere."""
    return f"CASE WHEN {x} RLIKE {lit(r'\A[A-Za-z ]*\z')} THEN initcap({x}) ELSE {_marked_title(x)} END"


def canonical_label(x: str, labels: Mapping[str, str] = DEPARTMENT_LABELS) -> str:
    """Alias lookup on the stripped lower-case value; title case when unknown."""
    if not labels:
        return _marked_title(strip(x))
    settled = sorted({v for v in labels.values() if labels.get(v.lower()) == v})
    known = f"try_element_at(map({lits(part for pair in labels.items() for part in pair)}), lower({strip(x)}))"
    looked_up = f"coalesce({known}, {_marked_title(strip(x))})"
    return f"CASE WHEN {x} IN ({lits(settled)}) THEN {x} ELSE {looked_up} END" if settled else looked_up


_PARTS = {"%Y": r"(\d{4})", "%m": r"(\d{1,2})", "%d": r"(\d{1,2})"}


def _layout(fmt: str) -> tuple[str, list[str]]:
    """Regex of a ``%Y``/``%m``/``%d`` layout and the parts its groups hold."""
    groups, pattern, rest = [], "", fmt
    while rest:
        token = rest[:2]
        if token in _PARTS:
            groups.append(token)
            pattern, rest = pattern + _PARTS[token], rest[2:]
        else:
            pattern, rest = pattern + "\\" + rest[0], rest[1:]
    return pattern, groups


def parse_date(x: str, *formats: str) -> str:
    """Date by the first layout that gives a real one, null otherwise.

    Layouts of different shapes share one regex that also brings the parts into ISO order;
    testing the shape first keeps failed parses cheap.
    """
    batches: list[dict[str, list[str]]] = [{}]
    for fmt in formats:
        pattern, groups = _layout(fmt)
        if pattern in batches[-1]:
            batches.append({})
        batches[-1][pattern] = groups
    tried = []
    for batch in batches:
        held = [token for groups in batch.values() for token in groups]
        iso = "-".join("".join(f"${i + 1}" for i, t in enumerate(held) if t == token) for token in _PARTS)
        pattern = lit(rf"\A(?:{'|'.join(batch)})\z")
        tried.append(f"CASE WHEN {x} RLIKE {pattern} THEN try_cast(regexp_replace({x}, {pattern}, {lit(iso)}) AS DATE) END")
    return f"coalesce({', '.join(tried)})" if len(tried) > 1 else tried[0]


def format_date(x: str, formats: Sequence[str] = DATE_FORMATS) -> str:
    """First layout that gives a real date, as ISO text; anything else unchanged."""
    first, *rest = formats
    if first != "%Y-%m-%d" or not rest:
        return f"coalesce(CAST({parse_date(x, *formats)} AS STRING), {x})"
    # A full ISO shape comes out as it went in, whether or not it is a real date.
    parsed = f"coalesce(CAST({parse_date(x, *formats)} AS STRING), {x})"
    return f"CASE WHEN {x} RLIKE {lit(ISO_SHAPE)} THEN {x} ELSE {parsed} END"


def format_phone(x: str) -> str:
    """``ddd-ddd-dddd`` when exactly ten digits are present, else unchanged."""
    pattern = r"(?U)\A\D*" + r"(\d)\D*" * 10 + r"\z"
    return f"regexp_replace({x}, {lit(pattern)}, '$1$2$3-$4$5$6-$7$8$9$10')"


def valid_email_or_null(x: str) -> str:
    return f"CASE WHEN {x} RLIKE {lit(MAILBOX_PATTERN)} THEN {x} END"


def derive_email(name: str, domain: str = "example.com") -> str:
    """``first.last@domain`` from a name; a single word gives ``first@domain``."""
    clean = normalize_text(f"replace({name}, {lit(chr(39))}, '')")
    whole = f"regexp_replace({clean}, '^([^ ]*)(?: .*)? ([^ ]*)$', '$1.$2')"
    return f"concat({whole}, {lit('@' + domain)})"
