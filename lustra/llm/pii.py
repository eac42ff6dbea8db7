"""Surrogates for personal data: keyed replacements of the same kind, gender, script and format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.llm.words import computed, renamed_in, without
from lustra.session import stage

PATIENCE = 2  # redraws before a surrogate grows by a character each
ROUNDS = 60  # redraws at most; words of a name grow from the first on, so only exhausted formats come near

# Forms of address by gender, in Latin and Cyrillic script.
MALE = ("Mr", "Mister", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа", "Г-жа")

_NAME = r"(?:\p{Lu}[\p{Ll}\p{M}]+(?:[-’']\p{Lu}[\p{Ll}]+)?)"
#: kind -> pattern; the first that matches at a place wins there, so the order counts.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,24}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{3,4}[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4})?(?![0-9])",
    "name": rf"(?<!\p{{L}})(?:{'|'.join(MALE + FEMALE)})\.? {_NAME}(?: {_NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these holds no entity.
HINT = rf"[0-9@]|{'|'.join(MALE + FEMALE)}|[a-f]{{32}}|[A-F]{{32}}"
RESULT = ("n_entities", "kinds")

#: script -> (letters of its names as a class, consonants, vowels, endings of men's and women's names).
SCRIPTS = {
    "latin": (r"\p{IsLatin}", "bdfgklmnprstv", "aeiou", "o", "a"),
    "cyrillic": (r"\p{IsCyrillic}", "бвгдклмнпрст", "аеиоу", "ов", "ова"),
    "greek": (r"\p{IsGreek}", "βγδκλμνπρστφ", "αειου", "ος", "α"),
}
_SMALL = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
_SEPARATOR = "[ ’'-]"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind_of(value: str) -> str:
    """Kind of an entity text: the first pattern that matches it whole."""
    tests = "".join(f" WHEN {value} rlike {_literal('^(?:' + p.replace('(?<![0-9A-Za-z])', '').replace('(?![0-9A-Za-z])', '') + ')$')} THEN '{k}'" for k, p in PATTERNS.items())
    return f"CASE{tests} ELSE 'phone' END"


def _draw(seed: str, place: str, n: str | int) -> str:
    """A number below ``n`` for a place of an entity: part of a keyed digest."""
    return f"CAST(conv(substr(md5(concat({seed}, '/', {place})), 1, 12), 16, 10) AS BIGINT) % {n}"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _chars(text: str) -> str:
    return f"filter(split({text}, ''), __x -> __x != '')"


def _spelled(value: str, seed: str, whole: str | None = None) -> str:
    """Every digit, and every letter within its script and case, drawn anew; anything else stays.

    Letters of other scripts are drawn from those of the value itself (or of ``whole``).
    """
    pick = lambda letters: f"substr('{letters}', 1 + CAST({_draw(seed, 'i', len(letters))} AS INT), 1)"
    own = f"regexp_replace({whole or value}, {_literal('[^' + chr(92) + 'p{L}]')}, '')"
    cases = [("^[0-9]$", pick("0123456789"))]
    for script, letters in _SMALL.items():
        cases += [(rf"^(?=\p{{Ll}}){SCRIPTS[script][0]}$", pick(letters)), (rf"^(?=\p{{Lu}}){SCRIPTS[script][0]}$", pick(letters.upper()))]
    cases.append((r"^\p{L}$", f"substr({own}, 1 + CAST({_draw(seed, 'i', f'length({own})')} AS INT), 1)"))
    tests = "".join(f" WHEN c rlike {_literal(p)} THEN {drawn}" for p, drawn in cases)
    return f"array_join(transform({_chars(value)}, (c, i) -> CASE{tests} ELSE c END), '')"


def _longer(attempt: str | int, seed: str, letters: str) -> str:
    """So many letters more as redraws have gone beyond PATIENCE."""
    return f"""IF({attempt} > {PATIENCE}, array_join(transform(sequence(1, greatest({attempt} - {PATIENCE}, 1)),
        j -> substr('{letters}', 1 + CAST({_draw(seed, "concat('more', j)", len(letters))} AS INT), 1)), ''), '')"""


def _luhn(digits: str) -> str:
    """Sum of the check: every second digit from the right doubled, tens and ones added."""
    twice = "(CAST(c AS INT) * 2) DIV 10 + (CAST(c AS INT) * 2) % 10"
    return f"aggregate({_chars(f'reverse({digits})')}, struct(0L AS s, 0 AS k), (a, c) -> struct(a.s + CAST(if(a.k % 2 = 1, {twice}, CAST(c AS INT)) AS BIGINT) AS s, a.k + 1 AS k), a -> a.s)"


def _mod97(text: str) -> str:
    """Rest by 97 of a number whose letters stand for 10 to 35."""
    value = "CAST(conv(c, 36, 10) AS INT)"
    return f"aggregate({_chars(text)}, 0, (a, c) -> IF(c rlike '[0-9]', a * 10 + {value}, a * 100 + {value}) % 97)"


def _syllables(kind: str, canon: str, attempt: str | int, seed: str) -> str:
    """A name of drawn syllables, one more each redraw, with the ending of its gender, in its script."""
    by = lambda at, other: "CASE split(" + kind + ", '/')[2] " + " ".join(f"WHEN '{k}' THEN '{v[at]}'" for k, v in SCRIPTS.items()) + f" ELSE {other} END"
    one = lambda what, letters: f"substr({letters}, 1 + CAST({_draw(seed, f"concat('{what}', j)", f'length({letters})')} AS INT), 1)"
    syllable = f"concat({one('c', '__c')}, {one('v', '__v')})"
    body = f"array_join(transform(sequence(1, 2 + {attempt}), j -> {syllable}), '')"
    last = f"transform(array(0), j -> {one('end', '__c')})[0]"
    ending = f"IF(split({kind}, '/')[1] = 'f', {by(4, _literal(''))}, {by(3, _literal(''))})"
    return _let("__c", by(1, canon), _let("__v", by(2, canon), f"concat({body}, {last}, {ending})"))


def surrogate(kind: str, canon: str, attempt: str | int, key: str) -> str:
    """Surrogate of an atom as an expression of its kind, canonical form and attempt alone.

    The draw depends on a keyed digest, so equal atoms get equal surrogates in every document and rerun.  A card and
    an IBAN keep their check if it holds, an address four valid octets, a host its top-level domain, a phone its
    country code.
    """
    seed = f"sha2(concat({_literal(key)}, '/', {kind}, '/', {canon}, '/', {attempt}), 256)"
    more = lambda letters: _longer(attempt, "__s", letters)
    digits, small = "0123456789", _SMALL["latin"]
    local, top = f"substring_index({canon}, '@', 1)", f"substring_index({canon}, '.', -1)"
    host = f"concat({_spelled(f'substr({canon}, 1, length({canon}) - length({top}) - 1)', '__s')}, {more(small)}, '.', {top})"
    octets = ", '.', ".join(f"1 + {_draw('__s', _literal(str(k)), n)}" for k, n in enumerate((223, 254, 254, 254)))
    number = f"concat({_spelled(canon, '__s')}, {more(digits)})"
    body = "substr(__n, 1, length(__n) - 1)"
    check = f"CAST((10 - ({_luhn(f'concat({body}, {_literal("0")})')}) % 10) % 10 AS STRING)"
    card = _let("__n", number, f"IF(({_luhn(canon)}) % 10 = 0, concat({body}, {check}), __n)")
    country, rest = f"substring_index({canon}, '/', 1)", f"substring_index({canon}, '/', -1)"
    phone = f"concat({country}, '/', {_spelled(rest, '__s')}, {more(digits)})"
    bank = f"substr({canon}, 1, 2)"
    valid = f"{_mod97(f'concat(substr({canon}, 5), substr({canon}, 1, 4))')} = 1"
    two = f"lpad(CAST(98 - {_mod97(f'concat(__n, {bank}, {_literal("00")})')} AS STRING), 2, '0')"
    iban = _let("__n", f"concat({_spelled(f'substr({canon}, 5)', '__s')}, {more(digits)})", f"concat({bank}, IF({valid}, {two}, {_spelled(f'substr({canon}, 3, 2)', '__s')}), __n)")
    cases = {
        "email": f"concat({_spelled(local, '__s')}, {more(small)})", "host": host, "ip": f"concat({octets})", "card": card, "phone": phone, "iban": iban,
        "secret": f"substr(__s, 1, length({canon}))",
    }
    tests = "".join(f" WHEN {kind} = '{k}' THEN {x}" for k, x in cases.items())
    return _let("__s", seed, f"CASE{tests} WHEN startswith({kind}, 'word/') THEN {_syllables(kind, canon, attempt, '__s')} ELSE {number} END")


def _entities(text: str) -> str:
    return f"if({text} rlike {_literal(HINT)}, regexp_extract_all({text}, {_literal(ANY)}, 0), CAST(array() AS ARRAY<STRING>))"


def entity_table(docs: DataFrame) -> DataFrame:
    """(kind, value) of every distinct entity of the texts, as written."""
    found = docs.select(F.explode(F.expr(_entities("text"))).alias("value")).distinct()
    return found.select(F.expr(kind_of("value")).alias("kind"), "value")


def canonical(kind: str, value: str) -> str:
    """What all ways of writing an entity have in common: digits alone, a phone's country apart, small letters."""
    country = f"regexp_extract({value}, '^(\\\\+[0-9]{{1,3}})[ .(-]', 1)"
    rest = f"regexp_replace(substr({value}, length({country}) + 1), '[^0-9]', '')"
    return f"""CASE WHEN {kind} IN ('card', 'ssn') THEN regexp_replace({value}, '[^0-9]', '') WHEN {kind} = 'iban' THEN replace({value}, ' ', '')
        WHEN {kind} = 'phone' THEN concat({country}, '/', {rest}) ELSE lower({value}) END"""


_TITLE = "^(" + "|".join(MALE + FEMALE) + r")\.? "


def _names(value: str) -> str:
    """The words of a name without its form of address."""
    return f"regexp_replace({value}, {_literal(_TITLE)}, '')"


def _word_kind(value: str, word: str) -> str:
    gender = f"IF({value} rlike {_literal('^(' + '|'.join(FEMALE) + r')\.? ')}, 'f', 'm')"
    script = "CASE " + " ".join(f"WHEN {word} rlike {_literal('^' + v[0])} THEN '{k}'" for k, v in SCRIPTS.items()) + " ELSE 'other' END"
    return f"concat('word/', {gender}, '/', {script})"


def atom_table(entities: DataFrame) -> DataFrame:
    """(kind, canon) of the distinct atoms of entities: what gets a surrogate of its own.

    An address has its host for one, a name each of its words; all others are one atom.
    """
    words = f"transform(split({_names('value')}, {_literal(_SEPARATOR)}), w -> struct({_word_kind('value', 'w')} AS kind, lower(w) AS canon))"
    host = "struct('host' AS kind, lower(substring_index(value, '@', -1)) AS canon)"
    own = f"struct(kind AS kind, {canonical('kind', 'value')} AS canon)"
    atoms = f"CASE kind WHEN 'name' THEN {words} WHEN 'email' THEN array({own}, {host}) ELSE array({own}) END"
    return entities.select(F.explode(F.expr(atoms)).alias("a")).select("a.*").distinct()


def redrawn(atoms: DataFrame, key: str) -> DataFrame:
    """(atom, surrogate) of the atoms whose first draw collides, with draws that do not; ``atom`` is kind/canon.

    A draw collides if it is an atom of the corpus or the draw of another one, of which the earliest round and
    then the smallest name keeps it.  Losers draw again, against all draws made; names grow by a syllable a
    round, and after PATIENCE rounds others by a letter or digit.  Each round handles only the losers.
    """
    # Two mail names collide only within their host; names of both genders are one kind of word.
    claim = "CASE WHEN kind = 'email' THEN concat('email/', {0}, '@', substring_index(canon, '@', -1)) WHEN startswith(kind, 'word/') THEN concat('word/', {0}) ELSE concat(kind, '/', {0}) END AS word"
    own = "CASE WHEN kind = 'email' THEN substring_index(canon, '@', 1) ELSE canon END"
    named = atoms.withColumn("atom", F.expr("concat(kind, '/', canon)"))

    def drawn_by(rows: DataFrame, attempt: int) -> DataFrame:
        return stage(rows.withColumn("surrogate", F.expr(surrogate("kind", "canon", attempt, key))), "surrogates")

    def claims(rows: DataFrame, attempt: int) -> DataFrame:
        return rows.selectExpr(claim.format("surrogate"), f"struct({attempt} AS round, atom) AS by")

    def judged(rows: DataFrame, taken: DataFrame, attempt: int) -> DataFrame:
        owner = taken.groupBy("word").agg(F.min("by").alias("owner"))
        asked = rows.selectExpr("*", claim.format("surrogate").replace(" AS word", " AS __word"))
        return asked.join(owner, F.expr("__word = word")).selectExpr("kind", "canon", "atom", "surrogate", f"owner.round = {attempt} AND owner.atom = atom AS own")

    drawn = drawn_by(named, 0)
    taken = claims(drawn, 0).unionAll(drawn.selectExpr(claim.format(own), "struct(-1 AS round, atom) AS by"))
    lost, out = stage(judged(drawn, taken, 0).filter("NOT own").select("kind", "canon", "atom"), "collisions"), None
    for attempt in range(1, ROUNDS):
        if lost.isEmpty():
            break
        again = drawn_by(lost, attempt)
        taken = claims(again, attempt).unionAll(taken)
        settled = stage(judged(again, taken, attempt), "settled")
        kept = settled.filter("own").select("atom", "surrogate")
        out = kept if out is None else out.unionAll(kept)
        lost = settled.filter("NOT own").select("kind", "canon", "atom")
    else:
        raise ValueError("there are more entities of a format than it can write")
    return stage(out, "overrides") if out is not None else atoms.sparkSession.createDataFrame([], "atom string, surrogate string")


def _recased(value: str, drawn: str) -> str:
    """``drawn`` with capitals where ``value`` has them."""
    return f"array_join(zip_with({_chars(value)}, {_chars(drawn)}, (c, d) -> coalesce(IF(c rlike {_literal('^' + chr(92) + 'p{Lu}')}, upper(d), d), '')), '')"


def _laid_out(value: str, drawn: str) -> str:
    """The characters of ``drawn`` in place of the letters and digits of ``value``; what is left over goes behind."""
    step = "IF(c rlike '[0-9A-Za-z]', struct(concat(a.t, substr(__d, a.i, 1)) AS t, a.i + 1 AS i), struct(concat(a.t, c) AS t, a.i AS i))"
    return _let("__d", drawn, f"aggregate({_chars(value)}, struct('' AS t, 1 AS i), (a, c) -> {step}, a -> concat(a.t, substr(__d, a.i)))")


def replacement(kind: str, value: str, overrides: str, key: str) -> str:
    """What a mention is replaced by: the surrogates of its atoms in its own format."""

    def of(k: str, canon: str) -> str:
        # Bound, since both are used many times.
        return _let("__k", k, _let("__o", canon, f"coalesce({overrides}[concat(__k, '/', __o)], {surrogate('__k', '__o', 0, key)})"))

    at = f"locate('@', {value})"
    local, host = f"substr({value}, 1, {at} - 1)", f"substr({value}, {at} + 1)"
    email = f"concat({_recased(local, of(_literal('email'), f'lower({value})'))}, '@', {_recased(host, of(_literal('host'), f'lower({host})'))})"
    pieces = f"regexp_extract_all({_names(value)}, {_literal(_SEPARATOR + '|[^' + _SEPARATOR[1:] + '+')}, 0)"
    words = f"transform({pieces}, w -> IF(w rlike {_literal('^' + _SEPARATOR + '$')}, w, initcap({of(_word_kind(value, 'w'), 'lower(w)')})))"
    name = f"concat(substr({value}, 1, length({value}) - length({_names(value)})), array_join({words}, ''))"
    plain = of(kind, canonical(kind, value))
    secret = f"IF({value} rlike '[A-F]', upper({plain}), {plain})"
    return f"""CASE {kind} WHEN 'email' THEN {email} WHEN 'name' THEN {name} WHEN 'secret' THEN {secret} WHEN 'ip' THEN {plain}
        ELSE {_laid_out(value, f"regexp_replace({plain}, '[+/]', '')")} END"""


_OWN = ("__found", "__redrawn", "__kinds", "__new", "__id", "__hash", "__pairs", "__held")


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with entities of ``text`` replaced, n_entities and kinds (a sorted array of those found).

    ``key`` is secret: who knows it can test guesses.  One entity has one surrogate in the whole corpus however it is
    written: numbers go by their digits, addresses by small letters, and each word of a name by itself, so that a
    person named in full and by family name stays one.  Two entities never share a surrogate, and no surrogate is an entity of
    the corpus.  Kind, gender (by form of address), script and format stay: names are Latin, Cyrillic or Greek
    syllables, in any other script letters of their own; lengths stay but for names and where a format runs out.
    Names are found behind a form of address only.

    Null texts stay null and empty ones empty with no entities; a null id is like any other; repeated rows get
    the same text; all other columns stay, whatever their names, and n_entities and kinds replace input columns of
    those names; an empty table gives an empty one.
    """
    if not key:
        raise ValueError("surrogates need a key")
    rest, back = renamed_in(without(docs, RESULT), _OWN)
    overrides = redrawn(atom_table(entity_table(docs)), key)
    out = computed(rest, {"__found": _entities("text")})
    out = computed(out, {"__kinds": f"transform(__found, e -> {kind_of('e')})"})
    if overrides.isEmpty():
        out = out.withColumn("__redrawn", F.expr("CAST(map() AS MAP<STRING, STRING>)"))
    else:
        # Only documents that hold a redrawn atom get a map, known by id and hash of the text.
        found = docs.selectExpr("doc_id AS __id", "xxhash64(text) AS __hash", f"explode(array_distinct({_entities('text')})) AS value")
        atoms = found.selectExpr("__id", "__hash", "value", f"{kind_of('value')} AS kind")
        words = f"transform(split({_names('value')}, {_literal(_SEPARATOR)}), w -> concat({_word_kind('value', 'w')}, '/', lower(w)))"
        own = f"concat(kind, '/', {canonical('kind', 'value')})"
        held = f"CASE kind WHEN 'name' THEN {words} WHEN 'email' THEN array({own}, concat('host/', lower(substring_index(value, '@', -1)))) ELSE array({own}) END"
        atoms = atoms.select("__id", "__hash", F.explode(F.expr(held)).alias("atom"))
        maps = atoms.join(overrides, "atom").groupBy("__id", "__hash").agg(F.expr("collect_set(struct(atom, surrogate)) AS __pairs"))
        maps = maps.withColumnsRenamed({"__id": "__held", "__hash": "__hash"})
        out = out.join(maps, F.expr("doc_id <=> __held AND xxhash64(text) = __hash"), "left")
        out = out.withColumn("__redrawn", F.expr("coalesce(map_from_entries(__pairs), CAST(map() AS MAP<STRING, STRING>))"))
        out = out.drop("__held", "__hash", "__pairs")
    replaced = replacement("__m.k", "__m.e", "__redrawn", key)
    out = computed(out, {"__new": f"transform(zip_with(__found, __kinds, (e, k) -> struct(e, k)), __m -> {replaced})"})
    # The text between the entities, then what replaces them, in turn.
    joined = f"array_join(zip_with(split(text, {_literal(ANY)}, -1), __new, (t, s) -> concat(t, coalesce(s, ''))), '')"
    out = out.withColumn("text", F.expr(f"if(size(__found) = 0, text, {joined})"))
    out = out.withColumn("n_entities", F.expr("CAST(size(__found) AS BIGINT)")).withColumn("kinds", F.expr("array_sort(array_distinct(__kinds))"))
    return out.drop("__found", "__redrawn", "__kinds", "__new").withColumnsRenamed(back)
