"""Every operator against a plain version: whole given tables, and small tables of odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from brute import WORD, base_row, cut_repeats, hits, near, revisits, targets, thin_lines, tokens
from lustra.llm import chat, components, jaccard, lines, mixing, pii, quality, queries, suffixes, warc, wumanber
from lustra.llm import tokens as unigram

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, name):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def prose(seed, n, letters="abcdefgh"):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n))


def edited(text, seed, changes):
    rnd, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[rnd.randrange(len(words))] = f"x{rnd.randrange(9)}"
    return " ".join(words)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, copies, near copies, repeated lines, one very long text."""
    base, passage = prose(1, 120), prose(2, 40)
    rows = [(0, None), (1, ""), (2, " \t\n \x0b\x0c\r "), (3, "one"), (4, "ONE"), (5, "a b c d"), (6, "A b  c\td"), (7, base), (8, base)]
    rows += [(10 + k, edited(base, k, k % 7)) for k in range(40)]
    rows += [(60 + k, prose(100 + k, 30) + "\n" + passage + "\n" + prose(200 + k, 30)) for k in range(6)]
    rows += [(70, "l1\nl2\nl3\nl4"), (71, "l0\nl1\nl2\nl3\nl5"), (72, "x\n" * 9), (73, "\n\n\n\n"), (74, "l2\nl3\nl4")]
    rows += [(80, "ab" * 300), (81, prose(5, 4000)), (82, "Grüße 😀 " * 40), (83, "\0" * 150), (84, "a" * 99), (85, "a" * 100), (86, "a" * 101)]
    rows += [(90 + k, edited(prose(9, 9), k, k % 3)) for k in range(9)]
    rows += [(110 + k, f"{prose(10, 6)} {k % 2}") for k in range(4)]
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 5 else None, 0) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ------------------------------------------------------------------ 1


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_counts(spark, odd):
    want = {i: base_row(t) for i, t in pairs(odd)}
    assert by_id(quality.base_counts(odd), *COUNTS) == want
    got = by_id(queries.QUERIES["op1_quality_rules"](spark, SF), *COUNTS)
    assert got == {r[0]: base_row(r[1]) for r in table(spark, "documents")}


def plain_scores(docs, trusted):
    """{doc_id: mean log ratio of its words and neighbouring words}, hashed as Spark does."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    word = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    pair = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
    grams = {}
    for i, text in docs:
        hashes = [word(w) for w in WORD.findall(text or "")]
        grams[i] = [signed(h) % quality.BUCKETS for h in [*hashes, *(pair(a, b) for a, b in zip(hashes, hashes[1:]))]]
    raw = Counter(b for held in grams.values() for b in held)
    target = Counter(b for i, held in grams.items() if i in trusted for b in held)
    share = sum(target.values()) / sum(raw.values())
    ratio = {b: math.log((target[b] + quality.SMOOTH) / (n * share + quality.SMOOTH)) for b, n in raw.items()}
    return {i: sum(ratio[b] for b in held) / len(held) if held else 0.0 for i, held in grams.items()}


def test_quality_scores(spark):
    docs = [(r[0], r[1]) for r in table(spark, "documents")]
    trusted = {r[0] for r in table(spark, "labels") if r[1] == 1}
    want = plain_scores(docs, trusted)
    got = by_id(queries.QUERIES["op1_quality_rules"](spark, SF), "score", "kept", "base_failed")
    for i, _ in docs:
        score, kept, failed = got[i]
        assert score == pytest.approx(want[i], abs=1e-9) and kept == (not failed and want[i] >= quality.KEEP_FROM)


def test_quality_keeps_clean_and_drops_junk(spark):
    sf = "/root/testdata/sf0.01"
    judged = queries.QUERIES["op1_quality_rules"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = judged.join(labels, "doc_id").filter("NOT base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.15 * len(bad)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_quality_keeps_clean_documents_the_target_lacks(spark, sf):
    """Documents without a label, and labelled ones held out of the target, are clean if they have no symbol."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet") for name in ("documents", "labels"))
    unlabelled = quality.judge(docs, quality.trusted_ids(labels)).join(labels, "doc_id", "left_anti")
    held_out = quality.judge(docs, quality.trusted_ids(labels.filter("doc_id % 10 != 3"))).join(labels.filter("doc_id % 10 = 3 AND quality = 1"), "doc_id", "left_semi")
    for judged in (unlabelled, held_out):
        kept = [r["kept"] for r in judged.filter("NOT base_failed AND n_symbols = 0").select("kept").collect()]
        assert len(kept) > 3 and sum(kept) >= 0.99 * len(kept)


def test_quality_stage_and_empty(spark, odd, nothing):
    labels = spark.createDataFrame([(k, 1) for k in range(7, 50)] + [(7, 1), (None, 1), (81, 0)], "doc_id long, quality int")
    clash = odd.withColumnRenamed("n_chars", "kept")
    out = quality.kept_documents(clash, quality.trusted_ids(labels))
    assert out.columns == clash.columns and 0 < out.count() < odd.count()
    assert quality.judge(nothing, quality.trusted_ids(labels.limit(0))).count() == 0


# ------------------------------------------------------------------ 2


KEY = "a key"


def test_surrogates(spark, nothing):
    texts = [
        (1, "mail ada.long@mail7.example.com or +1 (017) 555-7713, card 4111 1111 1111 1111"),
        (2, "again ada.long@mail7.example.com and bob@mail7.example.com from 97.51.17.173"),
        (3, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" Mrs. Vera Long met Mr Tom Hill'),
        (4, "Госпожа Иванова и Господин Петров"), (5, None), (6, ""), (7, "no entity here"), (7, "no entity here"),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS n_entities")
    got = {r["doc_id"]: r for r in pii.pseudonymize(df, KEY).collect()}
    assert got[5]["text"] is None and got[6]["text"] == "" and got[7]["text"] == "no entity here"
    assert got[1]["kinds"] == ["card", "email", "phone"] and got[1]["n_entities"] == 3
    for i, text in texts[:4]:
        assert got[i]["text"] != text
    mail = got[1]["text"].split()[1]
    assert mail == got[2]["text"].split()[1] and mail.endswith(".com") and mail != got[2]["text"].split()[3]
    assert mail.split("@")[1] == got[2]["text"].split()[3].split("@")[1]
    digits = [int(c) for c in got[1]["text"].split("card ")[1].replace(" ", "")]
    assert len(digits) == 16 and sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
    assert got[1]["text"].split("or ")[1].startswith("+1 (")
    woman, man = got[3]["text"].split("Mrs. ")[1].split(" met Mr ")
    assert all(w[0].isupper() and w.endswith("a") for w in woman.split()) and all(w.endswith("o") for w in man.split())
    assert got[4]["text"].split()[1].endswith("ова") and got[4]["text"].split()[4].endswith("ов")
    assert pii.pseudonymize(nothing, KEY).count() == 0


def test_surrogates_of_a_small_space_stay_distinct(spark):
    """Nearly all values of a kind are taken, so most draws collide."""
    values = [f"{a}.{b}.0.1" for a in range(1, 30) for b in range(1, 30)] + [f"00{k}-00-0000" for k in range(10)]
    df = spark.createDataFrame([(i, f"x {v} y") for i, v in enumerate(values)], "doc_id long, text string")
    out = [r["text"] for r in pii.pseudonymize(df, KEY).collect()]
    assert len(set(out)) == len(values) and not {t.split()[1] for t in out} & set(values)


def test_surrogates_of_other_scripts_stay_distinct(spark):
    """Values that sort after all ASCII texts: redraws must not take what another entity holds."""
    small, names = "абвгдежзиклмнопрстуфхцчшэюя", set()
    rnd = random.Random(8)
    while len(names) < 5000:
        names.add("Господин " + rnd.choice(small).upper() + "".join(rnd.choice(small) for _ in range(rnd.randint(3, 7))))
    values = sorted(names) + [f"{x}{y}@почта.example.com" for x in "эюя" for y in small]
    df = spark.createDataFrame([(i, f"{v} .") for i, v in enumerate(values)], "doc_id long, text string")
    out = [r["text"] for r in pii.pseudonymize(df, KEY).collect()]
    assert len(set(out)) == len(values) and not {t[:-2] for t in out} & set(values)


def replaced(spark, texts, key=KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pii.pseudonymize(df, key).orderBy("doc_id").collect()]


def test_surrogates_of_one_entity_agree_however_written(spark):
    out = replaced(spark, ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111", "Ada@x.org", "ada@x.org", "ADA@X.ORG", "+1 (017) 555-7713", "+1 017-555-7713", "+1.017.555.7713"])
    assert len({t.replace(" ", "").replace("-", "") for t in out[:3]}) == 1 and out[0][4] == " " and out[2][4] == "-"
    assert len({t.lower() for t in out[3:6]}) == 1 and out[3][0].isupper() and out[5].isupper() and out[4].islower()
    assert len({re.sub("[^0-9]", "", t) for t in out[6:]}) == 1 and out[6].startswith("+1 (") and out[8].startswith("+1.")
    full, family, other, wife = replaced(spark, ["Mr Tom Hill .", "Mr. Hill .", "Mr Tom Long .", "Mrs Hill ."])
    assert full.split()[2] == family.split()[1] and full.split()[1] == other.split()[1] != other.split()[2]
    assert full.split()[2].endswith("o") and wife.split()[1].endswith("a") and family.startswith("Mr. ")
    assert replaced(spark, ["Mr Tom Hill"], "another key") != replaced(spark, ["Mr Tom Hill"])
    with pytest.raises(ValueError):
        pii.pseudonymize(spark.createDataFrame([], "doc_id long, text string"), "")


def test_surrogates_keep_script_check_and_format(spark):
    greek, double, armenian = replaced(spark, ["Mr Γιώργος Παπάς", "Mrs Vera Long-Hill", "Mr Արամ Հակոբյան"])
    assert all(0x370 <= ord(c) < 0x400 for w in greek.split()[1:] for c in w) and all(w.endswith("ος") for w in greek.split()[1:])
    assert re.fullmatch("Mrs [A-Z][a-z]+a [A-Z][a-z]+a-[A-Z][a-z]+a", double)
    assert all(0x530 <= ord(c) < 0x590 for w in armenian.split()[1:] for c in w) and armenian != "Mr Արամ Հակոբյան"
    (iban, wrong) = replaced(spark, ["DE89 3704 0044 0532 0130 00", "DE12 3704 0044 0532 0130 00"])
    number = lambda t: int("".join(str(int(c, 36)) for c in t.replace(" ", "")[4:] + t[:4])) % 97
    assert iban.startswith("DE") and [len(p) for p in iban.split()] == [4, 4, 4, 4, 4, 2] and number(iban) == 1 and wrong != iban


def test_surrogate_hosts_stay_distinct(spark):
    hosts = [f"{a}{b}.org" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"][:600]
    out = replaced(spark, [f"me@{h}" for h in hosts])
    assert len({t.split("@")[1] for t in out}) == 600 and not {t.split("@")[1] for t in out} & set(hosts)


def test_surrogates_of_many_names_stay_names(spark):
    """More one-word names than the shortest surrogates can tell apart."""
    df = spark.range(100_000).selectExpr("id AS doc_id", "concat('Mr ', initcap(translate(conv(id + 1000000, 10, 20), '0123456789ABCDEFGHIJ', 'abcdefghijklmnopqrst')), ' .') AS text")
    found = pii.pseudonymize(df, KEY).selectExpr("count(DISTINCT text) AS n", "bool_and(text rlike '^Mr [A-Z][a-z]+o [.]$') AS named").first()
    assert (found["n"], found["named"]) == (100_000, True)


def test_surrogates_of_odd_rows(spark):
    rows = [(None, "Mr Tom Hill met Mr Hill", 1), (None, "Mr Tom Hill met Mr Hill", 2), (1, None, 3), (2, "", 4), (3, "x" * 50_000 + " Mr Hill", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __found long").selectExpr("*", "__found AS __id", "__found AS kinds")
    got = sorted(pii.pseudonymize(df, KEY).collect(), key=lambda r: r["__found"])
    assert [r["__id"] for r in got] == [1, 2, 3, 4, 5] and got[0]["text"] == got[1]["text"] != rows[0][1]
    assert (got[2]["text"], got[3]["text"], got[2]["n_entities"], got[4]["kinds"]) == (None, "", 0, ["name"])


def test_surrogates_leave_no_entity(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["value"] for r in pii.entity_table(docs).collect()}
    after = {r["value"] for r in pii.entity_table(queries.QUERIES["op2_surrogates"](spark, sf)).collect()}
    assert before and not before & after and len(after) == len(before)


# ------------------------------------------------------------------ 3


def test_decontamination(spark, odd, nothing):
    text = prose(5, 4000)
    items = [(1, " ".join(text.split()[50:75]).upper()), (2, prose(2, 40)), (3, "one"), (3, "ONE!"), (4, None), (5, "?"), (None, "a b c"), (10, prose(77, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    names = [(n if n is not None else "null", t) for n, t in items]
    want = {i: hits(t, names) for i, t in pairs(odd)}
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    clash = odd.withColumnRenamed("lang", "n_hit")
    assert by_id(wumanber.find_benchmark(clash, bench), *columns) == want
    assert by_id(wumanber.find_benchmark(odd, bench, pass_bytes=60), *columns) == want
    out = wumanber.decontaminate(clash, bench)
    assert out.columns == clash.columns and {r["doc_id"] for r in out.collect()} == {i for i, w in want.items() if not w[-1]}
    assert wumanber.find_benchmark(nothing, bench).count() == 0
    assert wumanber.find_benchmark(odd, bench.limit(0)).filter("contaminated").count() == 0


def test_decontamination_in_many_passes(spark, odd):
    """More passes than run in one task: what they found is staged in between."""
    items = [(k, prose(2, 40) if k == 3 else prose(300 + k, 12)) for k in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = wumanber.find_benchmark(odd, bench, pass_bytes=200)
    assert len(wumanber.benchmark_blocks(bench, 200)) > 2 * wumanber.TOGETHER
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= wumanber.TOGETHER
    assert by_id(found, "n_hit", "n_items") == {i: hits(t, [(str(k), x) for k, x in items])[1:3] for i, t in pairs(odd)}


def test_decontamination_of_tables(spark):
    items = table(spark, "benchmark")
    got = by_id(queries.QUERIES["op3_decontamination"](spark, SF), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == {r[0]: hits(r[1], items) for r in table(spark, "documents")} and any(v[-1] for v in got.values())


# ------------------------------------------------------------------ 4


def check_mix(rows, size_of):
    sizes = {}
    for source, n in size_of.values():
        sizes[source] = sizes.get(source, 0) + n
    want, taken = targets(sizes), {}
    assert len(rows) == len(size_of)
    for r in rows:
        source, n = size_of[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, sizes[source]) and r["target"] == pytest.approx(want[source])
        assert 0 <= r["taken"] <= 3 * n and (not n or r["taken"] % n == 0)
        taken[source] = taken.get(source, 0) + r["taken"]
    for source, target in want.items():
        shortest = min((n for s, n in size_of.values() if s == source and n), default=0)
        assert abs(taken.get(source, 0) - target) <= max(0.02 * target, 3 * shortest + 1), source


def test_mixing(spark, odd, nothing):
    rows = queries.QUERIES["op4_mixing"](spark, SF).collect()
    check_mix(rows, {r[0]: (r[3], base_row(r[1])[0]) for r in table(spark, "documents")})
    again = queries.QUERIES["op4_mixing"](spark, SF).collect()
    assert sorted(rows) == sorted(again)
    mixed = mixing.mix(odd, ["doc_id"]).selectExpr("doc.doc_id", "size", "source_size", "target", "copies * size AS taken").collect()
    check_mix(mixed, {r["doc_id"]: (r["source"], base_row(r["text"])[0]) for r in odd.collect()})
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(odd).columns == [*odd.columns, "copies"]


def test_mixing_many_blocks(spark):
    rows = [(i, prose(i, 1 + i * i % 90), "abc"[i % 3], "x") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(df, ["doc_id"], block=500).selectExpr("doc.doc_id", "size", "source_size", "target", "copies * size AS taken").collect()
    check_mix(got, {i: (s, len(t.split())) for i, t, s, _ in rows})


def plain_rates(sizes, target, most=3):
    """min(most, exp(l * size)) that meets the target, by bisection."""
    low, high, scale = -1e6, 1e6, sum(sizes) / len(sizes)
    for _ in range(300):
        l = (low + high) / 2
        got = sum(z * (most if l * z / scale > math.log(most) else math.exp(max(l * z / scale, -700))) for z in sizes)
        low, high = (l, high) if got < target else (low, l)
    return {z: min(most, math.exp(max(min(low * z / scale, 5), -700))) for z in sizes}


def test_balance_tilts_by_size(spark):
    """Rates differ by size, meet every target, and are those of the entropy problem."""
    rnd = random.Random(12)
    sizes = {s: [rnd.choice([3, 40, 90, 400, 2500]) * rnd.randint(1, 9) for _ in range(60)] for s in ("a", "b", "c", "d")} | {"e": [5], "f": [7, 7, 7]}
    rows = [(s, z, sizes[s].count(z)) for s in sizes for z in set(sizes[s])]
    counted = spark.createDataFrame(rows, "source string, size long, n long")
    shares = {"a": 0.2, "b": 1.0, "c": 1.7, "d": 3.0, "e": 0.5, "f": 2.9}
    targets = spark.createDataFrame([(s, len(z), sum(z), shares[s] * sum(z)) for s, z in sizes.items()], "source string, rows long, source_size long, target double")
    rated = counted.join(mixing.balance(counted, targets), "source").selectExpr("source", "size", "n", "target", f"{mixing.rate_of()} AS rate").collect()
    for s, z in sizes.items():
        mine = [r for r in rated if r["source"] == s]
        assert sum(r["n"] * r["rate"] * r["size"] for r in mine) == pytest.approx(shares[s] * sum(z), rel=1e-6)
        want = plain_rates(z, shares[s] * sum(z)) if shares[s] < 3 else dict.fromkeys(z, 3)
        assert all(r["rate"] == pytest.approx(want[r["size"]], rel=1e-4, abs=1e-9) and 0 <= r["rate"] <= 3 for r in mine)
    assert len({round(r["rate"], 6) for r in rated if r["source"] == "a"}) > 10


@pytest.mark.parametrize("target, missed", [(1219, 1), (3000, 23), (500, 23), (4000, 23), (47, 23)])
def test_rounding_ends_near_the_target(spark, target, missed):
    """A source of seven documents ends within half the shortest; one whose best is a word off is found to a word."""
    sizes = [47, 71, 275, 350, 636, 665, 2770]
    rates = plain_rates(sizes, target)
    df = spark.createDataFrame([("s", z, 1, rates[z]) for z in sizes], "source string, size long, n long, rate double")
    total = {r["size"]: r["total"] for r in mixing.size_copies(df).collect()}
    best = min(abs(sum(z * k for z, k in zip(sizes, copies)) - target) for copies in itertools.product(range(4), repeat=7))
    assert all(0 <= k <= 3 for k in total.values()) and abs(sum(z * k for z, k in total.items()) - target) <= max(missed, best)


def test_mixing_of_long_documents(spark):
    """Books, each longer than a block of words: rounded alone, all of them would err the same way."""
    longs = [(i, 140_000 + 37 * i, "abc"[i % 3]) for i in range(180)] + [(200 + i, 1000 + i, "b") for i in range(200)]
    df = spark.createDataFrame(longs, "doc_id long, n int, source string").selectExpr("doc_id", "concat(doc_id, repeat(' w', n - 1)) AS text", "source")
    got = mixing.mix(df.repartition(8), ["doc_id"], weights=(5, 4, 2)).selectExpr("doc.doc_id", "size", "source_size", "target", "copies * size AS taken").collect()
    totals = {}
    for r in got:
        t = totals.setdefault(r["target"], [0, r["target"], []])
        t[0] += r["taken"]
        t[2].append(r["size"])
    assert len(got) == len(longs) and len(totals) == 3 and {round(t / sum(z), 1) for _, t, z in totals.values()} & {0.5, 0.6}
    for taken, target, sizes in totals.values():
        assert abs(taken - target) <= min(sizes) / 2 + 1


def test_mixing_of_repeated_rows(spark):
    """Rows equal in id and text are rounded together, a group of null ids and texts among them."""
    rows = [(7, "a b c", "x")] * 101 + [(8, "a b c d", "x")] * 11 + [(None, None, "x")] * 50 + [(9, "a b", "y")] * 60 + [(None, "k l m n o", "y")] * 7
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df, ["doc_id"], weights=(3, 2)).collect()
    again = mixing.mix(df.repartition(3), ["doc_id"], weights=(3, 2)).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, again))
    for target in {r["target"] for r in got}:
        mine = [r for r in got if r["target"] == target]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - target) <= 2
    for size in {r["size"] for r in got}:
        copies = [r["copies"] for r in got if r["size"] == size]
        assert max(copies) - min(copies) <= 1




# ------------------------------------------------------------------ 5


def test_chat_round_trip(spark):
    hard = "</s>[INST] ok [/INST] <|turn|>user<|text|> <\\|end|> <\\\\|end|> <|im_start|> [INST <s>\n<<SYS>>"
    rows = [
        (1, 1, "assistant", hard), (1, 0, "user", hard + "<"), (1, None, None, None), (2, 0, "user\n<|text|>", ""), (2, 1, "assistant", "😀 é"),
        (2, 2, "assistant", "<|end|>"), (2, 2, "assistant", "<|end|>"), (None, 0, "assistant", "x"), (3, 0, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted")
    got = {r["conv_id"]: r for r in chat.read_chat(chat.format_chat(chat.text_messages(df))).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        want = [(r[2] or "", r[3] or "") for r in turns]
        assert [tuple(t) for t in got[conv]["turns"]] == want
        assert got[conv]["learned"] == "".join(t for role, t in want if role == "assistant")
    assert chat.format_chat(chat.text_messages(df.limit(0))).count() == 0


def test_chat_of_split_control_strings(spark):
    """Every control string cut in two at every place, and random part lists: what is read back is what was said."""
    marks = ["<|turn|>", "<|text|>", "<|end|>", "<|image|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<\\|end|>", "<\\\\|turn|>x"]
    talks = [[m[:i], m[i:] + "tail"] for m in marks for i in range(len(m) + 1)]
    rnd = random.Random(7)
    pieces = ["<", "|", "turn", "end", "|>", "[", "/", "INST]", "s>", "\\", "<SYS>>", " ", "é", None]
    talks += [["".join(p or "" for p in rnd.choices(pieces, k=rnd.randint(0, 4))) if rnd.random() < 0.9 else None for _ in range(rnd.randint(0, 6))] for _ in range(300)]
    rows = [(i, t, role, [("text", p, None, None) for p in talk]) for i, talk in enumerate(talks) for t, role in enumerate(("user", "assistant"))]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    got = {r["conv_id"]: r for r in chat.read_chat(chat.format_chat(df)).collect()}
    for i, talk in enumerate(talks):
        said = "".join(p or "" for p in talk)
        assert [tuple(t) for t in got[i]["turns"]] == [("user", said), ("assistant", said)] and got[i]["learned"] == said


def test_chat_texts_around_placeholders(spark):
    """Texts that would make a control string with the placeholder between them or without it."""
    parts = [("text", "<|", None, None), ("image", None, "a", None), ("text", "end|>", None, None), ("audio", None, "b", None), ("text", "<|en", None, None), (None, "d|>", None, None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    row = chat.read_chat(chat.format_chat(df)).first()
    assert [tuple(t) for t in row["turns"]] == [("assistant", "<|<|image|>end|><|audio|><|end|>")] and row["learned"] == "<|end|><|end|>"


def test_chat_parts(spark):
    part = lambda k, t=None, r=None, n=None: (k, t, r, n)
    rows = [
        (1, 0, "user", [part("text", "see "), part("image", None, "a.png"), part("Audio", None, "b.wav", 7), part("text", " <|image|>")]),
        (1, 1, "assistant", [part(None, "it is "), part("document", None, "c.pdf"), part("text", None), part("text", "so")]),
        (1, 2, "user", None), (2, 0, "user", []),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    formatted = {r["conv_id"]: r for r in chat.format_chat(df).collect()}
    one = formatted[1]
    assert one["formatted"].startswith("<|turn|>user<|text|>see <|image|><|audio|> <\\|image|><|end|><|turn|>assistant<|text|>it is <|document|>so<|end|>")
    assert [(a["kind"], a["ref"], a["tokens"]) for a in one["attachments"]] == [("image", "a.png", 576), ("audio", "b.wav", 7), ("document", "c.pdf", 1024)]
    assert all(one["formatted"][a["first"] :].startswith(f"<|{a['kind']}|>") for a in one["attachments"])
    assert [one["formatted"][s["first"] : s["first"] + s["length"]] for s in one["loss"]] == ["it is ", "so"]
    assert one["expanded_tokens"] == 576 + 7 + 1024 and (one["n_turns"], formatted[2]["n_turns"]) == (3, 1)


def test_chat_of_table(spark):
    got = {r["conv_id"]: r for r in queries.QUERIES["op5_chat_format"](spark, SF).collect()}
    talks = {}
    for conv, turn, role, text in [*table(spark, "conversations"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        talks.setdefault(conv, []).append((turn, role, text))
    assert set(got) == set(talks)
    for conv, turns in talks.items():
        turns.sort()
        learned = "".join(t for _, r, t in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert tuple(got[conv][c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want


# ------------------------------------------------------------------ 6


def test_warc(spark, tmp_path):
    got = [tuple(r) for r in queries.QUERIES["op6_warc"](spark, SF).collect()]
    pages = [(r[0], r[2]) for r in table(spark, "pages")]
    assert sorted(got, key=str) == sorted(revisits(pages), key=str)
    tricky = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(1, "u", "same"), (9, "v", "same"), (3, None, "same"), (4, "a\r\nX: y", tricky), (5, "w", None), (6, "w", ""), (7, "ü", "ünï 😀")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'p' AS payload").repartition(3)
    warc.write_warc(df, str(tmp_path / "w"), compression="none")
    warc.write_warc(df, str(tmp_path / "z"))
    whole = warc.read_warc(spark, str(tmp_path / "w"))
    assert sorted(map(str, whole.collect())) == sorted(map(str, warc.read_warc(spark, str(tmp_path / "z")).collect()))
    records = warc.read_warc(spark, str(tmp_path / "w"))
    number = warc.page_number
    found = records.selectExpr(f"{number('record_id')} AS i", "http_length AS n", "substr(payload_digest, 6) AS d", "record_type AS t", f"{number('refers_to')} AS r")
    assert sorted([tuple(r) for r in found.collect()], key=str) == sorted(revisits([(r[0], r[2]) for r in rows]), key=str)
    payloads = {r["i"]: bytes(r["payload"]).decode() for r in records.filter("record_type = 'response'").selectExpr(f"{number('record_id')} AS i", "payload").collect()}
    assert payloads == {9: "same", 4: tricky, 6: "", 7: "ünï 😀"}
    assert records.filter("record_type = 'revisit' AND target_uri IN ('u', 'v')").count() == 1
    only = warc.read_warc(spark, str(tmp_path / "w"), payloads=()).filter("payload IS NOT NULL")
    assert only.count() == 0
    least = warc.deduplicated(df, least=5)
    assert least.filter("page_id != keeper").count() == 0
    warc.write_warc(df.limit(0), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_warc_paths_of_object_stores():
    assert warc.uri("s3a://b/k.gz") == "s3://b/k.gz" and warc.uri("file:/x/y") == "file:/x/y" and warc.uri("hdfs://n/x") == "hdfs://n/x"


def test_warc_reader_pushes_headers():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = warc.WarcReader({"files": '[["file:/b", 5], ["file:/a", 99999999], ["file:/c", 5]]'})
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("target_uri",), ("a", "b")), GreaterThan(("http_length",), 3)]))
    assert len(left) == 1 and reader.wanted == {"record_type": {"response"}, "target_uri": {"a", "b"}}
    assert [[n for n, _ in p.files] for p in reader.partitions()] == [["file:/a"], ["file:/b", "file:/c"]]


# ------------------------------------------------------------------ 7


def test_lines(spark, odd, nothing):
    want = thin_lines(pairs(odd))
    clash = odd.withColumnRenamed("lang", "n_removed")
    assert dict(pairs(lines.drop_repeated_lines(clash))) == want
    out = lines.without_repeated_lines(clash)
    assert out.columns == clash.columns and out.count() == odd.count()
    got = {r["doc_id"]: r["text"] for r in queries.QUERIES["op7_line_dedup"](spark, SF).collect()}
    assert got == thin_lines([(r[0], r[1]) for r in table(spark, "documents")])
    assert lines.drop_repeated_lines(nothing).count() == 0


# ------------------------------------------------------------------ 8


def test_tokens(spark, odd, nothing):
    pieces = unigram.load_pieces()
    unknown = min(pieces.values()) - 10.0
    small = odd.filter("doc_id < 60 OR doc_id IN (82, 83)")
    want = {i: (len((t or "").split()), sum(tokens("▁" + w, pieces, unknown) for w in (t or "").split())) for i, t in pairs(small)}
    assert by_id(unigram.count_tokens(small, pieces), "n_pretokens", "n_tokens") == want
    assert by_id(unigram.count_tokens(small, pieces, nodes=8), "n_pretokens", "n_tokens") == want
    trie = unigram.Trie(pieces)
    word = "▁" + "Grüße😀x" * 100
    assert trie.tokens(word) == tokens(word, pieces, unknown)
    assert unigram.count_tokens(nothing, pieces).count() == 0


def test_tokens_of_odd_rows(spark):
    pieces = unigram.load_pieces()
    unknown = min(pieces.values()) - 10.0
    long = " ".join(f"w{i % 50} größe{i % 7}" for i in range(60_000))
    rows = [(None, "a b"), (None, None), (1, ""), (2, "same text"), (2, "same text"), (3, long)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, N_TOKENS int").selectExpr("*", "N_TOKENS AS k")
    got = {r["k"]: (r["n_pretokens"], r["n_tokens"]) for r in unigram.count_tokens(df, pieces).collect()}
    one = {w: tokens("▁" + w, pieces, unknown) for w in set(long.split()) | {"a", "b", "same", "text"}}
    assert got == {k: (len((t or "").split()), sum(one[w] for w in (t or "").split())) for k, (_, t) in enumerate(rows)}


def test_token_counts_of_table(spark):
    pieces = unigram.load_pieces()
    unknown = min(pieces.values()) - 10.0
    got = by_id(queries.QUERIES["op8_token_counts"](spark, SF), "n_pretokens", "n_tokens")
    docs = {r[0]: (r[1] or "").split() for r in table(spark, "documents")}
    cost = {w: tokens("▁" + w, pieces, unknown) for words in docs.values() for w in set(words)}
    assert got == {i: (len(words), sum(cost[w] for w in words)) for i, words in docs.items()}


# ------------------------------------------------------------------ 9


SPANS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def spans(df):
    return by_id(df.selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) AS kept_sha256"), *SPANS)


def test_suffixes(spark, odd, nothing, monkeypatch):
    want = cut_repeats(pairs(odd))
    assert spans(suffixes.remove_repeats(odd)) == want
    assert suffixes.remove_repeats(nothing).count() == 0
    got = by_id(queries.QUERIES["op9_suffix_dedup"](spark, SF), *SPANS)
    assert got == cut_repeats([(r[0], r[1]) for r in table(spark, "documents")])


def test_suffixes_of_split_buckets(spark, odd, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 3)
    monkeypatch.setattr(suffixes, "CHUNK", 1 << 12)
    assert spans(suffixes.remove_repeats(odd)) == cut_repeats(pairs(odd))
    twice = odd.unionAll(odd)
    assert spans(suffixes.remove_repeats(twice)) == cut_repeats(pairs(odd))


def test_longest_previous_factors():
    """The array against all pairs, with many equal suffixes and equal places."""
    rnd = random.Random(6)
    for n in (0, 1, 2, 40, 300):
        text = np.array([rnd.choice(b"ab\0") for _ in range(n + 8)], np.uint8)
        strings = np.lib.stride_tricks.sliding_window_view(text, 8)[:n] if n else np.empty((0, 8), np.uint8)
        place = np.array([rnd.randrange(max(1, n - 5)) for _ in range(n)], np.int64)

        def shared(i, j):
            return next((k for k in range(8) if strings[i][k] != strings[j][k]), 8)

        want = [max((shared(i, j) for j in range(n) if place[j] < place[i]), default=0) for i in range(n)]
        assert suffixes.longest_previous(strings, place).tolist() == want


def test_suffixes_leave_no_table(spark, odd):
    suffixes.remove_repeats(odd).count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("texts_")]


def test_suffixes_of_a_shared_passage(spark):
    """A passage in many surroundings, whose borders all documents have their own, and rows that repeat."""
    passage = prose(31, 60)
    rows = [(k, f"{prose(500 + k, 12)} {passage[k % 3 :]} {prose(900 + k, 12)}") for k in range(40)]
    df = spark.createDataFrame(rows + rows[:7] * 2, "doc_id long, text string")
    assert spans(suffixes.remove_repeats(df)) == cut_repeats(rows)
    assert suffixes.remove_repeats(df).count() == len(rows) + 14


# ------------------------------------------------------------------ 10


def test_near_duplicates(spark, odd, nothing):
    want = near(pairs(odd))
    found = jaccard.near_duplicates(odd)
    assert by_id(found, "n_shingles", "component_id") == want
    assert len({c for _, c in want.values()}) < len(want) - 20
    got = by_id(queries.QUERIES["op10_jaccard_join"](spark, SF), "n_shingles", "component_id")
    assert got == near([(r[0], r[1]) for r in table(spark, "documents")])
    assert jaccard.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("light", [0, 9])
def test_near_duplicates_by_either_way(spark, light, monkeypatch):
    """Chains of small sets around the boundary, with lists that are hot and a group that is searched by hubs."""
    monkeypatch.setattr(jaccard, "boundary", lambda sizes, length: light)
    monkeypatch.setattr(jaccard, "COLD", 3)
    rows = [(k, " ".join(f"w{i}" for i in range(k % 5, k % 5 + 6 + k % 11))) for k in range(60)]
    base = prose(3, 60)
    rows += [(100 + k, edited(base, k, 1 + k % 4)) for k in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(jaccard.near_duplicates(df), "n_shingles", "component_id") == near(rows)


def test_short_lists_are_told_by_pairs():
    """Pairs of sets that share many short lists are one row; lists that are longer or hot keep their rows."""
    rnd = random.Random(8)
    rows = [(t, s, 40 + s % 7, 46 + s % 3, True) for t in range(30) for s in rnd.sample(range(20), rnd.randrange(1, 6))]
    rows += [(100 + t, s, 40, 50, True) for t in range(25) for s in (-5, 77)] + [(200, 3, 40, 50, False), (201, 5, 1, 1, True), (201, 6, 90, 99, True)]
    rnd.shuffle(rows)
    names = ["token", "sid", "n", "reach", "cold"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in part]) for part in (rows[:50], rows[50:], rows[:9])]
    got = [r for b in jaccard._lists(iter(batches)) for r in b.to_pylist()]
    held = defaultdict(set)
    for r in rows:
        held[r[0]].add(r[1:])
    pairs, kept = Counter(), set()
    for token, sets in held.items():
        fits = {(a, b) for a in sets for b in sets if a[0] > b[0] and a[1] <= b[2] and b[1] <= a[2]}
        if len(sets) <= jaccard.FEW and all(x[3] for x in sets):
            pairs.update((a[0], b[0]) for a, b in fits)
        else:
            kept |= {(token, *x[:3]) for x in sets if not x[3] or any(x in f for f in fits)}
    assert {(r["sid"], r["other"]): r["shared"] for r in got if r["other"] is not None} == pairs and pairs[77, -5] == 25
    assert {(r["token"], r["sid"], r["n"], r["reach"]) for r in got if r["other"] is None} == kept
    assert len(got) == len(pairs) + len(kept)
    assert not [r for b in jaccard._lists(iter([pa.RecordBatch.from_pylist([dict(zip(names, rows[0]))])])) for r in b.to_pylist()]


def test_rows_of_names_are_found_without_a_shuffle(spark):
    """Names of any sign and place in the map; what has no name hardly ever stays, and no table is sorted or dealt out for it."""
    rnd = random.Random(11)
    keys = [0, -1, 1, 7, 8, -(1 << 63), (1 << 63) - 1, jaccard.MARK_BLOCK, jaccard.MARK_BLOCK - 1, jaccard.MARKS - 1, jaccard.MARKS]
    keys += [rnd.randrange(-(1 << 63), 1 << 63) for _ in range(3000)]
    rows = spark.createDataFrame([(k, f"t{k}") for k in keys], "sid long, text string")
    names = spark.createDataFrame([(k,) for k in keys[::2] + keys[:8:4]] + [(None,)], "n long")
    found = jaccard._named(rows, "sid", names)
    kept = [r["sid"] for r in found.collect()]
    assert set(keys[::2]) <= set(kept) and len(kept) < len(keys) / 2 + 20 and found.columns == rows.columns
    assert "SortMergeJoin" not in (plan := found._jdf.queryExecution().toString()) and "text" not in "".join(x for x in plan.splitlines() if "Exchange hash" in x)
    assert jaccard._named(rows, "sid", names.filter("n IS NULL")).count() == 0


def test_counters_of_sets_never_leave_out_a_link():
    rnd = np.random.default_rng(5)

    def likely(a, b):
        batch = {"a": [1], "b": [2], "spread_a": [jaccard._spread(a)], "spread_b": [jaccard._spread(b)]}
        return sum(x.num_rows for x in jaccard._likely(iter([pa.RecordBatch.from_pydict(batch)])))

    out = 0
    for n in [1, 4, 7, 30, 100, 400, 900] * 12:
        a = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[int(n * rnd.random() * 0.5) :], rnd.integers(0, 1 << 63, rnd.integers(0, n // 3 + 1)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        out += not likely(a, b)
        assert likely(a, b) or 100 * both < 75 * (len(a) + len(b) - both)
    assert out > 10
    # Full counters tell nothing: 1200 tokens of one counter, all shared, and 300 of the others.
    a = np.arange(1500, dtype=np.uint64) * np.uint64(jaccard.SPREAD)
    assert likely(a, a[:1200]) and likely(a, a) and not likely(a[:200], a[:100])


def test_texts_travel_only_where_sets_are_open(spark, monkeypatch):
    """Narrowing ends when it leaves nothing out, and whole texts are compared only of pairs that may link."""
    staged, kept = Counter(), {}

    def stage(df, label="stage", **options):
        staged[label] += 1
        kept.setdefault(label, []).append(out := real(df, label, **options))
        return out

    real = jaccard.stage
    monkeypatch.setattr(jaccard, "stage", stage)
    monkeypatch.setattr(jaccard, "discard", lambda *tables: None)
    passage = prose(41, 90)
    rows = [(k, edited(prose(k % 4, 80), k, k % 3)) for k in range(24)] + [(50 + k, f"{prose(300 + k, 70)} {passage}") for k in range(20)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    assert by_id(jaccard.near_duplicates(df), "n_shingles", "component_id") == near(rows)
    assert staged["lists"] < jaccard.NARROWINGS
    asked, likely, links = (sum(x.count() for x in kept[label]) for label in ("pairs", "likely", "links"))
    assert asked > likely >= links / 4 and links


def test_one_of_each(spark, odd, nothing):
    twice = odd.unionAll(odd)
    want = near(pairs(odd))
    out = jaccard.one_of_each(odd)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(d for d, (n, c) in want.items() if c == d) and out.columns == odd.columns
    again = [r["doc_id"] for r in jaccard.one_of_each(twice).collect()]
    assert sorted(set(again)) == sorted(d for d, (n, c) in want.items() if c == d)
    assert len(again) == len(set(again)) + sum(n == 0 for n, _ in want.values())
    assert jaccard.one_of_each(nothing).count() == 0


@pytest.mark.parametrize("small", [0, 40, 1 << 20])
def test_components(spark, small):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000)]
    given = spark.createDataFrame([*edges, (None, 7), (7, None)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components.components(given, small).collect()}
    assert components.components(given.limit(0), small).collect() == []
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


# ------------------------------------------------------------------ columns that clash

CLASHES = "gone", "__id", "__hash", "__text_hash", "__lines", "__text", "__words", "__hashes", "__grams", "__mark", "__own0", "n_lines", "kept", "score", "copies", "size", "target"


def test_columns_with_inner_names_survive(spark, odd):
    """Operators that hand documents on keep columns whatever their names."""
    clash = odd.selectExpr("*", *[f"doc_id AS `{c}`" for c in CLASHES])
    kept = {c for c in clash.columns}
    ids = spark.createDataFrame([(k,) for k in range(7, 50)], "doc_id long")
    bench = spark.createDataFrame([(1, prose(2, 40))], "item_id long, text string")
    for out in (lines.without_repeated_lines(clash), jaccard.one_of_each(clash), quality.kept_documents(clash, ids), wumanber.decontaminate(clash, bench)):
        assert out.columns == clash.columns
        assert all(r[c] == r["doc_id"] for r in out.collect() for c in CLASHES)
    mixed = mixing.mixed_documents(clash)
    assert set(mixed.columns) == kept and all(r["gone"] == r["__id"] == r["doc_id"] for r in mixed.collect())
    judged = quality.judge(clash, ids)
    assert {r["__words"] == r["doc_id"] for r in judged.collect()} == {True}
    thinned = lines.drop_repeated_lines(clash)
    assert {r["gone"] == r["doc_id"] for r in thinned.collect()} == {True}
