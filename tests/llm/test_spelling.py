"""Spelling variants against all pairs of words, and the k-d search against plain distances."""

from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from lustra.llm import queries, spelling

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(docs):
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def apart(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio=10):
    near = {w: [] for w in counts}
    words = sorted(counts)
    marks = {w: Counter(w) for w in words}
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if abs(len(a) - len(b)) <= 1 and sum(((marks[a] - marks[b]) | (marks[b] - marks[a])).values()) <= 2 and apart(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def rows(df):
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}
    return out


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows(queries.QUERIES["op12_spelling_variants"](spark, SF)) == plain_variants(plain_counts(docs))


@pytest.fixture(scope="module")
def odd():
    """Chains of forms, ties, accents, anagrams, long words, nulls, repeated rows."""
    rnd = random.Random(4)
    texts = [("abcdefgh " * 200, 1), ("abcdefgx " * 15, 2), ("abcdefyx " * 2, 3), ("ABCDEFZX abcdefzx", 4), (None, 5), ("", 6), ("naïvetés naïvetés naivetés naivetés", 7)]
    texts += [("éééééééé éééééééé èééééééé èééééééé", 8), ("a" * 300 + " " + "a" * 301, 9)] * 2 + [("rrrrrrr×÷ rrrrrrr×÷ ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀ àÀÀÀÀÀÀ àÀÀÀÀÀÀ", None)]
    texts += [(" ".join("".join(rnd.sample("abcdefgh", 8)) for _ in range(60)), 20 + k) for k in range(30)]
    texts += [(" ".join("".join(rnd.choices("aab", k=rnd.randint(6, 9))) for _ in range(100)), 60 + k) for k in range(10)]
    return [(i, t) for t, i in texts]


@pytest.mark.parametrize("cell", [40, 7, 20_000])
def test_odd_words(spark, odd, cell):
    docs = spark.createDataFrame([(i, t, i) for i, t in odd], "doc_id long, text string, WORD long").repartition(3)
    assert rows(spelling.spelling_variants(docs, cell=cell)) == plain_variants(plain_counts(odd))


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(docs).collect() == []


def test_ratio_must_end_chains(spark):
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string"), ratio=1)


def test_long_chain_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(13)], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(forms).collect()} == {f"w{i}": "w13" for i in range(13)}


def test_search_visits_all_it_can_reach():
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choices("abcdé", k=8)) for _ in range(900)})
    cell = spelling.Cell(words, np.arange(len(words)))
    for n in (7, 8):
        asked = sorted({"".join(rnd.choices("abcdé", k=n)) for _ in range(300)} | ({w for w in words[:50]} if n == 8 else set()))
        q, w = cell.near(spelling.letters(asked))
        got = sorted((asked[a], cell.words[b]) for a, b in zip(q.tolist(), w.tolist()))
        assert got == sorted((a, b) for a in asked for b in words if a != b and apart(a, b))


def test_tree_prunes():
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choices("abcdefghijklmnop", k=9)) for _ in range(4000)})
    counts = spelling.letter_counts(spelling.letters(words))
    nodes, leaves = spelling.grown(counts)
    assert sorted(np.concatenate(list(leaves.values())).tolist()) == list(range(len(words)))
    visits = sum(len(at) for _, at in spelling.reached(nodes, 0, counts, 1, 1))
    assert visits < len(words) * len(leaves) / 4
