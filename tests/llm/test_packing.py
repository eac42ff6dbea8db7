"""Packing: every id in one piece, windows filled, and the placing rule against a plain version."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from lustra.llm import packing, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out.encode_special_tokens = True
    return out


def check_whole(rows, texts, tokenizer, window=2048):
    """All pieces of the documents, in whole sequences; returns the padding."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(docs) == set(texts)
    for i, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(docs[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert {r["window"] for r in parts} == {at} and (at == window or at & (at - 1) == 0)
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_query(spark, tokenizer):
    rows = queries.QUERIES["op11_packing"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check_whole(rows, texts, tokenizer) == 0


ODD = [None, "", " ", "a", "<|endoftext|> x <|endoftext|>", "1 234 ²³ ½", "don't I'll we've 's", "\x1c\x1d \x85   　", "Grüße ЖУК 漢字 😀" * 50,
       "﻿a​bͅ", "x" * 5000, "word " * 3000, "\n\n\n  \t ", "ǅǈ ª º ĸ", "\0\x01\x7f"]


def test_odd_texts(spark, tokenizer):
    rows = [(i, t, None) for i, t in enumerate(ODD)] + [(None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, START long").repartition(3)
    out = packing.pack_documents(docs).selectExpr("*", "crc32(ids) AS ids_crc32").collect()
    assert check_whole(out, {i: t for i, t, _ in rows}, tokenizer) == 0


def test_words_are_encoded_like_texts(tokenizer):
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(3)
    letters = [chr(c) for c in range(0x250)] + list(" \n''srtlmvd019") * 20
    texts = [t or "" for t in ODD] + ["".join(rnd.choices(letters, k=300)) for _ in range(300)]
    for part in (texts[:1], texts, texts[::-1]):
        for text, ids in zip(part, encoder.encode(part)):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_plain_texts_are_split_without_properties():
    """The listed letters and numbers split every two neighbours as the tokenizer's pattern does."""
    split = re.compile(packing.plain_pattern(public_tokenizers.PATTERN)).findall
    like = regex.compile(public_tokenizers.PATTERN).findall
    plain = [chr(c) for c in range(0x250) if not re.search(packing._PLAIN, chr(c))]
    rnd = random.Random(4)
    texts = [a + b for a in plain for b in rnd.choices(plain, k=40) + list(" \n'a1.")]
    texts += ["".join(rnd.choices([*plain, *" \n''srtlmvd019" * 30], k=300)) for _ in range(300)]
    assert [split(t) for t in texts] == [like(t) for t in texts]
    assert packing.encoder(public_tokenizers.path("byte_bpe_50k.json")).split.__self__.pattern == packing.plain_pattern(public_tokenizers.PATTERN)


def test_memory_of_words_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 10)
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("a b c d e f g", "a h i j k l m", "b n o p q", "z" * 90 + " a"):
        assert encoder.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) <= 10 and all(encoder.known.values())


def test_small_windows(spark, tokenizer):
    docs = spark.createDataFrame([(i, "one two three four five " * (i % 7)) for i in range(300)], "doc_id long, text string")
    for open_ in (1, 3, 1000):
        out = packing.pack_documents(docs, window=16, open_windows=open_).selectExpr("*", "crc32(ids) AS ids_crc32").collect()
        assert check_whole(out, {i: "one two three four five " * (i % 7) for i in range(300)}, tokenizer, 16) == 0


def test_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(5, "same text")] * 4, "doc_id long, text string")
    out = packing.pack_documents(docs).collect()
    assert sum(r["length"] for r in out) == 4 * out[0]["doc_tokens"]
    assert packing.pack_documents(docs.limit(0)).collect() == []


def test_level_is_the_least_sum_of_squares():
    rnd = random.Random(1)
    levels, held = packing.Levels(50), Counter()
    for _ in range(3000):
        size = rnd.choice([7, 9, 11, 18, 23, 31, rnd.randint(1, 49)])

        def after(h):
            n = Counter(held)
            if h:
                n[h] -= 1
            if h + size < 50:
                n[h + size] += 1
            return sum(v * v for v in n.values())

        choices = [h for h in range(50 - size + 1) if h == 0 or held[h]]
        least = min(map(after, choices))
        best = max(h for h in choices if after(h) == least)
        assert levels.level(size) == best
        full = levels.place(("d", 0, [0] * size, size), size)
        if best:
            held[best] -= 1
        if best + size < 50:
            held[best + size] += 1
        assert (full is not None) == (best + size == 50)
        assert levels.open == sum(held.values())
    assert sum(len(p[2]) for p in levels.close()) == sum(k * v for k, v in held.items())
