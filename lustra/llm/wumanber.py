"""Benchmark decontamination: Wu-Manber search of benchmark windows in whole documents."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.llm.words import schema_with, without
from lustra.session import stage

WINDOW = 10
# Benchmark text searched in one pass over the documents; more text takes more passes.
PASS_BYTES = 1 << 20
TOGETHER = 4  # passes in one task
RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
FOUND = "__spans array<struct<first:bigint,last:bigint>>, __items array<string>"
COLUMNS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "__spans", "__items")

# Letters and digits stay (A-Z as a-z), so does everything beyond ASCII; the rest separates words.
_FOLD = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def plain_words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class WuManber:
    """Finds every occurrence of many byte strings, skipping by the last block of the current position.

    All strings are aligned on their first ``m`` bytes, ``m`` being the shortest length.  The block
    length follows the customary choice log(2 m k), here with the few bits a byte of prose carries.
    """

    def __init__(self, strings: Sequence[bytes]):
        self.m = m = min(map(len, strings))
        self.block = b = max(1, min(m, round(math.log(2 * m * len(strings) + 1, 6))))
        self.far = m - b + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[tuple[bytes, int]]] = {}
        for k, s in enumerate(strings):
            for end in range(b, m + 1):
                key = s[end - b : end]
                if m - end < self.shift.get(key, self.far):
                    self.shift[key] = m - end
            self.bucket.setdefault(s[m - b : m], []).append((s, k))

    def find(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(start, index of the string) in order of start."""
        m, b, far, shift, bucket, n = self.m, self.block, self.far, self.shift.get, self.bucket, len(text)
        end = m
        while end <= n:
            key = text[end - b : end]
            step = shift(key, far)
            if step:
                end += step
                continue
            start = end - m
            for s, k in bucket[key]:
                if text.startswith(s, start):
                    yield start, k
            end += 1


class Windows:
    """Word windows of benchmark items with the items that hold each, searched in classes of like length."""

    def __init__(self, items: Sequence[tuple[str, bytes]], width: int):
        held: dict[bytes, set[str]] = {}
        for name, text in items:
            words = plain_words(text)
            for i in range(max(1, len(words) - width + 1) if words else 0):
                held.setdefault(b" " + b" ".join(words[i : i + width]) + b" ", set()).add(name)
        classes: dict[int, list[bytes]] = {}
        for s in sorted(held):
            classes.setdefault(min(len(s), 64).bit_length(), []).append(s)
        self.searches = [
            (WuManber(group), [s.count(b" ") - 1 for s in group], [sorted(held[s], key=str) for s in group])
            for group in classes.values()
        ]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit words as disjoint (first, last) positions, and the items found."""
        text = b" " + b" ".join(words) + b" "
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for search, lengths, names in self.searches:
            at = word = 0
            for start, k in search.find(text):
                word += text.count(b" ", at, start)
                at = start
                spans.append((word, word + lengths[k] - 1))
                items.update(names[k])
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def benchmark_blocks(benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> list[DataFrame]:
    """The benchmark in hashed parts of about ``pass_bytes`` of text each; one part is fetched at a time."""
    items = benchmark.selectExpr("CAST(item_id AS STRING) AS item_id", "CAST(text AS BINARY) AS text").filter("text IS NOT NULL")
    size = items.agg(F.expr("coalesce(sum(length(text)), 0)")).first()[0]
    parts = max(1, math.ceil(size / pass_bytes))
    return [items.filter(F.expr(f"pmod(xxhash64(item_id, text), {parts}) = {k}")) for k in range(parts)]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated.

    A window is ``width`` consecutive words of an item (all of a shorter item); a document word inside
    any occurrence is hit.  Null and empty texts have no words and are clean, and items without words
    are never found.  Repeated rows are judged each, repeated item ids count once, and an item whose id
    is null is searched and named ``null``.  Result columns replace input columns of the same name.  Only a part of the benchmark
    of proven size goes to the tasks; a larger benchmark takes several passes, joined by no shuffle.  ``TOGETHER`` of them
    run in a task, each in a Python worker of its own; what they found is staged before the next ones.
    """
    spark = docs.sparkSession
    out = without(docs, COLUMNS)
    blocks = benchmark_blocks(benchmark, pass_bytes)
    for turn, block in enumerate(blocks):
        items = [(r["item_id"] if r["item_id"] is not None else "null", bytes(r["text"])) for r in block.collect()]
        sent = spark.sparkContext.broadcast(items)
        last = turn == len(blocks) - 1
        fields = schema_with(without(out, COLUMNS), RESULT if last else FOUND)
        out = out.mapInArrow(_pass(sent, width, turn == 0, last, fields.names), fields)
        if not last and turn % TOGETHER == TOGETHER - 1:
            out = stage(out, "passes")
    return out


def _pass(sent, width: int, first: bool, last: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(sent.value, width)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            spans, items, counts = [], [], []
            for i, text in enumerate(texts):
                words = plain_words(text.as_py())
                hit, found = windows.search(words) if words else ([], set())
                if not first:
                    hit = merged(hit + [(s["first"], s["last"]) for s in batch.column("__spans")[i].as_py()])
                    found |= set(batch.column("__items")[i].as_py())
                spans.append(hit)
                items.append(sorted(found))
                counts.append(len(words))
            kept = [batch.column(n) for n in batch.schema.names if n not in ("__spans", "__items")]
            if last:
                hits = [sum(b - a + 1 for a, b in s) for s in spans]
                new = [
                    pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                    pa.array([n > 0 for n in hits], pa.bool_()),
                ]
            else:
                kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
                new = [
                    pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], kind),
                    pa.array(items, pa.list_(pa.string())),
                ]
            yield pa.RecordBatch.from_arrays(kept + new, names=names)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window; all their columns stay, whatever their names."""
    back = {f"__in{i}": c for i, c in enumerate(docs.columns) if c.lower() in COLUMNS}
    marked = find_benchmark(docs.withColumnsRenamed({c: n for n, c in back.items()}), benchmark, width)
    return marked.filter("NOT contaminated").drop(*COLUMNS).withColumnsRenamed(back).select(*docs.columns)
