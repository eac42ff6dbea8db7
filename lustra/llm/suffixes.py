"""Repeated passages by suffix order: later copies of byte strings go, the first stays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.session import new_shared_path, stage

LENGTH = 100  # bytes of a string that must not start twice
GRAM = 24  # bytes of an anchor: 16 and 8
REACH = LENGTH - GRAM + 1  # places an anchor can have in such a string
CLASS = 48  # neighbouring starts of a run that are dealt out together
HOT = 50_000  # runs of different bytes of one anchor that may meet in one task
CHUNK = 1 << 21  # bytes hashed, or strings times LENGTH sorted, at a time

_BASE = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every place, by doubling: 16 bytes, then the 8 behind."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MIX[0]
    spans = {1: h}
    n = 1
    while n < 16:
        h = spans[n]
        spans[2 * n] = h[:-n] * np.uint64(pow(_BASE, n, 1 << 64)) + h[n:]
        n *= 2
    out = spans[16][: len(data) - GRAM + 1] * np.uint64(pow(_BASE, 8, 1 << 64)) + spans[8][16 : 16 + len(data) - GRAM + 1]
    for c in _MIX:
        out ^= out >> np.uint64(33)
        out *= c
    return out ^ (out >> np.uint64(31))


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, place of the anchor, its hash) of all runs of starts with one anchor.

    The anchor of a start is the place, among the REACH in the LENGTH bytes from it, whose gram has the
    smallest hash, the last of equals.  It depends on those bytes alone, so equal strings have equal anchors.
    """
    ends = np.cumsum([len(t) for t in texts])
    if not len(ends) or ends[-1] < LENGTH:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    data = np.frombuffer(b"".join(texts), np.uint8)
    h = gram_hashes(data)
    low = np.uint64((1 << len(data).bit_length()) - 1)
    m = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    n = 1
    while 2 * n <= REACH:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    m = np.minimum(m[: len(m) - (REACH - n)], m[REACH - n :])
    at = (low - (m & low)).astype(np.int64)
    begins = ends - [len(t) for t in texts]
    inside = np.zeros(len(at) + 1, np.int64)
    long = ends - begins >= LENGTH
    np.add.at(inside, begins[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    own = at[starts]
    new = np.flatnonzero((own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new - 1, [len(starts) - 1]])
    text = np.searchsorted(begins[long], starts[first], "right") - 1
    text = np.flatnonzero(long)[text]
    return text, starts[first] - begins[text], starts[last] - begins[text], own[first] - begins[text], h[own[first]].view(np.int64)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch in pieces of about CHUNK bytes, with the index of the first."""
    held, size, at = [], 0, 0
    for i, text in enumerate(batch.column("data")):
        held.append(text.as_py() or b"")
        size += len(held[-1])
        if size >= CHUNK:
            yield at, held
            held, size, at = [], 0, i + 1
    if held:
        yield at, held


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per run of starts: its anchor, the name of its bytes and its place.

    Of runs of a batch with the same bytes only the first is still open; the others are later copies.
    """
    for batch in batches:
        rows = batch.column("row").to_numpy(zero_copy_only=False)
        docs = batch.column("doc").to_numpy(zero_copy_only=False)
        parts, names = [], []
        for at, texts in _chunks(batch):
            text, lo, hi, anchor, gram = anchors(texts)
            parts.append((gram, rows[at + text], docs[at + text], lo, hi, anchor))
            ends = hi + LENGTH
            names += [xxhash.xxh3_64_intdigest(texts[t][a:b]) for t, a, b in zip(text.tolist(), lo.tolist(), ends.tolist())]
        if names:
            gram, row, doc, lo, hi, anchor = map(np.concatenate, zip(*parts))
            name = np.array(names, np.uint64).view(np.int64)
            open_ = ~_copies(gram, name, row, doc, lo)
            columns = [np.where(open_, gram, row), gram, name, row, doc, *(c.astype(np.int32) for c in (lo, hi, anchor)), open_]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["key", "gram", "name", "row", "doc", "lo", "hi", "anchor", "open"])


def _copies(gram, name, row, doc, lo) -> np.ndarray:
    """Which runs come after another place with the same bytes."""
    order = np.lexsort((lo, row, doc, name, gram))
    gram, name, row, doc, lo = (a[order] for a in (gram, name, row, doc, lo))
    head = np.ones(len(order), bool)
    head[1:] = (gram[1:] != gram[:-1]) | (name[1:] != name[:-1])
    first = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    out = np.empty(len(order), bool)
    # Rows equal in id and text are one place.
    out[order] = (row != row[first]) | (lo != lo[first]) | (doc != doc[first])
    return out


_MET = "row long, doc long, lo int, hi int, anchor int, gram long, parts int"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that are later copies as a whole (no gram), and one of each bytes where an anchor has several."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    names = ("gram", "name", "row", "doc", "lo", "hi", "anchor", "open")
    gram, name, row, doc, lo, hi, anchor, open_ = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in names)
    done = ~open_
    at = np.flatnonzero(open_)
    done[at] = _copies(gram[at], name[at], row[at], doc[at], lo[at])
    at = np.flatnonzero(~done)
    order = at[np.lexsort((name[at], gram[at]))]
    # What is left of a name is one place, maybe of rows equal in id and text: one of them goes on.
    head = np.ones(len(order), bool)
    head[1:] = (gram[order][1:] != gram[order][:-1]) | (name[order][1:] != name[order][:-1])
    order = order[head]
    new = np.ones(len(order), bool)
    new[1:] = gram[order][1:] != gram[order][:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(order)))
    several = np.repeat(size, size)
    keep = several > 1
    kept, parts = order[keep], -(-several[keep] // HOT)
    gone = np.flatnonzero(done)
    every = np.concatenate([gone, kept])
    some = np.concatenate([np.zeros(len(gone), bool), np.ones(len(kept), bool)])
    yield pa.RecordBatch.from_arrays(
        [pa.array(row[every]), pa.array(doc[every]), pa.array(lo[every]), pa.array(hi[every]), pa.array(anchor[every]), pa.array(gram[every], mask=~some),
         pa.array(np.concatenate([np.zeros(len(gone), np.int32), parts.astype(np.int32)]), mask=~some)],
        names=["row", "doc", "lo", "hi", "anchor", "gram", "parts"],
    )


_CLASSES = "key long, salt int, split boolean, doc long, row long, lo int, bytes binary"


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every run as classes of up to CLASS neighbouring starts, with the bytes of their strings.

    A start's class is how far behind it its anchor lies.  Equal strings have the same anchor equally far behind, so they are
    in the same class, and all strings of a class share the bytes from its last start to the end of its first
    string.  These name the class: equal strings meet, and runs that only have an anchor in common part.
    """
    for batch in batches:
        out: list[tuple] = []
        runs = zip(*(batch.column(c).to_pylist() for c in ("parts", "doc", "row", "lo", "anchor", "bytes")))
        for parts, doc, row, lo, anchor, data in runs:
            starts, behind = len(data) - LENGTH + 1, anchor - lo
            for c in range((behind - starts + 1) // CLASS, behind // CLASS + 1):
                last = behind - c * CLASS
                first = max(0, last - CLASS + 1)
                key = xxhash.xxh3_64_intdigest(data[last : last + LENGTH - CLASS + 1], seed=c)
                out.append((key - (1 << 63), row % parts, parts > 1, doc, row, lo + first, data[first : min(last, starts - 1) + LENGTH]))
        if out:
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["key", "salt", "split", "doc", "row", "lo", "bytes"])


def _smaller(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """How many bytes each suffix, in suffix order, shares with the nearest one before it of smaller place (0 if none).

    ``lcp`` is what a suffix shares with its neighbour before.  All nearest smaller positions are found side by side: who
    points to a larger place points to where that one points, and shares the least of both.
    """
    to = np.arange(-1, len(place) - 1)
    shared = lcp.copy()
    left = np.flatnonzero((to >= 0) & (place[np.maximum(to, 0)] >= place))
    while len(left):
        at = to[left]
        shared[left] = np.minimum(shared[left], shared[at])
        to[left] = to[at]
        at = to[left]
        left = left[(at >= 0) & (place[np.maximum(at, 0)] >= place[left])]
    shared[to < 0] = 0
    return shared


def longest_previous(strings: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The longest previous factor of every suffix, up to the width of ``strings``: what it shares with one of smaller place.

    ``strings`` are the suffixes cut to their width, a row of bytes each, ``place`` numbers their places in the corpus.  In
    suffix order, the suffix of smaller place that shares most is the nearest one before or the nearest one behind.
    """
    width = strings.shape[1]
    order = np.lexsort((place, np.ascontiguousarray(strings).view(f"V{width}").ravel().view(f"S{width}"))) if len(strings) else np.empty(0, np.int64)
    ranked, where = strings[order], place[order]
    lcp = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differs = ranked[1:] != ranked[:-1]
        lcp[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    before = _smaller(where, lcp)
    behind = _smaller(where[::-1], np.append(0, lcp[:0:-1]) if len(order) else lcp)[::-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(before, behind)
    return out


_FOUND = "row long, doc long, lo int, hi int, high long, low long"


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every class: runs of starts that are later copies, and one by one the other starts of split classes.

    Rows come by class, so only whole classes of about CHUNK bytes of strings are held.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, salt = (batch.column(c).to_numpy() for c in ("key", "salt"))
        new = np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1])) + 1
        if held:
            last = held[-1]
            if last.column("key")[-1].as_py() != key[0] or last.column("salt")[-1].as_py() != salt[0]:
                new = np.append(0, new)
        begin, sizes = 0, pc.binary_length(batch.column("bytes")).to_numpy(zero_copy_only=False) - LENGTH + 1
        for at in new.tolist():
            if size + int(sizes[begin:at].sum()) >= CHUNK // LENGTH:
                yield from _one(pa.Table.from_batches([*held, batch.slice(begin, at - begin)]))
                held, size, begin = [], 0, at
        held.append(batch.slice(begin))
        size += int(sizes[begin:].sum())
    if held:
        yield from _one(pa.Table.from_batches(held))


def _one(table: pa.Table) -> Iterator[pa.RecordBatch]:
    key, salt, doc, row, lo = (table.column(c).to_numpy() for c in ("key", "salt", "doc", "row", "lo"))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
    rows = np.diff(np.append(np.flatnonzero(new), len(key)))
    split = table.column("split").to_numpy(zero_copy_only=False)
    # A class of one row has no two equal strings.
    chosen = np.flatnonzero((np.repeat(rows, rows) > 1) | split)
    if not len(chosen):
        return
    data = table.column("bytes").take(pa.array(chosen)).to_pylist()
    lengths = np.array([len(d) for d in data])
    buffer = np.frombuffer(b"".join(data), np.uint8)
    counts = lengths - LENGTH + 1
    of = np.repeat(np.arange(len(chosen)), counts)
    step = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = (np.cumsum(lengths) - lengths)[of] + step
    strings = np.lib.stride_tricks.sliding_window_view(buffer, LENGTH)[begin]
    docs, rows, starts = doc[chosen][of], row[chosen][of], lo[chosen][of] + step
    # Numbers of places: equal ones only for rows equal in id and text.
    ranked = np.lexsort((starts, rows, docs))
    new = np.zeros(len(ranked), np.int64)
    new[1:] = (docs[ranked][1:] != docs[ranked][:-1]) | (rows[ranked][1:] != rows[ranked][:-1]) | (starts[ranked][1:] != starts[ranked][:-1])
    place = np.empty(len(ranked), np.int64)
    place[ranked] = np.cumsum(new)
    later = longest_previous(strings, place) >= LENGTH
    gone = np.flatnonzero(later)
    if len(gone):
        cut = np.flatnonzero((of[gone][1:] != of[gone][:-1]) | (step[gone][1:] != step[gone][:-1] + 1)) + 1
        a, b = gone[np.concatenate([[0], cut])], gone[np.concatenate([cut - 1, [len(gone) - 1]])]
        empty = pa.nulls(len(a), pa.int64())
        yield _found([rows[a], docs[a], starts[a].astype(np.int32), starts[b].astype(np.int32)], [empty, empty])
    left = np.flatnonzero(~later & split[chosen][of])
    if len(left):
        names = [xxhash.xxh3_128_intdigest(strings[i].tobytes()) for i in left]
        high = np.array([n >> 64 for n in names], np.uint64).view(np.int64)
        low = np.array([n & ((1 << 64) - 1) for n in names], np.uint64).view(np.int64)
        at = starts[left].astype(np.int32)
        yield _found([rows[left], docs[left], at, at], [pa.array(high), pa.array(low)])


def _found(columns: list[np.ndarray], names: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), *names], names=["row", "doc", "lo", "hi", "high", "low"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for text, runs in zip(batch.column("data"), batch.column("runs").to_pylist()):
            text = text.as_py() or b""
            spans: list[list[int]] = []
            for run in sorted((r["lo"], r["hi"] + LENGTH) for r in runs or ()):
                if spans and run[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], run[1])
                else:
                    spans.append(list(run))
            edges = [0, *(x for s in spans for x in s), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((len(text), len(text) - len(kept), len(spans), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row: its text as UTF-8 without repeated bytes.

    A byte goes if it lies in LENGTH bytes that also start earlier: in a document of smaller doc_id (null
    first; of equal ids, by a hash of the text) or before in the same.  Strings are judged on the input and
    never cross documents.  A null text is empty; texts shorter than LENGTH stay whole; rows equal in doc_id
    and text are one place and get the same result; an empty table gives an empty one; other columns are
    left out.

    1. Every string of LENGTH bytes has an anchor, a short gram chosen by its own bytes, and the starts with
       one anchor form a run.  Runs are dealt out by anchor, so equal strings meet, as rows without bytes; a
       string whose anchor occurs once cannot repeat, and a run whose bytes have an earlier place is a copy.
    2. Where an anchor has runs of different bytes, one run of each goes on with its bytes, cut into classes of
       neighbouring starts that are dealt out by the bytes their strings share (see ``_classes``).
    3. In every class the suffixes are sorted, and the longest previous factor of each follows from the nearest
       smaller places before and behind it.  Where it reaches LENGTH the start is a later copy.
    4. Only an anchor of more than HOT different runs has its classes split by document; what these do not find is
       compared by a 128-bit digest, in an aggregation that keeps the first place of each.
    5. Runs of removed starts go back to their documents, where covered bytes merge into spans.
    """
    spark = docs.sparkSession
    # A null id counts as the smallest number.
    fields = "xxhash64(doc_id, text) AS row", "doc_id", f"coalesce(doc_id, {-(1 << 63) + 1}L - 1L) AS doc", "CAST(coalesce(text, '') AS BINARY) AS data"
    # Both joins with whole texts go by row: bucketed once, texts are not moved for either.  The files stay below the
    # shared folder like other staged tables; their name in the catalog is only needed to read the buckets.
    table, buckets = f"texts_{uuid.uuid4().hex}", max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = new_shared_path(spark, "texts")
    docs.selectExpr(*fields).write.bucketBy(buckets, "row").option("path", path).saveAsTable(table)
    texts = spark.table(table)
    spark.sql(f"DROP TABLE {table}")

    runs = docs.selectExpr(*fields).mapInArrow(_runs, "key long, gram long, name long, row long, doc long, lo int, hi int, anchor int, open boolean")
    met = stage(runs.repartition("key").drop("key").mapInArrow(_met, _MET), "runs")
    several = met.filter("gram IS NOT NULL").drop("doc")
    suffixes = several.join(texts, "row").selectExpr("parts", "doc", "row", "lo", "anchor", f"substring(data, lo + 1, hi - lo + {LENGTH}) AS bytes")
    dealt = suffixes.mapInArrow(_classes, _CLASSES).repartition("key", "salt").sortWithinPartitions("key", "salt")
    found = stage(dealt.mapInArrow(_sorted, _FOUND), "found")
    open_ = found.filter("high IS NOT NULL")
    first = open_.groupBy("high", "low").agg(F.expr("min(struct(doc, row, lo)) AS first"), F.expr("count(1) AS n")).filter("n > 1")
    later = open_.join(first, ["high", "low"]).filter("NOT (struct(doc, row, lo) <=> first)")
    gone = [x.select("row", "lo", "hi") for x in (met.filter("gram IS NULL"), found.filter("high IS NULL"), later)]
    spans = gone[0].unionAll(gone[1]).unionAll(gone[2]).groupBy("row").agg(F.expr("collect_list(struct(lo, hi)) AS runs"))
    whole = texts.join(spans, "row", "left").select("doc_id", "data", "runs")
    return whole.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
