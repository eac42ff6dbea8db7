"""Packing token sequences into windows by sum of squares, online, with a level array per task."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lustra.llm.words import without

WINDOW = 2048
END = 1  # id behind every document
OPEN = 4096  # partially filled windows a task holds before it joins them
WORDS = 1 << 20  # words a worker remembers
CHUNK = 1 << 20  # characters encoded together
LONGEST = 64  # characters of a word worth remembering

# Where the splitting pattern reads alike in both libraries: no rare white space or control characters, no other scripts.
_PLAIN = r"[^\t\n\r\x20-\x7e\xa1-ɏ]"
# Characters that _PLAIN leaves to a text.
_TAKEN = re.sub(_PLAIN, "", "".join(map(chr, range(0x250))))
PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def plain_pattern(pattern: str) -> str:
    """A splitting pattern with letters and numbers listed, which splits plain texts alike without Unicode properties.

    The standard library's engine then takes less than half the time of one that knows the properties.
    """
    import regex

    for kind in (r"\p{L}", r"\p{N}"):
        listed = "".join(regex.findall(kind, _TAKEN))
        pattern = re.sub(r"\[[^]]*]", lambda m: m[0].replace(kind, listed), pattern).replace(kind, f"[{listed}]")
    return pattern


class Encoder:
    """Ids of whole texts by a byte-level BPE tokenizer file, words remembered.

    Byte-level BPE splits a text by a fixed pattern and encodes each word by itself, so the ids of a text are
    those of its words.  Texts with characters outside ``_PLAIN`` go to the tokenizer whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.split = re.compile(plain_pattern(public_tokenizers.PATTERN)).findall
        self.odd = re.compile(_PLAIN).search
        self.known: dict[str, bytes] = {}
        self.line = self._whole(["\n"])[0][0]

    def _whole(self, texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text; their new words are encoded together, and remembered while there is room."""
        words = [None if self.odd(t) else self.split(t) for t in texts]
        new = set().union(*(w for w in words if w)).difference(self.known)
        self._learn(new)
        ids = self.known.__getitem__
        out = [np.array(self._whole([t])[0], "<u4") if w is None else np.frombuffer(b"".join(map(ids, w)), "<u4") for t, w in zip(texts, words)]
        full = len(self.known) > WORDS
        for w in new:
            if full or len(w) > LONGEST:
                del self.known[w]
        return out

    def _learn(self, words: set[str]) -> None:
        """Encode words as one text with a line feed behind each, which is a word of its own there."""
        # White space would run into the line feed.
        blank = [w for w in words if w[-1].isspace()]
        plain = [w for w in words if not w[-1].isspace()]
        ids = np.array(self._whole(["".join(f"{w}\n" for w in plain)])[0], "<u4")
        ends = np.flatnonzero(ids == self.line)
        data, begin = ids.tobytes(), 0
        for w, end in zip(plain, (4 * ends).tolist(), strict=True):
            self.known[w] = data[begin:end]
            begin = end + 4
        self.known.update((w, np.array(i, "<u4").tobytes()) for w, i in zip(blank, self._whole(blank)))


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file, kept from task to task."""
    held = sys.modules.setdefault("_lustra_encoders", types.ModuleType("_lustra_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


class Levels:
    """Open windows by fill level, and how many there are of each level.

    A part of s tokens goes to the level h, or to a new window, for which the sum of the squared numbers of
    partially filled windows per level is least afterwards; of equals the fullest.  ``leave`` and ``come``
    hold what a level adds to that sum when a window leaves or reaches it.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.leave = np.full(window + 1, np.iinfo(np.int64).max // 4)
        self.leave[0] = 0  # a new window
        self.come = np.ones(window + 1, np.int64)
        self.come[window] = 0  # a full window counts no more
        self.held: dict[int, list[list]] = {}
        self.open = 0

    def level(self, size: int) -> int:
        cost = self.leave[: self.window - size + 1] + self.come[size:]
        return self.window - size - int(np.argmin(cost[::-1]))

    def _count(self, level: int) -> None:
        n = len(self.held.get(level, ()))
        self.leave[level] = 1 - 2 * n if n else np.iinfo(np.int64).max // 4
        self.come[level] = 2 * n + 1

    def place(self, part: tuple, size: int) -> list | None:
        """Put a part of ``size`` tokens, less than a window, away; the parts of the window if that fills it."""
        at = self.level(size)
        if at:
            parts = self.held[at].pop()
            self._count(at)
        else:
            parts = []
            self.open += 1
        parts.append(part)
        if at + size == self.window:
            self.open -= 1
            return parts
        self.held.setdefault(at + size, []).append(parts)
        self._count(at + size)
        return None

    def close(self) -> list:
        """All parts of open windows, fullest first; nothing is open then."""
        parts = [p for level in sorted(self.held, reverse=True) for w in self.held[level] for p in w]
        self.__init__(self.window)
        return parts


def sequences(parts: list[tuple], window: int, last: bool) -> Iterator[tuple[int, list[tuple]]]:
    """Windows filled by parts in order, cut where one is full: (size, parts).

    What is left behind the last full window is cut at powers of two, which need no padding, if ``last``.
    """
    left = sum(len(p[2]) for p in parts)
    sizes = [window] * (left // window)
    left %= window
    while left and last:
        sizes.append(1 << (left.bit_length() - 1))
        left -= sizes[-1]
    rest = iter(parts)
    part = None
    for size in sizes:
        out, free = [], size
        while free:
            doc, start, ids, tokens = part or next(rest)
            out.append((doc, start, ids[:free], tokens))
            part = (doc, start + free, ids[free:], tokens) if len(ids) > free else None
            free -= len(out[-1][2])
        yield size, out
    if not last:
        yield 0, ([part] if part else []) + list(rest)


def _packed(path: str, end: int, window: int, open_: int, schema: pa.Schema):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, levels = encoder(path).encode, Levels(window)
        base, number, rows = TaskContext.get().partitionId() << 40, 0, []

        def put(size: int, parts: list[tuple]) -> None:
            nonlocal number
            offset = 0
            for doc, start, ids, tokens in parts:
                rows.append((doc, start, len(ids), ids.tobytes(), tokens, base | number, offset, size))
                offset += len(ids)
            number += 1

        def join(last: bool) -> None:
            for size, parts in sequences(levels.close(), window, last):
                if size:
                    put(size, parts)
                    continue
                for p in parts:
                    if full := levels.place(p, len(p[2])):
                        put(window, full)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return out

        def chunks(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
            """Documents of a batch, about CHUNK characters at a time."""
            held, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append((doc, text.as_py() or ""))
                size += len(held[-1][1])
                if size >= CHUNK:
                    yield held
                    held, size = [], 0
            if held:
                yield held

        for chunk in (c for batch in batches for c in chunks(batch)):
            for (doc, _), found in zip(chunk, encode([text for _, text in chunk])):
                ids = np.append(found, np.array(end, "<u4"))
                whole = len(ids) - len(ids) % window
                for start in range(0, whole, window):
                    put(window, [(doc, start, ids[start : start + window], len(ids))])
                if whole < len(ids) and (full := levels.place((doc, whole, ids[whole:].copy(), len(ids)), len(ids) - whole)):
                    put(window, full)
                if levels.open > open_:
                    join(last=False)
            if rows:
                yield flush()
        join(last=True)
        if rows:
            yield flush()

    return pack


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end: int = END, window: int = WINDOW, open_windows: int = OPEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32 bits), doc_tokens, sequence_id,
    offset and window, the size that the piece's sequence is padded to.

    Documents are encoded whole, each followed by ``end``.  Full windows are cut off its front, and what is left
    is placed online into a partially filled window by sum of squares; each task has its own level array.
    Windows that a task ends with are joined and cut: full ones, then powers of two.  So nothing is padded and
    at most the parts in windows open at the end of a task are cut once more.  When more than ``open_windows`` are
    open, they are joined in between, which bounds the memory of a task.

    A null or empty text has the one id ``end``; a null doc_id stays null; repeated rows are documents each; an
    empty table gives no pieces; other columns are left out.  A sequence's id tells its task, so reruns over the same
    files agree; stage a table whose rows come in another order each time.
    """
    rows = without(docs, [c for c in docs.columns if c.lower() not in ("doc_id", "text")]).select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, {PIECES}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(out))
    return rows.mapInArrow(_packed(tokenizer or default_tokenizer(), end, window, open_windows, schema), out)
