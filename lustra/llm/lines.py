"""Line deduplication by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.functions.columns import ref
from lustra.llm.words import computed, has_word, renamed_in, without

WIDTH = 3
_OWN = ("gone", "__id", "__hash", "__text_hash", "__lines", "__text")
_KEY = ("doc_id", "__text_hash")


def _lines(text: str) -> str:
    return f"split({text}, '\\n', -1)"


def repeated_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, __text_hash, gone): positions, from 0, of lines that a later occurrence of a window covers.

    A window is ``width`` consecutive lines of which one at least has a word, known by a hash of its lines.
    Occurrences go by doc_id (null first), hash of the whole text and position; all but the first are later
    ones.  Windows are counted with partial aggregation, so a window that every document holds costs a row
    per task; the join back needs no group as a whole, and adaptive execution splits its hot keys.
    """
    lines = docs.selectExpr("doc_id", "xxhash64(text) AS __text_hash", f"{_lines('text')} AS lines")
    lines = computed(lines, {"hashes": f"transform(lines, l -> if({has_word('l')}, xxhash64(l), NULL))"})
    parts = ", ".join(f"get(hashes, i + {k})" for k in range(width))
    # Hashing skips nulls, so where the blank lines are is hashed too.
    blank = ", ".join(f"get(hashes, i + {k}) IS NULL" for k in range(width))
    window = f"if(i > size(hashes) - {width} OR coalesce({parts}) IS NULL, NULL, xxhash64({parts}, {blank}))"
    lines = computed(lines.select(*_KEY, "hashes"), {"windows": f"transform(hashes, (h, i) -> {window})"})
    each = lines.select(*_KEY, F.posexplode("windows").alias("at", "window")).filter("window IS NOT NULL")
    first = each.groupBy("window").agg(F.expr("count(1) AS n"), F.expr(f"min(struct({', '.join(_KEY)}, at)) AS first")).filter("n > 1")
    later = each.join(first, "window").filter(f"NOT (struct({', '.join(_KEY)}, at) <=> first)")
    starts = later.groupBy(*_KEY).agg(F.expr("collect_set(at) AS starts"))
    covered = f"array_distinct(flatten(transform(starts, s -> sequence(s, s + {width - 1}))))"
    return starts.selectExpr(*_KEY, f"array_sort({covered}) AS gone")


def drop_repeated_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with text, n_lines and n_removed after removing covered lines.

    Covered positions are merged, so a line goes once however many windows cover it.  Null texts stay null
    with 0 lines; an empty text is one empty line; a text of fewer than ``width`` lines stays whole.  A text
    whose lines all go becomes empty.  Rows equal in doc_id and text are one occurrence and get the same
    result.  All other columns stay; n_lines and n_removed replace input columns of those names.
    """
    rest, back = renamed_in(without(docs, ("n_lines", "n_removed")), _OWN)
    gone = repeated_lines(docs, width).withColumnsRenamed({"doc_id": "__id", "__text_hash": "__hash"})
    found = rest.join(gone, F.expr("doc_id <=> __id AND xxhash64(text) = __hash"), "left")
    found = computed(found, {"__lines": f"coalesce({_lines('text')}, CAST(array() AS ARRAY<STRING>))"})
    marks = "transform(__lines, (l, i) -> i)"
    kept = f"array_join(transform(array_except({marks}, gone), i -> __lines[i]), '\\n')"
    out = computed(
        found,
        {
            "__text": f"if(gone IS NULL, text, {kept})",
            "n_lines": "CAST(size(__lines) AS BIGINT)",
            "n_removed": "CAST(coalesce(size(gone), 0) AS BIGINT)",
        },
    )
    return out.withColumn("text", F.col("__text")).drop("__id", "__hash", "gone", "__lines", "__text").withColumnsRenamed(back)


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with repeated lines removed, columns unchanged."""
    plain, back = renamed_in(docs, ("n_lines", "n_removed"))
    out = drop_repeated_lines(plain).drop("n_lines", "n_removed").withColumnsRenamed(back)
    return out.select(*[ref(c) for c in docs.columns])
