"""Quality rules: simple counts of a text, then a hashed n-gram likelihood ratio against trusted documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.functions.columns import ref
from lustra.llm.words import BLANKS, computed, has_word, renamed_in, without, word_list

BUCKETS = 10_000
TRUSTED = 100_000  # labelled documents, at most, that make the trusted target
SMOOTH = 30  # n-grams a bucket that the target is given in the corpus' own shares
KEEP_FROM = -0.06  # mean log ratio an n-gram needs; see ``judge``
FEWEST_WORDS = 20
REPEATED_PER_100 = 30
WINDOW = 8
_OWN = ("__words", "__hashes", "__two", "__four", "__eight", "__lines", "__sorted", "__places", "__grams", "__id", "__mark")
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_grams", "score", "kept")


def _with_words(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__words", F.expr(word_list("text"))).withColumn("__hashes", F.expr("transform(__words, w -> xxhash64(w))"))


def _pairs(name: str, apart: int) -> str:
    """Hashes of each element with the one ``apart`` later."""
    n = f"greatest(size({name}) - {apart}, 0)"
    return f"zip_with(slice({name}, 1, {n}), slice({name}, {apart + 1}, {n}), (a, b) -> xxhash64(a, b))"


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and hash arrays.

    Windows of eight words are compared by a 64-bit hash built from pairs of pairs of pairs.
    """
    out = _with_words(without(docs, RESULT))
    out = out.withColumn("__two", F.expr(_pairs("__hashes", 1)))
    out = out.withColumn("__four", F.expr(_pairs("__two", 2))).withColumn("__eight", F.expr(_pairs("__four", 4)))
    lines = f"filter(split(text, '\\n', -1), l -> {has_word('l')})"
    out = out.withColumn("__lines", F.expr(lines))
    # Only texts that repeat a window sort their windows; the places of those found twice follow from neighbours.
    out = out.withColumn(
        "__sorted",
        F.expr("if(size(array_distinct(__eight)) < size(__eight), array_sort(transform(__eight, (h, i) -> struct(h, i))), NULL)"),
    )
    same = "__sorted[{}].h = x.h"
    out = out.withColumn(
        "__places",
        F.expr(f"""array_sort(transform(filter(__sorted, (x, k) -> (k > 0 AND {same.format('k - 1')})
                   OR (k < size(__sorted) - 1 AND {same.format('k + 1')})), x -> x.i))"""),
    )
    steps = f"transform(__places, (p, k) -> if(k = size(__places) - 1, {WINDOW}, least({WINDOW}, __places[k + 1] - p)))"
    out = computed(
        out,
        {
            "n_words": "CAST(size(__words) AS BIGINT)",
            "word_chars": f"CAST(coalesce(length(translate(text, ' {BLANKS}', '')), 0) AS BIGINT)",
            "n_symbols": "CAST(coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0) AS BIGINT)",
            "n_dup_lines": "CAST(coalesce(size(__lines) - size(array_distinct(__lines)), 0) AS BIGINT)",
            "n_repeat_words": f"coalesce(aggregate({steps}, 0L, (n, s) -> n + s), 0L)",
        },
    )
    return out.withColumn("base_failed", F.expr(f"n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {REPEATED_PER_100} * n_words"))


def _grams(buckets: int) -> str:
    """Buckets of the words and of the pairs of neighbouring words."""
    return f"transform(concat(__hashes, __two), h -> CAST(pmod(h, {buckets}) AS INT))"


def fit_ratio(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log(p_trusted / p_raw) of every bucket: two multinomials over hashed words and word pairs.

    All documents count for the raw corpus; those whose doc_id is in ``trusted`` (distinct ids, a bounded
    number) count for the target as well.  A bucket's count in the target and the count that the corpus lets
    expect there are both raised by ``SMOOTH``, so buckets a small target can hardly hold stay near 0 instead
    of counting against text that it has not seen.  Counts are combined in each task, and ``buckets`` rows
    reach the driver whatever the size of the corpus.
    """
    marks = F.broadcast(trusted.selectExpr("doc_id AS __id", "1L AS __mark"))
    words = _with_words(docs.select("doc_id", "text")).withColumn("__two", F.expr(_pairs("__hashes", 1)))
    grams = words.join(marks, F.expr("doc_id = __id"), "left").select(F.explode(F.expr(_grams(buckets))).alias("bucket"), "__mark")
    counts = grams.groupBy("bucket").agg(F.expr("count(1) AS raw"), F.expr("count(__mark) AS target"))
    expected = "raw / sum(raw) OVER () * sum(target) OVER ()"
    total = counts.withColumn("share", F.expr(f"log((target + {SMOOTH}) / ({expected} + {SMOOTH}))"))
    ratio = [0.0] * buckets
    for row in total.select("bucket", "share").collect():
        ratio[row["bucket"]] = row["share"]
    return ratio


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """Up to ``most`` ids labelled as good quality, by a hash of the id: the bounded sample the target is fitted on."""
    return labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.expr("xxhash64(doc_id)"), "doc_id").limit(most)


def judge(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` with the counts, score (mean log ratio of its n-grams) and kept.

    A document is kept unless it fails the base rules or its score is below ``keep_from``; nothing is drawn
    at random.  Ordinary prose scores near 0, since it is most of the corpus and of the target alike; text
    whose n-grams the target lacks scores far below.  The cut lies below trusted documents scored without
    their own counts, as all others are.  Null and empty texts have zero counts and score and fail the base
    rules.  Repeated rows are judged each; without trusted ids all ratios are 0 and only the base rules
    count; an empty table gives an empty one.  Result columns replace input columns.
    """
    docs, back = renamed_in(docs, _OWN)
    ratio = fit_ratio(docs, trusted, buckets)
    weights = "array(" + ", ".join(f"{x!r}D" for x in ratio) + ")"
    out = base_counts(docs).withColumn("__grams", F.expr(_grams(buckets)))
    summed = f"aggregate(__grams, 0D, (s, g) -> s + {weights}[g])"
    out = computed(out, {"n_grams": "CAST(size(__grams) AS BIGINT)", "score": f"if(size(__grams) = 0, 0D, {summed} / size(__grams))"})
    out = out.withColumn("kept", F.expr(f"NOT base_failed AND score >= {float(keep_from)!r}D"))
    return out.drop(*_OWN).withColumnsRenamed(back)


def kept_documents(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The documents that the rules keep, columns unchanged."""
    plain, back = renamed_in(docs, RESULT)
    out = judge(plain, trusted).filter("kept").drop(*RESULT).withColumnsRenamed(back)
    return out.select(*[ref(c) for c in docs.columns])
