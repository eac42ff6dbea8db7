"""The pipeline stage by stage against plain versions of what each stage does."""

from __future__ import annotations

import pytest

import corpus_pipeline
from brute import base_row, hits, near, targets, thin_lines
from lustra.llm import quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, SF), name)
        out.append((name, docs.columns, {r["doc_id"]: r.asDict() for r in docs.collect()}))
    return out


def test_stages(spark, steps):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    judged = quality.judge(docs, quality.trusted_ids(spark.read.parquet(f"{SF}/labels.parquet")))
    kept = {r["doc_id"] for r in judged.collect() if not base_row(r["text"])[-1] and r["score"] >= quality.KEEP_FROM}
    assert set(steps[0][2]) == kept and all(s[1] == columns for s in steps[:-1])
    want = thin_lines([(d, texts[d]) for d in kept])
    assert {d: r["text"] for d, r in steps[1][2].items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in steps[1][2].values())
    groups = near(list(want.items()))
    assert set(steps[2][2]) == {d for d, (n, c) in groups.items() if c == d}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(steps[3][2]) == {d for d, r in steps[2][2].items() if not hits(r["text"], items)[-1]}
    assert 0 < len(steps[3][2]) < len(steps[2][2]) < len(kept) < len(texts)


def test_mix_stage(steps):
    before, after = steps[3][2], steps[4][2]
    sizes, taken = {}, {}
    for r in before.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + base_row(r["text"])[0]
    for r in after.values():
        assert 1 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * base_row(r["text"])[0]
    for source, target in targets(sizes).items():
        shortest = min((n for r in before.values() if r["source"] == source and (n := base_row(r["text"])[0])), default=0)
        assert abs(taken.get(source, 0) - target) <= 0.02 * target + shortest / 2 + 1


def test_run_equals_stages(spark, steps):
    rows = {r["doc_id"]: r.asDict() for r in corpus_pipeline.run(spark, SF).collect()}
    assert rows == steps[-1][2]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Null ids, texts and sources, empty and very long texts, repeated rows, ties, and columns with inner names."""
    text = " ".join(f"word{i % 37} other{i % 11}" for i in range(60))
    rows = [(None, text, "a"), (None, None, None), (1, None, "a"), (2, "", "b"), (3, " \n ", None), (4, text, "a"), (4, text, "a"), (5, text + " end", "b"), (6, "x " * 40_000, "c"), (7, "one\ntwo\nthree\nfour", "c")]
    df = spark.createDataFrame([(i, t, "en", s, len(t or ""), k) for k, (i, t, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, gone int")
    return df.selectExpr("*", "gone AS __id", "gone AS __words", "gone AS __hash", "gone AS size", "gone AS target", "gone AS n_words", "gone AS kept")


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, odd_docs, name):
    step = dict(corpus_pipeline.STAGES)[name]
    out = step(spark, odd_docs, SF)
    last = name == corpus_pipeline.STAGES[-1][0]
    assert out.columns == [*odd_docs.columns, *(["copies"] if last else [])]
    rows, given = out.collect(), {r["gone"]: r for r in odd_docs.collect()}
    assert all(r[c] == r["gone"] for r in rows for c in ("__id", "__words", "__hash", "size", "target", "n_words", "kept"))
    left = {r["gone"] for r in rows}
    if name == "quality_rules":
        assert left <= {0, 5, 6, 7} and {1, 2, 3, 4, 9} & left == set()
    elif name == "line_dedup":
        assert left == set(given) and all(r["text"] == given[r["gone"]]["text"] for r in rows)
    elif name == "near_duplicates":
        # One of the three copies and the near copy, all rows without words, and the others.
        assert len(left & {0, 5, 6, 7}) == 1 and {1, 2, 3, 4, 8, 9} <= left
    elif name == "decontamination":
        assert left == set(given)
    else:
        assert all(1 <= r["copies"] <= 3 for r in rows) and left & {1, 2, 3, 4} == set()
    assert step(spark, odd_docs.limit(0), SF).collect() == []
