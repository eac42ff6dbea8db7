"""Spelling variants: k-d trees over letter counts find words one edit apart, frequent ones are the forms of rare ones."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.session import stage

RUN = "[A-Za-zÀ-ÿ]"
SHORTEST = 7  # code points of a word
LEAST = 2  # occurrences of a word
RATIO = 10  # times a word's occurrences that its form has
SLIP = 31  # one of so many occurrences loses a code point
DIMS = 32  # letters a to z, all other code points folded into the rest
CELL = 20_000  # words of a cell of the shared tree
LEAF = 16  # words of a leaf inside a cell
QUERIES = 1 << 17  # words searched together in a cell
PAIRS = 1 << 20  # candidate pairs compared together

Nodes = dict[int, tuple[int, int, int, int]]  # dimension, greatest count on the left, left node, right node


def word_counts(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, slip: int = SLIP) -> DataFrame:
    """(word, n): runs of letters of whole texts, in lower case, of at least ``shortest`` code points and ``least`` occurrences.

    Occurrences whose checksum with the doc_id (null: empty) is a multiple of ``slip`` lose one code point.
    """
    # A run that is too short stays so when it loses a code point.
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{shortest},}}"), F.lit(0))).alias("run"))
    lower = runs.selectExpr("doc_id", "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run")
    drawn = lower.selectExpr("run", "crc32(concat(coalesce(CAST(doc_id AS STRING), ''), ':', run)) AS h")
    at = "CAST(h % length(run) AS INT)"
    word = f"if(h % {slip} = 0, concat(substring(run, 1, {at}), substring(run, {at} + 2)), run) AS word"
    found = drawn.selectExpr(word).filter(f"length(word) >= {shortest}").groupBy("word").agg(F.expr("count(1) AS n"))
    return found.filter(f"n >= {least}")


def letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.array(words, f"<U{len(words[0])}").view(np.uint32).reshape(len(words), -1)


def letter_counts(points: np.ndarray) -> np.ndarray:
    """How often each letter occurs, a row per dimension; one edit changes one count by one, or two of them."""
    low = points - 97
    dim = np.where(low < 26, low, 26 + points % (DIMS - 26)).astype(np.int64)
    out = np.zeros((len(points), DIMS), np.int64)
    np.add.at(out, (np.arange(len(points))[:, None], dim), 1)
    return np.ascontiguousarray(np.minimum(out, 255).astype(np.uint8).T)


def grown(counts: np.ndarray) -> tuple[Nodes, dict[int, np.ndarray]]:
    """A k-d tree over the columns of ``counts``: nodes from 0, and the points of each leaf.

    A node is split where one count parts its points most evenly; points with the same counts stay together.
    """
    nodes, leaves, stack, new = {}, {}, [(0, np.arange(counts.shape[1]))], 1
    while stack:
        node, points = stack.pop()
        best = None
        if len(points) > LEAF:
            held = counts[:, points]
            for value in range(int(held.max())):
                left = (held <= value).sum(axis=1)
                off = np.abs(2 * left - len(points))
                off[(left == 0) | (left == len(points))] = np.iinfo(np.int64).max
                dim = int(np.argmin(off))
                if off[dim] < np.iinfo(np.int64).max and (best is None or off[dim] < best[0]):
                    best = (off[dim], dim, value)
        if best is None:
            leaves[node] = points
            continue
        _, dim, value = best
        below = counts[dim, points] <= value
        nodes[node] = (dim, value, new, new + 1)
        stack += [(new, points[below]), (new + 1, points[~below])]
        new += 2
    return nodes, leaves


def reached(nodes: Nodes, root: int, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, queries) for every leaf whose box holds points that some queries reach.

    A query, a column of ``counts``, may gain ``up`` letters and lose ``down``.  What it must gain and lose to
    enter a box grows on the way down, and it is pruned where that is too much.
    """
    n = counts.shape[1]
    stack = [(root, np.arange(n), np.zeros(n, np.int16), np.zeros(n, np.int16), {}, {})]
    while stack:
        node, at, gain, loss, low, high = stack.pop()
        if not len(at):
            continue
        if node not in nodes:
            yield node, at
            continue
        dim, value, left, right = nodes[node]
        own = counts[dim][at].astype(np.int16)
        lost = loss + np.maximum(own - value, 0) - np.maximum(own - high.get(dim, 255), 0)
        gained = gain + np.maximum(value + 1 - own, 0) - np.maximum(low.get(dim, 0) - own, 0)
        a, b = lost <= down, gained <= up
        stack.append((left, at[a], gain[a], lost[a], low, {**high, dim: min(value, high.get(dim, 255))}))
        stack.append((right, at[b], gained[b], loss[b], {**low, dim: max(value + 1, low.get(dim, 0))}, high))


def _marks(counts: np.ndarray) -> np.ndarray:
    """64 bits a word: which letters occur, and which occur twice."""
    bit = np.uint64(1) << np.arange(DIMS, dtype=np.uint64)
    once = ((counts >= 1) * bit[:, None]).sum(axis=0, dtype=np.uint64)
    return once | (((counts >= 2) * bit[:, None]).sum(axis=0, dtype=np.uint64) << np.uint64(DIMS))


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows of code points are one replacement apart (equal lengths), or one insertion into the shorter."""
    n = short.shape[1]
    if n == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    front = np.logical_and.accumulate(short == long[:, :n], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= n


class Cell:
    """Words of one length with a k-d tree of their own."""

    def __init__(self, words: list[str], n: np.ndarray):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words, self.n = [words[i] for i in order], n[order]
        self.points = letters(self.words)
        counts = letter_counts(self.points)
        self.marks = _marks(counts)
        self.nodes, self.leaves = grown(counts)

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of all pairs one edit apart; queries are as long as the words, or one code point shorter."""
        counts = letter_counts(queries)
        marks = _marks(counts)
        down = int(queries.shape[1] == self.points.shape[1])
        found: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        held, size = [], 0

        def verify() -> None:
            q, w = (np.concatenate(x) for x in zip(*held))
            ok = one_edit(queries[q], self.points[w])
            found.append((q[ok], w[ok]))
            held.clear()

        for leaf, at in reached(self.nodes, 0, counts, 1, down):
            inside = self.leaves[leaf]
            own = self.marks[inside]
            step = max(1, PAIRS // len(inside))
            for i in range(0, len(at), step):
                asked = marks[at[i : i + step]][:, None]
                fits = (np.bitwise_count(own & ~asked) <= 1) & (np.bitwise_count(asked & ~own) <= down)
                q, w = np.nonzero(fits)
                held.append((at[i : i + step][q], inside[w]))
                size += len(q)
                if size >= PAIRS:
                    verify()
                    size = 0
        if held:
            verify()
        q, w = (np.concatenate(x) for x in zip(*found))
        return q, w


def _best(who: np.ndarray, of: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per value of ``who``: how many partners it has, and the one of largest n, of equals the first; ``of`` is in order of words."""
    order = np.lexsort((of, -n[of], who))
    who, of = who[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]) if len(who) else np.empty(0, bool))
    return who[first], np.diff(np.append(first, len(who))), of[first]


_PARTIAL = "word string, n long, near long, best_n long, best string"


def _partial(words: list[str], near: np.ndarray, partners: list[str], n: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(words, pa.string()), pa.nulls(len(words), pa.int64()), pa.array(near, pa.int64()), pa.array(n, pa.int64()), pa.array(partners, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n", "near", "best_n", "best"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What words know of their partners in a cell.  Rows come by cell: its words, then queries of each kind.

    Of words of equal length each asks; of two lengths the shorter one asks and both get an answer.
    """
    cell, kind, held, tree = None, None, [], None
    words: list[str] = []
    counts: list[np.ndarray] = []

    def answer() -> Iterator[pa.RecordBatch]:
        nonlocal words, counts
        if words and tree is not None:
            n = np.concatenate(counts)
            order = sorted(range(len(words)), key=words.__getitem__)
            asked, n = [words[i] for i in order], n[order]
            q, w = tree.near(letters(asked))
            who, near, best = _best(q, w, tree.n)
            yield _partial([asked[i] for i in who], near, [tree.words[i] for i in best], tree.n[best])
            if kind == 2:
                who, near, best = _best(w, q, n)
                yield _partial([tree.words[i] for i in who], near, [asked[i] for i in best], n[best])
        words, counts = [], []

    for batch in batches:
        at, what, n = (batch.column(i).to_numpy() for i in (0, 1, 3))
        text = batch.column(2).to_pylist()
        edges = np.flatnonzero((at[1:] != at[:-1]) | (what[1:] != what[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(at)]):
            if b == a:
                continue
            if (at[a], what[a]) != (cell, kind):
                if kind == 0:
                    tree = Cell(words, np.concatenate(counts))
                    words, counts = [], []
                else:
                    yield from answer()
                if at[a] != cell and what[a] != 0:
                    tree = None
                cell, kind = at[a], what[a]
            for i in range(a, b, QUERIES):
                words += text[i : min(b, i + QUERIES)]
                counts.append(n[i : min(b, i + QUERIES)])
                if kind != 0 and len(words) >= QUERIES:
                    yield from answer()
    if kind != 0:
        yield from answer()


class SharedTree:
    """The upper part of the k-d trees, one root a length, whose leaves are the cells dealt out to tasks."""

    def __init__(self):
        self.roots: dict[int, int] = {}
        self.nodes: Nodes = {}
        self.pieces: dict[int, int] = {}  # of cells of more than CELL words with the same counts

    def own(self, length: int, counts: np.ndarray) -> np.ndarray:
        """The leaf of every column of ``counts``."""
        out = np.full(counts.shape[1], -1, np.int64)
        if length in self.roots:
            for leaf, at in self._down(self.roots[length], counts):
                out[at] = leaf
        return out

    def _down(self, root: int, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        stack = [(root, np.arange(counts.shape[1]))]
        while stack:
            node, at = stack.pop()
            if node not in self.nodes:
                yield node, at
            elif len(at):
                dim, value, left, right = self.nodes[node]
                below = counts[dim][at] <= value
                stack += [(left, at[below]), (right, at[~below])]


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(length, words, n) of every batch, words of a length together."""
    for batch in batches:
        words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        lengths = np.array([len(w) for w in words], np.int64)
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            yield int(length), [words[i] for i in at], n[at]


def shared_tree(words: DataFrame, cell: int = CELL) -> SharedTree:
    """Split lengths, then cells of more than ``cell`` words, until none can be split.

    A level is one job: tasks count the letters of the words in open cells, sums are taken by cell, dimension
    and value, and of every open cell one row comes to the driver, which is one for ``cell`` words at least.
    """
    tree = SharedTree()
    lengths = words.groupBy(F.expr("length(word) AS length")).agg(F.expr("count(1) AS n")).orderBy("length").collect()
    tree.roots = {r["length"]: i for i, r in enumerate(lengths)}
    open_ = {i for i, r in enumerate(lengths) if r["n"] > cell}
    new = len(lengths)
    while open_:

        def histograms(batches: Iterator[pa.RecordBatch], tree: SharedTree = tree, open_: set = open_) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for length, held, _ in _by_length(batches):
                counts = letter_counts(letters(held))
                own = tree.own(length, counts)
                for leaf in np.unique(own).tolist():
                    if leaf in open_:
                        inside = counts[:, own == leaf].astype(np.int64) + 256 * np.arange(DIMS)[:, None]
                        total[leaf] = total.get(leaf, 0) + np.bincount(inside.ravel(), minlength=256 * DIMS)
            for leaf, sums in total.items():
                at = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), leaf)), pa.array(at // 256), pa.array(at % 256), pa.array(sums[at])], names=["leaf", "dim", "value", "n"])

        sums = words.mapInArrow(histograms, "leaf long, dim long, value long, n long").groupBy("leaf", "dim", "value").agg(F.expr("sum(n) AS n"))
        ranked = sums.selectExpr(
            "leaf", "dim", "value", "sum(n) OVER (PARTITION BY leaf, dim ORDER BY value) AS below", "sum(n) OVER (PARTITION BY leaf, dim) AS total"
        )
        best = ranked.groupBy("leaf").agg(F.expr("max(total) AS total"), F.expr("min(if(below < total, struct(abs(2 * below - total) AS off, dim, value, below), null)) AS s"))
        found = best.orderBy("leaf").collect()
        open_ = set()
        for r in found:
            if r["s"] is None:
                tree.pieces[r["leaf"]] = -(-r["total"] // cell)
                continue
            tree.nodes[r["leaf"]] = (r["s"]["dim"], r["s"]["value"], new, new + 1)
            open_ |= {leaf for leaf, n in ((new, r["s"]["below"]), (new + 1, r["total"] - r["s"]["below"])) if n > cell}
            new += 2
    return tree


def _routed(tree: SharedTree):
    """Every word to its cell (kind 0), and to each cell of its length (1) and the next (2) that one edit reaches."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, words, n in _by_length(batches):
            counts = letter_counts(letters(words))
            text = pa.array(words, pa.string())

            def rows(leaf: int, kind: int, at: np.ndarray, piece: np.ndarray) -> pa.RecordBatch:
                columns = [pa.array(leaf << 24 | piece), pa.array(np.full(len(at), kind)), text.take(pa.array(at)), pa.array(n[at])]  # noqa: B023
                return pa.RecordBatch.from_arrays(columns, names=["cell", "kind", "word", "n"])

            own = tree.own(length, counts)
            for leaf in np.unique(own).tolist():
                at = np.flatnonzero(own == leaf)
                pieces = tree.pieces.get(leaf, 1)
                yield rows(leaf, 0, at, np.array([crc32(words[i].encode()) % pieces for i in at], np.int64))
            for kind, to, down in ((1, length, 1), (2, length + 1, 0)):
                if to not in tree.roots:
                    continue
                for leaf, at in reached(tree.nodes, tree.roots[to], counts, 1, down):
                    for piece in range(tree.pieces.get(leaf, 1)):
                        yield rows(leaf, kind, at, np.full(len(at), piece, np.int64))

    return route


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """(word, n, n_near, best, best_n) of every word: how many words are one inserted, deleted or replaced code
    point away, and of these the one of largest n (ties: smallest in code-point order), null if there is none.

    ``words`` has distinct words and n.  Words are points by their letter counts, in one k-d tree a length.
    The upper levels are shared: their leaves, of at most ``cell`` words, go to tasks, where each grows on.  A
    word visits the cells whose box it can reach by gaining and losing a letter (its own length) or by gaining one
    (the next length), and there the leaves alike; what is left is compared letter by letter.  Words with the same
    counts beyond ``cell`` are dealt out in pieces, all of which are asked.  Tasks send one row per word and cell.
    """
    tree = shared_tree(words, cell)
    dealt = words.mapInArrow(_routed(tree), "cell long, kind long, word string, n long")
    found = dealt.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(_searched, _PARTIAL)
    every = words.selectExpr("word", "n", "0L AS near", "CAST(null AS BIGINT) AS best_n", "CAST(null AS STRING) AS best").unionAll(found)
    best = "min(if(best IS NULL, null, struct(-best_n AS less, best))) AS b"
    out = every.groupBy("word").agg(F.expr("max(n) AS n"), F.expr("sum(near) AS n_near"), F.expr(best))
    return out.selectExpr("word", "n", "n_near", "b.best AS best", "-b.less AS best_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following (word, form) ends.  Every round joins the table with itself and doubles the steps."""
    at = stage(forms.selectExpr("word", "form AS root"), "roots")
    while True:
        next_ = at.selectExpr("word AS __word", "root AS further")
        found = stage(at.join(next_, at["root"] == next_["__word"], "left").selectExpr("word", "coalesce(further, root) AS root", "further IS NOT NULL AS moved"), "roots")
        at = found.drop("moved")
        if found.filter("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO, cell: int = CELL) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of :func:`word_counts`.

    A word's form is its most frequent near word (see :func:`near_words`) if that occurs at least ``ratio`` times
    as often (more than once as often, so following forms ends); root is the last form on the way, the word itself
    if it has none.  Null and empty texts have no words, a null doc_id counts as an empty one, repeated rows are
    counted each, an empty table gives no words, other columns are ignored, and a word may be of any length.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = stage(word_counts(docs, shortest, least), "words")
    near = stage(near_words(words, cell), "near")
    has = f"best_n >= {ratio} * n"
    ends = roots(near.filter(has).selectExpr("word", "best AS form"))
    joined = near.join(ends, "word", "left")
    return joined.selectExpr("word", f"if({has}, best, null) AS form", "coalesce(root, word) AS root", "n", "n_near", f"if({has}, best_n, null) AS form_n")
