"""Near duplicates by Jaccard similarity of word 5-gram sets: a size-aware join of light and heavy sets."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.functions.columns import ref
from lustra.llm.components import components
from lustra.llm.words import has_word, renamed_in
from lustra.session import discard, stage

WORDS = 5
PER_100 = 75  # two sets link when 100 * intersection >= PER_100 * union
CELLS = 1 << 21  # counters of the frequency sketch; a size of the plan, not of the result
BLOCK = 1 << 12  # counters moved as one value
COLD = 4096  # a token whose sketch counter is below this has a list short enough for one task
FEW = 3  # sets of a list that is told by its pairs: these are no more than its rows
MOST_LIGHT = 16  # largest boundary between light and heavy sets that is weighed
NARROWINGS = 4  # times the candidates are counted and listed anew at most
WORTH = 8  # narrowing ends with a turn that leaves out less than one set in so many
MARKS = 1 << 25  # bits of a map of names; a size of the plan, not of the result
MARK_BLOCK = 1 << 15  # bits that Spark's bitmaps hold
SPREAD = 1 << 9  # counters of one set
FULL = 255  # what such a counter holds at most
HUB_ROUNDS = 3

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.array([2 * k + 1 for k in (0x4F1BBCDCBFA53E0A, 0x2545F4914F6CDD1D, 0x632BE59BD9B4E019, 0x1B873593CC9E2D51, 0x38B34AE5A1E38B93)], dtype=np.uint64)
LISTED = ["token", "sid", "n", "reach", "other", "shared"]


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word 5-grams of a text; all words as one if there are fewer."""
    words = text.translate(_LOWER).split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), n)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    s = h[: n - WORDS + 1] * _ODD[0]
    for k in range(1, WORDS):
        s ^= s >> np.uint64(29)
        s += h[k : n - WORDS + 1 + k]
        s *= _ODD[k]
    s ^= s >> np.uint64(32)
    return np.unique(s)


def set_id(tokens: np.ndarray) -> int | None:
    """64-bit name of a set; equal sets have equal names, and none has no name."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())))) if len(tokens) else None


def least_overlap(n: int, m: int) -> int:
    """Smallest intersection that links sets of these sizes."""
    return -(-PER_100 * (n + m) // (100 + PER_100))


def smallest_partner(n: int) -> int:
    return -(-PER_100 * n // 100)


def largest_partner(n: int) -> int:
    return 100 * n // PER_100


def prefix_length(n: int) -> int:
    """So many tokens, in any order common to all sets, hold one that a linked set has in its own prefix."""
    return n - smallest_partner(n) + 1


def reach(n, place):
    """Largest partner that can still link with a set of ``n`` tokens when their first common one is at ``place``."""
    return (100 * n - (100 + PER_100) * place) // PER_100


def light_cost(n: int) -> int:
    """Subsets that a light set of ``n`` tokens is enumerated into."""
    return sum(comb(n, least_overlap(n, m)) for m in range(smallest_partner(n), largest_partner(n) + 1) if least_overlap(n, m) <= n)


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """Largest light size: where enumerating subsets of all sets up to it costs least in total.

    ``sizes`` counts the sets of each small size; a heavy set scans a list for every token of its prefix.
    """
    best, at, saved = 0.0, 0, 0.0
    for n in range(1, MOST_LIGHT + 1):
        saved += sizes.get(n, 0) * (prefix_length(n) * (1 + list_length) - light_cost(n))
        if saved > best:
            best, at = saved, n
    return at


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    return (t.as_py() for t in batch.column("text").cast(pa.binary()))


def _count(seen: np.ndarray, tokens: np.ndarray) -> None:
    np.add.at(seen, (tokens & np.uint64(CELLS - 1)).astype(np.int64), 1)


def _blocks(seen: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Blocks of counters that have counted anything, packed."""
    used = np.flatnonzero(seen.reshape(-1, BLOCK).any(1))
    return pa.array(used), pa.array([zlib.compress(seen[k * BLOCK : (k + 1) * BLOCK].tobytes(), 1) for k in used], pa.binary())


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks of a partition."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            seen = np.frombuffer(zlib.decompress(counts), np.int64)
            total[k] = total[k] + seen if k in total else seen
    packed = [zlib.compress(total[k].tobytes(), 1) for k in total]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(packed, pa.binary())], names=["block", "counts"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, with the tokens of small sets, then what the task has counted in the sketch."""
    names = ["doc_id", "text_hash", "n", "sid", "tokens", "block", "counts"]
    seen = np.zeros(CELLS, np.int64)
    for batch in batches:
        ns, sids, small, met = [], [], [], set()
        for text in _texts(batch):
            tokens = shingle_set(text)
            sid = set_id(tokens)
            ns.append(len(tokens))
            sids.append(sid)
            small.append(tokens.tobytes() if 0 < len(tokens) <= MOST_LIGHT else None)
            if sid not in met:
                met.add(sid)
                _count(seen, tokens)
        empty = [pa.nulls(len(ns), pa.int64()), pa.nulls(len(ns), pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(ns, pa.int64()), pa.array(sids, pa.int64()), pa.array(small, pa.binary()), *empty],
            names=names,
        )
    blocks, counts = _blocks(seen)
    empty = pa.nulls(len(blocks), pa.int64())
    yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.nulls(len(blocks), pa.binary()), blocks, counts], names=names)


def _recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(CELLS, np.int64)
    for batch in batches:
        for text in _texts(batch):
            _count(seen, shingle_set(text))
    yield pa.RecordBatch.from_arrays(list(_blocks(seen)), names=["block", "counts"])


def _spread(tokens: np.ndarray) -> bytes:
    """The tokens of a set, counted by their low bits; a counter that is FULL tells nothing."""
    return np.minimum(np.bincount((tokens & np.uint64(SPREAD - 1)).astype(np.int64), minlength=SPREAD), FULL).astype(np.uint8).tobytes()


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, text, spread) of texts that have a set."""
    for batch in batches:
        sets = [shingle_set(text) for text in _texts(batch)]
        some = [k for k, tokens in enumerate(sets) if len(tokens)]
        sids, spreads = pa.array([set_id(sets[k]) for k in some], pa.int64()), pa.array([_spread(sets[k]) for k in some], pa.binary())
        yield pa.RecordBatch.from_arrays([sids, batch.column("text").take(pa.array(some, pa.int64())), spreads], names=["sid", "text", "spread"])


def _prefixes(sent, light: int):
    """(token, sid, n, reach, cold) of the prefixes of all sets that can link with a heavy one, rare tokens first."""
    least = smallest_partner(light + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sent.value
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            met: set[int | None] = {None}
            for text in _texts(batch):
                tokens = shingle_set(text)
                n, sid = len(tokens), set_id(tokens)
                if n < least or sid in met:
                    continue
                met.add(sid)
                counts = seen[(tokens & np.uint64(CELLS - 1)).astype(np.int64)]
                first = np.lexsort((tokens, counts))[: prefix_length(n)]
                k = len(first)
                parts.append((tokens[first].view(np.int64), np.full(k, sid, np.int64), np.full(k, n), reach(n, np.arange(k)), counts[first] < COLD))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["token", "sid", "n", "reach", "cold"])

    return run


def _fitting(n: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which rows of one list have another that both reach.

    By size: among the rows up to one's own reach, the farthest reach of another must come back to it.
    """
    order = np.argsort(n, kind="stable")
    sizes, back = n[order], far[order]
    best = np.maximum.accumulate(back)
    at = np.maximum.accumulate(np.where(back == best, np.arange(len(back)), 0))
    # The farthest without the row that is farthest itself.
    second = np.full(len(back), -1)
    for k in range(1, len(back)):
        second[k] = max(second[k - 1], best[k - 1] if back[k] >= best[k - 1] else back[k])
    upto = np.searchsorted(sizes, back, "right") - 1
    other = np.where(upto < 0, -1, np.where(at[upto] == np.arange(len(back)), second[upto], best[upto]))
    out = np.empty(len(n), bool)
    out[order] = other >= sizes
    return out


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fitting pairs of short cold lists, with the number of lists; of longer ones the rows that fit another; hot rows as they are.

    Each row counts once.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    names = ["token", "sid", "n", "reach", "cold"]
    token, sid, n, far, cold = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in names)
    order = np.lexsort((sid, token))
    token, sid, n, far, cold = (a[order] for a in (token, sid, n, far, cold))
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
    token, sid, n, far, cold = (a[new] for a in (token, sid, n, far, cold))
    keep = ~cold
    edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
    sizes = np.diff(edges)
    short = [(edges[:-1][(sizes == k) & cold[edges[:-1]]], i, j) for k in range(2, FEW + 1) for i, j in combinations(range(k), 2)]
    low, high = (np.concatenate([at + x[k] for at, *x in short]) for k in (0, 1))
    fit = (n[low] <= far[high]) & (n[high] <= far[low])
    # The rows of a list are in the order of their sets.
    pairs, shared = np.unique(np.stack([sid[high[fit]], sid[low[fit]]], 1), axis=0, return_counts=True)
    for k in np.flatnonzero(sizes > FEW):
        a, b = edges[k], edges[k + 1]
        if cold[a]:
            keep[a:b] = _fitting(n[a:b], far[a:b])
    kept = int(keep.sum())
    nothing, unpaired = pa.nulls(len(pairs), pa.int64()), pa.nulls(kept, pa.int64())
    yield pa.RecordBatch.from_arrays([*(pa.array(c[keep]) for c in (token, sid, n, far)), unpaired, unpaired], names=LISTED)
    yield pa.RecordBatch.from_arrays([nothing, pa.array(pairs[:, 0]), nothing, nothing, pa.array(pairs[:, 1]), pa.array(shared)], names=LISTED)


def _subsets(light: int):
    """(key, low, sid): the subsets of every light set that are as large as a link with a partner size asks.

    Keys hold the two sizes; ``low`` tells that the set has the smaller one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lows, sids = [], [], []
            for sid, data in zip(batch.column("sid").to_pylist(), batch.column("tokens").to_pylist()):
                raw = [data[i : i + 8] for i in range(0, len(data), 8)]
                n = len(raw)
                for m in range(smallest_partner(n), min(largest_partner(n), light) + 1):
                    need = least_overlap(n, m)
                    if need > min(n, m):
                        continue
                    tag = min(n, m) * 1000 + max(n, m)
                    for chosen in combinations(raw, need):
                        keys.append(int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(b"".join(chosen), tag)))))
                        lows.append(n <= m)
                        sids.append(sid)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lows, pa.bool_()), pa.array(sids, pa.int64())], names=["key", "low", "sid"])

    return run


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that may link: sets have no more tokens in common than the smaller of their counters add up to."""
    for batch in batches:
        a, b = (np.array([np.frombuffer(x, np.uint8) for x in batch.column(c).to_pylist()], np.int64).reshape(-1, SPREAD) for c in ("spread_a", "spread_b"))
        need = -(-PER_100 * (a.sum(1) + b.sum(1)) // (100 + PER_100))
        may = (np.minimum(a, b).sum(1) >= need) | (a == FULL).any(1) | (b == FULL).any(1)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(may))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that link, decided on the whole sets."""
    hub_id, hub = None, None
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        ta, tb = batch.column("text_a").cast(pa.binary()), batch.column("text_b").cast(pa.binary())
        keep = []
        for i, b_id in enumerate(b):
            if b_id != hub_id:
                hub_id, hub = b_id, shingle_set(tb[i].as_py())
            one = shingle_set(ta[i].as_py())
            both = len(np.intersect1d(one, hub, assume_unique=True))
            keep.append(100 * both >= PER_100 * (len(one) + len(hub) - both))
        keep = np.array(keep, bool)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[keep]), pa.array(np.array(b, np.int64)[keep])], names=["a", "b"])


def _light_links(base: DataFrame, light: int) -> DataFrame:
    """Star links of sets that share a subset: a set of the smaller size links with all others of its key."""
    sets = base.filter(f"n BETWEEN 1 AND {light}").groupBy("sid").agg(F.expr("min(tokens) AS tokens"))
    rows = stage(sets.mapInArrow(_subsets(light), "key long, low boolean, sid long"), "subsets")
    centre = rows.filter("low").groupBy("key").agg(F.expr("min(sid) AS centre"))
    return rows.join(centre, "key").filter("sid != centre").selectExpr("sid AS a", "centre AS b").distinct()


def _sketch(counted: DataFrame) -> np.ndarray:
    """The counters on the driver: CELLS numbers, whatever the input."""
    seen = np.zeros(CELLS, np.int64)
    for row in counted.repartition("block").mapInArrow(_added, "block long, counts binary").collect():
        seen[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] += np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return seen


def _inverted(texts: DataFrame, seen: np.ndarray, light: int) -> DataFrame:
    """Staged inverted lists of the texts' prefixes, only rows that fit another row of their list.

    Lists of cold tokens meet in one task and are bounded by COLD; those of hot ones are spread and kept.
    Most lists have two or three sets, and most pairs of sets that meet there meet in many lists: of them only
    the pairs (sid, other) are told, and the number of lists that a task has seen them in.
    """
    sent = texts.sparkSession.sparkContext.broadcast(seen)
    rows = texts.mapInArrow(_prefixes(sent, light), "token long, sid long, n long, reach long, cold boolean")
    rows = rows.repartition("token", F.expr("if(cold, 0, pmod(sid, 64))"))
    return stage(rows.mapInArrow(_lists, ", ".join(f"{c} long" for c in LISTED)), "lists")


def _named(rows: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """The rows whose 64-bit ``key`` is in the one column of ``names``, and few others; no row is shuffled.

    A map of the names' low bits, of MARKS bits whatever the input, goes to every task.  A row whose bit is that
    of another name stays, so what must be exact joins afterwards.
    """
    at = names.toDF("__name").filter("__name IS NOT NULL").selectExpr(f"pmod(__name, {MARKS}) AS __at")
    marks = at.groupBy(F.expr(f"__at DIV {MARK_BLOCK}").alias("__block")).agg(F.expr(f"bitmap_construct_agg(__at % {MARK_BLOCK})").alias("__bits"))
    place = f"CAST(pmod({key}, {MARK_BLOCK}) AS INT)"
    byte = f"CAST(conv(hex(substring(__bits, 1 + shiftright({place}, 3), 1)), 16, 10) AS INT)"
    met = f"pmod({key}, {MARKS}) DIV {MARK_BLOCK} = __block AND bit_get({byte}, {place} % 8) = 1"
    return rows.join(F.broadcast(marks), F.expr(met), "left_semi")


def _listed(lists: DataFrame) -> DataFrame:
    """The sets of lists and pairs."""
    return lists.selectExpr("sid").unionAll(lists.filter("other IS NOT NULL").selectExpr("other")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, comp) of every row; comp names the component, null without shingles.

    Documents link when their sets of word 5-grams (A-Z as a-z; fewer words are one shingle) have a Jaccard
    similarity of 0.75 or more; component_id is the smallest doc_id that links lead to.  Null texts and texts
    without words have no shingles and link with nothing.  Rows may repeat and ids too: a node is a distinct
    set, so copies cost one set and are no pairs.  A null doc_id never names a component unless all its ids
    are null.  An empty table gives an empty one; other columns are ignored.

    * Light sets, up to a size chosen by cost, are enumerated into subsets as large as a link asks.  Sharing
      one is linking, so each subset is a star and nothing is left to compare.
    * Heavy sets scan the inverted lists of their prefixes, the rarest tokens by a sketch of all documents
      (which only orders tokens: any sketch gives the same links).  A token's place in a set bounds the sizes
      it can link with; sets without a fitting partner in any list are done.  The others are counted and
      listed anew while that leaves sets out, which sharpens the order.  Short lists are told by their pairs, longer ones have a hub each.
      Then every set is compared whole with the hub or partner that shares most lists with it and lies in another
      component, and at last all fitting pairs of lists between components.  Longer lists make no pairs inside
      a component.
    """
    scanned = docs.selectExpr("doc_id", "text", "xxhash64(text) AS text_hash")
    scanned = stage(scanned.mapInArrow(_scan, "doc_id long, text_hash long, n long, sid long, tokens binary, block long, counts binary"), "sets")
    base = scanned.filter("block IS NULL").drop("block", "counts")
    seen = _sketch(scanned.filter("block IS NOT NULL").select("block", "counts"))
    small = base.filter(f"n BETWEEN 1 AND {MOST_LIGHT}").groupBy("n").agg(F.expr("count(DISTINCT sid) AS sets")).collect()
    total = float(seen.sum()) or 1.0
    light = boundary({r["n"]: r["sets"] for r in small}, float((seen.astype(float) ** 2).sum()) / total)
    links = _light_links(base, light) if light else docs.sparkSession.createDataFrame([], "a long, b long")
    comps = stage(components(links), "components")

    lists = _inverted(docs.select("text"), seen, light)
    if not lists.isEmpty():
        texts = _texts_of(lists, base, docs)
        left = texts.count()
        for _ in range(NARROWINGS - 1):
            wider, listed, before = texts, lists, left
            lists = _inverted(texts, _sketch(texts.mapInArrow(_recount, "block long, counts binary")), light)
            texts = stage(_named(texts, "sid", _listed(lists)), "texts")
            discard(wider, listed)
            left = texts.count()
            if (before - left) * WORTH < before:
                break
        comps = _search(texts, lists, comps)

    ids = base.groupBy("sid").agg(F.min("doc_id").alias("first")).filter("sid IS NOT NULL")
    named = ids.join(comps, F.expr("sid = node"), "left").selectExpr("sid", "first", "coalesce(comp, sid) AS comp")
    names = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    by_set = named.join(names, "comp").selectExpr("sid AS __sid", "comp", "component_id")
    out = base.join(by_set, F.expr("sid = __sid"), "left")
    return out.selectExpr("doc_id", "text_hash", "n AS n_shingles", "if(sid IS NULL, doc_id, component_id) AS component_id", "comp")


def _texts_of(lists: DataFrame, base: DataFrame, docs: DataFrame) -> DataFrame:
    """Staged (sid, text, spread) of every listed set, the text of one of its documents, and of few others; no text is shuffled."""
    chosen = base.join(_listed(lists), "sid", "left_semi").groupBy("sid").agg(F.expr("min(struct(doc_id, text_hash)) AS one"))
    # Rows that repeat an id and a text are few, and equal: any of them will do.
    found = _named(docs.select("doc_id", "text"), "xxhash64(xxhash64(text), CAST(doc_id AS BIGINT))", chosen.selectExpr("xxhash64(one.text_hash, one.doc_id)"))
    kind = docs.schema["text"].dataType.simpleString()
    return stage(found.select("text").mapInArrow(_held, f"sid long, text {kind}, spread binary"), "texts")


def _search(texts: DataFrame, lists: DataFrame, comps: DataFrame) -> DataFrame:
    """Components after comparing sets that share a list until no list has an open pair."""
    tested, listed = None, lists
    near = lists.filter("other IS NOT NULL").groupBy("sid", "other").agg(F.expr("sum(shared) AS shared"))
    near = stage(near.selectExpr("sid AS a", "other AS b", "shared"), "near")
    lists = lists.filter("other IS NULL").drop("other", "shared")
    for turn in range(HUB_ROUNDS + 1):
        if turn == 1:
            # Most lists lie in one component by now.
            rows = _with_components(lists, comps)
            lists = stage(rows.join(_open(rows).select("token"), "token", "left_semi").select("token", "sid", "n", "reach"), "open")
            discard(listed)
        if turn:
            known = near
            near = stage(_apart(known.join(pairs, ["a", "b"], "left_anti"), comps), "near")
            discard(known)
        if turn and lists.isEmpty() and near.isEmpty():
            break
        rows = _with_components(lists, comps)
        met = near if turn else _apart(near, comps)
        pairs = _all_pairs(rows, met) if turn == HUB_ROUNDS else _hub_pairs(rows, met, turn)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stage(pairs, "pairs")
        links, apart = _linked(pairs, texts), comps
        comps = _united(apart, links)
        discard(links, apart)
        tested = pairs if tested is None else tested.unionAll(pairs)
    return comps


def _apart(near: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b, shared) whose sets lie in two components."""
    own = comps.selectExpr("node AS x", "comp AS cx")
    rows = near.join(own, F.expr("a = x"), "left").selectExpr("a", "b", "shared", "coalesce(cx, a) AS ca")
    return rows.join(own, F.expr("b = x"), "left").filter("ca != coalesce(cx, b)").select("a", "b", "shared")


def _with_components(lists: DataFrame, comps: DataFrame) -> DataFrame:
    return lists.join(comps, F.expr("sid = node"), "left").selectExpr("token", "sid", "n", "reach", "coalesce(comp, sid) AS comp")


def _open(rows: DataFrame, **wanted: str) -> DataFrame:
    """Lists with sets of several components, with the ``wanted`` aggregates of each."""
    found = rows.groupBy("token").agg(F.expr("min(comp) AS least"), F.expr("max(comp) AS most"), *[F.expr(x).alias(n) for n, x in wanted.items()])
    return found.filter("least != most").drop("least", "most")


def _hub_pairs(rows: DataFrame, met: DataFrame, turn: int) -> DataFrame:
    """Each set with the hub, or partner of short lists, of another component that it shares most lists with.

    The hub of a list is the set with the longest reach for its size, the one with most in common with
    others; in every other turn it is drawn by a hash.  The sets of a hub's own component leave the join at once.
    """
    hub = f"max_by(struct(sid, n, reach, comp), struct({'reach / n' if turn % 2 == 0 else '0'}, xxhash64(sid, {turn})))"
    hubs = _open(rows, hub=hub).withColumnRenamed("token", "__token")
    near = rows.join(hubs, F.expr("token = __token AND comp != hub.comp AND n <= hub.reach AND hub.n <= reach"))
    shared = near.selectExpr("sid", "hub.sid AS h").groupBy("sid", "h").agg(F.expr("count(1) AS shared"))
    both = met.select(F.inline(F.expr("array(struct(a AS sid, b AS h, shared), struct(b AS sid, a AS h, shared))")))
    shared = shared.unionAll(both).groupBy("sid", "h").agg(F.expr("sum(shared) AS shared"))
    best = shared.groupBy("sid").agg(F.expr("max_by(h, struct(shared, h)) AS h"))
    return best.selectExpr("greatest(sid, h) AS a", "least(sid, h) AS b").distinct()


def _all_pairs(rows: DataFrame, met: DataFrame) -> DataFrame:
    """Every pair of a list that fits and lies in two components: one of the two is not in the main one."""
    by_comp = rows.groupBy("token", "comp").agg(F.expr("count(1) AS k"))
    main = by_comp.groupBy("token").agg(F.expr("count(1) AS comps"), F.expr("max_by(comp, struct(k, comp)) AS main")).filter("comps > 1")
    outside = rows.join(main.selectExpr("token AS __token", "main"), F.expr("token = __token AND comp != main"))
    other = rows.selectExpr("token AS __other", "sid AS other", "n AS m", "reach AS other_reach", "comp AS other_comp")
    fits = "token = __other AND comp != other_comp AND (other_comp = main OR sid > other) AND n <= other_reach AND m <= reach"
    pairs = outside.join(other, F.expr(fits)).selectExpr("greatest(sid, other) AS a", "least(sid, other) AS b")
    return pairs.unionAll(met.select("a", "b")).distinct()


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The staged pairs that link; texts are shuffled only of sets whose counters leave it open."""
    likely = stage(_both(pairs, texts, "spread").mapInArrow(_likely, "a long, b long").distinct(), "likely")
    links = stage(_both(likely, texts, "text").mapInArrow(_verify, "a long, b long"), "links")
    discard(likely)
    return links


def _both(pairs: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    """The staged pairs with a column of both sets."""
    held = _named(texts.select("sid", column), "sid", pairs.select(F.explode(F.array("a", "b"))))
    left = held.selectExpr("sid AS a", f"{column} AS {column}_a")
    right = held.selectExpr("sid AS b", f"{column} AS {column}_b")
    return pairs.join(left, "a").join(right, "b").select("a", "b", f"{column}_a", f"{column}_b")


def _united(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after adding links: only the joined components are worked on."""
    own = comps.selectExpr("node AS x", "comp AS cx")
    edges = links.join(own, F.expr("a = x"), "left").selectExpr("coalesce(cx, a) AS a", "b")
    edges = edges.join(own, F.expr("b = x"), "left").selectExpr("a", "coalesce(cx, b) AS b").distinct()
    joined = stage(components(edges), "joined").selectExpr("node AS c", "comp AS root")
    # Nodes that had no component of their own are in the edges under their own name.
    old = comps.join(joined, F.expr("comp = c"), "left").selectExpr("node", "coalesce(root, comp) AS comp")
    new = joined.join(comps, F.expr("c = node"), "left_anti").selectExpr("c AS node", "root AS comp")
    return stage(old.unionAll(new), "components")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest doc_id (null last), columns unchanged.

    Rows without shingles all stay; of rows equal in doc_id and text, one of those chosen stays.
    """
    plain, back = renamed_in(docs, ("__id", "__hash"))
    found = stage(near_duplicates(plain), "found")
    best = found.filter("comp IS NOT NULL").groupBy("comp").agg(F.expr("min(struct(doc_id IS NULL, doc_id, text_hash)) AS best"))
    best = best.selectExpr("best.doc_id AS __id", "best.text_hash AS __hash")
    alone = plain.filter(f"text IS NULL OR NOT {has_word('text')}")
    kept = plain.join(best, F.expr("doc_id <=> __id AND xxhash64(text) = __hash"), "left_semi")
    repeated = found.filter("comp IS NOT NULL").groupBy("doc_id", "text_hash").agg(F.expr("count(1) AS k")).filter("k > 1")
    if not repeated.isEmpty():
        kept = kept.withColumn("__hash", F.expr("xxhash64(text)")).dropDuplicates(["doc_id", "__hash"]).drop("__hash")
    return kept.unionAll(alone).withColumnsRenamed(back).select(*[ref(c) for c in docs.columns])
