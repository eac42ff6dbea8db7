"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.functions.columns import ref
from lustra.llm.words import word_count
from lustra.operators.rows import number_rows
from lustra.session import cut, stage, stage_observed

WEIGHTS = (5, 2, 1)
MOST = 3  # copies of a document, and times its size that a source may be asked for
BLOCK = 256  # sizes rounded in one step
LAST = 6  # shortest sizes of a source that are rounded together
TOLERANCE = 1e-9  # share of its target that a source may miss before rounding
ROUNDS = 200  # Newton steps at most; bisection alone would need fewer


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per source with rows, source_size and target; ``sized`` has source and size.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all sizes.
    Targets stop at ``most`` times the source's size and the excess is reshared by weight until none is
    above: the level of the rest rises with every round, and only that number is on the driver.
    """
    totals = sized.groupBy("source").agg(F.expr("count(1) AS rows"), F.expr("coalesce(sum(size), 0) AS source_size"))
    turns = f"element_at(array({', '.join(f'{w}D' for w in weights)}), CAST(__turn % {len(weights)} AS INT) + 1)"
    ranked = number_rows(totals, ["source IS NULL", "source"], "__turn").withColumn("__weight", F.expr(turns))
    ranked = stage(ranked.withColumn("__cap", F.expr(f"{float(most)}D * source_size")), "sources")
    level, capped = 0.0, -1
    while True:
        full = f"__cap <= {level!r}D * __weight"
        found = ranked.agg(
            F.expr("coalesce(sum(source_size), 0)"), F.expr(f"coalesce(sum(if({full}, __cap, 0D)), 0D)"),
            F.expr(f"coalesce(sum(if({full}, 0D, __weight)), 0D)"), F.expr(f"count_if({full})"),
        ).first()
        if found[3] == capped or not found[2]:
            break
        capped, level = found[3], (found[0] - found[1]) / found[2]
    return ranked.withColumn("target", F.expr(f"least(__cap, {level!r}D * __weight)")).drop("__turn", "__weight", "__cap")


def rate_of(most: int = MOST) -> str:
    """Rate of a document of ``size`` words under the multiplier ``l`` of its source, as an expression."""
    return f"IF(size = 0 OR target <= 0, 0D, IF(filled, {most}D, least({most}D, exp(l * size / scale))))"


def balance(counted: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """``targets`` with the multiplier ``l`` of every source, its ``scale`` and ``filled``, for :func:`rate_of`.

    Entropy balancing looks for the rates w nearest to 1, by the sum of w * log(w) - w over documents, with w up
    to ``most`` and the words of each source, the sum of w * size, at its target.  The dual is convex, and its
    solution tilts documents exponentially by their size: w = min(most, exp(l * size)).  A Newton step takes the
    gradient and the Hessian of every source, which are sums over ``counted`` (source, size, n), in one
    aggregation; sources do not interact, so the Hessian is diagonal.  A step that leaves the bracket of what has
    been tried is replaced by its middle.  Sources that meet their target to ``TOLERANCE`` stand still.
    Only how many are left is on the driver.
    """
    start = targets.selectExpr(
        "*", f"target >= {most}D * source_size * (1 - 1e-12) AS filled", "greatest(source_size / greatest(rows, 1L), 1D) AS scale",
        "0D AS l", "CAST(NULL AS DOUBLE) AS low", "CAST(NULL AS DOUBLE) AS high",
    )
    state = stage(start.withColumn("done", F.expr("filled OR target <= 0 OR source_size = 0")), "multipliers")
    words = counted.filter("size > 0").selectExpr("source AS __source", "size", "n")
    tilted = "exp(l * size / scale)"
    left = None
    for _ in range(ROUNDS):
        each = words.join(state.filter("NOT done"), F.expr("__source <=> source"))
        sums = each.groupBy("__source").agg(
            F.expr(f"sum(n * size * least({most}D, {tilted})) AS got"),
            F.expr(f"sum(IF({tilted} < {most}D, n * size * (size / scale) * {tilted}, 0D)) AS slope"),
        )
        open_ = state.join(sums, F.expr("source <=> __source"), "left").drop("__source")
        open_ = open_.withColumns({"low": F.expr("IF(got < target, l, low)"), "high": F.expr("IF(got >= target, l, high)"), "__new": F.expr("l - (got - target) / nullif(slope, 0D)")})
        inside = "coalesce(__new > coalesce(low, double('-Infinity')) AND __new < coalesce(high, double('Infinity')), false)"
        middle = "CASE WHEN low IS NULL THEN high - 1 - 2 * abs(high) WHEN high IS NULL THEN low + 1 + 2 * abs(low) ELSE (low + high) / 2 END"
        met = f"done OR abs(got - target) <= {TOLERANCE} * target"
        moved = open_.withColumns({"done": F.expr(met), "l": F.expr(f"CASE WHEN {met} THEN l WHEN {inside} THEN __new ELSE {middle} END")})
        state, seen = stage_observed(moved.drop("got", "slope", "__new"), {"left": "count_if(NOT done)"}, "multipliers")
        left = seen["left"]
        if not left:
            return state.drop("low", "high", "done")
    raise ArithmeticError(f"{left} sources have not met their target")


def size_copies(counted: DataFrame, most: int = MOST, block: int = BLOCK, last: int = LAST) -> DataFrame:
    """(source, size, total): copies of all documents of a size; ``counted`` has source, size, n and rate.

    Sizes of a source are taken from long to short, and what is owed after one goes on to the next, as far
    as the shorter ones can make up for it with the copies they are due.  The ``last`` shortest sizes are rounded
    together: of the numbers of copies near those due, the combination that comes nearest to the target.  So what is
    missed in the end is at most half a shortest document, unless copies run out.  A source is one row with its
    distinct sizes, which grow at most as the root of twice its words.  ``block`` sizes at a time keep the
    arrays that grow short.
    """
    below = "OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    rows = counted.filter("size > 0").selectExpr(
        "source", "size", "n", "n * rate AS due", f"coalesce(sum(n * rate * size) {below}, 0D) AS spare", f"coalesce(sum(n * ({most}D - rate) * size) {below}, 0D) AS room"
    )
    rows = rows.groupBy("source").agg(F.expr("reverse(array_sort(collect_list(struct(size, n, due, spare, room)))) AS sizes"))
    rows = rows.withColumn("head", F.expr(f"slice(sizes, 1, greatest(size(sizes) - {last}, 0))"))
    # Fewest and most copies that the shorter sizes can make up for.
    wish = "t.due + i.owed / t.size"
    bounds = f"struct(ceil(t.due + (i.owed - t.room) / t.size) AS a, floor(t.due + (i.owed + t.spare) / t.size) AS b, round({wish}) AS k)"
    total = f"transform(array({bounds}), x -> CAST(greatest(0D, least({most}D * t.n, IF(x.a <= x.b, greatest(x.a, least(x.b, x.k)), x.k))) AS BIGINT))[0]"
    one = f"""aggregate(b, struct(s.owed AS owed, CAST(array() AS ARRAY<BIGINT>) AS out),
              (i, t) -> transform(array({total}), k -> struct(i.owed + (t.due - k) * t.size AS owed, array_append(i.out, k) AS out))[0])"""
    blocks = f"IF(size(head) = 0, array(), transform(sequence(0, (size(head) - 1) DIV {block}), j -> slice(head, j * {block} + 1, {block})))"
    first = f"""aggregate({blocks}, struct(0D AS owed, CAST(array() AS ARRAY<ARRAY<BIGINT>>) AS out),
                (s, b) -> transform(array({one}), i -> struct(i.owed AS owed, array_append(s.out, i.out) AS out))[0])"""
    # Four numbers of copies a size: all there are of a single document, else those around the one due.
    start = f"greatest(0L, least({most} * t.n - 3, CAST(floor(t.due + a.owed / t.size) AS BIGINT) - 1))"
    options = f"filter(transform(array(0L, 1L, 2L, 3L), o -> {start} + o), k -> k <= {most} * t.n)"
    grow = f"flatten(transform(s, a -> transform({options}, k -> struct(a.owed + (t.due - k) * t.size AS owed, array_append(a.out, k) AS out))))"
    tail = f"aggregate(slice(sizes, size(head) + 1, {last}), array(struct(first.owed AS owed, CAST(array() AS ARRAY<BIGINT>) AS out)), (s, t) -> {grow})"
    best = f"array_min(transform({tail}, c -> struct(abs(c.owed) AS off, c.out AS out))).out"
    rows = rows.withColumn("first", F.expr(first)).withColumn("totals", F.expr(f"concat(flatten(first.out), {best})"))
    rows = rows.select("source", F.explode(F.expr("arrays_zip(sizes, totals)")).alias("x"))
    return rows.selectExpr("source", "x.sizes.size AS size", "x.totals AS total")


def _rows_of(targets: DataFrame, counted: DataFrame) -> DataFrame:
    """``targets`` whose ``rows`` is the number of documents with words."""
    held = counted.filter("size > 0").groupBy("source").agg(F.expr("sum(n) AS __rows")).withColumnRenamed("source", "__source")
    return targets.join(held, F.expr("source <=> __source"), "left").withColumn("rows", F.expr("coalesce(__rows, 0L)")).drop("__source", "__rows")


def mix(
    docs: DataFrame,
    carry: Sequence[str] | None = None,
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: its columns ``carry`` (all) as struct ``doc``, size, source_size, target and copies.

    Rates become whole copies, 0 to ``most``, first for all documents of a source and size (``size_copies``),
    then for each: the copies of a size are dealt out evenly, and those left over go to the smallest hashes
    of id and text, so reruns agree.  Only hashes are sorted, by range; documents stay where they are.  Null
    texts and empty ones have size 0 and 0 copies; a null source is a source; an empty table gives an empty
    one; repeated rows are documents each.  Other columns are only carried.
    """
    sized = docs.select(
        F.struct(*[docs[ref(c)] for c in carry or docs.columns]).alias("doc"),
        F.expr("source AS source"),
        F.expr(f"{word_count('text')} AS size"),
        F.expr("xxhash64(doc_id, text) AS tie"),
    )
    # Rows equal in id and text are one row with their number m; pieces are a range partition's part of a size.
    ties = sized.groupBy("source", "size", "tie").agg(F.expr("count(1) AS m"))
    ties = cut(ties.orderBy("source", "size", "tie")).withColumn("part", F.expr("shiftright(monotonically_increasing_id(), 33)"))
    pieces = stage(ties.groupBy("source", "size", "part").agg(F.expr("sum(m) AS held")), "pieces")
    counted = pieces.groupBy("source", "size").agg(F.expr("sum(held) AS n"))
    words = pieces.selectExpr("source", "size * held AS size", "held")
    counted = stage(counted, "counted")
    rated = balance(counted, _rows_of(source_targets(words, weights, most), counted), most).withColumnRenamed("source", "__source")
    counted = counted.join(rated, F.expr("source <=> __source")).withColumn("rate", F.expr(rate_of(most)))
    counted = stage(counted.drop("__source", "rows", "filled", "scale", "l"), "sizes")
    totals = size_copies(counted, most, block).selectExpr("source AS __source", "size AS __size", "total")
    each = counted.join(totals, F.expr("source <=> __source AND size = __size"), "left").drop("__source", "__size", "rate")
    each = each.withColumn("least", F.expr("coalesce(total DIV n, 0L)")).withColumn("more", F.expr("coalesce(total % n, 0L)"))
    each = stage(each.drop("total", "n"), "copies")
    # The hash up to which documents of a size get one copy more, and how many of the documents of that hash do.
    named = each.filter("more > 0").selectExpr("source AS __source", "size AS __size", "more")
    before = "coalesce(sum({}) OVER (PARTITION BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"
    places = pieces.join(named, F.expr("source <=> __source AND size = __size"))
    places = places.withColumn("more", F.expr("more - " + before.format("held", "__source, __size ORDER BY part")))
    places = places.filter("more > 0 AND more <= held").selectExpr("__source", "__size", "part AS __part", "more")
    ends = ties.join(places, F.expr("source <=> __source AND size = __size AND part = __part"))
    ends = ends.withColumn("more", F.expr("more - " + before.format("m", "__source, __size, __part ORDER BY tie")))
    ends = ends.filter("more > 0 AND more <= m").selectExpr("__source", "__size", "tie AS last", "more AS lasts", "m")
    due = each.join(ends, F.expr("source <=> __source AND size = __size"), "left").drop("__source", "__size", "more")
    due = stage(due.withColumnRenamed("source", "__source").withColumnRenamed("size", "__size"), "due")
    found = sized.join(due, F.expr("source <=> __source AND size = __size"))
    out = ("doc", "size", "source_size", "target")
    whole = found.filter("NOT coalesce(tie = last AND lasts < m, false)")
    whole = whole.selectExpr(*out, "least + if(coalesce(tie <= last, false), 1L, 0L) AS copies")
    if due.filter("lasts < m").isEmpty():
        return whole
    # Of rows equal in id and text, as many as are left get one more; which of them makes no difference.
    equal = found.filter("tie = last AND lasts < m").withColumn("__row", F.monotonically_increasing_id())
    equal = number_rows(equal, ["__source IS NULL", "__source", "__size", "__row"], "place")
    first = equal.groupBy("source", "size").agg(F.expr("min(place) AS first")).withColumnsRenamed({"source": "__of", "size": "__long"})
    equal = equal.join(first, F.expr("source <=> __of AND size = __long"))
    return whole.unionAll(equal.selectExpr(*out, "least + if(place - first < lasts, 1L, 0L) AS copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with the number of ``copies`` (which replaces a column of that name)."""
    taken = mix(docs).filter("copies > 0")
    return taken.select(*[F.col(f"doc.{ref(c)}") for c in docs.columns if c.lower() != "copies"], "copies")
