"""Connected components of an edge table by alternating large-star and small-star steps, the last of them in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.session import discard, stage

SMALL = 1 << 20  # edges that one task unites


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.expr("count(1)"), F.expr("bit_xor(xxhash64(u, v))")).first())


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, comp) of all edges of a task: both ends of an edge take the smaller name until nothing changes."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    ends = np.concatenate([b.column(c).to_numpy() for c in (0, 1) for b in held])
    nodes, at = np.unique(ends, return_inverse=True)
    u, v = np.split(at, 2)
    name = np.arange(len(nodes))
    before = None
    while before is None or (name != before).any():
        before = name.copy()
        least = np.minimum(name[u], name[v])
        for end in (u, v):
            # The name itself is lowered too, so whole trees move at once.
            np.minimum.at(name, name[end], least)
            np.minimum.at(name, end, least)
        while (name[name] != name).any():
            name = name[name]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[name])], names=["node", "comp"])


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, comp) of every node of the edges (a, b), with the smallest node of its component.

    Every step groups by node with partial aggregation and joins back, so the neighbours of a node are never
    held together; adaptive execution splits the join of a node that most edges share.  A component of n
    nodes takes about log(n) steps.  As soon as no more than ``small`` edges are left, one task ends the work.
    Self-links name nodes alone; an edge with a null end is ignored; no edges give no rows.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    nodes = edges.selectExpr("explode(array(a, b)) AS node").distinct()
    pairs = stage(edges.filter("a != b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "edges")
    before = None
    while (now := _mark(pairs)) != before and now[0]:
        if now[0] <= small:
            roots = pairs.coalesce(1).mapInArrow(_united, "node long, comp long")
            break
        before = now
        both = pairs.unionAll(pairs.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.expr("least(min(v), u) AS m"))
        large = both.join(least, "u").filter("v > u").selectExpr("v AS u", "m AS v").distinct()
        large = stage(large, "edges")
        discard(pairs)
        least = large.groupBy("u").agg(F.expr("min(v) AS m"))
        small_star = large.join(least, "u").filter("v != m").selectExpr("v AS u", "m AS v").unionAll(least.selectExpr("u", "m AS v"))
        pairs = stage(small_star.filter("u != v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), "edges")
        discard(large)
    else:
        roots = pairs.selectExpr("u AS node", "v AS comp")
    return nodes.join(roots, "node", "left").selectExpr("node", "coalesce(comp, node) AS comp")
