"""Connected components by alternating large-star and small-star steps.

Both steps (Kiveris et al., "Connected Components in MapReduce and Beyond") only
use equi-joins on a node and minima by node, which are combined map-side.  A node
with very many neighbours would be a hot key of the join; there are at most so many
of those as edges allow, so they are joined by a broadcast of bounded size instead.

Before each round every task replaces the edges that it holds, a bounded number at a
time, by the stars of their components.  A long chain then costs no rounds, and few
enough edges for one task are done without any.  Every round is written to the shared folder, which keeps the plans short and
survives lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowseq.llm.common import drop_settled, settle

#: Edges that a task contracts at once.
EDGES_AT_ONCE = 1 << 20
#: A node is hot with more edges than this, and than this share of all edges.
HOT_EDGES, HOT_SHARE = 256, 1000


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of ``a[i]`` and ``b[i]`` in ``label``, in place; labels are class minima."""
    while True:
        la, lb = label[a], label[b]
        lo, hi = np.minimum(la, lb), np.maximum(la, lb)
        differ = lo < hi
        if not differ.any():
            return
        np.minimum.at(label, hi[differ], lo[differ])
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped


def _contract(at_once: int):
    """Edges ``u, v`` as edges from each node to the smallest of its component, by ``at_once`` edges."""

    def stars(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        u, v = (np.concatenate(c) for c in zip(*held, strict=True))
        nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = np.arange(len(nodes))
        unite(label, ends[: len(u)], ends[len(u) :])
        own = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            if n and n + len(batch) > at_once:
                yield stars(held)
                held, n = [], 0
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            n += len(batch)
        if held:
            yield stars(held)

    return run


def _with_lowest(edges: DataFrame, lowest: DataFrame, n: int) -> DataFrame:
    """``edges`` with ``m`` of their ``u``.  At most 2 n / (n / HOT_SHARE) nodes are hot."""
    if n <= HOT_EDGES:
        return edges.join(lowest.select("u", "m"), "u")
    limit = max(HOT_EDGES, n // HOT_SHARE)
    hot = lowest.where(F.col("n") > limit).select("u", "m")
    if hot.isEmpty():
        return edges.join(lowest.select("u", "m"), "u")
    hot = F.broadcast(hot)
    rest = edges.join(hot.select("u"), "u", "left_anti").join(lowest.where(F.col("n") <= limit).select("u", "m"), "u")
    return rest.unionByName(edges.join(hot, "u"))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(edges: DataFrame, *, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """``node, root`` for every node of ``edges(u, v)`` but the roots, the root being a component's smallest node.

    Loops and repeated edges do no harm; null ends link nothing.
    """
    edges = settle(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    state = _state(edges)
    while state[0]:
        parts = -(-state[0] // at_once)
        old, edges = edges, settle(edges.coalesce(parts).mapInArrow(_contract(at_once), "u long, v long"))
        drop_settled(old)
        if parts == 1:
            break
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = settle(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        # Only neighbours above a node move, so the others need not meet its minimum.
        large = _with_lowest(both.where(F.col("v") > F.col("u")), first, state[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select("u", "v", "m")
        nxt = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = settle(nxt.unionAll(lowest.select("u", F.col("m").alias("v"))).distinct())
        old, edges = edges, nxt
        drop_settled(old)
        drop_settled(first)
        was, state = state, _state(edges)
        if was == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
