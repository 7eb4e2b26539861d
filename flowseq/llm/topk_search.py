"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors become integers, floor(256 x).  A vector is cut into 1, 4, 16 and then 32
segments; each segment is known by its mean and its deviation.  For two vectors,

    d^2 >= sum over segments of length * ((mean - mean')^2 + (dev - dev')^2),

and with the exact norms a lower bound of the distance is an upper bound of the
inner product, (|q|^2 + |x|^2 - d^2) / 2.  Pairs are bounded coarse to fine; those
that can't reach the query's k-th best score found so far drop out, pair by pair,
and only survivors get exact scores.  The k-th best scores are known early: first
from a bounded number of rows on the driver, then, chunk by chunk, from the pairs
with the highest bounds.  Every bound is rounded outwards, so ties stay exact.

The queries are taken in hash blocks of bounded size.  A block is broadcast, all
candidates are searched against it in one map-side pass, each task keeps its k
best by query, and those are merged by query.

Defined results: vectors that are null, or hold null or non-finite components,
take no part; vectors of different lengths are never compared; rows that repeat a
``vec_id`` are vectors of their own, each a candidate of the others and, if a query,
with ranks of its own; empty tables give an empty result.  Scores beyond 64 bits end
at the largest or smallest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowseq.llm.common import settle

LEVELS = (1, 4, 16, 32)
SCALE = 256
#: Queries in a block (expected number), and candidates that are scored at once.
BLOCK_QUERIES = 2048
BATCH_ROWS = 1024
#: Rows whose scores give the first k-th best of every query, and pairs that are scored at once.
SEED_ROWS = 1024
PAIRS_AT_ONCE = 1 << 17
_EXACT = float(1 << 53)


def _segments(dim: int, level: int) -> np.ndarray:
    return np.linspace(0, dim, min(level, dim) + 1).astype(int)


def summaries(x: np.ndarray) -> list[np.ndarray]:
    """By level, the segment means and deviations, scaled so that bounds are plain inner products."""
    out = []
    for level in LEVELS:
        cut = _segments(x.shape[1], level)
        size = np.diff(cut).astype(float)
        total = np.add.reduceat(x, cut[:-1], axis=1)
        square = np.add.reduceat(x * x, cut[:-1], axis=1)
        mean = total / size
        dev = np.sqrt(np.maximum(square / size - mean * mean, 0))
        out.append(np.concatenate([mean, dev], 1) * np.sqrt(np.concatenate([size, size])))
    return out


def _python_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores too large for floating point, in whole numbers, ended at the range of long."""
    a, b = ([[int(v) for v in row] for row in m] for m in (q, x))
    top = (1 << 63) - 1
    return np.array([[max(-top - 1, min(top, sum(map(int.__mul__, r, s)))) for s in b] for r in a], np.int64).reshape(len(q), len(x))


class Block:
    """The queries of one block and dimension, with the best rows found so far.

    ``bounded`` counts the pairs of a query and a row that were looked at, ``scored``
    those of them that got an exact score.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.rows, self.ids, self.x, self.k = rows, ids, x, k
        self.levels = summaries(x)
        self.most = np.abs(x).max(initial=0)
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in ids]
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()
        self.bounded = self.scored = 0

    def search(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Look at vectors, given by row number, id and components."""
        if not len(ids) or not len(self.ids) or not self.k:
            return
        self.bounded += len(self.ids) * len(ids)
        other = self.rows[:, None] != rows[None, :]
        if float(self.most) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1]) >= _EXACT:
            q, c = np.nonzero(other)
            self._keep(q, c, _python_scores(self.x, x)[q, c], rows, ids)
            return
        # The deviations lose about half the digits where values nearly cancel.
        slack = 1e-7 * float(self.most + 1) * float(np.abs(x).max(initial=0) + 1) * x.shape[1] + 1e-6
        alive = other
        for mine, theirs in zip(self.levels, summaries(x), strict=True):
            at, columns = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            if not len(at):
                return
            bounds = np.full(alive.shape, -np.inf)
            bounds[np.ix_(at, columns)] = mine[at] @ theirs[columns].T + slack
            alive &= bounds >= self.floor[:, None]
        # The highest bounds first: what they score raises the floor for the rest.
        bounds[~alive] = -np.inf
        first = min(2 * self.k, len(ids))
        top = np.argpartition(-bounds, first - 1, axis=1)[:, :first]
        q = np.repeat(np.arange(len(self.ids)), first)
        c = top.ravel()
        some = alive[q, c]
        self._score(q[some], c[some], x, rows, ids)
        alive[q, c] = False
        alive &= bounds >= self.floor[:, None]
        self._score(*np.nonzero(alive), x, rows, ids)

    def _score(self, q: np.ndarray, c: np.ndarray, x: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        for at in range(0, len(q), PAIRS_AT_ONCE):
            a, b = q[at : at + PAIRS_AT_ONCE], c[at : at + PAIRS_AT_ONCE]
            self._keep(a, b, np.einsum("ij,ij->i", self.x[a], x[b]), rows, ids)

    def _keep(self, q: np.ndarray, c: np.ndarray, scores: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        self.scored += len(q)
        good = scores >= self.floor[q]
        q, c, scores = q[good], c[good], scores[good]
        # By query the best come first, equal ones by id, so only k of them matter.
        order = np.lexsort((rows[c], ids[c], -scores, q))
        q, c, scores = q[order], c[order], scores[order]
        for a in np.flatnonzero(np.r_[len(q) > 0, q[1:] != q[:-1]]).tolist():
            r, upto = int(q[a]), min(len(q), a + self.k)
            while upto > a and q[upto - 1] != r:
                upto -= 1
            got = self.best[r] + [(-int(s), int(ids[i]), int(rows[i])) for s, i in zip(scores[a:upto].tolist(), c[a:upto].tolist(), strict=True)]
            self.best[r] = sorted(got)[: self.k]
            if len(self.best[r]) == self.k:
                self.floor[r] = max(self.floor[r], -self.best[r][-1][0])


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """One row per id with whole-number components; rows that take no part are gone."""
    v = F.col(vector_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    plain = plain.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", bad), F.lit(True)))
    # Doubles hold floor(256 x) exactly: scaling by a power of two is exact.
    whole = plain.select("vec_id", F.transform("v", lambda x: F.when(F.abs(x) >= float(1 << 54), x * SCALE).otherwise(F.floor(x * SCALE).cast("double"))).alias("v"))
    # The table is written before it is used, which freezes the row numbers.
    return settle(whole.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "v"))


def _by_dimension(rows: np.ndarray, ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(dimension, rows, ids, vectors)`` in chunks of ``BATCH_ROWS``, from lists laid end to end."""
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        for i in range(0, len(at), BATCH_ROWS):
            part = at[i : i + BATCH_ROWS]
            yield d, rows[part], ids[part], flat[starts[part][:, None] + np.arange(d)] if d else np.zeros((len(part), 0))


def _arrays(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids, lengths and components of a batch or table ``row, vec_id, v``."""
    row, ids, lists = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (batch.column(i) for i in range(3)))
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    plain = lambda x: x.to_numpy(zero_copy_only=False)
    return plain(row), plain(ids), plain(lists.value_lengths()), plain(lists.flatten())


def _blocks(queries: tuple, k: int, floors: dict[int, np.ndarray]) -> dict[int, Block]:
    by_dim: dict[int, list] = {}
    for d, *part in _by_dimension(*queries):
        by_dim.setdefault(d, []).append(part)
    return {d: Block(*(np.concatenate(c) for c in zip(*parts, strict=True)), k, floors.get(d)) for d, parts in by_dim.items()}


def _seeded(queries: tuple, seeds: tuple, k: int) -> dict[int, np.ndarray]:
    """A k-th best score of every query, from few rows."""
    blocks = _blocks(queries, k, {})
    for d, *part in _by_dimension(*seeds):
        if d in blocks:
            blocks[d].search(*part)
    return {d: b.floor for d, b in blocks.items()}


def _search(shipped, k: int):
    names = ["query_row", "query_id", "vec_id", "row", "score"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks(*shipped.value[:1], k, shipped.value[1])
        for batch in batches:
            for d, *part in _by_dimension(*_arrays(batch)):
                if d in blocks:
                    blocks[d].search(*part)
        for block in blocks.values():
            found = [(int(r), int(q), i, row, -s) for r, q, best in zip(block.rows, block.ids, block.best, strict=True) for s, i, row in best]
            columns = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return search


def top_k(vectors: DataFrame, *, k: int = 5, query_every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each vector whose id is divisible by ``query_every``, the k best others."""
    spark = vectors.sparkSession
    usable = _usable(vectors, id_col, vector_col)
    queries = usable.where(F.col("vec_id") % query_every == 0)
    blocks = max(1, -(-queries.count() // block_queries))
    seeds = _arrays(usable.orderBy(F.xxhash64("row"), "row").limit(SEED_ROWS).toArrow())
    found = None
    for b in range(blocks):
        mine = _arrays(queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow())
        shipped = spark.sparkContext.broadcast((mine, _seeded(mine, seeds, k)))
        part = usable.mapInArrow(_search(shipped, k), "query_row long, query_id long, vec_id long, row long, score long")
        if blocks > 1:  # one job per block: plans and broadcasts stay bounded
            part = settle(part)
        found = part if found is None else found.unionAll(part)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
