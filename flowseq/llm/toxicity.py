"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms (ASCII lower-cased runs of letters, digits
and non-ASCII characters), hashed into ``BUCKETS``.  The machine scores

    w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2],

so a pair of terms, such as an insult with a mention of a group, gets a weight
of its own through the factors, which a linear model can't give it.

It is fitted on the driver on at most ``max_rows`` labelled rows (those with the
least hashes; the executors send hashed terms, never texts), over every bucket that
a labelled row has: weights and factors are sparse only where nothing is known.  The
penalised log loss is minimised by L-BFGS; the rows of a held-in tenth say when to
stop, at every size alike.  Scoring is one map-side pass over all whole texts.

Defined results: a null text is the empty text and is scored by the bias; labels
that are null, or whose document is missing, teach nothing; a document labelled
more than once teaches once, as toxic if any of its labels says so; of rows that
repeat an id the text with the least hash teaches; without any usable label every
score is 0; repeated documents each get a row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from flowseq.llm.common import bounded_batches, free_names, worker_cache

BUCKETS = 1 << 20
MAX_ROWS = 8_000
FACTORS = 6
FOLDS = 5
#: Penalties on squared weights and factors, and steps without a better held-in loss after which fitting ends.
RIDGE, FACTOR_RIDGE, PATIENCE = 0.2, 0.5, 8
#: Scale of a feature without any evidence of its own; one is that of strong evidence.
LEAST_SCALE = 0.01
CACHED_TERMS = 200_000

# ASCII letters in lower case, digits and bytes of other characters stay; the rest parts terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def terms(text: str) -> set[bytes]:
    return set(text.encode().translate(_FOLD).split())


def bucket(term: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(term, 7) % BUCKETS


@dataclass(frozen=True)
class FactorizationMachine:
    """``buckets`` are those with a weight, in ascending order; all others weigh nothing."""

    bias: float
    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    linear: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))

    def logit(self, hashed: np.ndarray) -> float:
        """The machine's sum for a set of buckets."""
        if not len(self.buckets) or not len(hashed):
            return self.bias
        at = np.minimum(np.searchsorted(self.buckets, hashed), len(self.buckets) - 1)
        at = at[self.buckets[at] == hashed]
        v = self.factors[at]
        return float(self.bias + self.linear[at].sum() + 0.5 * ((v.sum(0) ** 2) - (v**2).sum(0)).sum())


class _Rows:
    """Sparse rows of ones, by row and by feature."""

    def __init__(self, sets: list[np.ndarray], m: int):
        sizes = np.array([len(s) for s in sets], np.int64)
        self.n, self.m = len(sets), m
        self.flat = np.concatenate([np.zeros(0, np.int32), *sets]).astype(np.int32)
        self.some = np.flatnonzero(sizes)
        self.start = (np.cumsum(sizes) - sizes)[self.some]
        order = np.argsort(self.flat, kind="stable")
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)[order]
        used, first = np.unique(self.flat[order], return_index=True)
        self.used, self.first = used, first

    def times(self, w: np.ndarray) -> np.ndarray:
        """The sum of ``w`` over each row's features."""
        out = np.zeros(self.n, w.dtype)
        if len(self.some):
            out[self.some] = np.add.reduceat(w[self.flat], self.start)
        return out

    def transposed(self, r: np.ndarray) -> np.ndarray:
        """The sum of ``r`` over each feature's rows."""
        out = np.zeros(self.m, r.dtype)
        if len(self.used):
            out[self.used] = np.add.reduceat(r[self.row], self.first)
        return out


def _unpacked(params: np.ndarray, m: int) -> tuple[float, np.ndarray, np.ndarray]:
    return float(params[0]), params[1 : m + 1], params[m + 1 :].reshape(m, FACTORS)


def _logits(params: np.ndarray, rows: _Rows) -> tuple[np.ndarray, np.ndarray]:
    """The machine's sums, and by row the sums of factors; a factor at a time, which bounds memory."""
    w0, w, v = _unpacked(params, rows.m)
    z = w0 + rows.times(w - 0.5 * (v**2).sum(1))
    s = np.stack([rows.times(np.ascontiguousarray(v[:, f])) for f in range(FACTORS)], 1)
    return z + 0.5 * (s**2).sum(1), s


def _loss(params: np.ndarray, rows: _Rows, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Log loss and its gradient."""
    z, s = _logits(params, rows)
    _, _, v = _unpacked(params, rows.m)
    value = float(np.logaddexp(0, z.astype(float)).sum() - (y * z).sum())
    g = (1 / (1 + np.exp(-np.clip(z, -80, 80))) - y).astype(params.dtype)
    grad = np.empty_like(params)
    _, gx, gv = _unpacked(grad, rows.m)
    grad[0], gx[:] = g.sum(), rows.transposed(g)
    for f in range(FACTORS):
        gv[:, f] = rows.transposed(g * s[:, f]) - v[:, f] * gx
    return value, grad


def _direction(grad: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """L-BFGS: the inverse Hessian that the last steps suggest, times the gradient."""
    q, alphas = grad.copy(), []
    for step, change, rho in reversed(pairs):
        alphas.append(rho * (step @ q))
        q -= alphas[-1] * change
    if pairs:
        step, change, _ = pairs[-1]
        q *= (step @ change) / (change @ change)
    for (step, change, rho), alpha in zip(pairs, reversed(alphas), strict=True):
        q += (alpha - rho * (change @ q)) * step
    return -q


def minimise(params: np.ndarray, loss, held_in, *, steps: int = 200, memory: int = 5) -> np.ndarray:
    """The parameters with the least held-in loss on the way to the minimum."""
    value, grad = loss(params)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    best, least, idle = params, held_in(params), 0
    for _ in range(steps):
        d = _direction(grad, pairs)
        slope = grad @ d
        if slope > -1e-9:
            break
        t = 1.0 if pairs else min(1.0, 1 / np.abs(grad).sum())
        while True:  # halve until the loss falls enough
            new, grown = params + t * d, 0.0
            grown, its = loss(new)
            if grown <= value + 1e-4 * t * slope or t < 1e-12:
                break
            t /= 2
        change = its - grad
        if (curve := change @ (new - params)) > 1e-10:
            pairs = [*pairs[1 - memory :], (new - params, change, 1 / curve)]
        small = value - grown < 1e-6 * max(1.0, abs(value))
        params, value, grad = new, grown, its
        if (now := held_in(params)) < least:
            best, least, idle = params, now, 0
        elif (idle := idle + 1) >= PATIENCE:
            break
        if small:
            break
    return best


def evidence(sets: list[np.ndarray], y: np.ndarray, m: int) -> np.ndarray:
    """How far each feature may easily move, up to one: by its chi-squared of the label against what chance gives among so many.

    No feature is left out; one without any evidence has the scale ``LEAST_SCALE``.
    """
    n, p = len(y), y.sum()
    flat = np.concatenate([np.zeros(0, np.int32), *sets])
    seen = np.bincount(flat, minlength=m)
    toxic = np.bincount(flat, np.repeat(y, [len(s) for s in sets]), minlength=m)
    cells = ((toxic, seen * p / n), (seen - toxic, seen * (n - p) / n), (p - toxic, (n - seen) * p / n), (n - p - seen + toxic, (n - seen) * (n - p) / n))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = sum(np.where(o > 0, o * np.log(o / e), 0) for o, e in cells)
    return np.clip(2 * gain / (2 * np.log(max(m, 2))), LEAST_SCALE, 1)


def fit_machine(sets: list[np.ndarray], y: np.ndarray, *, seed: int = 17) -> FactorizationMachine:
    """The machine for rows that are sets of ascending buckets."""
    if not len(y):
        return FactorizationMachine(-np.inf)
    buckets = np.unique(np.concatenate([np.zeros(0, np.int32), *sets])).astype(np.int64)
    known = [np.searchsorted(buckets, s).astype(np.int32) for s in sets]
    m, rng = len(buckets), np.random.default_rng(seed)
    tenth = rng.permutation(len(y))[: len(y) // 10]
    inner = np.setdiff1d(np.arange(len(y)), tenth)
    rows, checks = _Rows([known[i] for i in inner], m), _Rows([known[i] for i in tenth], m)

    # Parameters in units of their scale: penalties and steps are alike for all.
    scale = evidence([known[i] for i in inner], y[inner], m)
    unit = np.concatenate([[1.0], scale, np.repeat(scale, FACTORS)]).astype(np.float32)

    def held_in(u: np.ndarray) -> float:
        z = _logits(unit * u, checks)[0].astype(float)
        return float(np.logaddexp(0, z).sum() - (y[tenth] * z).sum())

    def loss(u: np.ndarray) -> tuple[float, np.ndarray]:
        value, grad = _loss(unit * u, rows, y[inner])
        grad *= unit
        for part, penalty in ((slice(1, m + 1), RIDGE), (slice(m + 1, None), FACTOR_RIDGE)):
            value += penalty / 2 * float(u[part] @ u[part])
            grad[part] += penalty * u[part]
        return value, grad

    rate = (y.sum() + 0.5) / (len(y) + 1)
    start = np.concatenate([[np.log(rate / (1 - rate))], np.zeros(m), rng.normal(0, 0.05, m * FACTORS)]).astype(np.float32)
    w0, w, v = _unpacked(unit * minimise(start, loss, held_in), m)
    return FactorizationMachine(w0, buckets, w.copy(), v.copy())


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether a document is in the fold that labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _hash_terms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    known = worker_cache(__name__)
    for batch in batches:
        yield pa.array([_hashed(text.as_py() or "", known) for text in batch], pa.list_(pa.int32()))


def _hashed(text: str, known: dict[bytes, int]) -> np.ndarray:
    """The ascending buckets of a text's terms; ``known`` keeps those of terms met before."""
    if len(known) > CACHED_TERMS:
        known.clear()
    found = terms(text)
    for t in found.difference(known):
        known[t] = bucket(t)
    return np.unique(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> FactorizationMachine:
    """Fit on the labelled documents outside the held-out fold, ``max_rows`` of them at most."""
    usable = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    # A bounded number of rows, so they may be broadcast, and the documents need not move.
    taught = F.broadcast(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    slim = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hashed = slim.join(taught, "doc_id").select("doc_id", "y", F.xxhash64("text").alias("h"), arrow_udf(_hash_terms, "array<int>")(F.col("text")).alias("f"))
    rows = hashed.groupBy("doc_id").agg(F.min(F.struct("h", "f", "y")).alias("r")).select("doc_id", "r.y", "r.f").orderBy("doc_id").toArrow()
    lists = rows.column("f").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    y = rows.column("y").to_numpy()
    return fit_machine([flat[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)], (y > 0).astype(float))


def with_score(docs: DataFrame, model: FactorizationMachine, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the machine's probability for every whole text."""
    shipped = bounded_batches(docs).sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fm = shipped.value
        known = worker_cache(__name__)
        for batch in batches:
            z = np.array([fm.logit(_hashed(text.as_py() or "", known)) for text in batch])
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))) * (z > -np.inf), pa.float64())

    return docs.withColumn(out_col, score(F.col(text_col)))


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = with_score(slim, fit(docs, labels, id_col=id_col, text_col=text_col))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the machine doesn't reject, with their columns."""
    (score,) = free_names(docs, "score")
    scored = with_score(docs, fit(docs, labels), out_col=score)
    return scored.where(F.col(score) < 0.5).drop(score)
