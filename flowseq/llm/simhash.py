"""SimHash near-duplicates by anchor-point covering.

Fingerprints that differ in at most ``THRESHOLD`` = 4 of 64 bits link.  The bits
are cut into three blocks, so linked fingerprints differ in at most one bit of
some block.  A block's anchors are a covering code: a Hamming (15, 11) code word
with any value of the block's other bits, which lies within ``RADIUS`` = 1 of
every block value.  Each fingerprint has one home anchor per block (its nearest)
and is replicated to every anchor that can be home to a neighbour, which are
those within covering radius plus threshold reachable by one changed bit (14 or
15 anchors a block).  At an anchor, homes are compared with all its replicas.

Equal fingerprints are one from the start, so groups of copies never meet a
comparison.  An anchor yields a spanning forest of its links, never the pairs;
the forests of all anchors are joined by :mod:`flowseq.llm.components`.

Defined results: a null or empty text, or one of white space only, has
fingerprint zero and links like any other; fewer than four words make one
shingle; repeated rows each give a row; an empty table gives an empty result; a
null id never is a component's id, unless the component has no other (then null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from flowseq.llm.common import bounded_batches, free_names, settle
from flowseq.llm.components import connected_components, unite

SHINGLE = 4
SEED = 42
THRESHOLD = 4
RADIUS = 1
#: First bit and number of bits of each block.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Replicas that one group of anchors should hold: sets the number of groups.
GROUP_ROWS = 400_000
_PAIRS_AT_ONCE = 1 << 21


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash of a whole text."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), SEED)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    n = len(words) - shingle + 1
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        out = np.fromiter((fingerprint(t) for t in batch.to_pylist()), np.uint64, len(batch))
        yield pa.array(out.view(np.int64))


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a signed long."""
    return arrow_udf(_fingerprints, "long")(text)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- the covering code ---------------------------------------------------------------------


def _syndromes() -> np.ndarray:
    """Hamming syndrome of every 15-bit value: the exclusive or of the (1-based) set positions."""
    out = np.zeros(1 << 15, np.uint8)
    values = np.arange(1 << 15)
    for bit in range(15):
        out ^= (((values >> bit) & 1) * (bit + 1)).astype(np.uint8)
    return out


def _flips() -> np.ndarray:
    """By syndrome, the masks that lead to a code word within distance two; the first is the nearest."""
    out = np.zeros((16, 8), np.uint64)
    for s in range(16):
        masks = [0 if s == 0 else 1 << (s - 1)]
        masks += [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 16) if s and i < i ^ s and 0 < i ^ s]
        out[s] = (masks + [masks[0]] * 8)[:8]
    return out


SYNDROME, FLIPS = _syndromes(), _flips()


def homes(fp: np.ndarray, block: int) -> np.ndarray:
    """Home anchor of each fingerprint in one block."""
    start, bits = BLOCKS[block]
    value = (fp >> np.uint64(start)) & np.uint64((1 << bits) - 1)
    return value ^ FLIPS[SYNDROME[(value & np.uint64(0x7FFF)).astype(np.int64)], 0]


def replicas(fp: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, anchor)`` of all anchors that may be home to a fingerprint one bit away in the block."""
    start, bits = BLOCKS[block]
    value = (fp >> np.uint64(start)) & np.uint64((1 << bits) - 1)
    syndrome = SYNDROME[(value & np.uint64(0x7FFF)).astype(np.int64)]
    near = value[:, None] ^ FLIPS[syndrome]
    other = (value ^ FLIPS[syndrome, 0])[:, None] ^ (np.uint64(1) << np.arange(15, bits, dtype=np.uint64))
    anchors = np.concatenate([near, other], 1)
    keep = np.concatenate([np.repeat(np.array([[True] + [False] * 7]) | (syndrome > 0)[:, None], 1, 1), np.ones(other.shape, bool)], 1)
    rows = np.broadcast_to(np.arange(len(fp))[:, None], anchors.shape)
    return rows[keep], anchors[keep]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _deal(groups: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for b in range(len(BLOCKS)):
                row, anchor = replicas(fp, b)
                anchor = anchor | np.uint64(b << 32)
                group = (_mix(anchor) % np.uint64(groups)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(anchor.view(np.int64)), pa.array(fp[row].view(np.int64))], names=["g", "anchor", "fp"])

    return deal


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links at the anchors of one group."""
    anchor = pdf["anchor"].to_numpy().view(np.uint64)
    order = np.argsort(anchor, kind="stable")
    anchor = anchor[order]
    fp = pdf["fp"].to_numpy().view(np.uint64)[order]
    known, ident = np.unique(fp, return_inverse=True)
    label = np.arange(len(known))
    block = (anchor >> np.uint64(32)).astype(np.int64)
    home = np.zeros(len(fp), bool)
    for b in range(len(BLOCKS)):
        at = block == b
        home[at] = homes(fp[at], b) == (anchor[at] & np.uint64(0xFFFFFFFF))
    first = np.searchsorted(anchor, anchor, "left")
    last = np.searchsorted(anchor, anchor, "right")
    mine = np.flatnonzero(home)
    sizes = (last - first)[mine]
    at = 0
    while at < len(mine):  # as many homes at once as make a bounded number of pairs
        upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), _PAIRS_AT_ONCE, "right")) + at)
        rows, n = mine[at:upto], sizes[at:upto]
        left = np.repeat(rows, n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[rows], n)
        hit = np.bitwise_count(fp[left] ^ fp[right]) <= THRESHOLD
        hit &= ident[left] != ident[right]
        if hit.any():
            unite(label, ident[left[hit]], ident[right[hit]])
        at = upto
    # Each class as a chain, not as a star: no node has more than two neighbours here.
    order = np.argsort(label, kind="stable")
    same = label[order[1:]] == label[order[:-1]]
    return pd.DataFrame({"u": known[order[:-1][same]].view(np.int64), "v": known[order[1:][same]].view(np.int64)})


def links(fingerprints: DataFrame) -> DataFrame:
    """``u, v``: a forest whose components are those of all links between distinct ``fp``."""
    n = fingerprints.count()
    groups = max(256, n * 44 // GROUP_ROWS)
    dealt = fingerprints.select("fp").mapInArrow(_deal(groups), "g int, anchor long, fp long")
    return dealt.groupBy("g").applyInPandas(_compare, "u long, v long")


def assign(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, root, component_id`` of every row; ``root`` is one fingerprint of the component."""
    printed = settle(bounded_batches(docs).select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col)).alias("fp")))
    first = settle(printed.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(first))
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(smallest, "root").select("fp", "root", "component_id")
    return printed.join(of, "fp").select("doc_id", "fp", "root", "component_id")


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    return assign(docs, id_col=id_col, text_col=text_col).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def keep_rows(docs: DataFrame, stays: DataFrame, code: Column, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id and ``code`` are a ``doc_id, code`` of ``stays``, once each.

    Rows are told apart by both, as ids may repeat or be null.
    """
    mine, theirs, its = free_names(docs, "code", "their_code", "their_id")
    named = docs.withColumn(mine, code)
    stays = stays.select(F.col("doc_id").alias(its), F.col("code").alias(theirs))
    kept = named.join(stays, (named[mine] == stays[theirs]) & named[id_col].eqNullSafe(stays[its]), "left_semi")
    return kept.dropDuplicates([id_col, mine]).drop(mine)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (null ids last).

    Of rows of the component that share this id the one with the smallest fingerprint stays, once.
    """
    found = settle(assign(docs, id_col=id_col, text_col=text_col))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp")).alias("best")
    stays = settle(found.groupBy("root").agg(best).select("best.doc_id", F.col("best.fp").alias("code")))
    return keep_rows(docs, stays, fingerprint_column(F.col(text_col)), id_col)
