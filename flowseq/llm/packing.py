"""Packing documents into training sequences by cutting-stock column generation.

A document's token ids, with an end id, are cut into full sequences and a rest.
Pieces fall into length classes of ``GRAIN`` tokens, and the class histogram is
all that the plan needs: a few hundred counts, however large the corpus.

1.  *Linear program.*  Patterns are multisets of classes that fit a sequence.  A
    revised simplex method minimises the number of sequences that cover the
    histogram; a knapsack by dynamic programming over the duals prices the next
    pattern, until none is worth more than a sequence.
2.  *Rounding.*  Pattern counts are rounded down; what remains of the histogram
    (at most some hundred sequences) is packed first-fit in falling length.
3.  *Assignment.*  Pieces are ranked within their class without gathering a class
    anywhere: ranks are counted within hash salts, salts are offset by running
    counts.  A rank falls into one pattern's range, which gives its sequence.
    Offsets are running sums over a sequence, which holds few pieces.

Pieces whose class has one pattern range per rank are joined with the plan table,
whose size is bounded by the number of classes and patterns.

Defined results: a null or empty text is the end id alone; repeated rows are
documents of their own (their pieces get sequences and offsets of their own);
an empty table gives an empty result; other columns are never read.  The
tokenizer file must exist on every executor at the same path.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowseq.llm.common import bounded_batches, settle, worker_cache

SEQUENCE = 4096
GRAIN = 16
END_ID = 2
#: Pieces that one salt of a class should hold.
SALT_PIECES = 50_000
CACHE_ENTRIES = 500_000
MAX_CACHED = 48

#: Latin letters, then ASCII punctuation but the apostrophe, which may begin a contraction.
_WORD = re.compile(r"([a-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _ids_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others for the characters from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _encoder(path: str):
    """``text -> ids as little-endian 32-bit words``, with a cache that the worker keeps.

    The tokenizer drops white space and never joins across it, lower-cases, and
    parts letters from punctuation, so ids can be looked up by white-space chunk.
    A new word of Latin letters goes straight to the tokenizer's merge model, which
    spares it normalising and splitting; all other new chunks, and texts that may
    hold a special string, are encoded as they are.
    """
    from tokenizers import Tokenizer

    kept = worker_cache(__name__)
    if path not in kept:
        kept[path] = Tokenizer.from_file(path), {}
    tok, cache = kept[path]
    merge, alphabet = tok.model.tokenize, _byte_alphabet()

    def direct(raw: bytes) -> bytes:
        return _ids_bytes(tok.encode(raw.decode(), add_special_tokens=False).ids)

    def keep(c: bytes, ids: bytes) -> bytes:
        if len(cache) >= CACHE_ENTRIES:
            cache.clear()
        cache[c] = ids
        return ids

    def chunk(c: bytes) -> bytes:
        if len(c) > MAX_CACHED:
            return direct(c)
        word = _WORD.fullmatch(c.decode())
        if not word:
            return keep(c, direct(c))
        if not word[2]:
            letters = word[1].lower().encode().decode("latin-1")
            return keep(c, _ids_bytes([t.id for t in merge(letters if letters.isascii() else letters.translate(alphabet))]))
        core, tail = word[1].encode(), word[2].encode()
        return keep(c, (cache.get(core) or chunk(core)) + (cache.get(tail) or chunk(tail)))

    def encode(text: str) -> bytes:
        raw = text.encode()
        if b"<|" in raw:
            return direct(raw)
        chunks = raw.lower().split()
        out = [cache.get(c) for c in chunks]
        if None in out:
            for i, got in enumerate(out):
                if got is None:
                    out[i] = chunk(chunks[i])
        return b"".join(out)

    return encode


def _pieces(path: str, sequence: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        end = _ids_bytes([END_ID])
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (encode(text) if text else b"") + end
                n = len(ids) // 4
                for start in range(0, n, sequence):
                    part = ids[4 * start : 4 * (start + sequence)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), n))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return cut


def pieces(docs: DataFrame, tokenizer_path: str, *, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: full sequences and the rest of each document."""
    slim = bounded_batches(docs).select(F.col(id_col).cast("long"), F.col(text_col))
    return slim.mapInArrow(_pieces(tokenizer_path, sequence), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


# --- the plan ------------------------------------------------------------------------------


def price(duals: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: an unbounded knapsack by dynamic programming over the fill."""
    value = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    for fill in range(1, capacity + 1):
        fits = int(np.searchsorted(sizes, fill, "right"))
        value[fill] = value[fill - 1]
        if fits:
            worth = value[fill - sizes[:fits]] + duals[:fits]
            best = int(np.argmax(worth))
            if worth[best] > value[fill] + 1e-12:
                value[fill], taken[fill] = worth[best], best
    pattern, fill = np.zeros(len(sizes)), capacity
    while fill > 0:
        if taken[fill] < 0:
            fill -= 1
        else:
            pattern[taken[fill]] += 1
            fill -= sizes[taken[fill]]
    return float(value[capacity]), pattern


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row exchanges.

    The threaded LAPACK routine can wait forever in a process that has started
    children, as a Spark driver has.
    """
    n = len(a)
    both = np.concatenate([a, np.eye(n)], 1)
    for i in range(n):
        pivot = i + int(np.argmax(np.abs(both[i:, i])))
        both[[i, pivot]] = both[[pivot, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0
        both -= factor[:, None] * both[i]
    return both[:, n:]


def column_generation(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[float, np.ndarray]]:
    """``(times, pattern)`` of a linear program that covers the counts with the fewest sequences.

    Starts from one pattern per class; every basis in between is feasible, so the
    result is valid should ``rounds`` end the search before the optimum.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ counts
    for step in range(rounds):
        worth, pattern = price(np.maximum(inverse.sum(0), 0), sizes, capacity)
        if worth <= 1 + 1e-7:
            break
        direction = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, x / direction, np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = pattern
        x = x - ratio[leave] * direction
        x[leave] = ratio[leave]
        x = np.maximum(x, 0)
        if step % 200 == 199:
            inverse = _inverse(basis)
            x = np.maximum(inverse @ counts, 0)
        else:
            row = inverse[leave] / direction[leave]
            inverse -= np.outer(direction, row)
            inverse[leave] = row
    return [(float(x[i]), basis[:, i].copy()) for i in range(m)]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """``(times, pattern)`` whose patterns hold every class exactly as often as the histogram, or more."""
    sizes = np.array(sorted(k for k, n in histogram.items() if n), int)
    if not len(sizes):
        return []
    left = np.array([histogram[int(s)] for s in sizes], int)
    out: list[tuple[int, dict[int, int]]] = []
    for times, pattern in column_generation(sizes, left.astype(float), capacity):
        held = pattern.astype(int)
        n = int(times + 1e-6)
        some = held > 0
        n = min([n, *(left[some] // held[some]).tolist()])
        if n > 0:
            out.append((n, {int(s): int(h) for s, h in zip(sizes, held, strict=True) if h}))
            left -= n * held
    # The rest: first fit in falling length, many equal sequences at a time.
    while left.any():
        pattern, room = {}, capacity
        for i in range(len(sizes) - 1, -1, -1):
            h = min(int(left[i]), room // int(sizes[i]))
            if h:
                pattern[i] = h
                room -= h * int(sizes[i])
        n = min(int(left[i]) // h for i, h in pattern.items())
        out.append((n, {int(sizes[i]): h for i, h in pattern.items()}))
        for i, h in pattern.items():
            left[i] -= n * h
    return out


def _plan_table(planned: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int]]:
    """``(class, first rank, end rank, pieces a sequence, first sequence)``."""
    rows, used, sequence = [], {}, 0
    for times, pattern in planned:
        for size, h in pattern.items():
            first = used.get(size, 0)
            used[size] = first + times * h
            rows.append((size, first, used[size], h, sequence))
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer_path: str, *, sequence: int = SEQUENCE, grain: int = GRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with their ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer_path, sequence=sequence, id_col=id_col, text_col=text_col)
    size = F.ceil(F.col("length") / grain).cast("int")
    cut = settle(cut.withColumn("size", size))
    histogram = {r["size"]: r["n"] for r in cut.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = _plan_table(plan(histogram, sequence // grain))
    planned = spark.createDataFrame(table, "size int, first long, upto long, held long, base long")

    salts = max(64, sum(histogram.values()) // SALT_PIECES)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    sized = salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    local = Window.partitionBy("size", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(local) - 1).join(offsets, ["size", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("ahead"))

    # The plan has a bounded number of rows: patterns times the classes in each.
    hit = (ranked["size"] == planned["size"]) & (ranked["rank"] >= planned["first"]) & (ranked["rank"] < planned["upto"])
    placed = ranked.join(F.broadcast(planned), hit).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", ranked["rank"],
        (F.col("base") + F.floor((ranked["rank"] - F.col("first")) / F.col("held"))).alias("sequence_id"),
    )
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank", "doc_id", "start").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(within), F.lit(0)).alias("offset")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)
