"""Removal of word passages that an earlier document has: sparse suffix trees by prefix.

A window is ``WINDOW`` = 13 consecutive words of one document; it goes if its
words also start somewhere in a document with a smaller id.

Not every suffix is kept, only those that start at an *anchor*: among the nine
5-word prefixes that fit into a window, the anchor is the one with the least hash
(the first of equals).  Equal windows have equal anchors at equal offsets, so the
suffix trees over anchored suffixes, extended to the left by up to eight words,
hold every repeated window, at a fifth of the suffixes.

1.  The anchors of all documents are dealt into groups by their prefix; prefixes
    that only one document has are unique and drop out with all their windows.
2.  For the others, each document ships the stretch of words that the anchor's
    windows cover to the group of its prefix.  A group is sized to fit in memory.
    Its suffix tree is cut level by level: the nodes at depth 2 d follow from
    those at depth d (:func:`nodes`), and the nodes at depth 13 with leaves from
    more than one document are the repeats.  They compare words, not hashes.
3.  The covered words of each document are taken out.

Hot passages: what one task holds several times is settled inside the task
(only the smallest document has to ask others), so a group gets a stretch of
words at most once from each task, however many documents share it.

Defined results: a null text is empty; documents under 13 words lose nothing;
rows that repeat an id are separate documents with an equal id, so they never
remove words from each other; a null id counts as greater than every other;
empty tables give an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowseq.llm.common import bounded_batches, settle, text_bytes
from flowseq.order import OrderSpec
from flowseq.plans.layout import Layout

_SALTS = 64
WINDOW = 13
PREFIX = 5
_SPAN = WINDOW - PREFIX + 1
#: Anchors that one group should hold, and that a task gathers before it sends them.
GROUP_ANCHORS = 250_000
SEND_ANCHORS = 1 << 19
#: A prefix that one task sees more often is settled inside the task.
HOT = 16
_ODD = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))

_codes: dict[bytes, int] = {}


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of anything but space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.encode().split() if text else []


def _code(words: list[bytes]) -> np.ndarray:
    """A 64-bit code of each word; a worker keeps the codes of words that it has met."""
    import xxhash

    if len(_codes) > 400_000:
        _codes.clear()
    out = [_codes.get(w) for w in words]
    for i, c in enumerate(out):
        if c is None:
            w = words[i]
            c = out[i] = xxhash.xxh64_intdigest(w)
            if len(w) <= 32:
                _codes[w] = c
    return np.array(out, np.uint64)


def anchors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the prefix at each position, and the anchor's position for each window."""
    if len(words) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = _code(words)
    n = len(words) - PREFIX + 1
    h = code[:n] * _ODD[0]
    for j in range(1, PREFIX):
        h += code[j : j + n] * _ODD[j]
    h ^= h >> np.uint64(29)
    h *= _ODD[1]
    h ^= h >> np.uint64(32)
    least = np.lib.stride_tricks.sliding_window_view(h, _SPAN).argmin(1)
    return h, least + np.arange(len(least))


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length, byte planes apart, compressed."""
    import zstandard

    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays)
    return zstandard.compress(planes, 1)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for k, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).ravel())
        at += n * size
    return out


def _spread(x: np.ndarray, groups: int) -> np.ndarray:
    h = x.astype(np.uint64) * _ODD[3]
    return ((h ^ (h >> np.uint64(32))) % np.uint64(groups)).astype(np.int32)


_BLOBS = pa.schema([("g", pa.int32()), ("known", pa.bool_()), ("blob", pa.binary()), ("words", pa.binary())])
_BLOB_DDL = "g int, known boolean, blob binary, words binary"


def _by_group(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(group, kind="stable")
    cut = np.flatnonzero(np.diff(group[order])) + 1
    for rows in np.split(order, cut):
        if len(rows):
            yield int(group[rows[0]]), rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOBS, strict=True)], schema=_BLOBS)


def _send_anchors(groups: int, shift: int):
    def flush(h: np.ndarray, uid: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        # Of a prefix met often, two documents' anchors stand for all: the rest is known to be shared.
        order = np.lexsort((uid, h))
        sh, su = h[order], uid[order] >> shift
        start = np.flatnonzero(np.r_[True, sh[1:] != sh[:-1]])
        size = np.diff(np.r_[start, len(sh)])
        first, last = su[start], su[start + size - 1]
        hot = (size > HOT) & (first != last)
        known = np.zeros(len(h), bool)
        inner = np.repeat(hot, size)
        inner[start[hot]] = False
        inner[(start + size - 1)[hot]] = False
        known[order] = inner
        rows = []
        fresh = np.flatnonzero(~known)
        for g, at in _by_group((h[fresh] % np.uint64(groups)).astype(np.int32)):
            i = fresh[at]
            rows.append((g, False, _pack((h[i] >> np.uint64(16)).astype(np.uint64), np.diff(uid[i], prepend=0), pos[i]), None))
        told = np.flatnonzero(known)
        for g, at in _by_group(_spread(uid[told], groups)):
            i = told[at]
            rows.append((g, True, _pack(np.diff(uid[i], prepend=0), pos[i]), None))
        return _batch(rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, at = anchors(words_of(text))
                if len(at):
                    at = at[np.r_[True, at[1:] != at[:-1]]]
                    held.append((h[at], np.full(len(at), uid, np.int64), at.astype(np.uint32)))
                    n += len(at)
                    if n >= SEND_ANCHORS:
                        yield flush(*map(np.concatenate, zip(*held, strict=True)))
                        held, n = [], 0
        if held:
            yield flush(*map(np.concatenate, zip(*held, strict=True)))

    return send


def _lists(name: str, uid: np.ndarray, values: np.ndarray) -> pd.DataFrame:
    """A row with the list of its values for each of the ascending uids."""
    start = np.flatnonzero(np.r_[True, uid[1:] != uid[:-1]]) if len(uid) else np.zeros(0, np.int64)
    lists = [x.tolist() for x in np.split(values, start[1:])] if len(start) else []
    return pd.DataFrame({"uid": uid[start], name: pd.Series(lists, dtype=object)})


def _shared(shift: int):
    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        """Anchors whose prefix more than one document has: ``uid, at``, by document."""
        uids, positions = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        hashes: list[np.ndarray] = []
        fresh_uid: list[np.ndarray] = []
        fresh_pos: list[np.ndarray] = []
        for known, blob in zip(pdf["known"], pdf["blob"], strict=True):
            if known:
                d, p = _unpack(blob, "i8", "u4")
                uids.append(np.cumsum(d))
                positions.append(p)
            else:
                h, d, p = _unpack(blob, "u8", "i8", "u4")
                hashes.append(h)
                fresh_uid.append(np.cumsum(d))
                fresh_pos.append(p)
        if hashes:
            h, uid, pos = np.concatenate(hashes), np.concatenate(fresh_uid), np.concatenate(fresh_pos)
            order = np.lexsort((uid, h))
            h, uid, pos = h[order], uid[order], pos[order]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[start, len(h)])
            more = (uid[start] >> shift) != (uid[start + size - 1] >> shift)
            mask = np.repeat(more, size)
            uids.append(uid[mask])
            positions.append(pos[mask])
        uid, pos = np.concatenate(uids), np.concatenate(positions)
        order = np.argsort(uid, kind="stable")
        uid, pos = uid[order], pos[order]
        return _lists("at", uid, pos.astype(np.int32))

    return shared


def _send_stretches(groups: int, shift: int):
    def flush(held: list[tuple[int, int, int, bytes, int]]) -> pa.RecordBatch:
        """``held``: (uid, first window, number of windows, words, prefix hash)."""
        least: dict[bytes, int] = {}
        for uid, _, _, words, _ in held:
            d = uid >> shift
            if least.setdefault(words, d) > d:
                least[words] = d
        ask = [x for x in held if x[0] >> shift == least[x[3]]]
        told = [x for x in held if x[0] >> shift != least[x[3]]]
        rows = []
        for known, part in ((False, ask), (True, told)):
            if not part:
                continue
            uid, first, n = (np.array(c, np.int64) for c in list(zip(*part, strict=True))[:3])
            key = _spread(uid, groups) if known else (np.array([x[4] for x in part], np.uint64) % np.uint64(groups)).astype(np.int32)
            for g, at in _by_group(key):
                import zstandard

                text = None if known else zstandard.compress(b"\n".join(part[i][3] for i in at.tolist()), 1)
                rows.append((g, known, _pack(uid[at], first[at].astype(np.uint32), n[at].astype(np.uint32)), text))
        return _batch(rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes, int]] = []
        for batch in batches:
            for uid, text, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = words_of(text)
                h, anchor = anchors(words)
                mine = np.unique(np.array(at, np.int64))
                first = np.searchsorted(anchor, mine, "left")
                last = np.searchsorted(anchor, mine, "right")
                for a, lo, hi in zip(mine.tolist(), first.tolist(), last.tolist(), strict=True):
                    if hi > lo:
                        held.append((uid, lo, hi - lo, b" ".join(words[lo : hi - 1 + WINDOW]), int(h[a])))
                if len(held) >= SEND_ANCHORS // 4:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    return send


def nodes(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The suffix tree's node at depth ``WINDOW`` above each of the suffixes that start at ``starts``.

    ``symbols`` numbers the words of all stretches, one after the other.  Nodes at
    depth 2 d are pairs of nodes at depth d, so 1, 2, 4 and 8 follow from each
    other, and 13 from two nodes at depth 8 that overlap.
    """
    node, depth = symbols.astype(np.int64), 1
    while 2 * depth <= WINDOW:
        pair = node.copy()
        pair[:-depth] = node[:-depth] * (int(node.max()) + 1) + node[depth:]
        node = np.unique(pair, return_inverse=True)[1]
        depth *= 2
    pair = node[starts] * (int(node.max()) + 1) + node[starts + WINDOW - depth]
    return np.unique(pair, return_inverse=True)[1]


def _repeats(shift: int):
    def repeats(pdf: pd.DataFrame) -> pd.DataFrame:
        """Runs of windows that a smaller document has: ``uid, first, n``."""
        import zstandard

        out = [(np.zeros(0, np.int64),) * 3]
        uid, first, n, sizes = [], [], [], []
        words: list[bytes] = []
        for known, blob, text in zip(pdf["known"], pdf["blob"], pdf["words"], strict=True):
            part = [x.astype(np.int64) for x in _unpack(blob, "i8", "u4", "u4")]
            if known:
                out.append(tuple(part))
                continue
            for column, x in zip((uid, first, n), part, strict=True):
                column.append(x)
            for stretch in zstandard.decompress(text).split(b"\n"):
                own = stretch.split(b" ")
                sizes.append(len(own))
                words += own
        if uid:
            u, f, m = np.concatenate(uid), np.concatenate(first), np.concatenate(n)
            numbers: dict[bytes, int] = {}
            symbols = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
            base = np.cumsum(sizes) - np.array(sizes)
            owner = np.repeat(np.arange(len(m)), m)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)
            node = nodes(np.r_[symbols, np.zeros(WINDOW, np.int64)], base[owner] + step)
            doc = u[owner] >> shift
            least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, node, doc)
            gone = np.flatnonzero(doc > least[node])
            if len(gone):
                o, s = owner[gone], step[gone]
                new = np.r_[True, (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)]
                at = np.flatnonzero(new)
                out.append((u[o[at]], f[o[at]] + s[at], np.diff(np.r_[at, len(o)])))
        u, f, m = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.argsort(u, kind="stable")
        return _lists("runs", u[order], ((f << 32) | m)[order])

    return repeats


def _cover(n: int, runs: list[int] | None) -> np.ndarray:
    """Which of n words the runs of windows (first << 32 | number) cover."""
    edge = np.zeros(n + 1, np.int64)
    for run in runs or ():
        first, m = run >> 32, run & 0xFFFFFFFF
        edge[first] += 1
        edge[first + m - 1 + WINDOW] -= 1
    return np.cumsum(edge[:n]) > 0


def _identified(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """``uid, doc_id, text`` with a unique ``uid`` whose upper bits order like the ids, and the number of lower bits.

    Where ids are unique and present, which one aggregation over the ids tells, the
    uid is the id.  Else the upper bits are the id's place among all ids (null the
    last), and the lower ones number the rows of an id, however many it has, by
    salts, so that no task holds them all.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    top = slim.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.bool_or(F.col("doc_id").isNull()).alias("nameless")).first()
    if (top["most"] or 0) <= 1 and not top["nameless"]:
        return slim.withColumn("uid", F.col("doc_id")), 0
    salted = settle(slim.withColumn("at", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(_SALTS))))
    ids = salted.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    ranked = settle(Layout(ids, OrderSpec((("doc_id", True),))).index("rank"))
    known = ranked.count()
    most = salted.groupBy("doc_id", "salt").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    bits = (_SALTS - 1).bit_length() + int(most).bit_length()
    if (known + 1) << bits >= 1 << 62:
        raise ValueError("too many rows of too many ids to number them in 62 bits")
    number = F.row_number().over(Window.partitionBy("doc_id", "salt").orderBy("at")) - 1 + F.col("salt") * (1 << int(most).bit_length())
    numbered = salted.withColumn("number", number).join(ranked, "doc_id", "left")
    return settle(numbered.select("doc_id", "text", (F.shiftleft(F.coalesce("rank", F.lit(known)), bits) + F.col("number")).alias("uid"))), bits


def repeated_runs(docs: DataFrame, shift: int, *, groups: int) -> DataFrame:
    """``uid, runs``: the windows of each document that a smaller document has."""
    slim = docs.select("uid", "text")
    sent = slim.mapInArrow(_send_anchors(groups, shift), _BLOB_DDL)
    shared = sent.groupBy("g").applyInPandas(_shared(shift), "uid long, at array<int>")
    places = settle(shared.groupBy("uid").agg(F.flatten(F.collect_list("at")).alias("at")))
    stretches = slim.join(places, "uid").select("uid", "text", "at").mapInArrow(_send_stretches(groups, shift), _BLOB_DDL)
    found = stretches.groupBy("g").applyInPandas(_repeats(shift), "uid long, runs array<long>")
    return settle(found.groupBy("uid").agg(F.flatten(F.collect_list("runs")).alias("runs")))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = words_of(text)
            if runs:
                gone = _cover(len(words), runs)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            else:
                kept = words
            rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
        n, removed, kept_text = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept_text, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: each document's words that stay, joined by single spaces."""
    whole, shift = _identified(bounded_batches(docs), id_col, text_col)
    groups = max(256, text_bytes(docs, text_col) // 30 // GROUP_ANCHORS)
    runs = repeated_runs(whole, shift, groups=groups)
    joined = whole.join(runs, "uid", "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(_apply, "doc_id long, n_words long, n_removed long, kept string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
