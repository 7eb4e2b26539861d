"""Benchmark decontamination by q-gram filtering in diagonal bands.

Texts are folded: case by Unicode's rules in all letters, then byte by byte other
ASCII but letters and digits to spaces.  Where folding changes the number of
characters (as of sharp s), found positions are mapped back.  Every benchmark item is cut into
patterns: the whole item up to ``PATTERN`` bytes, overlapping pieces of that
length if it is longer.  For a pattern of m bytes the edit budget e is a share of
m, bounded so that the q-gram lemma says something: a region within e edits
shares at least m - q + 1 - q e of the pattern's q-grams.

Each Arrow batch of documents is one byte array.  Its q-grams (7 bytes, which
permit one edit in ten bytes) are looked up in a bit table, then in the sorted q-grams of the
patterns.  A hit lies on the diagonal text position - pattern position; diagonals
are counted in bands of twice the needed width that overlap by half, so the hits
of any alignment within e edits fall together into one band.  Counts
by a hash of the band, never too low, first rule out most hits.  Bands that reach the
bound are verified by an alignment of the whole pattern along the band's diagonals.

A quotation of part of an item, of ``EXCERPT`` bytes or more without an edit, is a
run of consecutive q-gram hits on one diagonal: pieces overlap by more than that, so
it lies in a piece as a whole.  Such runs count where the whole pattern is not found.

Documents are never shuffled.  The patterns are shipped in blocks of at most
``BLOCK_BYTES`` of benchmark text; a larger benchmark takes more passes.

Defined results: null and empty texts contain nothing; items that are null or have no
letter or digit match nothing; items shorter than ``SHORTEST`` bytes after folding
match word for word, between word borders, with no shared q-grams counted; rows of the
benchmark that share an item id, which may be null, are one item, whose texts are
looked for together; repeated documents each give rows; empty tables give an empty
result; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from flowseq.llm.common import bounded_batches, settle

Q = 7
PATTERN = 192
#: Step from one piece of a long item to the next.
STRIDE = 96
SHORTEST = 32
#: Bytes of an item that are a leak when they stand in a text word for word.
EXCERPT = 64
#: Edits allowed as a share of a pattern's length, where the lemma permits as many.
EDIT_RATE = 0.1
BLOCK_BYTES = 4 << 20
#: Bytes of text and q-gram matches that are looked at together: bound a task's memory.
BATCH_BYTES = 1 << 20
BATCH_MATCHES = 4 << 20
_BITS = 22
#: Mask of the slots that half bands are counted in.
_SLOTS = (1 << 20) - 1
#: Added to diagonals, which are negative where a text begins within a pattern.
_SHIFT = 1 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


_WORDS = re.compile(rb"[^ ]+")


def fold(text: str) -> bytes:
    return text.casefold().encode().translate(_FOLD)


def unfolded(text: str, start: int, end: int) -> tuple[int, int]:
    """The code points of ``text`` that hold those from ``start`` to ``end`` of its case-folded form."""
    if len(text.casefold()) == len(text):
        return start, end
    ends = np.cumsum([len(c.casefold()) for c in text])
    return int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, end, "left")) + 1


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit code of the q-gram at every position of a byte array."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.concatenate([data, np.zeros(8 - Q, np.uint8)])
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        out[o::8] = data[o : o + (len(data) - o) // 8 * 8].view(np.uint64)
    return (out & np.uint64((1 << 8 * Q) - 1)) * np.uint64(0x9E3779B97F4A7C15)


def budget(m: int) -> int:
    """Edits allowed in a pattern of m bytes: the lemma's bound stays at least a quarter of its q-grams."""
    return max(0, min(int(EDIT_RATE * m), (m - Q + 1) * 3 // (4 * Q)))


def bound(m: int) -> int:
    return m - Q + 1 - Q * budget(m)


class Patterns:
    """The patterns of one block of items, with their q-grams sorted."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [item for item, _ in items]
        self.item: list[int] = []
        self.text: list[bytes] = []
        self.short: dict[bytes, list[int]] = {}
        for k, (_, text) in enumerate(items):
            data = fold(text).strip(b" ")
            if len(data) < SHORTEST:
                if words := data.split():
                    self.short.setdefault(b" ".join(words), []).append(k)
                continue
            starts = [0] if len(data) <= PATTERN else [*range(0, len(data) - PATTERN, STRIDE), len(data) - PATTERN]
            for s in starts:
                self.item.append(k)
                self.text.append(data[s : s + PATTERN])
        self.words = _automaton(self.short)
        codes = [grams(np.frombuffer(t, np.uint8)) for t in self.text]
        self.gram = np.concatenate([*codes, np.zeros(0, np.uint64)])
        self.owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        self.at = np.concatenate([*(np.arange(len(c)) for c in codes), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.owner, self.at = self.gram[order], self.owner[order], self.at[order]
        self.distinct, self.first, self.number = np.unique(self.gram, return_index=True, return_counts=True)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[self._slot(self.gram)] = True
        sizes = np.array([len(t) for t in self.text], np.int64)
        self.bound = np.array([bound(m) for m in sizes.tolist()], np.int64)
        # Half a band; every band is two halves wide and e edits move a match by e diagonals at most.
        self.half = np.array([budget(m) + 1 for m in sizes.tolist()], np.int64)
        # A band's region lies within so many bytes of its first diagonal.
        self.reach = int((sizes + 4 * self.half).max(initial=0))

    def part(self, low: int, high: int) -> Patterns:
        """The same with the q-grams of the patterns from ``low`` to ``high`` only."""
        out = copy(self)
        mine = (self.owner >= low) & (self.owner < high)
        out.gram, out.owner, out.at = self.gram[mine], self.owner[mine], self.at[mine]
        out.distinct, out.first, out.number = np.unique(out.gram, return_index=True, return_counts=True)
        return out

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _BITS)


def _automaton(short: dict[bytes, list[int]]):
    if not short:
        return None
    import ahocorasick

    found = ahocorasick.Automaton()
    for words in short:
        found.add_word(words.decode("latin-1"), words)
    found.make_automaton()
    return found


def short_matches(raw: bytes, patterns: Patterns) -> Iterator[tuple[int, int, int]]:
    """``(item, start, end)`` of short items that stand in a case-folded text word for word, between word borders."""
    if patterns.words is None:
        return
    text = raw.translate(_FOLD)
    # Words stand one blank apart in the items, so they must here; where each was is kept.
    places = [(m.start(), m.end()) for m in _WORDS.finditer(text)]
    line = b" ".join(text[a:b] for a, b in places)
    starts = np.cumsum([0, *(b - a + 1 for a, b in places)])
    for end, words in patterns.words.iter(line.decode("latin-1")):
        first, after = end + 1 - len(words), end + 1
        if (not first or line[first - 1] == 32) and (after == len(line) or line[after] == 32):
            i, j = np.searchsorted(starts, [first, after], "right") - 1
            for item in patterns.short[words]:
                yield item, places[int(i)][0], places[int(j)][1]


def align(pattern: bytes, region: bytes, edits: int, diagonals: tuple[int, int] | None = None) -> tuple[int, int, int] | None:
    """Fewest edits of the whole pattern against any part of the region: ``(edits, start, end)``, or None beyond ``edits``.

    Only the ``diagonals`` (from, to; text position less pattern position) are computed;
    without them, all that an alignment within the edits can touch.
    """
    exact = region.find(pattern)
    if exact >= 0:
        return 0, exact, exact + len(pattern)
    m, n = len(pattern), len(region)
    low, high = diagonals or (-edits, n - m + 2 * edits)
    width = high - low + 1
    if width <= 0:
        return None
    out = 1 << 20
    # Characters and positions by diagonal: those outside the region fit nothing.
    reach = np.arange(low, low + m + width)
    inside = (reach >= 0) & (reach < n)
    text = np.full(m + width, 256, np.int64)
    text[inside] = np.frombuffer(region, np.uint8)[reach[inside]]
    column = np.arange(width)
    position = column + low
    cost = np.where((position >= 0) & (position <= n), 0, out)
    start = position.copy()
    for i, c in enumerate(pattern, 1):
        diagonal, down = cost + (text[i - 1 : i - 1 + width] != c), np.append(cost[1:], out) + 1
        better = diagonal <= down
        step = np.where(better, diagonal, down)
        origin = np.where(better, start, np.append(start[1:], 0))
        position = column + low + i
        step[(position < 0) | (position > n)] = out
        # Steps along the region cost one each: a running minimum of step - column.
        run = np.minimum.accumulate((step - column) * (width + 1) + column)
        source = run % (width + 1)
        cost = run // (width + 1) + column
        start = origin[source]
        cost[position > n] = out
        if cost.min() > edits:
            return None
    best = int(np.argmin(cost))
    return int(cost[best]), int(start[best]), best + low + m


def look_up(data: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions whose q-gram a pattern has, and where these are among the patterns' q-grams: first and number."""
    codes = grams(data)
    hit = np.flatnonzero(patterns.table[Patterns._slot(codes)])
    if not len(hit):
        return hit, hit, hit
    found = codes[hit]
    at = np.minimum(np.searchsorted(patterns.distinct, found), len(patterns.distinct) - 1)
    same = patterns.distinct[at] == found
    return hit[same], patterns.first[at[same]], patterns.number[at[same]]


def regions(
    data: np.ndarray, ends: np.ndarray, patterns: Patterns, *, origin: np.ndarray | None = None, own: np.ndarray | None = None, looked_up=None, quoted: list | None = None
) -> list[tuple[int, int, int, int, int, int]]:
    """Matches in concatenated folded texts: ``(text, pattern, start, end, edits, shared)``.

    ``ends`` are the texts' ends in ``data``; a match never crosses one.  Where
    ``data`` holds parts of texts, ``origin`` says at what byte of its text each
    begins, and only bands are judged whose first diagonal lies in the text's
    range ``own`` (from, to).  Bands are laid by the text, so neither its parts nor
    its neighbours matter.  ``quoted`` receives the excerpts, in the same form.
    """
    origin = np.zeros(len(ends), np.int64) if origin is None else origin
    hit, lo, n = looked_up or look_up(data, patterns)
    if not len(hit):
        return []
    begin = np.r_[0, ends[:-1]] - origin
    text = np.searchsorted(ends, hit, "right")
    inside = hit + Q <= ends[text]
    hit, lo, n, text = hit[inside], lo[inside], n[inside], text[inside]
    where = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    owner = patterns.owner[where]
    half = patterns.half[owner]
    diagonal = np.repeat(hit - begin[text], n) - patterns.at[where] + _SHIFT  # never negative
    hit, text = np.repeat(hit, n), np.repeat(text, n)
    band = diagonal // half
    width = int(band.max(initial=0)) + 2
    # Band k holds the half bands k and k + 1, so every hit counts for two bands.
    key = (text * len(patterns.text) + owner) * width + band
    least = np.minimum(patterns.bound, EXCERPT - Q + 1)[owner]
    # Half bands that follow one another have slots that do; a slot counts at least its half band.
    slot = (Patterns._slot((key // width).view(np.uint64)).astype(np.int64) + band) & _SLOTS
    seen = np.bincount(slot, minlength=_SLOTS + 1)
    mine = seen[slot]
    upper = mine + seen[(slot + 1) & _SLOTS] >= least
    lower = mine + seen[(slot - 1) & _SLOTS] >= least
    if quoted is not None:
        # The hits of an excerpt share a diagonal, so their band has them all.
        quoted += excerpts(hit[upper], text[upper], owner[upper], diagonal[upper])
    at = np.r_[np.flatnonzero(upper), np.flatnonzero(lower) + len(key)]
    both = np.concatenate([key[upper], key[lower] - 1])
    keys, first, count = np.unique(both, return_index=True, return_counts=True)
    first = at[first] % len(key)
    # The bound is on places of the pattern, of which a repeated word hits some more than once.
    places = np.unique(both * PATTERN + patterns.at[where][at % len(key)])
    good = np.bincount(np.searchsorted(keys, places // PATTERN), minlength=len(keys)) >= patterns.bound[owner[first]]
    found: list[tuple[int, int, int, int, int, int]] = []
    for k, i, c in zip(keys[good].tolist(), first[good].tolist(), count[good].tolist(), strict=True):
        p, t = int(owner[i]), int(text[i])
        e, m = budget(len(patterns.text[p])), len(patterns.text[p])
        low = (k % width) * int(half[i]) - _SHIFT
        if own is not None and not own[t][0] <= low < own[t][1]:
            continue
        low += int(begin[t])
        a = max(low - e, int(ends[t - 1]) if t else 0)
        b = min(low + 2 * int(half[i]) + m + e, int(ends[t]))
        if got := align(patterns.text[p], data[a:b].tobytes(), e, (low - e - a, low + 2 * int(half[i]) + e - a)):
            found.append((t, p, a + got[1], a + got[2], got[0], c))
    return found


def excerpts(hit: np.ndarray, text: np.ndarray, owner: np.ndarray, diagonal: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of consecutive hits on a diagonal that cover ``EXCERPT`` bytes: as :func:`regions` gives matches."""
    # Hits come by position: by text, pattern and diagonal they stay so.
    order = np.lexsort((hit, diagonal, owner, text))
    hit, text, owner, diagonal = hit[order], text[order], owner[order], diagonal[order]
    broken = (np.diff(hit) != 1) | (np.diff(text) != 0) | (np.diff(owner) != 0) | (np.diff(diagonal) != 0)
    first = np.flatnonzero(np.r_[len(hit) > 0, broken])
    size = np.diff(np.r_[first, len(hit)])
    first, size = first[size > EXCERPT - Q], size[size > EXCERPT - Q]
    return [(t, p, a, a + n + Q - 1, 0, n) for t, p, a, n in zip(text[first].tolist(), owner[first].tolist(), hit[first].tolist(), size.tolist(), strict=True)]


def matches(raw: list[bytes], patterns: Patterns, *, batch_bytes: int = BATCH_BYTES, batch_matches: int = BATCH_MATCHES, quoted: list | None = None) -> Iterator[tuple[int, int, int, int, int, int]]:
    """What :func:`regions` finds in whole case-folded texts, by bytes of them, in bounded memory.

    A text longer than ``batch_bytes`` is looked at range by range, and ranges with
    more than ``batch_matches`` q-gram matches, as of phrases that very many items
    share, are halved.  ``quoted`` receives the excerpts; one that a range cuts comes
    whole from the range it begins in.
    """
    if not patterns.text:
        return
    # Below this a range would mostly be what it shares with its neighbours.
    least, reach = 4 * patterns.reach, patterns.reach
    batch_bytes = max(batch_bytes, least)
    todo: list[list[tuple[int, int, int]]] = [[]]
    size = 0
    for t, text in enumerate(raw):
        for at in range(0, len(text), batch_bytes):
            upto = min(at + batch_bytes, len(text))
            if size + upto - at > batch_bytes:
                todo.append([])
                size = 0
            todo[-1].append((t, at, upto))
            size += upto - at
    while todo:
        part = todo.pop()
        whole = [(raw[t][max(0, a - reach) : b + reach], max(0, a - reach)) for t, a, b in part]
        data = np.frombuffer(b"".join(x for x, _ in whole).translate(_FOLD), np.uint8)
        found = look_up(data, patterns)
        if found[2].sum() > batch_matches:
            if len(part) > 1:
                todo += [part[: len(part) // 2], part[len(part) // 2 :]]
                continue
            t, a, b = part[0]
            if b - a > 2 * least:
                todo += [[(t, a, (a + b) // 2)], [(t, (a + b) // 2, b)]]
                continue
        # A range too short to halve is compared with some of the patterns at a time.
        times = max(1, -(-int(found[2].sum()) // batch_matches))
        step = -(-len(patterns.text) // times)
        some = [patterns] if times == 1 else (patterns.part(p, p + step) for p in range(0, len(patterns.text), step))
        ends = np.cumsum([len(x) for x, _ in whole])
        origin = np.array([o for _, o in whole], np.int64)
        # The first range of a text owns the diagonals in front of it too.
        own = np.array([(a if a else -_SHIFT, b if b < len(raw[t]) else b + _SHIFT) for t, a, b in part], np.int64).reshape(-1, 2)
        for mine in some:
            runs = None if quoted is None else []
            # Positions are those of the concatenated ranges: back to those of the texts.
            shift = origin - np.r_[0, ends[:-1]]
            for i, p, a, b, e, c in regions(data, ends, mine, origin=origin, own=own, looked_up=found if times == 1 else None, quoted=runs):
                yield part[i][0], p, a + int(shift[i]), b + int(shift[i]), e, c
            for i, p, a, b, e, c in runs or ():
                quoted.append((part[i][0], p, a + int(shift[i]), b + int(shift[i]), e, c))


def _scan(shipped):
    names = ["doc_id", "item_id", "start", "end", "edits", "shared_qgrams"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = Patterns(shipped.value)
        # Rows of the benchmark that share an id, which may be null, are one item.
        distinct = list(dict.fromkeys(patterns.ids))
        names_of = [distinct.index(i) for i in patterns.ids] if len(distinct) < len(patterns.ids) else list(range(len(distinct)))

        def search(ids: list, texts: list[str], raw: list[bytes]) -> pa.RecordBatch:
            best: dict[tuple[int, int], list] = {}
            quoted: list = []
            whole = [(t, names_of[patterns.item[p]], a, b, e, c) for t, p, a, b, e, c in matches(raw, patterns, quoted=quoted)]
            whole += [(t, names_of[k], a, b, 0, 0) for t, text in enumerate(raw) for k, a, b in short_matches(text, patterns)]
            known = {x[:2] for x in whole}
            parts = [(t, names_of[patterns.item[p]], a, b, e, c) for t, p, a, b, e, c in quoted]
            for t, item, a, b, e, c in [*whole, *(x for x in parts if x[:2] not in known)]:
                got = best.setdefault((t, item), [a, b, e, c])
                best[t, item] = [min(got[0], a), max(got[1], b), min(got[2], e), max(got[3], c)]
            rows = []
            for (t, item), (a, b, e, c) in best.items():
                span = unfolded(texts[t], len(raw[t][:a].decode(errors="ignore")), len(raw[t][:b].decode(errors="ignore")))
                rows.append((ids[t], distinct[item], *span, e, c))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

        for batch in batches:
            ids, texts, raw, size = [], [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    ids.append(i)
                    texts.append(text)
                    raw.append(text.casefold().encode())
                    size += len(raw[-1])
                    if size >= BATCH_BYTES:
                        yield search(ids, texts, raw)
                        ids, texts, raw, size = [], [], [], 0
            yield search(ids, texts, raw)

    return scan


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items in order of their ids; rows that share an id are never parted, so blocks don't show in the result."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col), F.col(text_col)).distinct().orderBy(item_col, text_col).toLocalIterator():
        if row[1]:
            if size >= block_bytes and block[-1][0] != row[0]:
                yield block
                block, size = [], 0
            block.append((row[0], row[1]))
            size += len(row[1].encode())
    yield block


def leaks(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``doc_id, item_id, start, end, edits, shared_qgrams``: the benchmark items that documents contain.

    One row per document and item: the extent of all its matches in code points,
    the fewest edits and the most shared q-grams of any of them.  Excerpts count
    where no whole pattern matches.
    """
    slim = bounded_batches(docs).select(F.col(id_col).cast("long"), F.col(text_col))
    schema = "doc_id long, item_id long, start long, end long, edits long, shared_qgrams long"
    found, pending = None, None
    for block in _blocks(benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")), "i", "t", block_bytes):
        if block or pending is None:
            if pending is not None:  # one job per block: plans stay short
                found = settle(pending) if found is None else found.unionAll(settle(pending))
            pending = slim.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(block)), schema)
    return pending if found is None else found.unionAll(pending)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that contain a benchmark item, in the same map-side way."""
    out = bounded_batches(docs)
    for block in _blocks(benchmark.select("item_id", "text"), "item_id", "text", BLOCK_BYTES):
        if block:
            out = out.where(~_leaking(docs.sparkSession.sparkContext.broadcast(block))(F.col(text_col)))
    return out


def _leaking(shipped):
    @arrow_udf("boolean")
    def leaking(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search = _scan(shipped)
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.array(np.arange(len(batch))), batch.cast(pa.string())], names=["i", "t"])
            bad = {i for found in search(iter([rows])) for i in found.column(0).to_pylist()}
            yield pa.array([i in bad for i in range(len(batch))])

    return leaking
