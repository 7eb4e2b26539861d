"""Personal data by weak supervision.

Every candidate span of a text (strict pattern matches, near misses of the
patterns, obfuscated forms) is put to five labelers that vote yes, no or
abstain: the strict pattern, the shape of the span, a gazetteer (top-level
domains, card issuers, area codes), cue words in front of the span, and what the
span is embedded in.  Votes and features over *all* documents are counted (of both
a bounded number exists, so the counts are small however large the corpus is).
Expectation-maximisation, kind by kind, estimates how reliable each labeler is
and how likely each vote pattern is real; a logistic span classifier is then
trained on those soft labels, with features of the span and its context.  A candidate that the
classifier accepts and that overlaps no other span is added to the strict ones,
which always stay.

Both passes over the texts are map-side only; whole texts are read, in linear
time.  Offsets are code points, ends exclusive.

Defined results: a null text is the empty text and has no span; repeated rows
each give a row; with no candidate at all nothing is added; an empty table gives
an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from flowseq.llm.common import bounded_batches
from flowseq.llm.toxicity import minimise

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: A candidate is added from this probability on.
ACCEPT = 0.5
#: Penalty on the classifier's squared weights.
RIDGE = 0.5

# Strict patterns.  Possessive repeats and the look-behind of the address pattern
# leave what matches unchanged and make the scan linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Looser forms, which only propose candidates.
_AT = r"(?:\s?[\[({]\s?at\s?[\])}]\s?|\s+at\s+)"
_DOT = r"(?:\s?[\[({]\s?dot\s?[\])}]\s?|\s+dot\s+|\.)"
_SPELLED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}", re.I)
_DEFANGED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9A-Za-z])")
_DIGIT = re.compile(r"[0-9]")

# Gazetteers and cue words.
_TLDS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au ch at be pl se no dk fi pt ie jp cn in br mx ru".split())
_ISSUERS = {13: "4", 14: "3", 15: "3", 16: "24569", 17: "6", 18: "6", 19: "46"}
_CUES = (
    re.compile(r"\b(?:e-?mail|mail|contact|write to|reach|correo|courriel|adresse)\b", re.I),
    re.compile(r"\b(?:ip|host|server|address|login from|client|addr)\b", re.I),
    re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|payment|pan|karte|carte|tarjeta)\b", re.I),
    re.compile(r"\b(?:phone|tel|telephone|call|fax|mobile|cell|whatsapp|handy|telefon|t[ée]l[ée]phone|m[óo]vil)\b", re.I),
)
_CUE_REACH = 40


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from each ``@`` outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            start = at
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                yield start, domain.end()
                done = domain.end()
        at = text.find("@", max(at + 1, done))


def strict_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """``(start, kind, end)`` of the strict matches, and of pattern matches that fail the check."""
    good: list[tuple[int, int, int]] = []
    failed: list[tuple[int, int, int]] = []
    if "@" in text:
        good += [(s, EMAIL, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text) if "." in text else ():
            ok = all(len(part := p.lstrip("0")) <= 3 and int(part or 0) <= 255 for p in m[0].split("."))
            (good if ok else failed).append((m.start(), IP, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19:
                ok = len(digits) >= 14 and luhn(digits)
                (good if ok else failed).append((m.start(), CARD, m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            ok = 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15
            (good if ok else failed).append((m.start(), PHONE, m.end()))
    return sorted(good), sorted(failed)


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """Obfuscated and national forms that no strict pattern describes."""
    found = []
    low = text.lower()
    if "dot" in low or "(at" in low or "[at" in low or "{at" in low:
        found += [(m.start(), EMAIL, m.end()) for m in _SPELLED.finditer(text)]
    if _DIGIT.search(text):
        if "[.]" in text:
            found += [(m.start(), IP, m.end()) for m in _DEFANGED.finditer(text)]
        found += [(m.start(), PHONE, m.end()) for m in _NATIONAL.finditer(text)]
    return found


# --- labelers: +1 yes, -1 no, 0 abstain ---------------------------------------------------


def _gazetteer(kind: int, span: str, digits: str) -> int:
    if kind == EMAIL:
        return 1 if re.split(r"[^A-Za-z0-9]+", span.lower())[-1] in _TLDS else -1
    if kind == CARD:
        return 1 if digits[:1] and digits[0] in _ISSUERS.get(len(digits), "") else -1
    if kind == PHONE:  # area codes start with 2 to 9
        area = re.search(r"\(([0-9]+)\)", span)
        return (1 if area[1][0] in "23456789" else -1) if area else 0
    return -1 if digits[:1] in ("", "0") else 1


def _shape(kind: int, span: str, digits: str) -> int:
    if kind == EMAIL:
        bracketed = bool(re.search(r"[\[({]", span))
        return 1 if "@" in span or (bracketed and not re.search(r"\s(?:at|dot)\s", span)) else (-1 if "dot" not in span.lower() else 0)
    if kind == IP:
        return 1 if span.count(".") == 3 and all(len(p) <= 3 for p in re.findall("[0-9]+", span)) else -1
    if kind == CARD:
        groups = [len(g) for g in re.split(r"[ -]", span)]
        return 1 if len(groups) == 1 and len(digits) == 16 or groups in ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4]) else (-1 if len(groups) > 6 else 0)
    return 1 if re.fullmatch(r"(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}", span) else (-1 if len(digits) < 9 else 0)


def _embedding(text: str, start: int, end: int) -> int:
    before, after = text[max(0, start - 12) : start], text[end : end + 1]
    joined = before[-1:].isalnum() or after.isalnum()
    assigned = bool(re.search(r"[=#:]\s*[\"']?\w*$", before)) and not re.search(r"(?:ip|mail|tel|phone|card)\W*$", before, re.I)
    return -1 if joined or assigned else 0


def votes(text: str, start: int, kind: int, end: int, strict: int) -> tuple[int, ...]:
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    cue = 1 if _CUES[kind].search(text, max(0, start - _CUE_REACH), start) else 0
    return strict, _shape(kind, span, digits), _gazetteer(kind, span, digits), cue, _embedding(text, start, end)


#: Number of forms of a span, and of words in front of one, that the classifier tells apart.
FORMS, CONTEXTS = 32, 64
_RUNS = ((re.compile(r"[0-9]+"), "9"), (re.compile(r"[A-Za-z]+"), "a"), (re.compile(r"\s+"), " "))
_LAST_WORD = re.compile(r"([^\W\d_]+)[\W\d_]*$")


def _form(span: str) -> int:
    """The span with runs of digits, letters and blanks as one character each, hashed."""
    for run, mark in _RUNS:
        span = run.sub(mark, span)
    return zlib.crc32(span[:40].encode()) % FORMS


def _context(text: str, start: int) -> int:
    """The last word near in front of the span, hashed; 0 if there is none."""
    word = _LAST_WORD.search(text[max(0, start - _CUE_REACH) : start])
    return 1 + zlib.crc32(word[1].lower().encode()) % (CONTEXTS - 1) if word else 0


def _code(kind: int, votes_: tuple[int, ...], text: str, start: int, end: int) -> int:
    """Kind, votes, and what the classifier sees of the span and its context, as one integer."""
    span = text[start:end]
    n = sum("0" <= c <= "9" for c in span)
    shape = 2 * (0 if n < 7 else 1 if n < 10 else 2 if n < 13 else 3) + any(c in span for c in " -([")
    out = kind
    for v in votes_:
        out = out * 3 + v + 1
    return ((out * 8 + shape) * FORMS + _form(span)) * CONTEXTS + _context(text, start)


def _decode(code: int) -> tuple[int, list[int], int, int, int]:
    """Kind, votes (0 no, 1 abstain, 2 yes), shape, form and context."""
    code, context = divmod(code, CONTEXTS)
    code, form = divmod(code, FORMS)
    code, shape = divmod(code, 8)
    vs = []
    for _ in range(5):
        code, v = divmod(code, 3)
        vs.append(v)
    return code, vs[::-1], shape, form, context


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Strict spans, and all candidates as ``(start, kind, end, pattern)``, strict ones first."""
    good, failed = strict_spans(text)
    tagged = [(x, 1) for x in good] + [(x, -1) for x in failed]
    known = set(good) | set(failed)
    tagged += [(x, 0) for x in loose_spans(text) if x not in known]
    return good, [(s, k, e, _code(k, votes(text, s, k, e, strict), text, s, e)) for (s, k, e), strict in tagged]


# --- expectation-maximisation and the span classifier -------------------------------------


@dataclass(frozen=True)
class SpanModel:
    """Acceptance probability by candidate pattern, and the labelers' estimated reliabilities."""

    probability: dict[int, float]
    reliability: dict[str, list[list[float]]]


def expectation_maximisation(vote_rows: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote row and ``P(vote | class)`` per labeler.

    ``vote_rows`` holds 0 (no), 1 (abstain), 2 (yes).  Pseudo-counts say that a
    labeler votes yes more often on real spans, which fixes the classes' names.
    """
    weight = counts / counts.sum()
    pseudo = np.array([[0.04, 0.03, 0.01], [0.01, 0.03, 0.04]])  # class 0, class 1
    score = (vote_rows - 1).sum(1)
    post = 1 / (1 + np.exp(-1.5 * score))
    one_hot = np.eye(3)[vote_rows]  # rows x labelers x votes
    theta = np.zeros((2, vote_rows.shape[1], 3))
    for _ in range(rounds):
        for y, p in ((0, 1 - post), (1, post)):
            mass = np.einsum("r,rlv->lv", weight * p, one_hot) + pseudo[y]
            theta[y] = mass / mass.sum(1, keepdims=True)
        prior = np.clip((weight * post).sum(), 0.02, 0.98)
        logs = [np.einsum("rlv,lv->r", one_hot, np.log(theta[y])) for y in (0, 1)]
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - prior) / prior), -50, 50)))
    return post, theta


def train(pattern_counts: dict[int, int]) -> SpanModel:
    """Reliabilities by kind from the votes, then one logistic classifier of spans.

    The estimate gives each vote row a soft label, and every candidate counts once.  The
    classifier sees each vote, but no combination of them, and besides what no labeler
    tells: the digits, the form of the span and the word in front of it, by kind.  So two
    spans with equal votes may be judged differently.
    """
    if not pattern_counts:
        return SpanModel({}, {})
    codes = sorted(pattern_counts)
    counts = np.array([pattern_counts[c] for c in codes], float)
    kinds, vs, shapes, forms, contexts = (np.array(x) for x in zip(*map(_decode, codes), strict=True))
    soft, reliability = np.zeros(len(codes)), {}
    for k in set(kinds.tolist()):
        at = np.flatnonzero(kinds == k)
        rows, which = np.unique(vs[at], axis=0, return_inverse=True)
        post, theta = expectation_maximisation(rows, np.bincount(which.ravel(), counts[at], len(rows)))
        soft[at] = post[which.ravel()]
        reliability[KINDS[k]] = [[float(theta[y, j, 2 * y]) for y in (0, 1)] for j in range(vs.shape[1])]
    # Features by number: votes, shape, form and context, each for itself by kind.
    sizes = [3] * vs.shape[1] + [8, FORMS, CONTEXTS]
    values = [*vs.T, shapes, forms, contexts]
    first = np.cumsum([1, *(4 * n for n in sizes)])
    features = np.stack([np.zeros(len(codes), int), *(at + kinds * n + v for at, n, v in zip(first, sizes, values, strict=False))], 1)

    def logits(w: np.ndarray) -> np.ndarray:
        return w[features].sum(1)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = logits(w)
        gap = counts * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - soft)
        grad = np.bincount(features.ravel(), np.repeat(gap, features.shape[1]), int(first[-1]))
        return float((counts * (np.logaddexp(0, z) - soft * z)).sum() + 0.5 * RIDGE * (w @ w)), grad + RIDGE * w

    w = minimise(np.zeros(int(first[-1])), loss, lambda w: loss(w)[0], steps=300)
    p = 1 / (1 + np.exp(-np.clip(logits(w), -500, 500)))
    return SpanModel(dict(zip(codes, p.tolist(), strict=True)), reliability)


def fit(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Count the vote patterns of all documents, then train on the counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(c[3] for c in candidates(text)[1])
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = bounded_batches(docs).select(F.col(text_col).alias("t")).mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return train({r["pattern"]: r["n"] for r in rows})


def find_spans(text: str, probability: dict[int, float]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Strict spans and all spans of one text, by start and kind."""
    good, cands = candidates(text)
    if len(cands) == len(good):
        return good, good
    added: list[tuple[int, int, int]] = []
    strict = set(good)
    ranked = sorted(((-probability.get(c, 0.0), s, k, e) for s, k, e, c in cands if (s, k, e) not in strict))
    # Disjoint intervals in order: the last that starts before a span's end tells whether it is free.
    starts: list[int] = []
    ends: list[int] = []
    for s, _, e in good:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for p, s, k, e in ranked:
        at = bisect_left(starts, e)
        if -p >= ACCEPT and (not at or ends[at - 1] <= s):
            added.append((s, k, e))
            starts.insert(at, s)
            ends.insert(at, e)
    return good, sorted(good + added)


_SPAN = "array<struct<kind:string,start:int,end:int>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def spans_of(text: Column, model: SpanModel, spark) -> Column:
    """A struct of the strict (``base``) and of all (``spans``) spans of a text."""
    shipped = spark.sparkContext.broadcast(model.probability)

    @arrow_udf(f"struct<base:{_SPAN},spans:{_SPAN}>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shipped.value
        as_rows = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
        for batch in batches:
            both = [find_spans(t, known) if t else ([], []) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([as_rows(b[i]) for b in both], _SPAN_ARROW) for i in (0, 1)], names=["base", "spans"]
            )

    return find(text)


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """``doc_id, base, spans`` of every row."""
    slim = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = model or fit(slim)
    found = slim.select("doc_id", spans_of(F.col("text"), model, docs.sparkSession).alias("f"))
    return found.select("doc_id", F.col("f.base").alias("base"), F.col("f.spans").alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; null texts stay null."""
    model = model or fit(bounded_batches(docs), text_col)
    shipped = docs.sparkSession.sparkContext.broadcast(model.probability)

    @arrow_udf("string")
    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shipped.value
        for batch in batches:
            yield pa.array([redact_text(t, known) if t else t for t in batch.to_pylist()], pa.string())

    return docs.withColumn(text_col, masked(F.col(text_col)))


def redact_text(text: str, probability: dict[int, float]) -> str:
    out, at = [], 0
    for s, k, e in find_spans(text, probability)[1]:
        if e > at:  # kinds may overlap: what an earlier span covers is gone already
            out.append(text[at : max(s, at)] + f"<{KINDS[k].upper()}>")
            at = e
    return "".join(out) + text[at:] if out else text


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, hash of the strict spans and list of all spans, of what :func:`detect` returns."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, KINDS),
        F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
    )
