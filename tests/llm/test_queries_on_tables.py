"""The registered queries on whole tables against brute-force versions."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

from flowseq.llm import decontaminate, pii
from flowseq.llm.common import table
from flowseq.llm.queries import QUERIES, SEQUENCE, tokenizer
from tests.conftest import SF
from tests.llm.test_decontaminate import plain_distance
from tests.llm.test_simhash import brute_print, classes

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}


def base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_op1(spark):
    rows = QUERIES["op1_pii"](spark, SF).collect()
    source = texts(spark)
    assert sorted(r["doc_id"] for r in rows) == sorted(source)
    for r in rows:
        spans = base(source[r["doc_id"]])
        line = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(line).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in spans) for i in range(4)]
        assert set(line) <= set(r["spans"].split(",")) | {""}


def test_op2(spark):
    """Every item that stands in a text word for word is found, and what is found is there within its edits."""
    source = {i: decontaminate.fold(t) for i, t in texts(spark).items()}
    items = {r["item_id"]: decontaminate.fold(r["text"]).strip() for r in table(spark, SF, "benchmark").collect()}
    rows = QUERIES["op2_decontamination"](spark, SF).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    assert len(found) == len(rows) > 0
    assert {(d, i) for d, t in source.items() for i, b in items.items() if b in t} <= found
    plain = texts(spark)
    for r in rows[:20]:
        part = decontaminate.fold(plain[r["doc_id"]][r["start"] : r["end"]])
        item = items[r["item_id"]]
        assert part.strip() in item or plain_distance(item[: decontaminate.PATTERN], part) <= decontaminate.budget(decontaminate.PATTERN)


def test_op4(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    source = texts(spark)
    for r in QUERIES["op4_token_counts"](spark, SF).collect():
        text = source.pop(r["doc_id"])
        n = len(sp.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4096)
    assert not source


def test_op8(spark):
    source = texts(spark)
    ids = sorted(source)
    prints = [brute_print(source[i]) for i in ids]
    want = {(i, f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, classes(prints), strict=True)}
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in QUERIES["op8_simhash"](spark, SF).collect()} == want


def packed(rows, ids_of):
    """Pieces cover every document's ids once, and sequences without a gap."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = ids_of[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts, whole in [*((p, len(ids_of[d])) for d, p in by_doc.items()), *((p, None) for p in by_sequence.values())]:
        at = 0
        for begin, length in sorted(parts):
            assert begin == at
            at += length
        assert at == whole if whole else at <= SEQUENCE
    assert set(by_doc) == set(ids_of)
    return sum(map(len, ids_of.values())) / (SEQUENCE * len(by_sequence))


def test_op10(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    ids_of = {i: np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4") for i, t in texts(spark).items()}
    assert packed(QUERIES["op10_packing"](spark, SF).collect(), ids_of) > 0.9
