import random
import zlib

import numpy as np
import pytest

from flowseq.llm import packing, token_count
from flowseq.llm.queries import tokenizer
from tests.llm.data import ODD, frame

PARTS = ["a", "The", " ", "  ", "\n", "É", "é", "①", "<|endoftext|>", "<|ENDOFTEXT|>", "<s>", "</s>", "ﬁ", "\t", "\r\n", ".", ",", "'s", "don't", "Hello", "world.", "　", "\xa0", "12", "-", "日本", "😀", "é", "́", "ΑΣ", "İ", "K", "x,", "9.", "_", "...", "▁", "\x00"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_additive_counts_equal_the_library():
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    sp, count = sentencepiece.SentencePieceProcessor(model_file=path), token_count._counter(path, {"Hello": 1})
    assert token_count._model(path)[1]
    for t in texts(5000, 1) + ["word" * 500, " " * 40]:
        assert count(t) == len(sp.encode(t)), repr(t)


def test_counts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    docs = [*ODD, *texts(100, 2)]
    rows = {r["doc_id"]: r for r in token_count.token_counts(frame(spark, docs), tokenizer("piece_bpe_32k.model"), limit=100).collect()}
    for i, t in enumerate(docs):
        n = len(sp.encode(t or ""))
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"], rows[i]["over_limit"]) == (len((t or "").encode()), n, n > 100)
    assert token_count.token_counts(frame(spark, ["x"]).limit(0), tokenizer("piece_bpe_32k.model")).count() == 0
    assert token_count.token_counts(frame(spark, ["x"] * 3, [1, 1, None]), tokenizer("piece_bpe_32k.model")).count() == 3


def test_cached_ids_equal_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    encode = packing._encoder(tokenizer("word_bpe_49k.json"))
    for t in texts(5000, 3):
        assert np.frombuffer(encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("ids", [None, "repeated"])
def test_packing_round_trip(spark, ids):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    docs = [*ODD, *texts(60, 4), "lorem ipsum dolor " * 4000]
    numbers = None if ids is None else [7] * 3 + [None] * 2 + list(range(100, 100 + len(docs) - 5))
    rows = packing.pack(frame(spark, docs, numbers), tokenizer("word_bpe_49k.json")).collect()
    want = [np.array(tok.encode(t or "", add_special_tokens=False).ids + [packing.END_ID], "<u4") for t in docs]
    assert sum(r["length"] for r in rows) == sum(map(len, want))
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    if ids is None:
        pieces = {}
        for r in rows:
            pieces.setdefault(r["doc_id"], []).append(r)
        for i, w in enumerate(want):
            at = 0
            for r in sorted(pieces[i], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(w)
                assert r["ids_crc32"] == zlib.crc32(w[at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(w)


def test_packing_of_nothing(spark):
    assert packing.pack(frame(spark, ["x"]).limit(0), tokenizer("word_bpe_49k.json")).count() == 0


def test_plan_covers_the_histogram_near_the_bound():
    rng = np.random.default_rng(1)
    for n in (1, 50, 5000):
        lengths = np.minimum(rng.lognormal(3.5, 1, n).astype(int) + 1, 256)
        histogram = {int(k): int(c) for k, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
        planned = packing.plan(histogram, 256)
        held = {}
        for times, pattern in planned:
            assert sum(k * h for k, h in pattern.items()) <= 256
            for k, h in pattern.items():
                held[k] = held.get(k, 0) + times * h
        assert held == histogram
        assert sum(t for t, _ in planned) <= 1.02 * lengths.sum() / 256 + 12
