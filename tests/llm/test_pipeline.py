"""The pipeline against a plain version of its stages."""

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from flowseq.llm import packing, pii, toxicity
from flowseq.llm.common import table
from flowseq.llm.queries import tokenizer
from tests.conftest import SF
from tests.llm.data import ODD, frame
from tests.llm.test_near_duplicates import brute_kept
from tests.llm.test_queries_on_tables import packed


def test_stages_against_a_plain_version(spark):
    docs = table(spark, SF, "documents")
    source = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    logit = lambda t: model.logit(np.unique([toxicity.bucket(w) for w in toxicity.terms(t or "")] or np.zeros(0, int)))
    ids = [i for i in sorted(source) if logit(source[i]) < 0]
    ids = [ids[k] for k in brute_kept([source[i] for i in ids])]  # similarity of 0.8 over five words
    fold = lambda t: re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]", " ", (t or "").lower())
    items = [fold(r["text"]).strip() for r in table(spark, SF, "benchmark").collect()]
    clean = [i for i in ids if not any(b in fold(source[i]) for b in items)]

    out = docs
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
        out = corpus_pipeline.settle(out)
        kept.append(sorted(r["doc_id"] for r in out.select("doc_id").collect()))
    assert kept[1] == ids
    assert kept[2] == clean
    assert kept[3] == clean
    masked = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    for i, (text, n) in masked.items():
        assert not pii.strict_spans(text or "")[0] and n == len(text)
        if not pii.candidates(source[i] or "")[1]:
            assert text == source[i]

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, SF).collect()
    packed(rows, {i: np.array(tok.encode(masked[i][0] or "", add_special_tokens=False).ids + [packing.END_ID], "<u4") for i in clean})


def run_stages(spark, docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = corpus_pipeline.settle(stage(spark, docs, sf_dir))
        assert docs.columns == columns
    return docs, stage_rows(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir))


def stage_rows(pieces):
    return pieces.collect()


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    """Stage by stage as the docstring says: texts, not ids, tell rows apart."""
    item = next(r["text"] for r in table(spark, SF, "benchmark").collect())
    alone = [f"{w} " * 3 + "words of one text that no other has" for w in ("alpha", "beta", "gamma")]
    texts = [*ODD, alone[0], alone[1], alone[2], alone[1], f"so {item} there", None, "", "write to me@example.org now and then"]
    ids = [*range(len(ODD)), 3, 3, None, 1, 70, 71, None, None]
    docs = frame(spark, texts, ids).withColumn("__toxicity", F.lit("t")).withColumn("code", F.lit("c"))
    kept, rows = run_stages(spark, docs, SF)
    left = sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect())
    plain = [i for i in brute_kept_rows(texts, ids) if texts[i] is None or item not in texts[i]]
    want = sorted((str(ids[i]), (texts[i] or "").replace("me@example.org", "<EMAIL>")) for i in plain)
    assert left == want
    assert sum(r["start"] == 0 for r in rows) == len(want)
    none, rows = run_stages(spark, docs.limit(0), SF)
    assert none.count() == 0 and rows == []


def brute_kept_rows(texts, ids):
    """Of each component the row with the smallest id, null ids last."""
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is None, ids[i] or 0))
    return [order[k] for k in brute_kept([texts[i] for i in order])]
