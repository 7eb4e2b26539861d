import hashlib
import random

import pytest

from flowseq.llm import substring_dedup as s
from flowseq.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF
from tests.helpers import same_rows
from tests.llm.data import ODD, frame

rng = random.Random(11)


def words(n, kinds=500):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def brute(rows):
    """``rows``: (id, text); a null id is greater than all."""
    rank = lambda i: float("inf") if i is None else i
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, float("inf")), rank(i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < rank(i):
                gone[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    passages = [words(rng.randint(13, 80)) for _ in range(12)]
    texts = []
    for _ in range(150):
        parts = words(rng.randint(0, 60))
        for p in rng.sample(passages, rng.randint(0, 3)):
            cut = rng.randint(0, len(p) - 1)
            parts += p[cut:] + words(rng.randint(0, 20)) + p[: cut + rng.randint(0, 5)]
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    texts += texts[:10] * 3 + [" ".join(["the"] * 300)] * 3 + [" ".join(["a", "b"] * 40)] * 2 + ODD
    return texts


@pytest.mark.parametrize("kind", ["unique", "repeated"])
def test_against_brute_force(spark, kind):
    texts = corpus()
    rng.shuffle(texts)
    ids = list(range(len(texts)))
    if kind == "repeated":
        ids = [None if i % 17 == 0 else i // 3 - 20 for i in ids]
    rows = list(zip(ids, texts, strict=True))
    got = s.digest(s.dedup(frame(spark, texts, ids).repartition(3))).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_hot_passage_is_settled_inside_tasks(spark):
    passage = words(60)
    texts = [" ".join(words(5) + passage + words(5)) for _ in range(200)]
    got = s.digest(s.dedup(frame(spark, texts).repartition(2))).collect()
    assert sorted(map(tuple, got), key=str) == brute(list(enumerate(texts)))


def test_nodes_are_equal_words():
    import numpy as np

    symbols = np.array([1, 2] * 20 + [0] * 13)
    node = s.nodes(symbols, np.arange(20))
    assert len(set(node.tolist())) == 2


def test_sql(spark, duck):
    """On the whole table, and on odd texts and ids against the same plain model as above."""
    import duckdb
    import pandas as pd

    same_rows(QUERIES["op7_substring_dedup"](spark, SF).toPandas(), duck.execute(ORACLE_SQL["op7_substring_dedup"]).df())
    texts = corpus()
    rows = [(None if i % 17 == 0 else i // 3, t) for i, t in enumerate(texts)]
    documents = pd.DataFrame({"doc_id": pd.array([i for i, _ in rows], "Int64"), "text": [t for _, t in rows]})
    assert len(documents)
    got = duckdb.execute(ORACLE_SQL["op7_substring_dedup"]).fetchall()
    assert sorted(got, key=str) == brute(rows)


def test_empty_table(spark):
    assert s.dedup(frame(spark, ["x"]).limit(0)).count() == 0


def test_large_ids_beside_repeated_ones(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    texts = [passage, passage, "other words", "other words", passage, None]
    for ids in ([5, 1 << 62, 7, 7, -(1 << 63), None], [5, (1 << 63) - 1, 7, 7, None, 9]):
        rows = [(r["doc_id"], r["n_removed"]) for r in s.dedup(frame(spark, texts, ids)).collect() if r["n_words"] == 30]
        least = min(i for i, _ in rows if i is not None)
        assert {i: n for i, n in rows} == {i: 0 if i == least else 30 for i, _ in rows}
