import random

import numpy as np
import pytest

from flowseq.llm import simhash
from flowseq.llm.components import connected_components
from tests.llm.data import ODD, frame

rng = random.Random(4)


def brute_print(text):
    import xxhash

    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(prints))]


def corpus():
    base = [[f"w{rng.randrange(900)}" for _ in range(rng.randint(1, 150))] for _ in range(60)]
    texts = [" ".join(w) for w in base]
    for w in base[:30]:
        for _ in range(rng.randint(1, 4)):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v).upper())
    return texts + texts[:9] + ODD


def test_components_against_brute_force(spark):
    texts = corpus()
    prints = [brute_print(t) for t in texts]
    want = classes(prints)
    rows = {r["doc_id"]: r for r in simhash.components(frame(spark, texts).repartition(3)).collect()}
    assert [rows[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [rows[i]["component_id"] for i in range(len(texts))] == want
    kept = simhash.keep_one(frame(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert kept.columns == frame(spark, ["x"]).columns


def test_no_pair_within_the_threshold_is_lost():
    r = np.random.default_rng(0)
    f = r.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 300, dtype=np.uint64)
    for _ in range(20):
        g = f.copy()
        for _ in range(4):
            g ^= np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64)
        met = np.zeros(300, bool)
        for b in range(3):
            row, anchor = simhash.replicas(g, b)
            home = simhash.homes(f, b)
            met[row[anchor == home[row]]] = True
        assert met.all()


def test_repeated_and_missing_ids(spark):
    texts = ["one two three four five"] * 4 + ["other words stand here now"] * 2 + ["only once here it is"]
    ids = [3, 3, 1, None, None, None, 9]
    assert simhash.components(frame(spark, texts, ids)).count() == 7
    kept = simhash.keep_one(frame(spark, texts, ids)).collect()
    assert sorted((str(r["doc_id"]) for r in kept)) == ["1", "9", "None"]
    assert simhash.components(frame(spark, ["x"]).limit(0)).count() == 0
    assert simhash.keep_one(frame(spark, ["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("at_once", [16, 1 << 20])
@pytest.mark.parametrize("n", [0, 1, 60])
def test_connected_components(spark, n, at_once):
    edges = [(i, i + 1) for i in range(n)] + [(1000 + i, 1000) for i in range(n)] + [(5000, 5000), (1003, 1000), (None, 4)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long"), at_once=at_once).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1000 + i: 1000 for i in range(1, n)} | {1003: 1000}
