import math
import random

from flowseq.llm import topk_search

DDL = "vec_id long, embedding array<double>, score string, v int"


def brute(rows, k, every):
    usable = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for n, (q, a) in enumerate(usable):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for m, (i, b) in enumerate(usable) if m != n and len(b) == len(a))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(64)], "x", 1) for i in range(400)]
    rows += [(400 + i, [round(rng.gauss(0, 1)) * 1.0 for _ in range(5)], "x", 1) for i in range(60)]  # many ties
    rows += [(500, None, "x", 1), (501, [1.0, None], "x", 1), (550, [float("nan")], "x", 1), (600, [float("inf")] * 64, "x", 1), (650, [], "x", 1), (700, [], "x", 1), (None, [1.0], "x", 1), (750, [2.0], "x", 1)]
    rows += [(0, rows[0][1], "x", 1), (7, rows[7][1], "x", 1)]
    vectors = spark.createDataFrame(rows, DDL).repartition(5)
    for block in (2048, 3):
        got = sorted(map(tuple, topk_search.top_k(vectors, k=5, query_every=50, block_queries=block).collect()))
        assert got == brute(rows, 5, 50)


def test_large_components_and_empty(spark):
    rows = [(i * 50, [1e8 * (i - 2), 3.0 * i, 1e7], "x", 1) for i in range(6)]
    got = sorted(map(tuple, topk_search.top_k(spark.createDataFrame(rows, DDL), k=3).collect()))
    top = (1 << 63) - 1
    best = {q: sorted(max(-top - 1, min(top, s)) for x, _, _, s in brute(rows, 6, 50) if x == q)[-3:] for q, *_ in rows}
    assert {q: sorted(s for x, _, _, s in got if x == q) for q, *_ in rows} == best
    assert topk_search.top_k(spark.createDataFrame([], DDL)).count() == 0


def test_bounds_never_fall_below_the_score():
    import numpy as np

    rng = np.random.default_rng(0)
    q, x = np.floor(rng.normal(0, 100, (30, 37))), np.floor(rng.normal(20, 50, (50, 37)))
    for a, b in zip(topk_search.summaries(q), topk_search.summaries(x), strict=True):
        assert (a @ b.T + 1e-3 >= q @ x.T).all()


def test_share_of_pairs_that_get_an_exact_score(spark):
    """Bounds drop most pairs of vectors that are smooth, and a part of random ones."""
    import numpy as np

    from flowseq.llm.common import table

    def share(x, queries):
        rows = np.arange(len(x))
        block = topk_search.Block(rows[queries], rows[queries], x[queries], 5)
        for at in range(0, len(x), 500):
            block.search(rows[at : at + 500], rows[at : at + 500], x[at : at + 500])
        want = [sorted((-int(x[q] @ x[i]), i) for i in rows if i != q)[:5] for q in rows[queries][:10]]
        assert [[(s, i) for s, i, _ in b] for b in block.best[:10]] == want
        assert block.bounded == len(x) * len(block.ids)
        return block.scored / block.bounded

    r = np.random.default_rng(1)
    smooth = np.floor(np.cumsum(r.normal(0, 40, (2000, 64)), 1))
    assert share(smooth, slice(0, 2000, 50)) < 0.1
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings").orderBy("vec_id").toPandas()
    x = np.floor(256 * np.array(vectors["embedding"].tolist(), float))
    for queries in (slice(0, None, 50), slice(0, None, 2)):
        part = share(x, queries)
        print(f"scored {part:.3f} of the pairs")
        assert part < 0.9


def test_rows_that_repeat_an_id_are_candidates_of_each_other(spark):
    rows = [(50, [1.0, 2.0], "x", 1), (50, [1.0, 2.5], "x", 1), (7, [0.0, 1.0], "x", 1)]
    got = sorted(map(tuple, topk_search.top_k(spark.createDataFrame(rows, DDL)).collect()))
    assert got == brute(rows, 5, 50) and [r[2] for r in got] == [50, 50, 7, 7]
