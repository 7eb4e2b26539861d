"""D1 to D8, W1 to W5."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import flowseq as fs
from flowseq.plans import layout


def test_distinct(spark):  # D1 to D4
    values = [random.Random(3).randrange(8) for _ in range(50)]
    f = fs.iterate(spark, values)
    assert f.distinct().to() == list(dict.fromkeys(values))
    assert f.distinct(by=lambda v: v % 3).to() == list({v % 3: v for v in reversed(values)}[k] for k in dict.fromkeys(v % 3 for v in values))
    assert fs.from_df(spark.createDataFrame([(1,), (1,)], "v int")).distinct().to() == [1]
    mixed = fs.from_df(spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "a int, b int"), [("a", True), ("b", False)])
    assert mixed.distinct(by=lambda e: e.a).to() == [(0, 1), (1, 0)]


def test_unique(spark):  # D5, D6, Q31
    f = fs.iterate(spark, [1, 1, 2, 2, 1])
    assert f.unique().to() == [1, 2, 1]
    assert fs.iterate(spark, [1, 3, 2, 4, 5]).unique(lambda v: v % 2).to() == [1, 2, 5]
    assert fs.elements(spark, None, None, 2, schema="int").unique().to() == [None, 2]
    assert fs.range_(spark, 4).unique().to() == [0, 1, 2, 3]


def test_concat(spark):  # D7, Q7, Q8
    a, b = fs.iterate(spark, [3, 1]), fs.range_(spark, 2)
    assert a.concat(b).to() == [3, 1, 0, 1]
    assert a.concat(b).reverse().to() == [1, 0, 1, 3]
    assert a.sort().concat(b.take_first(1), a).to() == [1, 3, 0, 3, 1]
    assert a.concat(fs.iterate(spark, [0.5])).to() == [3.0, 1.0, 0.5]


def window_model(n, size, step):
    full = 0 if n < size else (n - size) // step + 1
    out = [list(range(k * step, k * step + size)) for k in range(full)]
    if full * step < n and (full == 0 or n > (full - 1) * step + size):
        out.append(list(range(full * step, n)))
    return out


@pytest.mark.parametrize("size,step", [(1, 1), (5, 5), (5, 1), (5, 4), (5, 6), (2, 5), (3, 2)])
def test_window(spark, size, step):  # W1 to W4, Q17
    for n in (0, 1, 4, 5, 6, 11, 20):
        assert fs.range_(spark, n).window(size, step).to() == window_model(n, size, step), n


def test_window_options(spark):  # Q24
    f = fs.range_(spark, 7)
    assert f.window(3, s=lambda v: F.sum(v)).to() == [3, 12, 6]
    assert f.reverse().window(4).to() == [[6, 5, 4, 3], [2, 1, 0]]
    assert f.window(3).map(lambda w: F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + x)).to() == [3, 12, 6]
    for bad in ((0, 1), (2, 0)):
        with pytest.raises(ValueError):
            f.window(*bad)


def test_split(spark):  # W5, Q15
    f = fs.iterate(spark, [0, 1, 2, 0, 0, 3, 0])
    assert f.split(lambda v: v == 0).to() == [[1, 2], [3]]
    assert f.split(lambda v: v == 9).to() == [[0, 1, 2, 0, 0, 3, 0]]
    assert fs.elements(spark, schema="int").split(lambda v: v == 0).to() == []
    assert f.split(lambda v: v == 0, n=lambda v: F.count(F.lit(1))).to() == [2, 1]
    assert fs.elements(spark, " a b  c ", "").split_text(" ", lambda s: s).to() == ["a", "b", "c"]


@pytest.mark.parametrize("seed", range(3))
def test_distributed_layout_equals_the_single_task(spark, seed, monkeypatch):
    """The plan for large inputs: range partitions with carried summaries."""
    rng = random.Random(seed)
    values = [rng.choice([1, 2, None]) for _ in range(rng.choice([0, 1, 40]))]
    f = fs.elements(spark, *values, schema="int")
    ops = [
        lambda f: f.zip_with_index(), lambda f: f.unique(), lambda f: f.groupby().adjacent().count("n"), lambda f: f.split(lambda v: v == 2),
        lambda f: f.window(4, 3), lambda f: f.window(5), lambda f: f.reverse().zip_with_index(),
    ]
    single = [op(f).to() for op in ops]
    monkeypatch.setattr(layout, "SINGLE_TASK_BYTES", -1)
    assert [op(f).to() for op in ops] == single
    assert single[0] == list(enumerate(values))
    assert [k for k, _ in single[2]] == [k for k, _ in itertools.groupby(values)]


@pytest.mark.parametrize("up", [True, False])
def test_what_elements_are_made_of_is_partitioned_and_not_they(spark, up, monkeypatch):
    rng = random.Random(5)
    rows = [(i if i else None, " ".join(rng.choice(["a", "a", "b", ""]) for _ in range(rng.randrange(12))) if i % 7 else None, "x") for i in range(60)]
    docs = fs.from_df(spark.createDataFrame(rows, "i int, text string, other string"), [("i", up)])
    words = lambda: docs.split_text(" ", lambda e: e.text, "w")
    ops = [
        lambda: words().zip_with_index("pos"), lambda: words().zip_with_index("pos").unique(by=lambda e: e.w), lambda: words().unique(),
        lambda: words().zip_with_index("p").filter(lambda e: e.p % 3 > 0).zip_with_index("q"), lambda: words().reverse().zip_with_index(),
        lambda: words().filter(lambda w: w == "a").zip_with_index("p").zip_with_index("q"), lambda: words().map(lambda w: F.upper(w)).unique(),
    ]
    single = [op().to() for op in ops]
    monkeypatch.setattr(layout, "SINGLE_TASK_BYTES", -1)
    settled, settle = [], layout.settle
    monkeypatch.setattr(layout, "settle", lambda df: settled.append(settle(df)) or settled[-1])
    assert ops[1]().to() == single[1]
    assert [(df.count(), "other" in df.columns) for df in settled] == [(len(rows), False)]
    assert [op().to() for op in ops] == single
