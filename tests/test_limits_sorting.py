"""L1 to L8, O1 to O11."""

import random

import pytest
from pyspark.sql import functions as F

import flowseq as fs
from flowseq.functions import TopK


def plan(flow):
    return flow.to_df()._jdf.queryExecution().executedPlan().toString()


def test_order_is_required(spark):
    bare = fs.from_df(spark.range(3))
    for op in (lambda f: f.take_first(1), lambda f: f.head(), lambda f: f.window(2), lambda f: f.unique(), lambda f: f.zip_with_index(), lambda f: f.take_while(lambda v: v > 0)):
        with pytest.raises(fs.OrderRequired):
            op(bare)


def test_take_while(spark):  # L1
    f = fs.iterate(spark, [1, 2, 5, 1, 9])
    assert f.take_while(lambda v: v < 5).to() == [1, 2]
    assert f.take_while(lambda v: v < 100).to() == [1, 2, 5, 1, 9]
    assert f.take_while(lambda v: v < 0).to() == []
    assert f.reverse().take_while(lambda v: v != 2).to() == [9, 1, 5]
    assert fs.elements(spark, 1, None, 1, schema="int").take_while(lambda v: v == 1).to() == [1]
    assert "Window" not in plan(f.take_while(lambda v: v < 5))


def test_take_while_with_mixed_directions(spark):
    rows = [(a, b) for a in range(3) for b in range(3)]
    df = spark.createDataFrame(rows, "a int, b int")
    f = fs.from_df(df, [("a", True), ("b", False)])
    assert f.take_while(lambda e: ~((e.a == 1) & (e.b == 1))).to() == [(0, 2), (0, 1), (0, 0), (1, 2)]


def test_take_first(spark):  # L2
    f = fs.range_(spark, 10)
    assert f.take_first(3).to() == [0, 1, 2] and f.take_first(0).to() == [] and f.take_first(99).count().value() == 10
    assert "TakeOrderedAndProject" in plan(f.take_first(3))
    assert f.take_first(3).reverse().to() == [2, 1, 0]  # Q12
    assert f.take_first(3).reverse(at_source=True).to() == [9, 8, 7]


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_init_tail_head_last(spark, n):  # L3 to L6
    f, values = fs.range_(spark, n), list(range(n))
    assert f.init().to() == values[:-1] and f.tail().to() == values[1:]
    assert f.reverse().init().to() == values[::-1][:-1] and f.init().reverse().to() == values[:-1][::-1]
    assert f.head().value() == (values[0] if n else None) and f.last().value() == (values[-1] if n else None)


def test_reverse(spark):  # L7, L8, Q12, Q13
    f = fs.iterate(spark, [3, 1, 2])
    assert f.reverse().to() == [2, 1, 3] and f.reverse().reverse().to() == [3, 1, 2]
    assert f.zip_with_index().reverse().to() == [(2, 2), (1, 1), (0, 3)]
    assert f.zip_with_index().reverse(at_source=True).to() == [(0, 2), (1, 1), (2, 3)]
    assert fs.iterate(spark, [1, 1, 2]).distinct().reverse().to() == [2, 1]


def test_sort(spark):  # O1 to O6
    rng = random.Random(1)
    values = [rng.randrange(20) for _ in range(60)]
    f = fs.iterate(spark, values)
    assert f.sort().to() == sorted(values)
    assert f.sort(reverse=True).to() == sorted(values, reverse=True)
    assert f.sort(lambda v: v % 5).to() == sorted(values, key=lambda v: v % 5)  # stable
    assert f.sort().reverse().to() == sorted(values)[::-1]
    assert f.sort_with(lambda a, b: (b - a).cast("int")).to() == sorted(values, reverse=True)
    assert f.sort().take_first(4).to() == sorted(values)[:4]


def test_top_k(spark):  # O7 to O11
    f = fs.iterate(spark, [4, 9, 9, 1, 7])
    assert f.top_k(3).to() == [9, 9, 7] and f.top_k(2, smallest=True).to() == [1, 4]
    assert f.top_k(2, lambda v: -v).to() == [1, 4]
    ties = fs.iterate(spark, [("a", 1), ("b", 2), ("c", 2)], "s string, n int")
    assert ties.top_k(1, lambda e: e.n).to() == [("b", 2)]
    per_key = fs.range_(spark, 10).map(lambda v: {"k": v % 2, "v": v}).groupby(lambda e: {"k": e.k}).top_k(2, lambda e: e.v)
    assert per_key.to() == [(0, 8), (0, 6), (1, 9), (1, 7)]
    assert "WindowGroupLimit" in plan(per_key)


def test_bounded_heap():  # O7 to O11 on the driver
    heap = TopK(3)
    for v in [4, 9, 1, 7, 9]:
        heap.push(v)
    assert heap.top() == 7 and list(heap.drain()) == [7, 9, 9] and heap.empty()
    small = TopK(2, by=lambda s: len(s), smallest=True)
    for s in ["aaa", "b", "cc", "d"]:
        small.append(s)
    assert sorted(small.drain()) == ["b", "d"]


def test_to_bounded_heap(spark):  # O8 as a container
    heap = fs.range_(spark, 10).to(TopK(2))
    assert list(heap.drain()) == [8, 9]


def test_fold_functions_see_columns(spark):
    assert fs.range_(spark, 4).sort(lambda v: [v % 2, -v]).to() == [2, 0, 3, 1]
    assert fs.range_(spark, 3).map(lambda v: F.lit(1)).to() == [1, 1, 1]
