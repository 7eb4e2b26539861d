"""A1 to A14, G1 to G11."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import flowseq as fs


def test_empty_flows(spark):
    none = fs.elements(spark, schema="int")
    assert none.count().value() == 0
    assert [getattr(none, m)().value() for m in ("max", "min", "sum", "mul", "avg")] == [None] * 5
    assert none.any(lambda v: v > 0).value() is False and none.all(lambda v: v > 0).value() is True
    assert none.reduce(lambda a, b: a + b).value() is None
    assert none.reduce(lambda a, b: a + b, init=4).value() == 4
    assert none.sum(init=3).value() == 3 and none.mul(init=3).value() == 3 and none.avg(init=3).value() == 3  # Q11
    assert none.aggregate(5, lambda a, v: a + v).value() == 5
    assert none.last().value() is None


def test_numbers(spark):  # A4 to A6, A9 to A12
    f = fs.iterate(spark, [3, -4, 2, -4])
    assert (f.count().value(), f.max().value(), f.min().value(), f.sum().value(), f.mul().value()) == (4, 3, -4, -3, 96)
    assert f.avg().value() == 0 and fs.iterate(spark, [-7, -4]).avg().value() == -5  # towards zero
    assert f.avg(init=11).value() == 2
    assert fs.iterate(spark, [1.0, 2.0]).avg().value() == 1.5
    assert fs.iterate(spark, [1.5, 2.0]).mul().value() == 3.0
    assert f.sum(init=10).value() == 7
    with pytest.raises(PySparkException):  # Q23: overflow is an error
        fs.iterate(spark, [2**62, 4]).mul().value()


def test_extremes_by_key_take_the_first(spark):  # A5, A6, Q22
    f = fs.iterate(spark, [("a", 1), ("b", 2), ("c", 2), ("d", 1)], "s string, n int")
    assert f.max(lambda e: e.n).value()["s"] == "b" and f.min(lambda e: e.n).value()["s"] == "a"
    assert f.reverse().max(lambda e: e.n).value()["s"] == "c"


def test_folds(spark):  # A1 to A3, A7, A8
    f = fs.iterate(spark, ["a", "b", "c"])
    assert f.reduce(lambda x, y: F.concat(x, y)).value() == "abc"
    assert f.reverse().reduce(lambda x, y: F.concat(x, y)).value() == "cba"
    assert f.aggregate("", lambda acc, v: F.concat(acc, v, F.lit("."))).value() == "a.b.c."
    assert fs.iterate(spark, [1]).reduce(lambda x, y: x * 100 + y).value() == 1
    mixed = fs.from_df(spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "a int, b int"), [("a", True), ("b", False)])
    assert mixed.map(lambda e: F.concat(e.a, e.b)).reduce(lambda x, y: F.concat_ws(",", x, y)).value() == "01,00,10"


def test_any_all(spark):  # A13, A14: null is false
    f = fs.elements(spark, 1, None, 3, schema="int")
    assert f.any(lambda v: v > 2).value() and not f.all(lambda v: v > 0).value() and f.exists(lambda v: v == 1) and not f.exists(lambda v: v > 5)


def test_groups(spark):  # G1 to G9, Q9, Q10
    f = fs.iterate(spark, [("a", 1), ("b", 2), ("a", 3), ("b", 0)], "k string, v int")
    g = f.groupby(lambda e: e.k)
    assert g.count().to(dict) == {"a": 2, "b": 2}
    assert g.valueby(lambda e: e.v).last().to(dict) == {"a": 3, "b": 0}
    assert f.reverse().groupby(lambda e: e.k).valueby(lambda e: e.v).last().to(dict) == {"a": 1, "b": 2}
    assert g.valueby(lambda e: e.v).to_vector().to(dict) == {"a": [1, 3], "b": [2, 0]}
    assert g.valueby(lambda e: e.v).to_set().to(dict) == {"a": [1, 3], "b": [0, 2]}
    assert g.valueby(lambda e: e.v).aggregate(F.lit(100), lambda acc, v: acc * 2 + v).to(dict) == {"a": 405, "b": 404}
    assert g.agg(s=lambda e: F.sum(e.v)).to(dict) == {"a": 4, "b": 2}
    assert fs.iterate(spark, [1, 2, 1]).groupby().count().to(dict) == {1: 2, 2: 1}


def test_null_and_nan_keys(spark):  # Q29: NaNs are one group
    assert fs.elements(spark, 1.0, float("nan"), float("nan"), None, schema="double").groupby().count().count().value() == 3


def test_adjacent(spark):  # G10, Q6
    f = fs.iterate(spark, [1, 1, 2, 1, 1, 1])
    runs = f.groupby().adjacent().count("n")
    assert runs.to() == [(1, 2), (2, 1), (1, 3)]
    assert runs.head().value() == (1, 2)
    assert f.groupby().adjacent().to_vector("v").to() == [(1, [1, 1]), (2, [2]), (1, [1, 1, 1])]
    assert fs.elements(spark, None, None, 1, schema="int").groupby().adjacent().count("n").to() == [(None, 2), (1, 1)]
    assert fs.elements(spark, schema="int").groupby().adjacent().count("n").to() == []


def test_equal_keys_and_names_of_directions(spark):  # K5, O8
    f = fs.iterate(spark, [(5, "a"), (9, "b"), (5, "c"), (None, "d")], "DESCENT int, v string")
    assert f.to_map("DESCENT", "v").value() == {5: "a", 9: "b"}
    top = f.groupby(lambda e: {"g": F.lit(1)}).top_k(1, lambda e: e.DESCENT).map(lambda e: e.DESCENT)
    assert top.to() == [9]
    both = f.groupby(lambda e: {"g": F.lit(1)}).top_k(2, lambda e: [(e.DESCENT, False), (e.v, False)]).map(lambda e: e.v)
    assert both.to() == ["b", "c"]


def test_associative_reduce_over_ranges(spark, monkeypatch):  # A7
    from flowseq.plans import layout

    f = fs.iterate(spark, [str(i) for i in range(60)])
    join = lambda a, b: F.concat(a, F.lit(","), b)
    want = ",".join(map(str, range(60)))
    assert f.reduce(join, associative=True).value() == f.reduce(join).value() == want
    monkeypatch.setattr(layout, "SINGLE_TASK_BYTES", -1)
    assert f.reduce(join, associative=True).value() == want
    assert fs.elements(spark, schema="string").reduce(join, associative=True).value() is None
