"""S1 to S14, P1 to P17."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

import flowseq as fs
from flowseq.functions import EmptyValue, Optional, unwrap
from flowseq.functions import unwrap_or as or_else


def test_iterate(spark):  # S3, S5, S8
    assert fs.iterate(spark, [3, 1, 2]).to() == [3, 1, 2]
    assert fs.iterate(spark, "abc").to(str) == "abc"  # Q3: characters only
    assert fs.iterate(spark, [(1, "a"), (2, "b")], "n int, s string").to() == [(1, "a"), (2, "b")]
    assert fs.elements(spark, schema="int").to() == []
    assert fs.elements(spark, 1, None, 3, schema="int").to() == [1, None, 3]


def test_optional_source(spark):  # S4
    assert fs.iterate_optional(spark, None).to() == [] and fs.iterate_optional(spark, 5).to() == [5]


def test_range(spark):  # S9, Q2, Q30
    assert fs.range_(spark, 3).to() == [0, 1, 2]
    assert fs.range_(spark, 0, 10, 3).reverse().to() == [9, 6, 3, 0]
    assert fs.range_(spark, 5, 1).to() == []
    assert fs.range_(spark, 0.0, 1.0, 0.25).to() == [0.0, 0.25, 0.5, 0.75]
    for step in (0, -1):
        with pytest.raises(ValueError):
            fs.range_(spark, 0, 5, step)


def test_generate(spark):  # S10 to S12, Q1
    g = fs.generate(spark, lambda i: i * i)
    assert g.times(4).to() == [0, 1, 4, 9]
    assert g.until(lambda v: v > 10, limit=100).to() == [0, 1, 4, 9]
    assert not hasattr(g, "map")


def test_characters(spark):  # S14
    df = spark.createDataFrame([(0, "ab"), (1, "c")], "k int, t string")
    assert fs.characters(df, "t", "k").to() == ["a", "b", "c"]


def test_array_column_and_chained_result(spark):  # S6, S7
    vector = fs.range_(spark, 4).to_vector()
    assert sorted(vector.flatten().to()) == [0, 1, 2, 3]


def test_map_filter(spark):  # P1, P2
    f = fs.range_(spark, 6)
    assert f.map(lambda v: v * 2).filter(lambda v: v > 4).to() == [6, 8, 10]
    assert fs.elements(spark, 1, None, 3, schema="int").filter(lambda v: v > 1).to() == [3]
    # The order survives a projection that drops its columns.
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, s string")
    assert fs.from_df(df, "k").map(lambda e: e.s).to() == ["a", "b"]


def test_flatmap(spark):  # P3 to P6
    f = fs.range_(spark, 3)
    assert f.flatmap(lambda v: F.sequence(F.lit(0), v)).to() == [0, 0, 1, 0, 1, 2]
    assert f.flatmap(lambda v: F.transform(F.array(v, v), lambda x: x + 1)).reverse().to() == [3, 3, 2, 2, 1, 1]
    assert fs.elements(spark, "ab", "c").flatmap_chars(lambda s: s).reverse().to(str) == "cba"  # Q4
    assert f.flatmap(lambda v: F.sequence(F.lit(0), v)).take_first(3).to() == [0, 0, 1]  # Q5
    assert fs.iterate(spark, [[1, 2], [], [3]]).flatten().to() == [1, 2, 3]


def test_zip_with_index(spark):  # P7, Q33
    assert fs.elements(spark, "a", "b").zip_with_index().to() == [(0, "a"), (1, "b")]


def test_inspect(spark):  # P8
    seen = Observation()
    f = fs.range_(spark, 5).inspect(seen, F.count(F.lit(1)).alias("n"))
    f.act()
    assert seen.get["n"] == 5


def test_unwrap(spark):  # P9 to P12
    some = fs.elements(spark, 1, None, schema="int")
    assert some.unwrap_or(9).to() == [1, 9]
    assert fs.elements(spark, 1, 2).unwrap().to() == [1, 2]
    with pytest.raises(PySparkException):
        some.unwrap().to()
    assert unwrap(3) == 3 and or_else(None, 4) == 4
    with pytest.raises(EmptyValue):
        unwrap(None)


def test_optional_columns(spark):  # P13 to P15
    f = fs.elements(spark, 1, None, 3, schema="int")
    assert f.map_optional(lambda v: v + 1).to() == [2, None, 4]
    assert f.filter_optional(lambda v: v > 1).to() == [None, None, 3]
    assert f.flatmap_optional(lambda v: F.array(v, v)).to() == [1, 1, 3, 3]


def test_optional_values():  # P13 to P17
    seen = []
    assert Optional(2).map(lambda x: x + 1).inspect(seen.append).unwrap() == 3
    assert Optional(2).map(lambda x: Optional(x)).value == 2
    assert Optional().map(lambda x: x + 1).unwrap_or(7) == 7
    assert Optional(2).filter(lambda x: x > 2).value is None
    assert Optional(2).flatmap(range) == [0, 1] and Optional().flatmap(range) == []
    Optional(4).foreach(seen.append)
    Optional().foreach(seen.append)
    assert seen == [3, 4]


def test_python_functions(spark):  # U1, U3
    assert fs.range_(spark, 3).map_py(lambda v: v * 10, "long").to() == [0, 10, 20]
    assert fs.range_(spark, 5).aggregate_py(lambda pdf: int(pdf["value"].iloc[0] * 100 + len(pdf)), "long").value() == 5


def test_until_finds_its_own_end(spark):  # S11
    assert fs.generate(spark, lambda i: i * 3).until(lambda v: v >= 300_000).count().value() == 100_000
    assert fs.generate(spark, lambda i: i).until(lambda v: v >= 0).to() == []
    assert fs.generate(spark, lambda i: i).until(lambda v: v >= 9, limit=4).to() == [0, 1, 2, 3]


def test_text_files_in_order(spark, tmp_path):  # S14
    (tmp_path / "a.txt").write_text("one two\n\nthree")
    (tmp_path / "b.txt").write_text("four  five\n")
    assert fs.read_text(spark, str(tmp_path), ordered=True).to() == ["one two", "", "three", "four  five"]
    assert fs.read_text(spark, str(tmp_path), " ", ordered=True).to() == ["one", "two", "three", "four", "five"]


def test_pipeline_for_each_element(spark):  # P5
    f = fs.elements(spark, 3, 0, 2, schema="int")
    items = lambda v: F.when(v > 0, F.sequence(F.lit(1), v))
    assert f.flatmap(items, pipeline=lambda g: g.reverse().take_first(2)).to() == [3, 2, 2, 1]
    assert f.flatmap(items, pipeline=lambda g: g.sum()).to() == [6, 3]
