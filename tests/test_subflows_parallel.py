"""B1 to B7, X1 to X6, K1 to K11, S13, D8."""

import io

import pytest
from pyspark.sql import functions as F

import flowseq as fs
from flowseq.streaming import Concat, PlaceHolder, tumbling_counts


def test_branch(spark):  # B1
    side, main = fs.range_(spark, 5).branch(lambda f: f.take_first(2).sum())
    assert side.value() == 1 and main.to() == [0, 1, 2, 3, 4]
    inner, _ = main.branch(lambda f: f.branch(lambda g: g.count())[0], share=True)
    assert inner.value() == 5


def test_if_else(spark):  # B2: null goes to the other side
    f = fs.elements(spark, 1, None, 5, schema="int")
    yes, no = f.if_else(lambda v: v > 2, lambda g: g.to(), lambda g: g.if_else(lambda v: v == 1, lambda h: h.to(), lambda h: h.to()))
    assert yes == [5] and no == ([1], [None])


def test_partition(spark):  # B3, B4
    f = fs.range_(spark, 10)
    assert f.partition(lambda g: g.count()).by(lambda v: v % 3).to() == [(0, 4), (1, 3), (2, 3)]
    assert f.partition(lambda g: None).by(lambda v: v % 3).to() == [0, 1, 2]
    assert f.partition(lambda g: g.take_first(1)).by(lambda v: v % 3).to() == [0, 1, 2]
    assert f.partition(lambda g: g.zip_with_index("i")).by(lambda v: v % 2).to() == [(i, 2 * i + k) for k in (0, 1) for i in range(5)]


@pytest.mark.parametrize("name", ["head", "last", "init", "tail", "take_while", "distinct", "unique", "window", "split", "adjacent", "reduce", "avg", "mul", "sort", "max", "vector"])
def test_every_operator_runs_per_key(spark, name):
    """A keyed flow gives for each key what the operator gives for that key alone."""
    ops = {
        "head": lambda f: f.head(), "last": lambda f: f.last(), "init": lambda f: f.init(), "tail": lambda f: f.tail(),
        "take_while": lambda f: f.take_while(lambda v: v < 7), "distinct": lambda f: f.distinct(by=lambda v: v % 4), "unique": lambda f: f.unique(lambda v: F.floor(v / 4)),
        "window": lambda f: f.window(3, 2), "split": lambda f: f.split(lambda v: v % 5 == 4), "adjacent": lambda f: f.groupby(lambda v: F.floor(v / 4)).adjacent().count("n"),
        "reduce": lambda f: f.reduce(lambda a, b: a * 10 + b), "avg": lambda f: f.avg(), "mul": lambda f: f.mul(), "sort": lambda f: f.sort(reverse=True).take_first(2),
        "max": lambda f: f.max(lambda v: v % 5), "vector": lambda f: f.to_vector(),
    }
    op, f = ops[name], fs.range_(spark, 1, 14)
    together = f.partition(op).by(lambda v: v % 3).to()
    apart = []
    for k in range(3):
        out = op(f.filter(lambda v, k=k: v % 3 == k))
        apart += [(k, *(v if isinstance(v, tuple) else (v,))) for v in out.to()] if isinstance(out, fs.Result) else out.to()
    assert together == apart


def test_link_and_views(spark):  # B5 to B7
    pipeline = fs.link(lambda f: f.map(lambda v: v + 1), lambda f: f.filter(lambda v: v > 2))
    assert fs.range_(spark, 5).transform(pipeline).named("linked").to() == [3, 4, 5]
    assert spark.sql("SELECT sum(value) FROM linked").first()[0] == 12


def test_parallel(spark):  # X1 to X5
    f = fs.range_(spark, 20)
    for strategy in (None, fs.RandomAssign(3), fs.ByKey(lambda v: v % 4)):
        for n in (1, 4, 50):
            each = f.parallel(n, lambda g: g.sum(), shuffle_by=strategy)
            assert each.count().value() == n and each.map(lambda e: e.value).sum().value() == 190
            counts = f.parallel(n, lambda g: g.count(), shuffle_by=strategy)
            assert counts.map(lambda e: e.value).sum().value() == 20 and counts.map(lambda e: e.value).filter(lambda v: v.isNull()).count().value() == 0
        assert sorted(f.parallel(4, lambda g: g.map(lambda v: v * 2), shuffle_by=strategy).to()) == list(range(0, 40, 2))
    assert f.parallel(3, lambda g: None).to() == [0, 1, 2]


def test_parallel_partition(spark):  # X6, Q14
    assert fs.range_(spark, 10).parallel_partition(4, lambda g: g.sum()).key_by(lambda v: v % 2).to() == [(0, 20), (1, 25)]


def test_sinks(spark, tmp_path):  # K1 to K11
    f = fs.iterate(spark, [2, 1, 2])
    seen = []
    f.foreach(seen.append)
    f.act()
    assert seen == f.to() == f.to([]) == [2, 1, 2] and f.to(set) == {1, 2} and f.to({9} - {9}) == {1, 2}
    assert f.zip_with_index().to(dict) == {0: 2, 1: 1, 2: 2}
    assert f.to_vector().value() == [2, 1, 2] and f.to_set().value() == [1, 2]
    assert f.zip_with_index("i").to_map("i", "value").value() == {0: 2, 1: 1, 2: 2}
    target = [0] * 5
    assert f.to_iter(target, 1, 3) == 3 and target == [0, 2, 1, 0, 0]
    assert f.to_iter([], 0, 0) == 0
    out = io.StringIO()
    f.print(to=out)
    f.println(to=out)
    fs.elements(spark, schema="int").print(to=out)
    assert out.getvalue() == "[2, 1, 2]\n2\n1\n2\n[]\n"
    assert f.text(lambda v: F.format_string("<%d>", v), "|").value() == "[<2>|<1>|<2>]"
    assert fs.elements(spark, schema="int").text().value() == "[]"
    f.write(str(tmp_path / "t"))
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 2]


def test_calendar(spark):
    import calendar as python_calendar

    from flowseq.queries.calendar import calendar

    weeks = [r for r in calendar(spark, 2023, 1).to()]
    assert len(weeks) == 12 * 8 and weeks[0].strip() == "Jan" and weeks[1] == " Su Mo Tu We Th Fr Sa"
    days = python_calendar.Calendar(6)
    for m in range(12):
        for k, week in enumerate(days.monthdayscalendar(2023, m + 1)):
            assert weeks[m * 8 + 2 + k] == "".join(f"{d:3d}" if d else "   " for d in week)
    assert len(calendar(spark, 2024, 5).to()) == 3 * 8


def test_push_mode(spark, tmp_path):  # S13, D8
    source = PlaceHolder(spark, "v int", str(tmp_path))
    run = source.start(lambda f: f.filter(lambda v: v > 1).sum())
    run.run(1, 2).run(3)
    assert run.end().value() == 5
    assert source.start(lambda f: f.count()).run(7).end().value() == 1
    left, right = PlaceHolder(spark, "v int", str(tmp_path)), PlaceHolder(spark, "v int", str(tmp_path))
    right.push(9)
    left.push(1, 2)
    assert Concat(left, right).end().to() == [1, 2, 9]


def test_streaming(spark, tmp_path):  # S13, W1
    source = PlaceHolder(spark, "v int", str(tmp_path / "in"))
    got = []
    run = source.start(lambda f: f.map(lambda v: v * 10))
    run.run(1, 2, 3)
    run.stream(lambda flow, n: got.extend(flow.to()), str(tmp_path / "c")).awaitTermination(60)
    assert sorted(got) == [10, 20, 30]
    q = tumbling_counts(source.stream(), 2, s=F.sum("v")).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.sql("SELECT k, n, s FROM w").collect())) == [(0, 2, 3), (1, 1, 3)]
    assert Concat(source, source).stream().isStreaming


def test_elements_of_a_key_are_found_before_any_are_dealt(spark):  # X6
    seen = []
    f = fs.range_(spark, 1000).parallel_partition(3, lambda g: seen.append(g) or g.take_first(2)).key_by(lambda v: v % 7)
    assert sorted(f.to()) == list(range(14)) and len(seen) == 1
    plan = f.to_df()._jdf.queryExecution().executedPlan().toString()
    assert plan.index("REPARTITION_BY_NUM") < plan.index("WindowGroupLimit")
    odd = fs.range_(spark, 20).parallel_partition(3, lambda g: g.filter(lambda v: v % 2 == 1)).key_by(lambda v: v % 3)
    assert sorted(odd.to()) == list(range(1, 20, 2)) and odd.frame.rdd.getNumPartitions() == 3


@pytest.mark.parametrize("up", [True, False])
def test_first_of_a_key_leaves_rows_out_before_it_sorts(spark, up):  # L2: nulls, ties, NaN, few rows, a null key
    rng = __import__("random").Random(4)
    values = [None, float("nan"), *(float(v) for v in range(12))]
    rows = [(rng.choice([None, 0, 1, 2, 3]), rng.choice(values), i) for i in range(400)] + [(9, 1.0, 400), (8, None, 401)]
    f = fs.from_df(spark.createDataFrame(rows, "k int, v double, i int"), [("v", up), ("i", True)])
    place = lambda v: (v is None, 0.0) if v is None else (False, 1e9 if v != v else v)
    for n in (1, 2, 30, 200):
        out = f.partition(lambda g, n=n: g.take_first(n)).by(lambda e: e.k)
        got = sorted(r["i"] for r in out.to_df().collect())
        want = []
        for k in {r[0] for r in rows}:
            mine = [r for r in rows if r[0] == k]
            first = (lambda r: (r[1] is not None, place(r[1])[1], r[2])) if up else (lambda r: (r[1] is None, -place(r[1])[1], r[2]))
            want += [r[2] for r in sorted(mine, key=first)[:n]]
        assert got == sorted(want), n
    near = f.partition(lambda g: g.like(g._near_start(2))).by(lambda e: e.k)
    assert near.to_df().count() < 150
