"""The catalogue: one query per operator or example, with equivalent SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

import flowseq as fs
from flowseq.functions import Optional, TopK
from flowseq.functions import unwrap as unwrap_value
from flowseq.functions import unwrap_or as value_or
from flowseq.plans.scratch import scratch_dir
from flowseq.queries.calendar import CALENDAR_SQL, ex_calendar
from flowseq.streaming import Concat, PlaceHolder

#: Unique order of ``lineitem``.
LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str, order=None) -> fs.Flow:
    return fs.scan(spark, f"{sf_dir}/{name}.parquet", order)


def _events(spark, sf_dir):
    return _table(spark, sf_dir, "events", "event_id")


def _row(spark: SparkSession, **results) -> DataFrame:
    """Single results side by side."""
    return spark.range(1).select(*[r.to_df().scalar().alias(n) for n, r in results.items()])


def _made(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """What a sink on the driver holds, for comparison."""
    return spark.createDataFrame(rows, schema)


# --- sources -------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name FROM nation")
def iterate_scan(spark, sf_dir):
    return _table(spark, sf_dir, "nation", "n_nationkey").map(lambda e: {"n_nationkey": e.n_nationkey, "n_name": e.n_name}).to_df()


@query("SELECT * FROM (VALUES (1), (2), (3)) t(v)")
def elements_literal(spark, sf_dir):
    return fs.elements(spark, 1, 2, 3, schema="int").map(lambda v: {"v": v}).to_df()


@query("SELECT CAST(range AS BIGINT) AS id FROM range(0, 1000, 3)")
def range_step(spark, sf_dir):
    return fs.range_(spark, 0, 1000, 3).map(lambda v: {"id": v}).to_df()


@query("SELECT CAST(range * range AS BIGINT) AS v FROM range(0, 100)")
def generate_times(spark, sf_dir):
    return fs.generate(spark, lambda i: i * i).times(100).map(lambda v: {"v": v}).to_df()


@query("SELECT CAST(range * 7 AS BIGINT) AS v FROM range(0, 100) WHERE range * 7 < 500")
def generate_until(spark, sf_dir):
    return fs.generate(spark, lambda i: i * 7).until(lambda v: v >= 500).map(lambda v: {"v": v}).to_df()


@query("SELECT CAST(1 AS BIGINT) AS v")
def iterate_optional(spark, sf_dir):
    some, none = fs.iterate_optional(spark, 1), fs.iterate_optional(spark, None)
    return some.concat(none).map(lambda v: {"v": v}).to_df()


# --- element-wise --------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey * 2 AS v FROM orders")
def map_project(spark, sf_dir):
    return _table(spark, sf_dir, "orders", "o_orderkey").map(lambda e: {"o_orderkey": e.o_orderkey, "v": e.o_custkey * 2}).to_df()


@query("SELECT event_id FROM events WHERE event_type = 'click' AND value > 10")
def filter_pred(spark, sf_dir):
    return _events(spark, sf_dir).filter(lambda e: (e.event_type == "click") & (e.value > 10)).map(lambda e: {"event_id": e.event_id}).to_df()


@query("SELECT doc_id, w AS word FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> ''")
def flatmap_words(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents", "doc_id")
    return docs.split_text(" ", lambda e: e.text, "word", keep=("doc_id",)).to_df()


@query("SELECT n_nationkey, c AS ch FROM (SELECT n_nationkey, unnest(string_split(n_name, '')) AS c FROM nation) WHERE c <> ''")
def flatmap_chars(spark, sf_dir):
    return _table(spark, sf_dir, "nation", "n_nationkey").flatmap_chars(lambda e: e.n_name, "ch", keep=("n_nationkey",)).to_df()


@query("SELECT n_nationkey, CAST(unnest(range(n_regionkey)) AS BIGINT) AS i FROM nation")
def flatmap_subflow(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation", "n_nationkey")
    upto = lambda e: F.when(e.n_regionkey > 0, F.sequence(F.lit(0).cast("long"), e.n_regionkey.cast("long") - 1))
    return nation.flatmap(upto, "i", keep=("n_nationkey",)).to_df()


@query("SELECT ROW_NUMBER() OVER (ORDER BY event_id) - 1 AS idx, event_id FROM events")
def zip_with_index(spark, sf_dir):
    return _events(spark, sf_dir).map(lambda e: {"event_id": e.event_id}).zip_with_index("idx").to_df()


@query("SELECT COALESCE(CASE WHEN event_type = 'purchase' THEN user_id END, -1) AS v FROM events")
def unwrap_or(spark, sf_dir):
    bought = _events(spark, sf_dir).map(lambda e: F.when(e.event_type == "purchase", e.user_id))
    return bought.unwrap_or(-1).map(lambda v: {"v": v}).to_df()


@query("SELECT n_name AS v FROM nation")
def unwrap_present(spark, sf_dir):
    return _table(spark, sf_dir, "nation", "n_nationkey").map(lambda e: e.n_name).unwrap().map(lambda v: {"v": v}).to_df()


@query("SELECT event_id, (SELECT COUNT(*) FROM events) AS seen FROM events WHERE value > 5")
def inspect_passes(spark, sf_dir):
    """Everything passes; what was seen on the way is read after a run."""
    seen = Observation()
    flow = _events(spark, sf_dir).inspect(seen, F.count(F.lit(1)).alias("n"))
    flow.act()
    return flow.filter(lambda e: e.value > 5).map(lambda e: {"event_id": e.event_id, "seen": F.lit(seen.get["n"])}).to_df()


@query("SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def iterate_frame(spark, sf_dir):
    """An existing DataFrame as the source."""
    return fs.from_df(spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_regionkey = 1"), "n_nationkey").map(lambda e: {"n_nationkey": e.n_nationkey}).to_df()


@query("SELECT CAST(2 * n_nationkey AS BIGINT) AS v FROM nation")
def iterate_result(spark, sf_dir):
    """The items of a result: what an array sink gave is a source again."""
    keys = _table(spark, sf_dir, "nation", "n_nationkey").map(lambda e: e.n_nationkey.cast("long")).to_vector()
    return fs.iterate_column(keys).map(lambda v: {"v": v * 2}).to_df()


@query("SELECT n_regionkey, n_name FROM nation")
def flatten_arrays(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation", "n_nationkey").groupby(lambda e: {"r": e.n_regionkey}).valueby(lambda e: F.struct(e.n_regionkey, e.n_name)).to_vector("v")
    return nation.map(lambda e: e.v).flatten().map(lambda v: {"n_regionkey": v["n_regionkey"], "n_name": v["n_name"]}).to_df()


@query("SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 0.25), (2, 0.5), (3, 0.75)) t(i, v)")
def range_fraction(spark, sf_dir):
    return fs.range_(spark, 0.0, 1.0, 0.25).zip_with_index("i").map(lambda e: {"i": e.i.cast("int"), "v": e.value.cast("double")}).to_df()


@query("SELECT user_id * 2 AS v FROM events WHERE event_type = 'purchase' UNION ALL SELECT NULL FROM events WHERE event_type <> 'purchase'")
def optional_map(spark, sf_dir):
    return _events(spark, sf_dir).map(lambda e: F.when(e.event_type == "purchase", e.user_id)).map_optional(lambda v: v * 2).map(lambda v: {"v": v}).to_df()


@query("SELECT user_id + i AS v FROM events, (VALUES (0), (1)) t(i) WHERE event_type = 'purchase'")
def optional_flatmap(spark, sf_dir):
    bought = _events(spark, sf_dir).map(lambda e: F.when(e.event_type == "purchase", e.user_id))
    return bought.flatmap_optional(lambda v: F.array(v, v + 1)).map(lambda v: {"v": v}).to_df()


@query("SELECT CASE WHEN user_id % 2 = 0 THEN user_id END AS v FROM events")
def optional_filter(spark, sf_dir):
    return _events(spark, sf_dir).map(lambda e: e.user_id).filter_optional(lambda v: v % 2 == 0).map(lambda v: {"v": v}).to_df()


@query("SELECT * FROM (VALUES ('map', '6'), ('flatmap', '3,3'), ('filter', 'none'), ('unwrap', '3'), ('unwrap_or', '7'), ('seen', '3,3')) t(op, v)")
def optional_values(spark, sf_dir):
    """Optionals on the driver, as one that holds a three and one that holds nothing show them."""
    some, none, seen = Optional(3), Optional(), []
    some.foreach(seen.append)
    some.inspect(seen.append)
    none.inspect(seen.append).foreach(seen.append)
    rows = [
        ("map", str(some.map(lambda v: v * 2).unwrap())), ("flatmap", ",".join(map(str, some.flatmap(lambda v: [v, v]) + none.flatmap(lambda v: [v])))),
        ("filter", str(some.filter(lambda v: v > 3).unwrap_or("none"))), ("unwrap", str(unwrap_value(3))), ("unwrap_or", str(value_or(none.value, 7))), ("seen", ",".join(map(str, seen))),
    ]
    return _made(spark, rows, "op string, v string")


@query("SELECT event_id, length(event_type) + 1 AS n FROM events")
def map_python(spark, sf_dir):
    """A Python function of one value."""
    kinds = _events(spark, sf_dir).map(lambda e: F.concat_ws(":", e.event_id, e.event_type)).map_py(lambda s: len(s.split(":")[1]) + 1 + 1000 * int(s.split(":")[0]), "long")
    return kinds.map(lambda v: {"event_id": F.floor(v / 1000), "n": v % 1000}).to_df()


@query("SELECT n_nationkey, CAST(unnest(range(n_regionkey)) AS BIGINT) AS v FROM nation")
def flatmap_python(spark, sf_dir):
    """A Python function that gives any number of items."""
    nation = _table(spark, sf_dir, "nation", "n_nationkey").map(lambda e: {"n_nationkey": e.n_nationkey, "r": e.n_regionkey})
    return nation.map(lambda e: e.n_nationkey * 10 + e.r).flatmap_py(lambda v: [v // 10 * 10 + i for i in range(v % 10)], "long").map(lambda v: {"n_nationkey": F.floor(v / 10).cast("int"), "v": v % 10}).to_df()


@query("SELECT n_nationkey, ch, i FROM (SELECT n_nationkey, unnest(string_split(n_name, '')) AS ch, unnest(range(length(n_name))) AS i FROM nation) WHERE ch <> 'A' QUALIFY ROW_NUMBER() OVER (PARTITION BY n_nationkey ORDER BY i) <= 3")
def flatmap_pipeline(spark, sf_dir):
    """A sub-pipeline for each element's letters: numbered, without A, the first three."""
    nation = _table(spark, sf_dir, "nation", "n_nationkey")
    first = lambda f: f.zip_with_index("i").filter(lambda e: e.ch != "A").take_first(3)
    return nation.flatmap(lambda e: F.split(e.n_name, ""), "ch", keep=("n_nationkey",), pipeline=first).map(lambda e: {"n_nationkey": e.n_nationkey, "ch": e.ch, "i": e.i}).to_df()


@query("SELECT length(w) AS len, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY 1")
def text_stream(spark, sf_dir):
    """Text files as a stream of parts: the texts are written as lines first."""
    path = f"{scratch_dir(spark)}/text_stream"
    spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.translate("text", "\r\n", "\x01\x02").alias("text")).write.mode("overwrite").text(path)
    return fs.read_text(spark, path, " ", "w").groupby(lambda w: {"len": F.length(w).cast("long")}).count("n").to_df()


# --- limits --------------------------------------------------------------------------------


@query("SELECT event_id FROM events WHERE event_id < (SELECT MIN(event_id) FROM events WHERE value > 20)")
def take_while(spark, sf_dir):
    return _events(spark, sf_dir).take_while(lambda e: e.value <= 20).map(lambda e: {"event_id": e.event_id}).to_df()


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def take_first(spark, sf_dir):
    return _table(spark, sf_dir, "orders", ["o_orderdate", "o_orderkey"]).take_first(100).map(lambda e: {"o_orderkey": e.o_orderkey}).to_df()


@query("SELECT event_id FROM events WHERE event_id <> (SELECT MAX(event_id) FROM events)")
def init_drop_last(spark, sf_dir):
    return _events(spark, sf_dir).init().map(lambda e: {"event_id": e.event_id}).to_df()


@query("SELECT event_id FROM events WHERE event_id <> (SELECT MIN(event_id) FROM events)")
def tail_drop_first(spark, sf_dir):
    return _events(spark, sf_dir).tail().map(lambda e: {"event_id": e.event_id}).to_df()


@query("SELECT arg_min(event_type, event_id) AS h, arg_max(event_type, event_id) AS l FROM events")
def head_last(spark, sf_dir):
    kinds = _events(spark, sf_dir).map(lambda e: e.event_type)
    return spark.range(1).select(kinds.head().to_df().scalar().alias("h"), kinds.last().to_df().scalar().alias("l"))


@query("SELECT event_id, ROW_NUMBER() OVER (ORDER BY event_id DESC) - 1 AS idx FROM events")
def reverse_index(spark, sf_dir):
    return _events(spark, sf_dir).map(lambda e: {"event_id": e.event_id}).reverse().zip_with_index("idx").to_df()


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 5")
def reverse_at_source(spark, sf_dir):
    return _events(spark, sf_dir).take_first(5).reverse(at_source=True).map(lambda e: {"event_id": e.event_id}).to_df()


# --- sorting and top-k ---------------------------------------------------------------------


@query("SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS idx FROM customer")
def sort_desc_index(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer", "c_custkey")
    return customer.sort(lambda e: e.c_acctbal, reverse=True).map(lambda e: {"c_custkey": e.c_custkey}).zip_with_index("idx").to_df()


@query("SELECT n_name, ROW_NUMBER() OVER (ORDER BY length(n_name), n_name) - 1 AS idx FROM nation")
def sort_comparator(spark, sf_dir):
    names = _table(spark, sf_dir, "nation", "n_nationkey").map(lambda e: e.n_name)
    rank = lambda a, b: F.when(F.length(a) != F.length(b), F.length(a) - F.length(b)).when(a < b, -1).when(a > b, 1).otherwise(0)
    return names.sort_with(rank, "n_name").zip_with_index("idx").to_df()


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_global(spark, sf_dir):
    return _table(spark, sf_dir, "orders", "o_orderkey").top_k(10, lambda e: e.o_totalprice).map(lambda e: {"o_orderkey": e.o_orderkey}).to_df()


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) rn FROM customer) WHERE rn <= 3")
def topk_per_group(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer", "c_custkey")
    best = customer.groupby(lambda e: {"c_nationkey": e.c_nationkey}).top_k(3, lambda e: e.c_acctbal)
    return best.map(lambda e: {"c_nationkey": e.c_nationkey, "c_custkey": e.c_custkey}).to_df()


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def topk_smallest(spark, sf_dir):
    return _table(spark, sf_dir, "orders", "o_orderkey").top_k(10, lambda e: e.o_totalprice, smallest=True).map(lambda e: {"o_orderkey": e.o_orderkey}).to_df()


@query("SELECT event_type, event_id FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 2")
def topk_named_like_a_direction(spark, sf_dir):
    """A key column whose name holds the word for a direction."""
    named = _events(spark, sf_dir).map(lambda e: {"event_type": e.event_type, "event_id": e.event_id, "DESCENT": e.value})
    return named.groupby(lambda e: {"event_type": e.event_type}).top_k(2, lambda e: e.DESCENT).map(lambda e: {"event_type": e.event_type, "event_id": e.event_id}).to_df()


# --- aggregates ----------------------------------------------------------------------------


@query("SELECT COUNT(*) AS c, MIN(value) AS mn, MAX(value) AS mx FROM events")
def agg_count_min_max(spark, sf_dir):
    values = _events(spark, sf_dir).map(lambda e: e.value)
    return _row(spark, c=values.count(), mn=values.min(), mx=values.max())


@query("SELECT arg_min(event_id, (value, event_id)) AS value FROM events")
def agg_min_by_first(spark, sf_dir):
    return _events(spark, sf_dir).map(lambda e: {"event_id": e.event_id, "v": e.value}).min(lambda e: e.v).map(lambda e: {"value": e["event_id"]}).to_df()


@query("SELECT arg_max(event_id, (value, -event_id)) AS value FROM events")
def agg_max_by_first(spark, sf_dir):
    return _events(spark, sf_dir).map(lambda e: {"event_id": e.event_id, "v": e.value}).max(lambda e: e.v).map(lambda e: {"value": e["event_id"]}).to_df()


@query("SELECT CAST(SUM(user_id) AS BIGINT) AS s, CAST(SUM(user_id) // COUNT(*) AS BIGINT) AS a FROM events")
def agg_sum_avg_int(spark, sf_dir):
    users = _events(spark, sf_dir).map(lambda e: e.user_id)
    return spark.range(1).select(users.sum().to_df().scalar().alias("s"), users.avg().to_df().scalar().alias("a"))


@query("SELECT CAST(PRODUCT(range) AS BIGINT) AS p FROM range(1, 13)")
def agg_mul(spark, sf_dir):
    return fs.range_(spark, 1, 13).mul().map(lambda v: {"p": v}).to_df()


@query("SELECT CAST(1000 + SUM(user_id) AS BIGINT) AS r, CAST((1000 + SUM(user_id)) // COUNT(*) AS BIGINT) AS a FROM events")
def agg_sum_avg_init(spark, sf_dir):
    users = _events(spark, sf_dir).map(lambda e: e.user_id)
    return _row(spark, r=users.sum(init=1000), a=users.avg(init=1000))


@query("SELECT CAST(list_reduce(list_prepend(9, list(r_regionkey ORDER BY r_regionkey)), lambda a, x: a * 3 + x) AS BIGINT) AS r FROM region")
def agg_reduce_init(spark, sf_dir):
    keys = _table(spark, sf_dir, "region", "r_regionkey").map(lambda e: e.r_regionkey.cast("long"))
    return keys.reduce(lambda a, b: a * 3 + b, init=F.lit(9).cast("long")).map(lambda v: {"r": v}).to_df()


@query("SELECT string_agg(n_name, '>' ORDER BY n_nationkey) AS r FROM nation")
def agg_reduce_associative(spark, sf_dir):
    names = _table(spark, sf_dir, "nation", "n_nationkey").map(lambda e: e.n_name)
    return names.reduce(lambda a, b: F.concat(a, F.lit(">"), b), associative=True).map(lambda v: {"r": v}).to_df()


@query("SELECT length(string_agg(n_name, '')) AS n, string_agg(upper(n_name[1]), '' ORDER BY n_nationkey DESC) AS initials FROM nation")
def agg_aggregate_built(spark, sf_dir):
    """An accumulator of a type that follows the elements', and one that a finish turns into a result."""
    names = _table(spark, sf_dir, "nation", "n_nationkey").map(lambda e: e.n_name)
    n = names.aggregate(F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    initials = names.aggregate(F.array().cast("array<string>"), lambda a, x: F.array_prepend(a, F.upper(F.substring(x, 1, 1))), finish=lambda a: F.array_join(a, ""))
    return _row(spark, n=n, initials=initials)


@query("SELECT n_regionkey, CAST(median(n_nationkey) AS DOUBLE) AS m FROM nation GROUP BY n_regionkey")
def agg_python(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation", "n_nationkey")
    return nation.partition(lambda f: f.aggregate_py(lambda pdf: float(pdf["n_nationkey"].median()), "double")).by(lambda e: e.n_regionkey, "n_regionkey").map(lambda e: {"n_regionkey": e.n_regionkey, "m": e.value}).to_df()


@query("SELECT string_agg(r_name, '>' ORDER BY r_regionkey) AS r FROM region")
def agg_reduce_ordered(spark, sf_dir):
    names = _table(spark, sf_dir, "region", "r_regionkey").map(lambda e: e.r_name)
    return names.reduce(lambda a, b: F.concat(a, F.lit(">"), b)).map(lambda v: {"r": v}).to_df()


@query("SELECT CAST(list_reduce(list_prepend(7, list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey)), lambda a, x: (a * 31 + x) % 1000003) AS BIGINT) AS r FROM nation")
def agg_fold_ordered(spark, sf_dir):
    keys = _table(spark, sf_dir, "nation", "n_nationkey").map(lambda e: e.n_nationkey.cast("long"))
    return keys.aggregate(F.lit(7).cast("long"), lambda a, x: (a * 31 + x) % 1000003).map(lambda v: {"r": v}).to_df()


@query("SELECT COALESCE(BOOL_OR(value > 20), false) AS any_, COALESCE(BOOL_AND(value >= 0), true) AS all_ FROM events")
def any_all(spark, sf_dir):
    events = _events(spark, sf_dir)
    return spark.range(1).select(events.any(lambda e: e.value > 20).to_df().scalar().alias("any_"), events.all(lambda e: e.value >= 0).to_df().scalar().alias("all_"))


@query("SELECT COALESCE(BOOL_OR(value > 0), false) AS any_, COALESCE(BOOL_AND(value > 0), true) AS all_ FROM events WHERE false")
def any_all_empty(spark, sf_dir):
    none = _events(spark, sf_dir).filter(lambda e: F.lit(False))
    return spark.range(1).select(none.any(lambda e: e.value > 0).to_df().scalar().alias("any_"), none.all(lambda e: e.value > 0).to_df().scalar().alias("all_"))


# --- grouping ------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS c FROM lineitem GROUP BY ALL")
def group_count(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem")
    return lines.groupby(lambda e: {"l_returnflag": e.l_returnflag, "l_linestatus": e.l_linestatus}).count("c").to_df()


@query("SELECT user_id, arg_max(event_type, event_id) AS v FROM events GROUP BY user_id")
def group_last_wins(spark, sf_dir):
    return _events(spark, sf_dir).groupby(lambda e: {"user_id": e.user_id}).valueby(lambda e: e.event_type).last("v").to_df()


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def group_to_vector(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations", ["conv_id", "turn"])
    lists = turns.groupby(lambda e: {"conv_id": e.conv_id}).valueby(lambda e: e.role).to_vector("roles")
    return lists.map(lambda e: {"conv_id": e.conv_id, "roles": F.array_join(e.roles, ",")}).to_df()


@query("SELECT o_custkey, CAST(SUM(o_orderkey) AS BIGINT) AS s FROM orders GROUP BY o_custkey")
def group_fold(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders", "o_orderkey")
    return orders.groupby(lambda e: {"o_custkey": e.o_custkey}).agg(s=lambda e: F.sum(e.o_orderkey)).to_df()


@query("SELECT n_regionkey, list_reduce(list_prepend(CAST(1 AS BIGINT), list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey)), lambda a, x: (a * 7 + x) % 10007) AS h FROM nation GROUP BY n_regionkey")
def group_fold_ordered(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation", "n_nationkey")
    keyed = nation.groupby(lambda e: {"n_regionkey": e.n_regionkey}).valueby(lambda e: e.n_nationkey.cast("long"))
    return keyed.aggregate(F.lit(1).cast("long"), lambda a, x: (a * 7 + x) % 10007, "h").to_df()


_RUNS = """
    WITH a AS (SELECT *, event_type IS DISTINCT FROM LAG(event_type) OVER (ORDER BY event_id) AS chg FROM events),
    b AS (SELECT *, CAST(SUM(CAST(chg AS INT)) OVER (ORDER BY event_id) AS BIGINT) AS run FROM a)
    SELECT run, MIN(event_type) AS event_type, COUNT(*) AS c FROM b GROUP BY run
"""


@query(_RUNS)
def group_adjacent(spark, sf_dir):
    runs = _events(spark, sf_dir).groupby(lambda e: {"event_type": e.event_type}).adjacent().count("c")
    return runs.zip_with_index("run").map(lambda e: {"run": e.run + 1, "event_type": e.event_type, "c": e.c}).to_df()


# --- distinct, unique, concat --------------------------------------------------------------


@query("SELECT DISTINCT event_type, user_id FROM events")
def distinct_all(spark, sf_dir):
    return _events(spark, sf_dir).map(lambda e: {"event_type": e.event_type, "user_id": e.user_id}).distinct().to_df()


@query("SELECT user_id, MIN(event_id) AS event_id FROM events GROUP BY user_id")
def distinct_first_by(spark, sf_dir):
    return _events(spark, sf_dir).distinct(by=lambda e: e.user_id).map(lambda e: {"user_id": e.user_id, "event_id": e.event_id}).to_df()


@query("SELECT event_id FROM (SELECT event_id, event_type IS DISTINCT FROM LAG(event_type) OVER (ORDER BY event_id) AS k FROM events) WHERE k")
def unique_adjacent(spark, sf_dir):
    return _events(spark, sf_dir).unique(by=lambda e: e.event_type).map(lambda e: {"event_id": e.event_id}).to_df()


@query("SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION ALL SELECT CAST(s_nationkey AS BIGINT) FROM supplier")
def concat_union_all(spark, sf_dir):
    customers = _table(spark, sf_dir, "customer", "c_custkey").map(lambda e: {"k": e.c_nationkey.cast("long")})
    return customers.concat(_table(spark, sf_dir, "supplier", "s_suppkey").map(lambda e: {"k": e.s_nationkey.cast("long")})).to_df()


@query("SELECT ROW_NUMBER() OVER (ORDER BY arm, k) - 1 AS idx, name FROM (SELECT 0 AS arm, r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT 1, -n_nationkey, n_name FROM nation)")
def concat_ordered(spark, sf_dir):
    regions = _table(spark, sf_dir, "region", "r_regionkey").map(lambda e: {"name": e.r_name})
    nations = _table(spark, sf_dir, "nation", "n_nationkey").map(lambda e: {"name": e.n_name}).reverse()
    return regions.concat(nations).zip_with_index("idx").to_df()


@query("SELECT user_id % 3 AS k, MIN(event_id) AS event_id FROM events GROUP BY user_id % 3, user_id % 5")
def distinct_inserter(spark, sf_dir):
    """A Python function decides what is new, among the elements of a key."""

    def insert(known: set, element: tuple) -> bool:
        return not (element[1] % 5 in known or known.add(element[1] % 5))

    slim = _events(spark, sf_dir).map(lambda e: {"event_id": e.event_id, "user_id": e.user_id})
    return slim.distinct(by=lambda e: e.user_id % 3, insert=insert).map(lambda e: {"k": e.user_id % 3, "event_id": e.event_id}).to_df()


_WORD_RUNS = """
    WITH w AS (SELECT doc_id, i, w FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM documents) WHERE w <> ''),
    n AS (SELECT doc_id, w, ROW_NUMBER() OVER (ORDER BY doc_id, i) - 1 AS pos, lag(w) OVER (ORDER BY doc_id, i) IS DISTINCT FROM w AS fresh FROM w)
    SELECT pos // 1000 AS k, COUNT(*) AS n, CAST(SUM(CAST(fresh AS INT)) AS BIGINT) AS runs FROM n GROUP BY 1
"""


@query(_WORD_RUNS)
def range_layout_words(spark, sf_dir):
    """All words in order, numbered, in windows of a thousand, with the runs that begin in each: range partitions and carried summaries."""
    words = _table(spark, sf_dir, "documents", "doc_id").split_text(" ", lambda e: e.text, "w").zip_with_index("pos")
    firsts = words.unique(by=lambda e: e.w).groupby(lambda e: {"k": F.floor(e.pos / 1000)}).count("runs")
    sizes = words.groupby(lambda e: {"k": F.floor(e.pos / 1000)}).count("n")
    return sizes.to_df().join(firsts.to_df(), "k", "left").select("k", "n", F.coalesce("runs", F.lit(0)).alias("runs"))


# --- windows and splitting -----------------------------------------------------------------


@query("SELECT event_id // 7 AS k, COUNT(*) AS n, CAST(SUM(user_id) AS BIGINT) AS s FROM events GROUP BY 1")
def window_tumbling(spark, sf_dir):
    sums = _events(spark, sf_dir).window(7, n=lambda e: F.count(F.lit(1)), s=lambda e: F.sum(e.user_id))
    return sums.zip_with_index("k").to_df()


_SLIDING = """
    WITH p AS (SELECT ROW_NUMBER() OVER (ORDER BY event_id) - 1 AS pos, user_id FROM events), n AS (SELECT COUNT(*) AS n FROM p),
    f AS (SELECT n, CASE WHEN n < 5 THEN 0 ELSE (n - 5) // 4 + 1 END AS f FROM n), k AS (SELECT f, n, unnest(range(f + 1)) AS k FROM f)
    SELECT CAST(k AS BIGINT) AS k, COUNT(*) AS n, CAST(SUM(user_id) AS BIGINT) AS s
    FROM k JOIN p ON pos >= k * 4 AND pos < k * 4 + 5 WHERE k < f OR f = 0 OR n > (f - 1) * 4 + 5 GROUP BY k
"""


@query(_SLIDING)
def window_sliding_5_4(spark, sf_dir):
    sums = _events(spark, sf_dir).window(5, 4, n=lambda e: F.count(F.lit(1)), s=lambda e: F.sum(e.user_id))
    return sums.zip_with_index("k").to_df()


@query("SELECT event_id // 6 AS k, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS w FROM events WHERE event_id % 6 < 5 GROUP BY 1")
def window_hopping_5_6(spark, sf_dir):
    wins = _events(spark, sf_dir).map(lambda e: e.event_id).window(5, 6)
    return wins.map(lambda w: {"w": F.array_join(F.transform(w, lambda x: x.cast("string")), ",")}).zip_with_index("k").to_df()


@query("""
    WITH a AS (SELECT *, CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS BIGINT) AS g FROM events),
    b AS (SELECT g, COUNT(*) AS c, MIN(event_id) AS first_id FROM a WHERE event_type <> 'error' GROUP BY g)
    SELECT ROW_NUMBER() OVER (ORDER BY g) - 1 AS g, c, first_id FROM b
""")
def split_runs(spark, sf_dir):
    runs = _events(spark, sf_dir).split(lambda e: e.event_type == "error", c=lambda e: F.count(F.lit(1)), first_id=lambda e: F.min(e.event_id))
    return runs.zip_with_index("g").to_df()


# --- sub-pipelines -------------------------------------------------------------------------


@query("SELECT 'side' AS arm, COUNT(*) AS c FROM events UNION ALL SELECT 'main', COUNT(DISTINCT user_id) FROM events")
def branch_tee(spark, sf_dir):
    side, main = _events(spark, sf_dir).branch(lambda f: f.count())
    users = main.map(lambda e: e.user_id).distinct().count()
    arm = lambda f, name: f.map(lambda v: {"arm": F.lit(name), "c": v})
    return arm(side, "side").concat(arm(users, "main")).to_df()


@query("SELECT CASE WHEN value > 10 THEN 'if' ELSE 'else' END AS arm, COUNT(*) AS c FROM events GROUP BY 1")
def if_else_route(spark, sf_dir):
    yes, no = _events(spark, sf_dir).if_else(lambda e: e.value > 10, lambda f: f.count(), lambda f: f.count())
    arm = lambda f, name: f.map(lambda v: {"arm": F.lit(name), "c": v})
    return arm(yes, "if").concat(arm(no, "else")).to_df()


@query("SELECT user_id, COUNT(*) AS c, MAX(value) AS mx FROM events GROUP BY user_id")
def partition_result(spark, sf_dir):
    return _events(spark, sf_dir).partition(lambda f: f.agg(c=F.count(F.lit(1)), mx=F.max("value"))).by(lambda e: e.user_id, "user_id").to_df()


@query("SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM events")
def partition_pipe_index(spark, sf_dir):
    slim = _events(spark, sf_dir).map(lambda e: {"user_id": e.user_id, "event_id": e.event_id})
    return slim.partition(lambda f: f.zip_with_index("idx")).by(lambda e: e.user_id).to_df()


@query("SELECT DISTINCT event_type FROM events")
def partition_void_keys(spark, sf_dir):
    return _events(spark, sf_dir).partition(lambda f: None).by(lambda e: e.event_type, "event_type").to_df()


@query("SELECT user_id, event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) rn FROM events) WHERE rn <= 2")
def partition_limit(spark, sf_dir):
    slim = _events(spark, sf_dir).map(lambda e: {"user_id": e.user_id, "event_id": e.event_id})
    return slim.partition(lambda f: f.take_first(2)).by(lambda e: e.user_id).to_df()


@query("SELECT CAST((range + 1) * 2 AS BIGINT) AS v FROM range(0, 10)")
def link_compose(spark, sf_dir):
    pipeline = fs.link(lambda f: f.map(lambda v: v + 1), lambda f: f.map(lambda v: v * 2))
    return fs.range_(spark, 10).transform(pipeline).map(lambda v: {"v": v}).to_df()


@query("SELECT n_regionkey, ROW_NUMBER() OVER (ORDER BY n_regionkey DESC) - 1 AS i, COUNT(*) AS c FROM nation GROUP BY n_regionkey")
def partition_ordered(spark, sf_dir):
    """Keys in an order of choice, here descending."""
    counts = _table(spark, sf_dir, "nation", "n_nationkey").partition(lambda f: f.agg(c=F.count(F.lit(1)))).by(lambda e: e.n_regionkey, "n_regionkey", reverse=True)
    return counts.zip_with_index("i").to_df()


@query("SELECT event_type, COUNT(*) AS c FROM events WHERE value > 10 GROUP BY event_type")
def named_traversal(spark, sf_dir):
    """A flow under a name, run over by SQL."""
    _events(spark, sf_dir).filter(lambda e: e.value > 10).named("flow_events")
    return spark.sql("SELECT event_type, COUNT(*) AS c FROM flow_events GROUP BY event_type")


@query("SELECT CAST(SUM(v) AS BIGINT) AS s, CAST(2 AS BIGINT) AS runs FROM (SELECT range AS v FROM range(2, 20)) WHERE v % 2 = 0")
def push_mode(spark, sf_dir):
    """Elements pushed to a place holder; a later run has only its own."""
    source = PlaceHolder(spark, "v long", scratch_dir(spark))
    source.start(lambda f: f.count()).run(1, 2, 3).end().value()
    total = source.start(lambda f: f.filter(lambda v: v % 2 == 0).sum()).run(*range(2, 10)).run(*range(10, 20)).end()
    return total.map(lambda v: {"s": v, "runs": F.lit(2).cast("long")}).to_df()


@query("SELECT * FROM (VALUES (0, 1), (1, 2), (2, 9)) t(i, v)")
def push_left_right(spark, sf_dir):
    """Two inputs pushed to separately, the left one's elements first."""
    left, right = PlaceHolder(spark, "v int", scratch_dir(spark)), PlaceHolder(spark, "v int", scratch_dir(spark))
    right.push(9)
    left.push(1, 2)
    return Concat(left, right).end(lambda f: f.zip_with_index("i")).map(lambda e: {"i": e.i.cast("int"), "v": e.v}).to_df()


# --- parallel ------------------------------------------------------------------------------


@query("SELECT CAST(SUM(l_partkey * 2) AS BIGINT) AS s FROM lineitem")
def parallel_sum(spark, sf_dir):
    parts = _table(spark, sf_dir, "lineitem").map(lambda e: e.l_partkey * 2)
    return parts.parallel(4, lambda f: f.sum()).map(lambda e: e.value).sum().map(lambda v: {"s": v}).to_df()


@query("SELECT CAST(SUM(l_partkey) AS BIGINT) AS s, COUNT(*) AS n FROM lineitem")
def parallel_by_key(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").map(lambda e: {"p": e.l_partkey, "s": e.l_suppkey})
    each = lines.parallel(4, lambda f: f.agg(s=F.sum("p"), n=F.count(F.lit(1))), shuffle_by=fs.ByKey(lambda e: e.s))
    return each.agg(s=F.sum("s"), n=F.sum("n")).to_df()


@query("SELECT l_suppkey % 8 AS k, CAST(SUM(l_partkey) AS BIGINT) AS s FROM lineitem GROUP BY 1")
def parallel_partition_sum(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem")
    return lines.parallel_partition(4, lambda f: f.agg(s=F.sum("l_partkey"))).key_by(lambda e: e.l_suppkey % 8, "k").to_df()


@query("SELECT l_linenumber AS n, COUNT(*) AS c FROM lineitem WHERE l_quantity > 10 GROUP BY 1")
def parallel_pipe(spark, sf_dir):
    """Workers that pass elements on, dealt at random."""
    lines = _table(spark, sf_dir, "lineitem").map(lambda e: {"n": e.l_linenumber, "q": e.l_quantity})
    out = lines.parallel(4, lambda f: f.filter(lambda e: e.q > 10), shuffle_by=fs.RandomAssign(7))
    return out.groupby(lambda e: {"n": e.n}).count("c").to_df()


@query("SELECT CAST(range AS INT) AS pid FROM range(5)")
def parallel_void(spark, sf_dir):
    """Workers without a result: their numbers."""
    return _table(spark, sf_dir, "nation").parallel(5, lambda f: None, name="pid").to_df()


@query("SELECT range AS pid, CAST(0 AS BIGINT) AS value FROM range(3)")
def parallel_idle(spark, sf_dir):
    """Workers that get no elements have the result of an empty input."""
    none = _table(spark, sf_dir, "nation").filter(lambda e: F.lit(False))
    return none.parallel(3, lambda f: f.count()).map(lambda e: {"pid": e.pid.cast("long"), "value": e.value}).to_df()


@query("SELECT l_suppkey % 8 AS k, l_orderkey, l_linenumber FROM lineitem QUALIFY ROW_NUMBER() OVER (PARTITION BY l_suppkey % 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) <= 2")
def parallel_partition_pipe(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem", LINEITEM_ORDER)
    out = lines.parallel_partition(3, lambda f: f.take_first(2)).key_by(lambda e: e.l_suppkey % 8)
    return out.map(lambda e: {"k": e.l_suppkey % 8, "l_orderkey": e.l_orderkey, "l_linenumber": e.l_linenumber}).to_df()


# --- sinks ---------------------------------------------------------------------------------


@query("SELECT COUNT(DISTINCT p_brand) AS c FROM part")
def to_set_size(spark, sf_dir):
    return _table(spark, sf_dir, "part", "p_partkey").map(lambda e: e.p_brand).to_set().map(lambda v: {"c": F.size(v).cast("long")}).to_df()


@query("SELECT ROW_NUMBER() OVER (ORDER BY n_nationkey) + 1 AS place, n_name, 12 AS upto FROM nation QUALIFY place < 12")
def to_iter_bounded(spark, sf_dir):
    """Written over positions 2 to 11 of a list of 12; the position after the last one written."""
    target = [None] * 12
    upto = _table(spark, sf_dir, "nation", "n_nationkey").map(lambda e: e.n_name).to_iter(target, 2)
    return _made(spark, [(i, v, upto) for i, v in enumerate(target) if v is not None], "place long, n_name string, upto int")


@query("SELECT list(n_name ORDER BY n_nationkey)[3] AS third, count(*) AS n FROM nation")
def to_vector_item(spark, sf_dir):
    names = _table(spark, sf_dir, "nation", "n_nationkey").map(lambda e: e.n_name)
    return names.to_vector("v").map(lambda v: {"third": v[2], "n": F.size(v).cast("long")}).to_df()


@query("SELECT n_regionkey AS k, arg_min(n_name, n_nationkey) AS v FROM nation GROUP BY n_regionkey")
def to_map_first(spark, sf_dir):
    """Of equal keys the first stays."""
    nation = _table(spark, sf_dir, "nation", "n_nationkey").map(lambda e: {"k": e.n_regionkey, "v": e.n_name})
    return nation.to_map("k", "v", "m").to_df().select(F.explode("m").alias("k", "v"))


@query("SELECT n_regionkey AS k, string_agg(n_name, ',' ORDER BY n_name) AS v FROM nation GROUP BY n_regionkey")
def group_to_set(spark, sf_dir):
    sets = _table(spark, sf_dir, "nation").groupby(lambda e: {"k": e.n_regionkey}).valueby(lambda e: e.n_name).to_set("v")
    return sets.map(lambda e: {"k": e.k, "v": F.array_join(e.v, ",")}).to_df()


@query("SELECT r_name AS name, ROW_NUMBER() OVER (ORDER BY r_regionkey) - 1 AS i FROM region")
def to_containers(spark, sf_dir):
    """A new list, a list given, a heap given, and what a function on the driver sees: all the same elements in order."""
    names = _table(spark, sf_dir, "region", "r_regionkey").map(lambda e: e.r_name)
    names.act()
    seen: list[str] = []
    names.foreach(seen.append)
    given: list[str] = names.to([])
    heap = names.to(TopK(100, smallest=True))
    if not seen == given == names.to(list) or sorted(heap.drain()) != sorted(seen):
        raise AssertionError("sinks differ")
    return _made(spark, list(zip(seen, range(len(seen)), strict=True)), "name string, i long")


@query("SELECT p_partkey, ROW_NUMBER() OVER (ORDER BY p_retailprice, p_partkey DESC) - 1 AS i FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5)")
def topk_drain(spark, sf_dir):
    """The heap gives up the least of the best first."""
    best = _table(spark, sf_dir, "part", "p_partkey").top_k(5, lambda e: e.p_retailprice).map(lambda e: F.struct(e.p_partkey, e.p_retailprice))
    heap = best.to(TopK(5, by=lambda r: r["p_retailprice"]))
    return _made(spark, [(r["p_partkey"], i) for i, r in enumerate(heap.drain())], "p_partkey long, i long")


@query("SELECT string_agg(r_name, chr(10) ORDER BY r_regionkey) || chr(10) AS text FROM region")
def println_lines(spark, sf_dir):
    import io

    out = io.StringIO()
    _table(spark, sf_dir, "region", "r_regionkey").map(lambda e: e.r_name).println(out)
    return _made(spark, [(out.getvalue(),)], "text string")


@query("SELECT '<' || string_agg(lower(r_name), '|' ORDER BY r_regionkey) || '>' AS line FROM region")
def print_with_format(spark, sf_dir):
    return _table(spark, sf_dir, "region", "r_regionkey").map(lambda e: e.r_name).text(F.lower, "|", "<", ">").to_df()


@query("SELECT '[' || string_agg(r_name, ', ' ORDER BY r_regionkey) || ']' AS line FROM region")
def print_format(spark, sf_dir):
    return _table(spark, sf_dir, "region", "r_regionkey").map(lambda e: e.r_name).text().to_df()


# --- examples ------------------------------------------------------------------------------


@query("""
    WITH w AS (SELECT lower(t) AS w FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) AS t FROM documents) WHERE t <> ''),
    c AS (SELECT w, COUNT(*) AS c FROM w GROUP BY w)
    SELECT CAST(length(w) AS INT) AS len, w AS word, c AS cnt
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY length(w) ORDER BY c DESC, w) rn FROM c) WHERE rn <= 5
""")
def ex_topk_freq_words(spark, sf_dir):
    """The five most frequent words of each length."""
    words = _table(spark, sf_dir, "documents").split_text("[^A-Za-z0-9_]+", lambda e: e.text, "word").map(lambda w: {"word": F.lower(w)})
    counts = words.groupby(lambda w: {"word": w}).count("cnt")
    best = counts.groupby(lambda e: {"len": F.length(e.word)}).top_k(5, lambda e: [(e.cnt, False), (e.word, True)])
    return best.map(lambda e: {"len": e.len, "word": e.word, "cnt": e.cnt}).to_df()


@query("SELECT DISTINCT p_size FROM part")
def ex_sort_unique(spark, sf_dir):
    return _table(spark, sf_dir, "part", "p_partkey").map(lambda e: {"p_size": e.p_size}).sort().unique().to_df()


@query("SELECT MAX(value) AS mx FROM (SELECT value FROM events ORDER BY event_id LIMIT 3)")
def ex_first_n_max(spark, sf_dir):
    return _events(spark, sf_dir).map(lambda e: e.value).take_first(3).max().map(lambda v: {"mx": v}).to_df()


@query("SELECT * FROM (VALUES (0, 'H'), (1, 'E'), (2, 'L'), (3, 'L'), (4, 'O'), (5, 'W'), (6, 'O'), (7, 'R'), (8, 'L'), (9, 'D')) t(idx, ch)")
def ex_hello_world(spark, sf_dir):
    """Two lists without their decoys, every other word, letter by letter in capitals."""
    left = fs.elements(spark, "decoy", "skipped", "hello").tail()
    right = fs.elements(spark, "skipped", "world", "decoy").init()
    odd = left.concat(right).zip_with_index("i").filter(lambda e: e.i % 2 == 1).map(lambda e: e.value)
    letters = odd.flatmap_chars(lambda w: w).map(lambda c: {"ch": F.upper(c)}).zip_with_index("idx")
    return letters.map(lambda e: {"idx": e.idx.cast("int"), "ch": e.ch}).to_df()


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ROW_NUMBER() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS idx FROM lineitem")
def ex_terasort(spark, sf_dir):
    """All lines in total order, numbered."""
    lines = _table(spark, sf_dir, "lineitem", LINEITEM_ORDER)
    slim = lines.map(lambda e: {n: e[n] for n in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")})
    return slim.zip_with_index("idx").to_df()


query(CALENDAR_SQL)(ex_calendar)
