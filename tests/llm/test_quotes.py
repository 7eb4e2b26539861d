import duckdb

from flowseq.llm import quotes
from flowseq.llm.queries import ORACLE_SQL
from tests.helpers import same_rows

ROWS = [
    (1, 0, "user", "How do I sort a list?\n\nIt has numbers.", "x"),
    (1, 1, "assistant", "> How do I  SORT a list?\nUse sorted().", "x"),
    (1, 2, "user", ">> How do I sort a list?\n> Use sorted().\nThanks, and in reverse?", "x"),
    (1, 3, "user", "> It has numbers.\nFloats or integers?", "x"),
    (1, 4, "assistant", "> > Use sorted().\n> Thanks, and in reverse?\nPass reverse=True.", "x"),
    (1, 5, "user", "> never said\nWhat?", "x"),
    (2, 0, "user", "> Use sorted().\nother conversation", "x"),
    (2, 1, None, None, "x"),
    (2, 2, "user", "", "x"),
    (2, 3, "user", "> > >\n>", "x"),
    (3, 0, "user", "same", "x"), (3, 1, "user", "same", "x"), (3, 2, "user", "> same\nyes", "x"), (3, 2, "user", "> same\nno", "x"),
    (5, 0, "user", "line one\nline two\nline three\n\nsecond paragraph\nof two lines", "x"), (5, 1, "user", "ask\n\nme", "x"), (5, 2, "user", "> line one\n> line two\nabout two", "x"),
    (5, 3, "user", "> line one line two line three\n>\n> second  paragraph OF two lines\nabout all", "x"), (5, 4, "user", "> about two\n> ask\nlate", "x"), (5, 5, "user", "> about two\nsame again", "x"),
    (5, 6, "user", "> line three\n> never\nmore", "x"), (5, 7, "user", ">> ask\n> about all\ndeep", "x"),
    (None, 0, "user", "> same\nlost", "x"), (4, None, "user", "> same\nlost", "x"),
]
DDL = "conv_id long, turn long, role string, text string, hash string"


def test_threads(spark):
    rows = {(r["conv_id"], r["turn"]): r for r in quotes.link(spark.createDataFrame(ROWS, DDL)).collect()}
    parent = lambda c, t: rows[c, t]["parent"]
    assert [parent(1, t) for t in range(6)] == [None, 0, 1, 0, 2, None]
    assert [rows[1, t]["thread"] for t in range(6)] == [0, 0, 0, 0, 0, 5]
    assert [rows[1, t]["depth"] for t in range(6)] == [0, 1, 2, 1, 3, 0]
    assert rows[1, 4]["body"] == "Pass reverse=True." and rows[2, 3]["body"] == ""
    assert parent(2, 0) is None and parent(3, 2) == 0


def test_every_row_stays_and_sql_agrees(spark):
    import pandas as pd

    got = quotes.link(spark.createDataFrame(ROWS, DDL)).toPandas()
    assert len(got) == len(ROWS)
    whole = [r for r in ROWS if r[0] is not None and r[1] is not None]
    conversations = pd.DataFrame(whole, columns=["conv_id", "turn", "role", "text", "hash"])  # noqa: F841
    want = duckdb.connect().execute(ORACLE_SQL["op3_quotations"]).df()
    same_rows(quotes.link(spark.createDataFrame(whole, DDL)).toPandas(), want)


def test_long_chain_and_hot_message(spark):
    chain = [(1, 0, "u", "m0", "x")] + [(1, t, "u", f"> m{t - 1}\nm{t}", "x") for t in range(1, 40)]
    hot = [(2, 0, "u", "first", "x")] + [(2, t, "u", "> first\nme too", "x") for t in range(1, 300)]
    rows = quotes.link(spark.createDataFrame(chain + hot, DDL)).collect()
    assert {r["turn"]: r["depth"] for r in rows if r["conv_id"] == 1} == {t: t for t in range(40)}
    assert {(r["thread"], r["depth"]) for r in rows if r["conv_id"] == 2 and r["turn"]} == {(0, 1)}


def test_empty_table(spark):
    assert quotes.link(spark.createDataFrame([], DDL)).count() == 0


def test_parts_of_passages_and_reply_order(spark):
    linked = quotes.link(spark.createDataFrame(ROWS, DDL))
    rows = {r["turn"]: r for r in linked.where("conv_id = 5").collect()}
    assert [rows[t]["parent"] for t in range(8)] == [None, None, 0, 0, 2, 2, 0, 3]
    assert sorted(rows, key=lambda t: rows[t]["position"]) == [0, 2, 4, 5, 3, 7, 6, 1]
    whole = {r["conv_id"]: r["messages"] for r in quotes.conversations(linked).collect()}
    assert [m["body"] for m in whole[5]][1:5] == ["about two", "late", "same again", "about all"]
    assert [m["turn"] for m in whole[1]] == [0, 1, 2, 4, 3, 5]


def test_positions_of_a_long_chain_beside_branches(spark):
    chain = [(1, 0, "u", "m0", "x")] + [(1, t, "u", f"> m{t - 1 if t % 5 else t // 10}\nm{t}", "x") for t in range(1, 60)]
    rows = quotes.link(spark.createDataFrame(chain, DDL)).collect()
    path = {0: (0,)}
    for t in range(1, 60):
        path[t] = (*path[t - 1 if t % 5 else t // 10], t)
    want = sorted(path, key=path.get)
    assert [r["turn"] for r in sorted(rows, key=lambda r: r["position"])] == want
    assert {r["turn"]: r["depth"] for r in rows} == {t: len(p) - 1 for t, p in path.items()}
