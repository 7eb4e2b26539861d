"""Quotation linking: reply-ordered conversations without quotes.

A line that starts with ``>`` marks (blanks allowed between) is quoted, at the
level of its number of marks; consecutive lines of one level are a passage.
Passages are folded (ASCII lower case, blanks and breaks collapsed) and hashed,
and so are the own words of every message: the whole, its paragraphs and lines.
A passage links to the first earlier message of its conversation with an equal
hash; a passage that as a whole equals nothing links by its paragraphs, and one
without such by its lines.  A message answers the original of its outermost linked
passage (of several at that level, of one that links as a whole rather than by parts,
then of the longest); following these links by pointer doubling gives each message
the message that its thread began with and its depth below it.

``position`` puts a conversation in reply order: threads by the turn they begin with,
in each thread every message behind the one it answers and in front of the later
answers to that one.  It is the rank in a tour around the reply tree, found by pointer
doubling over the tour's steps.

All of it is joins and aggregations on (conversation, hash) or (conversation,
turn): originals are reduced to one per hash before they are joined, so a passage
that very many messages share meets one row, and no conversation is gathered in
one place (but by :func:`conversations`, whose result is one row for each).

Defined results: a null text is empty; null conversation ids or turns link to
nothing (rows without a turn stand first, as one thread); rows that repeat a turn each
give a row, and share their links and their position; a quote of nothing known stays
unlinked; texts of any length are read whole; an empty table gives an empty result;
other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowseq.llm.common import settle
from flowseq.order import OrderSpec
from flowseq.plans.layout import Layout

_PREFIX = r"^[ \t]*(>[ \t]*)+"
_BLANK = r"\n[ \t\r]*\n"
_HAS_QUOTE = r"(^|\n)[ \t]*>"


def fold(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, r"[ \t\r\n]+", " "))


def own_words(text: Column) -> Column:
    """A text without its quoted lines."""
    kept = F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike(r"^[ \t]*>"))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def passages(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, m, run, level, kind, hash, size``: the quoted passages of each message, whole and in parts."""
    quoted = messages.where(F.col("text").rlike(_HAS_QUOTE)).select("conv_id", "turn", "text").distinct()
    lines = quoted.select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("m"), F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    prefix = F.regexp_extract("line", _PREFIX, 0)
    lines = lines.select("conv_id", "turn", "m", "i", F.length(F.regexp_replace(prefix, "[^>]", "")).alias("level"), F.expr(f"substr(line, length(regexp_extract(line, r'{_PREFIX}', 0)) + 1)").alias("body"))
    # A window holds the lines of one message.
    order = Window.partitionBy("conv_id", "turn", "m").orderBy("i")
    turned = F.when(F.col("level") == F.lag("level").over(order), 0).otherwise(1)
    runs = lines.withColumn("turned", turned).withColumn("run", F.sum("turned").over(order))
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "body"))), lambda x: x["body"]), "\n")
    found = runs.where(F.col("level") > 0).groupBy("conv_id", "turn", "m", "run", "level").agg(raw.alias("raw"))
    # Kind 0 is the whole passage, 1 its paragraphs, 2 its lines.
    parts = F.flatten(F.array(*[F.transform(p, lambda x, k=k: F.struct(F.lit(k).alias("kind"), fold(x).alias("words"))) for k, p in enumerate((F.array("raw"), F.split("raw", _BLANK, -1), F.split("raw", "\n", -1)))]))
    each = found.select("conv_id", "turn", "m", "run", "level", F.explode(F.array_distinct(parts)).alias("p")).select("conv_id", "turn", "m", "run", "level", "p.kind", "p.words")
    return each.where(F.col("words") != "").select("conv_id", "turn", "m", "run", "level", "kind", F.md5(F.col("words").cast("binary")).alias("hash"), F.length("words").alias("size"))


def originals(messages: DataFrame) -> DataFrame:
    """``conv_id, hash, original``: the first message of a conversation with these own words."""
    own = own_words(F.col("text"))
    units = F.array_union(F.array(own), F.array_union(F.split(own, _BLANK, -1), F.split(own, "\n", -1)))
    known = messages.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(units, fold))).alias("words")).where(F.col("words") != "")
    return known.groupBy("conv_id", F.md5(F.col("words").cast("binary")).alias("hash")).agg(F.min("turn").alias("original"))


def replies(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, parent, n_linked``: what each quoting message answers."""
    linked = passages(messages).join(originals(messages), ["conv_id", "hash"]).where(F.col("original") < F.col("turn"))
    order = lambda *more: F.struct(*more, -F.col("kind"), F.col("size"), -F.col("original"))
    best = linked.groupBy("conv_id", "turn", "m", "run", "level").agg(F.max_by(F.struct("kind", "size", "original"), order()).alias("b"))
    best = best.select("conv_id", "turn", "level", "b.*")
    return best.groupBy("conv_id", "turn").agg(F.max_by("original", order(-F.col("level"))).alias("parent"), F.count(F.lit(1)).alias("n_linked"))


def threads(answers: DataFrame) -> DataFrame:
    """``conv_id, turn, parent, n_linked, thread, depth`` by pointer doubling over the replies."""
    now = settle(answers.select("conv_id", "turn", "parent", "n_linked", F.col("parent").alias("thread"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"), F.col("depth").alias("more"))
        if now.join(up, ["conv_id", "thread"], "left_semi").isEmpty():
            return now
        now = settle(
            now.join(up, ["conv_id", "thread"], "left").select(
                "conv_id", "turn", "parent", "n_linked", F.coalesce("above", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
            )
        )


def tour(answers: DataFrame) -> DataFrame:
    """``conv_id, turn, later``: for messages of threads with answers, how many of the thread stand at or behind them in reply order.

    The tour enters a message, then tours its answers by turn, and leaves it.  Each step
    knows the next one; the number of messages entered from a step on adds up along the
    steps by pointer doubling.
    """
    child = Window.partitionBy("conv_id", "parent").orderBy("turn")
    known = answers.select("conv_id", "turn", "parent").withColumn("sibling", F.lead("turn").over(child))
    roots = answers.select("conv_id", F.col("thread").alias("turn")).distinct().select("*", *[F.lit(None).cast("long").alias(c) for c in ("parent", "sibling")])
    first = answers.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("first"))
    nodes = known.unionByName(roots).join(first, ["conv_id", "turn"], "left")
    place = lambda c, side: F.struct(F.col(c).alias("turn"), F.lit(side).alias("side"))
    enter = nodes.select("conv_id", place("turn", 0).alias("at"), F.when(F.col("first").isNotNull(), place("first", 0)).otherwise(place("turn", 1)).alias("next"), F.lit(1).cast("long").alias("later"))
    leave = F.when(F.col("sibling").isNotNull(), place("sibling", 0)).when(F.col("parent").isNotNull(), place("parent", 1))
    now = settle(enter.unionByName(nodes.select("conv_id", place("turn", 1).alias("at"), leave.alias("next"), F.lit(0).cast("long").alias("later"))))
    while not now.where(F.col("next").isNotNull()).isEmpty():
        on = now.select("conv_id", F.col("at").alias("next"), F.col("next").alias("beyond"), F.col("later").alias("more"))
        now = settle(now.join(on, ["conv_id", "next"], "left").select("conv_id", "at", F.col("beyond").alias("next"), (F.col("later") + F.coalesce("more", F.lit(0))).alias("later")))
    return now.where(F.col("at.side") == 0).select("conv_id", F.col("at.turn").alias("turn"), "later")


def link(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, thread, depth, turn, position, parent, role, body, n_linked`` of every message.

    ``body`` has no quotes.  A message that answers nothing known begins a thread.
    """
    messages = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    found = threads(replies(messages))
    turns = messages.select("conv_id", "turn").distinct().join(found, ["conv_id", "turn"], "left")
    turns = turns.withColumn("thread", F.coalesce("thread", "turn"))
    if found.isEmpty():
        ranked, order = turns, ("conv_id", "thread")
    else:
        ranked = turns.join(tour(found).withColumnRenamed("turn", "t").withColumnRenamed("conv_id", "c"), (F.col("c") == F.col("conv_id")) & (F.col("t") == F.col("turn")), "left").drop("c", "t")
        ranked, order = ranked.withColumn("later", -F.coalesce("later", F.lit(1))), ("conv_id", "thread", "later")
    numbered = Layout(ranked, OrderSpec(tuple((c, True) for c in order)), spread=True).index("index")
    begin = numbered.groupBy(F.col("conv_id").alias("c")).agg(F.min("index").alias("begin"))
    placed = numbered.join(begin, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        F.col("conv_id").alias("c"), F.col("turn").alias("t"), "thread", "depth", "parent", "n_linked", (F.col("index") - F.col("begin")).alias("position")
    )
    return messages.join(placed, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))).select(
        "conv_id", "thread", F.coalesce("depth", F.lit(0)).alias("depth"), "turn", "position", "parent",
        "role", own_words(F.col("text")).alias("body"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )


def conversations(linked: DataFrame) -> DataFrame:
    """``conv_id, messages``: each conversation in reply order, its messages without quotes.

    A conversation becomes one row, so it must fit one.
    """
    message = F.struct("position", "turn", "depth", "role", "body")
    return linked.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("messages"))
