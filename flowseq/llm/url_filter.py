"""URL filtering by host-and-path rules: a sort-merge range join.

A host is keyed by its labels in reverse order, each followed by a dot, so
``news.example.org`` becomes ``org.example.news.``; a rule's key is that of its host,
a mark, and its path.  A URL has a key for each of its host's suffixes that rules
name: ``org.``, ``org.example.`` and so on, each with the mark and the URL's path.  A
rule then fits exactly the keys in the interval that starts with its own, and
intervals are nested or disjoint.  URL keys and rules are sorted and swept together:
rules open as the sweep reaches their key and close when a key leaves their interval,
so a stack holds the active nested rules and its top is the longest for that host.
However many rules a host has, a URL costs one place in the order for each suffix.

The page table is never shuffled: each Arrow batch is sorted and swept against
the sorted rules.  Rules are shipped in blocks of bounded size (``block_rules``
and ``block_bytes``); rule sets beyond one block are swept block after block in
the same tasks, each sweep keeping the longest match so far.

Defined results: a null URL or one without ``://`` has an empty host and path
and fits no rule; repeated rows each give a row; an empty table gives an empty
result; ties in length go to the rule with the longer host, then to the smaller
string; texts of any length are read whole; other columns of the input are kept
apart and never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule block holds at most so many rules and so many bytes of rule text.
BLOCK_RULES = 200_000
BLOCK_BYTES = 16 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands between host and path in a key: no host or path begins with it.
_MARK = "\x00"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, ASCII lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def sweep(keys: Iterable[str], rules: list[tuple]) -> Iterator[tuple[str, list[tuple]]]:
    """For each of the ascending ``keys``, the rules whose interval holds it.

    ``rules`` are tuples that start with their key, in ascending order.  The
    stack yielded is reused: it holds outer rules before inner ones.
    """
    stack: list[tuple] = []
    at = 0
    for key in keys:
        while at < len(rules) and rules[at][0] <= key:
            while stack and not rules[at][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        yield key, stack


def _blocks(rules: Iterable[tuple[str, str, str]], block_rules: int, block_bytes: int) -> Iterator[list[tuple]]:
    block: list[tuple] = []
    size = 0
    for verdict, host, path in rules:
        if verdict is None or host is None:
            continue
        host, path = host.translate(str.maketrans(_UPPER, _LOWER)), path or ""
        block.append((f"{host_key(host)}{_MARK}{path}", host, f"{host}{path}", verdict))
        size += 2 * len(host) + 2 * len(path) + 100
        if len(block) >= block_rules or size >= block_bytes:
            yield block
            block, size = [], 0
    yield block


def suffixes(host: str, labels: int) -> Iterator[str]:
    """The host and the domains that it is in, of at most so many labels, shortest first."""
    at = len(host)
    for _ in range(labels):
        at = host.rfind(".", 0, at)
        yield host[at + 1 :]
        if at < 0:
            return


def _matcher(shipped):
    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Of rules with one key the smaller string comes last, on top of the stack.
        rules = sorted(shipped.value, key=lambda r: (r[0], *([-ord(c) for c in x] for x in r[2:])))
        known = {r[1] for r in rules}
        labels = max((h.count(".") + 1 for h in known), default=0)
        for pdf in batches:
            rule, verdict = list(pdf["_rule"].to_numpy()), list(pdf["_verdict"].to_numpy())
            probes: dict[str, list[tuple[int, str]]] = {}
            for row, (host, path, given) in enumerate(zip(pdf["_host"].to_numpy(), pdf["_path"].to_numpy(), pdf["_given"].to_numpy(), strict=True)):
                for end in suffixes(host, labels) if given else ():
                    if end in known:
                        probes.setdefault(f"{host_key(end)}{_MARK}{path}", []).append((row, end))
            # The longest rule wins, among equals that of the longer host, which comes last.
            width = [-1 if r is None else len(r) for r in rule]
            hosts = [-1] * len(rule)
            for key, stack in sweep(sorted(probes), rules):
                if stack:
                    _, host, text, says = stack[-1]
                    for row, _ in probes[key]:
                        if (len(text), len(host)) > (width[row], hosts[row] if width[row] == len(text) else -1):
                            rule[row], verdict[row], width[row], hosts[row] = text, says, len(text), len(host)
            pdf["_rule"] = pd.Series(rule, dtype=object, index=pdf.index)
            pdf["_verdict"] = pd.Series(verdict, dtype=object, index=pdf.index)
            yield pdf

    return match


def judge_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]] | DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    block_rules: int = BLOCK_RULES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Host, path, longest fitting rule and verdict of every page.

    ``rules`` are ``(verdict, host, path)`` tuples, or a DataFrame with columns of
    these names, which is streamed to the driver one bounded block at a time.
    Pages that no rule fits get ``default``.
    """
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        rules = ((r[0], r[1], r[2]) for r in rules.select("verdict", "host", "path").toLocalIterator())
    url = F.col(url_col)
    out = pages.select(
        F.col(id_col).alias("_id"), host_of(url).alias("_host"), path_of(url).alias("_path"),
        F.lit(None).cast("string").alias("_rule"), F.lit(None).cast("string").alias("_verdict"),
        F.coalesce(F.contains(url, F.lit("://")), F.lit(False)).alias("_given"),
    )
    schema = out.schema
    for block in _blocks(rules, block_rules, block_bytes):
        if block:
            out = out.mapInPandas(_matcher(spark.sparkContext.broadcast(block)), schema)
    return out.select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_rule").alias("rule"), F.coalesce("_verdict", F.lit(default)).alias("verdict"),
    )
