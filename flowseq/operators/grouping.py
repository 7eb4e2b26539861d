"""Grouping by key, and by runs of equal keys."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from flowseq.flow import VALUE
from flowseq.order import OrderSpec
from flowseq.plans.layout import Layout


class Groups:
    """G1: elements by key, waiting for an aggregator."""

    def __init__(self, flow, key: dict[str, Column], value: Callable[[Any], Column] | None = None, runs: bool = False):
        self._flow, self._key, self._value, self._runs = flow, key, value, runs

    def valueby(self, fn: Callable[[Any], Column]) -> Groups:
        """Aggregate a part of each element."""
        return Groups(self._flow, self._key, fn, self._runs)

    def adjacent(self) -> Groups:
        """Runs of equal keys instead of all equal keys."""
        self._flow.need_order("adjacent")
        return Groups(self._flow, self._key, self._value, True)

    def _keyed(self):
        """The flow with its key columns beside it, the names that group it, and how the groups are ordered."""
        flow = self._flow.guarded()
        names = flow.fresh(*["k"] * len(self._key))
        df = flow.frame.select("*", *[c.alias(n) for n, c in zip(names, self._key.values(), strict=True)])
        flow = flow.like(df)
        if not self._runs:
            return flow, names, None
        (run,) = flow.fresh("run")
        return flow.like(Layout(flow.frame, flow.order, flow.keys).runs(F.struct(*names), run)), names, run

    def agg(self, **named: Callable[[Any], Column] | Column):
        """Native aggregates by name; a callable gets the flow's element."""
        flow, names, run = self._keyed()
        return self._grouped(flow, names, run, {n: c(flow.element) if callable(c) and not isinstance(c, Column) else c for n, c in named.items()})

    def _grouped(self, flow, names, run, columns: dict[str, Column]):
        out = list(self._key)
        by = [*flow.keys, *([run] if run else []), *names]
        df = flow.frame.groupBy(*by).agg(*[c.alias(n) for n, c in columns.items()])
        df = df.select(*flow.keys, *([run] if run else []), *[F.col(n).alias(o) for n, o in zip(names, out, strict=True)], *columns)
        order = OrderSpec(((run, True),)) if run else OrderSpec(tuple((o, True) for o in out))
        return type(flow)(df, (*out, *columns), order, flow.keys)

    def count(self, name: str = "count"):
        """G7"""
        return self.agg(**{name: F.count(F.lit(1))})

    def _of(self, flow) -> Column:
        return self._value(flow.element) if self._value else flow.value_struct()

    def last(self, name: str = VALUE):
        """The last value of each key."""
        flow, names, run = self._keyed()
        order, value = flow.need_order("the last value of a key"), self._of(flow)
        up = order.direction()
        if up is not None:
            return self._grouped(flow, names, run, {name: (F.max_by if up else F.min_by)(value, order.key())})
        (rank,) = flow.fresh("r")
        by = [*flow.keys, *([run] if run else []), *names]
        df = flow.frame.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order.columns(reverse=True)))).where(F.col(rank) == 1)
        return self._grouped(flow.like(df), names, run, {name: F.first(value)})

    def to_vector(self, name: str = VALUE):
        """The values of each key, in order if the flow has one; a key's values must fit a row."""
        flow, names, run = self._keyed()
        flow = flow._uniform() if flow.order else flow
        return self._grouped(flow, names, run, {name: flow.collected(lambda e: self._of(flow))})

    def to_set(self, name: str = VALUE):
        """The distinct values of each key."""
        flow, names, run = self._keyed()
        return self._grouped(flow, names, run, {name: F.array_sort(F.collect_set(self._of(flow)))})

    def aggregate(self, init: Any, merge: Callable[[Column, Column], Column], name: str = VALUE):
        """A fold from ``init`` over each key's values, in order if there is one."""
        flow, names, run = self._keyed()
        flow = flow._uniform() if flow.order else flow
        start = init if isinstance(init, Column) else F.lit(init)
        return self._grouped(flow, names, run, {name: F.aggregate(flow.collected(lambda e: self._of(flow)), start, merge)})

    def top_k(self, k: int, by: Callable[[Any], Any] | None = None, smallest: bool = False):
        """The elements of each key with the k largest (or smallest) sort keys.

        ``by`` gives a Column or a list; a pair ``(Column, ascending)`` has a direction
        of its own.  A rank filter, which Spark also applies before the exchange.
        """
        flow, names, run = self._keyed()
        keys = by(flow.element) if by else flow.value_struct()
        pairs = [c if isinstance(c, tuple) else (c, smallest) for c in (keys if isinstance(keys, list) else [keys])]
        order = [c.asc() if up else c.desc() for c, up in pairs] + flow.order.columns()
        (rank,) = flow.fresh("r")
        parts = [*flow.keys, *([run] if run else []), *names]
        df = flow.frame.withColumn(rank, F.row_number().over(Window.partitionBy(*parts).orderBy(*order))).where(F.col(rank) <= k)
        clash = [o for o in self._key if o in flow.columns]
        key_columns = [F.col(n).alias(o) for n, o in zip(names, self._key, strict=True) if o not in clash]
        out = [o for o in self._key if o not in clash]
        df = df.select(*key_columns, "*")
        return flow.like(df, columns=(*out, *flow.columns), order=OrderSpec(tuple((n, True) for n in names) + ((rank, True),)))


class Grouping:
    def groupby(self, key: Callable[[Any], Any] | None = None) -> Groups:
        """G1: by a key function, or by the elements themselves."""
        if key is None:
            return Groups(self, {n: F.col(n) for n in self.columns})
        out = self.apply(key)
        return Groups(self, {("key" if n == VALUE else n): c for n, c in out.items()})
