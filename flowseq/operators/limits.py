"""Prefix, suffix and direction."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowseq.flow import recorded

#: Keys for which rows are left out before a sort, and elements of each that this is tried for.
BOUNDED_KEYS, BOUNDED_ROWS = 1 << 14, 100
_FIXED_WIDTH = (T.IntegralType, T.FractionalType, T.DateType, T.TimestampType, T.TimestampNTZType)


class Limits:
    def _edge(self, last: bool) -> Column:
        """The position of the first or last row, as a one-value subquery."""
        return self.frame.orderBy(*self.order.columns(reverse=last)).limit(1).select(self.order.key()).scalar()

    def _per_key(self, reverse: bool = False):
        return Window.partitionBy(*self.keys).orderBy(*self.order.columns(reverse))

    @recorded
    def take_while(self, p: Callable[[Any], Column]):
        """L1: elements before the first for which ``p`` fails.

        Without keys no window is needed: the first failing position is found by a
        top-1, then a comparison keeps what stands before it.
        """
        order = self.need_order("take_while")
        if self.keys:
            (ok,) = self.fresh("ok")
            upto = self._per_key().rowsBetween(Window.unboundedPreceding, 0)
            return self.like(self.frame.withColumn(ok, F.bool_and(self.condition(p)).over(upto)).where(F.col(ok)).drop(ok))
        stop = self.frame.where(~self.condition(p)).orderBy(*order.columns()).limit(1).select(order.key()).scalar()
        return self.like(self.frame.where(stop.isNull() | order.before(stop)))

    @recorded
    def take_first(self, n: int):
        """L2, B3d: the first n elements, of each key if the flow is keyed."""
        order = self.need_order("take_first")
        if n <= 0:
            return self.like(self.frame.where(F.lit(False)))
        if self.keys:
            (rank,) = self.fresh("r")
            return self.like(self._near_start(n).withColumn(rank, F.row_number().over(self._per_key())).where(F.col(rank) <= n).drop(rank))
        return self.like(self.frame.orderBy(*order.columns()).limit(n))

    def _near_start(self, n: int):
        """Without rows that n of their key surely precede, so that no task sorts all it reads.

        A key's rows are dealt into shares; n shares whose first rows reach up to a bound
        hold n rows up to it.  Bounds need a hash aggregation, of the first order column
        only, and rows as high as the bound stay.  Keys without a bound lose nothing.
        """
        (name, up), df = self.order.keys[0], self.frame
        kind = df.schema[name].dataType
        wide = isinstance(kind, T.DecimalType) and kind.precision > 18
        # A key that is drawn anew in each run has no bound.
        if n > BOUNDED_ROWS or wide or not isinstance(kind, _FIXED_WIDTH) or not df._jdf.queryExecution().analyzed().deterministic():
            return df
        share, end, bound, *theirs = self.fresh("share", "end", "bound", *["k"] * len(self.keys))
        dealt = df.select(*self.keys, name, F.pmod(F.xxhash64(*self.order.names), F.lit(8 * n)).alias(share))
        ends = dealt.groupBy(*self.keys, share).agg((F.min if up else F.max)(name).alias(end)).where(F.col(end).isNotNull())
        nth = F.get(F.sort_array(F.array_agg(end), asc=up), F.lit(n - 1)).alias(bound)
        bounds = ends.groupBy(*[F.col(k).alias(t) for k, t in zip(self.keys, theirs, strict=True)]).agg(nth).where(F.col(bound).isNotNull()).limit(BOUNDED_KEYS)
        same = F.lit(True)
        for k, t in zip(self.keys, theirs, strict=True):
            same = same & F.col(k).eqNullSafe(F.col(t))
        value = F.col(name)
        near = (value.isNull() | (value <= F.col(bound))) if up else value >= F.col(bound)
        return df.join(F.broadcast(bounds), same, "left").where(F.col(bound).isNull() | near).drop(bound, *theirs)

    @recorded
    def init(self):
        """L3: all but the last element."""
        return self._without_edge("init", last=True)

    @recorded
    def tail(self):
        """L4: all but the first element."""
        return self._without_edge("tail", last=False)

    def _without_edge(self, what: str, last: bool):
        order = self.need_order(what)
        if self.keys:
            (rank,) = self.fresh("r")
            return self.like(self.frame.withColumn(rank, F.row_number().over(self._per_key(last))).where(F.col(rank) > 1).drop(rank))
        return self.like(self.frame.where(~order.same(self._edge(last))))

    def head(self):
        """The first element."""
        return self._edge_result("head", last=False)

    def last(self):
        """The last element."""
        return self._edge_result("last", last=True)

    def _edge_result(self, what: str, last: bool):
        order = self.need_order(what)
        if self.keys:
            (rank,) = self.fresh("r")
            df = self.frame.withColumn(rank, F.row_number().over(self._per_key(last))).where(F.col(rank) == 1)
        else:
            df = self.frame.orderBy(*order.columns(last)).limit(1)
        return self._result(df.select(*dict.fromkeys([*self.keys, *self.columns])), self.columns)

    @recorded
    def reverse(self, at_source: bool = False):
        """Backwards.

        By default what the operators so far give is reversed.  ``at_source`` instead
        runs all operators again over the reversed source, so prefixes, indexes and
        runs are counted from its end.
        """
        order = self.need_order("reverse")
        if not at_source or self.source is None:
            return self.like(self.frame, order=order.reversed())
        out = self.source.like(self.source.frame, order=self.source.need_order("reverse").reversed())
        for method, args, kwargs in self.steps:
            out = method(out, *args, **kwargs)
        return out


