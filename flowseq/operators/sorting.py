"""Sorting and top-k."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from flowseq.flow import recorded
from flowseq.order import OrderSpec


class Sorting:
    @recorded
    def sort(self, key: Callable[[Any], Column | list[Column]] | None = None, reverse: bool = False):
        """By the elements or by key expressions; ties keep the order so far.

        Sorting only replaces the order specification: rows move when a result needs
        it, and then by one range exchange.
        """
        base = self.guarded()
        keys = [F.col(c) for c in base.columns] if key is None else key(base.element)
        keys = keys if isinstance(keys, (list, tuple)) else [keys]
        names = base.fresh(*["s"] * len(keys))
        df = base.frame.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
        return base.like(df, order=OrderSpec(tuple((n, not reverse) for n in names) + base.order.keys))

    @recorded
    def sort_with(self, compare: Callable[[Column, Column], Column], name: str = "value"):
        """O3: by an opaque comparison (negative, zero or positive integer).

        The elements become one array, which one task sorts: for what no key
        expression can say, and for small flows.
        """
        array = F.array_sort(F.array_agg(self.value_struct()), compare)
        df = (self.frame.groupBy(*self.keys) if self.keys else self.frame).agg(array.alias(name))
        made = self.like(df.select(*self.keys, F.posexplode(name).alias("__pos", name)), columns=(name,), order=OrderSpec((("__pos", True),)))
        return made

    @recorded
    def top_k(self, k: int, by: Callable[[Any], Column | list[Column]] | None = None, smallest: bool = False):
        """The k largest elements (or smallest), best first; ties by the order so far.

        Plans as TakeOrderedAndProject, or as a rank filter per key.
        """
        return self.sort(by, reverse=not smallest).take_first(k)

    def _ranked(self, by: list[str], keys: list[Column], k: int):
        (rank,) = self.fresh("r")
        return self.frame.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).where(F.col(rank) <= k), rank
