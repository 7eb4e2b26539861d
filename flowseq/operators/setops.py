"""Distinct elements, runs without repeats, concatenation."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from flowseq.flow import recorded
from flowseq.order import OrderSpec
from flowseq.plans.layout import Layout


class SetOperations:
    @recorded
    def distinct(self, by: Callable[[Any], Any] | None = None, insert: Callable[[set, Any], bool] | None = None):
        """The first element of each value, or of each key.

        Firsts are minima by position, so they are found before the exchange.  With
        ``insert`` a Python function decides, in order, whether an element is new to the
        set of its key: only elements whose ``by`` is equal see each other, and those of
        one key must fit a task.
        """
        if insert:
            return self._distinct_py(by, insert)
        base = self.guarded()
        keys = {n: F.col(n) for n in base.columns} if by is None else base.apply(by)
        if not base.order:
            names = base.fresh(*["d"] * len(keys))
            df = base.frame.select("*", *[c.alias(n) for n, c in zip(names, keys.values(), strict=True)])
            return base.like(df.dropDuplicates([*base.keys, *names]).drop(*names))
        up = base.order.direction()
        rest = list(dict.fromkeys([*base.columns, *base.order.names]))
        if up is not None:
            names, (row,) = base.fresh(*["d"] * len(keys)), base.fresh("row")
            pick = (F.min_by if up else F.max_by)(F.struct(*rest), base.order.key())
            df = base.frame.groupBy(*base.keys, *[c.alias(n) for n, c in zip(names, keys.values(), strict=True)]).agg(pick.alias(row))
            return base.like(df.select(*base.keys, *[F.col(row)[n].alias(n) for n in rest if n not in base.keys]))
        (rank,) = base.fresh("r")
        window = Window.partitionBy(*base.keys, *keys.values()).orderBy(*base.order.columns())
        return base.like(base.frame.withColumn(rank, F.row_number().over(window)).where(F.col(rank) == 1).drop(rank))

    def _distinct_py(self, by, insert):
        base = self.guarded()
        order = base.need_order("distinct with a Python function")
        names = base.fresh(*["d"] * (len(base.apply(by)) if by else 1))
        keys = list(base.apply(by).values()) if by else [F.lit(0)]
        df = base.frame.select("*", *[c.alias(n) for n, c in zip(names, keys, strict=True)])
        columns = list(base.columns)

        def keep(pdf):
            pdf = pdf.sort_values(order.names, ascending=[up for _, up in order.keys], kind="stable")
            known: set = set()
            new = [bool(insert(known, row[0] if len(columns) == 1 else row)) for row in pdf[columns].itertuples(index=False, name=None)]
            return pdf[new]

        return base.like(df.groupBy(*base.keys, *names).applyInPandas(keep, df.schema).drop(*names))

    @recorded
    def unique(self, by: Callable[[Any], Column] | None = None):
        """Drops elements that equal the one before, or whose key does."""
        order = self.need_order("unique")
        (before,) = self.fresh("p")
        value = by(self.element) if by else self.value_struct()
        df = Layout(self.frame, order, self.keys, origin=self.origin, laid=self.laid).previous(value, before)
        return self.like(df.where(F.col(before).isNull() | ~F.col(before)["v"].eqNullSafe(value)).drop(before))

    @recorded
    def concat(self, *others):
        """All elements of this flow, then those of the others; types widen as in a union."""
        arms = [self.guarded(), *(o.guarded() for o in others)]
        ordered = all(a.order for a in arms)
        out, keys = None, []
        for i, a in enumerate(arms):
            visible = [F.col(c).alias(n) for c, n in zip(a.columns, self.columns, strict=True)]
            marks = [F.lit(i).alias("__arm")]
            if ordered:
                for j, b in enumerate(arms):
                    for k, (name, up) in enumerate(b.order.keys):
                        at = f"__a{j}k{k}"
                        marks.append((F.col(name) if i == j else F.lit(None).cast(b.frame.schema[name].dataType)).alias(at))
                        if i == 0:
                            keys.append((at, up))
            df = a.frame.select(*[F.col(k) for k in a.keys if k not in a.columns], *visible, *marks)
            out = df if out is None else out.unionAll(df)
        return self.like(out, order=OrderSpec((("__arm", True), *keys)) if ordered else OrderSpec())
