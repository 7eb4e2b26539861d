"""Global aggregates (A1 to A14).  In a keyed flow they are per key."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowseq.flow import VALUE


class Aggregations:
    def _result(self, df: DataFrame, columns) -> Any:
        from flowseq.flow import Result

        return Result(df, tuple(columns), keys=self.keys)

    def agg(self, **named: Column):
        """Any native aggregates, by name."""
        columns = [c.alias(n) for n, c in named.items()]
        return self._result(self.frame.groupBy(*self.keys).agg(*columns) if self.keys else self.frame.agg(*columns), named)

    def _of(self, fn: Callable[[Any], Column] | None) -> Column:
        return fn(self.element) if fn else self.value_struct()

    def _type(self, c: Column) -> T.DataType:
        return self.frame.select(c.alias("x")).schema[0].dataType

    def count(self):
        """A4"""
        return self.agg(value=F.count(F.lit(1)))

    def _extreme(self, by, largest: bool):
        value, key = self.value_struct(), by(self.element) if by else None
        if key is None:
            return self.agg(value=(F.max if largest else F.min)(value))
        # Of equals the first wins, so the order joins the key where there is one.
        if not self.order:
            return self.agg(value=(F.max_by if largest else F.min_by)(value, key))
        if (up := self.order.direction()) is not None and up is not largest:
            return self.agg(value=(F.max_by if largest else F.min_by)(value, F.struct(key, self.order.key())))
        best = self.like(self.frame.where(key.isNotNull())).sort(by, reverse=largest).head()
        return self._result(best.frame.select(*self.keys, best.value_struct().alias(VALUE)), (VALUE,))

    def max(self, by: Callable[[Any], Column] | None = None):
        """A5: the largest element, or the first with the largest key."""
        return self._extreme(by, True)

    def min(self, by: Callable[[Any], Column] | None = None):
        """The smallest element, or the first with the smallest key."""
        return self._extreme(by, False)

    def sum(self, fn: Callable[[Any], Column] | None = None, init: Any = None):
        """Null for an empty flow, unless ``init`` is given; whole numbers are summed as long."""
        total = F.sum(self._of(fn))
        return self.agg(value=total if init is None else F.lit(init) + F.coalesce(total, F.lit(0)))

    def mul(self, fn: Callable[[Any], Column] | None = None, init: Any = None):
        """A10: whole numbers are multiplied exactly, which an overflow of long ends with an error."""
        c = self._of(fn)
        if isinstance(self._type(c), (T.DoubleType, T.FloatType)):
            product = F.product(c)
            return self.agg(value=product if init is None else F.lit(init) * F.coalesce(product, F.lit(1.0)))
        # Partial products per hash bucket, then their product: no task holds all factors.
        (b,) = self.fresh("b")
        times = lambda x: F.reduce(F.array_agg(x.cast("long")), F.lit(1).cast("long"), lambda acc, v: acc * v)
        partial = self.frame.where(c.isNotNull()).select(*self.keys, c.alias("c")).withColumn(b, F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
        partial = partial.groupBy(*self.keys, b).agg(times(F.col("c")).alias("p"), F.count(F.lit(1)).alias("n"))
        whole = [(F.when(F.sum("n") > 0, times(F.col("p"))) if init is None else F.lit(init) * times(F.col("p"))).alias(VALUE)]
        return self._result(partial.groupBy(*self.keys).agg(*whole) if self.keys else partial.agg(*whole), (VALUE,))

    def avg(self, fn: Callable[[Any], Column] | None = None, init: Any = None):
        """Whole numbers are divided towards zero; ``init`` joins the sum, not the count."""
        c = self._of(fn)
        total, n = F.sum(c), F.count(c)
        if init is not None:
            total = F.lit(init) + F.coalesce(total, F.lit(0))
        whole = isinstance(self._type(c), T.IntegralType)
        (s, k) = ("__s", "__n")
        df = self.frame.groupBy(*self.keys).agg(total.alias(s), n.alias(k)) if self.keys else self.frame.agg(total.alias(s), n.alias(k))
        quotient = F.expr(f"{s} div {k}") if whole else F.col(s) / F.col(k)
        return self._result(df.select(*self.keys, F.when(F.col(k) == 0, F.col(s)).otherwise(quotient).alias(VALUE)), (VALUE,))

    def any(self, p: Callable[[Any], Column]):
        """False for an empty flow."""
        return self.agg(value=F.coalesce(F.bool_or(self.condition(p)), F.lit(False)))

    def all(self, p: Callable[[Any], Column]):
        """True for an empty flow."""
        return self.agg(value=F.coalesce(F.bool_and(self.condition(p)), F.lit(True)))

    def exists(self, p: Callable[[Any], Column]) -> bool:
        """A13 on the driver: stops at the first hit."""
        return not self.frame.where(self.condition(p)).limit(1).isEmpty()

    def collected(self, fn: Callable[[Any], Column] | None = None) -> Column:
        """All elements as an array in order: an aggregate, for results that fit a row."""
        value = self._of(fn)
        if not self.order:
            return F.array_agg(value)
        pairs = F.array_agg(F.struct(self.order.key().alias("k"), value.alias("v")))
        up = self.order.direction()
        if up is None:
            raise ValueError("an array needs an order of one direction: number the elements first (zip_with_index)")
        return F.transform(F.sort_array(pairs, asc=up), lambda x: x["v"])

    def _uniform(self):
        """The same flow with an order of one direction."""
        if not self.order or self.order.direction() is not None:
            return self
        base = self.guarded()
        (at,) = base.fresh("i")
        from flowseq.order import OrderSpec
        from flowseq.plans.layout import Layout

        return base.like(Layout(base.frame, base.order, base.keys).index(at), order=OrderSpec(((at, True),)))

    def aggregate(self, init: Column | Any, merge: Callable[[Column, Column], Column], fn: Callable[[Any], Column] | None = None, finish: Callable[[Column], Column] | None = None):
        """A1, A2, A3: a left fold in order; for folds that no native aggregate expresses.

        The elements of a key (or of the flow) become one array, so they must fit a task.
        """
        base = self._uniform()
        start = init if isinstance(init, Column) else F.lit(init)
        array = F.coalesce(base.collected(fn), F.array())
        folded = F.aggregate(array, start, merge, finish) if finish else F.aggregate(array, start, merge)
        return base.agg(value=folded)._with_keys_of(self)

    def reduce(self, merge: Callable[[Column, Column], Column], init: Any = None, fn: Callable[[Any], Column] | None = None, associative: bool = False):
        """A fold that starts from the first element, or from ``init``; null for an empty flow.

        Where ``merge`` is associative, ranges of the order are folded for themselves and
        their results then in order, so no task holds more than a range.
        """
        if init is not None:
            return self.aggregate(init, merge, fn)
        if associative and self.order and not self.keys:
            return self._reduce_ranges(merge, fn)
        base = self._uniform()
        array = base.collected(fn)
        folded = F.aggregate(F.slice(array, 2, F.greatest(F.size(array) - 1, F.lit(0))), F.get(array, F.lit(0)), merge)
        return base.agg(value=F.when(F.size(array) > 0, folded))._with_keys_of(self)

    def _reduce_ranges(self, merge, fn):
        from flowseq.order import OrderSpec
        from flowseq.plans.layout import Layout

        base = self.guarded()
        df, part = Layout(base.frame.select(*base.order.names, base._of(fn).alias(VALUE)), base.order).partitions()
        flow = base.like(df, columns=(VALUE,))
        if part is None:
            return flow.reduce(merge)
        each = flow.like(df, keys=(part,)).reduce(merge)
        return each.like(each.frame, order=OrderSpec(((part, True),)), keys=()).reduce(merge)

    def _with_keys_of(self, flow):
        if self.keys == flow.keys:
            return self
        df = self.frame.select(*[F.col(a).alias(b) for a, b in zip(self.keys, flow.keys, strict=True)], *self.columns)
        return flow._result(df, self.columns)

    def aggregate_py(self, fn: Callable[[pd.DataFrame], Any], returns: str):
        """A Python function of all rows of a key, in order, as a pandas frame; they must fit a task."""
        order, keys, columns = self.order, list(self.keys), list(self.columns)
        schema = T.StructType([*(self.frame.schema[k] for k in keys), T.StructField(VALUE, T._parse_datatype_string(returns))])

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            if order:
                pdf = pdf.sort_values(order.names, ascending=[up for _, up in order.keys], kind="stable")
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, VALUE: [fn(pdf[columns])]})

        return self._result(self.frame.groupBy(*keys).applyInPandas(run, schema), (VALUE,))
