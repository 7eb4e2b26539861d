"""Element-wise operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowseq.flow import VALUE, recorded
from flowseq.plans.layout import Layout


class Elementwise:
    @recorded
    def map(self, fn: Callable[[Any], Any]):
        """One element out for each one in."""
        base = self.guarded()
        out = base.apply(fn)
        return base.like(base.frame.select(*[c.alias(n) for n, c in out.items()], *[h for h in base.hidden if h not in out]), columns=tuple(out))

    @recorded
    def filter(self, p: Callable[[Any], Column]):
        """Elements for which ``p`` is true; null counts as false."""
        return self.where(self.condition(p))

    @recorded
    def flatmap(self, fn: Callable[[Any], Column], name: str = VALUE, keep: tuple[str, ...] = (), pipeline: Callable[[Any], Any] | None = None):
        """The items of the array that ``fn`` gives for each element.

        ``pipeline`` is a sub-pipeline that runs over the items of each element for
        itself, in one plan for all elements.  ``keep`` names columns to keep beside
        the items.
        """
        if pipeline:
            return self._flatmap_each(fn, name, keep, pipeline)
        base = self.guarded()
        (at,) = base.fresh("i")
        order = base.order.then((at, True)) if base.order else base.order
        rest = [*keep, *base.hidden]
        # A generator that numbers its items costs nothing more and keeps their order.
        items = fn(base.element)
        if not order:
            return base.like(base.frame.select(*rest, F.explode(items).alias(name)), columns=(*keep, name), order=order)
        made = lambda df, also=(): df.select(*also, *rest, F.posexplode(items).alias(at, name))
        out = base.like(made(base.frame), columns=(*keep, name), order=order)
        if not base.keys:
            out.origin = (base.slim(rest, items), base.order, made)
        return out

    def _flatmap_each(self, fn, name, keep, pipeline):
        base = self.guarded()
        base.need_order("a sub-pipeline per element")
        items = base.flatmap(fn, name, keep)
        # An element's position is its key.
        out = pipeline(items.like(items.frame, keys=(*base.keys, *base.order.names)))
        inner = tuple(k for k in out.order.keys if k[0] not in base.order.names)
        from flowseq.flow import Flow

        return Flow(out.frame, out.columns, base.order.then(*inner), base.keys)

    def flatmap_py(self, fn: Callable[[Any], Any], returns: str | T.DataType, name: str = VALUE, keep: tuple[str, ...] = ()):
        """U4: a Python function that gives any number of items for one value, in Arrow batches."""
        item = returns if isinstance(returns, T.DataType) else T._parse_datatype_string(returns)

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series([list(fn(v)) for v in batch.tolist()], dtype=object)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        udf = F.pandas_udf(run, T.ArrayType(item))
        return self.flatmap(lambda e: udf(e), name, keep)

    def flatmap_chars(self, fn: Callable[[Any], Column], name: str = VALUE, keep: tuple[str, ...] = ()):
        """The characters of a string."""
        return self.flatmap(lambda e: F.split(fn(e), ""), name, keep)._present(name)

    def _present(self, name: str):
        """Without empty items: a row filter stays in generated code, a filter over the array does not."""
        return self.where(F.col(name) != "")

    def flatten(self, name: str = VALUE):
        """The items of array elements."""
        return self.flatmap(lambda e: e, name)

    @recorded
    def zip_with_index(self, name: str = "index"):
        """With the 0-based position, counted within each key of a keyed flow."""
        order = self.need_order("zip_with_index")
        layout = Layout(self.frame, order, self.keys, origin=self.origin, laid=self.laid)
        out = self.like(layout.index(name, keep=True), columns=(name, *self.columns))
        out.laid = not layout.single
        return out

    def inspect(self, observation: Observation, *metrics: Column):
        """Passes everything through and gathers metrics on the way."""
        return self.like(self.frame.observe(observation, *metrics))

    @recorded
    def unwrap(self, fn: Callable[[Any], Column] = lambda e: e):
        """Raises an error when it meets null."""
        return self.map(lambda e: F.coalesce(fn(e), F.raise_error(F.lit("unwrap of an empty value")).cast(self._type_of(fn))))

    @recorded
    def unwrap_or(self, default: Any, fn: Callable[[Any], Column] = lambda e: e):
        """P10: a default in place of null."""
        return self.map(lambda e: F.coalesce(fn(e), F.lit(default)))

    def map_optional(self, fn: Callable[[Column], Column]):
        """Maps present values, null stays null."""
        return self.map(lambda e: F.when(e.isNotNull(), fn(e)))

    def flatmap_optional(self, fn: Callable[[Column], Column]):
        """Null gives no items."""
        return self.flatmap(lambda e: F.when(e.isNotNull(), fn(e)))

    def filter_optional(self, p: Callable[[Column], Column]):
        """Null where the predicate does not hold."""
        return self.map(lambda e: F.when(F.coalesce(p(e), F.lit(False)), e))

    @recorded
    def map_py(self, fn: Callable[[Any], Any], returns: str | T.DataType):
        """A Python function of one value, in Arrow batches; for what no expression can say."""

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series([fn(v) for v in batch.tolist()])

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        udf = F.pandas_udf(run, returns)
        return self.map(lambda e: udf(e))

    def _type_of(self, fn):
        return self.frame.select(fn(self.element)).schema[0].dataType
