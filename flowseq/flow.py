"""The flow: a lazy DataFrame with an order specification.

Operators are methods.  Element functions take what the flow holds - the column
itself if it has one visible column, else an accessor with a column per name - and
return a Column, or a dict of named Columns.  Everything stays a Catalyst
expression; Python callables are explicit (``map_py``, ``aggregate_py``).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowseq.order import OrderRequired, OrderSpec

VALUE = "value"


class Element:
    """The visible columns of a flow, by attribute or item."""

    def __init__(self, names: tuple[str, ...]):
        self._names = names

    def __getitem__(self, name: str) -> Column:
        if name not in self._names:
            raise KeyError(name)
        return F.col(name)

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_") or name not in self._names:
            raise AttributeError(name)
        return F.col(name)


def recorded(method):
    """Remember how a flow came about, so that ``reverse(at_source=True)`` can run it again."""

    @functools.wraps(method)
    def wrapper(self, *args, **kwargs):
        out = method(self, *args, **kwargs)
        if isinstance(out, FlowBase) and out is not self:
            out.source = self.source or self
            out.steps = (*self.steps, (method, args, kwargs))
        return out

    return wrapper


def predicate(p: Column) -> Column:
    """Two-valued: null is false."""
    return F.coalesce(p.cast("boolean"), F.lit(False))


class FlowBase:
    """State and helpers; the operators come from the mix-ins in :mod:`flowseq.operators`."""

    def __init__(self, df: DataFrame, columns: tuple[str, ...], order: OrderSpec = OrderSpec(), keys: tuple[str, ...] = ()):
        self.frame, self.columns, self.order, self.keys = df, tuple(columns), order, tuple(keys)
        self.source: FlowBase | None = None
        self.steps: tuple = ()
        # For layouts: what the elements were multiplied from, and whether the frame is in range partitions.
        self.origin: tuple | None = None
        self.laid = False

    # --- helpers for operators ------------------------------------------------------------

    @property
    def spark(self):
        return self.frame.sparkSession

    @property
    def element(self) -> Column | Element:
        return F.col(self.columns[0]) if len(self.columns) == 1 else Element(self.columns)

    @property
    def hidden(self) -> list[str]:
        """Order and key columns that no user sees."""
        return [n for n in dict.fromkeys([*self.keys, *self.order.names]) if n not in self.columns]

    def apply(self, fn: Callable[[Any], Any]) -> dict[str, Column]:
        """The named columns that an element function gives."""
        out = fn(self.element)
        if isinstance(out, Mapping):
            return dict(out)
        return {VALUE: out}

    def condition(self, fn: Callable[[Any], Column] | Column) -> Column:
        return predicate(fn(self.element) if callable(fn) and not isinstance(fn, Column) else fn)

    def value_struct(self) -> Column:
        """The whole element as one column."""
        return F.col(self.columns[0]) if len(self.columns) == 1 else F.struct(*self.columns)

    def need_order(self, what: str) -> OrderSpec:
        if not self.order:
            raise OrderRequired(f"{what} depends on position: give the flow an order")
        return self.order

    def like(self, df: DataFrame, columns=None, order: OrderSpec | None = None, keys=None):
        return type(self)(df, self.columns if columns is None else tuple(columns), self.order if order is None else order, self.keys if keys is None else keys)

    def fresh(self, *stems: str) -> list[str]:
        """Names that no column has yet."""
        taken, out = set(self.frame.columns), []
        for stem in stems:
            n = 0
            while (name := f"__{stem}{n}") in taken:
                n += 1
            taken.add(name)
            out.append(name)
        return out

    def where(self, condition: Column):
        """The elements that meet a condition, which are still of the same origin."""
        out = self.like(self.frame.where(condition))
        if self.origin:
            source, order, made = self.origin
            out.origin = (source, order, lambda df, also=(): made(df, also).where(condition))
        return out

    def slim(self, columns: list[str], value: Column) -> DataFrame:
        """The frame with no columns but those named and those that ``value`` is made of."""
        plan = self.frame.select(value.alias("v"))._jdf.queryExecution().analyzed()
        if plan.nodeName() != "Project":
            return self.frame
        used = plan.references().toSeq()
        used = {used.apply(i).name() for i in range(used.size())}
        return self.frame.select(*dict.fromkeys([*columns, *(c for c in self.frame.columns if c in used)]))

    def guarded(self) -> FlowBase:
        """The same flow with its order and keys held in hidden columns, so visible ones may go."""
        visible = [n for n in dict.fromkeys([*self.keys, *self.order.names]) if n in self.columns]
        if not visible:
            return self
        names = dict(zip(visible, self.fresh(*["o"] * len(visible)), strict=True))
        df = self.frame.select("*", *[F.col(old).alias(new) for old, new in names.items()])
        order = OrderSpec(tuple((names.get(n, n), up) for n, up in self.order.keys))
        return self.like(df, order=order, keys=tuple(names.get(n, n) for n in self.keys))

    # --- results --------------------------------------------------------------------------

    def to_df(self) -> DataFrame:
        """The visible columns; rows are not sorted."""
        return self.frame.select(*self.columns)

    def sorted_df(self) -> DataFrame:
        """The visible columns with the rows in order."""
        if not self.order:
            return self.to_df()
        return self.frame.orderBy(*self.order.columns()).select(*self.columns)


def _flow_class():
    from flowseq.operators import aggs, elementwise, grouping, limits, parallel, setops, sinks, sorting, subflows, windows

    class Flow(
        elementwise.Elementwise, limits.Limits, sorting.Sorting, aggs.Aggregations, grouping.Grouping,
        setops.SetOperations, windows.Windows, subflows.Subflows, parallel.Parallel, sinks.Sinks, FlowBase,
    ):
        """A lazy, ordered sequence of elements."""

    class Result(Flow):
        """What a result sink gives: one row, or one row per key of a keyed flow."""

        def value(self) -> Any:
            """The single value on the driver: None if there is no row, a tuple for several columns."""
            row = self.to_df().first()
            return None if row is None else row[0] if len(self.columns) == 1 else tuple(row)

    return Flow, Result


Flow, Result = _flow_class()
