"""Operators that take whole sub-pipelines."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowseq.order import OrderSpec
from flowseq.plans.scratch import settle


class Partition:
    """A sub-pipeline per key; :meth:`by` names the key."""

    def __init__(self, flow, fn: Callable[[Any], Any]):
        self._flow, self._fn = flow, fn

    def by(self, key: Callable[[Any], Column], name: str = "key", reverse: bool = False):
        """Run the sub-pipeline once, over a keyed flow.

        The key joins every window and every aggregation of the sub-pipeline, so all
        keys are treated by one plan.  A result sink gives (key, result), a pipe its
        elements, and no result the keys.  Keys come in ascending order, or in
        descending order with ``reverse`` (B4).
        """
        flow = self._flow.guarded()
        (hidden,) = flow.fresh("key")
        keyed = flow.like(flow.frame.withColumn(hidden, key(flow.element)), keys=(*flow.keys, hidden))
        return close(flow, keyed, self._fn(keyed), hidden, name, not reverse)


def close(flow, keyed, out, hidden: str, name: str, up: bool = True):
    """Turn what a sub-pipeline gave for a keyed flow into a flow over all keys."""
    from flowseq.flow import Flow, Result

    if isinstance(out, Result):
        df = out.frame.select(*[k for k in flow.keys], F.col(hidden).alias(name), *[c for c in out.columns if c != name])
        return Flow(df, (name, *[c for c in out.columns if c != name]), OrderSpec(((name, up),)), flow.keys)
    if out is None:
        df = keyed.frame.select(*flow.keys, F.col(hidden).alias(name)).distinct()
        return Flow(df, (name,), OrderSpec(((name, up),)), flow.keys)
    key = out.keys[-1]
    return Flow(out.frame, out.columns, out.order.prefixed((key, up)) if out.order else out.order, out.keys[:-1])


class Subflows:
    def transform(self, fn: Callable[[Any], Any]):
        """Apply a pipeline that was written as a function of its input."""
        return fn(self)

    def branch(self, fn: Callable[[Any], Any], share: bool = False):
        """B1: ``(what the side pipeline gives, this flow)``; ``share`` computes the input once, as a table for both."""
        base = self.like(settle(self.frame)) if share else self
        return fn(base), base

    def if_else(self, condition: Callable[[Any], Column], then: Callable[[Any], Any], otherwise: Callable[[Any], Any]):
        """B2: both results; each element goes to one side, and null counts as false."""
        c = self.condition(condition)
        return then(self.like(self.frame.where(c))), otherwise(self.like(self.frame.where(~c)))

    def partition(self, fn: Callable[[Any], Any]) -> Partition:
        """B3, B4"""
        return Partition(self, fn)

    def named(self, view: str):
        """The flow as a temporary view, for SQL."""
        self.to_df().createOrReplaceTempView(view)
        return self


def link(*stages: Callable[[Any], Any]) -> Callable[[Any], Any]:
    """One pipeline from several, applied from left to right."""

    def run(flow):
        for stage in stages:
            flow = stage(flow)
        return flow

    return run
