"""Sub-pipelines on parallel workers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowseq.operators.subflows import Partition, close
from flowseq.order import OrderSpec


class OnDemand:
    """Whoever is free gets the next elements: Spark's own task scheduling."""

    def worker(self, flow, n: int) -> Column:
        return F.pmod(F.monotonically_increasing_id(), F.lit(n))


class RandomAssign:
    """A random worker, from a seed."""

    def __init__(self, seed: int = 0):
        self.seed = seed

    def worker(self, flow, n: int) -> Column:
        return F.floor(F.rand(self.seed) * n)


class ByKey:
    """Equal keys go to one worker."""

    def __init__(self, key: Callable[[Any], Column]):
        self.key = key

    def worker(self, flow, n: int) -> Column:
        return F.pmod(F.xxhash64(self.key(flow.element)), F.lit(n))


class Parallel:
    def parallel(self, n: int, fn: Callable[[Any], Any], shuffle_by: Any = None, name: str = "pid"):
        """N workers run the sub-pipeline, each over its share.

        A result sink gives (worker, result), also for workers without elements; a pipe
        gives all elements without an order; no result gives the workers.  Workers are
        groups of one plan: results are combined before the exchange.
        """
        from flowseq.flow import Flow, Result

        flow = self.guarded()
        (pid,) = flow.fresh("pid")
        strategy = shuffle_by or OnDemand()
        keyed = flow.like(flow.frame.withColumn(pid, strategy.worker(flow, n).cast("int")), keys=(*flow.keys, pid))
        out = fn(keyed)
        everyone = flow.spark.range(n).select(F.col("id").cast("int").alias(pid))
        if isinstance(out, Result):
            none = fn(keyed.like(keyed.frame.where(F.lit(False)), keys=flow.keys)).frame if not flow.keys else None
            df = everyone.join(out.frame, pid, "left")
            if none is not None:
                # An idle worker's result is that of an empty input: one row.
                idle = none.select(F.struct(*out.columns).alias("s")).scalar()
                seen = out.frame.select(pid, F.lit(True).alias("__seen"))
                df = df.join(seen, pid, "left").select(pid, *[F.when(F.col("__seen"), F.col(c)).otherwise(idle[c]).alias(c) for c in out.columns])
            return Flow(df.select(F.col(pid).alias(name), *out.columns), (name, *out.columns), OrderSpec(((name, True),)))
        if out is None:
            return Flow(everyone.withColumnRenamed(pid, name), (name,), OrderSpec(((name, True),)))
        return close(flow, keyed, out, pid, name)._unordered()

    def _unordered(self):
        return self.like(self.frame, order=OrderSpec())

    def parallel_partition(self, n: int, fn: Callable[[Any], Any]):
        """A sub-pipeline per key, keys dealt over n tasks; ``.key_by(key)`` names the key."""
        return _KeyBy(self, n, fn)


class _KeyBy:
    def __init__(self, flow, n: int, fn: Callable[[Any], Any]):
        self._flow, self._n, self._fn = flow, n, fn

    def key_by(self, key: Callable[[Any], Column], name: str = "key"):
        """Equal keys meet in one of n tasks.

        Results, whether values or elements, are dealt once the sub-pipeline has given
        them: what it leaves out never moves, and no task has to hold what n of them read.
        """
        from flowseq.flow import Result

        given = []
        out = Partition(self._flow, lambda flow: given.append(self._fn(flow)) or given[-1]).by(key, name)
        dealt_by = name if given[-1] is None or isinstance(given[-1], Result) else given[-1].keys[-1]
        return out.like(out.frame.repartition(self._n, dealt_by))
