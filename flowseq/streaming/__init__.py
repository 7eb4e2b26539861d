"""Push mode (S13, D8): pipelines whose elements arrive over time, as Structured Streaming.

A :class:`PlaceHolder` is an input to be pushed to.  What is pushed becomes files
of a streaming source; :meth:`PlaceHolder.start` runs a pipeline over them, and
:meth:`Run.end` processes what is there and returns the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowseq.flow import Flow
from flowseq.order import OrderSpec

_SEQ = "__seq"


class PlaceHolder:
    """An unbound input with a schema; elements keep the order in which they were pushed."""

    def __init__(self, spark: SparkSession, schema: str, folder: str):
        self.spark, self._folder = spark, f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
        self._fields = T._parse_datatype_string(schema)
        self.schema = T.StructType([T.StructField(_SEQ, T.LongType()), *self._fields.fields])
        self._pushed = 0
        spark.createDataFrame([], self.schema).write.mode("append").parquet(self._folder)

    def push(self, *elements: Any) -> None:
        """Append elements: values, or tuples for several columns."""
        rows = [(self._pushed + i, *(e if isinstance(e, tuple) else (e,))) for i, e in enumerate(elements)]
        self._pushed += len(rows)
        self.spark.createDataFrame(rows, self.schema).write.mode("append").parquet(self._folder)

    def stream(self) -> DataFrame:
        """All that is pushed, as a streaming DataFrame."""
        return self.spark.readStream.schema(self.schema).parquet(self._folder)

    def _flow(self, df: DataFrame) -> Flow:
        return Flow(df, tuple(self._fields.names), OrderSpec(((_SEQ, True),)))

    def start(self, pipeline: Callable[[Flow], Any]) -> Run:
        """Begin a run of a pipeline; elements pushed from now on belong to it."""
        return Run(self, pipeline)


class Run:
    """One run of a pipeline in push mode."""

    def __init__(self, source: PlaceHolder, pipeline: Callable[[Flow], Any]):
        self._source, self._pipeline, self._after = source, pipeline, source._pushed

    def run(self, *elements: Any) -> Run:
        self._source.push(*elements)
        return self

    def end(self) -> Any:
        """The pipeline's result over the elements of this run."""
        df = self._source.spark.read.schema(self._source.schema).parquet(self._source._folder)
        return self._pipeline(self._source._flow(df.where(F.col(_SEQ) >= self._after)))

    def stream(self, sink: Callable[[Flow, int], None], checkpoint: str):
        """Element-wise pipelines as they arrive: ``sink`` gets the flow of each micro-batch."""

        def batch(df: DataFrame, n: int) -> None:
            sink(self._pipeline(self._source._flow(df)), n)

        return self._source.stream().where(F.col(_SEQ) >= self._after).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Concat:
    """Two inputs pushed to separately; the left one's elements stand before the right one's."""

    def __init__(self, left: PlaceHolder, right: PlaceHolder):
        self.left, self.right = left, right

    def end(self, pipeline: Callable[[Flow], Any] = lambda f: f) -> Any:
        whole = lambda p: p._flow(p.spark.read.schema(p.schema).parquet(p._folder))
        return pipeline(whole(self.left).concat(whole(self.right)))

    def stream(self) -> DataFrame:
        """Both streams with the side that each element came from."""
        side = lambda p, name: p.stream().withColumn("side", F.lit(name))
        return side(self.left, "left").unionByName(side(self.right, "right"))


def tumbling_counts(stream: DataFrame, size: int, seq: str = _SEQ, **aggregates) -> DataFrame:
    """W1 over a stream: windows of ``size`` elements by their running number, updated as they fill."""
    return stream.groupBy(F.floor(F.col(seq) / size).alias("k")).agg(F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in aggregates.items()])
