"""Where flows begin."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowseq.flow import VALUE, Flow
from flowseq.order import OrderSpec

_POS = "__pos"


def _order(keys: str | Iterable[str | tuple[str, bool]] | None) -> OrderSpec:
    if not keys:
        return OrderSpec()
    keys = [keys] if isinstance(keys, str) else keys
    return OrderSpec(tuple((k, True) if isinstance(k, str) else k for k in keys))


def from_df(df: DataFrame, order=None) -> Flow:
    """An existing DataFrame; ``order`` names unique columns, as ``name`` or ``(name, ascending)``."""
    return Flow(df, tuple(df.columns), _order(order))


def scan(spark: SparkSession, path: str, order=None, columns: Sequence[str] | None = None) -> Flow:
    """A Parquet table; only what later operators use is read."""
    df = spark.read.parquet(path)
    return from_df(df.select(*columns) if columns else df, order)


def iterate(spark: SparkSession, values: Iterable[Any], schema: str | T.DataType | None = None) -> Flow:
    """Values of the driver program, in their order.

    A string gives its characters.  A row type gives one column per field.
    """
    values = list(values)
    if schema is None and not values:
        schema = "long"
    if schema is not None and not isinstance(schema, T.StructType) and ":" not in str(schema) and " " not in str(schema):
        # One value column of the named type.
        kind = schema if isinstance(schema, T.DataType) else T._parse_datatype_string(schema)
        rows, fields = [(i, v) for i, v in enumerate(values)], [T.StructField(VALUE, kind)]
    elif schema is not None:
        struct = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        rows, fields = [(i, *v) for i, v in enumerate(values)], struct.fields
    else:
        as_rows = isinstance(values[0], (tuple, dict)) and not isinstance(values[0], str)
        inferred = spark.createDataFrame(values if as_rows else [(v,) for v in values]).schema
        fields = inferred.fields if as_rows else [T.StructField(VALUE, inferred.fields[0].dataType)]
        rows = [(i, *((v.values() if isinstance(v, dict) else v) if as_rows else (v,))) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, T.StructType([T.StructField(_POS, T.LongType(), False), *fields]))
    return Flow(frame, tuple(f.name for f in fields), OrderSpec(((_POS, True),)))


def elements(spark: SparkSession, *values: Any, schema: str | None = None) -> Flow:
    """A literal list; without values the empty sequence."""
    return iterate(spark, values, schema)


def iterate_optional(spark: SparkSession, value: Any, schema: str = "long") -> Flow:
    """No element for None, else one."""
    return iterate(spark, [] if value is None else [value], schema)


def iterate_column(flow: Flow, fn: Callable[[Any], Column] | None = None) -> Flow:
    """The items of an array column of a flow or of a result."""
    return flow.flatmap(fn or (lambda e: e))


def range_(spark: SparkSession, start: int, end: int | None = None, step: int = 1) -> Flow:
    """Half-open and ascending; ``range_(end)`` starts from zero."""
    if end is None:
        start, end = 0, start
    if step <= 0:
        raise ValueError("the step must be positive")
    if all(isinstance(x, int) for x in (start, end, step)):
        return Flow(spark.range(start, end, step).withColumnRenamed("id", VALUE), (VALUE,), OrderSpec(((VALUE, True),)))
    n = max(0, int(-(-(end - start) // step)))
    return Flow(spark.range(n).select(F.col("id").alias(_POS), (F.lit(start) + F.col("id") * F.lit(step)).alias(VALUE)), (VALUE,), OrderSpec(((_POS, True),)))


class Generator:
    """An unbounded source; only :meth:`times` and :meth:`until` make a flow of it."""

    def __init__(self, spark: SparkSession, fn: Callable[[Column], Column]):
        self._spark, self._fn = spark, fn

    def times(self, n: int) -> Flow:
        """The first n elements."""
        return Flow(self._spark.range(n).select(F.col("id").alias(_POS), self._fn(F.col("id")).alias(VALUE)), (VALUE,), OrderSpec(((_POS, True),)))

    def until(self, stop: Callable[[Column], Column], limit: int | None = None) -> Flow:
        """Up to the first element for which ``stop`` holds.

        The end is looked for now, in ranges that double, so the flow is exactly as long
        as it has to be; a ``stop`` that never holds raises after 2^62 elements.
        ``limit`` instead looks no further and gives at most so many elements.
        """
        if limit is not None:
            return self.times(limit).take_while(lambda e: ~F.coalesce(stop(e), F.lit(False)))
        begin, end = 0, 1 << 16
        while begin < 1 << 62:
            ids = self._spark.range(begin, end).where(F.coalesce(stop(self._fn(F.col("id"))), F.lit(False)))
            first = ids.agg(F.min("id")).first()[0]
            if first is not None:
                return self.times(first)
            begin, end = end, 2 * end
        raise ValueError("no element ends the sequence")


def generate(spark: SparkSession, fn: Callable[[Column], Column]) -> Generator:
    """``fn`` maps the running number of an element to the element."""
    return Generator(spark, fn)


def characters(df: DataFrame, text: str, order=None) -> Flow:
    """A text column as a stream of characters."""
    return from_df(df.select(text, *[k if isinstance(k, str) else k[0] for k in ([order] if isinstance(order, str) else order or [])]), order).flatmap(lambda e: F.split(F.col(text), ""))


def read_text(spark: SparkSession, path: str, separator: str | None = None, name: str = VALUE, ordered: bool = False) -> Flow:
    """Text files as their lines, or as the non-empty parts between matches of ``separator``.

    ``ordered`` keeps the order of files by path and of lines in a file.
    """
    lines = spark.read.text(path)
    if ordered:
        place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias(_POS)]
        lines = lines.select(F.col("value").alias(name), *place)
        order = OrderSpec((("__file", True), ("__block", True), (_POS, True)))
    else:
        lines, order = lines.select(F.col("value").alias(name)), OrderSpec()
    flow = Flow(lines, (name,), order)
    return flow.split_text(separator, lambda e: e, name) if separator else flow
