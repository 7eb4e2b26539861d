"""Running numbers, neighbours and running sums over a global order.

A window without a partition key puts all rows into one task.  That is right only
for input that one task reads anyway: one split of files, or as many bytes of
driver values, with nothing in between that multiplies rows.  All other input is
range-partitioned by the order, each partition is treated for itself, and one
summary row per partition (its count, its last value, its sum) is carried over to
the partitions after it.  Those rows join by partition, the key that the windows
need as well, so they cost no exchange of their own.

Where elements were multiplied on the way (``flatmap``), what they are made of is
partitioned instead, and they are made in the tasks that number them: they never move.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowseq.order import OrderSpec
from flowseq.plans.scratch import settle

#: Input of so many bytes is one split; behind an operator that multiplies rows, far less counts as small.
SINGLE_TASK_BYTES = 32 << 20
MULTIPLIED_BYTES = 64 << 10
#: Bytes of a source, as Spark tells them, for one range partition of rows that it multiplies into.
RANGE_BYTES = 4 << 20
MOST_RANGES = 20_000
_PART = "__part"
_MULTIPLIES = re.compile(r"\b(?:Generate|Expand|MapIn|FlatMap|\w*Join|Window)")


def _source_bytes(df: DataFrame):
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())), plan


def _ranges(source: DataFrame) -> int:
    """Partitions whose multiplied rows a task can sort in memory; Spark's own number where it doesn't know a size."""
    spark, wanted = source.sparkSession, _source_bytes(source)[0] // RANGE_BYTES
    if wanted > 1 << 30:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(max(spark.sparkContext.defaultParallelism, wanted), MOST_RANGES)


def one_split(df: DataFrame) -> bool:
    """Whether one task reads all that a plan starts from.  Sizes are those of the sources, not estimates of results."""
    size, plan = _source_bytes(df)
    return size <= (min(MULTIPLIED_BYTES, SINGLE_TASK_BYTES) if _MULTIPLIES.search(plan.toString()) else SINGLE_TASK_BYTES)


class Layout:
    """Rows in order, either as one sequence or in range partitions with carried summaries.

    ``spread`` asks for range partitions whatever the size.  ``origin`` is what ``df`` was
    multiplied from, its order (the first columns of ``order``), and how, with further columns
    kept; ``laid`` says that ``df`` comes from a layout by the same order.
    """

    def __init__(self, df: DataFrame, order: OrderSpec, keys: tuple[str, ...] = (), spread: bool = False, origin: tuple | None = None, laid: bool = False):
        self.order, self.keys = order, keys
        self.single = not laid and (bool(keys) or (not spread and one_split(df)))
        # Range bounds are sampled: every use must see the same partitions.
        self.counted = None
        if laid:
            self.df = df
        elif origin and not self.single:
            source, by, made = origin
            n = _ranges(source)
            ranged = settle(source.repartitionByRange(n, *by.columns()).withColumn(_PART, F.spark_partition_id()))
            # A window by partition needs no exchange behind this one; counts and sums need none.
            self.df, self.counted = made(ranged.repartition(n, _PART), (_PART,)), made(ranged, (_PART,))
        else:
            self.df = df if self.single else settle(df.repartitionByRange(*order.columns()).withColumn(_PART, F.spark_partition_id()))

    @property
    def window(self):
        by = self.keys if self.single else (_PART,)
        return (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*self.order.columns())

    def _carried(self, *summaries: Column) -> DataFrame:
        return (self.df if self.counted is None else self.counted).groupBy(_PART).agg(*summaries)

    def _ahead(self, column: str):
        """What the partitions before this one add up to: one row a partition, so one task is enough."""
        before = Window.partitionBy(F.lit(0)).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(column).over(before), F.lit(0)).alias("__ahead")

    def _done(self, df: DataFrame) -> DataFrame:
        return df.drop(_PART)

    def index(self, name: str, keep: bool = False) -> DataFrame:
        """With the 0-based position of each row; ``keep`` leaves the partitions in, for another layout by this order."""
        local = F.row_number().over(self.window).cast("long") - 1
        if self.single:
            return self.df.withColumn(name, local)
        carried = self._carried(F.count(F.lit(1)).alias("n")).select(_PART, self._ahead("n"))
        df = self.df.withColumn(name, local).join(F.broadcast(carried), _PART, "left").withColumn(name, F.col(name) + F.col("__ahead")).drop("__ahead")
        return df if keep else self._done(df)

    def _previous(self, value: Column, name: str) -> DataFrame:
        boxed = F.struct(value.alias("v"))
        local = F.lag(boxed).over(self.window)
        if self.single:
            return self.df.withColumn(name, local)
        ends = self.df.select(_PART, boxed.alias("e"), F.lead(F.lit(True)).over(self.window).alias("more")).where(F.col("more").isNull())
        carried = ends.select(_PART, F.lag("e").over(Window.partitionBy(F.lit(0)).orderBy(_PART)).alias("__end"))
        return self.df.withColumn(name, local).join(carried, _PART, "left").withColumn(name, F.coalesce(name, "__end")).drop("__end")

    def previous(self, value: Column, name: str) -> DataFrame:
        """With a struct ``v`` of the preceding row's value; null on the first row."""
        return self._done(self._previous(value, name))

    def running_sum(self, value: Column, name: str) -> DataFrame:
        """With the sum of ``value`` over all rows up to and with each row."""
        local = F.sum(value).over(self.window.rowsBetween(Window.unboundedPreceding, 0))
        if self.single:
            return self.df.withColumn(name, local)
        carried = self._carried(F.sum(value).alias("s")).select(_PART, self._ahead("s"))
        return self._done(self.df.withColumn(name, local).join(F.broadcast(carried), _PART, "left").withColumn(name, F.col(name) + F.col("__ahead")).drop("__ahead"))

    def runs(self, value: Column, name: str) -> DataFrame:
        """With the 1-based number of the run of equal values that each row is in: both steps share this layout."""
        before, changed = f"{name}_p", f"{name}_c"
        df = self._previous(value, before)
        differs = F.col(before).isNull() | ~F.col(before)["v"].eqNullSafe(value)
        same = Layout.__new__(Layout)
        same.order, same.keys, same.single, same.counted = self.order, self.keys, self.single, None
        same.df = df.withColumn(changed, F.when(differs, 1).otherwise(0).cast("long")).drop(before)
        return same.running_sum(F.col(changed), name).drop(changed)

    def partitions(self) -> tuple[DataFrame, str | None]:
        """The rows with the number of their range partition, whose order is that of the rows; None for one sequence."""
        return (self.df, None) if self.single else (self.df, _PART)
