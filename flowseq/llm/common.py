"""What the training-data operators share: tables, scratch space, sizes, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowseq.plans.scratch import drop_settled, scratch_dir, settle

__all__ = ["bounded_batches", "drop_settled", "free_names", "scratch_dir", "settle", "table", "text_bytes", "worker_cache"]


#: Rows of an Arrow batch: texts are long, so Spark's own number of rows would be much memory on both sides.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, for Python workers: batches hold ``BATCH_ROWS`` rows, unless the application's configuration says how many."""
    spark = df.sparkSession
    if spark.sparkContext.getConf().get(_BATCH_SETTING) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return df


_kept: tuple[str, dict] = ("", {})


def worker_cache(owner: str) -> dict:
    """What ``owner`` keeps from task to task of a Python worker, until another asks: Spark uses workers again, and their memory is for one."""
    global _kept
    if owner != _kept[0]:
        _kept = (owner, {})
    return _kept[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` has not, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Total UTF-8 bytes of the texts: what group counts are sized by."""
    row = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long")).alias("n")).first()
    return int(row["n"] or 0)
