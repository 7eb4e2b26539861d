"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where intermediate tables go when a local session names no shared folder (tests).
DEFAULT_SCRATCH = "file:///tmp/checkpoints"

#: Spark's switch for removing a query's shuffle files when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scratch: dict[int, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A folder for this application's intermediate tables.

    It lies in the shared folder of ``spark.checkpoint.dir``, so executors and
    driver see the same files, and goes away when the application ends.  A cluster
    that names none is an error: each machine would write to a folder of its own.
    """
    context = spark.sparkContext
    key = id(context._jsc)
    if key not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise RuntimeError("intermediate tables need a folder that all executors share: set spark.checkpoint.dir")
            base = DEFAULT_SCRATCH
        path = f"{base.rstrip('/')}/flowseq-{uuid.uuid4().hex}"
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(context._jsc.hadoopConfiguration())
        fs.mkdirs(target)
        fs.deleteOnExit(target)
        _scratch[key] = path
    return _scratch[key]


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of what is
    above, and non-repeatable layouts (partition ids, sampling) are frozen.
    What was shuffled for it is removed from the executors' disks.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(schema).parquet(path)


def drop_settled(df: DataFrame) -> None:
    """Remove the files of a table that :func:`settle` wrote and nothing reads any more."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    own = f"/{scratch_dir(spark).rsplit('/', 1)[1]}/"
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if own in parent:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)
