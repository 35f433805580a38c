"""Tables that an operator writes between its steps, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SPLIT_BYTES = 128 << 20  # what a scan gives a task by default


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one is set on one machine; on a cluster, whose executors couldn't read that, it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="strata-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Spark then deletes the shuffle files of a query when it ends, not when the driver's memory is cleaned.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, once: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back. once: its shuffle files go right after that.

    The table replaces the lineage above it, so a lost executor costs a re-read instead of the
    whole chain, and a value made from partition numbers (row ids, names) stays what it was.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    if once:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if once:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores if they come from fewer files than there are cores and are small enough to be dealt out cheaply."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if not 0 < len(rows.inputFiles()) < cores:
        return rows
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SPLIT_BYTES else rows


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that no later step reads."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
