"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .text import release


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where it is unset on one machine, as in tests, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        found = tempfile.mkdtemp(prefix="graphfactor-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/graphfactor/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


#: Bytes of the files that a plan reads for each of its partitions, at least, where partitions are merged.
PART_BYTES = 128 << 20


def few(df: DataFrame, per_core: int = 4) -> DataFrame:
    """df with its partitions merged, without a shuffle, to ``per_core`` for each core of the cluster or to one for
    each PART_BYTES that its plan reads, whichever are more: as many tasks as keep all cores busy and none too
    large, and no more small files, each of which costs the file system several calls."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return df.coalesce(min(1 << 30, max(per_core * df.sparkSession.sparkContext.defaultParallelism, read // PART_BYTES)))


def table(df: DataFrame, label: str, per_core: int = 4) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    few(df, per_core).write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._scratch_path = path
    return written


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``table`` that no plan needs any more."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def settle(spark: SparkSession) -> None:
    """Let go of finished plans: Spark removes their shuffle files and broadcasts when the driver collects their owners."""
    gc.collect()
    release()
    spark._jvm.System.gc()


#: Rows and bytes of the record batches that Python workers get: texts are long, and several copies of a batch exist at once.
_BATCH = (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20))


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with batches of bounded size, for df.transform. The session keeps the smaller of its own and our bounds."""
    conf = df.sparkSession.conf
    for key, most in _BATCH:
        own = conf.get(key, None)
        if not (own and own.isdigit() and 0 < int(own) <= most):
            conf.set(key, str(most))
    return df.mapInArrow(run, schema)
