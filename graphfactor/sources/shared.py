"""Intermediate tables in the folder that all machines of the cluster share (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends. Where spark.checkpoint.dir is unset on one
    machine, as in tests, a temporary folder serves."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        top = tempfile.mkdtemp(prefix="graphfactor-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/graphfactor/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
