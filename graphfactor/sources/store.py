"""Nested tables in, containers out and in again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..container import Container
from ..plans.analyze import Graph


def read_nested(spark: SparkSession, path: str, schema: T.StructType | None = None, format: str = "parquet") -> DataFrame:
    """A nested table of any format that Spark reads; a schema with metadata (entity, normalize, ...) replaces its own."""
    df = (spark.read.schema(schema) if schema is not None and format != "parquet" else spark.read).format(format).load(path)
    if schema is None:
        return df
    return df.select(*(df[f.name].cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema))


def write_container(container: Container, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """One Parquet folder: rows if the container is made of rows, else one folder per list and one for the roots."""
    if container._frames is None:
        writer = container.rows.write.mode(mode)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/rows")
        return
    for name in container:
        container[name].write.mode(mode).parquet(f"{path}/{name}")
    container.roots.write.mode(mode).parquet(f"{path}/roots")


def read_container(spark: SparkSession, path: str, graph: Graph, scope: str = "root") -> Container:
    """What write_container wrote, of the same graph."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        return Container(graph, rows=spark.read.parquet(f"{path}/rows"))
    frames = {name: spark.read.parquet(f"{path}/{name}") for name in graph.lists.values()}
    return Container(graph, frames=frames, roots=spark.read.parquet(f"{path}/roots"), scope=scope)


def write_json(container: Container, path: str, mode: str = "errorifexists") -> None:
    """One JSON document per root and line. Keys of roots are not part of the documents."""
    container.to_json().select("json").write.mode(mode).text(path)
