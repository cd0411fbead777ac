"""Factoring streams of nested rows.

Lists are distinct within one root and a root is one row, so factoring keeps no state: the plan of ``normalize`` runs
on a streaming frame as it does on a table, without watermarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.normalize import normalize
from ..plans.config import GraphConfig


def factor_stream(stream: DataFrame, config: GraphConfig, key: str, path: str, checkpoint: str, root: str | None = None, **trigger) -> StreamingQuery:
    """Append the container rows of a stream's roots to Parquet at ``path``, each root once (file sink and checkpoint)."""
    rows = normalize(stream, config, key, root).rows
    return rows.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
