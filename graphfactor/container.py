"""The result of factoring: for each root one list per entity type."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.values import by_place, row_schema
from .plans.analyze import Graph


#: JSON of timestamps to the microsecond, in UTC.
_EXACT = {"timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class Container:
    """Entity lists by name, leaves first.

    It is made of one row per root (root_id, root_index and an array per list) or of one frame per list (root_id, idx
    and the columns of the type); each form gives the other. In the global scope there are frames only, without
    root_id, and ``roots`` has root_id and root_index.
    """

    def __init__(self, graph: Graph, rows: DataFrame | None = None, frames: dict[str, DataFrame] | None = None, roots: DataFrame | None = None, scope: str = "root"):
        self.graph, self._rows, self._frames, self._roots, self.scope = graph, rows, frames, roots, scope

    @property
    def names(self) -> list[str]:
        return list(self.graph.lists.values())

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def _type(self, name: str) -> str:
        for t, listed in self.graph.lists.items():
            if listed == name:
                return t
        raise KeyError(f"{name} is not reachable from {self.graph.root}; there are {self.names}")

    def __getitem__(self, name: str) -> DataFrame:
        """Frame of a list: root_id, idx (from 0, dense within its root) and the type's columns."""
        node = self.graph.by_name[self._type(name)]
        if self._frames is not None:
            return self._frames[name]
        frame = self._rows.select("root_id", F.posexplode(name).alias("idx", "row"))
        schema = row_schema(self.graph, node.name)
        return frame.select("root_id", "idx", *(F.col("row")[f.name].alias(f.name, metadata=f.metadata) if f.metadata else F.col("row")[f.name].alias(f.name) for f in schema))

    def get(self, name: str, default: DataFrame | None = None) -> DataFrame | None:
        return self[name] if name in self.names else default

    @property
    def roots(self) -> DataFrame:
        """root_id and root_index: the place of each root in the list of the root type."""
        return self._roots if self._roots is not None else self._rows.select("root_id", "root_index")

    @property
    def rows(self) -> DataFrame:
        """One row per root. Frames are gathered by root, which a root's size bounds."""
        if self._rows is not None:
            return self._rows
        if self.scope != "root":
            raise ValueError("lists of the global scope don't belong to single roots")
        out = self.roots
        for t, name in self.graph.lists.items():
            columns = [f.name for f in row_schema(self.graph, t)]
            listed = self._frames[name].groupBy("root_id").agg(by_place(F.collect_list(F.struct("idx", F.struct(*columns).alias("row"))), "idx").alias("all"))
            listed = listed.select("root_id", F.transform("all", lambda x: x["row"]).alias(name))
            out = out.join(listed, "root_id", "left").withColumn(name, F.coalesce(name, F.array().cast(T.ArrayType(row_schema(self.graph, t)))))
        return out

    def create_views(self) -> None:
        """A temporary view of each list, named by the type's key (with_name, else its short name), for SQL."""
        for t, name in self.graph.lists.items():
            self[name].createOrReplaceTempView(self.graph.config.key_of(t))

    def counts(self) -> DataFrame:
        """list, n: entries over all roots."""
        if self._frames is None:
            sizes = F.explode(F.array(*(F.struct(F.lit(n).alias("list"), F.size(n).cast("long").alias("n")) for n in self.names))).alias("x")
            return self._rows.select(sizes).groupBy("x.list").agg(F.sum("x.n").alias("n"))
        out = None
        for n in self.names:
            one = self._frames[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("list"), "n")
            out = one if out is None else out.union(one)
        return out

    def to_json(self) -> DataFrame:
        """root_id and json: the container as one document, nulls written, in order of lists and columns."""
        camel = self.graph.config.camel_case
        from .functions.naming import camel_case

        lists = []
        for t, name in self.graph.lists.items():
            node = self.graph.by_name[t]
            named = lambda x: F.struct(*(x[p.column].alias(p.json_name(camel)) for p in node.props))
            lists.append(F.transform(name, named).alias(camel_case(name) if camel else name))
        return self.rows.select("root_id", F.to_json(F.struct(*lists), {"ignoreNullFields": "false", **_EXACT}).alias("json"))

    @staticmethod
    def from_json(graph: Graph, documents: DataFrame) -> Container:
        """documents: root_id and json, as ``to_json`` writes them; root_index may come with them (0 if not)."""
        from .functions.naming import camel_case

        camel = graph.config.camel_case
        schema = T.StructType()
        for t, name in graph.lists.items():
            row = T.StructType([T.StructField(p.json_name(camel), f.dataType) for p, f in zip(graph.by_name[t].props, row_schema(graph, t), strict=True)])
            schema.add(camel_case(name) if camel else name, T.ArrayType(row))
        parsed = documents.withColumn("x", F.from_json("json", schema, _EXACT))
        columns = []
        for t, name in graph.lists.items():
            node = graph.by_name[t]
            back = lambda x: F.struct(*(x[p.json_name(camel)].alias(p.column) for p in node.props))
            columns.append(F.transform(F.col("x")[camel_case(name) if camel else name], back).alias(name))
        index = F.col("root_index") if "root_index" in documents.columns else F.lit(0)
        return Container(graph, rows=parsed.select("root_id", index.alias("root_index"), *columns))
