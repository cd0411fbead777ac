"""Rebuilding nested rows from a container."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..container import Container
from ..plans.analyze import Graph
from ..plans.catalog import Field, PropKind
from ..plans.config import ConfigError
from .values import by_place, only_path


def default_of(f: Field) -> Column:
    """What a field that took no part comes back as: zero, false or, if it may be null or has no such value, null."""
    d = f.dtype
    if d is None:
        return F.lit(None)
    if not f.nullable and isinstance(d, T.NumericType):
        return F.lit(0).cast(d)
    if not f.nullable and isinstance(d, T.BooleanType):
        return F.lit(False)
    return F.array().cast(d) if f.many else F.lit(None).cast(d)


def _object(graph: Graph, name: str, row: Column, one, several) -> Column:
    """The declared fields of a type, those that take part filled from a flat row."""
    props = {p.name: p for p in graph.by_name[name].props}
    parts = []
    for f in graph.config.catalog[name]:
        p = props.get(f.name)
        if p is None:
            x = default_of(f)
        elif p.kind is PropKind.NORMALIZED:
            x = F.when(row[p.column].isNotNull(), one(p, row[p.column]))
        elif p.kind is PropKind.COLLECTION:
            indices = F.array_distinct(row[p.column]) if f.distinct else row[p.column]
            x = several(p, indices)
        else:
            x = row[p.column]
        parts.append(x.alias(f.name))
    return F.struct(*parts)


def denormalize(container: Container, root_zero: bool = False) -> DataFrame:
    """root_id and the root type's fields. A null collection comes back empty, ignored fields as defaults, collections
    with set semantics without repeats. An index out of range is an error. root_zero: take entry 0 as the root."""
    graph = container.graph
    if graph.cyclic:
        raise ConfigError("objects of cyclic types don't nest: use expand or the frames themselves")
    if container.scope == "global":
        return _by_joins(container)
    rows = container.rows
    for t, name in graph.lists.items():  # leaves first
        at = lambda p, i: F.col(graph.lists[p.target])[i]
        each = lambda p, xs: F.transform(xs, lambda i: F.when(i.isNotNull(), F.col(graph.lists[p.target])[i]))
        if only_path(graph, t) is not None:  # one entry at most
            made = F.array(_object(graph, t, F.col(name)[0], at, each))
            rows = rows.withColumn(name, F.when(F.size(name) > 0, made))
        else:
            rows = rows.withColumn(name, F.transform(name, lambda x: _object(graph, t, x, at, each)))
    index = F.lit(0) if root_zero else F.col("root_index")
    rows = rows.select("root_id", F.col(graph.lists[graph.root])[index].alias("v"))
    return rows.select("root_id", *(F.col("v")[f.name].alias(f.name) for f in graph.config.catalog[graph.root]))


def _by_joins(container: Container) -> DataFrame:
    graph = container.graph
    built: dict[str, DataFrame] = {}
    for t, name in graph.lists.items():
        out = container[name].select("idx", F.struct(*(c for c in container[name].columns if c != "idx")).alias("r"))
        for i, p in enumerate(graph.by_name[t].links):
            target = built[p.target].select(F.col("idx").alias("_k"), F.col("o").alias(f"_o{i}"))
            if p.kind is PropKind.NORMALIZED:
                out = out.join(target, F.col("r")[p.column] == F.col("_k"), "left").drop("_k")
            else:
                indices = F.array_distinct(F.col("r")[p.column]) if p.field.distinct else F.col("r")[p.column]
                each = out.select("idx", F.posexplode(indices).alias("_pos", "_i")).join(target, F.col("_i") == F.col("_k"), "left")
                gathered = each.groupBy("idx").agg(by_place(F.collect_list(F.struct("_pos", f"_o{i}")), "_pos").alias("_all"))
                out = out.join(gathered.select("idx", F.transform("_all", lambda y: y[f"_o{i}"]).alias(f"_o{i}")), "idx", "left")
                out = out.withColumn(f"_o{i}", F.coalesce(f"_o{i}", F.array().cast(T.ArrayType(built[p.target].schema["o"].dataType))))
        order = {p.name: i for i, p in enumerate(graph.by_name[t].links)}
        take = lambda p, _: F.col(f"_o{order[p.name]}")
        built[t] = out.select("idx", _object(graph, t, F.col("r"), take, take).alias("o"))
    root = built[graph.root].withColumnRenamed("idx", "root_index")
    return container.roots.join(root, "root_index").select("root_id", *(F.col("o")[f.name].alias(f.name) for f in graph.config.catalog[graph.root]))
