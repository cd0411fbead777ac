"""Expressions over one nested root: its pruned value, its occurrences of a type, and flat rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.analyze import Graph, Prop, has_map
from ..plans.catalog import PropKind
from ..plans.config import ConfigError


#: Field of a pruned value that tells values with NaN apart, where these equal nothing.
_PLACE = "place of NaN"


def floats(props: list[Prop]) -> list[Prop]:
    return [p for p in props if p.kind is PropKind.SIMPLE and isinstance(p.field.dtype, (T.DoubleType, T.FloatType))]


def spark_type(graph: Graph, name: str) -> T.StructType:
    """Type of a pruned value: fields that take part, maps as sorted entries."""
    out = T.StructType()
    if graph.nan_distinct and floats(graph.by_name[name].props):
        out.add(_PLACE, "string")
    for p in graph.by_name[name].props:
        if p.kind is PropKind.NORMALIZED:
            out.add(p.name, spark_type(graph, p.target))
        elif p.kind is PropKind.COLLECTION:
            out.add(p.name, T.ArrayType(spark_type(graph, p.target)))
        else:
            d = p.field.dtype
            out.add(p.name, T.ArrayType(T.StructType().add("key", d.keyType).add("value", d.valueType)) if isinstance(d, T.MapType) else d)
    return out


def required(p: Prop) -> bool:
    return not p.field.nullable or bool(p.field.metadata.get("required"))


def _raise(text: str) -> Column:
    return F.raise_error(F.lit(text))


def value(graph: Graph, name: str, e: Column, on_null: str, place: Column | None = None) -> Column:
    """e with the fields that take part at every depth; null collections are empty. place: where e stands in the table;
    with it, a value with NaN in a field of its own equals no other."""
    parts = []
    props = graph.by_name[name].props
    if graph.nan_distinct and floats(props):
        nan = reduce(Column.__or__, (F.coalesce(F.isnan(e[p.name]), F.lit(False)) for p in floats(props)))
        parts.append(F.when(nan, place).alias(_PLACE))
    for i, p in enumerate(props):
        x = e[p.name]
        below = None if place is None else F.concat(place, F.lit(f".{i}"))
        if p.kind is PropKind.NORMALIZED:
            missing = _raise(f"{name}.{p.name} is required and null") if required(p) and on_null == "error" else F.lit(None)
            x = F.when(x.isNotNull(), value(graph, p.target, x, on_null, below)).otherwise(missing)
        elif p.kind is PropKind.COLLECTION:
            missing = _raise(f"{name}.{p.name} has a null element") if on_null == "error" else F.lit(None)
            if place is None:
                each = lambda y: F.when(y.isNotNull(), value(graph, p.target, y, on_null)).otherwise(missing)
            else:
                each = lambda y, n: F.when(y.isNotNull(), value(graph, p.target, y, on_null, F.concat(below, F.lit(":"), n.cast("string")))).otherwise(missing)
            x = F.coalesce(F.transform(x, each), F.array().cast(T.ArrayType(spark_type(graph, p.target))))
        elif isinstance(p.field.dtype, T.MapType) and not has_map(p.field.dtype.valueType):
            x = F.array_sort(F.map_entries(x))
        elif has_map(p.field.dtype):
            raise ConfigError(f"{name}.{p.name}: maps within nested values can't be compared")
        parts.append(x.alias(p.name))
    return F.struct(*parts)


def occurrences(graph: Graph, source: str, target: str, e: Column) -> Column:
    """All values of type target in a value of type source, in the order of a depth-first walk over fields."""
    parts = []
    for p in graph.by_name[source].links:
        x, here = e[p.name], p.target == target
        if not here and not graph.reaches(p.target, target):
            continue
        if p.kind is PropKind.NORMALIZED:
            found = F.array(x) if here else occurrences(graph, p.target, target, x)
            parts.append(F.when(x.isNotNull(), found).otherwise(F.array().cast(T.ArrayType(spark_type(graph, target)))))
        else:
            there = F.filter(x, lambda y: y.isNotNull())
            parts.append(there if here else F.flatten(F.transform(there, lambda y: occurrences(graph, p.target, target, y))))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def flat_row(graph: Graph, name: str, e: Column, index_of: Callable[[str, Column], Column]) -> Column:
    """Row of a pruned value: scalars and inlined values as they are, references as indices into their lists."""
    parts = []
    for p in graph.by_name[name].props:
        x = e[p.name]
        if p.kind is PropKind.NORMALIZED:
            x = F.when(x.isNotNull(), index_of(p.target, x))
        elif p.kind is PropKind.COLLECTION:
            x = F.transform(x, lambda y: F.when(y.isNotNull(), index_of(p.target, y)))
        else:
            x = plain(p, x)
        parts.append(x.alias(p.column))
    return F.struct(*parts)


def plain(p: Prop, x: Column) -> Column:
    return F.map_from_entries(x) if isinstance(p.field.dtype, T.MapType) else x


def row_schema(graph: Graph, name: str) -> T.StructType:
    """Schema of a type's flat rows; metadata is kept if the configuration copies it."""
    out = T.StructType()
    for p in graph.by_name[name].props:
        kind = {PropKind.NORMALIZED: T.IntegerType(), PropKind.COLLECTION: T.ArrayType(T.IntegerType())}.get(p.kind, p.field.dtype)
        keep = graph.config.copy_metadata and p.kind in (PropKind.SIMPLE, PropKind.INLINED)
        out.add(p.column, kind, True, dict(p.field.metadata) if keep else None)
    return out


def by_place(structs: Column, place: str) -> Column:
    """An array of structs in order of an integer field; the other fields need no order (maps have none)."""
    return F.array_sort(structs, lambda a, b: a[place] - b[place])


def only_path(graph: Graph, target: str) -> list[Prop] | None:
    """The references that lead from the root to a type, if there is one way and no collection on it: then a root has
    one object of the type at most, and its index is 0."""
    path: list[Prop] = []
    while target != graph.root:
        ways = [(n, p) for n in graph.nodes for p in n.links if p.target == target]
        if len(ways) != 1 or ways[0][1].kind is PropKind.COLLECTION:
            return None
        path.insert(0, ways[0][1])
        target = ways[0][0].name
    return path
