"""Factoring acyclic nested rows.

A root's whole graph lies in its row, and lists are distinct within one root, so the usual plan needs no shuffle: the
occurrences of a type are gathered in order of a depth-first walk, array_distinct keeps the first of equal values, and
a reference becomes its value's place in that list. A type that a root can hold one object of needs neither. For roots
with very long lists, whose comparison within a row grows with the square of the length, and for lists over all roots,
the same lists come from groups and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..container import Container
from ..plans.analyze import Graph
from ..plans.catalog import PropKind
from ..plans.config import ConfigError, GraphConfig
from ..sources.shared import shared_table
from .dense import dense_index
from .values import flat_row, occurrences, only_path, plain, row_schema, spark_type, value

#: Occurrences of one type in a root up to which "auto" works within the row.
ROW_LIMIT = 1000


def normalize(df: DataFrame, config: GraphConfig, key: str | Column, root: str | None = None, scope: str = "root", strategy: str = "row", on_null_required: str = "error", row_limit: int = ROW_LIMIT, nan_distinct: bool = False) -> Container:
    """Factor each row of df, a value of the root type, into the lists of a container.

    key: column (or expression) that identifies a root; it is called root_id in the container. scope: "root", lists
    distinct within each root, or "global", one list for all rows. strategy (of scope "root"): "row" without a
    shuffle, "shuffle" by groups and joins, or "auto": within the row up to row_limit occurrences of a type, else by
    groups; all three give the same container. on_null_required: "error" or "null", for null in a field that is
    required (metadata required, or not nullable in an explicit catalog) and for null elements of collections.
    nan_distinct: a value with NaN in a field of its own equals no other, so each of its occurrences is an entry.
    """
    graph = config.compile(root)
    if graph.cyclic:
        raise ConfigError(f"{graph.root} refers back to itself: use normalize_objects")
    if on_null_required not in ("error", "null") or scope not in ("root", "global") or strategy not in ("row", "shuffle", "auto"):
        raise ConfigError("unknown option")
    fields = [f.name for f in config.catalog[graph.root]]
    rows = df.select((F.col(key) if isinstance(key, str) else key).alias("root_id"), F.struct(*(F.col(f"`{f}`") for f in fields)).alias("v"))
    graph.nan_distinct = nan_distinct
    place = F.coalesce(F.to_json(F.struct("root_id")), F.lit("")) if nan_distinct else None
    rows = rows.select("root_id", value(graph, graph.root, F.col("v"), on_null_required, place).alias("v"))
    if scope == "global":
        return _by_groups(rows, graph, "global")
    if strategy == "row":
        return Container(graph, rows=_within_rows(rows, graph))
    if strategy == "shuffle":
        return _by_groups(rows, graph, "root")
    others = [t for t in graph.by_name if t != graph.root]
    most = F.greatest(F.lit(0), F.lit(0), *(F.size(occurrences(graph, graph.root, t, F.col("v"))) for t in others))
    small = _within_rows(rows.where(most <= row_limit), graph)
    large = _by_groups(rows.where(most > row_limit), graph, "root").rows
    return Container(graph, rows=small.unionByName(large))


def _within_rows(rows: DataFrame, graph: Graph) -> DataFrame:
    lists = graph.lists
    paths = {t: only_path(graph, t) for t in lists}
    several = [t for t in lists if paths[t] is None]
    # names of their own: in one select, a list's name would mean the new column
    found = {t: F.array_distinct(occurrences(graph, graph.root, t, F.col("v"))).alias(f"values of {lists[t]}") for t in several}
    entities = rows.select("root_id", "v", *found.values())

    def place(t: str, x: Column) -> Column:
        return F.lit(0) if paths[t] is not None else (F.array_position(F.col(f"`values of {lists[t]}`"), x) - 1).cast("int")

    def entries(t: str) -> Column:
        if paths[t] is None:
            return F.transform(f"`values of {lists[t]}`", lambda x: flat_row(graph, t, x, place))
        x = F.col("v")
        for p in paths[t]:
            x = x[p.name]
        none = F.array().cast(T.ArrayType(row_schema(graph, t)))
        return F.when(x.isNotNull(), F.array(flat_row(graph, t, x, place))).otherwise(none)

    return entities.select("root_id", F.lit(0).alias("root_index"), *(entries(t).alias(lists[t]) for t in lists))


def _by_groups(rows: DataFrame, graph: Graph, scope: str) -> Container:
    scoped = ["root_id"] if scope == "root" else []
    if not scoped:
        # the input is worked out once, and not for each type again
        rows = shared_table(rows, "roots")
    entities: dict[str, DataFrame] = {}
    for t in graph.lists:
        found = F.array("v") if t == graph.root else occurrences(graph, graph.root, t, F.col("v"))
        occurring = rows.select("root_id", F.posexplode(found).alias("pos", "v"))
        first = F.min("pos") if scoped else F.min(F.struct("root_id", "pos"))
        distinct = occurring.groupBy(*scoped, "v").agg(first.alias("first"))
        if scoped:
            distinct = distinct.withColumn("idx", F.row_number().over(Window.partitionBy("root_id").orderBy("first")) - 1)
        else:
            distinct = dense_index(distinct, "first")
        entities[t] = distinct.select(*scoped, "idx", "v", *_keys("v", spark_type(graph, t)))
    frames = {graph.lists[t]: _linked(entities, graph, t, scoped) for t in graph.lists}
    if scoped:
        roots = rows.select("root_id", F.lit(0).alias("root_index"))
    else:
        own = entities[graph.root].select("k1", "k2", F.col("idx").alias("root_index"))
        roots = rows.select("root_id", *_keys("v", spark_type(graph, graph.root))).join(own, ["k1", "k2"]).select("root_id", "root_index")
    return Container(graph, frames=frames, roots=roots, scope=scope)


def _digest(x: Column, kind: T.DataType, seed: int) -> Column:
    """A 64-bit hash of a value in which nulls and ends of arrays count; Spark's own hash of nested values skips them."""
    if isinstance(kind, T.StructType):
        found = F.xxhash64(F.lit(seed), *(_digest(x[f.name], f.dataType, seed) for f in kind))
    elif isinstance(kind, T.ArrayType):
        found = F.xxhash64(F.lit(seed), F.size(x), F.transform(x, lambda y: _digest(y, kind.elementType, seed)))
    else:
        found = F.xxhash64(F.lit(seed), x)
    return F.when(x.isNull(), F.lit(0).cast("long")).otherwise(found)


def _keys(value: str, kind: T.DataType) -> list[Column]:
    """Two hashes that stand for a value in joins, so that a target's values aren't shuffled: every value that is looked up is
    among the target's entities, and two of n entities clash with a probability of n * n / 2 ** 129. A null has none."""
    x = F.col(value)
    return [F.when(x.isNotNull(), _digest(x, kind, seed)).alias(f"k{seed}") for seed in (1, 2)]


def _linked(entities: dict[str, DataFrame], graph: Graph, t: str, scoped: list[str]) -> DataFrame:
    """Frame of a type, each reference replaced by a join on the keys of the value it refers to."""
    node, key = graph.by_name[t], [*scoped, "k1", "k2"]
    out, columns = entities[t].select(*scoped, "idx", "v"), []
    for i, p in enumerate(node.props):
        x = F.col("v")[p.name]
        if p.kind in (PropKind.SIMPLE, PropKind.INLINED):
            columns.append(plain(p, x).alias(p.column))
            continue
        target, keys = entities[p.target].select(*key, F.col("idx").alias(f"_{i}")), _keys("_x", spark_type(graph, p.target))
        if p.kind is PropKind.NORMALIZED:
            out = out.withColumn("_x", x).select("*", *keys).join(target, key, "left").drop("_x", "k1", "k2")
            columns.append(F.col(f"_{i}").alias(p.column))
        else:
            each = entities[t].select(*scoped, "idx", F.posexplode(x).alias("_pos", "_x")).select(*scoped, "idx", "_pos", *keys)
            gathered = each.join(target, key, "left").groupBy(*scoped, "idx").agg(F.array_sort(F.collect_list(F.struct("_pos", F.col(f"_{i}").alias("_k")))).alias("_all"))
            gathered = gathered.select(*scoped, "idx", F.transform("_all", lambda y: y["_k"]).alias(f"_{i}"))
            out = out.join(gathered, [*scoped, "idx"], "left")
            columns.append(F.coalesce(F.col(f"_{i}"), F.array().cast("array<int>")).alias(p.column))
    return out.select(*scoped, "idx", *columns)
