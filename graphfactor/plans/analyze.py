"""From a root type to the list of types to extract, leaves first, with every field classified."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..functions.naming import camel_case, index_column, indices_column, list_names, short_name
from .catalog import Field, PropertyMode, PropKind
from .config import ConfigError, GraphConfig


@dataclass(frozen=True)
class Diagnostic:
    id: str
    severity: str
    type: str
    message: str


@dataclass(frozen=True)
class Prop:
    name: str
    kind: PropKind
    field: Field
    target: str | None = None
    circular: bool = False

    @property
    def column(self) -> str:
        if self.kind is PropKind.NORMALIZED:
            return index_column(self.name)
        return indices_column(self.name) if self.kind is PropKind.COLLECTION else self.name

    def json_name(self, camel: bool) -> str:
        """Field metadata "json" wins; else the column's name, in camel case if asked."""
        named = self.field.metadata.get("json")
        return named if named and self.kind in (PropKind.SIMPLE, PropKind.INLINED) else camel_case(self.column) if camel else self.column


@dataclass
class Node:
    name: str
    props: list[Prop]
    circular: bool = False
    #: lies on the path that a back-edge closed: rows are entered before back-edges are followed
    two_phase: bool = False

    def of_kind(self, *kinds: PropKind) -> list[Prop]:
        return [p for p in self.props if p.kind in kinds]

    @property
    def links(self) -> list[Prop]:
        return self.of_kind(PropKind.NORMALIZED, PropKind.COLLECTION)


@dataclass
class Graph:
    root: str
    nodes: list[Node]  # every type after those it refers to
    config: GraphConfig
    diagnostics: list[Diagnostic] = field(default_factory=list)
    nan_distinct: bool = False  # values with NaN equal nothing

    def __post_init__(self) -> None:
        self.by_name = {n.name: n for n in self.nodes}
        self.lists = list_names(self.by_name)

    @property
    def cyclic(self) -> bool:
        return any(p.circular for n in self.nodes for p in n.props)

    def reaches(self, start: str, target: str) -> bool:
        """Whether objects of ``start`` hold objects of ``target``, over one reference or more."""
        seen, open_ = set(), [start]
        while open_:
            for p in self.by_name[open_.pop()].links:
                if p.target == target:
                    return True
                if p.target not in seen:
                    seen.add(p.target)
                    open_.append(p.target)
        return False


def taking_part(config: GraphConfig, name: str) -> list[Field]:
    """Fields left after ignoring, or under explicit mode those included; by option or by metadata "normalize"."""
    options = config.of(name)
    mark = lambda f: f.metadata.get("normalize")
    fields = [f for f in config.catalog[name] if f.name not in options.ignored and mark(f) != "ignore"]
    if (options.mode or config.mode) is PropertyMode.EXPLICIT_ONLY:
        fields = [f for f in fields if f.name in options.included or mark(f) == "include"]
    return fields


def analyze(config: GraphConfig, root: str) -> Graph:
    """Depth first in order of fields. A field whose type is on the current path closes a cycle (a back-edge)."""
    if root not in config.catalog:
        raise ConfigError(f"unknown type {root}")
    nodes: dict[str, Node] = {}
    path: list[str] = []
    notes: list[Diagnostic] = []
    closed: set[str] = set()

    def extracted(owner: str, f: Field) -> bool:
        options = config.of(owner)
        if f.name in options.inlined:
            return False
        if f.name in options.normalized:
            return True
        if f.target in config.inlined:
            return False
        if config.discover or f.target in config.options or f.target in config.roots:
            return True
        notes.append(Diagnostic("DN0004", "info", f.target, f"{short_name(f.target)} is not registered and stays nested"))
        return False

    def visit(name: str) -> None:
        path.append(name)
        props = []
        for f in taking_part(config, name):
            if f.target is None:
                props.append(Prop(f.name, PropKind.SIMPLE, f))
                continue
            circular = f.target in path
            if circular:
                closed.update(path[path.index(f.target) :])
            if not circular and not extracted(name, f):
                if f.dtype is None:
                    raise ConfigError(f"{name}.{f.name} holds object ids, so {f.target} can't stay nested")
                props.append(Prop(f.name, PropKind.INLINED, f, f.target))
                continue
            if not circular and f.target not in nodes:
                visit(f.target)
            props.append(Prop(f.name, PropKind.COLLECTION if f.many else PropKind.NORMALIZED, f, f.target, circular))
        path.pop()
        nodes[name] = Node(name, props)

    visit(root)
    graph = Graph(root, list(nodes.values()), config)
    for n in graph.nodes:
        n.circular, n.two_phase = graph.reaches(n.name, n.name), n.name in closed
        if n.circular:
            notes.append(Diagnostic("DN0001", "warning", n.name, f"{short_name(n.name)} is part of a reference cycle"))
        if not n.props:
            notes.append(Diagnostic("DN0003", "error", n.name, f"{short_name(n.name)} has no fields that take part"))
    graph.diagnostics = list(dict.fromkeys(notes))
    return graph


def has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return has_map(dtype.elementType)
    return isinstance(dtype, T.StructType) and any(has_map(f.dataType) for f in dtype.fields)
