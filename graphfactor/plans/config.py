"""Which types and fields take part: a fluent configuration, evaluated eagerly on the driver."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from .catalog import PropertyMode, TypeCatalog


@dataclass
class TypeOptions:
    ignored: set[str] = field(default_factory=set)
    included: set[str] = field(default_factory=set)
    normalized: set[str] = field(default_factory=set)
    inlined: set[str] = field(default_factory=set)
    key: str | None = None
    mode: PropertyMode | None = None


class ConfigError(ValueError):
    """A configuration that can't be compiled."""


class TypeBuilder:
    """Options of one type. Every method returns the builder."""

    def __init__(self, options: TypeOptions):
        self._options = options

    def ignore(self, *names: str) -> TypeBuilder:
        """Leave fields out of the rows and of their equality."""
        self._options.ignored.update(names)
        return self

    def include(self, *names: str) -> TypeBuilder:
        """Fields that take part under PropertyMode.EXPLICIT_ONLY."""
        self._options.included.update(names)
        return self

    def normalize(self, *names: str) -> TypeBuilder:
        """Fields whose type is extracted even where types are inlined or not discovered."""
        self._options.normalized.update(names)
        return self

    def inline(self, *names: str) -> TypeBuilder:
        """Fields that stay nested although their type is extracted elsewhere."""
        self._options.inlined.update(names)
        return self

    def with_name(self, key: str) -> TypeBuilder:
        """Key of the type in temporary views; the list's name stays."""
        self._options.key = key
        return self

    def use_property_mode(self, mode: PropertyMode) -> TypeBuilder:
        self._options.mode = mode
        return self

    ignore_property, include_property, normalize_property, inline_property = ignore, include, normalize, inline


class GraphBuilder:
    """Options of a graph; they hold for the whole configuration."""

    def __init__(self, config: GraphConfig):
        self._config = config

    def auto_discover(self, on: bool = True) -> GraphBuilder:
        """Whether types that only references lead to are extracted; else only those named by for_type are."""
        self._config.discover = on
        return self

    def inline(self, *types: str) -> GraphBuilder:
        self._config.inlined.update(types)
        return self

    def copy_source_attributes(self) -> GraphBuilder:
        """Carry field metadata over to simple and inlined columns."""
        self._config.copy_metadata = True
        return self

    def use_property_mode(self, mode: PropertyMode) -> GraphBuilder:
        self._config.mode = mode
        return self

    def use_json_naming(self, policy: str = "camelCase") -> GraphBuilder:
        if policy != "camelCase":
            raise ConfigError(f"unknown naming policy {policy}; there is camelCase")
        self._config.camel_case = True
        return self

    def use_reference_tracking_for_cycles(self) -> GraphBuilder:
        """Recognise an object of a cyclic type by its identity before comparing values."""
        self._config.track_references = True
        return self

    def for_type(self, name: str, options: Callable[[TypeBuilder], object] | None = None) -> GraphBuilder:
        self._config.for_type(name, options)
        return self


class GraphConfig:
    """Roots and options over a catalog of types."""

    def __init__(self, catalog: TypeCatalog):
        self.catalog = catalog
        self.roots: list[str] = []
        self.options: dict[str, TypeOptions] = {}
        self.inlined: set[str] = set()
        self.discover = True
        self.copy_metadata = self.camel_case = self.track_references = False
        self.mode = PropertyMode.INCLUDE_ALL

    def _known(self, name: str) -> str:
        if name not in self.catalog:
            raise ConfigError(f"unknown type {name}")
        return name

    def normalize_graph(self, root: str, options: Callable[[GraphBuilder], object] | None = None) -> GraphBuilder:
        if self._known(root) not in self.roots:
            self.roots.append(root)
        graph = GraphBuilder(self)
        if options:
            options(graph)
        return graph

    def for_type(self, name: str, options: Callable[[TypeBuilder], object] | None = None) -> TypeBuilder:
        builder = TypeBuilder(self.options.setdefault(self._known(name), TypeOptions()))
        if options:
            options(builder)
        return builder

    def of(self, name: str) -> TypeOptions:
        return self.options.get(name, TypeOptions())

    def key_of(self, name: str) -> str:
        return self.of(name).key or name.rpartition(".")[2]

    def compile(self, root: str | None = None):
        """The analysed graph of a root (of the only one, if not named); raises on errors, warns on cycles."""
        from .analyze import analyze

        if root is None:
            if len(self.roots) != 1:
                raise ConfigError(f"name one of the roots {self.roots}")
            root = self.roots[0]
        graph = analyze(self, root)
        for d in graph.diagnostics:
            if d.severity == "error":
                raise ConfigError(f"{d.id}: {d.message}")
            if d.severity == "warning":
                warnings.warn(f"{d.id}: {d.message}", stacklevel=2)
        return graph

    def diagnostics(self):
        """Everything that the analysis of all roots has to say, each once."""
        from .analyze import analyze

        return list(dict.fromkeys(d for root in self.roots for d in analyze(self, root).diagnostics))
