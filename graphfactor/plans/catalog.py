"""Entity types: their fields, and how they refer to each other."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

from ..functions.naming import pascal_case


class PropertyMode(Enum):
    INCLUDE_ALL = 0
    EXPLICIT_ONLY = 1


class PropKind(Enum):
    SIMPLE = "simple"
    NORMALIZED = "normalized"
    COLLECTION = "collection"
    INLINED = "inlined"


@dataclass(frozen=True)
class Field:
    """A field as declared: of a Spark type, or (target) one or many entities."""

    name: str
    dtype: T.DataType | None = None
    target: str | None = None
    many: bool = False
    nullable: bool = True
    distinct: bool = False  # a collection with set semantics
    metadata: Mapping = field(default_factory=dict, compare=False)


_BY_NAME = {
    "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(),
    "tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(),
}


def simple(name: str, dtype: str | T.DataType, nullable: bool = True, **metadata) -> Field:
    """A field of a Spark type, given as such or by name; names of nested types need a running session."""
    if isinstance(dtype, str):
        dtype = _BY_NAME.get(dtype) or T._parse_datatype_string(dtype)
    return Field(name, dtype, nullable=nullable, metadata=metadata)


def ref(name: str, target: str, nullable: bool = True, **metadata) -> Field:
    return Field(name, target=target, nullable=nullable, metadata=metadata)


def many(name: str, target: str, distinct: bool = False, **metadata) -> Field:
    return Field(name, target=target, many=True, distinct=distinct, metadata=metadata)


class TypeCatalog:
    """Entity types by full name, each an ordered list of fields."""

    def __init__(self, types: Mapping[str, Sequence[Field]]):
        self.types = {name: list(fields) for name, fields in types.items()}
        for name, fields in self.types.items():
            for f in fields:
                if f.target is not None and f.target not in self.types:
                    raise ValueError(f"{name}.{f.name} refers to an unknown type {f.target}")

    def __getitem__(self, name: str) -> list[Field]:
        return self.types[name]

    def __contains__(self, name: str) -> bool:
        return name in self.types

    def __iter__(self) -> Iterator[str]:
        return iter(self.types)

    @staticmethod
    def from_schema(root: str, schema: T.StructType) -> TypeCatalog:
        """Types of a nested schema, the outermost struct being ``root``.

        A struct field (or array of structs) names its type in metadata "entity"; else structs of the same structure
        are one type, named after the first field that has it. Arrays whose metadata has collection="set" have set
        semantics. Maps, binaries, arrays of scalars and arrays of arrays are simple values. Variants can't be grouped.
        """
        types: dict[str, list[Field]] = {}
        by_shape: dict[str, str] = {}

        def named(f: T.StructField, struct: T.StructType) -> str:
            name = f.metadata.get("entity")
            if not name:
                shape = struct.simpleString()
                name = by_shape.get(shape)
                if not name:
                    name = pascal_case(f.name)
                    while name in types:
                        name += "_"
            by_shape.setdefault(struct.simpleString(), name)
            walk(name, struct)
            return name

        def walk(name: str, struct: T.StructType) -> None:
            if name in types:
                if [f.name for f in types[name]] != struct.names:
                    raise ValueError(f"entity {name} stands for structs with different fields: {[f.name for f in types[name]]} and {struct.names}")
                return
            types[name] = fields = []
            for f in struct.fields:
                if isinstance(f.dataType, T.StructType):
                    fields.append(Field(f.name, f.dataType, named(f, f.dataType), nullable=f.nullable, metadata=f.metadata))
                elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                    fields.append(Field(f.name, f.dataType, named(f, f.dataType.elementType), many=True, nullable=f.nullable, distinct=f.metadata.get("collection") == "set", metadata=f.metadata))
                elif isinstance(f.dataType, T.VariantType):
                    raise ValueError(f"{name}.{f.name}: values of type variant can't be compared")
                else:
                    fields.append(Field(f.name, f.dataType, nullable=f.nullable, metadata=f.metadata))

        walk(root, schema)
        return TypeCatalog(types)
