"""Names of lists, columns and JSON fields."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable


def camel_case(name: str) -> str:
    """person for Person, id for ID, xmlParser for XMLParser: of leading capitals all but the one that begins a word."""
    lead = 0
    while lead < len(name) and name[lead].isupper():
        lead += 1
    if lead > 1 and lead < len(name) and name[lead].islower():
        lead -= 1
    return name[:lead].lower() + name[lead:]


def pascal_case(name: str) -> str:
    return "".join(part[:1].upper() + part[1:] for part in name.replace("-", "_").split("_"))


def short_name(full: str) -> str:
    return full.rpartition(".")[2]


def namespace(full: str) -> str:
    return full.rpartition(".")[0]


def row_type(full: str) -> str:
    """Name of the flat form of a type."""
    return ".".join(x for x in (namespace(full), f"Normalized{short_name(full)}") if x)


def container_type(full: str) -> str:
    return row_type(full) + "Result"


def list_names(types: Iterable[str]) -> dict[str, str]:
    """{Type}List by type; types with one short name get their namespace, without dots, before it."""
    types = list(types)
    seen = Counter(map(short_name, types))
    return {t: (namespace(t).replace(".", "") if seen[short_name(t)] > 1 else "") + short_name(t) + "List" for t in types}


def index_column(prop: str) -> str:
    return prop + "Index"


def indices_column(prop: str) -> str:
    return prop + "Indices"
