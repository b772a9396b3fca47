"""Queries as data: both the SQL text and the typed builder end here."""

from __future__ import annotations

from dataclasses import dataclass, field

BIGINT, TEXT, BOOLEAN, DOUBLE = "BIGINT", "TEXT", "BOOLEAN", "DOUBLE"
SPARK = {BIGINT: "bigint", TEXT: "string", BOOLEAN: "boolean", DOUBLE: "double"}
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


@dataclass(frozen=True)
class Col:
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Lit:
    value: int | str | bool | None
    type: str


@dataclass(frozen=True)
class Op:
    """Arithmetic, comparison, AND, OR, NOT, IS NULL, IS NOT NULL."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Case:
    whens: tuple[tuple, ...]
    otherwise: object = None


@dataclass(frozen=True)
class Agg:
    """COUNT with no argument counts rows."""

    name: str
    arg: object = None


@dataclass(frozen=True)
class Scan:
    table: str
    alias: str


@dataclass(frozen=True)
class Join:
    left: object
    right: Scan
    #: Pairs of columns, the left side's first.
    on: tuple[tuple[Col, Col], ...]


@dataclass(frozen=True)
class Query:
    source: object
    select: tuple[tuple[str, object], ...]
    where: object = None
    keys: tuple = ()
    grouped: bool = False
    having: object = None
    distinct: bool = False

    def scans(self) -> list[Scan]:
        out, s = [], self.source
        while isinstance(s, Join):
            out.append(s.right)
            s = s.left
        return [s, *reversed(out)]


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    nullable: bool = True


@dataclass
class Catalog:
    """Tables by name; a table is a tuple of fields, fixed once declared."""

    tables: dict[str, tuple[Field, ...]] = field(default_factory=dict)

    def declare(self, name: str, fields: list[Field] | tuple[Field, ...]) -> None:
        from plumbago.errors import Refused

        if not fields:
            raise Refused("EmptySchema", name)
        if len({f.name for f in fields}) < len(fields):
            raise Refused("DuplicateColumn", name)
        for f in fields:
            if f.type == DOUBLE:
                raise Refused("TypeNotStorable", f"{name}.{f.name} {f.type}")
            if f.type not in SPARK:
                raise Refused("UnknownType", f"{name}.{f.name} {f.type}")
        if self.tables.get(name, tuple(fields)) != tuple(fields):
            raise Refused("TableRedeclared", name)
        self.tables[name] = tuple(fields)
