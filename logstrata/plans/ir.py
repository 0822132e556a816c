"""What statements become: small immutable records."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from logstrata.types import ColumnDef


@dataclass(frozen=True)
class Literal:
    value: Any
    text: str = ""


@dataclass(frozen=True)
class Param:
    """A placeholder, numbered from 1, that is bound to a literal before planning."""

    number: int
    text: str = ""


@dataclass(frozen=True)
class ColumnRef:
    name: str
    text: str = ""


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any
    text: str = ""


@dataclass(frozen=True)
class Negate:
    operand: Any
    text: str = ""


@dataclass(frozen=True)
class Aggregate:
    function: str
    column: str | None  # None: COUNT(*)
    text: str = ""


@dataclass(frozen=True)
class Star:
    text: str = "*"


@dataclass(frozen=True)
class Projection:
    expr: Any
    alias: str


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    value: Any  # a Literal or a Param


@dataclass(frozen=True)
class IsNull:
    column: str
    negated: bool


@dataclass(frozen=True)
class InList:
    column: str
    values: tuple
    negated: bool


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class OrderTerm:
    field: str
    descending: bool


@dataclass(frozen=True)
class Select:
    table: str
    projections: tuple[Projection, ...]
    where: Any = None
    group_by: tuple[str, ...] = ()
    order_by: tuple[OrderTerm, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class Eval:
    projections: tuple[Projection, ...]


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...]
    if_not_exists: bool = False


@dataclass(frozen=True)
class RenameTable:
    name: str
    new_name: str
    if_exists: bool = False


@dataclass(frozen=True)
class RenameColumn:
    table: str
    name: str
    new_name: str
    if_exists: bool = False


@dataclass(frozen=True)
class DropTable:
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class Insert:
    table: str
    rows: tuple[tuple, ...] = field(default=())


@dataclass(frozen=True)
class ShowTables:
    pass


@dataclass(frozen=True)
class Describe:
    name: str


def tag(command: Any) -> str:
    """The name a client is told for a command."""
    names = {CreateTable: "CREATE TABLE", RenameTable: "ALTER TABLE", RenameColumn: "ALTER TABLE", DropTable: "DROP TABLE", Insert: "INSERT"}
    return names.get(type(command), "SELECT")
