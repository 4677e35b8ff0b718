"""Statements and expressions, as data."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ledgerfold.functions.values import ValueType


@dataclass(frozen=True)
class QueryColumn:
    table: str
    column: str
    alias: str | None = None  # kept by the extended profile only


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class ColumnRef:
    column: QueryColumn


@dataclass(frozen=True)
class Comparison:
    op: str  # = <> < <= > >=
    left: Any
    right: Any


@dataclass(frozen=True)
class IsNull:
    expr: Any


@dataclass(frozen=True)
class IsNotNull:
    expr: Any


@dataclass(frozen=True)
class And:
    left: Any
    right: Any


@dataclass(frozen=True)
class Or:
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    expr: Any


@dataclass(frozen=True)
class InList:
    expr: Any
    items: tuple
    negated: bool = False


@dataclass(frozen=True)
class InSubquery:
    expr: Any
    subquery: Select


@dataclass(frozen=True)
class Exists:
    """True for every row if the subquery has any; or, of an expression, if it is true."""

    expr: Any


@dataclass(frozen=True)
class Like:
    expr: Any
    pattern: Any


@dataclass(frozen=True)
class Placeholder:
    name: str


@dataclass(frozen=True)
class Join:
    kind: str  # inner left right full
    table: str
    on: Any
    alias: str | None = None


@dataclass(frozen=True)
class Aggregate:
    function: str  # count sum avg min max
    columns: tuple[QueryColumn, ...] = ()  # none: COUNT(*)
    distinct: bool = False
    alias: str | None = None

    @property
    def name(self) -> str:
        if self.alias:
            return self.alias
        inner = ", ".join(c.column for c in self.columns) or "*"
        return f"{self.function}({'DISTINCT ' if self.distinct else ''}{inner})"


@dataclass(frozen=True)
class OrderBy:
    by: QueryColumn
    descending: bool = False


@dataclass(frozen=True)
class From:
    table: str
    joins: tuple[Join, ...] = ()
    alias: str | None = None


@dataclass(frozen=True)
class Select:
    source: From
    projection: tuple[QueryColumn, ...] = ()
    predicate: Any = None
    aggregates: tuple[Aggregate, ...] = ()
    group_by: tuple[QueryColumn, ...] = ()
    order_by: tuple[OrderBy, ...] = ()
    limit: int | None = None
    offset: int | None = None
    having: Any = None
    distinct: bool = False
    #: Projection and aggregates in the order written; empty means projection, then aggregates.
    items: tuple = ()


#: Stands for DEFAULT among a row's values.
DEFAULT = object()


@dataclass(frozen=True)
class Insert:
    """Values in column order; a short row whose first column is the key gets a generated one."""

    table: str
    row: tuple
    returning: tuple[str, ...] | None = None


@dataclass(frozen=True)
class InsertValues:
    table: str
    columns: tuple[str, ...]
    values: tuple
    returning: tuple[str, ...] | None = None
    more: tuple[tuple, ...] = ()  # further tuples, for the extended profile


@dataclass(frozen=True)
class Assignment:
    column: QueryColumn
    value: Any


@dataclass(frozen=True)
class Update:
    source: From
    assignments: tuple[Assignment, ...]
    predicate: Any = None
    returning: tuple[QueryColumn, ...] | None = None


@dataclass(frozen=True)
class Delete:
    source: From
    predicate: Any = None
    returning: tuple[QueryColumn, ...] | None = None


@dataclass(frozen=True)
class ColumnSchema:
    name: str
    type: ValueType
    default: Any = None
    primary_key: bool = False


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: tuple[ColumnSchema, ...]


@dataclass(frozen=True)
class IndexSchema:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class CreateTable:
    schema: TableSchema
    if_not_exists: bool = False
    indexes: tuple[IndexSchema, ...] = ()


@dataclass(frozen=True)
class DropTable:
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class AddColumn:
    column: ColumnSchema


@dataclass(frozen=True)
class DropColumn:
    name: str


@dataclass(frozen=True)
class RenameColumn:
    old: str
    new: str


@dataclass(frozen=True)
class RenameTable:
    new: str


@dataclass(frozen=True)
class AlterTable:
    table: str
    operations: tuple
    if_exists: bool = False


@dataclass(frozen=True)
class CreateIndex:
    index: IndexSchema
    if_not_exists: bool = False
    #: SQL returns early on an index that exists; the programmatic form makes it anew.
    from_sql: bool = False


@dataclass(frozen=True)
class DropIndex:
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class RenameIndex:
    old: str
    new: str


@dataclass
class ResultColumn:
    name: str
    source_table: str | None = None
    source_column: str | None = None


@dataclass
class QueryResult:
    """Rows of a statement in order, with where each column comes from."""

    rows: list[tuple] = field(default_factory=list)
    columns: list[ResultColumn] = field(default_factory=list)

    def rows_as(self, record: type) -> list:
        from ledgerfold.functions.records import decode_rows

        return decode_rows(self, record)
