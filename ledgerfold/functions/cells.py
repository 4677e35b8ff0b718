"""Values as Spark columns, and the engine's comparisons on them.

A column whose cells all have one type is a plain Spark column with a statically
known rank; comparing ranks is then decided while the plan is built, no cast is
ever inserted, and native comparisons reach the file scan. Columns of mixed types
hold tagged cells and compare by a CASE over the tag.

Comparisons here are null where an operand is null. Under a filter's root that
drops the row as false does; elsewhere truth() makes it false.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerfold.functions.values import Json, ValueType, first_key, key_uuid, type_of

CELL = "struct<t:tinyint,b:boolean,i:bigint,d:double,s:string,x:binary>"
#: Where each type's payload lies in a cell.
FIELD = {
    ValueType.TYPE: "i",
    ValueType.UUID: "s",
    ValueType.BOOL: "b",
    ValueType.INTEGER: "i",
    ValueType.FLOAT: "d",
    ValueType.TEXT: "s",
    ValueType.JSON: "s",
    ValueType.BLOB: "x",
}
SPARK_TYPE = {
    ValueType.NULL: "void",
    ValueType.TYPE: "tinyint",
    ValueType.UUID: "string",
    ValueType.BOOL: "boolean",
    ValueType.INTEGER: "bigint",
    ValueType.FLOAT: "double",
    ValueType.TEXT: "string",
    ValueType.JSON: "string",
    ValueType.BLOB: "binary",
}


@dataclass(frozen=True)
class Typed:
    """A column with its rank: a ValueType, None for tagged cells, or OPAQUE.

    ``literal`` holds the value of a constant. OPAQUE columns (timestamps,
    arrays) come from registered files; they can be selected but not compared.
    ``key`` is the integer key that the ids of a registered file were made of; it is null
    for rows that come from elsewhere, which ``mixed`` says there may be.
    """

    col: Column
    rank: ValueType | None
    literal: Any = None
    opaque: bool = False
    key: Column | None = None
    mixed: bool = False


def payload(value: Any) -> Any:
    """What Spark holds for a value."""
    kind = type_of(value)
    if kind in (ValueType.UUID, ValueType.JSON):
        return str(value)
    if kind == ValueType.BLOB:
        return bytearray(value)
    return int(value) if kind == ValueType.TYPE else value


def cell_tuple(value: Any) -> tuple:
    """A cell for createDataFrame."""
    kind = type_of(value)
    out: dict[str, Any] = {"b": None, "i": None, "d": None, "s": None, "x": None}
    if kind != ValueType.NULL:
        out[FIELD[kind]] = payload(value)
    return (int(kind), *out.values())


def cell_value(cell: Any) -> Any:
    """The value of a collected cell."""
    if cell is None or cell["t"] == ValueType.NULL:
        return None
    kind = ValueType(cell["t"])
    return plain_value(cell[FIELD[kind]], kind)


def plain_value(x: Any, kind: ValueType) -> Any:
    """The value of a collected payload of a known type."""
    if x is None:
        return None
    if kind == ValueType.UUID:
        return uuid.UUID(x)
    if kind == ValueType.JSON:
        return Json.parse(x)
    if kind == ValueType.BLOB:
        return bytes(x)
    if kind == ValueType.TYPE:
        return ValueType(x)
    return x


def literal(value: Any) -> Typed:
    kind = type_of(value)
    if kind == ValueType.NULL:
        return Typed(F.lit(None), kind)
    return Typed(F.lit(payload(value)).cast(SPARK_TYPE[kind]), kind, value)


def to_cell(x: Typed) -> Column:
    """A typed column as tagged cells; null becomes a cell of type NULL."""
    if x.rank is None:
        return x.col
    fields = [
        (x.col if x.rank != ValueType.NULL and FIELD[x.rank] == f else F.lit(None)).cast(t).alias(f)
        for f, t in (("b", "boolean"), ("i", "bigint"), ("d", "double"), ("s", "string"), ("x", "binary"))
    ]
    return F.struct(F.when(x.col.isNull(), F.lit(0)).otherwise(F.lit(int(x.rank))).cast("tinyint").alias("t"), *fields)


def from_cell(cell: Column, kind: ValueType) -> Column:
    """The payload of cells that are all of one type (or null)."""
    return cell[FIELD[kind]].cast(SPARK_TYPE[kind])


def is_null(x: Typed) -> Column:
    return (x.col.isNull() | (x.col["t"] == 0)) if x.rank is None else x.col.isNull()


def negative(x: Column) -> Column:
    """Whether the sign bit is set, of negative zero too."""
    return (x < 0) | ((x == 0) & x.cast("string").startswith("-"))


def float_key(x: Column) -> Column:
    """A struct that sorts doubles as their bits read as unsigned integers do."""
    return F.when(x.isNotNull(), F.struct(negative(x).alias("neg"), F.abs(x).alias("size")))


def order_columns(x: Typed) -> list[Column]:
    """Columns that sort in the engine's order."""
    if x.rank is None:
        c = x.col
        return [F.coalesce(c["t"], F.lit(0).cast("tinyint")), c["b"], c["i"], float_key(c["d"]), c["s"], c["x"]]
    return [float_key(x.col)] if x.rank == ValueType.FLOAT else [x.col]


_NATIVE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
_PYTHON = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
FLIPPED = {"=": "=", "<>": "<>", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _compare_float(op: str, a: Typed, b: Typed) -> Column:
    if a.literal is not None and b.literal is None:
        return _compare_float(FLIPPED[op], b, a)
    x, c = a.col, b.literal
    if c is not None and c == c and c > 0:
        # Against a positive constant: native comparisons, which the scan can use.
        if op in ("=", "<>"):
            return _NATIVE[op](x, b.col)
        if op in (">", ">="):
            return _NATIVE[op](x, b.col) | negative(x)
        return _NATIVE[op](x, b.col) & ~negative(x)
    return _NATIVE[op](float_key(x), float_key(b.col))


def _compare_key(op: str, a: Typed, b: Typed) -> Column:
    """Ids made of integer keys against a constant id: a test of the keys, which the scan can use, and of ids where there is no key."""
    first = first_key(str(b.literal))
    exact = first < 1 << 63 and key_uuid(first) == str(b.literal)
    if op in ("=", "<>"):
        of_key = _NATIVE[op](a.key, F.lit(first)) if exact else (F.lit(False) if op == "=" else a.key.isNotNull())
    elif op in ("<", ">="):
        of_key = _NATIVE[op](a.key, F.lit(first)) if first < 1 << 63 else (a.key.isNotNull() if op == "<" else F.lit(False))
    else:
        last = first if exact else first - 1  # the greatest key whose id isn't above
        of_key = _NATIVE[op](a.key, F.lit(last)) if last >= -(1 << 63) else (F.lit(False) if op == "<=" else a.key.isNotNull())
    return by_key(of_key, a.key, _NATIVE[op](a.col, b.col)) if a.mixed else of_key


def by_key(of_key: Column, key: Column, of_id: Column) -> Column:
    """``of_key`` where there is a key, else ``of_id``; the first part alone can be pushed to the scan."""
    return (of_key | key.isNull()) & (of_key | of_id)


def _cell_key(x: Typed) -> Column:
    """A struct of what tells values apart, null for null: equal exactly where values are, so that joins can hash it."""
    c = to_cell(x)
    return F.when(c["t"] != 0, F.struct(c["t"].alias("t"), c["b"].alias("b"), c["i"].alias("i"), float_key(c["d"]).alias("d"), c["s"].alias("s"), c["x"].alias("x")))


def compare(op: str, a: Typed, b: Typed) -> Column:
    """``a op b`` in the engine's order, null where either side is null."""
    if ValueType.NULL in (a.rank, b.rank):
        return F.lit(None).cast("boolean")
    if a.rank is not None and b.rank is not None:
        if a.rank != b.rank:
            # The ranks decide; no cast, no look at the values.
            both = F.lit(True)
            for side in (a, b):
                if side.literal is None:
                    both = both & side.col.isNotNull()
            return both if _PYTHON[op](a.rank, b.rank) else F.lit(False)
        if a.rank == ValueType.FLOAT:
            return _compare_float(op, a, b)
        if a.key is not None and b.literal is not None:
            return _compare_key(op, a, b)
        if b.key is not None and a.literal is not None:
            return _compare_key(FLIPPED[op], b, a)
        return _NATIVE[op](a.col, b.col)
    if op == "=":
        return _cell_key(a) == _cell_key(b)
    x, y = to_cell(a), to_cell(b)
    same = None
    for field in ("b", "i", "d", "s", "x"):
        kinds = [int(k) for k, f in FIELD.items() if f == field]
        l, r = x[field], y[field]
        test = _NATIVE[op](float_key(l), float_key(r)) if field == "d" else _NATIVE[op](l, r)
        same = F.when(x["t"].isin(kinds), test) if same is None else same.when(x["t"].isin(kinds), test)
    value = F.when(x["t"] == y["t"], same).otherwise(_NATIVE[op](x["t"], y["t"]))
    return F.when((x["t"] != 0) & (y["t"] != 0), value)


def same_value(a: Typed, b: Typed) -> Column:
    """For a filter: whether a column has a constant's value, null equalling null. Bare, so that the scan can use it."""
    return is_null(a) if b.rank == ValueType.NULL else compare("=", a, b)


def rank_of_type(kind: T.DataType) -> ValueType | None:
    """The rank of a registered file's column, or None if the engine has no such type."""
    if isinstance(kind, T.BooleanType):
        return ValueType.BOOL
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return ValueType.INTEGER
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return ValueType.FLOAT
    if isinstance(kind, T.StringType):
        return ValueType.TEXT
    if isinstance(kind, T.BinaryType):
        return ValueType.BLOB
    return None
