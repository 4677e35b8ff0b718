"""Decoding result rows into dataclasses."""

from __future__ import annotations

import dataclasses
import math
import types
import typing
import uuid
from typing import Any

from ledgerfold.errors import FromRowError
from ledgerfold.functions.values import Json, type_of

_NAMES = {uuid.UUID: "Uuid", bool: "Bool", int: "Integer", float: "Float", str: "Text", bytes: "Blob", Json: "Json"}


def _convert(value: Any, kind: Any, column: str) -> Any:
    if kind is Any:
        return value
    options = typing.get_args(kind) if typing.get_origin(kind) in (typing.Union, types.UnionType) else ()
    if options:
        if value is None and type(None) in options:
            return None
        kind = next(k for k in options if k is not type(None))
    if kind is int and isinstance(value, float) and math.isfinite(value) and -(2.0**63) <= value <= 2.0**63:
        return max(-(1 << 63), min((1 << 63) - 1, int(value)))
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if isinstance(value, kind) and not (kind is int and isinstance(value, bool)):
        return value
    raise FromRowError(f"invalid value for column {column}: expected {_NAMES.get(kind, kind)}, got {type_of(value).name.title()}")


def decode_rows(result: Any, record: type) -> list:
    """Each row as ``record``, a dataclass; ``metadata={"column": name}`` renames a field."""
    names = [c.name for c in result.columns]
    hints = typing.get_type_hints(record)
    places = []
    for f in dataclasses.fields(record):
        column = f.metadata.get("column", f.name)
        if column not in names:
            raise FromRowError(f"missing column {column}")
        if names.count(column) > 1:
            raise FromRowError(f"duplicate column {column}")
        places.append((f.name, names.index(column), hints[f.name], column))
    return [record(**{name: _convert(row[at], kind, column) for name, at, kind, column in places}) for row in result.rows]
