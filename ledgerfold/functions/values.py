"""Dynamically typed values: nine types, a total order across them, JSON, UUIDs.

Values are plain Python objects: None, ValueType, uuid.UUID, bool, int, float,
str, Json and bytes. The order compares types by rank first; floats compare by
their bits, so that negative zero isn't zero and every float with the sign bit
set sorts above all others.
"""

from __future__ import annotations

import json
import os
import struct
import time
import uuid
from collections.abc import Callable
from enum import IntEnum
from typing import Any

from ledgerfold.errors import MissingTimestampProvider


class ValueType(IntEnum):
    NULL = 0
    TYPE = 1
    UUID = 2
    BOOL = 3
    INTEGER = 4
    FLOAT = 5
    TEXT = 6
    JSON = 7
    BLOB = 8


class Json:
    """A JSON document. Equal if structurally equal; ordered by its shown form."""

    __slots__ = ("data",)

    def __init__(self, data: Any):
        self.data = data

    @classmethod
    def parse(cls, text: str) -> Json:
        return cls(json.loads(text))

    def __str__(self) -> str:
        return show_json(self.data)

    def __repr__(self) -> str:
        return f"Json({self.data!r})"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Json) and str(self) == str(other)

    def __hash__(self) -> int:
        return hash(str(self))


def show_json(data: Any) -> str:
    """Sorted keys, ``, `` and ``: `` between parts, strings unescaped; whole floats without a fraction."""
    if data is None:
        return "null"
    if isinstance(data, bool):
        return "true" if data else "false"
    if isinstance(data, int):
        return str(data)
    if isinstance(data, float):
        return str(int(data)) if data == data and abs(data) < 1e16 and data == int(data) and not (data == 0 and str(data)[0] == "-") else repr(data)
    if isinstance(data, str):
        return f'"{data}"'
    if isinstance(data, (list, tuple)):
        return "[" + ", ".join(map(show_json, data)) + "]"
    return "{" + ", ".join(f'"{k}": {show_json(data[k])}' for k in sorted(data)) + "}"


def type_of(value: Any) -> ValueType:
    if value is None:
        return ValueType.NULL
    if isinstance(value, ValueType):
        return ValueType.TYPE
    if isinstance(value, uuid.UUID):
        return ValueType.UUID
    if isinstance(value, bool):
        return ValueType.BOOL
    if isinstance(value, int):
        return ValueType.INTEGER
    if isinstance(value, float):
        return ValueType.FLOAT
    if isinstance(value, str):
        return ValueType.TEXT
    if isinstance(value, Json):
        return ValueType.JSON
    if isinstance(value, (bytes, bytearray)):
        return ValueType.BLOB
    raise TypeError(f"no value type for {type(value).__name__}")


def float_bits(x: float) -> int:
    return struct.unpack("<Q", struct.pack("<d", x))[0]


def order_key(value: Any) -> tuple:
    """A key that sorts values in the engine's order; equal keys mean equal values."""
    kind = type_of(value)
    if value is None:
        return (0,)
    if kind == ValueType.FLOAT:
        return kind.value, float_bits(value)
    if kind == ValueType.UUID:
        return kind.value, value.bytes
    if kind == ValueType.TEXT:
        return kind.value, value.encode("utf-8", "surrogatepass")
    if kind == ValueType.JSON:
        return kind.value, str(value)
    if kind == ValueType.BLOB:
        return kind.value, bytes(value)
    return kind.value, int(value)


def values_equal(a: Any, b: Any) -> bool:
    return order_key(a) == order_key(b)


#: Milliseconds since the epoch, or None where no clock is to be had.
Clock = Callable[[], "int | None"]


def system_clock() -> int:
    return time.time_ns() // 1_000_000


def uuid7(clock: Clock | None) -> uuid.UUID:
    """A version-7 UUID of the clock's time."""
    now = clock() if clock else None
    if now is None:
        raise MissingTimestampProvider
    noise = int.from_bytes(os.urandom(10), "big")
    bits = (now & (1 << 48) - 1) << 80 | 7 << 76 | (noise >> 62 & 0xFFF) << 64 | 2 << 62 | noise & (1 << 62) - 1
    return uuid.UUID(int=bits)


def key_uuid(key: int) -> str:
    """The row id of an integer key: all 64 bits, negative keys under a lower version digit, so that ids are ordered as keys are."""
    digits = f"{key & (1 << 63) - 1:016x}"
    return f"00000000-0000-{'6' if key < 0 else '7'}00{digits[0]}-8{digits[1:4]}-{digits[4:]}"


def first_key(row_id: str) -> int:
    """The least 64-bit key whose id isn't below ``row_id``; one more than the greatest key if there is none."""
    low, high = -(1 << 63), 1 << 63
    while low < high:
        middle = (low + high) // 2
        if key_uuid(middle) < row_id:
            low = middle + 1
        else:
            high = middle
    return low


def to_plain(value: Any) -> Any:
    """A JSON-able form that from_plain() reads back."""
    kind = type_of(value)
    if kind == ValueType.FLOAT:
        return [kind.value, str(float_bits(value))]
    if kind in (ValueType.UUID, ValueType.JSON):
        return [kind.value, str(value) if kind == ValueType.UUID else json.dumps(value.data)]
    if kind == ValueType.BLOB:
        return [kind.value, bytes(value).hex()]
    return [kind.value, value if kind != ValueType.TYPE else int(value)]


def from_plain(plain: Any) -> Any:
    kind, value = ValueType(plain[0]), plain[1]
    if kind == ValueType.FLOAT:
        return struct.unpack("<d", struct.pack("<Q", int(value)))[0]
    if kind == ValueType.UUID:
        return uuid.UUID(value)
    if kind == ValueType.JSON:
        return Json.parse(value)
    if kind == ValueType.BLOB:
        return bytes.fromhex(value)
    return ValueType(value) if kind == ValueType.TYPE else value
