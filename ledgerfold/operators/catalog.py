"""The catalog: four system tables, kept as small maps in a version's manifest.

Identity is by name. Dropping sets a flag; creating again clears it, and old
rows, columns and indexes of that name come back.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ledgerfold.errors import InvalidQuery
from ledgerfold.functions.values import ValueType, from_plain, to_plain
from ledgerfold.plans import ir

SYSTEM_TABLES = {
    "__engine_tables": "name string, deleted boolean",
    "__engine_table_fields": "table_name string, column_name string, type int, default string, position int, primary_key boolean, deleted boolean",
    "__engine_indices": "name string, table_name string, is_unique boolean, deleted boolean",
    "__engine_index_fields": "index_name string, position int, column_name string, deleted boolean",
}
_MAPS = ("tables", "fields", "indexes", "index_fields")


class Catalog:
    """Reads and writes the catalog maps of one manifest; every entry carries the version that wrote it."""

    def __init__(self, manifest: dict, actor: str):
        self.m, self.actor = manifest, actor

    def _stamp(self, entry: dict) -> dict:
        newest = max((e["v"][0] for name in _MAPS for e in self.m[name].values()), default=0)
        return entry | {"v": [newest + 1, self.actor]}

    # -- reading

    def has_table(self, name: str) -> bool:
        entry = self.m["tables"].get(name)
        return entry is not None and not entry["deleted"]

    def need_table(self, name: str) -> None:
        if not self.has_table(name):
            raise InvalidQuery("Table not found")

    def table_names(self) -> list[str]:
        return sorted(n for n, e in self.m["tables"].items() if not e["deleted"])

    def table_schema(self, name: str) -> ir.TableSchema:
        self.need_table(name)
        own = [(e["position"], k.split("\0")[1], e) for k, e in self.m["fields"].items() if k.split("\0")[0] == name and not e["deleted"]]
        columns = tuple(
            ir.ColumnSchema(column, ValueType(e["type"]), from_plain(e["default"]), e["primary_key"]) for _, column, e in sorted(own, key=lambda x: x[:2])
        )
        return ir.TableSchema(name, columns)

    def index_schema(self, name: str) -> ir.IndexSchema:
        entry = self.m["indexes"].get(name)
        if entry is None or entry["deleted"]:
            raise InvalidQuery("Index not found")
        return self._index(name, entry)

    def _index(self, name: str, entry: dict) -> ir.IndexSchema:
        own = [(int(k.split("\0")[1]), e["column"]) for k, e in self.m["index_fields"].items() if k.split("\0")[0] == name and not e["deleted"]]
        return ir.IndexSchema(name, entry["table"], tuple(c for _, c in sorted(own)), entry["unique"])

    def indexes_of(self, table: str) -> list[ir.IndexSchema]:
        return [self._index(n, e) for n, e in sorted(self.m["indexes"].items()) if not e["deleted"] and e["table"] == table]

    def kinds(self, table: str, column: str) -> set[ValueType]:
        """Types other than null that cells of a column have or may have."""
        return {ValueType(k) for k in self.m["kinds"].get(table, {}).get(column, [])}

    def base(self, table: str) -> dict | None:
        """The registered files that a table starts from."""
        return self.m["bases"].get(table)

    # -- writing

    def saw(self, table: str, column: str, kinds) -> None:
        own = self.m["kinds"].setdefault(table, {})
        own[column] = sorted(set(own.get(column, [])) | {int(k) for k in kinds if k != ValueType.NULL})

    def create_table(self, schema: ir.TableSchema, keyless: bool = False) -> None:
        keys = [c for c in schema.columns if c.primary_key]
        if not keyless:
            if not keys:
                raise InvalidQuery("Table requires a UUID primary key")
            if len(keys) > 1:
                raise InvalidQuery("Table requires exactly one primary key")
            if keys[0].type != ValueType.UUID:
                raise InvalidQuery("Primary key must have UUID type")
        self.m["tables"][schema.name] = self._stamp({"deleted": False})
        for position, column in enumerate(schema.columns):
            self.add_column(schema.name, column, position)

    def add_column(self, table: str, column: ir.ColumnSchema, position: int) -> None:
        key = f"{table}\0{column.name}"
        if key in self.m["fields"]:
            return  # an entry that is there stays as it is, dropped or not
        entry = {"type": int(column.type), "default": to_plain(column.default), "position": position, "primary_key": column.primary_key, "deleted": False}
        self.m["fields"][key] = self._stamp(entry)

    def flag(self, where: str, key: str, **changes: Any) -> None:
        self.m[where][key] = self._stamp(self.m[where][key] | changes)

    def create_index(self, index: ir.IndexSchema) -> None:
        if not index.name or not index.columns:
            raise InvalidQuery("Index requires a name and column")
        self.need_table(index.table)
        names = {c.name for c in self.table_schema(index.table).columns}
        if any(c not in names for c in index.columns):
            raise InvalidQuery("Index column not found")
        self.m["indexes"][index.name] = self._stamp({"table": index.table, "unique": index.unique, "deleted": False})
        for key in [k for k in self.m["index_fields"] if k.split("\0")[0] == index.name]:
            self.flag("index_fields", key, deleted=True)
        for position, column in enumerate(index.columns):
            self.m["index_fields"][f"{index.name}\0{position}"] = self._stamp({"column": column, "deleted": False})

    def drop_index(self, name: str) -> None:
        self.flag("indexes", name, deleted=True)
        for key in [k for k in self.m["index_fields"] if k.split("\0")[0] == name]:
            self.flag("index_fields", key, deleted=True)

    # -- export and merge

    def entries(self) -> list[tuple[str, str, dict]]:
        """(kind, key, entry) of all entries, sorted."""
        return sorted((name, key, entry) for name in _MAPS for key, entry in self.m[name].items())

    def merge(self, kind: str, key: str, entry: dict) -> bool:
        """Takes an entry of another replica if its version is the later one."""
        own = self.m[kind].get(key)
        if own is None or tuple(entry["v"]) > tuple(own["v"]):
            self.m[kind][key] = entry
            return True
        return False

    def system_table(self, spark: SparkSession, name: str) -> DataFrame:
        rows: list[tuple]
        if name == "__engine_tables":
            rows = [(k, e["deleted"]) for k, e in self.m["tables"].items()]
        elif name == "__engine_table_fields":
            rows = [(*k.split("\0"), e["type"], str(from_plain(e["default"])), e["position"], e["primary_key"], e["deleted"]) for k, e in self.m["fields"].items()]
        elif name == "__engine_indices":
            rows = [(k, e["table"], e["unique"], e["deleted"]) for k, e in self.m["indexes"].items()]
        else:
            rows = [(k.split("\0")[0], int(k.split("\0")[1]), e["column"], e["deleted"]) for k, e in self.m["index_fields"].items()]
        return spark.createDataFrame(sorted(rows), SYSTEM_TABLES[name])
