"""The database: SQL and statements over a versioned store of replicated tables."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.errors import EngineError, InvalidQuery
from ledgerfold.functions.cells import literal, rank_of_type, same_value
from ledgerfold.functions.values import Clock, ValueType, system_clock
from ledgerfold.operators import oplog
from ledgerfold.operators.scan import ROW_ID, row_uuid
from ledgerfold.operators.select import Selected
from ledgerfold.operators.transaction import Transaction, collect, row_key
from ledgerfold.plans import ir
from ledgerfold.plans.sql import EXTENDED, STRICT, translate
from ledgerfold.sources.files import read_files
from ledgerfold.sources.store import Store, parse_uri, shared_folder


class Database:
    """One replica. ``profile`` is strict (the small dialect) or extended (all of the representation)."""

    def __init__(self, spark: SparkSession, root: str, profile: str = STRICT, clock: Clock | None = system_clock, actor: str | None = None):
        if profile not in (STRICT, EXTENDED):
            raise ValueError(f"no profile {profile!r}")
        self.spark, self.profile, self.clock = spark, profile, clock
        self.actor = actor or uuid.uuid4().hex[:16]
        self.store = Store(spark, root)

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> Database:
        """The database in a folder, made if it isn't there."""
        return cls(spark, path, **options)

    @classmethod
    def in_memory(cls, spark: SparkSession, **options) -> Database:
        """A database of this session, in a folder that close() removes."""
        return cls(spark, f"{shared_folder(spark)}/session-{uuid.uuid4().hex}", **options)

    @classmethod
    def open_uri(cls, spark: SparkSession, uri: str, **options) -> Database:
        path = parse_uri(uri)
        return cls.in_memory(spark, **options) if path is None else cls.open(spark, path, **options)

    def close(self) -> None:
        """Removes a session's database; one that was opened by path stays."""
        if "/session-" in self.store.root:
            self.store.destroy()

    # -- statements

    def translate(self, sql: str, params: Any = None) -> list:
        return translate(sql, self.profile, params)

    def execute(self, statements: list) -> list[ir.QueryResult]:
        """Runs a batch; all of it or, after an error, nothing."""
        with Transaction(self) as tx:
            return [tx.execute(s) for s in statements]

    def translate_and_execute(self, sql: str, params: Any = None) -> list[ir.QueryResult]:
        return self.execute(self.translate(sql, params))

    def translate_and_select(self, sql: str, params: Any = None) -> ir.QueryResult:
        results = self.translate_and_execute(sql, params)
        if len(results) != 1:
            raise InvalidQuery("Expected one query result")
        return results[0]

    def select(self, query: str | ir.Select, params: Any = None) -> Selected:
        if isinstance(query, str):
            statements = self.translate(query, params)
            if len(statements) != 1 or not isinstance(statements[0], ir.Select):
                raise InvalidQuery("Expected one query result")
            query = statements[0]
        return Transaction(self).select(query)

    def dataframe(self, query: str | ir.Select, params: Any = None) -> DataFrame:
        """A query as a lazy DataFrame over the newest version; its rows are in no order unless limited."""
        return self.select(query, params).named()

    # -- tables

    def register_files(self, table: str, path: str, format: str = "parquet", key: str | None = None, id_column: str = "id", schema: str | None = None) -> None:
        """Makes files a table without copying them.

        With ``key``, an integer column, each row has the UUID of its key in
        ``id_column`` and can be updated and deleted; without, it can be scanned.
        """
        df = read_files(self.spark, path, format, schema)
        columns = [ir.ColumnSchema(id_column, ValueType.UUID, None, True)] if key else []
        columns += [ir.ColumnSchema(f.name, rank_of_type(f.dataType) or ValueType.NULL) for f in df.schema]
        tx = Transaction(self)
        if tx.catalog.has_table(table):
            raise InvalidQuery("Table already exists")
        tx.manifest["bases"][table] = {"path": path, "format": format, "key": key, "schema": schema}
        tx.catalog.create_table(ir.TableSchema(table, tuple(columns)), keyless=True)
        tx.commit()

    def insert_frame(self, table: str, df: DataFrame) -> None:
        with Transaction(self) as tx:
            tx.insert_frame(table, df)

    def table_names(self) -> list[str]:
        return Transaction(self).catalog.table_names()

    def table_schema(self, name: str) -> ir.TableSchema:
        return Transaction(self).catalog.table_schema(name)

    def index_schema(self, name: str) -> ir.IndexSchema:
        return Transaction(self).catalog.index_schema(name)

    def drop_table(self, name: str) -> None:
        self.execute([ir.DropTable(name)])

    def tombstone_column(self, table: str, column: str) -> None:
        tx = Transaction(self)
        tx.catalog.need_table(table)
        if f"{table}\0{column}" not in tx.manifest["fields"]:
            raise InvalidQuery("Schema name not found")
        tx.catalog.flag("fields", f"{table}\0{column}", deleted=True)
        tx.commit()

    def system_table(self, name: str) -> DataFrame:
        return Transaction(self).catalog.system_table(self.spark, name)

    def get_row(self, table: str, key: uuid.UUID) -> tuple | None:
        scan = Transaction(self).scan(table)
        one = Selected(scan.df.where(scan.of_id(row_key(key))), [ir.ResultColumn(n, table, n) for n in scan.names], [scan.columns[n] for n in scan.names], [])
        rows = collect(one).rows
        return rows[0] if rows else None

    def index_lookup(self, name: str, key: tuple) -> tuple | None:
        """The row of the lowest id among those with ``key``."""
        tx = Transaction(self)
        index = tx.catalog.index_schema(name)
        if len(key) != len(index.columns):
            raise InvalidQuery("Index key has the wrong column count")
        if any(v is None for v in key):
            return None
        scan = tx.scan(index.table)
        df = scan.df
        for c, v in zip(index.columns, key, strict=True):
            df = df.where(same_value(scan.columns[c], literal(v)))
        first = Selected(df.orderBy(ROW_ID).limit(1), [ir.ResultColumn(n) for n in scan.names], [scan.columns[n] for n in scan.names], [])
        rows = collect(first).rows
        return rows[0] if rows else None

    # -- conflicts

    def row_conflicts(self, table: str, key: uuid.UUID) -> list[str]:
        """Names of a row's conflicted columns, in schema order."""
        tx = Transaction(self)
        names = [c.name for c in tx.catalog.table_schema(table).columns]
        ops = tx.ops(table)
        if ops is None:
            return []
        found = {r["col"] for r in oplog.conflicts(ops.where(F.col("row_id") == row_key(key))).collect()}
        return [n for n in names if n in found]

    def resolve_row(self, table: str, key: uuid.UUID, values: list[tuple[str, Any]]) -> None:
        """Settles conflicted columns of a row by a write that replaces all live ones."""
        if not values:
            raise InvalidQuery("Resolution requires an assignment")
        tx = Transaction(self)
        schema = tx.catalog.table_schema(table)
        conflicted = self.row_conflicts(table, key)
        if self.get_row(table, key) is None:
            raise InvalidQuery("Row not found")
        settled: dict[str, Any] = {}
        for name, value in values:
            column = next((c for c in schema.columns if c.name == name), None)
            if column is None:
                raise InvalidQuery("Unknown resolution column")
            if name not in conflicted:
                raise InvalidQuery("Resolution column is not conflicted")
            if column.primary_key:
                raise InvalidQuery("Cannot resolve the primary key")
            if name in settled:
                raise InvalidQuery("Resolution column is repeated")
            settled[name] = value
        ids = self.spark.createDataFrame([(row_key(key),)], "row_id string")
        with tx:
            tx.assign(table, ids, settled, resolving=True)

    # -- log and catalog

    def ops(self, table: str) -> DataFrame | None:
        return Transaction(self).ops(table)

    def compact(self, table: str) -> None:
        """Rewrites a table's log without replaced writes and deleted rows."""
        tx = Transaction(self)
        ops = tx.ops(table)
        if ops is None:
            return
        gone = tx.tombstones(table)
        tx.replace(table, oplog.compact(ops, gone) if gone is not None else oplog.live_ops(ops))
        tx.commit()

    def needs_compaction(self, table: str, deltas: int = 100, size: int = 1 << 20) -> bool:
        """Whether a table's log has as many folders or bytes as call for compaction."""
        names = Transaction(self).manifest["ops"].get(table, [])
        return len(names) >= deltas or self.store.size(names) >= size

    def export_catalog_entries(self) -> list[tuple[str, str, str]]:
        """(kind, key, entry as JSON) of every catalog entry, sorted."""
        return [(kind, key, json.dumps(entry, sort_keys=True)) for kind, key, entry in Transaction(self).catalog.entries()]

    def apply_catalog_entry(self, kind: str, key: str, entry: str) -> None:
        """Takes another replica's entry if it is later than the own one."""
        tx = Transaction(self)
        if kind not in ("tables", "fields", "indexes", "index_fields"):
            from ledgerfold.errors import Custom

            raise Custom("Invalid catalog key")
        tx.catalog.merge(kind, key, json.loads(entry))
        tx.commit()


__all__ = ["Database", "EngineError", "row_uuid"]
