"""One atomic batch of statements over one version of the store.

Single inserted rows are staged as tuples. Updates, deletes and frames are written
at once, so that their plans run once and later statements of the batch, which see
them, start from files. Nobody else sees those files before commit() publishes one
new version; after an error, abort() removes them and the store is as it was.
"""

from __future__ import annotations

import copy
import uuid
from typing import TYPE_CHECKING, Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.errors import InvalidQuery, Unsupported
from ledgerfold.functions.cells import CELL, Typed, cell_tuple, cell_value, is_null, literal, plain_value, same_value
from ledgerfold.functions.values import ValueType, order_key, type_of, uuid7
from ledgerfold.operators.catalog import Catalog
from ledgerfold.operators.oplog import dealt, make_ops, visible_cells
from ledgerfold.operators.scan import ROW_ID, Scan, place, scan_table
from ledgerfold.operators.select import Selected, select_extended, select_strict
from ledgerfold.plans import ir
from ledgerfold.sources.files import read_files
from ledgerfold.sources.store import OPS, TOMBSTONES

if TYPE_CHECKING:
    from ledgerfold.database import Database

#: Logs and lists of deleted rows of up to so many bytes in files are broadcast; staged rows are the driver's own.
BROADCAST_BYTES = 2 << 20
#: Written rows of which the keys are broadcast when a unique index is checked.
BROADCAST_ROWS = 100_000


class Transaction:
    def __init__(self, db: Database):
        self.db, self.spark = db, db.spark
        self.manifest = db.store.latest()
        self.based_on = self.manifest["version"]
        self.before = copy.deepcopy(self.manifest)
        self.catalog = Catalog(self.manifest, db.actor)
        self.rows: dict[str, list[tuple]] = {}
        self.written: list[str] = []

    # -- what the batch sees

    def ops(self, table: str) -> DataFrame | None:
        parts = []
        if names := self.manifest["ops"].get(table):
            parts.append(self.db.store.read(names, OPS))
        if rows := self.rows.get(table):
            parts.append(self.spark.createDataFrame(rows, OPS))
        return _union(parts)

    def cells(self, table: str) -> DataFrame | None:
        """The visible cells of a table's log. Of a log that is too large to broadcast, writes and what they replace are counted first."""
        ops = self.ops(table)
        if ops is None or self.small("ops", table):
            return None if ops is None else visible_cells(ops)
        rows, names = ops.agg(F.count("*"), F.sum(F.size("preds"))).first()
        return visible_cells(ops, rows, names or 0)

    def small(self, kind: str, table: str) -> bool:
        return self.db.store.size(self.manifest[kind].get(table, [])) <= BROADCAST_BYTES

    def tombstones(self, table: str) -> DataFrame | None:
        names = self.manifest["tombstones"].get(table)
        return self.db.store.read(names, TOMBSTONES) if names else None

    def base(self, table: str) -> DataFrame | None:
        info = self.catalog.base(table)
        return read_files(self.spark, info["path"], info["format"], info.get("schema")) if info else None

    def scan(self, table: str) -> Scan:
        self.catalog.need_table(table)
        small = [self.small(kind, table) for kind in ("ops", "tombstones")]
        return scan_table(self.spark, self.catalog, table, self.base(table), self.cells(table), self.tombstones(table), *small)

    # -- statements

    def execute(self, statement: Any) -> ir.QueryResult:
        if isinstance(statement, ir.Select):
            return collect(self.select(statement))
        if isinstance(statement, ir.InsertValues):
            return self.insert_values(statement)
        if isinstance(statement, ir.Insert):
            return self.insert_row(statement.table, self.materialize(self.catalog.table_schema(statement.table), statement.row), statement.returning)
        if isinstance(statement, ir.Update):
            return self.update(statement)
        if isinstance(statement, ir.Delete):
            return self.delete(statement)
        return self.define(statement)

    def select(self, query: ir.Select) -> Selected:
        if self.db.profile == "extended":
            return select_extended(query, self.scan)
        return select_strict(query, self.scan(query.source.table))

    # -- INSERT

    def materialize(self, schema: ir.TableSchema, row: tuple) -> tuple:
        """A full row: a short one gets a generated key in front if the key comes first, then defaults."""
        row = tuple(row)
        if len(row) > len(schema.columns):
            raise InvalidQuery("INSERT row has the wrong column count")
        if len(row) < len(schema.columns):
            if not schema.columns[0].primary_key:
                raise InvalidQuery("INSERT row has the wrong column count")
            if not row or type_of(row[0]) != ValueType.UUID:
                row = (uuid7(self.db.clock), *row)
            row += tuple(c.default for c in schema.columns[len(row) :])
        return row

    def insert_values(self, s: ir.InsertValues) -> ir.QueryResult:
        return self.insert_rows(s.table, [self.full_row(s, values) for values in (s.values, *s.more)], s.returning)

    def full_row(self, s: ir.InsertValues, given: tuple) -> tuple:
        """A tuple of VALUES as a row with all columns."""
        schema = self.catalog.table_schema(s.table)
        names = [c.name for c in schema.columns]
        columns = list(s.columns) or names
        if len(columns) != len(given):
            raise InvalidQuery("INSERT column/value count mismatch")
        values: dict[str, Any] = {}
        for column, value in zip(columns, given, strict=True):
            if column not in names:
                raise InvalidQuery("Unknown INSERT column")
            if column in values:
                raise InvalidQuery("Duplicate INSERT column")
            values[column] = value
        if sum(c.primary_key for c in schema.columns) != 1:
            raise InvalidQuery("Table requires exactly one UUID primary key")
        row = []
        for c in schema.columns:
            value = values.get(c.name, ir.DEFAULT)
            if value is ir.DEFAULT:
                value = uuid7(self.db.clock) if c.primary_key else c.default
            row.append(value)
        return tuple(row)

    def insert_row(self, table: str, row: tuple, returning: tuple[str, ...] | None) -> ir.QueryResult:
        return self.insert_rows(table, [row], returning)

    def insert_rows(self, table: str, rows: list[tuple], returning: tuple[str, ...] | None) -> ir.QueryResult:
        """Stages rows after one look at the table for all of their keys and unique indexes; the first that is refused tells why."""
        schema = self.catalog.table_schema(table)
        names = [c.name for c in schema.columns]
        named = [dict(zip(names, row, strict=True)) for row in rows]
        keys = [next((v for c, v in zip(schema.columns, row, strict=True) if c.primary_key), None) for row in rows]
        if any(type_of(k) != ValueType.UUID for k in keys):
            raise InvalidQuery("Primary key must be a UUID")
        ids = [str(k) for k in keys]
        gone = self.tombstones(table)
        if gone is not None and gone.where(F.col("row_id").isin(ids)).limit(1).count():
            raise InvalidQuery("Primary key was deleted")
        self.refuse_duplicates(table, ids, named, [i for i in self.catalog.indexes_of(table) if i.unique])
        own = self.rows.setdefault(table, [])
        for row_id, values in zip(ids, named, strict=True):
            for column, value in values.items():
                own.append((row_id, column, 1, self.db.actor, f"1@{self.db.actor}", cell_tuple(value), []))
                self.catalog.saw(table, column, {type_of(value)})
        if returning is None:
            return ir.QueryResult()
        wanted = [n for name in returning for n in (names if name == "*" else [name])]
        if not set(wanted) <= set(names):
            raise InvalidQuery("Unknown RETURNING column")
        return ir.QueryResult([tuple(values[n] for n in wanted) for values in named], [ir.ResultColumn(n, table, n) for n in wanted])

    def refuse_duplicates(self, table: str, ids: list[str], named: list[dict[str, Any]], unique: list[ir.IndexSchema]) -> None:
        """Holds rows against the table and each other. What the table has of their keys comes here: a row a key and index at most."""
        of_index = lambda index, values: None if any(values[c] is None for c in index.columns) else tuple(order_key(values[c]) for c in index.columns)
        held_ids, held_keys = set(), {index.name: set() for index in unique}
        if self.ops(table) is not None or self.base(table) is not None:
            scan = self.scan(table)
            hit = F.lit(False)
            for row_id in ids:
                hit = hit | scan.of_id(row_id)
            for index in unique:
                for values in named:
                    if of_index(index, values) is not None:
                        same = F.lit(True)
                        for c in index.columns:
                            same = same & same_value(scan.columns[c], literal(values[c]))
                        hit = hit | same
            shown = sorted({c for index in unique for c in index.columns})
            for r in scan.df.where(hit).select(ROW_ID, *[scan.columns[c].col.alias(f"u{i}") for i, c in enumerate(shown)]).collect():
                held_ids.add(r[ROW_ID])
                found = {c: cell_value(x) if scan.columns[c].rank is None else plain_value(x, scan.columns[c].rank) for c, x in zip(shown, r[1:], strict=True)}
                for index in unique:
                    held_keys[index.name].add(of_index(index, found))
        for row_id, values in zip(ids, named, strict=True):
            if row_id in held_ids:
                raise InvalidQuery("Primary key already exists")
            held_ids.add(row_id)
            for index in unique:
                key = of_index(index, values)
                if key is not None and key in held_keys[index.name]:
                    raise InvalidQuery("Unique index violation")
                held_keys[index.name].add(key)

    def insert_frame(self, table: str, df: DataFrame) -> None:
        """Inserts the rows of a frame in one go: keys, uniqueness and deletions are checked by joins.

        The frame is computed once. Its writes are staged before their keys are checked, so that their
        number is known and each task gets a bounded share; after a refusal abort() removes them.

        Columns are matched by name; the key column holds canonical UUID text,
        other columns are stored with the type that Spark has for them.
        """
        from ledgerfold.functions.cells import rank_of_type, to_cell

        schema = self.catalog.table_schema(table)
        key = next(c.name for c in schema.columns if c.primary_key)
        if key not in df.columns or any(c not in {s.name for s in schema.columns} for c in df.columns):
            raise InvalidQuery("Unknown INSERT column")
        cells = []
        for c in schema.columns:
            if c.name == key:
                typed = Typed(F.col(key), ValueType.UUID)
            elif c.name in df.columns:
                rank = rank_of_type(df.schema[c.name].dataType)
                if rank is None:
                    raise InvalidQuery("column type has no values")
                typed = Typed(F.col(c.name), rank)
            else:
                typed = literal(c.default)
            self.catalog.saw(table, c.name, {typed.rank})
            cells.append(F.struct(F.lit(c.name).alias("col"), to_cell(typed).cast(CELL).alias("cell")))
        held = self.scan(table).df if self.ops(table) is not None or self.base(table) is not None else None
        long = df.select(F.col(key).alias("row_id"), F.explode(F.array(*cells)).alias("c")).select("row_id", "c.col", "c.cell")
        done = self.stage(table, ops=make_ops(long.withColumns({"counter": F.lit(None).cast("bigint"), "live": F.lit(None).cast("array<string>")}), self.db.actor))
        if done is None:
            return
        ids = dealt(done.where(F.col("col") == key).select("row_id"), done.count(), "row_id")
        told = ids.agg(F.count("*"), F.count_distinct("row_id"), F.count(F.when(~F.col("row_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$") | F.col("row_id").isNull(), 1))).first()
        if told[2]:
            raise InvalidQuery("Primary key must be a UUID")
        gone = self.tombstones(table)
        if gone is not None and ids.join(gone, "row_id", "left_semi").limit(1).count():
            raise InvalidQuery("Primary key was deleted")
        if told[0] != told[1] or held is not None and held.join(ids.withColumnRenamed("row_id", ROW_ID), ROW_ID, "left_semi").limit(1).count():
            raise InvalidQuery("Primary key already exists")
        self.refuse_shared_keys(table, ids, [i for i in self.catalog.indexes_of(table) if i.unique])

    # -- UPDATE, DELETE

    def matched(self, table: str, predicate: Any, what: str) -> tuple[Scan, DataFrame]:
        """Ids of rows whose column equals a value, null equalling null."""
        scan = self.scan(table)
        if not isinstance(predicate, ir.Comparison) or predicate.op != "=":
            raise Unsupported("UPDATE and DELETE require column equality predicates")
        sides = (predicate.left, predicate.right)
        column = next((s.column for s in sides if isinstance(s, ir.ColumnRef)), None)
        value = next((s for s in sides if isinstance(s, ir.Literal)), None)
        if column is None or value is None:
            raise Unsupported("UPDATE and DELETE require column equality predicates")
        typed = self.column(scan, table, column, "Unknown predicate column")
        if not scan.keyed:
            raise Unsupported(f"{what} of a table without a key")
        return scan, scan.df.where(same_value(typed, literal(value.value))).select(F.col(ROW_ID).alias("row_id"))

    def column(self, scan: Scan, table: str, c: ir.QueryColumn, unknown: str) -> Typed:
        if c.table and c.table != table:
            raise InvalidQuery("Unknown column table")
        if c.column not in scan.columns:
            raise InvalidQuery(unknown)
        return scan.columns[c.column]

    def update(self, s: ir.Update) -> ir.QueryResult:
        table = s.source.table
        if s.source.joins:
            raise Unsupported("UPDATE JOIN")
        if s.returning is not None:
            raise Unsupported("UPDATE RETURNING")
        schema = self.catalog.table_schema(table)
        if not s.assignments:
            raise InvalidQuery("UPDATE requires an assignment")
        scan = self.scan(table)
        values: dict[str, Any] = {}
        for a in s.assignments:
            self.column(scan, table, a.column, "Unknown assignment column")
            if not isinstance(a.value, ir.Literal):
                raise Unsupported("UPDATE column assignments")
            if next(c for c in schema.columns if c.name == a.column.column).primary_key:
                raise InvalidQuery("Cannot update the primary key")
            values[a.column.column] = a.value.value
        _, ids = self.matched(table, s.predicate, "UPDATE")
        self.assign(table, ids, values)
        return ir.QueryResult()

    def assign(self, table: str, ids: DataFrame, values: dict[str, Any], resolving: bool = False) -> None:
        """Stages writes of ``values`` to the rows of ``ids`` that replace what is live there."""
        from ledgerfold.functions.cells import to_cell

        cells = [F.struct(F.lit(c).alias("col"), to_cell(literal(v)).cast(CELL).alias("cell")) for c, v in values.items()]
        wanted = ids.select("row_id", F.explode(F.array(*cells)).alias("c")).select("row_id", "c.col", "c.cell")
        cells = self.cells(table)
        if cells is None:
            now = wanted.withColumns({"counter": F.lit(None).cast("bigint"), "live": F.lit(None).cast("array<string>")})
        else:
            now = wanted.join(cells.drop("cell"), ["row_id", "col"], "left")
        done = self.stage(table, ops=make_ops(now, self.db.actor))
        if done is None:
            return
        if not resolving and done.where(F.size("preds") > 1).limit(1).count():
            raise InvalidQuery("Logical row column is conflicted")
        ids = done.select("row_id").distinct()
        for c, v in values.items():
            self.catalog.saw(table, c, {type_of(v)})
        self.refuse_shared_keys(table, ids, [i for i in self.catalog.indexes_of(table) if i.unique and set(i.columns) & set(values)])

    def refuse_shared_keys(self, table: str, ids: DataFrame, unique: list[ir.IndexSchema]) -> None:
        """A violation if a written row now shares a unique key with another."""
        if not unique:
            return
        scan = self.scan(table)
        written = ids.select(F.col("row_id").alias("_written")).distinct()
        few = written.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        held = F.broadcast if few else (lambda df: df)
        for index in unique:
            keys = [scan.columns[c] for c in index.columns]
            full = scan.df
            for k in keys:
                full = full.where(~is_null(k))
            full = full.select(ROW_ID, *[k.col.alias(f"k{i}") for i, k in enumerate(keys)])
            names = full.columns[1:]
            flagged = full.join(held(written), F.col(ROW_ID) == F.col("_written"), "left")
            if few:  # only rows that share a key with a written one need to meet
                flagged = flagged.join(held(flagged.where("_written IS NOT NULL").select(*names).distinct()), names, "left_semi")
            shared = flagged.groupBy(*names).agg(F.count("*").alias("n"), F.count("_written").alias("w"))
            if shared.where("n > 1 AND w > 0").limit(1).count():
                raise InvalidQuery("Unique index violation")

    def delete(self, s: ir.Delete) -> ir.QueryResult:
        if s.source.joins:
            raise Unsupported("DELETE JOIN")
        if s.returning is not None:
            raise Unsupported("DELETE RETURNING")
        _, ids = self.matched(s.source.table, s.predicate, "DELETE")
        self.stage(s.source.table, tombstones=ids)
        return ir.QueryResult()

    # -- DDL

    def define(self, s: Any) -> ir.QueryResult:
        catalog = self.catalog
        extended = self.db.profile == "extended"
        if isinstance(s, ir.CreateTable):
            if catalog.has_table(s.schema.name):
                if not s.if_not_exists:
                    raise InvalidQuery("Table already exists")
            else:
                catalog.create_table(s.schema)
                for index in s.indexes:
                    self.create_index(index)
        elif isinstance(s, ir.DropTable):
            if catalog.has_table(s.name):
                catalog.flag("tables", s.name, deleted=True)
            elif not s.if_exists:
                raise InvalidQuery("Table not found")
        elif isinstance(s, ir.AlterTable):
            self.alter(s, extended)
        elif isinstance(s, ir.CreateIndex):
            entry = self.manifest["indexes"].get(s.index.name)
            if entry and not entry["deleted"]:
                if not s.if_not_exists:
                    raise InvalidQuery("Index already exists")
                if s.from_sql:
                    return ir.QueryResult()
            catalog.need_table(s.index.table)
            self.create_index(s.index)
        elif isinstance(s, ir.DropIndex):
            entry = self.manifest["indexes"].get(s.name)
            if entry and not entry["deleted"]:
                catalog.drop_index(s.name)
            elif not s.if_exists:
                raise InvalidQuery("Index not found")
        elif isinstance(s, ir.RenameIndex) and extended:
            index = catalog.index_schema(s.old)
            if (taken := self.manifest["indexes"].get(s.new)) and not taken["deleted"]:
                raise InvalidQuery("Index already exists")
            catalog.drop_index(s.old)
            catalog.create_index(ir.IndexSchema(s.new, index.table, index.columns, index.unique))
        else:
            raise Unsupported("only CREATE TABLE and ALTER TABLE ADD COLUMN are supported")
        return ir.QueryResult()

    def create_index(self, index: ir.IndexSchema) -> None:
        self.catalog.create_index(index)
        if index.unique:
            scan = self.scan(index.table)
            full = scan.df
            for c in index.columns:
                full = full.where(~is_null(scan.columns[c]))
            keys = [scan.columns[c].col.alias(f"k{i}") for i, c in enumerate(index.columns)]
            if full.groupBy(*keys).count().where("count > 1").limit(1).count():
                raise InvalidQuery("Unique index violation")

    def alter(self, s: ir.AlterTable, extended: bool) -> None:
        catalog = self.catalog
        if not catalog.has_table(s.table):
            if s.if_exists:
                return
            raise InvalidQuery("Table not found")
        names = [c.name for c in catalog.table_schema(s.table).columns]
        for position, op in enumerate(s.operations, len(names)):
            if isinstance(op, ir.AddColumn):
                if op.column.name in names:
                    raise InvalidQuery("Column already exists")
                if op.column.primary_key:
                    raise InvalidQuery("Cannot add a primary-key column")
                catalog.add_column(s.table, op.column, position)
                names.append(op.column.name)
            elif not extended:
                raise Unsupported("only ALTER TABLE ADD COLUMN is supported")
            elif isinstance(op, ir.DropColumn):
                if op.name not in names:
                    raise InvalidQuery("Unknown projection column")
                if self.manifest["fields"][f"{s.table}\0{op.name}"]["primary_key"]:
                    raise InvalidQuery("Cannot update the primary key")
                catalog.flag("fields", f"{s.table}\0{op.name}", deleted=True)
                for index in catalog.indexes_of(s.table):
                    if op.name in index.columns:
                        catalog.drop_index(index.name)
            else:
                raise Unsupported("only ALTER TABLE ADD COLUMN is supported")

    # -- the end

    def stage(self, table: str, ops: DataFrame | None = None, tombstones: DataFrame | None = None) -> DataFrame | None:
        """Writes rows for a table's log or its deletions; gives them back as files, or None if there are none."""
        kind, df, schema = ("ops", ops, OPS) if ops is not None else ("tombstones", tombstones, TOMBSTONES)
        name = self.db.store.write(df, kind)
        self.written.append(name)
        done = self.db.store.read([name], schema)
        if not done.limit(1).count():
            return None
        self.manifest[kind].setdefault(table, []).append(name)
        return done

    def replace(self, table: str, ops: DataFrame) -> None:
        """Makes ``ops`` the whole log of a table."""
        name = self.db.store.write(ops, "ops")
        self.written.append(name)
        self.rows.pop(table, None)
        self.manifest["ops"][table] = [name]

    def commit(self) -> None:
        """Publishes what was staged; nothing staged publishes nothing."""
        for table, rows in sorted(self.rows.items()):
            name = self.db.store.write(self.spark.createDataFrame(rows, OPS).coalesce(1), "ops")
            self.written.append(name)
            self.manifest["ops"].setdefault(table, []).append(name)
        if self.manifest != self.before:
            self.db.store.publish(self.manifest, self.based_on)

    def abort(self) -> None:
        """Removes files that no version will refer to."""
        for name in self.written:
            self.db.store.remove(name)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        """Commits, or aborts after an error in the block or in committing."""
        try:
            if kind is None:
                self.commit()
        except BaseException:
            self.abort()
            raise
        if kind is not None:
            self.abort()


def _union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def collect(selected: Selected) -> ir.QueryResult:
    """A result in its order, as values."""
    df = selected.df.orderBy(*selected.order) if selected.order else selected.df
    try:
        rows = df.select(*[t.col.alias(place(i)) for i, t in enumerate(selected.typed)]).collect()
    except PySparkException as e:
        if "[[Unknown" in str(e):
            raise InvalidQuery(str(e).split("[[")[1].split("]]")[0]) from None
        raise
    values = []
    for row in rows:
        values.append(tuple(cell_value(x) if t.rank is None and not t.opaque else x if t.opaque else plain_value(x, t.rank) for x, t in zip(row, selected.typed, strict=True)))
    return ir.QueryResult(values, selected.columns)


def row_key(key: Any) -> str:
    """The row id that a key names."""
    value = key[0] if isinstance(key, (tuple, list)) and len(key) == 1 else key
    if not isinstance(value, uuid.UUID):
        raise InvalidQuery("Primary key must be a UUID")
    return str(value)
