"""Table scans: what a table's files and its log show, as typed columns.

A table without writes is its registered files and nothing else, so pruning and
pushdown reach them. With writes, visible cells are laid out one column each and
laid over the files; deleted rows go by an anti join. A log whose size has been
found small is broadcast, so that files are never shuffled to meet a few writes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions.cells import SPARK_TYPE, Typed, by_key, from_cell, literal, rank_of_type, to_cell
from ledgerfold.functions.values import ValueType, first_key, key_uuid, type_of
from ledgerfold.operators.catalog import Catalog
from ledgerfold.plans import ir

#: Name of the scan's row id; the columns are named by place, since Spark doesn't tell cases apart.
ROW_ID = "_row_id"
#: The integer key that a row id was made of, for rows of registered files.
KEY = "_row_key"


def row_uuid(key: Column) -> Column:
    """The row id of an integer key, as key_uuid() has it; null for a null key, whose row can be scanned but not addressed."""
    key = key.cast("bigint")
    digits = F.lower(F.lpad(F.hex(key.bitwiseAND(F.lit((1 << 63) - 1))), 16, "0"))
    version = F.when(key < 0, "6").otherwise("7")
    return F.concat(
        F.lit("00000000-0000-"), version, F.lit("00"), F.substring(digits, 1, 1), F.lit("-8"), F.substring(digits, 2, 3), F.lit("-"), F.substring(digits, 5, 12)
    )


@dataclass
class Scan:
    """A frame with ROW_ID (unless keyless) and one column per schema column."""

    df: DataFrame
    schema: ir.TableSchema
    columns: dict[str, Typed]
    keyed: bool = True

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.schema.columns]

    def of_id(self, row_id: str) -> Column:
        """Whether a row has this id; of rows of files a test of their key, which the files can use."""
        same = F.col(ROW_ID) == row_id
        if KEY not in self.df.columns:
            return same
        key = first_key(row_id)
        of_key = F.col(KEY) == key if key < 1 << 63 and key_uuid(key) == row_id else F.lit(False)
        mixed = any(t.mixed for t in self.columns.values())
        return by_key(of_key, F.col(KEY), same) if mixed else of_key


def place(i: int) -> str:
    return f"_c{i}"


def scan_table(
    spark: SparkSession,
    catalog: Catalog,
    table: str,
    base: DataFrame | None,
    cells: DataFrame | None,
    tombstones: DataFrame | None,
    small_log: bool = False,
    few_deleted: bool = False,
) -> Scan:
    """``small_log`` and ``few_deleted``: what ``cells``, the log's visible cells, and ``tombstones`` hold has been found to fit a broadcast."""
    schema = catalog.table_schema(table)
    info = catalog.base(table) or {}
    key = info.get("key")
    keyed = base is None or key is not None
    ranks: dict[str, ValueType | None] = {}
    opaque: set[str] = set()
    for c in schema.columns:
        kinds = catalog.kinds(table, c.name) | ({type_of(c.default)} - {ValueType.NULL})
        if base is not None and c.name in base.columns:
            own = rank_of_type(base.schema[c.name].dataType)
            if own is None:
                opaque.add(c.name)
            else:
                kinds |= {own}
        ranks[c.name] = next(iter(kinds)) if len(kinds) == 1 else c.type if not kinds else None

    def from_base(c: ir.ColumnSchema) -> Column:
        """A registered file's column, or the default of one that was added since."""
        if c.primary_key and key and c.name not in base.columns:
            return row_uuid(F.col(key))
        if c.name not in base.columns:
            value = literal(c.default)
            return to_cell(value) if ranks[c.name] is None else value.col.cast(SPARK_TYPE[ranks[c.name]])
        if c.name in opaque:
            return F.col(c.name)
        own = rank_of_type(base.schema[c.name].dataType)
        col = F.col(c.name).cast(SPARK_TYPE[own]) if base.schema[c.name].dataType.simpleString() != SPARK_TYPE[own] else F.col(c.name)
        return to_cell(Typed(col, own)) if ranks[c.name] is None else col

    wide = None
    if base is not None:
        ids = [row_uuid(F.col(key)).alias(ROW_ID), F.col(key).cast("bigint").alias(KEY)] if keyed else []
        wide = base.select(*ids, *[from_base(c).alias(place(i)) for i, c in enumerate(schema.columns)])
    if cells is not None:
        logged = cells.groupBy("row_id").agg(
            *[F.first(F.when(F.col("col") == c.name, F.col("cell")), ignorenulls=True).alias(f"_d{i}") for i, c in enumerate(schema.columns)]
        )

        def shown(i: int, c: ir.ColumnSchema, under: Column) -> Column:
            cell = F.col(f"_d{i}")
            value = cell if ranks[c.name] is None else from_cell(cell, ranks[c.name])
            return F.when(cell.isNotNull(), value).otherwise(under)

        if wide is None:

            def default(c: ir.ColumnSchema) -> Column:
                value = literal(c.default)
                return to_cell(value) if ranks[c.name] is None else value.col.cast(SPARK_TYPE[ranks[c.name]])

            wide = logged.select(F.col("row_id").alias(ROW_ID), *[shown(i, c, default(c)).alias(place(i)) for i, c in enumerate(schema.columns)])
        else:
            logged = logged.withColumnRenamed("row_id", "_logged")
            same = F.col(ROW_ID) == F.col("_logged")
            # Only an insert writes the key column, so that its rows can be told from those of the files.
            born = F.lit(False)
            for i, c in enumerate(schema.columns):
                if c.primary_key:
                    born = F.col(f"_d{i}").isNotNull()
            if small_log:
                rest = logged.where(born)
                missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in wide.schema]
                both = wide.join(F.broadcast(logged), same, "left").unionByName(rest.select(*missing, *logged.columns))
            else:
                both = wide.join(logged, same, "full_outer").where(F.col(ROW_ID).isNotNull() | F.col("_logged").isNull() | born)
            new = F.col(ROW_ID).isNull()
            wide = both.select(
                F.coalesce(ROW_ID, "_logged").alias(ROW_ID),
                KEY,
                *[
                    (F.col(place(i)) if c.name in opaque else shown(i, c, F.when(new, _default(c, ranks[c.name])).otherwise(F.col(place(i))))).alias(place(i))
                    for i, c in enumerate(schema.columns)
                ],
            )
    if wide is None:
        fields = ", ".join([f"{ROW_ID} string", *[f"{place(i)} {SPARK_TYPE[ranks[c.name] or c.type]}" for i, c in enumerate(schema.columns)]])
        wide = spark.createDataFrame([], fields)
        ranks = {c.name: ranks[c.name] or c.type for c in schema.columns}
    if tombstones is not None and keyed:
        gone = tombstones.withColumnRenamed("row_id", ROW_ID)
        wide = wide.join(F.broadcast(gone) if few_deleted else gone, ROW_ID, "left_anti")
    made = KEY in wide.columns
    columns = {
        c.name: Typed(F.col(place(i)), ranks[c.name], opaque=c.name in opaque, key=F.col(KEY) if made and c.primary_key and c.name not in base.columns else None, mixed=cells is not None)
        for i, c in enumerate(schema.columns)
    }
    return Scan(wide, schema, columns, keyed)


def _default(c: ir.ColumnSchema, rank: ValueType | None) -> Column:
    value = literal(c.default)
    return to_cell(value) if rank is None else value.col.cast(SPARK_TYPE[rank])
