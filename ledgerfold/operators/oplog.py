"""The operation log: writes of cells, which of them are live, and what they show.

A write names the writes it replaces. A cell's live writes are those that nobody
replaced; the visible one has the greatest (counter, actor), and more than one
live write is a conflict. Union of two logs, without repeated writes, is the
merge of two replicas: commutative, associative and idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.cells import CELL

KEY = ["row_id", "col"]
#: Writes that one task sorts, about; a write takes some 250 bytes of memory, but as few as six in files and in shuffles.
ROWS_A_TASK = 250_000
#: Names of replaced writes that are broadcast, at most.
BROADCAST_NAMES = 100_000


def merge_logs(*logs: DataFrame) -> DataFrame:
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out.dropDuplicates([*KEY, "op_id"])


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in partitions for a log of ``rows`` writes: as many as keep the memory of a task what it is, however large the log."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)), *keys)


def live_ops(ops: DataFrame, rows: int | None = None, names: int | None = None) -> DataFrame:
    """Writes that no other write of the log replaces. ``rows`` and ``names`` as for visible_cells()."""
    if names == 0:
        return ops
    replaced = ops.select(*KEY, F.explode("preds").alias("op_id"))
    on = [*KEY, "op_id"]
    if names is not None and names <= BROADCAST_NAMES:
        replaced = F.broadcast(replaced)
    elif rows is not None:
        ops, replaced = dealt(ops, rows, *on), dealt(replaced, rows, *on)
    return ops.join(replaced, on, "left_anti")


def visible_cells(ops: DataFrame, rows: int | None = None, names: int | None = None) -> DataFrame:
    """(row_id, col, cell, n, counter, live): each cell's visible value, its number of live writes and their names.

    Cells are structs, so that Spark sorts to aggregate them, and would sort all that a task has read before
    it deals rows out. Where the log is known to have ``rows`` writes whose preds hold ``names`` names, rows are
    dealt out first, once for the cells and for what is made of a row's cells, to tasks of bounded size.
    """
    live = live_ops(ops, rows, names)
    if rows is not None:
        live = dealt(live, rows, "row_id")
    return (
        live.groupBy(*KEY)
        .agg(
            F.max_by("cell", F.struct("counter", "actor")).alias("cell"),
            F.count("*").alias("n"),
            F.max("counter").alias("counter"),
            F.array_sort(F.collect_set("op_id")).alias("live"),  # as many as writers that haven't met
        )
    )


def conflicts(ops: DataFrame) -> DataFrame:
    """(row_id, col, n) of cells with several live writes."""
    return live_ops(ops).groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def make_ops(cells: DataFrame, actor: str) -> DataFrame:
    """Writes for (row_id, col, cell, counter, live): one after ``counter`` that replaces ``live``."""
    counter = F.coalesce("counter", F.lit(0)) + 1
    return cells.select(
        "row_id",
        "col",
        counter.cast("bigint").alias("counter"),
        F.lit(actor).alias("actor"),
        F.concat_ws("@", counter.cast("string"), F.lit(actor)).alias("op_id"),
        F.col("cell").cast(CELL).alias("cell"),
        F.coalesce("live", F.array().cast("array<string>")).alias("preds"),
    )


def compact(ops: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The log without replaced writes and without rows that are deleted.

    Replaced writes may go once all replicas have seen what replaced them; their
    names stay in the preds of the writes that did.
    """
    return live_ops(ops).join(tombstones, "row_id", "left_anti")


def contenders(rows: DataFrame, keys: list[str], row_id: str = "row_id") -> DataFrame:
    """Rows with their rank among those that share a unique key; the lowest id holds it, null keys contend for nothing."""
    from pyspark.sql import Window

    named = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return named.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(row_id)))


def latest_generation(entries: DataFrame, now: int) -> DataFrame:
    """A key-value view of (key, generation, deleted, expires, value): the newest generation decides alone.

    A newest generation that is deleted or expired hides its key; older ones never come back.
    """
    newest = entries.groupBy("key").agg(F.max_by(F.struct("value", "deleted", "expires"), "generation").alias("e"))
    alive = ~F.coalesce("e.deleted", F.lit(False)) & (F.col("e.expires").isNull() | (F.col("e.expires") > now))
    return newest.where(alive).select("key", F.col("e.value").alias("value"))
