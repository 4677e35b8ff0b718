"""Changes as a stream: writes from elsewhere enter the log by micro-batches.

Applying is idempotent, so a batch that Spark repeats after a failure changes
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ledgerfold.database import Database
from ledgerfold.operators.sync import apply_ops
from ledgerfold.operators.transaction import Transaction
from ledgerfold.sources.store import OPS


def read_changes(db: Database, path: str) -> DataFrame:
    """A folder of Parquet files of writes (OPS), as a stream."""
    return db.spark.readStream.schema(OPS).parquet(path)


def apply_stream(db: Database, table: str, changes: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts taking a stream of writes into ``table``; each micro-batch is one version."""

    def take(batch: DataFrame, _: int) -> None:
        with Transaction(db) as tx:
            apply_ops(tx, table, batch)

    writer = changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
