"""A Spark-native engine for replicated tables.

``Database`` runs a small SQL dialect, or statements built from ``plans.ir``, over
tables whose rows are keyed by UUIDs and whose state is an append-only log of
cell writes in versioned Parquet. Replicas synchronise by digests and converge.
"""

from ledgerfold.database import Database
from ledgerfold.errors import EngineError

__all__ = ["Database", "EngineError"]
