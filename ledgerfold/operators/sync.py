"""Synchronising replicas: state units, digests, manifests and a two-party session.

A unit is a catalog entry or a row. A row's state is its whole log, sorted, and its
metadata tells whether it is deleted; the digest covers both. Replicas compare
manifests (key and digest), send rows that the other lacks whole, and of rows that
both have only the writes that the other lacks. Applying is a union of logs, so it
may be repeated and reordered; deletions are kept for good and win over writes.

Everything about rows is a DataFrame: what differs is found by anti joins and
never comes to the driver. Both sides compute what they will send from their
version at the start, before anything is received.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.database import Database
from ledgerfold.errors import Custom, SyncDependencyUnavailable
from ledgerfold.functions.values import ValueType
from ledgerfold.operators.oplog import KEY
from ledgerfold.operators.transaction import Transaction
from ledgerfold.sources.store import OPS, TOMBSTONES, shared_folder

PROTOCOL_VERSION = 3
UNITS_PER_FRAME = 64
DELETED = '{"deleted":true,"version":1}'
UNIT = "key string, state string, metadata string, digest string"


class Transport(Protocol):
    """Carries what a side sends; may raise, which ends the session.

    The payload of "state" is a function that gives the units as a DataFrame with their frames, and
    that of "changes" one that gives single writes by table; a transport between stores that one
    Spark session reads need not call them.
    """

    def carry(self, sender: str, kind: str, payload: Any) -> Any: ...


class Direct:
    def carry(self, sender: str, kind: str, payload: Any) -> Any:
        return payload


def length_bytes(column: Column) -> Column:
    """A string's length in bytes as eight bytes, the lowest first."""
    digits = F.lpad(F.hex(F.octet_length(column).cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)]))


def digest(state: Column, metadata: Column) -> Column:
    """SHA-256 over state and metadata, each after its length."""
    return F.sha2(F.concat(length_bytes(state), F.encode(state, "utf-8"), length_bytes(metadata), F.encode(metadata, "utf-8")), 256)


# -- units


def row_units(tx: Transaction, table: str) -> DataFrame:
    """One unit for each row that the log of ``table`` has, deleted ones included."""
    ops, gone = tx.ops(table), tx.tombstones(table)
    if ops is None:
        ops = tx.spark.createDataFrame([], OPS)
    if gone is None:
        gone = tx.spark.createDataFrame([], TOMBSTONES)
    # A row's own writes; sorted, so that partitioning and file layout don't show.
    entry = F.struct("col", "counter", "actor", "op_id", F.array_sort("preds").alias("preds"), "cell")
    states = ops.dropDuplicates([*KEY, "op_id"]).groupBy("row_id").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("state"))
    both = states.join(gone.distinct().withColumn("metadata", F.lit(DELETED)), "row_id", "full_outer")
    return both.select(
        F.concat(F.lit(f"row/{table}/"), "row_id").alias("key"),
        F.coalesce("state", F.lit("")).alias("state"),
        F.coalesce("metadata", F.lit("")).alias("metadata"),
    ).withColumn("digest", digest(F.col("state"), F.col("metadata")))


def catalog_units(tx: Transaction) -> DataFrame:
    rows = [(f"catalog/{kind}/{key}", json.dumps(entry, sort_keys=True), "") for kind, key, entry in tx.catalog.entries()]
    return tx.spark.createDataFrame(rows, "key string, state string, metadata string").withColumn("digest", digest(F.col("state"), F.col("metadata")))


def logged_tables(tx: Transaction) -> list[str]:
    return sorted({*tx.manifest["ops"], *tx.manifest["tombstones"]})


def state_units(db: Database) -> DataFrame:
    """All units of a replica."""
    tx = Transaction(db)
    out = catalog_units(tx)
    for table in logged_tables(tx):
        out = out.unionByName(row_units(tx, table))
    return out


def frames(units: DataFrame, size: int = UNITS_PER_FRAME) -> DataFrame:
    """``units`` with the number of the frame that each travels in, ``size`` to a frame in the order of their keys.

    Units are sorted once into files, which go with the driver. Places come from the sizes of the sorted
    partitions, of which alone the driver hears.
    """
    spark = units.sparkSession
    path = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
    slot = F.monotonically_increasing_id()
    units.repartitionByRange("key").sortWithinPartitions("key").withColumn("_slot", slot).write.parquet(path)
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(gone)
    placed = spark.read.parquet(path).withColumn("_part", F.shiftright("_slot", 33))
    before, upto = [], 0
    for r in placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        before.append((r["_part"], upto))
        upto += r["n"]
    starts = spark.createDataFrame(before, "_part long, _before long")
    within = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.join(F.broadcast(starts), "_part")  # a row for each partition
    return numbered.withColumn("frame", F.floor((F.col("_before") + within) / size).cast("long")).drop("_slot", "_part", "_before")


def outbound_units(tx: Transaction, plan: Outbound) -> DataFrame:
    """The units of a plan that travel whole: catalog entries, rows that the other lacks, and deletions."""
    out = catalog_units(tx)
    for table in logged_tables(tx):
        ids = [df.select("row_id") for df in (plan.snapshots.get(table), plan.deletions.get(table)) if df is not None]
        if ids:
            wanted = ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])
            own = row_units(tx, table)
            out = out.unionByName(own.join(wanted.select(F.concat(F.lit(f"row/{table}/"), "row_id").alias("key")).distinct(), "key", "left_semi"))
    return out


def manifest(units: DataFrame) -> DataFrame:
    """(key, digest), one row per key."""
    return units.select("key", "digest").dropDuplicates(["key"])


def manifest_diff(own: DataFrame, other: DataFrame) -> DataFrame:
    """Entries that ``other`` doesn't have, or not with this digest."""
    return own.join(other, ["key", "digest"], "left_anti")


def change_inventory(ops: DataFrame) -> DataFrame:
    """(row_id, col, op_id): names of the writes of a log."""
    return ops.select(*KEY, "op_id").distinct()


def verify(units: DataFrame) -> None:
    if units.where(F.col("digest") != digest(F.col("state"), F.col("metadata"))).limit(1).count():
        raise Custom("Invalid sync state digest")


# -- what to send


@dataclass
class Outbound:
    """Per table: whole rows, single writes for rows that the other has, and deletions."""

    catalog: list[tuple[str, str, dict]]
    snapshots: dict[str, DataFrame]
    changes: dict[str, DataFrame]
    deletions: dict[str, DataFrame]


def outbound(own: Transaction, other: Transaction) -> Outbound:
    out = Outbound(own.catalog.entries(), {}, {}, {})
    for table in logged_tables(own):
        ops, theirs = own.ops(table), other.ops(table)
        gone, their_gone = own.tombstones(table), other.tombstones(table)
        if gone is not None:
            gone = gone.distinct()
            out.deletions[table] = gone.join(their_gone, "row_id", "left_anti") if their_gone is not None else gone
        if ops is None:
            continue
        if theirs is None:
            out.snapshots[table] = ops
            continue
        known = theirs.select("row_id").distinct()
        out.snapshots[table] = ops.join(known, "row_id", "left_anti")
        out.changes[table] = ops.join(known, "row_id", "left_semi").join(change_inventory(theirs), [*KEY, "op_id"], "left_anti")
    return out


# -- taking it


def apply_catalog(tx: Transaction, entries: list[tuple[str, str, dict]]) -> int:
    return sum(tx.catalog.merge(kind, key, entry) for kind, key, entry in entries)


def apply_ops(tx: Transaction, table: str, ops: DataFrame, fresh: bool = False) -> DataFrame | None:
    """Adds writes that the log doesn't have, and gives back those; ``fresh`` ones are known to be new."""
    own = tx.ops(table)
    new = ops if fresh else ops.dropDuplicates([*KEY, "op_id"])
    if own is not None and not fresh:
        new = new.join(change_inventory(own), [*KEY, "op_id"], "left_anti")
    done = tx.stage(table, ops=new)
    if done is not None:
        for r in done.select("col", F.col("cell.t").alias("t")).distinct().collect():  # columns by types
            tx.catalog.saw(table, r["col"], {ValueType(r["t"])})
    return done


def apply_changes(tx: Transaction, table: str, changes: DataFrame, fresh: bool = False) -> DataFrame | None:
    """Single writes, all or none; their rows must be here already."""
    own = tx.ops(table)
    if not fresh:
        lacking = changes if own is None else changes.join(own.select("row_id").distinct(), "row_id", "left_anti")
        if lacking.limit(1).count():
            raise SyncDependencyUnavailable
    return apply_ops(tx, table, changes, fresh)


def apply_changes_atomically(db: Database, table: str, changes: DataFrame) -> None:
    with Transaction(db) as tx:
        apply_changes(tx, table, changes)


def apply_units(db: Database, units: DataFrame) -> None:
    """Takes units (UNIT) of another replica after checking their digests."""
    verify(units)
    with Transaction(db) as tx:
        _apply_units(tx, units)


def _apply_units(tx: Transaction, units: DataFrame) -> None:
    entries = [(r["key"].split("/", 2)[1], r["key"].split("/", 2)[2], json.loads(r["state"])) for r in units.where("key LIKE 'catalog/%'").collect()]
    apply_catalog(tx, entries)
    rows = units.where("key LIKE 'row/%'").withColumn("table", F.regexp_extract("key", "^row/(.*)/[^/]*$", 1)).withColumn("row_id", F.substring_index("key", "/", -1))
    state = "array<struct<col:string,counter:bigint,actor:string,op_id:string,preds:array<string>,cell:struct<t:tinyint,b:boolean,i:bigint,d:double,s:string,x:binary>>>"
    for table in [r["table"] for r in rows.select("table").distinct().collect()]:
        own = rows.where(F.col("table") == table)
        ops = own.where("state <> ''").select("row_id", F.explode(F.from_json("state", state)).alias("o")).select("row_id", "o.*")
        apply_ops(tx, table, ops.select("row_id", "col", "counter", "actor", "op_id", "cell", "preds"))
        tx.stage(table, tombstones=own.where(F.col("metadata") != "").select("row_id"))


# -- the session


@dataclass
class SyncResult:
    """What one side sent and took: rows sent whole, writes, deletions, catalog entries taken."""

    sent_snapshots: int = 0
    sent_changes: int = 0
    sent_deletions: int = 0
    received_snapshots: int = 0
    received_changes: int = 0
    received_deletions: int = 0
    catalog_entries: int = 0
    frames: int = 0

    @property
    def unchanged(self) -> bool:
        return not any((self.received_snapshots, self.received_changes, self.received_deletions, self.catalog_entries))


def synchronize(initiator: Database, responder: Database, transport: Transport | None = None) -> tuple[SyncResult, SyncResult]:
    """One session; afterwards both replicas show the same, unless it was interrupted.

    Rows sent whole and catalog entries are one transaction, single writes and
    deletions another, so an interrupted session leaves each side in some valid
    state, and running it again completes it.
    """
    carry = (transport or Direct()).carry
    sides = {"initiator": initiator, "responder": responder}
    peer = {"initiator": "responder", "responder": "initiator"}
    results = {s: SyncResult() for s in sides}
    at = {s: Transaction(db) for s, db in sides.items()}
    for s in sides:
        if carry(s, "hello", PROTOCOL_VERSION) != PROTOCOL_VERSION:
            raise Custom("unsupported sync protocol version")
    for kind in ("manifest", "inventory"):
        for s in sides:
            carry(s, kind, None)
    plans = {s: outbound(at[s], at[peer[s]]) for s in sides}
    for s in sides:
        plan, sent, took = plans[s], results[s], results[peer[s]]
        # What was planned against the receiver's present version is new to it.
        seen = at[peer[s]].based_on
        carry(s, "state", lambda s=s, plan=plan: frames(outbound_units(at[s], plan)))
        with Transaction(sides[peer[s]]) as tx:
            fresh = tx.based_on == seen
            took.catalog_entries = apply_catalog(tx, plan.catalog)
            for table, ops in plan.snapshots.items():
                if (done := apply_ops(tx, table, ops, fresh)) is not None:
                    took.received_snapshots += done.agg(F.count_distinct("row_id")).first()[0]
        seen = tx.manifest["version"] if fresh else -1
        carry(s, "changes", lambda plan=plan: plan.changes)
        with Transaction(sides[peer[s]]) as tx:
            fresh = tx.based_on == seen
            for table, ops in plan.changes.items():
                if (done := apply_changes(tx, table, ops, fresh)) is not None:
                    took.received_changes += done.count()
            for table, gone in plan.deletions.items():
                if (done := tx.stage(table, tombstones=gone)) is not None:
                    took.received_deletions += done.count()
        sent.sent_snapshots, sent.sent_changes, sent.sent_deletions = took.received_snapshots, took.received_changes, took.received_deletions
        units = (sent.sent_snapshots + sent.sent_deletions + len(plan.catalog), sent.sent_changes)
        sent.frames = sum(math.ceil(n / UNITS_PER_FRAME) for n in units) + 4
        carry(s, "done", None)
    return results["initiator"], results["responder"]


def recover(db: Database, source: Database, table: str, rows: DataFrame) -> None:
    """Takes the whole state of the named rows from ``source``, for changes whose rows were missing."""
    theirs = Transaction(source)
    ops, gone = theirs.ops(table), theirs.tombstones(table)
    with Transaction(db) as tx:
        apply_catalog(tx, theirs.catalog.entries())
        if ops is not None:
            apply_ops(tx, table, ops.join(rows, "row_id", "left_semi"))
        if gone is not None:
            tx.stage(table, tombstones=gone.join(rows, "row_id", "left_semi"))


def converged(a: Database, b: Database) -> bool:
    """Whether both replicas have the same manifest."""
    one, two = manifest(state_units(a)), manifest(state_units(b))
    return not manifest_diff(one, two).limit(1).count() and not manifest_diff(two, one).limit(1).count()
