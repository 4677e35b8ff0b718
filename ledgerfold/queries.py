"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.database import Database
from ledgerfold.functions.cells import Typed, to_cell
from ledgerfold.functions.values import ValueType
from ledgerfold.operators import oplog, sync
from ledgerfold.operators.scan import row_uuid
from ledgerfold.plans import ir

KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
    "orders": "o_orderkey", "events": "event_id", "lineitem": None,
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_UUID = "'00000000-0000-7000-8000-' || printf('%012x', {})"


def database(spark: SparkSession, sf_dir: str, *tables: str, profile: str = "strict") -> Database:
    """A session's database over files of ``sf_dir``."""
    db = Database.in_memory(spark, profile=profile)
    for t in tables:
        db.register_files(t, f"{sf_dir}/{t}.parquet", key=KEYS[t])
    return db


def query(name: str, oracle: str):
    def register(f):
        QUERIES[name], ORACLE_SQL[name] = f, oracle
        return f

    return register


def sql(name: str, tables: str, text: str, oracle: str | None = None, profile: str = "strict", before: str = "") -> None:
    """A query that runs ``before`` and then selects ``text``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir, *tables.split(), profile=profile)
        if before:
            db.translate_and_execute(before)
        return db.dataframe(text)

    QUERIES[name], ORACLE_SQL[name] = run, oracle or text


def extended(name: str, tables: str, text: str, oracle: str | None = None, before: str = "") -> None:
    sql(name, tables, text, oracle, "extended", before)


# -- scans, projections, filters

sql("scan_project", "orders", "SELECT o_orderkey, o_totalprice FROM orders")
sql("scan_wildcard", "region", "SELECT * FROM region", f"SELECT {_UUID.format('r_regionkey')} AS id, CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
sql("scan_qualified", "nation", "SELECT nation.n_name FROM nation", "SELECT n_name FROM nation")
sql("filter_eq_text", "orders", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
sql("filter_ne_text", "orders", "SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT'")
sql("filter_range_int", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 500")
sql("filter_range_float", "lineitem", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 30.0 AND l_quantity < 40.0")
sql(
    "filter_float_bit_order", "customer", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000.0",
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 OR c_acctbal < 0",
)
sql("filter_cross_rank_lt", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey < 1.5", "SELECT o_orderkey FROM orders")
sql("filter_cross_rank_eq", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey = 1.0", "SELECT o_orderkey FROM orders WHERE false")
sql("filter_cross_rank_ne", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey <> 'a'", "SELECT o_orderkey FROM orders")
sql("filter_and_or_nested", "orders", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND (o_totalprice < 50000.0 OR o_orderkey < 1000)")
sql("filter_non_boolean", "orders", "SELECT o_orderkey FROM orders WHERE 1", "SELECT o_orderkey FROM orders WHERE false")
sql(
    "filter_uuid_cast", "orders", "SELECT o_orderkey FROM orders WHERE id < CAST('00000000-0000-7000-8000-000000000100' AS UUID)",
    "SELECT o_orderkey FROM orders WHERE o_orderkey < 256",
)
sql("alias_discarded", "region", "SELECT r_name AS n FROM region", "SELECT r_name FROM region")
sql(
    "filter_is_null", "nation", "SELECT n_nationkey FROM nation WHERE n_name IS NULL",
    "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE n_regionkey = 2", before="UPDATE nation SET n_name = NULL WHERE n_regionkey = 2",
)
sql(
    "filter_is_not_null", "nation", "SELECT n_nationkey, n_name FROM nation WHERE n_name IS NOT NULL",
    "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_regionkey <> 2", before="UPDATE nation SET n_name = NULL WHERE n_regionkey = 2",
)
sql(
    "filter_two_valued", "nation", "SELECT n_nationkey FROM nation WHERE (n_name = NULL) = FALSE",
    "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation", before="UPDATE nation SET n_name = NULL WHERE n_regionkey = 2",
)

# -- INSERT, UPDATE, DELETE, DDL

sql(
    "insert_defaults", "", "SELECT name, stock FROM goods",
    "SELECT * FROM (VALUES ('unknown', CAST(7 AS BIGINT)), ('Ada', CAST(0 AS BIGINT))) AS t(name, stock)",
    before="CREATE TABLE goods (id UUID PRIMARY KEY, name TEXT DEFAULT 'unknown', stock INTEGER DEFAULT 0);"
    "INSERT INTO goods (stock) VALUES (7); INSERT INTO goods (name) VALUES ('Ada')",
)


@query("insert_returning", "SELECT '00000000-0000-7000-8000-000000000007' AS id, 'Ada' AS name")
def insert_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    db.translate_and_execute("CREATE TABLE goods (id UUID PRIMARY KEY, name TEXT)")
    (out,) = db.translate_and_execute("INSERT INTO goods VALUES (CAST('00000000-0000-7000-8000-000000000007' AS UUID), 'Ada') RETURNING *")
    return spark.createDataFrame([(str(out.rows[0][0]), out.rows[0][1])], "id string, name string")


@query("insert_first_tuple_only", "SELECT CAST(1 AS BIGINT) AS n")
def insert_first_tuple_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    import warnings

    db = database(spark, sf_dir)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        db.translate_and_execute("CREATE TABLE t (id UUID PRIMARY KEY, n INTEGER); INSERT INTO t (n) VALUES (1), (2), (3)")
    return db.dataframe("SELECT n FROM t")


extended(
    "insert_all_tuples", "", "SELECT n FROM t", "SELECT * FROM (VALUES (CAST(1 AS BIGINT)), (CAST(2 AS BIGINT)), (CAST(3 AS BIGINT))) AS t(n)",
    before="CREATE TABLE t (id UUID PRIMARY KEY, n INTEGER); INSERT INTO t (n) VALUES (1), (2), (3)",
)
_BASE_UPDATED = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_regionkey = 1 THEN 'moved' ELSE n_name END AS n_name FROM nation"
sql("update_literal", "nation", "SELECT n_nationkey, n_name FROM nation", _BASE_UPDATED, before="UPDATE nation SET n_name = 'moved' WHERE n_regionkey = 1")
sql(
    "update_matches_null", "nation", "SELECT n_nationkey, n_name FROM nation", _BASE_UPDATED,
    before="UPDATE nation SET n_name = NULL WHERE n_regionkey = 1; UPDATE nation SET n_name = 'moved' WHERE n_name = NULL",
)
sql(
    "update_mixed_type", "nation", "SELECT n_nationkey FROM nation WHERE n_name < 'A'",
    "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE n_regionkey = 1 OR n_name < 'A'",
    before="UPDATE nation SET n_name = 5 WHERE n_regionkey = 1",
)
sql(
    "delete_tombstone", "supplier", "SELECT s_suppkey, s_name FROM supplier", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey <> 3",
    before="DELETE FROM supplier WHERE s_nationkey = 3",
)
sql(
    "delete_then_filter", "supplier", "SELECT s_suppkey FROM supplier WHERE s_acctbal >= 1000.0",
    "SELECT s_suppkey FROM supplier WHERE s_nationkey <> 3 AND (s_acctbal >= 1000 OR s_acctbal < 0)", before="DELETE FROM supplier WHERE s_nationkey = 3",
)
sql("add_column_default", "part", "SELECT p_partkey, role FROM part", "SELECT p_partkey, 'member' AS role FROM part", before="ALTER TABLE part ADD COLUMN role TEXT DEFAULT 'member'")
sql(
    "add_column_then_update", "part", "SELECT p_partkey, role FROM part", "SELECT p_partkey, CASE WHEN p_size = 7 THEN 'guest' ELSE 'member' END AS role FROM part",
    before="ALTER TABLE part ADD COLUMN role TEXT DEFAULT 'member'; UPDATE part SET role = 'guest' WHERE p_size = 7",
)
extended("drop_recreate_table", "region", "SELECT r_name FROM region", before="DROP TABLE region; CREATE TABLE region (id UUID PRIMARY KEY)")
extended("drop_column", "region", "SELECT * FROM region", f"SELECT {_UUID.format('r_regionkey')} AS id, CAST(r_regionkey AS BIGINT) AS r_regionkey FROM region", before="ALTER TABLE region DROP COLUMN r_name")


@query("insert_frame", "SELECT c_custkey, c_name, c_acctbal, 'x' AS note FROM customer")
def insert_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole frame as inserts, with keys and a unique index checked by joins."""
    db = Database.in_memory(spark)
    db.translate_and_execute("CREATE TABLE c (id UUID PRIMARY KEY, c_custkey INTEGER UNIQUE, c_name TEXT, c_acctbal FLOAT, note TEXT DEFAULT 'x')")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    db.insert_frame("c", rows.select(row_uuid(F.col("c_custkey")).alias("id"), "c_custkey", "c_name", "c_acctbal"))
    return db.dataframe("SELECT c_custkey, c_name, c_acctbal, note FROM c")


# -- indexes


@query("index_lookup_lowest_uuid", "SELECT min(c_custkey) AS c_custkey, 'BUILDING' AS c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def index_lookup_lowest_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "customer")
    db.translate_and_execute("CREATE INDEX segments ON customer (c_mktsegment)")
    row = db.index_lookup("segments", ("BUILDING",))
    names = [c.name for c in db.table_schema("customer").columns]
    found = [] if row is None else [(row[names.index("c_custkey")], "BUILDING")]
    return spark.createDataFrame(found, "c_custkey long, c_mktsegment string")


@query("unique_contenders", "SELECT c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY c_mktsegment")
def unique_contenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who holds each value of a unique key that several rows claim."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("row_id", row_uuid(F.col("c_custkey")))
    return oplog.contenders(rows, ["c_mktsegment"]).where("rank = 1").select("c_mktsegment", "c_custkey")


@query("unique_violations", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a unique index over (l_orderkey, l_linenumber) would refuse."""
    db = database(spark, sf_dir, "lineitem", profile="extended")
    return db.dataframe("SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1")


# -- the log


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes: the user is the row, the type the column; nobody has seen another's write."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    counter = F.unix_micros(F.col("ts").cast("timestamp"))
    actor = F.lpad(F.col("event_id").cast("string"), 12, "0")
    return events.select(
        F.col("user_id").cast("string").alias("row_id"), F.col("event_type").alias("col"), counter.alias("counter"), actor.alias("actor"),
        F.concat_ws("@", counter.cast("string"), actor).alias("op_id"), to_cell(Typed(F.col("value"), ValueType.FLOAT)).alias("cell"),
        F.array().cast("array<string>").alias("preds"),
    )


@query("oplog_visible_value", "SELECT CAST(user_id AS VARCHAR) AS row_id, event_type AS col, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def oplog_visible_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.visible_cells(event_ops(spark, sf_dir)).select("row_id", "col", F.col("cell.d").alias("value"))


@query("oplog_conflicts", "SELECT CAST(user_id AS VARCHAR) AS row_id, event_type AS col, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def oplog_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.conflicts(event_ops(spark, sf_dir))


@query("oplog_resolve", "SELECT CAST(user_id AS VARCHAR) AS row_id, event_type AS col, CAST(count(*) AS DOUBLE) AS value, CAST(1 AS BIGINT) AS n FROM events GROUP BY ALL")
def oplog_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell settled by a write that replaces all of its live ones."""
    ops = event_ops(spark, sf_dir)
    live = oplog.visible_cells(ops)
    settled = live.withColumn("cell", to_cell(Typed(F.col("n").cast("double"), ValueType.FLOAT)))
    merged = oplog.merge_logs(ops, oplog.make_ops(settled, "resolver"))
    return oplog.visible_cells(merged).select("row_id", "col", F.col("cell.d").alias("value"), "n")


@query("oplog_merge", "SELECT CAST(user_id AS VARCHAR) AS row_id, event_type AS col, count(*) AS n FROM events GROUP BY ALL")
def oplog_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping replicas' logs, merged without repeated writes."""
    ops = event_ops(spark, sf_dir)
    left, right = ops.where(F.col("actor") % 3 != 0), ops.where(F.col("actor") % 3 != 1)
    return oplog.merge_logs(left, right).groupBy("row_id", "col").agg(F.count("*").alias("n"))


@query(
    "tombstone_scan",
    "SELECT CAST(user_id AS VARCHAR) AS row_id, event_type AS col, count(*) AS n FROM events "
    "WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 95) GROUP BY ALL",
)
def tombstone_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log compacted: rows that were deleted are gone."""
    ops = event_ops(spark, sf_dir)
    gone = ops.where((F.col("col") == "error") & (F.col("cell.d") > 95)).select("row_id").distinct()
    return oplog.compact(ops, gone).groupBy("row_id", "col").agg(F.count("*").alias("n"))


@query(
    "kv_latest_generation",
    "SELECT key, value FROM (SELECT user_id AS key, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS t FROM events GROUP BY ALL) WHERE t <> 'error'",
)
def kv_latest_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    entries = events.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("generation"), (F.col("event_type") == "error").alias("deleted"),
        F.lit(None).cast("long").alias("expires"), "value",
    )
    return oplog.latest_generation(entries, 0)


# -- synchronisation


_UNIT_KEY = f"'row/n/' || {_UUID.format('s_suppkey')}"
_UNIT_STATE = (
    """'[{"col":"city","counter":1,"actor":"a","op_id":"1@a","preds":[],"cell":{"t":0}},{"col":"id","counter":1,"actor":"a","op_id":"1@a","preds":[],"cell":{"t":2,"s":"' || """
    + _UUID.format("s_suppkey")
    + """ || '"}},{"col":"k","counter":1,"actor":"a","op_id":"1@a","preds":[],"cell":{"t":4,"i":' || s_suppkey || '}},{"col":"name","counter":1,"actor":"a","op_id":"1@a","preds":[],"cell":{"t":6,"s":"' || s_name || '"}}]'"""
)
_DIGEST = "sha256(unhex(printf('%02x', strlen(state) % 256) || printf('%02x', strlen(state) // 256) || '000000000000') || encode(state) || unhex('0000000000000000'))"
_UNITS = f"SELECT key, state, '' AS metadata, {_DIGEST} AS digest FROM (SELECT {_UNIT_KEY} AS key, {_UNIT_STATE} AS state FROM supplier)"


def _rows_of(units: DataFrame) -> DataFrame:
    return units.where("key LIKE 'row/%'")


def _loaded(spark: SparkSession, sf_dir: str, actor: str = "a") -> Database:
    """A replica with all suppliers."""
    db = Database.in_memory(spark, actor=actor)
    db.translate_and_execute("CREATE TABLE n (id UUID PRIMARY KEY, k INTEGER, name TEXT, city TEXT)")
    db.insert_frame("n", _suppliers(spark, sf_dir))
    return db


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return rows.select(row_uuid(F.col("s_suppkey")).alias("id"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))


@query("state_units", _UNITS)
def state_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows' units of a replica, with their digests."""
    return _rows_of(sync.state_units(_loaded(spark, sf_dir)))


@query("manifest", f"SELECT key, digest FROM ({_UNITS})")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _rows_of(sync.state_units(_loaded(spark, sf_dir)))
    return sync.manifest(units.unionByName(units))


@query("manifest_diff", f"SELECT {_UNIT_KEY} AS key FROM supplier WHERE s_suppkey % 2 = 1 OR s_suppkey IN (2, 4)")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second replica has and the first lacks or has otherwise."""
    a, b = _replicas(spark, sf_dir)
    return _rows_of(sync.manifest_diff(sync.manifest(sync.state_units(b)), sync.manifest(sync.state_units(a)))).select("key")


@query(
    "frames",
    f"SELECT frame, CAST(count(*) AS BIGINT) AS units, min(key) AS first, max(key) AS last FROM (SELECT key, CAST((row_number() OVER (ORDER BY key) - 1) // 64 AS BIGINT) AS frame FROM ({_UNITS})) GROUP BY frame",
)
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replica's rows in the frames that a session would send."""
    cut = sync.frames(_rows_of(sync.state_units(_loaded(spark, sf_dir))))
    return cut.groupBy("frame").agg(F.count("*").alias("units"), F.min("key").alias("first"), F.max("key").alias("last"))


def _replicas(spark: SparkSession, sf_dir: str) -> tuple[Database, Database]:
    """Two replicas of one table: evens here, odds there, and both have changed what they share."""
    rows = _suppliers(spark, sf_dir)
    a, b = Database.in_memory(spark, actor="a"), Database.in_memory(spark, actor="b")
    a.translate_and_execute("CREATE TABLE n (id UUID PRIMARY KEY, k INTEGER, name TEXT, city TEXT)")
    a.insert_frame("n", rows.where("k % 2 = 0"))
    sync.synchronize(a, b)
    b.insert_frame("n", rows.where("k % 2 = 1"))
    a.translate_and_execute("UPDATE n SET name = 'A' WHERE k = 2; DELETE FROM n WHERE k = 4")
    b.translate_and_execute("UPDATE n SET city = 'B' WHERE k = 2; UPDATE n SET city = 'late' WHERE k = 4")
    return a, b


_SYNCED = "SELECT s_suppkey AS k, CASE WHEN s_suppkey = 2 THEN 'A' ELSE s_name END AS name, CASE WHEN s_suppkey = 2 THEN 'B' END AS city FROM supplier WHERE s_suppkey <> 4"


@query("sync_session", f"SELECT 'a' AS replica, * FROM ({_SYNCED}) UNION ALL SELECT 'b' AS replica, * FROM ({_SYNCED})")
def sync_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both replicas after one session: columns merge, the deletion wins over a write."""
    a, b = _replicas(spark, sf_dir)
    sync.synchronize(a, b)
    text = "SELECT k, name, city FROM n"
    return a.dataframe(text).withColumn("replica", F.lit("a")).unionByName(b.dataframe(text).withColumn("replica", F.lit("b")))


@query(
    "outbound_plan",
    "SELECT 'change' AS what, CAST(2 AS BIGINT) AS n UNION ALL SELECT 'snapshot', CAST(count(*) AS BIGINT) FROM supplier WHERE s_suppkey % 2 = 1",
)
def outbound_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second replica would send: rows that the first lacks whole, single writes of others."""
    from ledgerfold.operators.transaction import Transaction

    a, b = _replicas(spark, sf_dir)
    plan = sync.outbound(Transaction(b), Transaction(a))
    rows = plan.snapshots["n"].select(F.count_distinct("row_id").alias("n")).withColumn("what", F.lit("snapshot"))
    return rows.unionByName(plan.changes["n"].select(F.count("*").alias("n")).withColumn("what", F.lit("change"))).select("what", "n")


@query("inventory_diff", "SELECT CAST(user_id AS VARCHAR) AS row_id, event_type AS col, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY ALL")
def inventory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that a replica's inventory lacks, per cell."""
    ops = event_ops(spark, sf_dir)
    other = sync.change_inventory(ops.where(F.col("actor").cast("long") % 3 != 0))
    return ops.join(other, ["row_id", "col", "op_id"], "left_anti").groupBy("row_id", "col").agg(F.count("*").alias("n"))


@query("snapshot_recovery", "SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey = 1")
def snapshot_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row whose changes came before it, taken whole."""
    a, b = _replicas(spark, sf_dir)
    a = Database.in_memory(spark, actor="c")
    sync.recover(a, b, "n", b.ops("n").select("row_id").distinct().where(F.expr("conv(right(row_id, 1), 16, 10) % 2 = 0 OR right(row_id, 12) = '000000000001'")))
    return a.dataframe("SELECT k FROM n")


@query(
    "catalog_export",
    "SELECT * FROM (VALUES ('fields', 't|id'), ('fields', 't|name'), ('index_fields', 't_unique_0_name|0'), ('indexes', 't_unique_0_name'), ('tables', 't')) AS e(kind, key)",
)
def catalog_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database.in_memory(spark)
    db.translate_and_execute("CREATE TABLE t (id UUID PRIMARY KEY, name TEXT UNIQUE)")
    return spark.createDataFrame([(k, key.replace("\0", "|")) for k, key, _ in db.export_catalog_entries()], "kind string, key string")


@query(
    "system_tables",
    "SELECT * FROM (VALUES ('t', 'id', 0, true), ('t', 'name', 1, false)) AS e(table_name, column_name, position, primary_key)",
)
def system_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database.in_memory(spark)
    db.translate_and_execute("CREATE TABLE t (id UUID PRIMARY KEY, name TEXT UNIQUE)")
    return db.system_table("__engine_table_fields").select("table_name", "column_name", "position", "primary_key")


@query("stream_changes", "SELECT CAST(user_id AS VARCHAR) AS row_id, event_type AS col, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that arrive as a stream of files, some of them twice."""
    from ledgerfold.streaming.changes import apply_stream, read_changes

    db = Database.in_memory(spark)
    db.translate_and_execute("CREATE TABLE e (id UUID PRIMARY KEY)")
    ops = event_ops(spark, sf_dir)
    folder = f"{db.store.root}/incoming"
    ops.write.parquet(folder)
    ops.where(F.col("actor").cast("long") % 2 == 0).write.mode("append").parquet(folder)
    stream = apply_stream(db, "e", read_changes(db, folder), f"{db.store.root}/stream")
    stream.awaitTermination()
    return oplog.visible_cells(db.ops("e")).select("row_id", "col", F.col("cell.d").alias("value"))


# -- the extended profile

_JOIN = "SELECT c_custkey, o_orderkey FROM customer {} JOIN orders ON customer.c_custkey = orders.o_custkey AND o_totalprice > 400000.0"
extended("join_inner", "customer orders", "SELECT c_name, o_orderkey FROM customer INNER JOIN orders ON customer.c_custkey = orders.o_custkey WHERE c_mktsegment = 'BUILDING'")
extended("join_left", "customer orders", _JOIN.format("LEFT"))
extended("join_right", "customer orders", "SELECT c_custkey, o_orderkey FROM customer RIGHT JOIN orders ON customer.c_custkey = orders.o_custkey AND c_mktsegment = 'BUILDING'")
extended("join_full", "customer orders", "SELECT c_custkey, o_orderkey FROM customer FULL JOIN orders ON customer.c_custkey = orders.o_custkey AND o_totalprice > 400000.0 AND c_mktsegment = 'BUILDING'")
extended(
    "join_self", "nation", "SELECT a.n_name AS one, b.n_name AS two FROM nation AS a INNER JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
)
extended("agg_count_star", "orders", "SELECT COUNT(*) AS n FROM orders")
extended("agg_count", "orders", "SELECT COUNT(o_custkey) AS n FROM orders WHERE o_orderstatus = 'O'")
extended("agg_count_distinct", "orders", "SELECT COUNT(DISTINCT o_custkey) AS n FROM orders")
extended("agg_count_distinct_multi", "orders", "SELECT COUNT(DISTINCT o_custkey, o_orderstatus) AS n FROM orders", "SELECT count(DISTINCT (o_custkey, o_orderstatus)) AS n FROM orders")
extended("agg_sum", "orders", "SELECT SUM(o_orderkey) AS s FROM orders", "SELECT CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders")
extended("agg_avg", "orders", "SELECT AVG(o_orderkey) AS a FROM orders")
extended("agg_min_max", "orders", "SELECT MIN(o_orderpriority) AS lo, MAX(o_totalprice) AS hi FROM orders")
extended("agg_max_float_bits", "customer", "SELECT MAX(c_acctbal) AS hi, MIN(c_acctbal) AS lo FROM customer", "SELECT min(c_acctbal) AS hi, min(CASE WHEN c_acctbal >= 0 THEN c_acctbal END) AS lo FROM customer")
extended("group_by", "lineitem", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_orderkey) AS s, MAX(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus",
         "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS s, max(l_quantity) AS q FROM lineitem GROUP BY ALL")
extended("having", "orders", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
extended("order_by_limit", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
extended("limit_offset", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
extended("distinct", "orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
extended("in_list", "orders", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
extended("not_in_list", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (1, 2, 3)")
extended("in_subquery", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000.0)")
extended("like", "part", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%'")
extended("not_predicate", "orders", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_orderkey < 100)")
extended("exists", "customer orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT o_orderkey FROM orders WHERE o_orderkey = 1)")
extended("not_exists", "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT o_orderkey FROM orders WHERE o_orderkey < 0)")


@query("params_bound", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 90000")
def params_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "orders", profile="extended")
    return db.dataframe("SELECT o_orderkey FROM orders WHERE o_orderstatus = :s AND o_totalprice < :k", {"s": "F", "k": 90000.0})


@query("statements_as_data", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def statements_as_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same engine without SQL text."""
    column = lambda c: ir.QueryColumn("orders", c)
    where = ir.Comparison("=", ir.ColumnRef(column("o_orderstatus")), ir.Literal("F"))
    return database(spark, sf_dir, "orders").dataframe(ir.Select(ir.From("orders"), (column("o_orderkey"),), where))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered file through parser, binder and rank folding to a pushed-down scan."""
    return database(spark, sf_dir, "lineitem").dataframe("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30.0 AND l_returnflag = 'R'")


QUERIES["flagship"] = flagship
ORACLE_SQL["flagship"] = "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30.0 AND l_returnflag = 'R'"


# -- keys, indexes, DDL and refusals


@query("large_keys", "SELECT id, k FROM (SELECT k, '00000000-0000-' || CASE WHEN k < 0 THEN '6' ELSE '7' END || '00' || h[1] || '-8' || h[2:4] || '-' || h[5:16] AS id FROM (SELECT k, printf('%016x', CAST(CASE WHEN k < 0 THEN CAST(k AS HUGEINT) + 9223372036854775808 ELSE k END AS BIGINT)) AS h FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN 281474976710656 + o_orderkey WHEN 2 THEN 9223372036854775807 - o_orderkey ELSE -o_orderkey END AS k FROM orders))) WHERE k <> 5")
def large_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all 64 bits have ids of their own, in the keys' order, and a deletion hits one row."""
    key = "CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN 281474976710656 + o_orderkey WHEN 2 THEN 9223372036854775807 - o_orderkey ELSE -o_orderkey END AS k"
    db = Database.in_memory(spark)
    path = f"{db.store.root}/large"
    spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(key).write.parquet(path)
    db.register_files("t", path, key="k")
    db.translate_and_execute("DELETE FROM t WHERE k = 5")
    return db.dataframe("SELECT id, k FROM t")


@query("point_get", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 77")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from ledgerfold.functions.values import key_uuid

    db = database(spark, sf_dir, "orders")
    row = db.get_row("orders", uuid.UUID(key_uuid(77)))
    names = [c.name for c in db.table_schema("orders").columns]
    return spark.createDataFrame([] if row is None else [(row[names.index("o_orderkey")], row[names.index("o_orderstatus")])], "o_orderkey long, o_orderstatus string")


sql(
    "filter_uuid_range", "orders", "SELECT o_orderkey FROM orders WHERE id >= CAST('00000000-0000-7000-8000-000000000100' AS UUID) AND id <= CAST('00000000-0000-7000-8000-0000000001ff' AS UUID)",
    "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 256 AND 511",
)
extended(
    "join_mixed_types", "nation region", "SELECT n_nationkey, r_name FROM nation INNER JOIN region ON nation.n_regionkey = region.r_regionkey",
    "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey <> 2",
    before="UPDATE nation SET n_regionkey = 'two' WHERE n_regionkey = 2",
)


def told(spark: SparkSession, attempts) -> DataFrame:
    """What each attempt, a name and a function, is refused with."""
    from ledgerfold.errors import EngineError

    rows = []
    for name, attempt in attempts:
        try:
            attempt()
            rows.append((name, "taken"))
        except EngineError as e:
            rows.append((name, str(e)))
    return spark.createDataFrame(rows, "what string, said string")


@query(
    "unique_refused",
    "SELECT what, said, n FROM (VALUES ('frame', 'Invalid query: Unique index violation'), ('tuple', 'Invalid query: Unique index violation'), ('update', 'Invalid query: Unique index violation'), ('null', 'taken')) AS t(what, said), (SELECT count(*) + 1 AS n FROM supplier)",
)
def unique_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that would share a unique key are refused, whole, and null keys aren't held against each other."""
    db = _loaded(spark, sf_dir)
    db.translate_and_execute("CREATE UNIQUE INDEX names ON n (name)")
    frame = _suppliers(spark, sf_dir).select(row_uuid(F.col("k") + 1_000_000).alias("id"), "name")
    out = told(spark, [
        ("frame", lambda: db.insert_frame("n", frame)), ("tuple", lambda: db.translate_and_execute(_taken_name(db))),
        ("update", lambda: db.translate_and_execute("UPDATE n SET name = 'same' WHERE city = NULL")), ("null", lambda: db.translate_and_execute("INSERT INTO n (name) VALUES (NULL)")),
    ])
    return out.join(db.dataframe("SELECT k FROM n").agg(F.count("*").alias("n")), F.lit(True))


def _taken_name(db: Database) -> str:
    (first, *_) = db.translate_and_select("SELECT name FROM n WHERE k = 1").rows
    return f"INSERT INTO n (k, name) VALUES (0, '{first[0]}')"


@query("resolve_row", "SELECT replica, s_suppkey AS k, CASE WHEN s_suppkey = 2 THEN 'C' ELSE s_name END AS name FROM supplier, (VALUES ('a'), ('b')) AS r(replica)")
def resolve_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both replicas write one cell; one settles it, and the other learns of it."""
    import uuid

    from ledgerfold.functions.values import key_uuid

    a, b = _loaded(spark, sf_dir), Database.in_memory(spark, actor="b")
    sync.synchronize(a, b)
    a.translate_and_execute("UPDATE n SET name = 'A' WHERE k = 2")
    b.translate_and_execute("UPDATE n SET name = 'B' WHERE k = 2")
    sync.synchronize(a, b)
    a.resolve_row("n", uuid.UUID(key_uuid(2)), [("name", "C")])
    sync.synchronize(a, b)
    text = "SELECT k, name FROM n"
    return a.dataframe(text).withColumn("replica", F.lit("a")).unionByName(b.dataframe(text).withColumn("replica", F.lit("b")))


@query("apply_changes", "SELECT * FROM (VALUES ('early', 'Sync dependency is unavailable'), ('late', 'taken'), ('again', 'taken')) AS t(what, said)")
def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single writes of a row that isn't here are refused, then taken after the row, and taking them again changes nothing."""
    a, b = _loaded(spark, sf_dir), Database.in_memory(spark, actor="b")
    ops = a.ops("n")
    a.translate_and_execute("UPDATE n SET city = 'Oslo' WHERE k = 2")
    changes = a.ops("n").where("counter > 1")
    b.translate_and_execute("CREATE TABLE n (id UUID PRIMARY KEY, k INTEGER, name TEXT, city TEXT)")

    def late() -> None:
        with _transaction(b) as tx:
            sync.apply_ops(tx, "n", ops)
        again()

    def again() -> None:
        sync.apply_changes_atomically(b, "n", changes)

    out = told(spark, [("early", again), ("late", late), ("again", again)])
    shown = {r.city for r in b.dataframe("SELECT city FROM n WHERE k = 2").collect()}
    return out if shown == {"Oslo"} else out.where("false")


def _transaction(db: Database):
    from ledgerfold.operators.transaction import Transaction

    return Transaction(db)


@query("index_ddl", "SELECT * FROM (VALUES ('rename', 'taken'), ('old name', 'Invalid query: Index not found'), ('lookup', 'taken'), ('drop', 'taken'), ('dropped', 'Invalid query: Index not found'), ('rebuild', 'Invalid query: Unique index violation')) AS t(what, said)")
def index_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes renamed, dropped, and built over rows that share a key."""
    db = database(spark, sf_dir, "customer", profile="extended")
    run = lambda text: lambda: db.translate_and_execute(text)
    db.translate_and_execute("CREATE INDEX segments ON customer (c_mktsegment)")
    return told(spark, [
        ("rename", run("ALTER INDEX segments RENAME TO parts")), ("old name", lambda: db.index_lookup("segments", ("BUILDING",))), ("lookup", lambda: db.index_lookup("parts", ("BUILDING",))),
        ("drop", run("DROP INDEX parts")), ("dropped", lambda: db.index_schema("parts")), ("rebuild", run("CREATE UNIQUE INDEX parts ON customer (c_mktsegment)")),
    ])


@query("column_tombstone", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey FROM region")
def column_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "region")
    db.tombstone_column("region", "r_name")
    return db.dataframe("SELECT * FROM region").drop("id")


@query("catalog_apply", "SELECT * FROM (VALUES ('earlier', 'Invalid query: Table not found'), ('later', 'taken'), ('stale', 'taken'), ('unknown', 'Error: Invalid catalog key')) AS t(what, said)")
def catalog_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another replica's entries are taken if they are later; stale ones change nothing."""
    a, b = Database.in_memory(spark, actor="a"), Database.in_memory(spark, actor="b")
    a.translate_and_execute("CREATE TABLE t (id UUID PRIMARY KEY, name TEXT)")
    entries = a.export_catalog_entries()

    def take() -> None:
        for e in entries:
            b.apply_catalog_entry(*e)
        b.table_schema("t")

    return told(spark, [("earlier", lambda: b.table_schema("t")), ("later", take), ("stale", take), ("unknown", lambda: b.apply_catalog_entry("rows", "t", "{}"))])


@query(
    "refusals",
    "SELECT * FROM (VALUES ('batch', 'Invalid query: Primary key must be a UUID'), ('nothing of it', 'Invalid query: Table not found'), ('conflict', 'Error: Transaction conflict'), ('uri', 'Error: unsupported URI scheme: file:///x')) AS t(what, said)",
)
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch is all or nothing, a late writer is refused, and so is an unknown address."""
    db = Database.in_memory(spark)

    def late() -> None:
        tx = _transaction(db)
        tx.catalog.create_table(ir.TableSchema("late", (ir.ColumnSchema("id", ValueType.UUID, None, True),)))
        db.translate_and_execute("CREATE TABLE first (id UUID PRIMARY KEY)")
        tx.commit()

    return told(spark, [
        ("batch", lambda: db.translate_and_execute("CREATE TABLE t (id UUID PRIMARY KEY); INSERT INTO t VALUES (1)")), ("nothing of it", lambda: db.table_schema("t")),
        ("conflict", late), ("uri", lambda: Database.open_uri(spark, "file:///x")),
    ])


@query("implicit_order", "SELECT CAST(row_number() OVER (ORDER BY s_suppkey) AS BIGINT) AS place, s_suppkey AS k FROM supplier")
def implicit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a result come in the order of their ids."""
    rows = _loaded(spark, sf_dir).translate_and_select("SELECT k FROM n").rows
    return spark.createDataFrame([(i, k) for i, (k,) in enumerate(rows, 1)], "place long, k long")


@query("file_formats", "SELECT format, n_nationkey, n_name FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation), (VALUES ('csv'), ('json'), ('orc'), ('parquet')) AS f(format)")
def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table by way of each file format."""
    from ledgerfold.sources.files import write_files

    db, out = Database.in_memory(spark), None
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    for form in ("csv", "json", "orc", "parquet"):
        path = f"{db.store.root}/{form}"
        write_files(rows, path, form)
        db.register_files(form, path, form, key="n_nationkey", schema="n_nationkey int, n_name string")
        own = db.dataframe(f"SELECT n_nationkey, n_name FROM {form}").withColumn("format", F.lit(form))
        out = own if out is None else out.unionByName(own)
    return out
