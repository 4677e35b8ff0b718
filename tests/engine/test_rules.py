"""The rules of values, predicates and statements that plain SQL gets wrong."""

import dataclasses
import math
import uuid

import pytest

from ledgerfold import Database, EngineError
from ledgerfold.errors import FromRowError, MissingTimestampProvider, TranslateError, UriError
from ledgerfold.functions.values import Json, ValueType, order_key, show_json, uuid7, values_equal
from ledgerfold.plans import ir
from ledgerfold.plans.sql import translate
from ledgerfold.sources.store import parse_uri
from tests.engine.conftest import key, uid

A, B, C = "123456789abc", "123456789abd", "123456789abe"
T = "CREATE TABLE t (id UUID PRIMARY KEY, i INTEGER, f FLOAT, s TEXT, b BOOLEAN)"


@pytest.fixture(scope="module")
def filled(spark):
    db = Database.in_memory(spark)
    db.translate_and_execute(T)
    db.execute([
        ir.Insert("t", (key(A), 1, -0.0, "a", True)), ir.Insert("t", (key(B), 2, 5.5, None, False)), ir.Insert("t", (key(C), None, -3.0, "b", None)),
        ir.Insert("t", (key("123456789abf"), 7, math.nan, "é", True)),
    ])
    return db


@pytest.mark.parametrize(
    "where, rows",
    [
        ("i = NULL", []), ("(i = NULL) = FALSE", [1, 2, None, 7]), ("(i = s) IS NULL", []), ("1", []), ("b", [1, 7]), ("'x' OR b", [1, 7]),
        ("i = 1.0", []), ("i <> 1.0", [1, 2, 7]), ("i < 1.5", [1, 2, 7]), ("f > 5", [1, 2, None, 7]), ("s > 1", [1, 2, None, 7][0:1] + [None, 7]),
        ("f = 0.0", []), ("f > 5.0", [1, 2, None, 7]), ("f > 6.0", [1, None, 7]), ("f < 6.0", [2]), ("f <> 5.5", [1, None, 7]), ("f >= 5.5", [1, 2, None, 7]), ("f <= 5.5", [2]),
        ("6.0 > f", [2]), ("f > f", []), ("f = f", [1, 2, None, 7]), ("i >= 2 AND i < 7", [2]), ("i = 1 OR s = 'b'", [1, None]), ("i IS NULL", [None]), ("NULL IS NULL", [1, 2, None, 7]),
        ("(i = 1 OR i = 2) AND (b = TRUE OR s IS NULL)", [1, 2]), ("b < 1", [1, 2, 7]), ("s >= 'b'", [None, 7]), ("1 = 1", [1, 2, None, 7]), ("1 = 1.0", []),
    ],
)
def test_where(filled, where, rows):
    assert [r[0] for r in filled.translate_and_select(f"SELECT i FROM t WHERE {where}").rows] == rows


@pytest.mark.parametrize(
    "sql, message",
    [
        ("SELECT * FROM t WHERE i = -1", "Unsupported expression"), ("SELECT * FROM t WHERE i + 1 = 2", "Unsupported binary operator"), ("SELECT * FROM t WHERE NOT b", "Unsupported expression"),
        ("SELECT * FROM t WHERE i IN (1)", "Unsupported expression"), ("SELECT * FROM t WHERE s LIKE 'a'", "Unsupported expression"), ("SELECT * FROM t WHERE i BETWEEN 1 AND 2", "Unsupported expression"),
        ("SELECT * FROM t WHERE i = 1e5", "Invalid integer literal: 1e5"), ("SELECT * FROM t WHERE id = CAST('x' AS UUID)", "Invalid UUID literal"), ("SELECT * FROM t WHERE i = CAST(1 AS UUID)", "UUID casts require text values"),
        ("SELECT * FROM t WHERE i = CAST('1' AS INTEGER)", "Unsupported cast"), ("WITH x AS (SELECT 1) SELECT * FROM x", "CTEs not yet supported"), ("SELECT i FROM t UNION SELECT i FROM t", "Only plain SELECT"),
        ("SELECT 1", "Missing FROM clause"), ("SELECT t.* FROM t", "Unsupported projection item"), ("SELECT * FROM a.t", "Unsupported table name with 2 parts"), ("SELECT * FROM t HAVING i = 1", "HAVING is not supported"),
        ("SELECT * FROM t CROSS JOIN u", "Unsupported JOIN type"), ("SELECT * FROM t INNER JOIN u USING (id)", "USING joins"), ("SELECT * FROM t NATURAL INNER JOIN u", "NATURAL joins"), ("SELECT * FROM t INNER JOIN u", "JOIN without ON"),
        ("CREATE TABLE u (id UUID PRIMARY KEY, d DATE)", "Unsupported column data type"), ("CREATE TABLE u (id UUID PRIMARY KEY, d INT DEFAULT (1+1))", "Unsupported binary operator"), ("DROP VIEW v", "DROP VIEW not supported"),
        ("ALTER TABLE t DROP COLUMN s", "Only ALTER TABLE ADD COLUMN"), ("CREATE INDEX ON t (s)", "CREATE INDEX requires an index name"), ("CREATE INDEX x ON t (s DESC)", "bare identifier"), ("INSERT INTO t VALUES (i)", "Unsupported expression in VALUES"),
        ("UPDATE t SET i = s + 1 WHERE i = 1", "UPDATE assignments require a value"), ("DELETE FROM t INNER JOIN u ON t.i = u.i WHERE i = 1", "Joins in DELETE"), ("DELETE FROM t, u WHERE i = 1", "Only one table in DELETE"), ("TRUNCATE t", "Unsupported SQL statement"),
        ("CREATE TABLE u (id UUID PRIMARY KEY, UNIQUE (zz))", "UNIQUE column not found"), ("INSERT INTO t (i) VALUES (1) RETURNING t.i", "Unsupported RETURNING identifier"), ("SELECT * FROM t WHERE s IS DISTINCT FROM 'a'", "Unsupported expression"),
        ("SELECT 'a", "sql parser error"), ("SELECT * FROM t; SELECT", "sql parser error"),
    ],
)
def test_translation_errors(sql, message):
    with pytest.raises(TranslateError, match=message.replace("+", r"\+").replace(".", r"\.")) as e:
        translate(sql)
    assert str(e.value).startswith("Translate error: Error: ")


@pytest.mark.parametrize(
    "sql, message",
    [
        ("SELECT x FROM t", "Unknown projection column"), ("SELECT u.i FROM t", "Unknown projection table"), ("SELECT i FROM t WHERE zz = 1", "Unknown predicate column"), ("SELECT i FROM t INNER JOIN t ON t.i = t.i", "complex SELECT"),
        ("INSERT INTO t VALUES (1)", "INSERT column/value count mismatch"), ("INSERT INTO t (zz) VALUES (1)", "Unknown INSERT column"), ("INSERT INTO t (i, i) VALUES (1, 2)", "Duplicate INSERT column"), ("INSERT INTO t DEFAULT VALUES", "count mismatch"),
        ("INSERT INTO t SELECT * FROM t", "count mismatch"), (f"INSERT INTO t (id) VALUES ({uid(A)})", "Primary key already exists"), ("INSERT INTO t (i) VALUES (1) RETURNING zz", "Unknown RETURNING column"),
        ("UPDATE t SET id = NULL WHERE i = 1", "Cannot update the primary key"), ("UPDATE t SET i = 2", "UPDATE and DELETE require column equality predicates"), ("UPDATE t SET i = 2 WHERE i > 1", "require column equality predicates"),
        ("UPDATE t SET i = s WHERE i = 1", "UPDATE column assignments"), ("UPDATE t SET zz = 1 WHERE i = 1", "Unknown assignment column"), ("UPDATE t SET i = 1 WHERE zz = 1", "Unknown predicate column"), ("DELETE FROM t AS q WHERE q.i = 1", "Unknown column table"),
        ("CREATE TABLE t (id UUID PRIMARY KEY)", "Table already exists"), ("CREATE TABLE u (id INT PRIMARY KEY)", "Primary key must have UUID type"), ("CREATE TABLE u (id UUID)", "Table requires a UUID primary key"),
        ("CREATE TABLE u (a UUID PRIMARY KEY, b UUID PRIMARY KEY)", "Table requires exactly one primary key"), ("CREATE INDEX x ON t (zz)", "Index column not found"), ("CREATE INDEX x ON u (i)", "Table not found"), ("DROP INDEX x", "Index not found"),
        ("ALTER TABLE t ADD COLUMN s TEXT", "Column already exists"), ("ALTER TABLE t ADD COLUMN k UUID PRIMARY KEY", "Cannot add a primary-key column"), ("ALTER TABLE u ADD COLUMN s TEXT", "Table not found"), ("ALTER INDEX x RENAME TO y", "only CREATE TABLE"),
        ("SELECT * FROM T", "Table not found"), ("SELECT I FROM t", "Unknown projection column"),
    ],
)
def test_execution_errors_change_nothing(filled, sql, message):
    before = filled.store.latest()["version"]
    with pytest.raises(EngineError, match=message):
        filled.translate_and_execute(sql)
    assert filled.store.latest()["version"] == before


def test_unknown_columns_matter_only_to_rows_that_reach_them(filled, db):
    assert filled.translate_and_select("SELECT i FROM t WHERE i = 99 AND zz = 1").rows == []
    assert len(filled.translate_and_select("SELECT i FROM t WHERE i IS NULL OR i IS NOT NULL OR zz = 1").rows) == 4
    db.translate_and_execute(T)
    assert db.translate_and_select("SELECT i FROM t WHERE zz = 1").rows == []


def test_projection(filled):
    out = filled.translate_and_select("SELECT id, *, t.s AS other FROM t WHERE i = 1")
    assert [c.name for c in out.columns] == ["id", "id", "i", "f", "s", "b", "s"]
    assert out.columns[6] == ir.ResultColumn("s", "t", "s")
    assert out.rows[0][0] == key(A) and str(out.rows[0][3]) == "-0.0"


def test_mutations(db):
    db.translate_and_execute(T)
    with pytest.warns(UserWarning, match="first tuple"):
        db.translate_and_execute("INSERT INTO t (i, s) VALUES (1, 'a'), (2, 'b')")
    db.translate_and_execute("INSERT INTO t (id, i, s) VALUES (DEFAULT, 3, NULL)")
    db.translate_and_execute("UPDATE t SET s = 'x', s = 'null was here' WHERE s = NULL")
    assert sorted(db.translate_and_select("SELECT i, s FROM t").rows) == [(1, "a"), (3, "null was here")]
    db.translate_and_execute("UPDATE t SET i = 'text' WHERE 3 = i")
    assert db.translate_and_select("SELECT i FROM t WHERE i > 5").rows == [("text",)]
    assert db.translate_and_execute("UPDATE t SET i = 1 WHERE i = 99; DELETE FROM t WHERE i = 1; SELECT i FROM t")[2].rows == [("text",)]
    with pytest.raises(EngineError, match="Expected one query result"):
        db.translate_and_select("SELECT i FROM t; SELECT i FROM t")
    assert db.translate_and_select("SELECT i FROM t WHERE s = $1").rows == []


def test_deleted_keys_never_return(db):
    db.translate_and_execute(f"CREATE TABLE u (id UUID PRIMARY KEY); INSERT INTO u VALUES ({uid(A)}); DELETE FROM u WHERE id = {uid(A)}")
    with pytest.raises(EngineError, match="Primary key was deleted"):
        db.translate_and_execute(f"INSERT INTO u VALUES ({uid(A)})")


def test_unique_indexes(db):
    db.translate_and_execute(f"CREATE TABLE u (id UUID PRIMARY KEY, a TEXT, b INT, UNIQUE (a, b)); INSERT INTO u VALUES ({uid(A)}, 'x', 1); INSERT INTO u VALUES ({uid(B)}, 'x', NULL); INSERT INTO u VALUES ({uid(C)}, 'x', NULL)")
    assert db.index_schema("u_unique_0_a_b") == ir.IndexSchema("u_unique_0_a_b", "u", ("a", "b"), True)
    with pytest.raises(EngineError, match="Unique index violation"):
        db.translate_and_execute(f"UPDATE u SET b = 1 WHERE id = {uid(B)}")
    with pytest.raises(EngineError, match="Unique index violation"):
        db.translate_and_execute("UPDATE u SET b = 2 WHERE b = NULL")
    with pytest.raises(EngineError, match="Unique index violation"):
        db.translate_and_execute("CREATE UNIQUE INDEX ua ON u (a)")
    db.translate_and_execute("CREATE INDEX ua ON u (a)")
    assert db.index_lookup("ua", ("x",))[0] == key(A)
    assert db.index_lookup("ua", (None,)) is None and db.index_lookup("ua", ("y",)) is None
    with pytest.raises(EngineError, match="wrong column count"):
        db.index_lookup("ua", ("x", 1))
    db.execute([ir.CreateIndex(ir.IndexSchema("ua", "u", ("b",)), if_not_exists=True)])
    assert db.index_schema("ua").columns == ("b",)
    db.translate_and_execute("CREATE INDEX IF NOT EXISTS ua ON u (a)")
    assert db.index_schema("ua").columns == ("b",)


def test_drop_and_create_again_brings_rows_back(wide):
    wide.translate_and_execute(f"CREATE TABLE u (id UUID PRIMARY KEY, a TEXT); INSERT INTO u VALUES ({uid(A)}, 'x'); DROP TABLE u")
    assert wide.table_names() == []
    wide.translate_and_execute("CREATE TABLE u (id UUID PRIMARY KEY, other TEXT)")
    assert wide.translate_and_select("SELECT * FROM u").rows == [(key(A), "x", None)]


def test_values_order():
    ordered = [None, ValueType.TEXT, uuid.UUID(int=1), False, True, -5, 3, 0.0, 1.5, math.inf, -0.0, -1.5, "", "a", "é", Json([]), b"", b"\x00", b"\xff"]
    assert sorted(reversed(ordered), key=order_key) == ordered
    assert not values_equal(0.0, -0.0) and values_equal(math.nan, math.nan) and not values_equal(1, 1.0) and values_equal(Json(1), Json(1.0))
    assert show_json({"b": [1, 2.0, None], "a": 'q"'}) == '{"a": "q"", "b": [1, 2, null]}'


def test_json_blob_and_other_types_round_trip(db):
    db.translate_and_execute("CREATE TABLE v (id UUID PRIMARY KEY, j JSON, x BLOB)")
    db.execute([ir.Insert("v", (key(A), Json({"a": [1]}), b"\x01\xff")), ir.Insert("v", (key(B), "text", ValueType.BLOB)), ir.Insert("v", ("q",)[:0] + (key(C), 1.5))])
    assert db.translate_and_select("SELECT j, x FROM v").rows == [(Json({"a": [1]}), b"\x01\xff"), ("text", ValueType.BLOB), (1.5, None)]
    assert db.get_row("v", key(A)) == (key(A), Json({"a": [1]}), b"\x01\xff")
    assert db.get_row("v", key("123456789000")) is None


def test_clock():
    assert uuid7(lambda: 1 << 40).int >> 80 == 1 << 40
    with pytest.raises(MissingTimestampProvider):
        uuid7(lambda: None)


def test_uris(spark, tmp_path):
    assert parse_uri(":in_memory:") is None and parse_uri("ledger://./a/b") == "./a/b"
    for bad, message in (("ledger://", "file URI missing path"), ("sqlite:///x", "unsupported URI scheme: sqlite:///x")):
        with pytest.raises(UriError, match=message):
            parse_uri(bad)
    one = Database.open_uri(spark, f"ledger://{tmp_path}/db")
    one.translate_and_execute(f"CREATE TABLE u (id UUID PRIMARY KEY); INSERT INTO u VALUES ({uid(A)})")
    one.close()
    assert Database.open(spark, f"{tmp_path}/db").translate_and_select("SELECT id FROM u").rows == [(key(A),)]


def test_writers_do_not_overwrite_each_other(db):
    from ledgerfold.operators.transaction import Transaction

    db.translate_and_execute("CREATE TABLE u (id UUID PRIMARY KEY)")
    late = Transaction(db)
    late.insert_row("u", (key(A),), None)
    db.translate_and_execute(f"INSERT INTO u VALUES ({uid(B)})")
    with pytest.raises(EngineError, match="Transaction conflict"):
        late.commit()


@dataclasses.dataclass
class Record:
    number: float = dataclasses.field(metadata={"column": "i"})
    s: str | None


def test_records(filled):
    out = filled.translate_and_select("SELECT i, s FROM t WHERE i IS NOT NULL")
    assert out.rows_as(Record) == [Record(1.0, "a"), Record(2.0, None), Record(7.0, "é")]
    with pytest.raises(FromRowError, match="missing column i"):
        filled.translate_and_select("SELECT s FROM t").rows_as(Record)
    with pytest.raises(FromRowError, match="duplicate column s"):
        filled.translate_and_select("SELECT i, s, s FROM t").rows_as(Record)
    with pytest.raises(FromRowError, match="invalid value for column i"):
        filled.translate_and_select("SELECT i, s FROM t").rows_as(Record)


def test_parameters(wide):
    wide.translate_and_execute("CREATE TABLE u (id UUID PRIMARY KEY, a TEXT, n INT)")
    wide.translate_and_execute("INSERT INTO u (a, n) VALUES (?, ?)", ["x", 4])
    assert wide.translate_and_select("SELECT a FROM u WHERE n = :n", {"n": 4}).rows == [("x",)]
    with pytest.raises(EngineError, match="Missing named parameter: m"):
        wide.translate_and_select("SELECT a FROM u WHERE n = :m", {"n": 4})
    with pytest.raises(EngineError, match="cannot mix"):
        wide.translate_and_select("SELECT a FROM u WHERE n = :n AND a = $1", {"n": 4})


def test_pushdown_reaches_the_files(spark):
    db = Database.in_memory(spark)
    db.register_files("orders", "/root/testdata/sf0.001/orders.parquet", key="o_orderkey")
    df = db.dataframe("SELECT o_orderkey FROM orders WHERE o_orderkey >= 5 AND o_orderstatus = 'F'")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(o_orderkey,5)" in plan and "EqualTo(o_orderstatus,F)" in plan
    assert "o_custkey" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("most", [None, -1])
def test_small_and_large_logs_show_the_same(spark, monkeypatch, most):
    """Whether the log is broadcast or shuffled: rows of files, changed, deleted and new ones."""
    from ledgerfold.operators import transaction

    if most is not None:
        monkeypatch.setattr(transaction, "BROADCAST_BYTES", most)
        monkeypatch.setattr(transaction, "BROADCAST_ROWS", most)
    db = Database.in_memory(spark)
    db.register_files("nation", "/root/testdata/sf0.001/nation.parquet", key="n_nationkey")
    db.translate_and_execute("CREATE UNIQUE INDEX names ON nation (n_name)")
    db.translate_and_execute(f"INSERT INTO nation (id, n_nationkey, n_name) VALUES ({uid(A)}, 99, 'new')")
    db.translate_and_execute("UPDATE nation SET n_name = 'moved' WHERE n_nationkey = 3; DELETE FROM nation WHERE n_nationkey = 4")
    with pytest.raises(EngineError, match="Unique index violation"):
        db.translate_and_execute("UPDATE nation SET n_name = 'moved' WHERE n_nationkey = 5")
    with pytest.raises(EngineError, match="Unique index violation"):
        db.translate_and_execute("UPDATE nation SET n_name = 'same' WHERE n_regionkey = 1")
    shown = {r.n_nationkey: r.n_name for r in db.dataframe("SELECT n_nationkey, n_name FROM nation").collect()}
    files = {r.n_nationkey: r.n_name for r in spark.read.parquet("/root/testdata/sf0.001/nation.parquet").collect()}
    assert shown == {k: v for k, v in files.items() if k != 4} | {3: "moved", 99: "new"}
    plan = db.dataframe("SELECT n_name FROM nation")._jdf.queryExecution().toString()
    assert ("FullOuter" in plan) == (most == -1)
    db.close()


def plan_of(spark, df):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    return plan


def test_ids_are_tested_by_their_keys(spark):
    """Equality and ranges of ids reach the files as tests of keys, with and without a log."""
    from ledgerfold.functions.values import key_uuid

    db = Database.in_memory(spark)
    db.register_files("orders", "/root/testdata/sf0.001/orders.parquet", key="o_orderkey")
    where = f"SELECT o_orderkey FROM orders WHERE id {{}} CAST('{key_uuid(7)}' AS UUID)"
    assert "EqualTo(o_orderkey,7)" in plan_of(spark, db.dataframe(where.format("=")))
    assert "LessThan(o_orderkey,7)" in plan_of(spark, db.dataframe(where.format("<")))
    db.translate_and_execute(f"INSERT INTO orders (id, o_orderkey) VALUES ({uid(A)}, 900000); UPDATE orders SET o_orderstatus = 'Z' WHERE o_orderkey = 7")
    assert "EqualTo(o_orderkey,7)" in plan_of(spark, db.dataframe(where.format("=")))
    assert db.dataframe(where.format("=")).collect() == [(7,)]
    assert db.get_row("orders", key(A))[1] == 900000
    assert db.get_row("orders", uuid.UUID(key_uuid(7)))[4 - 1] == "Z"
    assert [r[0] for r in db.dataframe(f"SELECT o_orderkey FROM orders WHERE id >= {uid(A)}").collect()] == [900000]
    db.close()


def test_matched_rows_are_found_by_the_files(spark):
    from ledgerfold.operators.transaction import Transaction

    db = Database.in_memory(spark)
    db.register_files("orders", "/root/testdata/sf0.001/orders.parquet", key="o_orderkey")
    (delete,) = translate("DELETE FROM orders WHERE o_orderkey = 3")
    _, ids = Transaction(db).matched("orders", delete.predicate, "DELETE")
    assert "EqualTo(o_orderkey,3)" in plan_of(spark, ids)


def test_mixed_columns_join_by_hash(spark):
    db = Database.in_memory(spark, profile="extended")
    for name, k in (("nation", "n_nationkey"), ("region", "r_regionkey")):
        db.register_files(name, f"/root/testdata/sf0.001/{name}.parquet", key=k)
    db.translate_and_execute("UPDATE nation SET n_regionkey = 'two' WHERE n_regionkey = 2; UPDATE nation SET n_regionkey = NULL WHERE n_regionkey = 3")
    for text in (
        "SELECT n_name FROM nation INNER JOIN region ON nation.n_regionkey = region.r_regionkey",
        "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)",
    ):
        df = db.dataframe(text)
        assert df.count() == 15 and "NestedLoop" not in plan_of(spark, df)
    db.close()


def test_a_new_manifest_is_whole_or_not_there(spark):
    from ledgerfold.errors import Custom
    from ledgerfold.sources.store import EMPTY_MANIFEST

    db = Database.in_memory(spark)
    db.translate_and_execute("CREATE TABLE u (id UUID PRIMARY KEY)")
    with pytest.raises(Custom, match="Transaction conflict"):
        db.store.publish(dict(EMPTY_MANIFEST), 0)
    assert db.table_names() == ["u"]
    names = [s.getPath().getName() for s in db.store.fs.listStatus(db.store._path(f"{db.store.root}/versions"))]
    assert [n for n in names if not n.endswith(".crc")] == ["000000000001.json"]
    db.close()
