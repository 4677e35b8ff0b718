import random

import pytest
from pyspark.sql import functions as F

from ledgerfold import Database, EngineError
from ledgerfold.errors import SyncDependencyUnavailable
from ledgerfold.functions.cells import cell_tuple
from ledgerfold.operators import oplog, sync
from ledgerfold.operators.transaction import Transaction
from ledgerfold.sources.store import OPS
from ledgerfold.streaming.changes import apply_stream, read_changes
from tests.engine.conftest import key, uid
from tests.engine.runners import LineDown

ONE, TWO = "000000000001", "000000000002"
PEOPLE = "CREATE TABLE people (id UUID PRIMARY KEY, name TEXT, city TEXT)"
ROWS = "SELECT name, city FROM people"


@pytest.fixture
def pair(spark):
    a, b = Database.in_memory(spark, actor="a"), Database.in_memory(spark, actor="b")
    a.translate_and_execute(f"{PEOPLE}; INSERT INTO people VALUES ({uid(ONE)}, 'Ada', 'London')")
    sync.synchronize(a, b)
    return a, b


def test_columns_merge_and_conflicts_resolve(pair):
    a, b = pair
    a.translate_and_execute("UPDATE people SET name = 'Grace' WHERE name = 'Ada'")
    b.translate_and_execute("UPDATE people SET city = 'Paris' WHERE name = 'Ada'")
    sync.synchronize(a, b)
    assert a.translate_and_select(ROWS).rows == b.translate_and_select(ROWS).rows == [("Grace", "Paris")]
    a.translate_and_execute("UPDATE people SET name = 'A' WHERE city = 'Paris'")
    b.translate_and_execute("UPDATE people SET name = 'B' WHERE city = 'Paris'")
    sync.synchronize(a, b)
    assert a.translate_and_select(ROWS).rows == b.translate_and_select(ROWS).rows
    assert a.row_conflicts("people", key(ONE)) == b.row_conflicts("people", key(ONE)) == ["name"]
    for sql in ("UPDATE people SET name = 'C' WHERE city = 'Paris'",):
        with pytest.raises(EngineError, match="Logical row column is conflicted"):
            a.translate_and_execute(sql)
    a.translate_and_execute("UPDATE people SET city = 'Rome' WHERE city = 'Paris'")
    for values, message in (
        ([], "requires an assignment"), ([("zz", 1)], "Unknown resolution column"), ([("city", 1)], "not conflicted"), ([("name", 1), ("name", 2)], "repeated"),
    ):
        with pytest.raises(EngineError, match=message):
            a.resolve_row("people", key(ONE), values)
    a.resolve_row("people", key(ONE), [("name", "Margaret")])
    sync.synchronize(b, a)
    assert a.translate_and_select(ROWS).rows == b.translate_and_select(ROWS).rows == [("Margaret", "Rome")]
    assert b.row_conflicts("people", key(ONE)) == [] and sync.converged(a, b)
    assert all(r.unchanged for r in sync.synchronize(a, b))


def test_deletion_wins_and_compaction_keeps_what_shows(pair):
    a, b = pair
    a.translate_and_execute("DELETE FROM people WHERE name = 'Ada'")
    b.translate_and_execute(f"UPDATE people SET name = 'X' WHERE name = 'Ada'; INSERT INTO people VALUES ({uid(TWO)}, 'Lin', 'Oslo'); UPDATE people SET city = 'Bergen' WHERE name = 'Lin'")
    sync.synchronize(a, b)
    assert a.translate_and_select(ROWS).rows == b.translate_and_select(ROWS).rows == [("Lin", "Bergen")]
    for db in pair:
        assert not db.needs_compaction("people") and db.needs_compaction("people", deltas=1)
        db.compact("people")
    assert b.ops("people").count() == 3
    assert a.translate_and_select(ROWS).rows == [("Lin", "Bergen")] and sync.converged(a, b)
    with pytest.raises(EngineError, match="deleted"):
        b.translate_and_execute(f"INSERT INTO people VALUES ({uid(ONE)}, 'Ada', 'x')")


def test_unique_contenders_after_sync(pair):
    a, b = pair
    a.translate_and_execute("CREATE UNIQUE INDEX people_city ON people (city)")
    sync.synchronize(a, b)
    a.translate_and_execute(f"UPDATE people SET city = 'Rome' WHERE city = 'London'")
    b.translate_and_execute(f"INSERT INTO people VALUES ({uid(TWO)}, 'Lin', 'Rome')")
    sync.synchronize(a, b)
    assert a.index_lookup("people_city", ("Rome",))[0] == b.index_lookup("people_city", ("Rome",))[0] == key(ONE)
    a.translate_and_execute("UPDATE people SET city = 'Paris' WHERE name = 'Ada'")
    assert a.index_lookup("people_city", ("Rome",))[0] == key(TWO)


def test_concurrent_columns_and_catalog_entries(pair):
    a, b = pair
    a.translate_and_execute("ALTER TABLE people ADD COLUMN role TEXT DEFAULT 'member'")
    b.translate_and_execute("ALTER TABLE people ADD COLUMN team TEXT DEFAULT 'core'")
    sync.synchronize(a, b)
    assert [c.name for c in a.table_schema("people").columns] == [c.name for c in b.table_schema("people").columns] == ["id", "name", "city", "role", "team"]
    assert b.translate_and_select("SELECT role, team FROM people").rows == [("member", "core")]
    b.execute([__import__("ledgerfold.plans.ir", fromlist=["DropTable"]).DropTable("people")])
    sync.synchronize(a, b)
    assert a.table_names() == b.table_names() == []


@pytest.mark.parametrize("sender", ["initiator", "responder"])
@pytest.mark.parametrize("kind", ["hello", "manifest", "inventory", "state", "changes", "done"])
def test_interrupted_sessions_are_repaired(pair, sender, kind):
    a, b = pair
    a.translate_and_execute("UPDATE people SET city = 'Rome' WHERE name = 'Ada'")
    b.translate_and_execute(f"INSERT INTO people VALUES ({uid(TWO)}, 'Lin', 'Oslo')")

    class Breaks:
        def carry(self, own, what, payload):
            if (own, what) == (sender, kind):
                raise LineDown
            return payload

    with pytest.raises(LineDown):
        sync.synchronize(a, b, Breaks())
    sync.synchronize(a, b)
    assert a.translate_and_select(ROWS).rows == b.translate_and_select(ROWS).rows == [("Ada", "Rome"), ("Lin", "Oslo")]


def test_changes_before_their_row(spark, pair):
    a, _ = pair
    late = Database.in_memory(spark, actor="c")
    changes = a.ops("people")
    with pytest.raises(SyncDependencyUnavailable):
        sync.apply_changes_atomically(late, "people", changes)
    sync.recover(late, a, "people", changes.select("row_id").distinct())
    sync.apply_changes_atomically(late, "people", changes)
    assert late.translate_and_select(ROWS).rows == [("Ada", "London")] and late.ops("people").count() == 3


def test_units_carry_a_replica(spark, pair):
    a, _ = pair
    a.translate_and_execute(f"INSERT INTO people VALUES ({uid(TWO)}, 'Lin', NULL); DELETE FROM people WHERE name = 'Ada'")
    copy = Database.in_memory(spark, actor="d")
    units = sync.state_units(a)
    sync.apply_units(copy, units)
    sync.apply_units(copy, units)
    assert copy.translate_and_select(ROWS).rows == [("Lin", None)] and sync.converged(a, copy)
    with pytest.raises(EngineError, match="Invalid sync state digest"):
        sync.apply_units(copy, units.withColumn("metadata", F.lit("x")))


def random_log(spark, seed):
    rng, rows = random.Random(seed), []
    for row in "pq":
        for col in "xy":
            live: list[str] = []
            for c in range(1, rng.randint(2, 8)):
                actor = rng.choice("ab")
                preds = [o for o in live if rng.random() < 0.7]
                rows.append((row, col, c, actor, f"{c}@{actor}", cell_tuple(rng.choice([1, "t", 2.5, None])), preds))
                live.append(f"{c}@{actor}")
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_merge_is_a_join_semilattice(spark, seed):
    rows, rng = random_log(spark, seed), random.Random(seed)
    parts = [spark.createDataFrame([r for r in rows if rng.random() < 0.6] or rows[:1], OPS) for _ in range(3)]
    shown = lambda log: sorted(map(str, oplog.visible_cells(log).collect()))
    a, b, c = parts
    assert shown(oplog.merge_logs(a, b, c)) == shown(oplog.merge_logs(c, b, a)) == shown(oplog.merge_logs(oplog.merge_logs(b, a), c, a, b))


def test_digest_is_sha256_of_lengths_and_bytes(spark):
    import hashlib

    state, metadata = "é" * 200, "m"
    raw = state.encode()
    wanted = hashlib.sha256(len(raw).to_bytes(8, "little") + raw + (1).to_bytes(8, "little") + b"m").hexdigest()
    assert spark.range(1).select(sync.digest(F.lit(state), F.lit(metadata))).first()[0] == wanted


def test_stream_is_idempotent(spark, pair, tmp_path):
    a, b = pair
    a.translate_and_execute("UPDATE people SET city = 'Rome' WHERE name = 'Ada'")
    folder = f"{tmp_path}/in"
    for _ in range(2):
        a.ops("people").write.mode("append").parquet(folder)
        apply_stream(b, "people", read_changes(b, folder), f"{tmp_path}/check").awaitTermination()
    assert b.translate_and_select(ROWS).rows == [("Ada", "Rome")] and b.ops("people").count() == a.ops("people").count()


def test_key_value_generations(spark):
    rows = [("k", 1, False, None, "old"), ("k", 2, True, None, "gone"), ("m", 1, False, 5, "late"), ("n", 3, False, 50, "new"), ("n", 2, False, None, "was")]
    df = spark.createDataFrame(rows, "key string, generation long, deleted boolean, expires long, value string")
    assert [tuple(r) for r in oplog.latest_generation(df, 10).collect()] == [("n", "new")]


def test_registered_files_take_writes(spark):
    db = Database.in_memory(spark)
    db.register_files("region", "/root/testdata/sf0.001/region.parquet", key="r_regionkey")
    db.translate_and_execute("INSERT INTO region (r_regionkey, r_name) VALUES (9, 'NEW'); UPDATE region SET r_name = 'X' WHERE r_regionkey = 1; DELETE FROM region WHERE r_regionkey = 2")
    assert sorted(db.translate_and_select("SELECT r_regionkey, r_name FROM region WHERE r_regionkey <= 9").rows)[1:3] == [(1, "X"), (3, sorted(db.translate_and_select("SELECT r_regionkey, r_name FROM region").rows)[2][1])]
    assert Transaction(db).scan("region").df.count() == 5


def test_frames_hold_64_sorted_units(pair, spark):
    a, b = pair
    rows = spark.range(10, 210).selectExpr("concat('00000000-0000-7000-8000-', lpad(hex(id), 12, '0')) AS id", "concat('n', id) AS name").selectExpr("lower(id) AS id", "name")
    a.insert_frame("people", rows)
    carried = {}

    class Listening:
        def carry(self, sender, kind, payload):
            if kind in ("state", "changes"):
                carried[sender, kind] = payload() if kind == "changes" else [(r.frame, r.key) for r in payload().orderBy("key").collect()]
            return payload

    took = sync.synchronize(a, b, Listening())
    sent = carried["initiator", "state"]
    assert [f for f, _ in sent] == [i // 64 for i in range(len(sent))]
    assert sum(k.startswith("row/people/") for _, k in sent) == took[0].sent_snapshots == 200
    assert sync.frames(sync.state_units(a).where("false")).count() == 0
    assert sync.converged(a, b)
