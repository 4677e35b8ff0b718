"""Logs that are too large to broadcast: results stay, and what a task sorts is bounded."""

import pytest
from pyspark.sql import functions as F

from ledgerfold import Database
from ledgerfold.errors import InvalidQuery
from ledgerfold.operators import oplog, transaction
from ledgerfold.operators.scan import row_uuid


@pytest.fixture()
def large(monkeypatch):
    monkeypatch.setattr(transaction, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(oplog, "ROWS_A_TASK", 500, raising=False)


def rows(spark, first, n):
    return spark.range(first, first + n, numPartitions=1).select(row_uuid(F.col("id")).alias("id"), F.col("id").alias("k"), F.format_string("n%d", "id").alias("name"))


def filled(spark):
    db = Database.in_memory(spark, actor="a")
    db.translate_and_execute("CREATE TABLE t (id UUID PRIMARY KEY, k INTEGER UNIQUE, name TEXT, note TEXT DEFAULT 'x')")
    db.insert_frame("t", rows(spark, 0, 1500))
    return db


def test_rows_are_dealt_out_before_they_are_sorted(spark, large):
    df = filled(spark).dataframe("SELECT k, name, note FROM t")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange") :]
    assert df.rdd.getNumPartitions() == 12  # 6,000 writes
    assert sorted(map(tuple, df.collect())) == [(i, f"n{i}", "x") for i in range(1500)]


def test_writes_and_refusals(spark, large):
    db = filled(spark)
    db.translate_and_execute("UPDATE t SET name = 'new' WHERE k = 7; UPDATE t SET name = 'newer' WHERE k = 7")
    for first, n, said in ((1499, 2, "already exists"), (2000, 0, None), (1500, 2, None)):
        if said:
            with pytest.raises(InvalidQuery, match=said):
                db.insert_frame("t", rows(spark, first, n))
        else:
            db.insert_frame("t", rows(spark, first, n))
    twice = rows(spark, 3000, 1).unionByName(rows(spark, 3000, 1))
    shared = rows(spark, 3000, 1).withColumn("k", F.lit(7).cast("bigint"))
    for df, said in ((twice, "already exists"), (shared, "Unique"), (shared.withColumn("id", F.lit(None).cast("string")), "must be a UUID")):
        with pytest.raises(InvalidQuery, match=said):
            db.insert_frame("t", df)
    wanted = [(i, "newer" if i == 7 else f"n{i}") for i in range(1502)]
    assert sorted(map(tuple, db.dataframe("SELECT k, name FROM t").collect())) == wanted


def test_live_writes_by_any_join(spark, large, monkeypatch):
    log = [(str(r), "c", n, "a", f"{n}@a", None, [f"{n - 1}@a"] if n > 1 else []) for r in range(40) for n in range(1, 4)]
    ops = spark.createDataFrame(log, transaction.OPS)
    wanted = sorted(map(str, oplog.visible_cells(ops).collect()))
    assert len(wanted) == 40
    for most in (100, 10):
        monkeypatch.setattr(oplog, "BROADCAST_NAMES", most)
        assert sorted(map(str, oplog.visible_cells(ops, len(log), 80).collect())) == wanted
