"""Tables kept up by streams equal their batch versions after any batches, retries and folds."""

import random

import pytest
from pyspark.sql import functions as F

from roomledger.operators.actions import latest_action
from roomledger.operators.gold import gold_hotel_month
from roomledger.operators.serving import one_per_key
from roomledger.operators.silver import silver_bookings
from roomledger.sources.tables import NoSnapshot, current_snapshot
from roomledger.streaming import kept

SCHEMA = "id long, reservation_id string, action_type string, note string, acted_by string, acted_at timestamp"


def stream(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(got, wanted):
    assert sorted(got.columns) == sorted(wanted.columns)
    assert sorted(map(str, got.select(*wanted.columns).collect())) == sorted(map(str, wanted.collect()))


def test_gold_after_batches_a_failed_one_and_folds(spark, bronze_row, folder):
    def arrive(*changes):
        silver_bookings(bronze_row(*changes)).coalesce(1).write.mode("append").parquet(f"{folder}/silver")

    def run():
        kept.keep_gold(stream(spark, f"{folder}/silver"), f"{folder}/gold", f"{folder}/cp").awaitTermination()
        return kept.read_kept(spark, f"{folder}/gold", kept.GOLD_KEYS)

    with pytest.raises(NoSnapshot):
        kept.read_kept(spark, f"{folder}/gold", kept.GOLD_KEYS)
    assert kept.fold(spark, f"{folder}/gold", kept.GOLD_KEYS) is None
    batch = lambda: gold_hotel_month(spark.read.parquet(f"{folder}/silver"))
    arrive({}, {"is_canceled": 1, "adr": "50.00"}, {"hotel": "Resort Hotel"})
    same(run(), batch())
    arrive({"is_canceled": 1}, {"arrival_date_month": "August"})
    arrive({"hotel": "Resort Hotel", "adr": "7.77"})
    same(run(), batch())
    assert kept.fold(spark, f"{folder}/gold", kept.GOLD_KEYS) == 1
    same(kept.read_kept(spark, f"{folder}/gold", kept.GOLD_KEYS), batch())

    arrive({"arrival_date_year": 2014, "adr": "1.00"}, {})  # much later than anything else
    write = kept.gold_hotel_month(stream(spark, f"{folder}/silver"))

    def fail(frame, number):
        frame.limit(0).write.mode("overwrite").parquet(f"{folder}/gold/changes/changed_in={number}")
        raise RuntimeError("killed")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept.ROCKSDB)
    try:
        failing = write.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).foreachBatch(fail).start()
        with pytest.raises(Exception):
            failing.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    same(run(), batch())
    same(run(), batch())
    for number in (2, 3):
        assert kept.fold(spark, f"{folder}/gold", kept.GOLD_KEYS) == number == current_snapshot(spark, f"{folder}/gold/folded")
        same(kept.read_kept(spark, f"{folder}/gold", kept.GOLD_KEYS), batch())
    arrive({"adr": "3.00"})
    same(run(), batch())


def test_latest_action_in_any_order(spark, folder):
    pick = random.Random(4)
    rows = [
        (i, f"r{pick.randrange(9)}", pick.choice(["note", "reconfirmed"]), pick.choice([None, "x"]), "desk", f"2024-01-0{pick.randint(1, 4)} 00:00:00")
        for i in range(200)
    ]
    pick.shuffle(rows)
    for k in range(4):
        frame = spark.createDataFrame(rows[k * 50 : (k + 1) * 50], SCHEMA.replace("acted_at timestamp", "at string"))
        frame.select("*", F.col("at").cast("timestamp").alias("acted_at")).drop("at").coalesce(1).write.mode("append").parquet(f"{folder}/actions")
        if k % 2:
            kept.keep_latest_actions(stream(spark, f"{folder}/actions"), f"{folder}/latest", f"{folder}/cp").awaitTermination()
            same(kept.read_kept(spark, f"{folder}/latest", ["reservation_id"]), latest_action(spark.read.parquet(f"{folder}/actions")))


def test_one_per_key_is_the_batch_survivor(spark, folder):
    pick = random.Random(6)
    for k in range(3):
        rows = [(pick.choice("abc") if pick.random() < 0.8 else None, pick.choice([None, 1, 2, 3]), pick.choice("xyz")) for _ in range(30)]
        spark.createDataFrame(rows, "k string, a int, b string").coalesce(1).write.mode("append").parquet(f"{folder}/rows")
    kept.keep_one_per_key(stream(spark, f"{folder}/rows"), "k", ["a", "b"], f"{folder}/one", f"{folder}/cp").awaitTermination()
    same(kept.read_kept(spark, f"{folder}/one", ["k"]), one_per_key(spark.read.parquet(f"{folder}/rows"), "k", ["a", "b"]))


def test_batches_are_parts_of_the_rows_without_a_shuffle(spark, folder):
    from roomledger.plans import queries

    rows, seen = spark.range(50).selectExpr("id AS k", "id % 7 AS v").unionByName(spark.range(5).selectExpr("id AS k", "id AS v")), []

    def keep(stream):
        seen.append(sorted(tuple(r) for r in spark.read.parquet(f"{folder}/rows").collect()))
        return kept.keep_one_per_key(stream, "k", ["v"], f"{folder}/one", f"{folder}/cp")

    queries._in_batches(spark, rows, f"{folder}/rows", keep)
    assert len(seen) == 3 and 0 < len(seen[0]) < len(seen[1]) < 55
    assert seen[2] == sorted(tuple(r) for r in rows.collect())
    assert kept.read_kept(spark, f"{folder}/one", ["k"]).count() == 50


def test_newest_versions_meet_by_packed_keys(spark):  # F10
    from roomledger.streaming.kept import _BATCH, _newest

    key = "0f" * 32
    versions = spark.createDataFrame([(key, 1, 1), (key, 2, 2), ("Not hex", 1, 3), (None, 1, 4)], f"k string, {_BATCH} long, v int")
    out = _newest(versions, ["k"])
    assert sorted(((r.k, r.v) for r in out.collect()), key=str) == sorted([(key, 2), ("Not hex", 3), (None, 4)], key=str)
    assert "unhex" in out._jdf.queryExecution().executedPlan().toString()
