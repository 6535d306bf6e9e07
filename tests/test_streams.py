import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from roomledger.operators import actions as a
from roomledger.operators.silver import silver_bookings
from roomledger.schemas import ACTION_SCHEMA, BRONZE_SCHEMA, SOURCE_SCHEMA
from roomledger.sources import tables
from roomledger.sources.landing import csv_batch, infer_schema
from roomledger.streaming import actions as log
from roomledger.streaming.medallion import build_silver, count_rules, land_csv, rule_totals

HEADER = ",".join(SOURCE_SCHEMA.names)
GOOD = (
    "City Hotel,0,10,2016,July,27,1,1,2,2,0,0,BB,PRT,Online TA,TA/TO,0,0,0,A,A,0,No Deposit,9,,0,"
    "Transient,100.00,0,0,Check-Out,2016-07-04"
)


def write(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as out:
        out.write("\n".join([HEADER, *lines]) + "\n")


@pytest.fixture
def local(folder):
    """The test folder as a plain path, for writing source files into it."""
    return folder.removeprefix("file:")


def land(spark, local):
    query = land_csv(spark, f"{local}/csv", f"{local}/bronze", f"{local}/cp/bronze")
    query.awaitTermination()
    return spark.read.parquet(f"{local}/bronze")


def test_landing_is_incremental_and_repeatable(spark, local):
    write(f"{local}/csv", "a.csv", GOOD, GOOD)
    assert land(spark, local).count() == 2
    assert land(spark, local).count() == 2  # the same file again adds nothing
    write(f"{local}/csv", "b.csv", GOOD)
    bronze = land(spark, local)
    assert bronze.count() == 3
    assert bronze.where("_ingested_at IS NULL OR _rescued_data IS NOT NULL").count() == 0
    files = sorted(os.path.basename(r[0]) for r in bronze.select("_source_file").distinct().collect())
    assert files == ["a.csv", "b.csv"]
    assert bronze.select(*BRONZE_SCHEMA.names).schema.simpleString() == BRONZE_SCHEMA.simpleString()


def test_bad_values_and_lines_are_rescued(spark, local):
    bad_value = GOOD.replace(",10,2016,", ",soon,2016,").replace("100.00", "cheap")
    write(f"{local}/csv", "a.csv", GOOD, bad_value, GOOD + ",extra", "City Hotel,1")
    rows = land(spark, local).collect()
    assert len(rows) == 4
    rescued = [json.loads(r._rescued_data) for r in rows if r._rescued_data]
    assert len(rescued) == 3 and all(r["_file_path"].endswith("a.csv") for r in rescued)
    value = next(r for r in rescued if "lead_time" in r)
    assert (value["lead_time"], value["adr"]) == ("soon", "cheap") and "_corrupt_record" not in value
    assert {r["_corrupt_record"] for r in rescued if "_corrupt_record" in r} == {
        GOOD + ",extra", "City Hotel,1"
    }
    kept = next(r for r in rows if r._rescued_data and "soon" in r._rescued_data)
    assert kept.lead_time is None and kept.hotel == "City Hotel" and kept.arrival_date_year == 2016


def test_schema_is_inferred_once(spark, local):
    write(f"{local}/csv", "a.csv", GOOD)
    schema = infer_schema(spark, f"{local}/csv")
    types = {f.name: f.dataType.simpleString() for f in schema.fields}
    assert types["lead_time"] == "int" and types["hotel"] == "string" and types["adr"] == "double"
    assert csv_batch(spark, f"{local}/csv", schema).first().adr == 100.0


def test_bronze_to_silver_stream_equals_the_batch(spark, local):
    write(f"{local}/csv", "a.csv", GOOD, GOOD.replace("100.00", "-6.38"), GOOD.replace(",2,0,0,BB", ",0,NA,0,BB"))
    bronze = land(spark, local)
    query = build_silver(spark, f"{local}/bronze", f"{local}/silver", f"{local}/cp/silver")
    query.awaitTermination()
    silver = spark.read.parquet(f"{local}/silver")
    want = silver_bookings(bronze.select(*BRONZE_SCHEMA.names))
    assert silver.count() == 2
    assert sorted(silver.select(*want.columns).collect(), key=str) == sorted(want.collect(), key=str)
    for _ in range(2):
        count_rules(spark, f"{local}/bronze", f"{local}/rules", f"{local}/cp/rules").awaitTermination()
        assert rule_totals(spark, f"{local}/rules").first().asDict() == {
            "valid_hotel": 0, "non_negative_adr": 1, "has_guests": 1, "clean_parse": 0, "rows": 3
        }
    again = build_silver(spark, f"{local}/bronze", f"{local}/silver", f"{local}/cp/silver")
    again.awaitTermination()
    assert spark.read.parquet(f"{local}/silver").count() == 2


@pytest.fixture
def raw_actions(spark):
    t = datetime(2026, 1, 1, 12)
    rows = [
        (1, "r1", "reconfirmed", "n1", "u", t),
        (2, "r1", "deposit_requested", None, "u", t),
        (3, "r1", "overbooked_backup", None, "u", datetime(2026, 1, 1, 11)),
        (4, "r2", "released", None, "u", t),
        (5, "r2", "note", "text", "u", None),
        (6, "r2", "refund", None, "u", t),
        (7, None, "note", None, "u", t),
        (8, "r3", None, None, "u", t),
    ]
    return spark.createDataFrame(rows, ACTION_SCHEMA)


def test_actions_are_split(raw_actions):
    valid, rejected = a.split_actions(raw_actions)
    assert sorted(r.id for r in valid.collect()) == [1, 2, 3, 4, 5]
    assert {r.id: r.reason for r in rejected.collect()} == {
        6: "unknown action_type", 7: "reservation_id is null", 8: "action_type is null"
    }
    assert valid.where("acted_at IS NULL").count() == 0


def test_latest_action_and_order(raw_actions):
    valid = a.split_actions(raw_actions)[0]
    assert {r.reservation_id: r.id for r in a.latest_action(valid).collect()} == {"r1": 2, "r2": 5}
    assert [r.id for r in a.prior_actions(valid, "r1").collect()] == [2, 1, 3]
    assert a.prior_actions(valid, "none").count() == 0


def test_latest_action_combines_before_the_shuffle(raw_actions):
    plan = a.latest_action(raw_actions)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Window" not in plan


def test_detail(spark, raw_actions):
    serving = spark.createDataFrame([("r1", 0.9), ("r9", 0.1)], "reservation_id string, cancel_probability double")
    valid = a.split_actions(raw_actions)[0]
    got = [(r.reservation_id, r.action_id, r.cancel_probability) for r in a.reservation_detail(serving, valid).collect()]
    assert sorted(got, key=str) == [("r1", 1, 0.9), ("r1", 2, 0.9), ("r1", 3, 0.9), ("r9", None, 0.1)]
    newest_first = a.reservation_detail(serving, valid, "r1").collect()
    assert [r.action_id for r in newest_first] == [2, 1, 3]
    one = a.reservation_detail(serving, valid, "r9").collect()
    assert [(r.reservation_id, r.action_type) for r in one] == [("r9", None)]


def test_log_round_trip(spark, folder, raw_actions):
    assert log.read_actions(spark, f"{folder}/log").count() == 0
    log.append_actions(raw_actions, f"{folder}/log", "b1")
    log.append_actions(raw_actions, f"{folder}/log", "b1")  # the same batch again
    assert log.read_actions(spark, f"{folder}/log").count() == 5
    assert {r.id for r in log.read_rejects(spark, f"{folder}/log").collect()} == {6, 7, 8}
    new = spark.createDataFrame([(None, "r1", "released", None, "desk", datetime(2026, 2, 1))], ACTION_SCHEMA)
    log.record_actions(new, f"{folder}/log")
    first = a.prior_actions(log.read_actions(spark, f"{folder}/log"), "r1").first()
    assert (first.action_type, first.acted_by, first.id) == ("released", "desk", 6)
    before = sorted(log.read_actions(spark, f"{folder}/log").collect(), key=str)
    for number in (1, 2):
        assert log.compact_actions(spark, f"{folder}/log") == number
        assert sorted(log.read_actions(spark, f"{folder}/log").collect(), key=str) == before
        assert {r.id for r in log.read_rejects(spark, f"{folder}/log").collect()} == {6, 7, 8}
    written = log.record_actions(new.withColumn("reservation_id", F.lit("r9")), f"{folder}/log")
    assert [(r.reservation_id, r.id) for r in written.collect()] == [("r9", 7)]
    assert log.read_actions(spark, f"{folder}/log").count() == 7


def test_notes_are_compacted_and_a_batch_can_be_repeated(spark, folder, raw_actions):
    nameless = raw_actions.withColumn("id", F.lit(None).cast("long"))
    path = f"{folder}/log"
    first = sorted(log.record_actions(nameless, path, "b0").collect(), key=str)
    log.record_actions(nameless, path, "b1")
    highest = log.last_id(spark, path)
    for _ in range(2):
        log.compact_actions(spark, path)
        assert log.last_id(spark, path) == highest
        assert spark.read.schema(log.LAST_SCHEMA).parquet(f"{path}_last").count() == 0  # no file per batch is left
    assert log.last_id(spark, path, "b1") < highest
    second = sorted(r.id for r in log.record_actions(nameless, path, "b1").collect())  # run again after compaction
    assert second[0] > max(r.id for r in first) and log.last_id(spark, path) == highest
    log.record_actions(nameless, path, "b2")
    assert log.last_id(spark, path) > highest


def test_actions_with_ids_are_written_without_an_order(spark, folder, raw_actions, monkeypatch):
    monkeypatch.setattr(log, "numbered", None)  # must not be needed
    written = log.record_actions(raw_actions, f"{folder}/log", "b0")
    assert sorted(r.id for r in written.collect()) == [1, 2, 3, 4, 5]
    assert log.last_id(spark, f"{folder}/log") == 5  # refused rows don't count
    assert log.record_actions(raw_actions.limit(0), f"{folder}/log", "b1").count() == 0
    assert log.last_id(spark, f"{folder}/log") == 5


def test_ids_are_consecutive_over_many_tasks(spark):
    df = spark.range(0, 1000, numPartitions=7).select(
        F.when(F.col("id") % 10 == 0, F.col("id") + 5000).alias("id"),
        F.col("id").cast("string").alias("reservation_id"),
    )
    out = log.assign_ids(df, 101).collect()
    given = [r.id for r in out if r.id >= 5000]
    assert len(given) == 100 and sorted(r.id for r in out if r.id < 5000) == list(range(101, 1001))


def test_action_stream(spark, folder, raw_actions):
    raw_actions.write.parquet(f"{folder}/in")
    for _ in range(2):
        stream = spark.readStream.schema(ACTION_SCHEMA).parquet(f"{folder}/in")
        log.action_stream(stream, f"{folder}/log", f"{folder}/cp").awaitTermination()
    assert sorted(r.id for r in log.read_actions(spark, f"{folder}/log").collect()) == [1, 2, 3, 4, 5]


def test_streamed_actions_without_an_id_get_one(spark, folder, raw_actions):
    given = raw_actions.withColumn("id", F.when(F.col("reservation_id") == "r2", F.col("id")))
    given.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(ACTION_SCHEMA).parquet(f"{folder}/in")
    log.action_stream(stream, f"{folder}/log", f"{folder}/cp").awaitTermination()
    once = {r.reservation_id + r.action_type: r.id for r in log.read_actions(spark, f"{folder}/log").collect()}
    assert len(once) == 5 and None not in once.values() and len(set(once.values())) == 5
    log.record_actions(given, f"{folder}/log", "stream-000000000000")  # the batch is run again
    again = {r.reservation_id + r.action_type: r.id for r in log.read_actions(spark, f"{folder}/log").collect()}
    assert again == once


def test_files_are_read_by_the_names_in_their_header(spark, local):
    fields = dict(zip(SOURCE_SCHEMA.names, GOOD.split(","), strict=True))
    names = SOURCE_SCHEMA.names[::-1]
    write(f"{local}/csv", "a.csv", GOOD)
    for name, chosen, extra in (("permuted", names, {}), ("missing", [n for n in names if n not in ("meal", "agent")], {}),
                                ("surplus", names, {"loyalty": "gold"}), ("empty column", names, {"loyalty": ""})):
        row = {**{n: fields[n] for n in chosen}, **extra}
        with open(f"{local}/csv/{name}.csv", "w") as out:
            out.write(",".join(row) + "\n" + ",".join(row.values()) + "\n")
    open(f"{local}/csv/nothing.csv", "w").close()
    rows = {os.path.basename(r._source_file).removesuffix(".csv"): r for r in land(spark, local).collect()}
    assert set(rows) == {"a", "permuted", "missing", "surplus", "empty%20column"}
    for name, row in rows.items():
        assert (row.hotel, row.lead_time, row.adr) == (rows["a"].hotel, rows["a"].lead_time, rows["a"].adr)
        assert (row.meal is None) == (name == "missing")
        assert (json.loads(row._rescued_data)["loyalty"] == "gold") if name == "surplus" else row._rescued_data is None


def test_rule_counts_cover_every_batch(spark, local):
    for i in range(110):
        write(f"{local}/csv", f"{i:03d}.csv", GOOD.replace("100.00", "-1.00") if i % 10 == 0 else GOOD)
    land_csv(spark, f"{local}/csv", f"{local}/bronze", f"{local}/cp/bronze").awaitTermination()
    from pyspark.sql import functions as sf

    from roomledger.operators.quality import BOOKING_RULES, rule_counts
    from roomledger.streaming import medallion

    stream = medallion.bronze_stream(spark, f"{local}/bronze", files_per_batch=1)
    assert stream.isStreaming and spark.read.parquet(f"{local}/bronze").count() == 110
    for number in range(105):  # as many batches as a progress log forgets
        counted = spark.range(1).select(*[sf.lit(1).cast("long").alias(r.name) for r in BOOKING_RULES], sf.lit(2).cast("long").alias("rows"))
        counted.coalesce(1).write.parquet(f"{local}/rules/batch={number}")
    assert rule_totals(spark, f"{local}/rules").first().rows == 210 and rule_counts(BOOKING_RULES)


def test_snapshots_are_kept_named_and_removed(spark, folder):
    assert tables.publish(spark.range(3), folder, "id", made_for="batch 0") == 1
    assert tables.publish(spark.range(4), folder, "id", made_for="batch 0") == 1
    assert tables.read_snapshot(spark, folder).count() == 3
    for _ in range(4):
        last = tables.publish(spark.range(5), folder, None, ["id"], keep=2)
    assert last == 5 and tables.read_snapshot(spark, folder, 4).count() == 5
    assert not tables.exists(spark, f"{folder}/data/snapshot=3")


def test_scratch_is_removed(spark):
    with pytest.raises(ZeroDivisionError), tables.scratch(spark, "x") as path:
        spark.range(3).write.parquet(path)
        assert tables.exists(spark, path)
        1 / 0
    assert not tables.exists(spark, path)


def test_actions_for_a_page(spark, folder):
    page = spark.createDataFrame([("r1",), ("r2",)], "reservation_id string")
    log.record_actions(a.actions_for_page(page, "reconfirmed", None, "desk"), f"{folder}/log")
    rows = log.read_actions(spark, f"{folder}/log").collect()
    assert sorted(r.id for r in rows) == [1, 2] and {r.note for r in rows} == {None}


def test_snapshots(spark, folder):
    assert tables.refresh(spark.range(1), folder, "id") == "SKIPPED_NOT_FOUND"
    with pytest.raises(tables.NoSnapshot):
        tables.read_snapshot(spark, folder)
    assert tables.publish(spark.range(5), folder, "id") == 1
    reader = tables.read_snapshot(spark, folder)
    assert tables.refresh(spark.range(7).withColumn("new", F.lit(1)), folder, "id") == "COMPLETED"
    assert reader.count() == 5 and tables.read_snapshot(spark, folder).count() == 7
    assert "new" in tables.read_snapshot(spark, folder).columns
    with pytest.raises(tables.InvalidKey, match="1 repeated"):
        tables.publish(spark.range(3).union(spark.range(1)), folder, "id")
    with pytest.raises(tables.InvalidKey, match="2 rows without"):
        tables.publish(spark.range(2).select(F.lit(None).cast("bigint").alias("id")), folder, "id")
    assert tables.current_snapshot(spark, folder) == 2
    assert tables.publish(spark.range(1), folder, "id") == 3


def test_clustered_write_spreads_copies_of_one_row(spark, folder):
    same = spark.range(0, 4000, numPartitions=8).select(
        F.lit("City Hotel").alias("hotel"), F.lit("2016-07-01").cast("date").alias("arrival_date")
    )
    out = tables.clustered(same, ["hotel", "arrival_date"], 4)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 2000
    tables.write_clustered(same, f"{folder}/t", ["hotel", "arrival_date"], 4)
    assert spark.read.parquet(f"{folder}/t").columns == ["hotel", "arrival_date"]


def test_replace_changes_the_schema(spark, folder):
    tables.replace_table(spark.range(3), folder)
    tables.replace_table(spark.range(2).withColumn("x", F.lit(1)), folder)
    assert tables.read_table(spark, folder).columns == ["id", "x"]
