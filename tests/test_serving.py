import json
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from roomledger.functions.display import display_actions, money, percent, to_json_rows
from roomledger.functions.risk import risk_band
from roomledger.operators import risk as r
from roomledger.operators import serving as s
from roomledger.operators.silver import silver_bookings
from roomledger.schemas import SERVING_COLUMNS

SERVING = (
    "reservation_id string, hotel string, risk_band string, market_segment string, lead_time int,"
    " cancel_probability double"
)


@pytest.fixture
def served(spark):
    return spark.createDataFrame([
        ("a", "City Hotel", "high", "Online TA", 30, 0.9),
        ("b", "City Hotel", "high", "Direct", 0, 0.9),
        ("c", "Resort Hotel", "medium", "Online TA", 5, 0.5),
        ("d", "Resort Hotel", "low", "Online TA", 40, 0.1),
        ("e", "City Hotel", "high", "Online TA", 29, 0.8),
    ], SERVING)


def ids(df):
    return [row.reservation_id for row in df.collect()]


@pytest.mark.parametrize("asked, window", [
    ({}, (50, 0)), ({"limit": "10", "offset": "40"}, (10, 40)), ({"limit": 0, "offset": -5}, (1, 0)),
    ({"limit": 9999}, (200, 0)), ({"limit": "junk", "offset": "junk"}, (50, 0)), ({"limit": " 7 ", "offset": "1.5"}, (7, 0)),
])
def test_page_window(asked, window):
    assert s.page_window(**asked) == window


def test_deep_pages_equal_shallow_ones(served, monkeypatch):
    city = s.reservation_filter(hotel="City Hotel")
    shallow = [(c, o, ids(s.list_page(served, c, limit=2, offset=o))) for c in (None, city) for o in (1, 2, 4, 9)]
    monkeypatch.setattr(s, "DEEP_PAGE", 0)
    assert [(c, o, ids(s.list_page(served, c, limit=2, offset=o))) for c, o, _ in shallow] == shallow


def test_band_edges(spark):
    df = spark.createDataFrame([(0.7,), (0.6999,), (0.4,), (0.3999,), (None,)], "p double")
    got = [row[0] for row in df.select(risk_band("p")).collect()]
    assert got == ["high", "medium", "medium", "low", "low"]


def test_filters(served):
    assert ids(s.list_page(served, s.reservation_filter())) == ["a", "b", "e", "c", "d"]
    everything = s.reservation_filter(
        hotel="City Hotel", risk_band="high", market_segment="Online TA", min_lead_time=30
    )
    assert ids(s.list_page(served, everything)) == ["a"]
    assert ids(s.list_page(served, s.reservation_filter(hotel="", risk_band=""))) == ["a", "b", "e", "c", "d"]
    assert s.count_page(served, s.reservation_filter(min_lead_time=0)).first().total == 5
    assert s.count_page(served, s.reservation_filter(min_lead_time=30)).first().total == 2


def test_unknown_band_is_an_error():
    with pytest.raises(ValueError, match="extreme"):
        s.reservation_filter(risk_band="extreme")


def test_pages_cover_everything_once(served):
    pages = [ids(s.list_page(served, limit=2, offset=o)) for o in (0, 2, 4)]
    assert pages == [["a", "b"], ["e", "c"], ["d"]]


def test_keyset_pages_equal_offset_pages(served):
    page, seen = s.list_page(served, limit=2).collect(), []
    while page:
        seen += [row.reservation_id for row in page]
        last = page[-1]
        page = s.next_page(served, last.cancel_probability, last.reservation_id, limit=2).collect()
    assert seen == ["a", "b", "e", "c", "d"]


def test_page_is_a_top_k(served):
    plan = s.list_page(served)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_lookup(served):
    assert ids(s.lookup(served, "c")) == ["c"] and ids(s.lookup(served, "zz")) == []


def test_kpis(served):
    row = s.kpis(served).first()
    assert (row.total, row.high_risk, row.medium_risk, row.low_risk) == (5, 3, 1, 1)
    assert row.avg_cancel_probability == pytest.approx(0.64)
    assert {x.risk_band: x["count"] for x in s.band_mix(served).collect()} == {
        "high": 3, "medium": 1, "low": 1
    }


def test_kpis_of_nothing(served):
    row = s.kpis(served.where("false")).first()
    assert row.total == 0 and row.avg_cancel_probability is None


def test_serving_is_one_row_per_key(spark, bronze_row):
    silver = silver_bookings(bronze_row({}, {}, {}, {"lead_time": 11}))
    risk = r.stamp_scores(silver.withColumn("cancel_probability", F.lit(0.75)), 3)
    out = s.build_serving(risk, silver)
    assert out.columns == SERVING_COLUMNS and out.count() == 2
    row = out.where("lead_time = 11").first()
    assert (row.risk_band, row.model_version, row.arrival_date) == ("high", 3, date(2016, 7, 1))


def test_serving_keeps_scores_without_a_booking(spark, bronze_row):
    silver = silver_bookings(bronze_row({}))
    risk = r.stamp_scores(
        spark.createDataFrame([("gone", "City Hotel", 0.2)], "reservation_id string, hotel string, cancel_probability double"), 1
    )
    row = s.build_serving(risk, silver).first()
    assert row.reservation_id == "gone" and row.arrival_date is None


def test_serving_join_adds_no_shuffle(spark, bronze_row):
    silver = silver_bookings(bronze_row({}))
    risk = r.stamp_scores(silver.withColumn("cancel_probability", F.lit(0.75)), 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = s.build_serving(risk, silver)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # one exchange per deduplicated side, none for the join
    assert plan.count("Exchange hashpartitioning") == 2 and "partial_max" in plan


def test_survivor_does_not_depend_on_row_order(spark):
    rows = [("k", 1, "x"), ("k", 2, "a"), ("k", 2, "b"), ("k", None, "z")]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "id string, v int, w string").repartition(3)
        assert s.one_per_key(df, "id", ["v", "w"]).collect() == [("k", 2, "b")]


def test_risk_summaries(served):
    risk = served.withColumn("model_version", F.when(F.col("hotel") == "City Hotel", 2).otherwise(1))
    assert [x.risk_band for x in r.risk_band_summary(risk).collect()] == ["high", "medium", "low"]
    assert [tuple(x) for x in r.high_risk_by_hotel(risk).collect()] == [("City Hotel", 3)]
    assert tuple(r.score_model_version(risk).first()) == (2, 3)
    assert {x.risk_band: x.share for x in r.risk_triage(risk).collect()} == {
        "high": 0.6, "medium": 0.2, "low": 0.2
    }
    assert tuple(r.score_check(risk).first()) == (5, 0, 0)


def test_json_rows(spark):
    df = spark.createDataFrame(
        [("abc", date(2016, 7, 1), datetime(2026, 9, 29, 20, 55, 42), datetime(2026, 9, 29, 20, 55, 42, 544708), Decimal("123.45"), 30, None)],
        "reservation_id string, arrival_date date, scored_at timestamp, acted_at timestamp, adr decimal(10,2), lead_time int, note string",
    )
    out = json.loads(to_json_rows(df).first().json)
    assert out == {
        "reservation_id": "abc", "arrival_date": "2016-07-01", "scored_at": "2026-09-29T20:55:42+00:00",
        "acted_at": "2026-09-29T20:55:42.544708+00:00", "adr": 123.45, "lead_time": 30, "note": None,
    }


def test_an_instant_means_the_same_in_every_zone(spark):
    df = spark.sql("SELECT TIMESTAMP '2026-01-01 00:00:00+00:00' AS at, TIMESTAMP_NTZ '2026-01-01 00:00:00' AS clock")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        out = json.loads(to_json_rows(df).first().json)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert out == {"at": "2025-12-31T19:00:00-05:00", "clock": "2026-01-01T00:00:00"}


def test_display(spark):
    df = spark.createDataFrame([(0.2793, 1234.5), (None, None), (1.0, -5.0)], "p double, m double")
    got = [tuple(x) for x in df.select(percent("p"), money("m")).collect()]
    assert got == [("27.9%", "$1,235"), ("—", "—"), ("100.0%", "-$5")]
    actions = spark.createDataFrame(
        [("0123456789abcdef", "deposit_requested", None, "x", datetime(2026, 1, 1))],
        "reservation_id string, action_type string, note string, acted_by string, acted_at timestamp",
    )
    assert tuple(display_actions(actions).first())[:2] == ("0123456789ab", "deposit requested")


def test_keys_are_shuffled_packed(spark):
    from roomledger.functions.keys import packed_key

    hashes = ["ab" * 32, "AB" * 32, "abc", "0abc", "", "gone", "é", None]
    risk = spark.createDataFrame([(k, "h", 0.5, "medium", 1, None) for k in hashes],
                                 "reservation_id string, hotel string, cancel_probability double, risk_band string, model_version int, scored_at timestamp")
    types = "reservation_id string, arrival_date date, lead_time int, adr decimal(10,2), market_segment string, adults int, children int, babies int, deposit_type string, customer_type string"
    silver = spark.createDataFrame([(k, None, i, *[None] * 7) for i, k in enumerate(hashes)], types)
    out = s.build_serving(risk, silver)
    assert {(x.reservation_id, x.lead_time) for x in out.collect()} == {
        (k, i if k is not None else None) for i, k in enumerate(hashes)}
    one = s.one_per_key(silver, "reservation_id", ["lead_time"])
    assert {tuple(x) for x in one.collect()} == set(zip(hashes, range(len(hashes))))
    packed = silver.select(F.length(packed_key(silver, "reservation_id"))).first()[0]
    assert packed == 33
    numbers = spark.createDataFrame([(1, 2), (1, 3), (None, 1)], "k int, v int")
    assert {tuple(x) for x in s.one_per_key(numbers, "k", ["v"]).collect()} == {(1, 3), (None, 1)}


def test_scores_and_details_of_the_same_rows(spark, bronze_row):  # F5, F6
    """One frame with both gives what two give, and its keys are shuffled once."""
    from roomledger.sources.star import formula_risk, formula_scored

    silver = silver_bookings(bronze_row({}, {}, {"lead_time": 99}, {"lead_time": 99, "agent": "7"}, {"adr": None, "adults": "x"}))
    extra = silver.limit(1).withColumn("lead_time", F.lit(5)).unionByName(silver.limit(1).withColumn("reservation_id", F.lit(None).cast("string")))
    silver = silver.unionByName(extra).localCheckpoint()
    two, one = s.build_serving(formula_risk(silver), silver), s.build_serving(formula_scored(silver))
    assert one.schema == two.schema
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    plan = one._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_details_shuffle_reservations_once_and_packed(spark, folder):  # F6
    from roomledger.operators.actions import reservation_detail

    key = "00ff" * 16
    spark.createDataFrame([(key, 1), ("x", 2), (None, 3)], "reservation_id string, v int").write.parquet(f"{folder}/s")
    serving = spark.read.parquet(f"{folder}/s")
    acts = [(1, key, "note", "n", "me", datetime(2024, 1, 1)), (2, key, "note", "n", "me", datetime(2024, 1, 2)), (3, None, "note", "n", "me", datetime(2024, 1, 3))]
    actions = spark.createDataFrame(acts, "id long, reservation_id string, action_type string, note string, acted_by string, acted_at timestamp")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = reservation_detail(serving, actions)
        got = sorted(((r.reservation_id, r.v, r.action_id) for r in out.collect()), key=str)
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted([(key, 1, 1), (key, 1, 2), ("x", 2, None), (None, 3, None)], key=str)
    assert plan.count("ReusedExchange") >= 1 and "unhex" in plan


def test_a_unique_key_is_checked_by_its_hash(spark, monkeypatch):  # F7
    from roomledger.sources import tables

    df = spark.range(50).select(F.col("id").cast("string").alias("k"))
    with pytest.raises(tables.InvalidKey):
        tables.require_unique_key(df.union(df.limit(1)), "k")
    with pytest.raises(tables.InvalidKey):
        tables.require_unique_key(df.union(spark.createDataFrame([(None,)], "k string")), "k")
    monkeypatch.setattr(tables, "packed_key", None)  # the keys themselves are not counted
    assert tables.require_unique_key(df, "k") == 50 and tables.require_unique_key(df.limit(0), "k") == 0


def test_a_snapshot_is_clustered_with_packed_keys(spark, folder, monkeypatch):  # F7
    from roomledger.sources import tables

    laid, clustered = [], tables.clustered
    monkeypatch.setattr(tables, "clustered", lambda df, *more: laid.append(dict(df.dtypes)) or clustered(df, *more))
    rows = [("ab" * 32, 1), ("AB", 2), ("", 3)]
    tables.publish(spark.createDataFrame(rows, "k string, v int"), folder, "k", ["v"])
    assert laid[0]["k"] == "binary"
    assert sorted(map(tuple, tables.read_snapshot(spark, folder).collect())) == sorted(rows)
