from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from roomledger.functions.keys import business_columns, surrogate_key
from roomledger.functions.parsing import date_from_parts, month_number
from roomledger.operators.quality import BOOKING_RULES, apply_rules, observe_rules, rule_metrics
from roomledger.operators.silver import silver_bookings, typed_bookings
from roomledger.schemas import MONTH_NAMES, SOURCE_SCHEMA


def test_typed_columns(bronze_row):
    row = typed_bookings(bronze_row({"is_canceled": 1, "children": "NA", "babies": None})).first()
    assert (row.is_canceled, row.children, row.babies, row.adults) == (True, 0, 0, 2)
    assert row.arrival_date == date(2016, 7, 1)
    assert (row.arrival_year, row.arrival_day, row.stay_nights) == (2016, 1, 3)
    assert row.adr == Decimal("100.00") and row.est_lost_revenue == Decimal("300.00")


def test_every_source_column_passes_through(bronze_row):
    out = silver_bookings(bronze_row({}))
    assert set(SOURCE_SCHEMA.names) <= set(out.columns)
    assert out.schema["adr"].dataType.simpleString() == "decimal(10,2)"
    assert out.schema["est_lost_revenue"].dataType.simpleString() == "decimal(12,2)"
    assert out.schema["agent"].dataType.simpleString() == "string"


def test_lost_revenue_only_when_canceled(bronze_row):
    rows = typed_bookings(
        bronze_row({"is_canceled": 1}, {"is_canceled": 0}, {"is_canceled": None})
    ).select("est_lost_revenue").collect()
    assert [r[0] for r in rows] == [Decimal("300.00"), Decimal("0.00"), Decimal("0.00")]


def test_lost_revenue_too_large_stops_the_job(bronze_row):
    huge = bronze_row({"is_canceled": 1, "adr": "99999999.99", "stays_in_week_nights": 2000})
    with pytest.raises(Exception, match="(?i)numeric|decimal|overflow|range"):
        typed_bookings(huge).select("est_lost_revenue").collect()


@pytest.mark.parametrize("index", range(12))
def test_month_names(spark, index):
    df = spark.createDataFrame([(MONTH_NAMES[index],)], "m string")
    assert df.select(month_number("m")).first()[0] == index + 1


def test_unreadable_dates_are_null(spark):
    rows = [
        (2016, "Foo", 1), (2015, "February", 30), (2015, "February", 29), (2016, "February", 29),
        (2016, "July", 0), (None, "July", 1), (2016, None, 1), (0, "July", 1), (2016, "July", 32),
        (99999, "July", 1), (2016, "December", 31),
    ]
    df = spark.createDataFrame(rows, "y int, m string, d int")
    got = [r[0] for r in df.select(date_from_parts("y", month_number("m"), "d")).collect()]
    assert got == [None, None, None, date(2016, 2, 29)] + [None] * 6 + [date(2016, 12, 31)]


def test_drop_rules(bronze_row):
    df = bronze_row({}, {"hotel": None}, {"adr": "-6.38"}, {"adr": None}, {"adults": "0"})
    assert silver_bookings(df).count() == 2


def test_rule_metrics_count_null_as_failure(bronze_row):
    df = typed_bookings(bronze_row(
        {}, {"hotel": None}, {"adr": "-6.38"}, {"adr": None}, {"adults": "0"},
        {"_rescued_data": "{}"},
    ))
    got = {r.rule: (r.action, r.passed, r.failed) for r in rule_metrics(df, BOOKING_RULES).collect()}
    assert got == {
        "valid_hotel": ("drop", 5, 1),
        "non_negative_adr": ("drop", 4, 2),
        "has_guests": ("warn", 5, 1),
        "clean_parse": ("warn", 5, 1),
    }


def test_observed_rules_equal_the_metrics(bronze_row):
    df = typed_bookings(bronze_row({}, {"hotel": None}, {"adr": None}, {"adults": "0"}))
    seen = Observation("rules")
    apply_rules(observe_rules(df, BOOKING_RULES, seen), BOOKING_RULES).write.format("noop").mode(
        "overwrite"
    ).save()
    want = {r.rule: r.failed for r in rule_metrics(df, BOOKING_RULES).collect()}
    assert {k: v for k, v in seen.get.items() if k != "rows"} == want
    assert seen.get["rows"] == 4


def test_identical_rows_share_a_key(bronze_row):
    keys = [r[0] for r in silver_bookings(bronze_row({}, {}, {"lead_time": 11})).select(
        "reservation_id").collect()]
    assert keys[0] == keys[1] != keys[2] and len(keys[0]) == 64


def test_lineage_columns_are_not_part_of_the_key(bronze_row):
    keys = silver_bookings(
        bronze_row({"_source_file": "a", "_rescued_data": "x"}, {"_source_file": "b"})
    ).select("reservation_id").distinct()
    assert keys.count() == 1
    assert business_columns(["a", "_b", "c"]) == ["a", "c"]


def test_null_positions_collide_unless_marked(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert df.select(surrogate_key(df.columns)).distinct().count() == 1
    assert df.select(surrogate_key(df.columns, null_token="\0")).distinct().count() == 2


def test_key_is_sha256_of_the_joined_text(spark):
    import hashlib

    df = spark.createDataFrame([("a", 1, None)], "x string, y int, z string")
    want = hashlib.sha256(b"a||1").hexdigest()
    assert df.select(surrogate_key(df.columns)).first()[0] == want


def test_silver_needs_no_shuffle(bronze_row):
    plan = silver_bookings(bronze_row({}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_warn_rules_do_not_filter(bronze_row):
    df = typed_bookings(bronze_row({"adults": "0"}, {"_rescued_data": "x"}))
    assert apply_rules(df, BOOKING_RULES).where(F.lit(True)).count() == 2
