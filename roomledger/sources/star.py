"""Bookings, scores and actions derived from the star-schema tables.

The operators run on any bookings table; this adapter makes one from ``lineitem``, ``orders``,
``customer``, ``nation`` and ``events`` so that they can be checked and timed on those tables.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.operators.risk import stamp_scores, with_stamp
from roomledger.schemas import SOURCE_SCHEMA

SCORED_AT = "2026-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(number: str, *names: str) -> Column:
    """Name chosen by the remainder of an integer column."""
    return F.element_at(
        F.array(*[F.lit(n) for n in names]),
        (F.col(number) % len(names)).cast("int") + 1,
    )


def _remainder(number: str, by: int) -> Column:
    return (F.col(number) % by).cast("int")


def _room(number: Column) -> Column:
    return F.char(F.lit(65) + number % 8)


def _text_count(col: Column) -> Column:
    """Guest count as the source file has it: text, NA when unknown."""
    return F.coalesce(col.cast("string"), F.lit("NA"))


# Dividing doubles and rounding to cents depends on the engine, so cents are integers throughout.
_ADR = (
    "cast(cast(cast(cast(l_extendedprice as decimal(12,2)) * 100 as bigint)"
    " div cast(l_quantity as bigint) - 10000 as decimal(18,0)) / 100 as decimal(10,2))"
)


LINE_COLUMNS = [
    "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "in_city", "marks", "adr", "rescued", "arrives_on",
    "booked_on", "o_orderstatus", "o_orderpriority", "o_custkey", "c_mktsegment", "n_name",
]
BY_ARRIVAL = ["in_city", "arrives_on"]  # what hotel and arrival_date of a booking come from
# What a booking asks of its line by yes or no: one number to shuffle instead of four columns.
MARKS = {"canceled": "l_returnflag = 'R'", "no_deposit": "l_tax < 0.03D", "refundable": "l_tax < 0.06D", "by_company": "l_tax > 0.05D"}


def _marks() -> Column:
    """A bit for each mark that is true; what is unknown is not."""
    return sum((F.when(F.expr(test), 1 << bit).otherwise(0) for bit, test in enumerate(MARKS.values())), F.lit(0))


def _marked(name: str) -> Column:
    return F.getbit("marks", F.lit(list(MARKS).index(name))) == 1


def booked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with what bookings take from their order, customer and nation: a fifth as wide as a booking.

    Orders get their customer and nation before they meet the lines, which are four times as many. Orders
    grow with the lines, so the two are always joined by a shuffle, never by a broadcast that happens to
    fit at small scale.
    """
    orders = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("booked_on", F.col("o_orderdate").cast("date"))
    )
    lines = table(spark, sf_dir, "lineitem").withColumns({
        "arrives_on": F.col("l_shipdate").cast("date"),
        "adr": F.expr(_ADR),
        "in_city": F.coalesce(F.col("l_linestatus") == "O", F.lit(False)),
        "marks": _marks(),
        "rescued": F.when(F.col("l_discount") > 0.095, F.col("l_discount").cast("string")),
    })
    return lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select(*LINE_COLUMNS)


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bookings in the landing schema, with lineage columns and the customer they belong to."""
    return as_bookings(booked_lines(spark, sf_dir), sf_dir)


def as_bookings(lines: DataFrame, sf_dir: str) -> DataFrame:
    """Booked lines as raw bookings, in the order of the lines. One booked in February appears twice, an exact duplicate."""
    status = F.when(_marked("canceled"), "Canceled").otherwise("Check-Out")
    derived = {
        "hotel": F.when(F.col("in_city"), "City Hotel").otherwise("Resort Hotel"),
        "is_canceled": F.when(_marked("canceled"), 1).otherwise(0),
        "lead_time": F.abs(F.datediff("arrives_on", "booked_on")) % 400,
        "arrival_date_year": F.year("arrives_on"),
        "arrival_date_month": F.date_format("arrives_on", "MMMM"),
        "arrival_date_week_number": F.weekofyear("arrives_on"),
        "arrival_date_day_of_month": F.day("arrives_on"),
        "stays_in_weekend_nights": _remainder("l_linenumber", 3),
        "stays_in_week_nights": F.col("l_quantity").cast("int") % 8,
        "adults": _text_count(F.nullif(_remainder("l_linenumber", 4), F.lit(3))),
        "children": _text_count(F.nullif(_remainder("l_partkey", 3), F.lit(2))),
        "babies": _text_count(_remainder("l_partkey", 2)),
        "meal": _pick("l_partkey", "BB", "HB", "FB", "SC"),
        "country": F.col("n_name"),
        "market_segment": F.col("c_mktsegment"),
        "distribution_channel": F.col("o_orderpriority"),
        "is_repeated_guest": F.when(F.col("l_suppkey") % 20 == 0, 1).otherwise(0),
        "previous_cancellations": _remainder("l_suppkey", 3),
        "previous_bookings_not_canceled": _remainder("l_partkey", 4),
        "reserved_room_type": _room(F.col("l_partkey")),
        "assigned_room_type": _room(F.col("l_partkey") + F.col("l_linenumber")),
        "booking_changes": _remainder("l_linenumber", 5),
        "deposit_type": F.when(_marked("no_deposit"), "No Deposit")
        .when(_marked("refundable"), "Refundable")
        .otherwise("Non Refund"),
        "agent": F.col("l_suppkey").cast("string"),
        "company": F.when(_marked("by_company"), F.col("l_partkey").cast("string")),
        "days_in_waiting_list": _remainder("l_suppkey", 7),
        "customer_type": F.col("o_orderstatus"),
        "adr": F.col("adr"),
        "required_car_parking_spaces": _remainder("l_partkey", 2),
        "total_of_special_requests": _remainder("l_suppkey", 5),
        "reservation_status": status,
        "reservation_status_date": F.when(_marked("canceled"), F.col("booked_on"))
        .otherwise(F.col("arrives_on")),
    }
    copies = F.when(F.month("booked_on") == 2, 2).otherwise(1)
    return lines.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).select(
        *[derived[f.name].cast(f.dataType).alias(f.name) for f in SOURCE_SCHEMA.fields],
        F.col("rescued").alias("_rescued_data"),
        F.current_timestamp().alias("_ingested_at"),
        F.lit(f"{sf_dir}/lineitem.parquet").alias("_source_file"),
        F.col("o_custkey").alias("_customer"),
    )


def formula_score() -> Column:
    """Stand-in probability from typed booking columns, so that SQL can reproduce it. Not the model."""
    points = (
        F.col("stay_nights") * 7
        + F.month("arrival_date") * 3
        + F.floor("adr").cast("int") % 50
    )
    return F.round(points.cast("double") / 150.0, 4)


def formula_risk(silver: DataFrame) -> DataFrame:
    """reservation_risk with the stand-in score and a version that varies by row."""
    return stamp_scores(*_formula_scored(silver))


def formula_scored(silver: DataFrame) -> DataFrame:
    """Silver with the columns of its ``formula_risk`` beside its own."""
    return with_stamp(*_formula_scored(silver))


def _formula_scored(silver: DataFrame) -> tuple[DataFrame, Column, Column]:
    scored = silver.withColumn("cancel_probability", formula_score())
    return scored, 1 + F.col("lead_time") % 3, F.lit(SCORED_AT).cast("timestamp")


def _action_type() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "click", "reconfirmed")
        .when(kind == "purchase", "deposit_requested")
        .when(kind == "signup", "overbooked_backup")
        .when(kind == "error", "released")
        .when((kind == "view") & (F.col("value") < 50), "note")
        .otherwise(kind)
    )


def actions_from_events(events: DataFrame) -> DataFrame:
    """Actions keyed by user. Some views stay unmapped, to be rejected."""
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("reservation_id"),
        _action_type().alias("action_type"),
        F.col("props").alias("note"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("acted_by"),
        F.col("ts").cast("timestamp").alias("acted_at"),
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions_from_events(table(spark, sf_dir, "events"))


def booking_actions(spark: SparkSession, sf_dir: str, silver: DataFrame) -> DataFrame:
    """Actions on bookings: each user acts on the first booking key of the customer of that number.

    Users without a booking get a NULL reservation, to be rejected.
    """
    first_key = silver.groupBy("_customer").agg(F.min("reservation_id").alias("first_key"))
    keyed = actions(spark, sf_dir).withColumn("_customer", F.col("reservation_id").cast("bigint"))
    return keyed.join(first_key, "_customer", "left").select(
        "id", F.col("first_key").alias("reservation_id"), "action_type", "note", "acted_by",
        "acted_at",
    )
