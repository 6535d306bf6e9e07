"""Names, types and constants shared by every layer."""

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must not change, results depend on them.
# ---------------------------------------------------------------------------

MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

CITY_HOTEL = "City Hotel"
RESORT_HOTEL = "Resort Hotel"

KEY_SEPARATOR = "||"

HIGH_RISK_FROM = 0.7
MEDIUM_RISK_FROM = 0.4
RISK_BANDS = ("high", "medium", "low")

ACTION_TYPES = ("reconfirmed", "deposit_requested", "overbooked_backup", "released", "note")

DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 200

CATEGORICAL_FEATURES = [
    "hotel", "meal", "market_segment", "distribution_channel",
    "reserved_room_type", "deposit_type", "customer_type",
]

NUMERIC_FEATURES = [
    "lead_time", "arrival_year", "arrival_date_week_number", "stays_in_weekend_nights",
    "stays_in_week_nights", "adults", "children", "babies", "is_repeated_guest",
    "previous_cancellations", "previous_bookings_not_canceled", "booking_changes",
    "days_in_waiting_list", "adr", "required_car_parking_spaces",
    "total_of_special_requests", "stay_nights",
]

# Known only after the outcome, derived from it, identifying, or too fine to generalise.
NEVER_FEATURES = [
    "reservation_status", "reservation_status_date", "est_lost_revenue", "is_canceled",
    "assigned_room_type", "reservation_id", "agent", "company", "country",
]

LABEL = "is_canceled"
MISSING_CATEGORY = "missing"

SERVING_COLUMNS = [
    "reservation_id", "hotel", "arrival_date", "lead_time", "adr", "market_segment",
    "adults", "children", "babies", "deposit_type", "customer_type",
    "cancel_probability", "risk_band", "model_version", "scored_at",
]

MASKED_COLUMNS = ["country", "agent", "company"]
MASK = "***"
ENGINEER = "hotel_engineer"
ANALYST = "hotel_analyst"
CITY_MANAGER = "hotel_mgr_city"
RESORT_MANAGER = "hotel_mgr_resort"

# ---------------------------------------------------------------------------
# Frozen landing schema: the 32 source columns in file order.
# ---------------------------------------------------------------------------

SOURCE_SCHEMA = T.StructType([
    T.StructField("hotel", T.StringType()),
    T.StructField("is_canceled", T.IntegerType()),
    T.StructField("lead_time", T.IntegerType()),
    T.StructField("arrival_date_year", T.IntegerType()),
    T.StructField("arrival_date_month", T.StringType()),
    T.StructField("arrival_date_week_number", T.IntegerType()),
    T.StructField("arrival_date_day_of_month", T.IntegerType()),
    T.StructField("stays_in_weekend_nights", T.IntegerType()),
    T.StructField("stays_in_week_nights", T.IntegerType()),
    T.StructField("adults", T.StringType()),
    T.StructField("children", T.StringType()),
    T.StructField("babies", T.StringType()),
    T.StructField("meal", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("market_segment", T.StringType()),
    T.StructField("distribution_channel", T.StringType()),
    T.StructField("is_repeated_guest", T.IntegerType()),
    T.StructField("previous_cancellations", T.IntegerType()),
    T.StructField("previous_bookings_not_canceled", T.IntegerType()),
    T.StructField("reserved_room_type", T.StringType()),
    T.StructField("assigned_room_type", T.StringType()),
    T.StructField("booking_changes", T.IntegerType()),
    T.StructField("deposit_type", T.StringType()),
    T.StructField("agent", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("days_in_waiting_list", T.IntegerType()),
    T.StructField("customer_type", T.StringType()),
    T.StructField("adr", T.DecimalType(10, 2)),
    T.StructField("required_car_parking_spaces", T.IntegerType()),
    T.StructField("total_of_special_requests", T.IntegerType()),
    T.StructField("reservation_status", T.StringType()),
    T.StructField("reservation_status_date", T.DateType()),
])

LINEAGE_FIELDS = [
    T.StructField("_rescued_data", T.StringType()),
    T.StructField("_ingested_at", T.TimestampType()),
    T.StructField("_source_file", T.StringType()),
]

BRONZE_SCHEMA = T.StructType(SOURCE_SCHEMA.fields + LINEAGE_FIELDS)

ACTION_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("reservation_id", T.StringType()),
    T.StructField("action_type", T.StringType()),
    T.StructField("note", T.StringType()),
    T.StructField("acted_by", T.StringType()),
    T.StructField("acted_at", T.TimestampType()),
])
