"""Report formatting and JSON-safe values."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ABSENT = "—"


def _named(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def percent(col) -> Column:
    """Share as a percentage with one decimal, halves up."""
    scaled = F.round(_named(col).cast("decimal(18,8)") * 100, 1)
    return F.coalesce(F.concat(scaled.cast("decimal(18,1)").cast("string"), F.lit("%")), F.lit(ABSENT))


def money(col) -> Column:
    """Whole dollars with thousands separators, halves away from zero."""
    whole = F.round(_named(col).cast("decimal(24,4)"), 0).cast("decimal(24,0)")
    text = F.concat(
        F.when(whole < 0, "-$").otherwise("$"), F.format_number(F.abs(whole), 0)
    )
    return F.coalesce(text, F.lit(ABSENT))


def short_id(col) -> Column:
    return F.substring(_named(col), 1, 12)


def action_label(col) -> Column:
    return F.replace(_named(col), F.lit("_"), F.lit(" "))


def party(adults, children, babies) -> Column:
    return F.concat_ws("/", *[_named(c).cast("string") for c in (adults, children, babies)])


def iso_timestamp(col, offset: bool = False) -> Column:
    """ISO text; the fraction appears only when there is one, the session zone's offset when asked for."""
    ts = _named(col)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, ".SSSSSS")
    text = F.concat(whole, F.when(fraction == ".000000", "").otherwise(fraction))
    return F.concat(text, F.date_format(ts, "xxx")) if offset else text


def json_value(field: T.StructField) -> Column:
    """One column as JSON can carry it: dates and times as ISO text, decimals as doubles.

    A TIMESTAMP is an instant, so its text has the offset and means the same in every session zone. A
    TIMESTAMP_NTZ is what a clock showed and has none.
    """
    col = F.col(field.name)
    kind = field.dataType
    if isinstance(kind, T.DateType):
        col = F.date_format(col, "yyyy-MM-dd")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        col = iso_timestamp(col, offset=isinstance(kind, T.TimestampType))
    elif isinstance(kind, T.DecimalType):
        col = col.cast("double")
    return col.alias(field.name)


def to_json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object per row, NULLs kept."""
    values = [json_value(field) for field in df.schema.fields]
    return df.select(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias(name))


def display_reservations(serving: DataFrame) -> DataFrame:
    """Serving rows shaped for reading."""
    return serving.select(
        short_id("reservation_id").alias("reservation"),
        "hotel",
        F.date_format("arrival_date", "yyyy-MM-dd").alias("arrival"),
        percent("cancel_probability").alias("cancel_probability"),
        "risk_band",
        "lead_time",
        money("adr").alias("adr"),
        "market_segment",
        party("adults", "children", "babies").alias("party"),
    )


def display_actions(actions: DataFrame) -> DataFrame:
    """Action rows shaped for reading."""
    return actions.select(
        short_id("reservation_id").alias("reservation"),
        action_label("action_type").alias("action"),
        "note",
        "acted_by",
        iso_timestamp("acted_at").alias("acted_at"),
    )
