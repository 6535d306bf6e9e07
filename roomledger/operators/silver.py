"""Raw bookings to typed, keyed, cleaned reservations.

Projections and filters only: no shuffle, and the same functions serve a batch or a stream.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.functions.keys import business_columns, surrogate_key
from roomledger.functions.parsing import (
    date_from_parts, int_or_zero, month_number, soft_cast,
)
from roomledger.operators.quality import BOOKING_RULES, apply_rules


def typed_bookings(bronze: DataFrame, null_token: str | None = None) -> DataFrame:
    """Every bronze column kept, plus the key, the typed and the derived columns."""
    keyed = bronze.withColumn(
        "reservation_id", surrogate_key(business_columns(bronze.columns), null_token)
    )
    source = dict(bronze.dtypes)

    def typed_as(name, to):
        return soft_cast(name, to, source.get(name))

    typed = keyed.withColumns({
        # identifiers, not measures
        "agent": F.col("agent").cast("string"),
        "company": F.col("company").cast("string"),
        "is_canceled": typed_as("is_canceled", "boolean"),
        "lead_time": typed_as("lead_time", "int"),
        "adr": typed_as("adr", "decimal(10,2)"),
        "arrival_year": typed_as("arrival_date_year", "int"),
        "arrival_day": typed_as("arrival_date_day_of_month", "int"),
        **{
            name: int_or_zero(name, source.get(name))
            for name in (
                "adults", "children", "babies",
                "stays_in_weekend_nights", "stays_in_week_nights",
            )
        },
    })
    dated = typed.withColumns({
        "arrival_date": date_from_parts(
            "arrival_year", month_number("arrival_date_month"), "arrival_day"
        ),
        "stay_nights": F.col("stays_in_weekend_nights") + F.col("stays_in_week_nights"),
    })
    # A product too large for the column stops the job instead of turning into NULL.
    lost = (F.col("adr") * F.col("stay_nights")).cast("decimal(12,2)")
    return dated.withColumn(
        "est_lost_revenue",
        F.when(F.col("is_canceled"), lost).otherwise(F.lit(0).cast("decimal(12,2)")),
    )


def silver_bookings(bronze: DataFrame, null_token: str | None = None) -> DataFrame:
    """Typed bookings without the rows a drop rule rejects."""
    return apply_rules(typed_bookings(bronze, null_token), BOOKING_RULES)
