"""Scored reservations and the summaries over them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomledger.functions.risk import risk_band


def stamp_scores(
    scored: DataFrame, model_version: int | Column, scored_at: Column | None = None
) -> DataFrame:
    """Scores with their band, model version and scoring time: the reservation_risk table."""
    return with_stamp(scored, model_version, scored_at).select(
        "reservation_id", "hotel", "cancel_probability", "risk_band", "model_version", "scored_at")


def with_stamp(
    scored: DataFrame, model_version: int | Column, scored_at: Column | None = None
) -> DataFrame:
    """All columns of the scored rows, and beside them band, model version and scoring time."""
    version = model_version if isinstance(model_version, Column) else F.lit(model_version)
    return scored.withColumns({
        "risk_band": risk_band("cancel_probability"),
        "model_version": version.cast("int"),
        "scored_at": F.current_timestamp() if scored_at is None else scored_at,
    })


def risk_band_summary(risk: DataFrame) -> DataFrame:
    """Count and spread of the probability per band (A3)."""
    p = F.col("cancel_probability")
    return (
        risk.groupBy("risk_band")
        .agg(
            F.count(F.lit(1)).alias("reservations"),
            F.round(F.avg(p), 4).alias("avg_prob"),
            F.round(F.min(p), 4).alias("min_prob"),
            F.round(F.max(p), 4).alias("max_prob"),
        )
        .orderBy(F.desc("avg_prob"))
    )


def risk_band_distribution(risk: DataFrame) -> DataFrame:
    """Count and mean probability per band."""
    return (
        risk.where(F.col("risk_band").isNotNull())
        .groupBy("risk_band")
        .agg(
            F.count(F.lit(1)).alias("reservations"),
            F.round(F.avg("cancel_probability"), 4).alias("avg_cancel_probability"),
        )
        .orderBy(F.desc("avg_cancel_probability"))
    )


def high_risk_by_hotel(risk: DataFrame) -> DataFrame:
    """High-risk reservations per hotel."""
    return (
        risk.where(F.col("hotel").isNotNull() & F.col("risk_band").ilike("%high%"))
        .groupBy("hotel")
        .agg(F.count(F.lit(1)).alias("high_risk_reservations"))
        .orderBy(F.desc("high_risk_reservations"), "hotel")
    )


def score_model_version(risk: DataFrame) -> DataFrame:
    """The version behind most of the current scores, the newer one on a tie."""
    return (
        risk.where(F.col("model_version").isNotNull())
        .groupBy("model_version")
        .agg(F.count(F.lit(1)).alias("reservations"))
        .orderBy(F.desc("reservations"), F.desc("model_version"))
        .limit(1)
    )


def risk_triage(risk: DataFrame) -> DataFrame:
    """Bands with their share of all scored rows."""
    per_band = risk.groupBy("risk_band").agg(
        F.count(F.lit(1)).alias("reservations"),
        F.round(F.avg("cancel_probability"), 4).alias("avg_cancel_probability"),
    )
    total = per_band.agg(F.sum("reservations")).scalar()
    return per_band.withColumn(
        "share", F.round(F.try_divide(F.col("reservations"), total), 4)
    ).orderBy(F.desc("avg_cancel_probability"))


def hotel_scorecard(gold: DataFrame, risk: DataFrame) -> DataFrame:
    """Past outcome and current risk per hotel (J4). Both sides are one row per hotel when they meet."""
    outcome = gold.groupBy("hotel").agg(
        F.sum("bookings").alias("bookings"),
        F.round(F.try_divide(F.sum("cancellations"), F.sum("bookings")), 4).alias("cancel_rate"),
        F.sum("est_lost_revenue").alias("est_lost_revenue"),
    )
    exposure = risk.groupBy("hotel").agg(
        F.count_if(F.col("risk_band") == "high").alias("high_risk"),
        F.round(F.avg("cancel_probability"), 4).alias("avg_cancel_probability"),
    )
    return outcome.join(exposure, "hotel")


def score_check(risk: DataFrame) -> DataFrame:
    """Rows, rows without a score and rows with a score outside [0, 1] (V3)."""
    p = F.col("cancel_probability")
    return risk.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(p.isNull()).alias("unscored"),
        F.count_if(~p.between(0.0, 1.0)).alias("out_of_range"),
    )
