"""Risk banding."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from roomledger.schemas import HIGH_RISK_FROM, MEDIUM_RISK_FROM


def risk_band(probability) -> Column:
    """Band of a cancellation probability; a missing score counts as low."""
    p = F.col(probability) if isinstance(probability, str) else probability
    return (
        F.when(p >= HIGH_RISK_FROM, "high")
        .when(p >= MEDIUM_RISK_FROM, "medium")
        .otherwise("low")
    )
