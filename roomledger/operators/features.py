"""Model inputs and the temporal split."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.schemas import (
    CATEGORICAL_FEATURES, LABEL, MISSING_CATEGORY, NEVER_FEATURES, NUMERIC_FEATURES,
)


def feature_lists(columns) -> tuple[list[str], list[str]]:
    """Categorical and numeric features present in a table; leakage stops the job."""
    present = set(columns)
    categorical = [name for name in CATEGORICAL_FEATURES if name in present]
    numeric = [name for name in NUMERIC_FEATURES if name in present]
    leaked = set(categorical + numeric) & set(NEVER_FEATURES)
    if leaked:
        raise ValueError(f"not allowed as features: {sorted(leaked)}")
    return categorical, numeric


def features(df: DataFrame, keep: list[str], categorical: list[str], numeric: list[str]) -> DataFrame:
    """Filled features after the kept columns: the one select that fit and score share.

    Kept columns that are also features come under their own name with ``_`` in front.
    """
    used = set(categorical) | set(numeric)
    return df.select(
        *[F.col(c).alias(f"_{c}") if c in used else F.col(c) for c in keep],
        *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CATEGORY)).alias(c) for c in categorical],
        *[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in numeric],
    )


def split_cutoff(df: DataFrame, date_col: str = "arrival_date", q: float = 0.8) -> DataFrame:
    """One row: the interpolated quantile of the date, in days since 1970 (M1).

    Exact, yet small on the way: a task keeps a count per distinct date, and dates are few.
    """
    return df.agg(F.percentile(F.unix_date(date_col), q).alias("cutoff"))


def temporal_split(
    df: DataFrame, date_col: str = "arrival_date", q: float = 0.8, cutoff: float | None = None
) -> DataFrame:
    """Rows marked train (before the cutoff) or test (all others, a missing date included) (M1).

    A cutoff already known is used as it is, which spares each later pass finding it again.
    """
    limit = split_cutoff(df, date_col, q).scalar() if cutoff is None else F.lit(cutoff)
    before = F.coalesce(F.unix_date(date_col) < limit, F.lit(False))
    return df.withColumn("split", F.when(before, "train").otherwise("test"))


def split_balance(marked: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows and positive rate of each split."""
    return marked.groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.round(F.avg(F.col(label).cast("int")), 4).alias("cancel_rate"),
    )
