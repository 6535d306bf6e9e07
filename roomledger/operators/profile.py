"""Row counts, key uniqueness and duplicates across layers."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def layer_counts(**layers: DataFrame) -> DataFrame:
    """One row per named table: layer, row_count."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("layer"), "row_count")
        for name, df in layers.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def compare_counts(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """Bronze and silver row counts side by side."""
    bronze_rows = bronze.agg(F.count(F.lit(1))).scalar()
    return silver.agg(F.count(F.lit(1)).alias("silver_rows")).select(
        bronze_rows.alias("bronze_rows"),
        "silver_rows",
        (bronze_rows - F.col("silver_rows")).alias("dropped_rows"),
    )


def rescued_rows(bronze: DataFrame) -> DataFrame:
    """Rows with rescued data."""
    return bronze.agg(F.count_if(F.col("_rescued_data").isNotNull()).alias("rescued_rows"))


def key_uniqueness(df: DataFrame, key: str) -> DataFrame:
    """Rows against distinct keys."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct(key).alias("distinct_keys")
    ).withColumn("is_unique", F.col("row_count") == F.col("distinct_keys"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Each key that occurs more than once, with its number of copies."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def duplicate_profile(df: DataFrame, key: str) -> DataFrame:
    """How many keys have how many copies, and the surplus rows that makes."""
    return (
        duplicate_keys(df, key)
        .groupBy("copies")
        .agg(F.count(F.lit(1)).alias("key_count"))
        .withColumn("surplus_rows", (F.col("copies") - 1) * F.col("key_count"))
    )
