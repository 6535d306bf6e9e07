"""Mergeable sketches per file: distinct keys, overlap of layers, quantiles.

A file's sketches are made once, when it is new; questions merge the stored sketches and read no data. Distinct counts
are HyperLogLog (standard error 0.8 %), overlaps theta sketches (0.8 % of the union), quantiles KLL (rank error
some 0.4 %). Where a result has to be exact, ``profile.key_uniqueness`` and ``features.split_cutoff`` stay the way.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger.functions.parsing import as_number
from roomledger.sources.tables import exists

LOG_ENTRIES = 14  # of the distinct-count and theta sketches: at most some 128 KB a file and key
QUANTILE_K = 800

STORED = T.StructType([
    T.StructField("layer", T.StringType()), T.StructField("part", T.StringType()), T.StructField("column", T.StringType()),
    T.StructField("row_count", T.LongType()), T.StructField("null_count", T.LongType()), T.StructField("distinct", T.BinaryType()),
    T.StructField("members", T.BinaryType()), T.StructField("spread", T.BinaryType()), T.StructField("run", T.IntegerType()),
])


def sketches(df: DataFrame, part: Column, keys: list[str], numbers: list[str]) -> DataFrame:
    """part, column, row_count, null_count and the column's sketches, one row per part and column.

    Keys, known by a text of their value, get the distinct and the member sketch, numbers and dates the spread. One
    pass over the columns named; sketches are combined on the map side, so a large part is no large task.
    """
    whole = df.groupBy(part.alias("part"))
    aggregates = [F.count(F.lit(1)).alias("row_count")]
    for i, c in enumerate(keys):
        text = F.col(c).cast("string")
        aggregates += [F.count(c).alias(f"k{i}"), F.hll_sketch_agg(text, LOG_ENTRIES).alias(f"d{i}"), F.theta_sketch_agg(text, LOG_ENTRIES).alias(f"m{i}")]
    for i, c in enumerate(numbers):
        aggregates += [F.count(c).alias(f"n{i}"), F.kll_sketch_agg_double(as_number(F.col(c), df.schema[c].dataType), QUANTILE_K).alias(f"s{i}")]
    none = F.lit(None).cast("binary")

    def entry(name: str, held: str, distinct: Column, members: Column, spread: Column) -> Column:
        return F.struct(F.lit(name).alias("column"), "row_count", (F.col("row_count") - F.col(held)).alias("null_count"),
                        distinct.alias("distinct"), members.alias("members"), spread.alias("spread"))

    entries = [entry(c, f"k{i}", F.col(f"d{i}"), F.col(f"m{i}"), none) for i, c in enumerate(keys)]
    entries += [entry(c, f"n{i}", none, none, F.col(f"s{i}")) for i, c in enumerate(numbers)]
    return whole.agg(*aggregates).select("part", F.explode(F.array(*entries)).alias("e")).select("part", "e.*")


class SketchStore:
    """Sketches of the files of named layers, under one folder. For one writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _stored(self) -> DataFrame:
        if not exists(self.spark, self.root):
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(self.root)

    def add(self, df: DataFrame, layer: str, keys: list[str] = (), numbers: list[str] = ()) -> int:
        """Sketch those files of ``df``, a frame read from Parquet, that the layer has no sketches of; returns their number.

        The columns of a layer are those of its first call. What a failed run left is written over by the next.
        A layer whose files were replaced is another layer: name its snapshot in it.
        """
        stored = self._stored()
        known = {r.part for r in stored.where(F.col("layer") == layer).select("part").distinct().collect()}
        new = [name for name in df.inputFiles() if name not in known]
        if new:
            run = (stored.agg(F.max("run")).first()[0] or 0) + 1
            rows = self.spark.read.schema(df.schema).parquet(*new)
            made = sketches(rows, F.input_file_name(), list(keys), list(numbers))
            made.select(F.lit(layer).alias("layer"), *made.columns).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/run={run}")
        return len(new)

    def _of(self, layer: str, column: str) -> DataFrame:
        return self._stored().where((F.col("layer") == layer) & (F.col("column") == column))

    def distinct(self, layer: str, column: str) -> DataFrame:
        """row_count, null_count and distinct_estimate of the layer's column, in one row; zeros for an unknown layer."""
        merged = F.hll_sketch_estimate(F.hll_union_agg("distinct"))
        return self._of(layer, column).agg(
            F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"), F.coalesce(F.sum("null_count"), F.lit(0)).alias("null_count"),
            F.coalesce(merged, F.lit(0)).alias("distinct_estimate"))

    def overlap(self, left: str, right: str, column: str) -> DataFrame:
        """Estimated numbers of keys in both layers (both), only in the left and only in the right one, in one row."""
        stored = self._stored().where(F.col("layer").isin(left, right) & (F.col("column") == column))
        pair = stored.agg(*[
            F.theta_union_agg(F.when(F.col("layer") == layer, F.col("members")), LOG_ENTRIES).alias(name)
            for layer, name in ((left, "a"), (right, "b"))])
        return pair.select(*[
            F.coalesce(F.theta_sketch_estimate(f(x, y)), F.lit(0)).alias(name)
            for f, x, y, name in ((F.theta_intersection, "a", "b", "both"), (F.theta_difference, "a", "b", "left_only"), (F.theta_difference, "b", "a", "right_only"))])

    def quantiles(self, layer: str, column: str, shares: list[float]) -> DataFrame:
        """share, value: the layer's quantiles; dates as days and instants as seconds since 1970-01-01, null where there are no values."""
        merged = self._of(layer, column).agg(F.kll_merge_agg_double("spread").alias("s"), (F.sum("row_count") - F.sum("null_count")).alias("held"))
        values = F.array(*[
            F.struct(F.lit(share).alias("share"), F.when(F.col("held") > 0, F.kll_sketch_get_quantile_double("s", F.lit(share))).alias("value"))
            for share in shares])
        return merged.select(F.explode(values).alias("e")).select("e.*")
