"""Files to bronze to silver as streams.

Each runner processes what is there and stops, and goes on from its checkpoint next time. No state
is kept between rows, so nothing grows with the length of the stream.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from roomledger.operators.quality import BOOKING_RULES, apply_rules, rule_counts
from roomledger.operators.silver import typed_bookings
from roomledger.schemas import BRONZE_SCHEMA, SOURCE_SCHEMA
from roomledger.sources.landing import FILES_PER_BATCH, csv_batch, file_stream
from roomledger.sources.tables import stored

LANDED = "landed"  # bronze's folders, one per batch


def append_parquet(stream: DataFrame, out_dir: str, checkpoint: str, name: str) -> StreamingQuery:
    """Append a stream to a folder, each input exactly once, until the input is used up."""
    return (
        stream.writeStream.queryName(name)
        .format("parquet")
        .option("compression", "zstd")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out_dir)
    )


def land_csv(
    spark: SparkSession, src_dir: str, out_dir: str, checkpoint: str,
    schema: T.StructType = SOURCE_SCHEMA, files_per_batch: int = FILES_PER_BATCH,
) -> StreamingQuery:
    """New CSV files to bronze, each by the names in its own header.

    A batch has a folder of its own, so one that is run again after a failure lands its files once.
    """
    def land(batch: DataFrame, number: int) -> None:
        files = [row.path for row in batch.collect()]  # names of at most files_per_batch files
        if files:
            rows = csv_batch(batch.sparkSession, files, schema)
            stored(rows).mode("overwrite").parquet(f"{out_dir}/{LANDED}={number}")

    return (
        file_stream(spark, src_dir, files_per_batch)
        .writeStream.queryName("bronze_bookings")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(land)
        .start()
    )


def bronze_stream(
    spark: SparkSession, bronze_dir: str, schema: T.StructType = BRONZE_SCHEMA,
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """Bronze as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(bronze_dir)
        .select(*schema.names)
    )


def build_silver(
    spark: SparkSession, bronze_dir: str, out_dir: str, checkpoint: str,
    schema: T.StructType = BRONZE_SCHEMA,
) -> StreamingQuery:
    """New bronze rows to silver (S6, R2); ``count_rules`` keeps the rules' counts."""
    typed = typed_bookings(bronze_stream(spark, bronze_dir, schema))
    return append_parquet(apply_rules(typed, BOOKING_RULES), out_dir, checkpoint, "silver_bookings")


def count_rules(
    spark: SparkSession, bronze_dir: str, out_dir: str, checkpoint: str,
    schema: T.StructType = BRONZE_SCHEMA,
) -> StreamingQuery:
    """Rule failures of new bronze rows, one small row per batch in a table.

    A stream of its own that reads only the columns the rules look at. A query's own progress forgets
    all but its latest batches; the table doesn't, and a batch that is run again replaces its row.
    """
    def count(batch: DataFrame, number: int) -> None:
        counted = batch.agg(*rule_counts(BOOKING_RULES))
        counted.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    return (
        typed_bookings(bronze_stream(spark, bronze_dir, schema))
        .writeStream.queryName("booking_rules")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(count)
        .start()
    )


def rule_totals(spark: SparkSession, counts_dir: str) -> DataFrame:
    """One row: failures per rule and rows over all batches ever counted."""
    names = [*(rule.name for rule in BOOKING_RULES), "rows"]
    counts = spark.read.schema(", ".join(f"{n} long" for n in names)).parquet(counts_dir)
    return counts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
