"""The append-only action log as a table and as a stream sink."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from roomledger.operators.actions import ACTION_COLUMNS, checked_actions
from roomledger.schemas import ACTION_SCHEMA
from roomledger.sources.tables import current_snapshot, exists, numbered, publish, read_snapshot, remove

STORED_SCHEMA = T.StructType([
    *ACTION_SCHEMA.fields,
    T.StructField("reason", T.StringType()),
    T.StructField("batch", T.StringType()),
    T.StructField("valid", T.BooleanType()),
])


LAST_SCHEMA = T.StructType([T.StructField("last", T.LongType()), T.StructField("batch", T.StringType())])


def _last_dir(log_dir: str) -> str:
    """Beside the log: per batch, the highest id in it."""
    return f"{log_dir}_last"


def _compact_dir(log_dir: str) -> str:
    """Beside the log: snapshots of it, ordered for reading."""
    return f"{log_dir}_compact"


def _notes_dir(log_dir: str) -> str:
    """Beside the log: snapshots of the highest ids of older batches."""
    return f"{log_dir}_notes"


def _batches(spark: SparkSession, log_dir: str) -> DataFrame:
    if not exists(spark, log_dir):
        return spark.createDataFrame([], STORED_SCHEMA)
    return spark.read.schema(STORED_SCHEMA).parquet(log_dir)


def _stored(spark: SparkSession, log_dir: str) -> DataFrame:
    """The compacted part of the log and the batches written since."""
    if current_snapshot(spark, _compact_dir(log_dir)) is None:
        return _batches(spark, log_dir)
    compact = read_snapshot(spark, _compact_dir(log_dir))
    done = compact.select("batch").distinct()
    newer = _batches(spark, log_dir).join(done, "batch", "left_anti")
    return compact.select(*STORED_SCHEMA.names).unionByName(newer.select(*STORED_SCHEMA.names))


def read_actions(spark: SparkSession, log_dir: str) -> DataFrame:
    """The log: every valid action."""
    return _stored(spark, log_dir).where("valid").select(*ACTION_COLUMNS)


def read_rejects(spark: SparkSession, log_dir: str) -> DataFrame:
    """What was refused, with the reason."""
    return _stored(spark, log_dir).where("NOT valid").select(*ACTION_COLUMNS, "reason")


def assign_ids(df: DataFrame, start: int) -> DataFrame:
    """Consecutive ids from ``start`` for the rows that have none; given ids stay.

    The numbers follow the rows' content, so the same rows get the same ids however they are read.
    """
    content = [c for c in df.columns if c != "id"]
    without = numbered(df.where(F.col("id").isNull()), "id", start, order=content)
    return df.where(F.col("id").isNotNull()).unionByName(without.select(*df.columns))


def append_actions(df: DataFrame, log_dir: str, batch: str | None = None) -> str:
    """Check actions and add them to the log in one pass, the refused ones apart.

    A batch has a folder of its own, so repeating one after a failure replaces it and never adds
    its rows twice. The highest id of the batch is noted beside the log. Returns the batch's name.
    """
    batch = batch or uuid.uuid4().hex
    folder = _write_batch(df, log_dir, batch)
    written = df.sparkSession.read.schema(T.StructType([*ACTION_SCHEMA.fields, STORED_SCHEMA["valid"]])).parquet(folder)
    _note(df.sparkSession, log_dir, batch, written.where("valid").agg(F.max("id")).first()[0])
    return batch


def _write_batch(df: DataFrame, log_dir: str, batch: str) -> str:
    folder = f"{log_dir}/batch={batch}"
    (
        checked_actions(df)
        .withColumn("valid", F.col("reason").isNull())
        .write.mode("overwrite")
        .partitionBy("valid")
        .parquet(folder)
    )
    return folder


def _note(spark: SparkSession, log_dir: str, batch: str, highest: int | None) -> None:
    note = spark.range(0, 1, 1, 1).select(F.lit(highest).cast("long").alias("last"))
    note.write.mode("overwrite").parquet(f"{_last_dir(log_dir)}/batch={batch}")


def _notes(spark: SparkSession, log_dir: str) -> DataFrame:
    """(last, batch) of every batch; a note of its own goes before one in the snapshot."""
    own = spark.createDataFrame([], LAST_SCHEMA)
    if exists(spark, _last_dir(log_dir)):
        own = spark.read.schema(LAST_SCHEMA).parquet(_last_dir(log_dir))
    if current_snapshot(spark, _notes_dir(log_dir)) is None:
        return own
    older = read_snapshot(spark, _notes_dir(log_dir)).select(*LAST_SCHEMA.names)
    return older.join(own.select("batch"), "batch", "left_anti").select(*LAST_SCHEMA.names).unionByName(own)


def last_id(spark: SparkSession, log_dir: str, without: str | None = None) -> int:
    """The highest id in the log, from one noted number per batch; 0 when there is none.

    A batch that is being repeated is left out, so that it gets the ids it had.
    """
    noted = _notes(spark, log_dir)
    if without is not None:
        noted = noted.where(F.col("batch") != without)
    return noted.agg(F.max("last")).first()[0] or 0


def record_actions(df: DataFrame, log_dir: str, batch: str | None = None) -> DataFrame:
    """Append actions, numbering those without an id after the highest in the log.

    One pass tells the highest id and whether any is missing, and only then are rows put in order to be
    numbered. Where all have ids the other pass is the writing. The rows come back as they were
    written. For one writer at a time, like any counter kept in a table.
    """
    spark, batch = df.sparkSession, batch or uuid.uuid4().hex
    given, missing, valid = checked_actions(df).agg(
        F.max("id"), F.count_if(F.col("id").isNull()), F.max(F.when(F.col("reason").isNull(), F.col("id")))).first()
    if missing:
        append_actions(assign_ids(df, max(given or 0, last_id(spark, log_dir, batch)) + 1), log_dir, batch)
    else:
        _write_batch(df, log_dir, batch)
        _note(spark, log_dir, batch, valid)
    return _batches(spark, log_dir).where((F.col("batch") == batch) & F.col("valid")).select(*ACTION_COLUMNS)


def action_stream(source: DataFrame, log_dir: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of actions to the log.

    The batch number names the folder, so a batch run again after a failure is written once, with the
    ids it had. Actions that come without an id get one.
    """
    def write(batch: DataFrame, number: int) -> None:
        record_actions(batch, log_dir, f"stream-{number:012d}")

    return (
        source.writeStream.queryName("reservation_action")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def compact_actions(spark: SparkSession, log_dir: str, keep: int = 2) -> int:
    """Publish the log ordered by reservation and time; readers use it from then on.

    A reservation's actions are then read from few files. Batches written later are read beside it
    until the next compaction. The batches themselves stay, so a stream can still repeat its last one.
    The notes of highest ids are put into one table too, and their files go.
    """
    number = publish(_stored(spark, log_dir), _compact_dir(log_dir), None, ["reservation_id", "acted_at"], keep=keep)
    if exists(spark, _last_dir(log_dir)):
        own = spark.read.schema(LAST_SCHEMA).parquet(_last_dir(log_dir)).select("batch").collect()  # names of new batches
        publish(_notes(spark, log_dir), _notes_dir(log_dir), None, ["batch"], keep=keep)
        for row in own:
            remove(spark, f"{_last_dir(log_dir)}/batch={row.batch}")
    return number
