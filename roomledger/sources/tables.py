"""Parquet tables: scan, replace, clustered write, published snapshots.

Plain folders have no transactions, so nothing is overwritten while it may be read: a new version is
written beside the old one and only then named in a pointer table.
"""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger.functions.keys import packed_key, unpacked_key
from roomledger.session import work_dir

POINTER_SCHEMA = T.StructType([
    T.StructField("snapshot", T.LongType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("published_at", T.TimestampType()),
    T.StructField("made_for", T.StringType()),
])


class NoSnapshot(Exception):
    """Nothing has been published there yet."""


class InvalidKey(ValueError):
    """A key is NULL or occurs more than once."""


def stored(df: DataFrame) -> DataFrameWriter:
    """Writer of a table's files. Keys are hex digits, which only a codec with entropy coding halves."""
    return df.write.option("compression", "zstd")


@contextmanager
def file_by_file(spark: SparkSession) -> Iterator[None]:
    """Scans that run in the block put no two files in one task, so a projection keeps the files' clustering."""
    cost, most = "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(cost)
    spark.conf.set(cost, spark.conf.get(most))
    try:
        yield
    finally:
        spark.conf.set(cost, before)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Batch scan."""
    return spark.read.parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Full overwrite; the columns may differ from the last time.

    ``df`` must not read from ``path``. Use ``publish`` where readers are active.
    """
    stored(df).mode("overwrite").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a parquet table has been written there."""
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write to a fresh folder in the shared directory and read back.

    Cuts the lineage at something that outlives any executor, for a frame used several times.
    """
    path = work_dir(df.sparkSession, purpose)
    stored(df).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, column: str, start: int = 1, order: list | None = None) -> DataFrame:
    """A written copy of the rows with consecutive numbers, in the given order if there is one.

    Numbering everything in one sorted task would not scale. The rows are written with the task they
    come from and their place in it, and a task's numbers begin after those of the tasks before it.
    All that has to be put in order is one count per task.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(
        df.withColumn("_place", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_place", 33)),
        "numbered",
    )
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(F.col("_task").alias("task"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("task", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    )
    in_task = F.col("_place") - F.shiftleft("_task", 33)
    # one row per task is sent to the rows; by its size alone the planner would shuffle the rows to it
    return placed.join(F.broadcast(starts), F.col("_task") == F.col("task")).withColumn(
        column, F.lit(start) + F.col("before") + in_task
    ).select(*[c for c in df.columns if c != column], column)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder that this library wrote; false when there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.delete(target, True)


@contextmanager
def scratch(spark: SparkSession, purpose: str) -> Iterator[str]:
    """Folder in the shared directory for tables that nothing reads once the block is left."""
    path = work_dir(spark, purpose)
    try:
        yield path
    finally:
        remove(spark, path)


def clustered(df: DataFrame, columns: list[str], partitions: int | None = None) -> DataFrame:
    """Rows ordered so that a scan can skip files and row groups by min and max.

    Range bounds are found by sampling, which runs the input once more: cluster a written table, as
    a maintenance job does, rather than the end of a long computation.

    The last range column is the task a row comes from. Without it, many copies of one row would all
    be in the same range and so in one output task.
    """
    origin = "_origin"
    keys = [*columns, origin]
    ranged = df.withColumn(origin, F.spark_partition_id())
    ranged = (
        ranged.repartitionByRange(*keys) if partitions is None
        else ranged.repartitionByRange(partitions, *keys)
    )
    return ranged.sortWithinPartitions(*columns).drop(origin)


def write_clustered(df: DataFrame, path: str, columns: list[str], partitions: int | None = None) -> None:
    stored(clustered(df, columns, partitions)).mode("overwrite").parquet(path)


def write_balanced(df: DataFrame, path: str) -> None:
    """Write files of even size however skewed or few the input's partitions are.

    Spark splits and joins partitions by their measured size, so one hot key makes no huge file and
    many small inputs make no small files.
    """
    stored(df.hint("rebalance")).mode("overwrite").parquet(path)


def require_unique_key(df: DataFrame, key: str) -> int:
    """Number of rows; InvalidKey when the key is NULL or repeats.

    One grouped count, combined on the map side; only one row comes back. Keys are counted by eight bytes of
    hash first, and themselves only where a hash repeats.
    """
    hashed = df.groupBy(F.xxhash64(key).alias("hash")).agg(F.count(F.lit(1)).alias("copies"))
    seen = hashed.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"), F.count_if(F.col("copies") > 1).alias("repeated")).first()
    if not seen.repeated and df.where(F.col(key).isNull()).isEmpty():
        return seen.rows  # keys with different hashes are different
    copies = df.groupBy(packed_key(df, key).alias("_key")).agg(F.count(F.lit(1)).alias("copies"))
    found = copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("_key").isNull(), F.col("copies"))), F.lit(0)).alias("nulls"),
        F.count_if(F.col("copies") > 1).alias("repeated"),
    ).first()
    if found.nulls or found.repeated:
        raise InvalidKey(f"{key}: {found.nulls} rows without a key, {found.repeated} repeated keys")
    return found.rows


def _pointer(root: str) -> str:
    return f"{root}/pointer"


def _folder(root: str, snapshot: int) -> str:
    return f"{root}/data/snapshot={snapshot}"


def current_snapshot(spark: SparkSession, root: str) -> int | None:
    """Number of the newest published snapshot, None before the first."""
    if not exists(spark, _pointer(root)):
        return None
    pointer = spark.read.schema(POINTER_SCHEMA).parquet(_pointer(root))
    return pointer.agg(F.max("snapshot")).first()[0]


def published_for(spark: SparkSession, root: str, made_for: str) -> int | None:
    """The snapshot that was published under that name, if any."""
    if not exists(spark, _pointer(root)):
        return None
    pointer = spark.read.schema(POINTER_SCHEMA).parquet(_pointer(root))
    return pointer.where(F.col("made_for") == made_for).agg(F.max("snapshot")).first()[0]


def publish(
    df: DataFrame, root: str, key: str | None, cluster_by: list[str] | None = None,
    keep: int | None = None, made_for: str | None = None,
) -> int:
    """Write a complete new snapshot, check its key, then make it the current one.

    What is checked is what was written, so the input is computed once, and clustering, which samples
    its input, works on a written copy. A run that fails before the last step leaves readers on the
    old snapshot, and the next run writes over its leftovers. ``keep`` removes all but so many of the
    newest snapshots afterwards. A snapshot ``made_for`` something that has one is not made again.
    """
    spark = df.sparkSession
    if made_for is not None and (done := published_for(spark, root, made_for)) is not None:
        return done
    snapshot = (current_snapshot(spark, root) or 0) + 1
    folder = _folder(root, snapshot)
    if cluster_by:
        with scratch(spark, "unclustered") as path:
            stored(df).parquet(path)
            rows = spark.read.schema(df.schema).parquet(path)
            if key is None or key in cluster_by:
                laid = clustered(rows, cluster_by)
            else:  # keys cross the network as few bytes
                laid = clustered(rows.withColumn(key, packed_key(rows, key)), cluster_by).withColumn(key, unpacked_key(rows, key, key))
            stored(laid).mode("overwrite").parquet(folder)
    else:
        stored(df).mode("overwrite").parquet(folder)
    written = spark.read.schema(df.schema).parquet(folder)
    rows = written.count() if key is None else require_unique_key(written, key)
    spark.range(1).select(
        F.lit(snapshot).cast("long").alias("snapshot"),
        F.lit(rows).cast("long").alias("row_count"),
        F.current_timestamp().alias("published_at"),
        F.lit(made_for).cast("string").alias("made_for"),
    ).coalesce(1).write.mode("append").parquet(_pointer(root))
    for old in range(snapshot - keep, 0, -1) if keep else ():
        if not remove(spark, _folder(root, old)):
            break  # what is older went earlier
    return snapshot


def read_snapshot(spark: SparkSession, root: str, snapshot: int | None = None) -> DataFrame:
    """A published snapshot, the newest unless one is named. NoSnapshot before the first."""
    number = snapshot or current_snapshot(spark, root)
    if number is None:
        raise NoSnapshot(root)
    return spark.read.parquet(_folder(root, number))


def refresh(source: DataFrame, root: str, key: str) -> str:
    """Publish again where a snapshot exists; skip where none was set up yet."""
    if current_snapshot(source.sparkSession, root) is None:
        return "SKIPPED_NOT_FOUND"
    publish(source, root, key)
    return "COMPLETED"


