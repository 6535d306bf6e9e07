"""Tables kept up by streams: gold, the latest action and one row per key, without reading it all again.

An aggregate over a stream keeps its groups in Spark's state store and gives each batch's changed groups.
Those are written to a folder per batch; reading takes each group's newest version. Folding merges them
into a published snapshot. A batch that is run again has the same state to start from and replaces its own
folder, so retries change nothing, and rows may come in any order and however late: no group is ever closed,
which costs one row of state per group.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roomledger.functions.keys import packed_key, unpacked_key
from roomledger.operators.actions import latest_action
from roomledger.operators.gold import gold_hotel_month
from roomledger.operators.serving import one_per_key
from roomledger.sources.tables import NoSnapshot, exists, publish, read_snapshot, remove, stored

GOLD_KEYS = ["hotel", "arrival_year", "arrival_month", "arrival_month_start"]
_BATCH = "changed_in"  # number of the batch that a version of a group comes from
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def keep_up(updates: DataFrame, root: str, checkpoint: str, name: str) -> StreamingQuery:
    """Write the changed groups of every batch of a streaming aggregate, until the input is used up.

    State is kept by RocksDB, on disk and in the checkpoint, since keys may be as many as rows.
    """
    def write(batch: DataFrame, number: int) -> None:
        stored(batch).mode("overwrite").parquet(f"{root}/changes/{_BATCH}={number}")

    spark = updates.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        return (
            updates.writeStream.queryName(name)
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
    finally:
        spark.conf.set(_PROVIDER, before)


def _versions(spark: SparkSession, root: str) -> DataFrame | None:
    """All versions of the groups that are still there: of the snapshot and of batches since."""
    parts = []
    try:
        parts.append(read_snapshot(spark, f"{root}/folded"))
    except NoSnapshot:
        pass
    if exists(spark, f"{root}/changes"):
        changes = spark.read.parquet(f"{root}/changes")
        parts.append(changes.withColumn(_BATCH, F.col(_BATCH).cast("long")))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _newest(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group; a grouped maximum by batch, so a group with many versions is no hot key."""
    others = [c for c in versions.columns if c not in (*keys, _BATCH)]
    best = F.max_by(F.struct(*others, _BATCH), _BATCH).alias("best")
    packed = [packed_key(versions, k).alias(k) for k in keys]  # keys cross the network as few bytes
    return versions.groupBy(*packed).agg(best).select(*[unpacked_key(versions, k, k).alias(k) for k in keys], "best.*")


def read_kept(spark: SparkSession, root: str, keys: Sequence[str]) -> DataFrame:
    """The table as of the last batch. NoSnapshot before the first."""
    versions = _versions(spark, root)
    if versions is None:
        raise NoSnapshot(root)
    return _newest(versions, keys).select(*[c for c in versions.columns if c != _BATCH])


def fold(spark: SparkSession, root: str, keys: Sequence[str], keep: int = 2) -> int | None:
    """Merge the changes into the next snapshot; its number, or None when there are none.

    The folders merged are removed when the next fold has been published, so a reader that has listed
    them finishes.
    """
    if not exists(spark, f"{root}/changes"):
        return None
    changes = spark.read.parquet(f"{root}/changes")
    batches = sorted(r[0] for r in changes.select(_BATCH).distinct().collect())  # one number per batch since
    try:
        folded = read_snapshot(spark, f"{root}/folded").agg(F.max(_BATCH)).first()[0]
    except NoSnapshot:
        folded = None
    number = publish(_newest(_versions(spark, root), keys), f"{root}/folded", None, keep=keep)
    for batch in batches:
        if folded is not None and batch <= folded:
            remove(spark, f"{root}/changes/{_BATCH}={batch}")
    return number


def keep_gold(silver: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Gold kept up from a stream of silver (A1, R2); as many rows of state as hotels have months."""
    return keep_up(gold_hotel_month(silver), root, checkpoint, "gold_kept")


def keep_latest_actions(actions: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """The newest action of each reservation from a stream of actions, the higher id on equal times."""
    return keep_up(latest_action(actions), root, checkpoint, "latest_action_kept")


def keep_one_per_key(rows: DataFrame, key: str, order: Sequence[str], root: str, checkpoint: str) -> StreamingQuery:
    """The row of each key that a batch would keep, whatever the order of arrival.

    A late row replaces an earlier one only if it is greater in that order; nothing is dropped for being late.
    """
    return keep_up(one_per_key(rows, key, order), root, checkpoint, "one_per_key_kept")
