"""Scoring new reservations and refreshing the served snapshot as streams."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roomledger.operators.model import predict
from roomledger.operators.risk import stamp_scores
from roomledger.operators.serving import build_serving
from roomledger.sources.tables import publish
from roomledger.streaming.medallion import append_parquet


def score_stream(
    model: PipelineModel, model_version: int, silver: DataFrame, out_dir: str, checkpoint: str
) -> StreamingQuery:
    """Score reservations as they arrive."""
    scored = predict(model, silver, ["reservation_id", "hotel"])
    return append_parquet(
        stamp_scores(scored, model_version), out_dir, checkpoint, "reservation_risk"
    )


def label_stream(model: PipelineModel, silver: DataFrame, keep: list[str]) -> DataFrame:
    """Expected outcome (0 kept, 1 canceled) beside kept columns, for a batch or a stream."""
    return predict(model, silver, keep).select(*keep, "prediction")


def snapshot_stream(
    spark: SparkSession, risk_dir: str, silver_dir: str, root: str, checkpoint: str
) -> StreamingQuery:
    """Publish a new snapshot whenever scores have been added.

    The stream is only the trigger: a snapshot is always the whole of both tables. It is named after
    its batch, so a batch that is run again after a failure publishes nothing twice.
    """
    schema = spark.read.parquet(risk_dir).schema

    def republish(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        risk, silver = session.read.parquet(risk_dir), session.read.parquet(silver_dir)
        publish(build_serving(risk, silver), root, "reservation_id", made_for=f"{checkpoint}#{number}")

    return (
        spark.readStream.schema(schema)
        .parquet(risk_dir)
        .select(F.lit(1).alias("arrived"))
        .writeStream.queryName("snapshot_refresh")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(republish)
        .start()
    )
