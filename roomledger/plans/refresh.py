"""The end-to-end job: land, clean, aggregate, train, score, publish.

Steps run in order and an error ends the run, so nothing is scored by a model that failed to train
and readers keep the last published snapshot.
"""

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from roomledger.operators.features import feature_lists, split_cutoff, temporal_split
from roomledger.operators.gold import gold_hotel_month
from roomledger.operators.metrics import ranking_metrics, threshold_metrics
from roomledger.operators.model import ModelParams, fit, predict, score
from roomledger.operators.serving import build_serving
from roomledger.schemas import LABEL, SOURCE_SCHEMA
from roomledger.sources.landing import infer_schema, landed_schema
from roomledger.sources.ledger import load_champion, promote, register
from roomledger.sources.tables import exists, publish, read_snapshot, read_table, scratch
from roomledger.streaming.medallion import build_silver, count_rules, land_csv

MODEL_NAME = "cancel_classifier"
EPOCH = date(1970, 1, 1)
KEPT_SNAPSHOTS = 3  # readers of an older one have this many runs to finish


@dataclass(frozen=True)
class Layout:
    """Where the tables of one deployment live."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def checkpoint(self, name: str) -> str:
        return f"{self.root}/checkpoints/{name}"


def frozen_schema(spark: SparkSession, src_dir: str, layout: Layout) -> T.StructType:
    """Column types found in the first files ever landed; every later run uses the same.

    Columns of the source keep their known types, any others are as found.
    """
    path = layout.path("schema")
    if not exists(spark, path):
        known = {f.name: f for f in SOURCE_SCHEMA.fields}
        found = [known.pop(f.name, f) for f in infer_schema(spark, src_dir).fields]
        spark.createDataFrame([], T.StructType([*found, *known.values()])).coalesce(1).write.parquet(path)
    return spark.read.parquet(path).schema


def ingest(spark: SparkSession, src_dir: str, layout: Layout, schema: T.StructType | None = None) -> None:
    """New files to bronze, new bronze rows to silver, a new snapshot of gold from all of silver.

    Files are read by the names in their headers and cast to the schema, by default the one frozen at
    the first run. Failures of the quality rules are added up in a table.
    """
    schema = schema or frozen_schema(spark, src_dir, layout)
    bronze, landed = layout.path("bronze"), landed_schema(schema)
    land_csv(spark, src_dir, bronze, layout.checkpoint("bronze"), schema).awaitTermination()
    build_silver(spark, bronze, layout.path("silver"), layout.checkpoint("silver"), landed).awaitTermination()
    count_rules(spark, bronze, layout.path("rules"), layout.checkpoint("rules"), landed).awaitTermination()
    gold = gold_hotel_month(read_table(spark, layout.path("silver")))
    publish(gold, layout.path("gold"), None, ["hotel", "arrival_month_start"], keep=KEPT_SNAPSHOTS)


def train_and_register(
    silver: DataFrame, root: str, params: ModelParams = ModelParams(), name: str = MODEL_NAME
) -> tuple[int, dict]:
    """Fit on the earlier arrivals, measure on the later ones, register and promote.

    What comes back to the driver is one row of metrics at a time.
    """
    spark = silver.sparkSession
    cutoff = split_cutoff(silver).first()[0]
    marked = temporal_split(silver, cutoff=cutoff)
    train, test = marked.where("split = 'train'"), marked.where("split = 'test'")
    model = fit(train, params)
    with scratch(spark, "holdout-scores") as path:
        predict(model, test, [LABEL]).write.parquet(path)
        scored = spark.read.parquet(path)
        metrics = {
            **ranking_metrics(scored, LABEL, "cancel_probability").first().asDict(),
            **threshold_metrics(scored, LABEL, "cancel_probability").first().asDict(),
        }
    sizes = {row.split: row["count"] for row in marked.groupBy("split").count().collect()}
    categorical, numeric = feature_lists(silver.columns)
    record = {
        **params.as_dict(),
        "estimator": "GBTClassifier",
        "split": "temporal",
        "split_cutoff": EPOCH + timedelta(days=int(cutoff)),
        "n_train": sizes.get("train", 0),
        "n_test": sizes.get("test", 0),
        "n_categorical": len(categorical),
        "n_numeric": len(numeric),
    }
    version = register(spark, root, name, model, record, metrics)
    promote(spark, root, name, version)
    return version, metrics


def score_all(silver: DataFrame, root: str, risk_path: str, name: str = MODEL_NAME) -> int:
    """Score every reservation with the promoted model into a new snapshot of risk."""
    model, version = load_champion(silver.sparkSession, root, name)
    publish(score(model, silver, version), risk_path, None, keep=KEPT_SNAPSHOTS)
    return version


def refresh_model(spark: SparkSession, layout: Layout, params: ModelParams = ModelParams()) -> int:
    """Train, then score, then publish; each step only after the one before it succeeded."""
    silver = read_table(spark, layout.path("silver"))
    train_and_register(silver, layout.path("model"), params)
    score_all(silver, layout.path("model"), layout.path("risk"))
    serving = build_serving(read_snapshot(spark, layout.path("risk")), silver)
    return publish(serving, layout.path("serving"), "reservation_id", ["hotel", "arrival_date"], keep=KEPT_SNAPSHOTS)


def run(
    spark: SparkSession, src_dir: str, layout: Layout, params: ModelParams = ModelParams(),
    schema: T.StructType | None = None,
) -> DataFrame:
    """The whole job; the served snapshot comes back."""
    ingest(spark, src_dir, layout, schema)
    refresh_model(spark, layout, params)
    return read_snapshot(spark, layout.path("serving"))
