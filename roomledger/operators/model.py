"""Cancellation classifier: fit, score, permutation importance."""

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomledger.operators.boosting import Growth, boost, ensemble, exchanged_margins, grown
from roomledger.operators.features import feature_lists, features
from roomledger.operators.metrics import ranking_from_steps, score_steps
from roomledger.operators.risk import stamp_scores
from roomledger.schemas import LABEL
from roomledger.sources.tables import numbered


@dataclass(frozen=True)
class ModelParams:
    """Boosting settings; the defaults are the published ones, leaves and min_leaf those of the published kind."""

    iterations: int = 300
    learning_rate: float = 0.06
    depth: int = 8
    seed: int = 42  # nothing in training is random; permutations are
    bins: int = 255
    leaves: int = 31
    min_leaf: int = 20

    def as_dict(self) -> dict:
        return asdict(self)


def _indexer(categorical: list[str]) -> StringIndexer:
    """Categories numbered in order of the alphabet; one never seen gets one extra, last number."""
    return StringIndexer(
        inputCols=categorical, outputCols=[f"{c}__index" for c in categorical],
        handleInvalid="keep", stringOrderType="alphabetAsc",
    )


def _training_rows(train: DataFrame, label: str) -> tuple[DataFrame, list[str], list[str]]:
    categorical, numeric = feature_lists(train.columns)
    rows = features(train.where(F.col(label).isNotNull()), [label], categorical, numeric)
    return rows.withColumn(label, F.col(label).cast("double")), categorical, numeric


def fit_encoder(train: DataFrame, label: str = LABEL) -> PipelineModel:
    """One-hot vectors of the categories seen in training, as ``<name>__onehot`` (M2).

    A category never seen becomes all zeros: the encoder leaves the indexer's last number out. The model
    itself splits categories as sets and needs no such vectors.
    """
    rows, categorical, _ = _training_rows(train, label)
    encoder = OneHotEncoder(
        inputCols=[f"{c}__index" for c in categorical], outputCols=[f"{c}__onehot" for c in categorical], dropLast=True)
    return Pipeline(stages=[_indexer(categorical), encoder] if categorical else []).fit(rows)


def fit(
    train: DataFrame, params: ModelParams = ModelParams(), label: str = LABEL, saved: str | None = None,
    workers: int | None = None,
) -> PipelineModel:
    """Fit on the features a table has. Runs the training jobs (M3).

    ``saved`` is a folder that keeps the trees of every so many rounds; a fit that failed goes on from
    it when it is called again with the same rows and settings.
    """
    rows, categorical, numeric = _training_rows(train, label)
    stages, indexed, categories = [], [f"{c}__index" for c in categorical], []
    if categorical:
        indexer = _indexer(categorical).fit(rows)
        rows, stages = indexer.transform(rows), [indexer]
        categories = [len(labels) + 1 for labels in indexer.labelsArray]
    growth = Growth(params.iterations, params.learning_rate, params.depth, params.leaves, params.min_leaf, params.bins)
    base, trees, how = boost(rows, indexed, categories, numeric, label, growth, saved, workers)
    model = ensemble(train.sparkSession, base, trees, how, "features__vector", label)
    return PipelineModel([*stages, VectorAssembler(inputCols=indexed + numeric, outputCol="features__vector"), model])


def model_features(model: PipelineModel) -> tuple[list[str], list[str]]:
    """Categorical and numeric inputs of a fitted pipeline, so that scoring asks the model."""
    indexers = [s for s in model.stages if s.hasParam("inputCols") and s.hasParam("stringOrderType")]
    categorical = list(indexers[0].getInputCols()) if indexers else []
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    numeric = [c for c in assembler.getInputCols() if not c.endswith("__index")]
    return categorical, numeric


def _probability(vector: str = "probability") -> Column:
    return vector_to_array(F.col(vector))[1]


def predict(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """Kept columns, cancel_probability and the 0/1 prediction for each row.

    Works on a batch or a stream; every row is scored where it lies.
    """
    categorical, numeric = model_features(model)
    used = set(categorical) | set(numeric)
    scored = model.transform(features(df, keep, categorical, numeric))
    return scored.select(
        *[F.col(f"_{c}").alias(c) if c in used else F.col(c) for c in keep],
        _probability().alias("cancel_probability"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def score(
    model: PipelineModel, silver: DataFrame, model_version: int, scored_at: Column | None = None
) -> DataFrame:
    """reservation_risk for every reservation."""
    scored = predict(model, silver, ["reservation_id", "hotel"])
    return stamp_scores(scored, model_version, scored_at)


def _paired(
    rows: DataFrame, names: list[str], keep: list[str], order: Column, repeats: int, carried: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The numbered rows, and (other, repeat, row): the row that row is paired with in each repeat.

    ``other`` holds the carried columns, the names if none are given.
    """
    carried = carried or names
    base = numbered(rows.select(*dict.fromkeys([*keep, *names, *carried])), "row", order=[*dict.fromkeys([*keep, *names])])
    total = base.count()
    turns = base.drop("row").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    # the order may look at every column, what is sorted has only those that are carried or break ties
    ordered = turns.withColumn("_order", order).select(*dict.fromkeys(["repeat", "_order", *names, *carried]))
    turned = numbered(ordered, "place", order=["repeat", "_order", *names])
    return base, turned.select(
        F.struct(*carried).alias("other"), "repeat",
        (F.col("place") - (F.col("repeat") - 1) * F.lit(total)).alias("row"),
    )


def permuted(
    rows: DataFrame, names: list[str], keep: list[str], order: Column, repeats: int = 5
) -> DataFrame:
    """The rows, and copies of them with one column at a time taken from another row.

    Columns: feature (NULL for the untouched rows), repeat, the kept ones and the names. Repeat r
    pairs row i with the row that comes i-th when all are put in the order, an expression over
    ``repeat`` and the rows' columns; ties are put in the order of the names. Both numberings are by
    ranges, so no task sorts all rows, and the copies are spread over all tasks.
    """
    base, other = _paired(rows, names, keep, order, repeats)
    copies = base.join(other, "row").withColumn("feature", F.explode(F.array(*[F.lit(name) for name in names])))
    moved = copies.select(
        "feature", "repeat", *keep,
        *[
            F.when(F.col("feature") == name, F.col(f"other.{name}")).otherwise(F.col(name)).alias(name)
            for name in names
        ],
    )
    untouched = base.select(F.lit(None).cast("string").alias("feature"), F.lit(0).alias("repeat"), *keep, *names)
    return moved.unionByName(untouched)


def trees_by_feature(model: PipelineModel) -> dict[str, list[int]]:
    """For each feature the numbers of the trees that split by it."""
    categorical, numeric = model_features(model)
    found: dict[str, list[int]] = {name: [] for name in categorical + numeric}
    inputs = [c.removesuffix("__index") for c in model.stages[-2].getInputCols()]
    for number, tree in enumerate(model.stages[-1]._java_obj.trees()):
        for place in {int(i) for i in re.findall(r"\(feature (\d+) ", tree.toDebugString())}:
            found[inputs[place]].append(number)
    return found


def _margins(model: PipelineModel, df: DataFrame, inputs: list[str], others: list[str], trees: dict[str, list[int]]) -> DataFrame:
    """label, repeat and what the trees add up to: of the row, then with each input taken from the other row, if given.

    Sums are rounded to 12 places.
    """
    spark, count = df.sparkSession, len(inputs)
    held, trees_of = grown(spark, model.stages[-1]), [trees[c.removesuffix("__index")] for c in inputs]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i + 2).to_numpy(zero_copy_only=False) for i in range(count + len(others))]
            margin, moved = exchanged_margins(held, columns[:count], columns[count:], trees_of)
            sums = np.round(np.vstack([margin, moved]) if others else margin[None], 12) + 0.0
            lists = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, len(sums), dtype=np.int32), sums.T.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["label", "repeat", "margins"])

    numbers = [F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate([*inputs, *others])]
    return df.select("label", "repeat", *numbers).mapInArrow(add_up, "label int, repeat int, margins array<double>")


def permutation_scores(
    model: PipelineModel, test: DataFrame, label: str = LABEL, repeats: int = 5, seed: int = 42
) -> DataFrame:
    """feature, repeat, label, cancel_probability of the test rows and their permuted copies.

    All rows take part, whatever their number. A copy differs from its row only in what the trees that split
    by the permuted feature say: only these run on it, by look-ups in numpy, and what they said of the row is
    replaced in the row's sum. Sums are rounded to 12 places, so that scores which differ by rounding errors only are ties.
    """
    categorical, numeric = model_features(model)
    names, keep, trees = categorical + numeric, [label, "reservation_id"], trees_by_feature(model)
    *encoders, assembler, _ = model.stages
    inputs = assembler.getInputCols()
    rows = features(test, keep, categorical, numeric)
    for encoder in encoders:
        rows = encoder.transform(rows)
    order = F.xxhash64("repeat", F.lit(seed), "reservation_id")
    base, other = _paired(rows, names, keep, order, repeats, inputs)
    base = base.withColumn("label", F.col(label).cast("int"))
    pairs = base.join(other.select("row", "repeat", *[F.col(f"other.{c}").alias(f"_other_{c}") for c in inputs]), "row")
    moved = _margins(model, pairs, inputs, [f"_other_{c}" for c in inputs], trees)
    sums = [F.struct(F.lit(c.removesuffix("__index")).alias("feature"), F.col("margins")[i + 1].alias("margin")) for i, c in enumerate(inputs)]
    columns = lambda feature, repeat, margin: [
        feature.alias("feature"), repeat.alias("repeat"), "label", (1 / (1 + F.exp(-2 * margin))).alias("cancel_probability"),
    ]
    moved = moved.withColumn("sum", F.explode(F.array(*sums))).select(*columns(F.col("sum.feature"), F.col("repeat"), F.col("sum.margin")))
    untouched = _margins(model, base.withColumn("repeat", F.lit(0)), inputs, [], trees)
    return moved.unionByName(untouched.select(*columns(F.lit(None).cast("string"), F.lit(0), F.col("margins")[0])))


def importance(scored: DataFrame, top: int = 15) -> DataFrame:
    """Mean drop in ROC-AUC per feature, largest first, from permutation scores."""
    keys = ("feature", "repeat")
    aucs = ranking_from_steps(score_steps(scored, "label", "cancel_probability", keys=keys), *keys)
    # a few hundred rows: one per feature and repeat
    with_base = aucs.withColumn(
        "base", F.max(F.when(F.col("feature").isNull(), F.col("roc_auc"))).over(Window.partitionBy())
    )
    return (
        with_base.where(F.col("feature").isNotNull())
        .groupBy("feature")
        .agg(F.avg(F.col("base") - F.col("roc_auc")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
        .limit(top)
    )


def feature_importance(
    model: PipelineModel, test: DataFrame, label: str = LABEL, repeats: int = 5, seed: int = 42, top: int = 15,
) -> DataFrame:
    """Mean drop in ROC-AUC when a feature's values are exchanged, over the whole holdout."""
    rows = test.where(F.col(label).isNotNull())
    return importance(permutation_scores(model, rows, label, repeats, seed), top)
