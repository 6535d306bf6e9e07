import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from roomledger.operators import features as f
from roomledger.operators import model as m
from roomledger.operators.metrics import ranking_metrics
from roomledger.schemas import CATEGORICAL_FEATURES, NEVER_FEATURES, NUMERIC_FEATURES
from roomledger.sources import ledger
from roomledger.sources.tables import numbered
from roomledger.streaming.scoring import label_stream

PARAMS = m.ModelParams(iterations=5, learning_rate=0.3, depth=3)


@pytest.fixture(scope="module")
def bookings(spark):
    """Cancels when the lead time is long, unless there is a deposit."""
    rng = random.Random(7)
    rows = []
    for i in range(800):
        lead, deposit = rng.randrange(200), rng.choice(["No Deposit", "Refundable"])
        rows.append((
            f"{i:04d}", rng.choice(["City Hotel", "Resort Hotel"]), lead, deposit,
            rng.randrange(5), date(2016, 1, 1) + timedelta(days=i % 365),
            lead > 100 and deposit == "No Deposit",
        ))
    return spark.createDataFrame(rows, (
        "reservation_id string, hotel string, lead_time int, deposit_type string, adults int,"
        " arrival_date date, is_canceled boolean"
    ))


@pytest.fixture(scope="module")
def split(bookings):
    marked = f.temporal_split(bookings)
    return marked.where("split = 'train'"), marked.where("split = 'test'")


@pytest.fixture(scope="module")
def fitted(split):
    return m.fit(split[0], PARAMS)


def test_feature_lists_follow_the_table():
    assert f.feature_lists(["lead_time", "hotel", "country", "x"]) == (["hotel"], ["lead_time"])


def test_no_feature_is_forbidden():
    assert not set(CATEGORICAL_FEATURES + NUMERIC_FEATURES) & set(NEVER_FEATURES)
    assert len(CATEGORICAL_FEATURES) == 7 and len(NUMERIC_FEATURES) == 17


def test_leak_is_an_error(monkeypatch):
    monkeypatch.setattr(f, "NUMERIC_FEATURES", ["est_lost_revenue"])
    with pytest.raises(ValueError, match="est_lost_revenue"):
        f.feature_lists(["est_lost_revenue"])


def test_features_are_filled(spark):
    df = spark.createDataFrame([(None, None, "k")], "hotel string, lead_time int, reservation_id string")
    row = f.features(df, ["reservation_id", "hotel"], ["hotel"], ["lead_time"]).first()
    assert (row.reservation_id, row._hotel, row.hotel, row.lead_time) == ("k", None, "missing", 0.0)


def test_cutoff_interpolates_and_missing_dates_are_tested(spark):
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(4)]
    df = spark.createDataFrame([(d,) for d in days] + [(None,)], "arrival_date date")
    start = (days[0] - date(1970, 1, 1)).days
    assert f.split_cutoff(df).first().cutoff == pytest.approx(start + 2.4)
    got = {r.arrival_date: r.split for r in f.temporal_split(df).collect()}
    assert got == {days[0]: "train", days[1]: "train", days[2]: "train", days[3]: "test", None: "test"}
    known = f.temporal_split(df, cutoff=start + 2.4)
    assert {r.arrival_date: r.split for r in known.collect()} == got


def test_learns_a_separable_outcome(fitted, split):
    scored = m.predict(fitted, split[1], ["is_canceled"])
    assert ranking_metrics(scored, "is_canceled", "cancel_probability").first().roc_auc > 0.95


def test_scores_every_row_between_zero_and_one(fitted, bookings):
    risk = m.score(fitted, bookings, 4)
    assert risk.count() == bookings.count()
    assert risk.where("cancel_probability NOT BETWEEN 0 AND 1 OR cancel_probability IS NULL").count() == 0
    assert [r[0] for r in risk.select("model_version").distinct().collect()] == [4]
    assert risk.columns == [
        "reservation_id", "hotel", "cancel_probability", "risk_band", "model_version", "scored_at"
    ]


def test_unseen_category_is_all_zeros(fitted, bookings):
    new = bookings.limit(1).withColumn("hotel", F.lit("Beach Hotel"))
    categorical, numeric = m.model_features(fitted)
    row = m.fit_encoder(bookings).transform(f.features(new, [], categorical, numeric)).first()
    assert row["hotel__onehot"].numNonzeros() == 0 and row["hotel__onehot"].size == 2
    assert 0 < m.predict(fitted, new, []).first().cancel_probability < 1


def test_scoring_runs_no_python_on_rows(fitted, bookings):
    plan = m.score(fitted, bookings, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_labels_for_new_bookings(fitted, spark):
    new = spark.createDataFrame(
        [("risky", "City Hotel", 180, "No Deposit", 1), ("safe", "City Hotel", 2, "Refundable", 1)],
        "reservation_id string, hotel string, lead_time int, deposit_type string, adults int",
    )
    got = {r.reservation_id: r.prediction for r in label_stream(fitted, new, ["reservation_id"]).collect()}
    assert got == {"risky": 1, "safe": 0}


def test_published_settings_are_the_default():
    assert m.ModelParams().as_dict() == {
        "iterations": 300, "learning_rate": 0.06, "depth": 8, "seed": 42, "bins": 255, "leaves": 31, "min_leaf": 20}


def test_importance_finds_the_drivers(fitted, split):
    got = {r.feature: r.importance for r in m.feature_importance(fitted, split[1], repeats=3).collect()}
    assert set(got) == {"hotel", "deposit_type", "lead_time", "adults"}
    assert got["lead_time"] > 0.1 > abs(got["adults"]) and got["deposit_type"] > 0.05


def test_permutation_only_moves_values(fitted, split):
    rows = split[1].count()
    scores = m.permutation_scores(fitted, split[1], repeats=2)
    assert scores.count() == rows * (4 * 2 + 1)
    per_copy = scores.groupBy("feature", "repeat").agg(F.sum("label").alias("n")).select("n").distinct()
    assert per_copy.count() == 1


def test_only_trees_of_the_permuted_feature_run(fitted, split):
    """Scores equal those of whole models on permuted rows, with fewer trees run."""
    trees = m.trees_by_feature(fitted)
    texts = [t.toDebugString for t in fitted.stages[-1].trees]
    inputs = [c.removesuffix("__index") for c in fitted.stages[-2].getInputCols()]
    for place, name in enumerate(inputs):
        assert trees[name] == [i for i, text in enumerate(texts) if f"(feature {place} " in text]
    assert sum(map(len, trees.values())) < len(texts) * len(inputs)

    categorical, numeric = m.model_features(fitted)
    names = categorical + numeric
    rows = f.features(split[1], ["is_canceled", "reservation_id"], categorical, numeric)
    order = F.xxhash64("repeat", F.lit(42), "reservation_id")
    whole = fitted.transform(m.permuted(rows, names, ["is_canceled", "reservation_id"], order, 2)).select(
        "feature", "repeat", F.col("is_canceled").cast("int").alias("label"), m._probability().alias("p"))
    ordered = lambda df, p: sorted((r.feature or "", r["repeat"], r.label, round(r[p], 9)) for r in df.collect())
    assert ordered(m.permutation_scores(fitted, split[1], repeats=2), "cancel_probability") == ordered(whole, "p")
    rounded = whole.select("feature", "repeat", "label", F.round("p", 9).alias("cancel_probability"))  # rounding errors are no order
    want = {r.feature: r.importance for r in m.importance(rounded).collect()}
    got = {r.feature: r.importance for r in m.feature_importance(fitted, split[1], repeats=2).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_a_permuted_column_keeps_its_values(spark):
    df = spark.range(7000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    copies = m.permuted(df, ["a", "b"], ["k"], F.xxhash64("repeat", "k"), repeats=2)
    sums = {(r.feature, r["repeat"]): (r.n, r.a, r.b, r.moved) for r in copies.groupBy("feature", "repeat").agg(
        F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"),
        F.count_if(F.col("a") != F.col("k").cast("long")).alias("moved")).collect()}
    assert set(sums) == {(None, 0), ("a", 1), ("a", 2), ("b", 1), ("b", 2)}
    assert {v[:3] for v in sums.values()} == {(7000, 7000 * 6999 // 2, 21000)}  # more rows than any sample had
    assert sums["a", 1][3] > 6900 and sums["b", 1][3] == 0 == sums[None, 0][3]


def test_importance_is_repeatable(fitted, split):
    first, second = (m.feature_importance(fitted, split[1], repeats=2).collect() for _ in range(2))
    assert first == second


def test_ledger_versions_and_champion(spark, folder, fitted, split):
    with pytest.raises(ledger.NoChampion):
        ledger.load_champion(spark, folder, "model")
    for expected in (1, 2):
        version = ledger.register(
            spark, folder, "model", fitted, PARAMS.as_dict(), {"roc_auc": 0.9, "f1": None}, f"run{expected}"
        )
        assert version == expected
    assert ledger.newest_version(ledger.runs(spark, folder)).first().version == 2
    assert ledger.newest_version(ledger.runs(spark, folder), "run1").first().version == 1
    ledger.promote(spark, folder, "model", 2)
    ledger.promote(spark, folder, "model", 1)
    loaded, version = ledger.load_champion(spark, folder, "model")
    assert version == 1
    want = m.score(fitted, split[1], 1).select("reservation_id", "cancel_probability")
    got = m.score(loaded, split[1], version).select("reservation_id", "cancel_probability")
    assert sorted(want.collect()) == sorted(got.collect())
    record = ledger.runs(spark, folder).where("version = 1").first()
    assert record.params["iterations"] == "5" and record.metrics["roc_auc"] == 0.9


def test_what_is_put_in_order_has_no_keys(spark):  # F19
    """The order may look at the keys, but the sorted copies of the rows do without them; pairs stay as they were."""
    rows = spark.createDataFrame([(f"{i:064d}", i % 2, i * 7 % 50) for i in range(200)], "reservation_id string, is_canceled int, x int")
    order = F.md5(F.concat_ws(":", "repeat", "reservation_id"))
    base, other = m._paired(rows, ["x"], ["is_canceled", "reservation_id"], order, 2)
    place = other.select("other.x", "repeat", "row").collect()
    for repeat in (1, 2):
        expected = [r.x for r in rows.orderBy(F.md5(F.concat_ws(":", F.lit(repeat), "reservation_id")), "x").collect()]
        assert [r.x for r in sorted((r for r in place if r.repeat == repeat), key=lambda r: r.row)] == expected
    assert not any("reservation_id" in spark.read.parquet(f).columns for f in other.inputFiles())


def test_rows_are_numbered_where_they_lie(spark):  # F19
    """However large the table, no row is shuffled to get its number once it is in order."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # as for a table that is too large
    try:
        rows = numbered(spark.range(0, 1000, 1, 7).withColumn("x", F.col("id") * 37 % 1000), "row", order=["x"])
        assert [(r.x, r.row) for r in rows.orderBy("row").collect()] == [(i, i + 1) for i in range(1000)]
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(limit, before)
