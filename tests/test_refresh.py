"""The whole job on files derived from the given tables, and the registered queries."""

import pytest
from pyspark.sql import functions as F

from oracle import SMALL, compare, connect

from roomledger.operators import actions as acts
from roomledger.operators import serving as s
from roomledger.operators.model import ModelParams
from roomledger.plans import refresh
from roomledger.plans.oracles import ORACLES
from roomledger.plans.queries import QUERIES
from roomledger.plans.warehouse import Warehouse, warehouse
from roomledger.sources import ledger, star, tables
from roomledger.sources.landing import write_csv
from roomledger.streaming import actions as log
from roomledger.streaming.scoring import score_stream, snapshot_stream

PARAMS = ModelParams(iterations=2, depth=3)
LEARNING = ModelParams(iterations=40, learning_rate=0.3)  # enough to learn the few training rows


@pytest.fixture(scope="module")
def deployed(spark):
    from roomledger.session import work_dir

    root = work_dir(spark, "test-refresh")
    write_csv(star.bookings(spark, SMALL), f"{root}/csv")
    layout = refresh.Layout(f"{root}/tables")
    served = refresh.run(spark, f"{root}/csv", layout, PARAMS)
    return layout, served


def read(spark, deployed, name):
    return spark.read.parquet(deployed[0].path(name))


def snapshot(spark, deployed, name):
    return tables.read_snapshot(spark, deployed[0].path(name))


def test_a_failure_in_the_middle_leaves_every_layer(spark, deployed, monkeypatch):
    layout = deployed[0]
    names = ("gold", "risk", "serving")
    before = {n: sorted(snapshot(spark, deployed, n).collect(), key=str) for n in names}
    breaks = F.udf(lambda v: 1 / 0, "double")
    real = refresh.score
    monkeypatch.setattr(refresh, "score", lambda *a: real(*a).withColumn("cancel_probability", breaks("cancel_probability")))
    with pytest.raises(Exception, match="division by zero"):
        refresh.score_all(read(spark, deployed, "silver"), layout.path("model"), layout.path("risk"))
    assert {n: sorted(snapshot(spark, deployed, n).collect(), key=str) for n in names} == before


def test_a_hotel_and_date_filter_skips_files(spark):
    """Of the clustered layer's files, only some can hold a hotel's month; the others' bounds exclude it."""
    import glob

    import pyarrow.parquet as pq

    silver = warehouse(spark, "/root/testdata/sf0.01").silver
    files = glob.glob(f"{silver.inputFiles()[0].removeprefix('file://').rsplit('/', 1)[0]}/*.parquet")
    kept = 0
    for name in files:
        meta = pq.ParquetFile(name).metadata
        bounds = {c: [] for c in ("hotel", "arrival_date")}
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                if column.path_in_schema in bounds:
                    bounds[column.path_in_schema].append((column.statistics.min, column.statistics.max))
        low, high = (f(str(b[k]) for b in bounds["hotel"]) for k, f in ((0, min), (1, max)))
        first, last = (f(str(b[k]) for b in bounds["arrival_date"]) for k, f in ((0, min), (1, max)))
        kept += low <= "City Hotel" <= high and first <= "1997-03-31" and last >= "1997-03-01"
    assert len(files) > 2 and 0 < kept < len(files)


def test_row_counts_across_layers(spark, deployed):
    source = star.bookings(spark, SMALL)
    silver = read(spark, deployed, "silver")
    assert read(spark, deployed, "bronze").count() == source.count()
    assert silver.count() == source.where("adr >= 0").count()
    assert snapshot(spark, deployed, "risk").count() == silver.count()
    assert deployed[1].count() == silver.select("reservation_id").distinct().count()


def test_scores_are_probabilities(spark, deployed):
    risk = snapshot(spark, deployed, "risk")
    assert risk.where(~F.col("cancel_probability").between(0, 1)).count() == 0
    assert [r[0] for r in risk.select("model_version").distinct().collect()] == [1]


def test_kpis_equal_a_direct_count(deployed):
    served = deployed[1]
    row = s.kpis(served).first()
    assert row.total == served.count() == row.high_risk + row.medium_risk + row.low_risk
    assert row.high_risk == served.where("cancel_probability >= 0.7").count()
    assert row.avg_cancel_probability == pytest.approx(
        served.agg(F.avg("cancel_probability")).first()[0], abs=1e-4
    )


def test_run_record(spark, deployed):
    layout = deployed[0]
    record = ledger.runs(spark, layout.path("model")).first()
    assert record.params["n_categorical"] == "7" and record.params["n_numeric"] == "17"
    silver = read(spark, deployed, "silver")
    assert int(record.params["n_train"]) + int(record.params["n_test"]) == silver.count()
    assert set(record.metrics) >= {"roc_auc", "average_precision", "precision", "recall", "f1"}


def test_written_action_reads_back_first(spark, deployed, folder):
    page = s.list_page(deployed[1], limit=1)
    log.record_actions(acts.actions_for_page(page, "note", "first", "a"), folder)
    log.record_actions(acts.actions_for_page(page, "released", "second", "a"), folder)
    key = page.first().reservation_id
    rows = acts.reservation_detail(deployed[1], log.read_actions(spark, folder), key).collect()
    assert [r.action_type for r in rows] == ["released", "note"]


def test_failed_training_leaves_the_served_data(spark, deployed):
    layout, _ = deployed
    before = tables.current_snapshot(spark, layout.path("serving"))
    with pytest.raises(Exception):
        refresh.refresh_model(spark, layout, ModelParams(iterations=-1))
    assert tables.current_snapshot(spark, layout.path("serving")) == before
    assert ledger.runs(spark, layout.path("model")).count() == 1


def test_scoring_and_snapshot_streams(spark, deployed, folder):
    layout = deployed[0]
    model, version = ledger.load_champion(spark, layout.path("model"), refresh.MODEL_NAME)
    silver = read(spark, deployed, "silver")
    stream = spark.readStream.schema(silver.schema).parquet(layout.path("silver"))
    score_stream(model, version, stream, f"{folder}/risk", f"{folder}/cp1").awaitTermination()
    risk = spark.read.parquet(f"{folder}/risk")
    assert risk.count() == silver.count()
    same = snapshot(spark, deployed, "risk").groupBy("risk_band").count().collect()
    assert sorted(risk.groupBy("risk_band").count().collect()) == sorted(same)
    for published in (1, 1):  # nothing new the second time
        snapshot_stream(
            spark, f"{folder}/risk", layout.path("silver"), f"{folder}/snap", f"{folder}/cp2"
        ).awaitTermination()
        assert tables.current_snapshot(spark, f"{folder}/snap") == published
    assert tables.read_snapshot(spark, f"{folder}/snap").count() == deployed[1].count()


def test_only_model_queries_have_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"gbt_importance"}
    assert set(ORACLES) <= set(QUERIES)


@pytest.fixture(scope="module")
def sql():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sql, name, monkeypatch):
    monkeypatch.setattr(Warehouse, "params", LEARNING)  # a quick model
    assert compare(QUERIES[name](spark, SMALL), sql, ORACLES[name]) is None


def test_full_load_of_a_reservation_with_many_actions(spark):
    """A reservation that holds a third of all actions is joined like any other."""
    actions = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("reservation_id"),
        F.lit("note").alias("action_type"), F.lit(None).cast("string").alias("note"),
        F.lit("u").alias("acted_by"), F.timestamp_seconds("id").alias("acted_at"),
    )
    serving = actions.select("reservation_id").distinct().withColumn("hotel", F.lit("City Hotel"))
    detail = acts.reservation_detail(serving, actions)
    assert detail.count() == 3000 and detail.where("reservation_id = 'hot'").count() == 1000
    newest = acts.latest_action(actions).where("reservation_id = 'hot'").first()
    assert newest.id == 2997
