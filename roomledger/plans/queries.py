"""The registered queries: one per operator, each over the whole given tables.

The first written layer, bronze, is derived from the star-schema tables. A query that builds a layer
builds it anew from the layer before; one that asks a question reads the layer it is about. The
flagship, gold_hotel_month, goes from the star-schema tables to the answer in one plan.
"""

from collections.abc import Callable
from datetime import date

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger.functions import sqlaccess
from roomledger.functions.keys import packed_key, unpacked_key
from roomledger.functions.parsing import as_number
from roomledger.functions.display import display_actions, display_reservations, to_json_rows
from roomledger.operators import (
    actions as acts, features as feats, gold as golds, governance, metrics, model, profile, quality,
    risk as risks, serving as serves,
)
from roomledger.operators.sketches import SketchStore
from roomledger.operators.silver import silver_bookings, typed_bookings
from roomledger.schemas import (
    ANALYST, CITY_HOTEL, CITY_MANAGER, CATEGORICAL_FEATURES, ENGINEER, LABEL, MASKED_COLUMNS,
    NUMERIC_FEATURES, RESORT_MANAGER, SOURCE_SCHEMA,
)
from roomledger.plans.warehouse import warehouse
from roomledger.session import work_dir
from roomledger.sources import ledger, star, tables
from roomledger.sources.csvfolder import land_folder
from roomledger.sources.landing import csv_batch, csv_files, infer_schema, write_csv
from roomledger.sources.skipping import SkippingTable
from roomledger.streaming import actions as action_log, kept, scoring
from roomledger.streaming.medallion import build_silver, count_rules, land_csv, rule_totals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TREND_YEAR = 1996
ACTIVE_USER = "8"
PERSONA_GROUPS = {
    "nobody": [],
    "engineer": [ENGINEER],
    "analyst": [ANALYST],
    "city_manager": [CITY_MANAGER],
    "resort_manager": [RESORT_MANAGER],
    "both_managers": [CITY_MANAGER, RESORT_MANAGER],
}
SILVER_COLUMNS = SOURCE_SCHEMA.names + [
    "reservation_id", "arrival_year", "arrival_day", "arrival_date", "stay_nights",
    "est_lost_revenue",
]


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later arrivals with their label and stand-in score."""
    return warehouse(spark, sf_dir).holdout


# ---- landing and cleaning ---------------------------------------------------


def _landed(spark: SparkSession, sf_dir: str) -> str:
    """Bronze table streamed from CSV files that hold the derived bookings."""
    root = work_dir(spark, "landing")
    csv = warehouse(spark, sf_dir).csv
    land_csv(spark, csv, f"{root}/bronze", f"{root}/checkpoints/bronze").awaitTermination()
    return root


@query
def bronze_landing(spark, sf_dir):  # S1, S2, S4, S5, R1
    root = _landed(spark, sf_dir)
    return tables.read_table(spark, f"{root}/bronze").select(*SOURCE_SCHEMA.names)


@query
def bronze_folder_stream(spark, sf_dir):  # S1, S2, S4, S5, R1
    """The CSV files landed through the folder source in byte ranges, twice; the second run finds nothing new."""
    root = work_dir(spark, "folder-stream")
    for _ in range(2):
        land_folder(spark, warehouse(spark, sf_dir).plain_csv, f"{root}/bronze", f"{root}/cp", range_bytes=8 << 20).awaitTermination()
    return tables.read_table(spark, f"{root}/bronze").select(*SOURCE_SCHEMA.names)


@query
def landed_by_name(spark, sf_dir):  # S1, S2, S3, R1
    """Files with the columns in another order, without one, and with one too many, in one landing.

    The schema is frozen from a first look at complete files, with the values' own types.
    """
    root, w = work_dir(spark, "by-name"), warehouse(spark, sf_dir)
    names = SOURCE_SCHEMA.names
    files = w.bronze_landed.withColumn("loyalty", F.concat(F.lit("tier "), F.col("lead_time") % 4))
    for part, columns in enumerate((names[::-1], [n for n in names if n != "meal"], [*names[5:], "loyalty", *names[:5]])):
        csv_files(files.where(F.col("lead_time") % 3 == part).select(*columns), "gzip").csv(f"{root}/csv/{part}")
    seen = infer_schema(spark, w.csv)
    schema = T.StructType([T.StructField(f.name, seen[f.name].dataType if f.name == "lead_time" else f.dataType) for f in SOURCE_SCHEMA.fields])
    land_csv(spark, f"{root}/csv/*", f"{root}/bronze", f"{root}/checkpoints/bronze", schema).awaitTermination()
    return tables.read_table(spark, f"{root}/bronze").select(
        *names, F.get_json_object("_rescued_data", "$.loyalty").alias("loyalty")
    )


@query
def landed_lineage(spark, sf_dir):  # S4, S5, R1
    """Landing run twice over the same files, then once more with new ones."""
    root, bronze = work_dir(spark, "lineage"), warehouse(spark, sf_dir).bronze_landed
    for name, chosen in (("first", "is_canceled = 0"), (None, None), ("second", "is_canceled = 1")):
        if name:
            write_csv(bronze.where(chosen), f"{root}/csv/{name}")
        land_csv(spark, f"{root}/csv/*", f"{root}/bronze", f"{root}/checkpoints/bronze").awaitTermination()
    folder = F.element_at(F.split("_source_file", "/"), -2)
    return tables.read_table(spark, f"{root}/bronze").groupBy("hotel", folder.alias("folder")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("_source_file").rlike("/part-[^/]*[.]csv$")).alias("with_file"),
        F.count("_ingested_at").alias("with_time"),
    )


@query
def streamed_gold(spark, sf_dir):  # S6, S7, R1, R2, R3, A1
    root = _landed(spark, sf_dir)
    build_silver(
        spark, f"{root}/bronze", f"{root}/silver", f"{root}/checkpoints/silver"
    ).awaitTermination()
    return golds.gold_hotel_month(tables.read_table(spark, f"{root}/silver"))


def _in_batches(spark, rows, path, keep):
    """Three parts of the rows, each kept as one batch once it has been written. A part is chosen by hash, not shuffled."""
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(3))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1 << 30).parquet
    for number in range(3):
        tables.stored(rows.where(part == number)).mode("append").parquet(path)
        keep(stream(path)).awaitTermination()


@query
def kept_gold(spark, sf_dir):  # A1, R2
    """Gold kept up over three batches of silver, folded into a snapshot on the way."""
    root = work_dir(spark, "kept-gold")
    _in_batches(
        spark, warehouse(spark, sf_dir).silver, f"{root}/silver", lambda rows: kept.keep_gold(rows, f"{root}/gold", f"{root}/cp"))
    kept.fold(spark, f"{root}/gold", kept.GOLD_KEYS)
    return kept.read_kept(spark, f"{root}/gold", kept.GOLD_KEYS)


@query
def kept_latest_action(spark, sf_dir):  # W2
    root = work_dir(spark, "kept-actions")
    _in_batches(
        spark, acts.split_actions(star.actions(spark, sf_dir))[0], f"{root}/actions",
        lambda actions: kept.keep_latest_actions(actions, f"{root}/latest", f"{root}/cp"))
    return kept.read_kept(spark, f"{root}/latest", ["reservation_id"])


@query
def kept_details(spark, sf_dir):  # D1, R3
    """One booking detail per reservation, kept up over three batches."""
    root, order = work_dir(spark, "kept-details"), ["arrival_date", "lead_time", "adr"]
    _in_batches(
        spark, warehouse(spark, sf_dir).silver_landed.select("reservation_id", *order), f"{root}/rows",
        lambda rows: kept.keep_one_per_key(rows, "reservation_id", order, f"{root}/one", f"{root}/cp"))
    return kept.read_kept(spark, f"{root}/one", ["reservation_id"])


@query
def streamed_rule_counts(spark, sf_dir):  # F5
    root = _landed(spark, sf_dir)
    count_rules(spark, f"{root}/bronze", f"{root}/rules", f"{root}/checkpoints/rules").awaitTermination()
    return rule_totals(spark, f"{root}/rules")


@query
def csv_rescue(spark, sf_dir):  # S3, F10
    """Landing with the guest counts declared as numbers: their NA texts are rescued, no row is lost."""
    counts = ("adults", "children", "babies")
    strict = T.StructType([
        T.StructField(f.name, T.IntegerType() if f.name in counts else f.dataType)
        for f in SOURCE_SCHEMA.fields
    ])
    rescued = F.col("_rescued_data")
    return csv_batch(spark, warehouse(spark, sf_dir).csv, strict).select(
        "hotel",
        F.get_json_object(rescued, "$.adults").alias("rescued_adults"),
        F.get_json_object(rescued, "$.children").alias("rescued_children"),
        F.get_json_object(rescued, "$.babies").alias("rescued_babies"),
        rescued.isNotNull().alias("is_rescued"),
    ).groupBy(
        "hotel", "rescued_adults", "rescued_children", "rescued_babies", "is_rescued"
    ).agg(F.count(F.lit(1)).alias("row_count"))


@query
def silver_table(spark, sf_dir):  # P1-P8, F1, F2
    return silver_bookings(warehouse(spark, sf_dir).bronze).select(*SILVER_COLUMNS)


@query
def clustered_silver(spark, sf_dir):  # S8, S9
    return warehouse(spark, sf_dir).silver.select(*SILVER_COLUMNS)


@query
def skipped_bookings(spark, sf_dir):  # S9
    """A hotel's month, from those files of a table along a Hilbert curve whose statistics allow it."""
    table = SkippingTable(spark, work_dir(spark, "skipping"), ["hotel", "arrival_date"], ["reservation_id"])
    table.add(warehouse(spark, sf_dir).silver_landed, written=True)
    month = (date(TREND_YEAR, 3, 1), date(TREND_YEAR, 3, 31))
    return table.read({"arrival_date": month}, {"hotel": CITY_HOTEL}).select(*SILVER_COLUMNS)


@query
def repeated_bookings_found(spark, sf_dir):  # S9, D2
    """All rows with the most repeated key, from the files whose Bloom filters allow it."""
    silver = warehouse(spark, sf_dir).silver_landed
    table = SkippingTable(spark, work_dir(spark, "skipping"), ["hotel", "arrival_date"], ["reservation_id"])
    table.add(silver, written=True)
    copies = silver.groupBy(packed_key(silver, "reservation_id").alias("_key")).count()
    named = copies.select("count", unpacked_key(silver, "reservation_id", "_key").alias("reservation_id"))
    key = named.orderBy(F.desc("count"), "reservation_id").first()["reservation_id"]
    return table.read(equals={"reservation_id": key}).select(*SILVER_COLUMNS)


@query
def keys_with_null_token(spark, sf_dir):  # P7
    rows = typed_bookings(warehouse(spark, sf_dir).bronze.select(*SOURCE_SCHEMA.names), null_token="<null>")
    return rows.groupBy("hotel").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct(packed_key(rows, "reservation_id")).alias("distinct_keys"),
        F.min("reservation_id").alias("lowest_key"),
    )


@query
def dq_metrics(spark, sf_dir):  # F1-F5
    return quality.rule_metrics(typed_bookings(warehouse(spark, sf_dir).bronze), quality.BOOKING_RULES)


@query
def rescued_rows(spark, sf_dir):  # F10
    return profile.rescued_rows(warehouse(spark, sf_dir).bronze)


# ---- gold and its questions -------------------------------------------------


@query
def gold_hotel_month(spark, sf_dir):  # A1
    return golds.gold_hotel_month(silver_bookings(star.bookings(spark, sf_dir)))


@query
def hotel_headline(spark, sf_dir):  # A2
    return golds.hotel_headline(warehouse(spark, sf_dir).gold)


@query
def hotel_compare(spark, sf_dir):  # A8, F9
    return golds.hotel_compare(warehouse(spark, sf_dir).gold)


@query
def portfolio_rollup(spark, sf_dir):  # A10
    return golds.portfolio_rollup(warehouse(spark, sf_dir).gold)


@query
def monthly_trend(spark, sf_dir):  # A12
    return golds.monthly_trend(warehouse(spark, sf_dir).gold, CITY_HOTEL, TREND_YEAR)


@query
def monthly_cancel_rates(spark, sf_dir):  # T4
    return golds.monthly_cancel_rates(warehouse(spark, sf_dir).gold, CITY_HOTEL)


@query
def recovery_sensitivity(spark, sf_dir):  # A13
    return golds.recovery_sensitivity(warehouse(spark, sf_dir).gold)


@query
def peak_month(spark, sf_dir):  # W1
    return golds.peak_months(warehouse(spark, sf_dir).gold)


@query
def top_loss_months(spark, sf_dir):  # T3
    return golds.top_loss_months(warehouse(spark, sf_dir).gold)


@query
def gold_preview(spark, sf_dir):  # T6
    return golds.gold_preview(warehouse(spark, sf_dir).gold)


@query
def silver_preview(spark, sf_dir):  # T5
    return golds.silver_preview(warehouse(spark, sf_dir).silver)


# ---- counts, keys, duplicates ----------------------------------------------


@query
def layer_counts(spark, sf_dir):  # A15, V1, V2, V3, V4
    w = warehouse(spark, sf_dir)
    return profile.layer_counts(
        bronze=w.bronze_landed, silver=w.silver_landed, gold=w.gold, risk=w.risk, serving=w.serving
    )


@query
def bronze_vs_silver(spark, sf_dir):  # J3, V2
    return profile.compare_counts(warehouse(spark, sf_dir).bronze, warehouse(spark, sf_dir).silver)


@query
def key_uniqueness(spark, sf_dir):  # A14
    return profile.key_uniqueness(warehouse(spark, sf_dir).silver, "reservation_id")


@query
def serving_key_uniqueness(spark, sf_dir):  # A14, V4
    return profile.key_uniqueness(warehouse(spark, sf_dir).serving, "reservation_id")


def _sketched(spark, sf_dir):
    """The store of sketches of silver and serving, and both layers."""
    w, store = warehouse(spark, sf_dir), SketchStore(spark, work_dir(spark, "sketches"))
    store.add(w.silver_landed, "silver", ["reservation_id"], ["adr", "arrival_date"])
    store.add(w.serving, "serving", ["reservation_id"])
    return store, w


@query
def sketched_keys(spark, sf_dir):  # A14, V4
    """Distinct keys per layer from stored sketches, beside the exact count; close is within 4 %."""
    store, w = _sketched(spark, sf_dir)
    rows = [
        store.distinct(name, "reservation_id")
        .withColumn("distinct_keys", profile.key_uniqueness(df, "reservation_id").select("distinct_keys").scalar())
        .select(F.lit(name).alias("layer"), "row_count", "null_count", "distinct_keys",
                (F.abs(F.col("distinct_estimate") - F.col("distinct_keys")) <= 0.04 * F.col("distinct_keys")).alias("is_close"))
        for name, df in (("silver", w.silver_landed), ("serving", w.serving))
    ]
    return rows[0].unionByName(rows[1])


@query
def sketched_overlap(spark, sf_dir):  # D2, V4
    """Keys in both layers and in one only, by theta sketches; close is within 4 % of all keys."""
    store, w = _sketched(spark, sf_dir)
    flags = [df.groupBy(packed_key(df, "reservation_id").alias("reservation_id")).agg(F.lit(i).alias("layer")) for i, df in enumerate((w.silver_landed, w.serving))]
    held = flags[0].unionByName(flags[1]).groupBy("reservation_id").agg(F.collect_set("layer").alias("layers"))
    estimate = store.overlap("silver", "serving", "reservation_id").first()  # three numbers
    exact = held.agg(
        F.count_if(F.size("layers") == 2).alias("both_keys"), F.count_if(F.col("layers") == F.array(F.lit(0))).alias("silver_only"),
        F.count_if(F.col("layers") == F.array(F.lit(1))).alias("serving_only"), F.count(F.lit(1)).alias("all_keys"))
    close = lambda name, exact: (F.abs(F.lit(estimate[name]) - F.col(exact)) <= 0.04 * F.col("all_keys")).alias(f"{exact}_close")
    return exact.select(
        "both_keys", "silver_only", "serving_only", close("both", "both_keys"), close("left_only", "silver_only"),
        close("right_only", "serving_only"))


@query
def sketched_quantiles(spark, sf_dir):  # M1, A3
    """Quantiles of price and arrival from stored sketches; close is a rank within 1 % of the rows."""
    store, w = _sketched(spark, sf_dir)
    out = None
    for column in ("adr", "arrival_date"):
        number = as_number(F.col(column), w.silver_landed.schema[column].dataType)
        found = store.quantiles("silver", column, [0.1, 0.5, 0.8, 0.99]).collect()  # four numbers
        held = F.count(number)
        near = lambda r: (F.count_if(number < r.value) <= (r.share + 0.01) * held) & (F.count_if(number <= r.value) >= (r.share - 0.01) * held)
        each = F.array(*[F.struct(F.lit(r.share).alias("share"), held.alias("row_count"), near(r).alias("is_close")) for r in found])
        one = w.silver_landed.agg(each.alias("each")).select(F.lit(column).alias("measure"), F.inline("each"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def duplicate_profile(spark, sf_dir):  # D2
    return profile.duplicate_profile(warehouse(spark, sf_dir).silver, "reservation_id")


@query
def duplicate_keys(spark, sf_dir):  # D2
    return profile.duplicate_keys(warehouse(spark, sf_dir).silver, "reservation_id")


# ---- risk ------------------------------------------------------------------


@query
def reservation_risk(spark, sf_dir):  # P9, P10
    return star.formula_risk(warehouse(spark, sf_dir).silver)


@query
def score_check(spark, sf_dir):  # V3
    return risks.score_check(warehouse(spark, sf_dir).risk)


@query
def risk_band_summary(spark, sf_dir):  # A3
    return risks.risk_band_summary(warehouse(spark, sf_dir).risk)


@query
def risk_band_distribution(spark, sf_dir):  # A6
    return risks.risk_band_distribution(warehouse(spark, sf_dir).risk)


@query
def high_risk_by_hotel(spark, sf_dir):  # A7, F9
    return risks.high_risk_by_hotel(warehouse(spark, sf_dir).risk)


@query
def score_model_version(spark, sf_dir):  # A9
    return risks.score_model_version(warehouse(spark, sf_dir).risk)


@query
def risk_triage_share(spark, sf_dir):  # A11
    return risks.risk_triage(warehouse(spark, sf_dir).risk)


@query
def hotel_scorecard(spark, sf_dir):  # J4
    return risks.hotel_scorecard(warehouse(spark, sf_dir).gold, warehouse(spark, sf_dir).risk)


@query
def newest_version_by_hotel(spark, sf_dir):  # W3
    versions = warehouse(spark, sf_dir).risk.groupBy(
        F.col("hotel").alias("model"), F.col("model_version").alias("version")
    ).agg(F.count(F.lit(1)).alias("scored"))
    return ledger.newest_version(versions)


# ---- serving ---------------------------------------------------------------


@query
def reservation_serving(spark, sf_dir):  # J1, D1, P13
    w = warehouse(spark, sf_dir)
    return serves.build_serving(w.risk, w.silver_landed)


@query
def published_snapshot(spark, sf_dir):  # S8, S10, S11, R5
    root, w = work_dir(spark, "snapshots"), warehouse(spark, sf_dir)
    tables.publish(serves.build_serving(w.risk, w.silver_landed), root, "reservation_id", ["hotel", "arrival_date"])
    return tables.read_snapshot(spark, root)


@query
def snapshot_refresh(spark, sf_dir):  # R5, M13
    """The snapshot after scores arrived in two batches."""
    root, w = work_dir(spark, "refresh"), warehouse(spark, sf_dir)
    silver = w.path("silver_landed")
    for number in (0, 1):
        part = w.risk.where(F.pmod(F.crc32("reservation_id"), F.lit(2)) == number)
        part.write.mode("append").parquet(f"{root}/risk")
        scoring.snapshot_stream(spark, f"{root}/risk", silver, f"{root}/served", f"{root}/checkpoint").awaitTermination()
    return tables.read_snapshot(spark, f"{root}/served")


@query
def kpi_row(spark, sf_dir):  # A4, V5, V8
    return serves.kpis(warehouse(spark, sf_dir).serving).withColumn(
        "avg_cancel_probability", F.round("avg_cancel_probability", 4)
    )


@query
def risk_band_mix(spark, sf_dir):  # A5
    return serves.band_mix(warehouse(spark, sf_dir).serving)


@query
def at_risk_page(spark, sf_dir):  # T1, T2
    return serves.list_page(warehouse(spark, sf_dir).serving, limit="junk", offset=40)


@query
def at_risk_next_page(spark, sf_dir):  # T1
    return serves.next_page(warehouse(spark, sf_dir).serving, 0.8, "", limit=9999)


@query
def filtered_page(spark, sf_dir):  # F6, T1, T2
    wanted = serves.reservation_filter(
        hotel=CITY_HOTEL, risk_band="high", market_segment="MACHINERY", min_lead_time=30
    )
    return serves.list_page(warehouse(spark, sf_dir).serving, wanted, limit=20)


@query
def filtered_count(spark, sf_dir):  # F6, A17
    wanted = serves.reservation_filter(
        hotel=CITY_HOTEL, risk_band="high", market_segment="", min_lead_time=0
    )
    return serves.count_page(warehouse(spark, sf_dir).serving, wanted)


@query
def reservation_lookup(spark, sf_dir):  # F8
    w = warehouse(spark, sf_dir)
    last_key = w.silver_landed.agg(F.max("reservation_id")).scalar()
    return serves.lookup(w.serving, last_key)


@query
def serving_json(spark, sf_dir):  # S14
    return to_json_rows(warehouse(spark, sf_dir).serving)


@query
def serving_display(spark, sf_dir):  # P14
    return display_reservations(warehouse(spark, sf_dir).serving)


# ---- actions ---------------------------------------------------------------


@query
def action_stream(spark, sf_dir):  # S12, R4, F7
    root = work_dir(spark, "action-log")
    schema = star.table(spark, sf_dir, "events").schema
    events = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    action_log.action_stream(
        star.actions_from_events(events), f"{root}/log", f"{root}/checkpoint"
    ).awaitTermination()
    return action_log.read_actions(spark, f"{root}/log")


@query
def streamed_action_ids(spark, sf_dir):  # S12, R4
    """Events without ids become actions with distinct ones, also when the last batch is run again."""
    root, given = work_dir(spark, "action-ids"), star.actions(spark, sf_dir)
    nameless = given.withColumn("id", F.lit(None).cast("long"))
    for _ in range(2):
        action_log.record_actions(nameless, f"{root}/log", "stream-000000000000")
    action_log.record_actions(nameless.where("action_type = 'note'"), f"{root}/log", "stream-000000000001")
    action_log.compact_actions(spark, f"{root}/log")
    log = action_log.read_actions(spark, f"{root}/log")
    return log.groupBy("action_type").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("id").alias("with_id"), F.count_distinct("id").alias("distinct_ids"),
    )


@query
def action_rejects(spark, sf_dir):  # F7, S12
    return acts.action_rejects(star.booking_actions(spark, sf_dir, warehouse(spark, sf_dir).silver))


@query
def latest_action(spark, sf_dir):  # W2
    return acts.latest_action(acts.split_actions(star.actions(spark, sf_dir))[0])


@query
def prior_actions(spark, sf_dir):  # T7
    valid = acts.split_actions(star.actions(spark, sf_dir))[0]
    return acts.prior_actions(valid, ACTIVE_USER)


@query
def actions_display(spark, sf_dir):  # P14
    return display_actions(acts.split_actions(star.actions(spark, sf_dir))[0])


@query
def reservation_detail(spark, sf_dir):  # J2, T7
    w = warehouse(spark, sf_dir)
    valid = acts.split_actions(star.booking_actions(spark, sf_dir, w.silver_landed))[0]
    return acts.reservation_detail(w.serving, valid)


@query
def actions_from_page(spark, sf_dir):  # S13, S12, V7
    """Actions written for the top high-risk page, read back from the log."""
    page = serves.list_page(
        warehouse(spark, sf_dir).serving, serves.reservation_filter(risk_band="high"), limit=25
    )
    when = F.lit(star.SCORED_AT).cast("timestamp")
    drafts = acts.actions_for_page(page, "reconfirmed", "called the guest", "desk", when)
    log_dir = work_dir(spark, "page-actions")
    action_log.record_actions(drafts, log_dir)
    return action_log.read_actions(spark, log_dir).select(
        "reservation_id", "action_type", "note", "acted_by", "acted_at"
    )


# ---- features, split, metrics ----------------------------------------------


@query
def model_features(spark, sf_dir):  # P11, P12
    return feats.features(
        warehouse(spark, sf_dir).silver, ["reservation_id"], CATEGORICAL_FEATURES, NUMERIC_FEATURES
    )


@query
def split_cutoff(spark, sf_dir):  # M1
    return feats.split_cutoff(warehouse(spark, sf_dir).silver)


@query
def split_balance(spark, sf_dir):  # M1, A16
    return feats.split_balance(feats.temporal_split(warehouse(spark, sf_dir).silver))


@query
def ranking_metrics(spark, sf_dir):  # M5, M6
    return metrics.ranking_metrics(holdout(spark, sf_dir), LABEL, "cancel_probability")


@query
def roc_pr_points(spark, sf_dir):  # M9
    return metrics.curve_points(holdout(spark, sf_dir), LABEL, "cancel_probability")


@query
def threshold_metrics(spark, sf_dir):  # M7
    return metrics.threshold_metrics(holdout(spark, sf_dir), LABEL, "cancel_probability")


@query
def confusion_matrix(spark, sf_dir):  # M8
    return metrics.confusion_matrix(holdout(spark, sf_dir), LABEL, "cancel_probability")


@query
def class_report(spark, sf_dir):  # M12
    return metrics.class_report(holdout(spark, sf_dir), LABEL, "cancel_probability")


# ---- the model itself: one fit with the published settings serves all -------


@query
def onehot_features(spark, sf_dir):  # M2
    """Per category the place of its one, -1 where all are zero."""
    w = warehouse(spark, sf_dir)
    rows = feats.features(w.silver, ["reservation_id"], CATEGORICAL_FEATURES, [])
    encoded = w.encoder.transform(rows)
    place = lambda c: F.array_position(vector_to_array(F.col(f"{c}__onehot")), F.lit(1.0)).cast("int") - 1
    return encoded.select("reservation_id", *[place(c).alias(c) for c in CATEGORICAL_FEATURES])


@query
def gbt_scores(spark, sf_dir):  # M3, M4, P9, P10, U3
    """Every reservation with its score checked: within 0 and 1, and of the band it carries."""
    w = warehouse(spark, sf_dir)
    p = F.col("cancel_probability")
    band = F.when(p >= 0.7, "high").when(p >= 0.4, "medium").otherwise("low")
    return model.score(w.model, w.silver, 1, F.lit(star.SCORED_AT).cast("timestamp")).select(
        "reservation_id", "hotel", "model_version", "scored_at",
        F.coalesce(p.between(0, 1), F.lit(False)).alias("in_range"), (F.col("risk_band") == band).alias("band_agrees"),
    )


@query
def gbt_labels(spark, sf_dir):  # M13
    """Expected outcomes agree with the probabilities they come from."""
    w = warehouse(spark, sf_dir)
    agrees = (F.col("prediction") == 1) == (F.col("cancel_probability") > 0.5)
    return model.predict(w.model, w.silver, ["reservation_id"]).select("reservation_id", agrees.alias("agrees"))


LEARNED_AUC = 0.7  # what only a fitted model reaches on the rows it learned from


@query
def gbt_holdout_metrics(spark, sf_dir):  # M3-M6
    """Counts of the holdout, and whether the model has learned its own training rows.

    The outcome of the given tables is drawn regardless of the features, so nothing predicts the holdout;
    a constant or an unfitted model has an AUC of 0.5 on both.
    """
    w = warehouse(spark, sf_dir)
    scored = model.predict(w.model, w.marked.where(f"{LABEL} IS NOT NULL"), ["split", LABEL])
    measured = metrics.ranking_from_steps(metrics.score_steps(scored, LABEL, "cancel_probability", keys=("split",)), "split")
    of = lambda split, c: F.max(F.when(F.col("split") == split, F.col(c)))
    return measured.agg(
        of("test", "positives").alias("positives"), of("test", "negatives").alias("negatives"),
        of("test", "roc_auc").between(0, 1).alias("auc_in_range"), (of("train", "roc_auc") > LEARNED_AUC).alias("learned"),
    )


@query
def gbt_importance(spark, sf_dir):  # M10, T8
    """On the model itself; trees differ between engines, so this one has no SQL."""
    w = warehouse(spark, sf_dir)
    return model.feature_importance(w.model, w.marked.where("split = 'test'"))


@query
def feature_importance(spark, sf_dir):  # M10, T8
    """On the stand-in score and a fixed order, so that SQL can repeat every permutation."""
    names = ["stay_nights", "arrival_date", "adr"]
    rows = warehouse(spark, sf_dir).marked.where(f"split = 'test' AND {LABEL} IS NOT NULL")
    order = F.unhex(F.md5(F.concat_ws(":", "repeat", "reservation_id")))
    copies = model.permuted(rows, names, [LABEL, "reservation_id"], order, repeats=2)
    scored = copies.select("feature", "repeat", F.col(LABEL).cast("int").alias("label"), star.formula_score().alias("cancel_probability"))
    return model.importance(scored).withColumn("importance", F.round("importance", 6))


@query
def training_record(spark, sf_dir):  # M11, M15, W3
    """The model registered twice, the first version promoted, and the record read back through the champion."""
    root, w = work_dir(spark, "ledger"), warehouse(spark, sf_dir)
    sizes = {r.split: r.row_count for r in feats.split_balance(w.marked).collect()}
    record = {"n_train": sizes.get("train", 0), "n_test": sizes.get("test", 0)}
    for _ in range(2):
        ledger.register(spark, root, "cancel", w.model, record, {"rows": float(sum(sizes.values()))})
    ledger.promote(spark, root, "cancel", 2)
    ledger.promote(spark, root, "cancel", 1)
    promoted = ledger.champion(ledger.aliases(spark, root))
    newest = ledger.newest_version(ledger.runs(spark, root)).select("model", F.col("version").alias("newest"))
    return ledger.runs(spark, root).join(promoted, ["model", "version"]).join(newest, "model").select(
        "model", "version", "newest", F.col("params.n_train").cast("long").alias("n_train"),
        F.col("params.n_test").cast("long").alias("n_test"), F.col("metrics.rows").cast("long").alias("row_count"),
    )


# ---- governance ------------------------------------------------------------

VIEW_COLUMNS = ["reservation_id", "hotel", "arrival_date", "adr", *MASKED_COLUMNS]


@query
def persona_city_view(spark, sf_dir):  # G1, G2, G3, U1, U2
    return governance.persona_view(warehouse(spark, sf_dir).silver, [CITY_MANAGER]).select(*VIEW_COLUMNS)


@query
def persona_analyst_view(spark, sf_dir):  # G1, G2, G3
    return governance.persona_view(warehouse(spark, sf_dir).silver, [ANALYST]).select(*VIEW_COLUMNS)


@query
def persona_engineer_view(spark, sf_dir):  # G1, G2, G3
    return governance.persona_view(warehouse(spark, sf_dir).silver, [ENGINEER]).select(*VIEW_COLUMNS)


@query
def persona_visibility(spark, sf_dir):  # G9
    return governance.visibility(warehouse(spark, sf_dir).silver, PERSONA_GROUPS)


def _asked(spark, sf_dir, groups, text):
    """SQL text asked of the guarded silver table by a member of the groups."""
    sqlaccess.create_functions(spark)
    sqlaccess.become(spark, groups)
    sqlaccess.guard(spark, "member_bookings", warehouse(spark, sf_dir).path("silver"))
    return spark.sql(text)


@query
def sql_persona_rows(spark, sf_dir):  # U1, U2, G1, G2, G3
    return _asked(spark, sf_dir, [CITY_MANAGER], f"SELECT {', '.join(VIEW_COLUMNS)} FROM member_bookings")


@query
def sql_persona_countries(spark, sf_dir):  # U1, U2, G9
    """One SQL text, asked by every persona."""
    answers = [
        _asked(spark, sf_dir, groups, f"""
            SELECT '{name}' AS persona, country, count(*) AS bookings, count(DISTINCT hotel) AS hotels
            FROM member_bookings WHERE mask_pii(country) IS NOT NULL GROUP BY country""")
        for name, groups in PERSONA_GROUPS.items()
    ]
    every = answers[0]
    for answer in answers[1:]:
        every = every.union(answer)
    return every
