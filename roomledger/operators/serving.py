"""The served snapshot and the reads over it."""

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomledger.functions.keys import packed_key, unpacked_key
from roomledger.schemas import DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE, RISK_BANDS, SERVING_COLUMNS
from roomledger.sources.tables import materialize

DETAIL_COLUMNS = [
    "arrival_date", "lead_time", "adr", "market_segment", "adults", "children", "babies",
    "deposit_type", "customer_type",
]
DEEP_PAGE = 10_000  # rows a top-k plan may skip
SCORE_COLUMNS = ["scored_at", "model_version", "cancel_probability", "hotel", "risk_band"]


def one_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The greatest row of each key, compared by ``order``, which must name every kept column.

    An aggregate rather than a window: each task first reduces its copies of a key to one row, so a
    key that holds a third of the table is as cheap to shuffle as any other, and the survivor does
    not depend on the order rows arrive in. Keys are shuffled packed.
    """
    best = F.max(F.struct(*order)).alias("best")
    return df.groupBy(packed_key(df, key).alias("_key")).agg(best).select(unpacked_key(df, key, "_key").alias(key), "best.*")


def build_serving(risk: DataFrame, silver: DataFrame | None = None) -> DataFrame:
    """One row per reservation: its score joined to its booking detail.

    Both sides are brought down to one row per key before they meet. Joining first would turn k
    copies of a booking into k * k rows. Either side leaves its aggregate already partitioned by
    the packed key, so the join itself shuffles nothing. Without ``silver`` the details are further columns
    of the scored rows; then one aggregate finds the greatest of both, and a key is shuffled once.
    """
    key = "reservation_id"
    if silver is None:
        best = risk.groupBy(packed_key(risk, key).alias("_key")).agg(
            F.max(F.struct(*SCORE_COLUMNS)).alias("score"), F.max(F.struct(*DETAIL_COLUMNS)).alias("detail"))
        detail = F.when(F.col("_key").isNotNull(), F.col("detail")).alias("detail")  # as a null key joins nothing
        parts = best.select(unpacked_key(risk, key, "_key").alias(key), "score.*", detail)
        return parts.select("*", "detail.*").select(*SERVING_COLUMNS)
    scores = risk.select(packed_key(risk, key).alias("_key"), *SCORE_COLUMNS)
    details = silver.select(packed_key(silver, key).alias("_key"), *DETAIL_COLUMNS)
    joined = one_per_key(scores, "_key", SCORE_COLUMNS).join(one_per_key(details, "_key", DETAIL_COLUMNS), "_key", "left")
    return joined.withColumn(key, unpacked_key(risk, key, "_key")).select(*SERVING_COLUMNS)


def page_window(limit=None, offset=None) -> tuple[int, int]:
    """(rows, rows to skip) of a page from what a request says.

    Whole numbers, as such or as text, are brought into 1..200 and 0 upwards. What is no whole number
    gives a page of the usual size, from the start.
    """
    def whole(value):
        text = str(value).strip()
        return int(text) if re.fullmatch(r"[+-]?[0-9]+", text) else None

    rows, skip = whole(limit), whole(offset)
    rows = DEFAULT_PAGE_SIZE if rows is None else sorted((1, rows, MAX_PAGE_SIZE))[1]
    return rows, skip if skip and skip > 0 else 0


def reservation_filter(
    *, hotel=None, risk_band=None, market_segment=None, min_lead_time=None
) -> Column:
    """All given conditions together; an empty text counts as not given, a lead time of 0 does."""
    if risk_band and risk_band not in RISK_BANDS:
        raise ValueError(f"no such risk band: {risk_band!r}; there are {sorted(RISK_BANDS)}")
    condition = F.lit(True)
    for column, wanted in (
        ("hotel", hotel), ("risk_band", risk_band), ("market_segment", market_segment),
    ):
        if wanted:
            condition = condition & (F.col(column) == wanted)
    if min_lead_time is not None:
        condition = condition & (F.col("lead_time") >= min_lead_time)
    return condition


def _ordered(serving: DataFrame, condition: Column | None) -> DataFrame:
    matching = serving if condition is None else serving.where(condition)
    return matching.orderBy(F.desc("cancel_probability"), "reservation_id")


def list_page(serving: DataFrame, condition: Column | None = None, limit=None, offset=None) -> DataFrame:
    """A page of reservations, most likely to cancel first.

    The key breaks ties, so pages do not overlap. Spark keeps offset + limit rows per task, which
    suits the first pages; beyond DEEP_PAGE rows the page comes from ``deep_page``.
    """
    rows, skip = page_window(limit, offset)
    if skip > DEEP_PAGE:
        return deep_page(serving, condition, rows, skip)
    return _ordered(serving, condition).offset(skip).limit(rows)


def deep_page(serving: DataFrame, condition: Column | None, rows: int, skip: int) -> DataFrame:
    """The page behind so many rows that no task should gather them.

    The order's keys are written in ranges and counted per range. Only the ranges that the page lies
    in are sorted, and their keys fetch the rows. Equal rows stay in one range, which is cut by count.
    """
    matching = serving if condition is None else serving.where(condition)
    keys = matching.select("cancel_probability", "reservation_id")
    ranged = materialize(
        materialize(keys, "page-keys")
        .repartitionByRange(F.desc("cancel_probability"), "reservation_id")
        .withColumn("range", F.spark_partition_id()),
        "page-ranges",
    )
    before, wanted, inside = 0, [], None
    for row in ranged.groupBy("range").count().orderBy("range").toLocalIterator():
        if before + row["count"] > skip and before < skip + rows:
            inside = before if inside is None else inside
            wanted.append(row["range"])
        before += row["count"]
    if not wanted:
        return serving.limit(0)
    page = _ordered(ranged.where(F.col("range").isin(wanted)), None).offset(skip - inside).limit(rows)
    chosen = F.broadcast(page.select("reservation_id"))  # at most a page of keys
    return _ordered(matching.join(chosen, "reservation_id", "left_semi"), None).limit(rows)


def next_page(
    serving: DataFrame, after_probability: float, after_id: str,
    condition: Column | None = None, limit=None,
) -> DataFrame:
    """The page after a known last row. The cost does not grow with depth, unlike an offset."""
    p = F.col("cancel_probability")
    after = (p < after_probability) | (
        (p == after_probability) & (F.col("reservation_id") > after_id)
    )
    return list_page(serving, after if condition is None else condition & after, limit)


def count_page(serving: DataFrame, condition: Column | None = None) -> DataFrame:
    """Number of reservations a filter matches."""
    matching = serving if condition is None else serving.where(condition)
    return matching.agg(F.count(F.lit(1)).alias("total"))


def lookup(serving: DataFrame, reservation_id: str | Column) -> DataFrame:
    """One reservation by key, no rows when there is none (F8)."""
    return serving.where(F.col("reservation_id") == reservation_id)


def kpis(serving: DataFrame) -> DataFrame:
    """Total, count per band and mean probability in one row (A4)."""
    return serving.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("risk_band") == band).alias(f"{band}_risk") for band in RISK_BANDS],
        F.avg("cancel_probability").alias("avg_cancel_probability"),
    )


def band_mix(serving: DataFrame) -> DataFrame:
    """The band counts of the KPI row as rows (A5)."""
    return (
        kpis(serving)
        .withColumnsRenamed({f"{band}_risk": band for band in RISK_BANDS})
        .unpivot([], list(RISK_BANDS), "risk_band", "count")
    )
