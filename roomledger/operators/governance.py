"""Persona views and the policy catalog."""

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger.functions.access import hotel_row_filter, mask_pii
from roomledger.schemas import ANALYST, CITY_MANAGER, ENGINEER, MASKED_COLUMNS, RESORT_MANAGER
from roomledger.sources.tables import materialize

# ---------------------------------------------------------------------------
# Groups, tags, grants and lineage edges.
# ---------------------------------------------------------------------------

PERSONAS = [ENGINEER, ANALYST, CITY_MANAGER, RESORT_MANAGER]

TABLE_TAGS = [
    ("bronze_bookings", "layer", "bronze"),
    ("silver_bookings", "layer", "silver"),
    ("gold_hotel_month", "layer", "gold"),
    ("gold_hotel_month", "certified", "true"),
]

COLUMN_TAGS = [
    ("silver_bookings", "country", "hb_data_class", "pii"),
    ("silver_bookings", "agent", "hb_data_class", "pii"),
    ("silver_bookings", "company", "hb_data_class", "pii"),
    ("silver_bookings", "adr", "hb_data_class", "financial"),
    ("silver_bookings", "est_lost_revenue", "hb_data_class", "financial"),
]

GRANTS = (
    [(p, "catalog", "catalog", "USE CATALOG") for p in PERSONAS]
    + [(p, "schema", "schema", "USE SCHEMA") for p in PERSONAS]
    + [
        (ENGINEER, "schema", "schema", "ALL PRIVILEGES"),
        (ENGINEER, "volume", "raw", "READ VOLUME"),
        (ENGINEER, "table", "bronze_bookings", "SELECT"),
    ]
    + [
        (p, "table", t, "SELECT")
        for t in ("silver_bookings", "gold_hotel_month")
        for p in (ANALYST, CITY_MANAGER, RESORT_MANAGER)
    ]
    + [
        (p, "function", f, "EXECUTE")
        for f in ("mask_pii", "hotel_row_filter")
        for p in PERSONAS
    ]
)

LINEAGE = [
    ("bronze_bookings", "silver_bookings"),
    ("silver_bookings", "gold_hotel_month"),
    ("silver_bookings", "reservation_risk"),
    ("reservation_risk", "reservation_risk_serving"),
    ("silver_bookings", "reservation_risk_serving"),
]

MASKS = [("silver_bookings", column, "mask_pii") for column in MASKED_COLUMNS]
ROW_FILTERS = [("silver_bookings", "hotel_row_filter", "hotel")]


def persona_view(silver: DataFrame, groups: Iterable[str]) -> DataFrame:
    """What a member of the groups sees of silver: rows filtered first, then columns masked.

    The filter reaches the scan, and a masked column that is not needed is never read.
    """
    visible = silver.where(hotel_row_filter("hotel", groups))
    return visible.withColumns({
        c: mask_pii(c, groups) for c in MASKED_COLUMNS if c in silver.columns
    })


def visibility(silver: DataFrame, personas: Mapping[str, Iterable[str]]) -> DataFrame:
    """Per persona: rows and hotels it sees, and a sample of how a masked column looks to it.

    One pass whatever the number of personas: rows are counted per hotel first, and each persona is
    then worked out from those few rows.
    """
    per_hotel = silver.groupBy("hotel").agg(
        F.count(F.lit(1)).alias("rows"), F.max("country").alias("country")
    )
    who = F.array(*[
        F.struct(
            F.lit(name).alias("persona"),
            hotel_row_filter("hotel", groups).alias("sees"),
            mask_pii("country", groups).alias("country"),
        )
        for name, groups in personas.items()
    ])
    seen = per_hotel.select("hotel", "rows", F.inline(who))
    return seen.groupBy("persona").agg(
        F.sum(F.when(F.col("sees"), F.col("rows")).otherwise(0)).alias("visible_rows"),
        F.count_if("sees").alias("hotels"),
        F.max(F.when(F.col("sees"), F.col("country"))).alias("country_sample"),
    )


def with_comments(df: DataFrame, comments: Mapping[str, str]) -> DataFrame:
    """The same rows with the caller's column comments in the schema, which written tables keep."""
    for name in set(df.columns) & set(comments):
        df = df.withMetadata(name, {**df.schema[name].metadata, "comment": comments[name]})
    return df


def tags(spark: SparkSession) -> DataFrame:
    """Table and column tags: table, column (NULL for the table itself), key, value."""
    rows = [(table, None, key, value) for table, key, value in TABLE_TAGS] + COLUMN_TAGS
    return spark.createDataFrame(rows, "table string, column string, key string, value string")


def tagged_columns(table: str, value: str) -> list[str]:
    """Columns of a table classified with a value, for example the ones to mask."""
    return [column for t, column, _, tag in COLUMN_TAGS if t == table and tag == value]


def access_matrix(spark: SparkSession) -> DataFrame:
    """Grants: persona, object_type, object, privilege."""
    return spark.createDataFrame(
        list(GRANTS), "persona string, object_type string, object string, privilege string"
    )


def allowed(requests: DataFrame, matrix: DataFrame) -> DataFrame:
    """The requests (persona, table) a grant covers; no grant means no.

    ALL PRIVILEGES on the schema covers each of its tables.
    """
    reads = matrix.where((F.col("object_type") == "table") & (F.col("privilege") == "SELECT"))
    on_table = requests.join(
        reads.select("persona", F.col("object").alias("table")), ["persona", "table"], "left_semi"
    )
    owners = matrix.where(F.col("privilege") == "ALL PRIVILEGES").select("persona").distinct()
    return on_table.union(requests.join(owners, "persona", "left_semi").select(*on_table.columns)).distinct()


def lineage(spark: SparkSession) -> DataFrame:
    """Direct table lineage: upstream, downstream."""
    return spark.createDataFrame(LINEAGE, "upstream string, downstream string")


def lineage_closure(edges: DataFrame) -> DataFrame:
    """Every table pair connected by lineage, with the length of the shortest way.

    Each round goes one step on from the pairs that the round before found and keeps those not seen
    yet, until there are none. So the longest shortest way decides how many rounds there are, and a
    cycle ends like anything else. Rounds are written, which keeps every plan as small as the first.
    """
    step = edges.select(F.col("upstream").alias("via"), F.col("downstream").alias("next")).distinct()
    reach = materialize(edges.select("upstream", "downstream").distinct().withColumn("depth", F.lit(1)), "lineage")
    frontier, depth = reach, 1
    while not frontier.isEmpty():
        depth += 1
        further = frontier.join(step, F.col("downstream") == F.col("via")).select(
            "upstream", F.col("next").alias("downstream")
        ).distinct()
        frontier = materialize(
            further.join(reach, ["upstream", "downstream"], "left_anti").withColumn("depth", F.lit(depth)), "lineage"
        )
        reach = reach.union(frontier)
    return reach


def masks(spark: SparkSession) -> DataFrame:
    """Column masks: table, column, function."""
    return spark.createDataFrame(MASKS, "table string, column string, function string")


def row_filters(spark: SparkSession) -> DataFrame:
    """Row filters: table, function, column."""
    return spark.createDataFrame(ROW_FILTERS, "table string, function string, column string")


def described_columns(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """Columns of a live table with type, tag and mask: the policy catalog as one frame."""
    live = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(schema.fields)],
        "position int, column string, type string",
    )
    of_table = F.col("table") == table
    return (
        live.join(
            tags(spark).where(of_table & F.col("column").isNotNull())
            .select("column", F.col("value").alias("data_class")),
            "column", "left",
        )
        .join(
            masks(spark).where(of_table).select("column", F.col("function").alias("mask")),
            "column", "left",
        )
        .select("position", "column", "type", "data_class", "mask")
    )
