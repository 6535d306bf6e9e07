"""Column mask, row filter and guarded views as SQL that any query text can use.

The member's groups are a session variable, the functions are SQL functions of that variable, and a view
over a written table applies them. Whatever SQL is asked of the view is filtered and masked. Spark inlines
the functions and folds the variable, so what is left of the filter reaches the scan, and a masked column
is not read. Everything is temporary: it belongs to one session, as a member does.
"""

from collections.abc import Iterable

from pyspark.sql import SparkSession

from roomledger.schemas import (
    ANALYST, CITY_HOTEL, CITY_MANAGER, ENGINEER, MASK, MASKED_COLUMNS, RESORT_HOTEL, RESORT_MANAGER,
)

GROUPS = "member_groups"


def _text(value: str) -> str:
    """A SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def create_functions(spark: SparkSession) -> None:
    """is_member(group), mask_pii(value) and hotel_row_filter(hotel), of a member who is in no group yet."""
    become(spark, [])
    member = lambda group: f"is_member({_text(group)})"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION is_member(g STRING) RETURNS BOOLEAN
        COMMENT 'Whether the session''s member is in the group.'
        RETURN array_contains({GROUPS}, g)""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION mask_pii(v STRING) RETURNS STRING
        COMMENT 'The value for engineers, the mask (also over NULL) for everyone else.'
        RETURN CASE WHEN {member(ENGINEER)} THEN v ELSE {_text(MASK)} END""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION hotel_row_filter(h STRING) RETURNS BOOLEAN
        COMMENT 'True for the rows of a hotel that the member may see.'
        RETURN {member(ENGINEER)} OR {member(ANALYST)}
          OR ({member(CITY_MANAGER)} AND h = {_text(CITY_HOTEL)})
          OR ({member(RESORT_MANAGER)} AND h = {_text(RESORT_HOTEL)})""")


def become(spark: SparkSession, groups: Iterable[str]) -> None:
    """Set the groups of the session's member; queries analysed from now on are answered for them."""
    listed = ", ".join(map(_text, sorted(set(groups))))
    spark.sql(f"DECLARE OR REPLACE VARIABLE {GROUPS} ARRAY<STRING> DEFAULT CAST(array({listed}) AS ARRAY<STRING>)")


def guard(spark: SparkSession, view: str, path: str, masked: Iterable[str] = MASKED_COLUMNS, hotel: str = "hotel") -> None:
    """A view over a Parquet table that filters its rows and masks its columns for the member."""
    masked = set(masked)
    columns = [
        f"mask_pii({_name(c)}) AS {_name(c)}" if c in masked else _name(c) for c in spark.read.parquet(path).columns
    ]
    spark.sql(f"""CREATE OR REPLACE TEMPORARY VIEW {_name(view)} AS
        SELECT {", ".join(columns)} FROM parquet.{_name(path)} WHERE hotel_row_filter({_name(hotel)})""")
