"""Named data-quality rules that drop rows or only count them."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

DROP = "drop"
WARN = "warn"


@dataclass(frozen=True)
class Rule:
    name: str
    predicate: str
    action: str

    def holds(self) -> Column:
        """True when the predicate is true; NULL counts as a failure, as in a SQL filter."""
        return F.coalesce(F.expr(self.predicate), F.lit(False))


BOOKING_RULES = [
    Rule("valid_hotel", "hotel IS NOT NULL", DROP),
    Rule("non_negative_adr", "adr >= 0", DROP),
    Rule("has_guests", "(adults + children + babies) > 0", WARN),
    Rule("clean_parse", "_rescued_data IS NULL", WARN),
]


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that pass every drop rule. Warn rules keep their rows."""
    drops = [rule.holds() for rule in rules if rule.action == DROP]
    return df.where(reduce(Column.__and__, drops, F.lit(True)))


def rule_counts(rules: list[Rule]) -> list[Column]:
    """Aggregates: failures per rule and the number of rows."""
    return [F.count_if(~rule.holds()).alias(rule.name) for rule in rules] + [
        F.count(F.lit(1)).alias("rows")
    ]


def observe_rules(df: DataFrame, rules: list[Rule], target: Observation | str) -> DataFrame:
    """The same rows, with rule failures counted while they are written.

    ``target`` is an Observation for a batch, or a name for a stream, whose progress then carries
    the counts. No extra pass over the data.
    """
    return df.observe(target, *rule_counts(rules))


def rule_metrics(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule: rule, action, passed, failed. One pass whatever the number of rules."""
    counted = df.agg(*rule_counts(rules))
    per_rule = F.array(*[
        F.struct(
            F.lit(rule.name).alias("rule"),
            F.lit(rule.action).alias("action"),
            (F.col("rows") - F.col(rule.name)).alias("passed"),
            F.col(rule.name).alias("failed"),
        )
        for rule in rules
    ])
    return counted.select(F.inline(per_rule))
