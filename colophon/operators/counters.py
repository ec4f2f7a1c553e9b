"""Counters kept by differences: statistics of the next snapshot from those of the last one and the changed records.

A record gives each counter at most one: the total, its flags, its rules and its occurrences. What a record gave before
a change is taken back and what it gives after is added, so the work grows with the changes and never with the
snapshot. Counters are rows (facet, value, count); those that fall to zero go, as a facet lists only what was seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.operators.facts import rule_columns

TOTAL = "total"
FLAGS = {"record_is_valid": "is_valid", "record_is_transformed": "is_transformed"}


def _given(records: DataFrame) -> DataFrame:
    """facet and value of all counters that the records have a part in, one row for each part."""
    cell = lambda facet, value: F.struct(facet.alias("facet"), value.alias("value"))
    flags = [cell(F.lit(facet), F.coalesce(F.col(c), F.lit(False)).cast("string")) for facet, c in FLAGS.items() if c in records.columns]
    rules = [cell(F.when(F.col(c), "valid_rules").otherwise("invalid_rules"), F.lit(c[5:])) for c in rule_columns(records)]
    return records.select(F.inline(F.array(cell(F.lit(TOTAL), F.lit("")), *flags, *rules)))


def _occurred(occurrences: DataFrame) -> DataFrame:
    """The counters of occurrence values: a facet for each rule and verdict."""
    facet = F.concat(F.when(F.col("is_valid"), "valid_occurrences:").otherwise("invalid_occurrences:"), F.col("rule_id").cast("string"))
    return occurrences.select(facet.alias("facet"), F.col("occurrence_value").alias("value"))


def _parts(records: DataFrame, occurrences: DataFrame | None, weight: int) -> DataFrame:
    parts = _given(records) if occurrences is None else _given(records).unionByName(_occurred(occurrences))
    return parts.withColumn("count", F.lit(weight).cast("long"))


def counted(records: DataFrame, occurrences: DataFrame | None = None) -> DataFrame:
    """facet, value, count of a whole snapshot."""
    return _parts(records, occurrences, 1).groupBy("facet", "value").agg(F.sum("count").alias("count"))


def moved(counters: DataFrame, before: DataFrame, after: DataFrame, occurrences_before: DataFrame | None = None, occurrences_after: DataFrame | None = None) -> DataFrame:
    """The counters after a change: ``before`` has the changed records as they were, ``after`` as they are.

    A new record is in ``after`` alone, a deleted one in ``before`` alone.
    """
    parts = counters.select("facet", "value", "count").unionByName(_parts(before, occurrences_before, -1)).unionByName(_parts(after, occurrences_after, 1))
    return parts.groupBy("facet", "value").agg(F.sum("count").alias("count")).where("count <> 0")


def of_changed(rows: DataFrame, changed: DataFrame, key: str = "identifier_hash") -> DataFrame:
    """The rows of changed records: what ``moved`` wants, from a snapshot and the keys that changed."""
    return rows.join(changed.select(key).distinct(), key, "left_semi")


def page_facets(counters: DataFrame) -> DataFrame:
    """The counters that ``stats.facets`` shows without filters."""
    return counters.where(F.col("facet").isin(*FLAGS, "valid_rules", "invalid_rules"))


def occurrence_counts(counters: DataFrame, rule_id: int) -> DataFrame:
    """is_valid, occurrence_value, n of a rule, as ``stats.occurrence_counts`` has them."""
    kept = counters.where(F.col("facet").isin(f"valid_occurrences:{rule_id}", f"invalid_occurrences:{rule_id}"))
    return kept.select(F.col("facet").startswith("valid").alias("is_valid"), F.col("value").alias("occurrence_value"), F.col("count").alias("n")).orderBy(F.desc("n"), "occurrence_value", "is_valid")
