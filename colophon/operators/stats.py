"""Filters, counts, facets, rule statistics and pages over validation facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.operators.facts import rule_columns
from colophon.shipping import scratch

_FLAGS = {"is_valid": "is_valid", "record_is_valid": "is_valid", "is_transformed": "is_transformed", "record_is_transformed": "is_transformed"}


class BadFilter(ValueError):
    """A filter is malformed."""


def check_filters(filters: list[str]) -> None:
    """Every filter must be ``field@@value``; stricter than what ``filter_condition`` reads."""
    for f in filters:
        if len(f.split("@@")) != 2:
            raise BadFilter(f)


def filter_condition(filters: list[str] | None) -> Column | None:
    """``field@@value`` or ``field:value`` filters as one condition; unknown fields and malformed filters are ignored."""
    conditions = []
    for f in filters or []:
        separator = "@@" if "@@" in f else ":"
        name, found, value = f.partition(separator)
        name, value = name.strip(), value.replace('"', "").strip()
        if not found:
            continue
        if name == "identifier":
            conditions.append(F.col("identifier").ilike("%" + value.replace("\\", "\\\\") + "%"))
        elif name in _FLAGS:
            conditions.append(F.col(_FLAGS[name]) == (value.lower() == "true"))
        elif name in ("valid_rules", "invalid_rules"):
            if not value.isdigit():
                raise BadFilter(f"{f}: a rule id is a number")
            conditions.append(F.col(f"rule_{int(value)}") == (name == "valid_rules"))
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def filtered(records: DataFrame, filters: list[str] | None) -> DataFrame:
    condition = filter_condition(filters)
    return records if condition is None else records.where(condition)


def _count(condition: Column | str) -> Column:
    return F.coalesce(F.count_if(condition if isinstance(condition, Column) else F.col(condition)), F.lit(0))


def counts(records: DataFrame, filters: list[str] | None = None) -> DataFrame:
    """One scan, one row: total, valid, transformed, and for every rule valid_<id> and invalid_<id>; zeros for no rows."""
    rules = rule_columns(records)
    by_rule = [x for c in rules for x in (_count(c).alias(f"valid_{c[5:]}"), _count(~F.col(c)).alias(f"invalid_{c[5:]}"))]
    transformed = _count("is_transformed") if "is_transformed" in records.columns else F.lit(0)
    return filtered(records, filters).agg(F.count("*").alias("total"), _count("is_valid").alias("valid"), transformed.cast("long").alias("transformed"), *by_rule)


def rule_counts(records: DataFrame, filters: list[str] | None = None) -> DataFrame:
    """rule_id, valid, invalid; rules are columns, so one scan and one row before they are stacked."""
    one = counts(records, filters)
    cells = F.array(*[F.struct(F.lit(int(c[5:])).cast("long").alias("rule_id"), F.col(f"valid_{c[5:]}").alias("valid"), F.col(f"invalid_{c[5:]}").alias("invalid")) for c in rule_columns(records)])
    return one.select(F.inline(cells))


def rule_statistics(records: DataFrame, definitions: DataFrame, filters: list[str] | None = None) -> DataFrame:
    """Definitions with their counts; a definition without any has 0 valid and null invalid."""
    stats = rule_counts(records, filters)
    return definitions.join(F.broadcast(stats), "rule_id", "left").withColumn("valid", F.coalesce("valid", F.lit(0)))  # one row for each rule


def facets(records: DataFrame, filters: list[str] | None = None) -> DataFrame:
    """facet, value, count. Without filters only seen values are listed; with filters always true and false."""
    one = counts(records, filters)
    rules = [c[5:] for c in rule_columns(records)]
    cell = lambda facet, value, n: F.struct(F.lit(facet).alias("facet"), F.lit(value).alias("value"), n.cast("long").alias("count"))
    flags = [("record_is_valid", F.col("valid")), ("record_is_transformed", F.col("transformed"))]
    cells = [c for facet, n in flags for c in (cell(facet, "true", n), cell(facet, "false", F.col("total") - n))]
    by_rule = [c for r in rules for c in (cell("valid_rules", r, F.col(f"valid_{r}")), cell("invalid_rules", r, F.col(f"invalid_{r}")))]
    out = one.select(F.inline(F.array(*cells, *by_rule)))
    keep_zero = F.col("facet").isin("record_is_valid", "record_is_transformed") if filters else F.lit(False)
    return out.where((F.col("count") > 0) | keep_zero)


def occurrence_counts(occurrences: DataFrame, rule_id: int, is_valid: bool | None = None) -> DataFrame:
    """Values of a rule with their counts, most frequent first; equal counts by value."""
    of_rule = occurrences.where(F.col("rule_id") == rule_id)
    if is_valid is not None:
        of_rule = of_rule.where(F.col("is_valid") == is_valid)
    return of_rule.groupBy("is_valid", "occurrence_value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "occurrence_value", "is_valid")


def page(df: DataFrame, number: int, size: int = 1000, order: str = "identifier", filters: list[str] | None = None) -> DataFrame:
    """A 0-based page by offset."""
    return filtered(df, filters).orderBy(order).offset(number * size).limit(size)


def next_page(df: DataFrame, key: str, after: object | None, size: int = 1000, condition: Column | None = None) -> DataFrame:
    """A page by key: what comes after ``after``; its cost does not grow with its number."""
    out = df if condition is None else df.where(condition)
    return (out if after is None else out.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def page_directory(df: DataFrame, key: str, size: int = 1000) -> DataFrame:
    """page and low: the first key of every page of ``size`` rows. Keys are unique.

    Rows are range-partitioned by key and written as keys alone; a row's place is its partition's offset, a sum over
    the partitions before it, and its place there. The directory is a row for each page: written, it serves any page.
    """
    spark = df.sparkSession
    there = scratch(spark, "page-directory")
    placed = df.select(key).repartitionByRange(key).sortWithinPartitions(key).withColumn("at", F.monotonically_increasing_id())
    placed.select(key, F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at")).write.parquet(there)
    placed = spark.read.parquet(there)
    # A row for each partition, so one task can add them up.
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    offsets = counts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("offset"))
    ranked = placed.join(offsets, "part").withColumn("rank", F.col("offset") + F.col("at"))
    return ranked.where(F.col("rank") % size == 0).select(F.expr(f"rank div {size}").alias("page"), F.col(key).alias("low"))


def directory_page(df: DataFrame, directory: DataFrame, number: int, key: str) -> DataFrame:
    """A 0-based page as a range of keys: its cost does not grow with its number. The rows are in no order."""
    lows = {r["page"]: r["low"] for r in directory.where(F.col("page").isin(number, number + 1)).collect()}  # two rows at most
    if number not in lows:
        return df.where(F.lit(False))
    out = df.where(F.col(key) >= F.lit(lows[number]))
    return out.where(F.col(key) < F.lit(lows[number + 1])) if number + 1 in lows else out


def page_envelope(total: int, number: int, size: int) -> dict[str, int | bool]:
    pages = -(-total // size) if size else 0
    return {"total_elements": total, "total_pages": pages, "number": number, "size": size, "has_next": number + 1 < pages, "has_previous": number > 0, "is_first": number == 0, "is_last": number + 1 >= pages}


def by_identifier(df: DataFrame, identifier: str) -> DataFrame:
    return df.where(F.col("identifier") == identifier).limit(1)


def status_is(column: Column, status: object, negated: bool = False) -> Column:
    """Equal to a status, or different from it."""
    return column != status if negated else column == status


def contains_ignoring_case(column: Column, text: str) -> Column:
    return F.lower(column).contains(text.lower())


def count_by_status(records: DataFrame, statuses: list[int]) -> DataFrame:
    """Rows with one of the statuses, in all and transformed."""
    return records.where(F.col("status").isin(statuses)).agg(F.count("*").alias("n"), _count("is_transformed").alias("n_transformed"))


def stats_to_json(stats: DataFrame) -> DataFrame:
    return stats.select(F.to_json(F.struct(*stats.columns)).alias("json"))


def stats_from_json(df: DataFrame, schema: str) -> DataFrame:
    return df.select(F.from_json("json", schema).alias("s")).select("s.*")
