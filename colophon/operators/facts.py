"""Validation facts: wide verdicts, long occurrences, joined views and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.functions.text import index_fingerprint
from colophon.operators.validators import ValidatorRule

FIXED = ["identifier_hash", "identifier", "datestamp", "is_valid", "is_transformed", "published_metadata_hash"]


def rule_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("rule_") and c[5:].isdigit()]


def record_validation(validated: DataFrame) -> DataFrame:
    """The wide fact: fixed columns and one boolean for each rule; a missing verdict is false."""
    fixed = [F.col(c) for c in FIXED if c in validated.columns]
    return validated.select(*fixed, *[F.coalesce(c, F.lit(False)).alias(c) for c in rule_columns(validated)])


def verdict_map(df: DataFrame) -> Column:
    """rule columns as map<bigint, boolean>."""
    return F.create_map(*[x for c in rule_columns(df) for x in (F.lit(int(c[5:])).cast("long"), F.col(c))])


def pivot_verdicts(df: DataFrame, rule_ids: list[int], verdicts: str = "rule_results") -> DataFrame:
    """map<bigint, boolean> to one column for each listed rule, without a job to find the rules."""
    return df.withColumns({f"rule_{i}": F.coalesce(F.try_element_at(F.col(verdicts), F.lit(i).cast("long")), F.lit(False)) for i in rule_ids}).drop(verdicts)


def rule_occurrences(validated: DataFrame, diagnose: bool = True) -> DataFrame:
    """The long fact: identifier_hash, rule_id, is_valid, occurrence_value; nothing unless diagnosing."""
    out = validated.where(F.lit(diagnose)).select("identifier_hash", F.explode("details").alias("d"))
    return out.select("identifier_hash", F.col("d.rule_id").alias("rule_id"), F.col("d.is_valid").alias("is_valid"), F.col("d.value").alias("occurrence_value"))


def fact_table(records: DataFrame, occurrences: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The documented 14-column view, one row for each occurrence. Both facts are joined on the record's hash."""
    facts = occurrences.join(records.select(*FIXED, "snapshot_id"), "identifier_hash")
    dims = snapshots.select("snapshot_id", "origin", "network", "repository", "institution", "metadata_prefix", "set_spec")
    return facts.join(dims, "snapshot_id", "left").select(
        F.col("identifier_hash").alias("id"), "identifier", "snapshot_id", "origin", "network", "repository", "institution", "rule_id",
        F.col("occurrence_value").alias("value"), occurrences["is_valid"].alias("is_valid"), records["is_valid"].alias("record_is_valid"), "is_transformed", "metadata_prefix", "set_spec",
    )


def observations(records: DataFrame, snapshot: dict[str, str | int] | None = None) -> DataFrame:
    """Rows as the API shows them: arrays of valid and invalid rule ids beside the snapshot's names."""
    rules = rule_columns(records)
    ids = lambda wanted: F.array_compact(F.array(*[F.when(F.col(c) == wanted, F.lit(c[5:])) for c in rules])) if rules else F.array().cast("array<string>")
    named = {k: F.lit(v) for k, v in (snapshot or {}).items()}
    empty = {c: F.lit(None).cast("string") for c in ("repository_name", "institution_name", "set_spec")}
    return records.select(*[c for c in FIXED if c in records.columns], ids(True).alias("valid_rules"), ids(False).alias("invalid_rules"), *[v.alias(k) for k, v in {**empty, **named}.items()])


def facts_of_records(records: DataFrame, occurrences: DataFrame | None = None) -> DataFrame:
    """One row for each record and rule with its verdict and, when diagnosing, the arrays of valid and invalid values."""
    long = records.select("identifier_hash", F.explode(verdict_map(records)).alias("rule_id", "rule_is_valid"))
    if occurrences is None:
        return long
    values = lambda valid: F.array_sort(F.collect_list(F.when(F.col("is_valid") == valid, F.col("occurrence_value"))))
    grouped = occurrences.groupBy("identifier_hash", "rule_id").agg(values(True).alias("valid_values"), values(False).alias("invalid_values"))
    none = F.array().cast("array<string>")
    return long.join(grouped, ["identifier_hash", "rule_id"], "left").withColumns({c: F.coalesce(c, none) for c in ("valid_values", "invalid_values")})


def rule_definitions(spark, rules: list[ValidatorRule]) -> DataFrame:
    rows = [(r.rule_id, r.name, r.description, r.quantifier, r.mandatory) for r in rules]
    return spark.createDataFrame(rows, "rule_id long, name string, description string, quantifier string, mandatory boolean")


def index_columns(records: DataFrame) -> DataFrame:
    """What an indexer reads: the fixed columns, no verdicts."""
    return records.select(*[c for c in FIXED if c in records.columns])


def index_documents(records: DataFrame, vectors: DataFrame, network: str, dimension: int, key: str = "identifier_hash") -> DataFrame:
    """What a search index with vectors takes of each valid record: id, identifier, network and its vector.

    ``vectors`` has the key and ``embedding``; a vector of another dimension counts as absent, and a record without
    one is indexed all the same.
    """
    fitting = vectors.where(F.size("embedding") == dimension).select(key, F.col("embedding").alias("vector"))
    rows = to_index(records).join(fitting, key, "left")
    return rows.select(index_fingerprint(F.lit(network), F.col(key)).alias("id"), "identifier", F.lit(network).alias("network"), "vector")


def to_index(records: DataFrame, only_valid: bool = True, content: dict[str, list[str]] | None = None) -> DataFrame:
    """Valid records whose fields have, for every field of ``content``, at least one of its values."""
    out = records.where("is_valid") if only_valid else records
    for name, values in (content or {}).items():
        out = out.where(F.coalesce(F.arrays_overlap(F.col(f"`{name}`"), F.array(*map(F.lit, values))), F.lit(False)))
    return out
