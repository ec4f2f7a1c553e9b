"""The standard tables as records, facts, catalogs and snapshots, and the same in SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions.text import content_hash, record_id
from colophon.operators.transformers import PriorityTranslate, transform
from colophon.operators.validators import ContentLength, ControlledValue, Regex, ValidatorRule, validate
from colophon.plans.registry import table
from colophon.shipping import scratch


def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records: ``flags`` holds return flag and line status of each line, ``sizes`` the quantities as text."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("flag"), F.col("l_quantity").cast("int").cast("string").alias("size"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", c))), lambda s: s[c])
    return lines.groupBy(F.col("l_orderkey").alias("record_id")).agg(ordered("flag").alias("flags"), ordered("size").alias("sizes"))


LINE_RECORDS = """r AS (
  SELECT l_orderkey AS record_id, list(flag ORDER BY l_linenumber, flag) AS flags, list(size ORDER BY l_linenumber, size) AS sizes
  FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS flag, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS size FROM lineitem) GROUP BY l_orderkey
)"""


def talk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as records: one field for each of two roles, in order of turns."""
    talks = table(spark, sf_dir, "conversations")
    ordered = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda s: s["text"])
    return talks.groupBy(F.col("conv_id").alias("record_id")).agg(ordered("user").alias("user"), ordered("assistant").alias("assistant"))


TALK_RECORDS = """r AS (
  SELECT conv_id AS record_id, coalesce(list("text" ORDER BY turn) FILTER (WHERE role = 'user'), []) AS "user",
         coalesce(list("text" ORDER BY turn) FILTER (WHERE role = 'assistant'), []) AS assistant
  FROM conversations GROUP BY conv_id
)"""

RULES: list[ValidatorRule] = [
    ContentLength(rule_id=1, name="length", field="text", min_length=200, max_length=5000, mandatory=True),
    ControlledValue(rule_id=2, name="language", field="lang", values=["en", "es"]),
    Regex(rule_id=3, name="source", field="source", pattern="src[0-9]", store_occurrences=True),
    ControlledValue(rule_id=4, name="quality", field="quality", values=["1"], quantifier="ZERO_OR_MORE", mandatory=True),
]


def doc_facts(spark: SparkSession, sf_dir: str, details: bool = False) -> DataFrame:
    """Documents as validated records: four rules, a translation of languages, quality labels as a field."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.col("quality").cast("string"))).alias("quality"))
    identifier = F.concat_ws(":", F.lit("oai"), "source", F.col("doc_id").cast("string"))
    one = lambda c: F.array_compact(F.array(c))
    rows = docs.join(labels, "doc_id", "left").select(
        identifier.alias("identifier"), record_id(identifier).alias("identifier_hash"), F.lit(None).cast("timestamp").alias("datestamp"), content_hash(F.col("text")).alias("published_metadata_hash"),
        F.lit(1).alias("snapshot_id"), one(F.col("text")).alias("text"), one(F.col("lang")).alias("lang"), one(F.col("source")).alias("source"), F.coalesce("quality", F.array().cast("array<string>")).alias("quality"),
    )
    moved = transform(rows, [PriorityTranslate(test_field="lang", write_field="lang", translations=[["fr", "fra"], ["de", "deu"]])])
    return validate(moved, RULES, details)


_stored: dict[tuple, str] = {}


def stored_facts(spark: SparkSession, sf_dir: str, details: bool = False) -> DataFrame:
    """``doc_facts`` as they are kept: written once for an application and a state of the tables, without the texts.

    Validation is a job of its own; counts, facets and pages read what it wrote.
    """
    state = []
    for name in ("documents", "labels"):
        there = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
        state += [fs.getFileStatus(there).getModificationTime(), fs.getContentSummary(there).getLength()]
    key = (spark.sparkContext.applicationId, sf_dir, *state)
    if key not in _stored:
        place = scratch(spark, "facts")
        doc_facts(spark, sf_dir, details=True).drop("text").write.parquet(place)
        _stored[key] = place
    facts = spark.read.parquet(_stored[key])
    return facts if details else facts.drop("details")


DOC_FACTS = """q AS (SELECT doc_id, list(CAST(quality AS VARCHAR)) AS quality FROM labels GROUP BY doc_id), v AS (
  SELECT 'oai:' || source || ':' || d.doc_id AS identifier, md5('oai:' || source || ':' || d.doc_id) AS identifier_hash, d.doc_id, lang, source,
         length("text") BETWEEN 200 AND 5000 AS rule_1, lang IN ('en', 'es') AS rule_2, regexp_full_match(source, 'src[0-9]') AS rule_3,
         q.quality IS NULL OR list_contains(q.quality, '1') AS rule_4, lang IN ('fr', 'de') AS is_transformed
  FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id
), f AS (SELECT *, rule_1 AND rule_4 AS is_valid FROM v)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a catalog; every seventeenth is deleted."""
    docs = table(spark, sf_dir, "documents")
    identifier = F.concat_ws(":", F.lit("oai"), "source", F.col("doc_id").cast("string"))
    deleted = F.col("doc_id") % 17 == 0
    return docs.select(record_id(identifier).alias("id"), identifier.alias("identifier"), F.when(~deleted, content_hash(F.col("text"))).alias("original_metadata_hash"), deleted.alias("deleted"), "doc_id", "text")


CATALOG = """c AS (
  SELECT md5('oai:' || source || ':' || doc_id) AS id, 'oai:' || source || ':' || doc_id AS identifier,
         CASE WHEN doc_id % 17 <> 0 THEN upper(md5("text")) END AS original_metadata_hash, doc_id % 17 = 0 AS deleted, doc_id, "text"
  FROM documents
)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as snapshots of customers' networks."""
    status = F.when(F.col("o_orderstatus") == "F", 9).when(F.col("o_orderstatus") == "O", 4).otherwise(3)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("network_id"), status.alias("status"), F.col("o_orderdate").alias("end_time"), F.col("o_orderdate").alias("start_time"), (F.col("o_orderkey") % 11 == 0).alias("deleted"))


SNAPSHOTS = """s AS (
  SELECT o_orderkey AS id, o_custkey AS network_id, CASE o_orderstatus WHEN 'F' THEN 9 WHEN 'O' THEN 4 ELSE 3 END AS status,
         o_orderdate AS end_time, o_orderdate AS start_time, o_orderkey % 11 = 0 AS deleted
  FROM orders
)"""
