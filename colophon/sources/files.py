"""Logs, rule side inputs, catalog files, attached files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """All batch files of a catalog."""
    return spark.read.option("pathGlobFilter", "oai_records_batch_*.parquet").parquet(path)


def log_line(message: Column, at: Column) -> Column:
    """``[time] message`` on one line."""
    return F.concat(F.lit("["), F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("] "), F.regexp_replace(message, r"[\r\n]+", " "))


def parse_log(lines: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """timestamp and message beside the columns to keep; a line without brackets is both, blank lines are left out."""
    line = F.col(column)
    plain = F.instr(line, "]") <= 1
    stamp = F.trim(F.regexp_extract(line, r"(?s)\A.([^\]]*)\]", 1))
    message = F.trim(F.regexp_extract(line, r"(?s)\A[^\]]*\](.*)\z", 1))
    return lines.where(F.trim(line) != "").select(*(keep or []), F.when(plain, line).otherwise(stamp).alias("timestamp"), F.when(plain, line).otherwise(message).alias("message"))


def read_log(spark: SparkSession, path: str, page: int = 0, size: int = 100) -> DataFrame:
    """A page of log entries, newest first."""
    return parse_log(spark.read.text(path)).orderBy(F.desc("timestamp"), "message").offset(page * size).limit(size)


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """One value for each line."""
    return spark.read.text(path).where("value <> ''").select("value")


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """Two tab-separated columns: key and value."""
    return spark.read.option("sep", "\t").schema("key string, value string").csv(path).where("key IS NOT NULL AND value IS NOT NULL")


def page_text(html: Column) -> Column:
    """The text of an HTML page: scripts, styles, comments and tags removed, five entities decoded, spaces collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def bitstreams(records: DataFrame, xml: str = "xml") -> DataFrame:
    """record_id and one row for each attached file: bundle type, name, url, format, size, checksum and sid."""
    schema = "element array<struct<_name:string, element:array<struct<_name:string, field:array<struct<_name:string,_VALUE:string>>, element:array<struct<_name:string, element:array<struct<_name:string, field:array<struct<_name:string,_VALUE:string>>>>>>>>>>"
    tree = records.select("record_id", F.from_xml(xml, schema, {"rowTag": "metadata"}).alias("m"))
    # metadata / bundles / bundle / (name field, bitstreams / bitstream / fields)
    bundles = tree.select("record_id", F.explode(F.filter("m.element", lambda e: e["_name"] == "bundles")).alias("b")).select("record_id", F.explode("b.element").alias("bundle"))
    of = lambda fields, name: F.get(F.transform(F.filter(fields, lambda f: f["_name"] == name), lambda f: f["_VALUE"]), F.lit(0))
    files = bundles.select("record_id", of(F.col("bundle.field"), "name").alias("type"), F.explode(F.flatten(F.transform("bundle.element", lambda e: e["element"]))).alias("f"))
    url = of(F.col("f.field"), "url")
    return files.select(
        "record_id",
        "type",
        of(F.col("f.field"), "name").alias("filename"),
        F.coalesce(F.try_url_decode(url), url).alias("url"),
        F.coalesce(of(F.col("f.field"), "format"), F.lit("application/pdf")).alias("mime"),
        F.coalesce(of(F.col("f.field"), "checksum"), F.md5(url)).alias("checksum"),
        of(F.col("f.field"), "sid").alias("sid"),
    )


def file_count(spark: SparkSession, path: str) -> int:
    """Files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").count()
