"""Harvested pages: XML responses to rows, replayed from files as a batch or as a stream.

A page is cut where a record with a header begins, so that records inside the metadata (some formats have elements of
that name) stay in it; a record's metadata reach from their first tag to their last. Values of the header are decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a record of the page begins, as against one inside the metadata.
_START = r"(?s)(?=<(?:[\w.-]+:)?record(?:\s[^>]*)?>\s*<(?:[\w.-]+:)?header[\s>/])"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row for each response file: path and xml."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("xml"))


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 10) -> DataFrame:
    """The same as a stream; a file is a page, and its place in the checkpoint the resumption token."""
    return spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def _text(xml: Column, tag: str) -> Column:
    return F.nullif(F.trim(F.xpath_string(xml, F.lit(f"//*[local-name()='{tag}']"))), F.lit(""))


def _blocks(xml: Column, tag: str) -> Column:
    """The elements of a name, as text; names may carry a prefix."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<(?:[\w.-]+:)?{tag}(?:\s[^>]*)?>.*?</(?:[\w.-]+:)?{tag}>"), F.lit(0))


def _inner(block: Column, tag: str) -> Column:
    """What an element holds, as text; null if it is absent."""
    found = F.regexp_extract(block, rf"(?s)<(?:[\w.-]+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:[\w.-]+:)?{tag}>", 1)
    return F.nullif(F.trim(found), F.lit(""))


def _decoded(text: Column) -> Column:
    """Character references and CDATA sections resolved; null stays null."""
    return F.when(text.rlike("[&<]"), F.xpath_string(F.concat(F.lit("<x>"), text, F.lit("</x>")), F.lit("/x"))).otherwise(text)


def records(pages: DataFrame) -> DataFrame:
    """resumption_token, identifier, datestamp, header_status, set_spec, metadata; one row for each record of a page."""
    token = F.regexp_extract("xml", r"(?s).*<(?:[\w.-]+:)?resumptionToken(?:\s[^>]*)?>(.*?)</(?:[\w.-]+:)?resumptionToken>", 1)
    token = _decoded(F.nullif(F.trim(token), F.lit("")))
    parts = F.filter(F.split("xml", _START), lambda x: x.rlike(r"\A<(?:[\w.-]+:)?record[\s>]"))
    rows = pages.select(token.alias("resumption_token"), F.explode(parts).alias("r"))
    head = F.regexp_extract("r", r"(?s)<(?:[\w.-]+:)?header(?:\s[^>]*)?(?:/>|>.*?</(?:[\w.-]+:)?header>)", 0)
    rows = rows.select("resumption_token", "r", head.alias("head"))
    status = F.nullif(F.regexp_extract("head", r"<(?:[\w.-]+:)?header[^>]*\sstatus\s*=\s*[\"']([^\"']*)", 1), F.lit(""))
    of = lambda tag: _decoded(_inner(F.col("head"), tag))
    metadata = F.nullif(F.trim(F.regexp_extract("r", r"(?s)<(?:[\w.-]+:)?metadata(?:\s[^>]*)?>(.*)</(?:[\w.-]+:)?metadata\s*>", 1)), F.lit(""))
    return rows.select("resumption_token", of("identifier").alias("identifier"), of("datestamp").alias("datestamp"), status.alias("header_status"), of("setSpec").alias("set_spec"), metadata.alias("metadata"))


def is_deleted() -> Column:
    return F.coalesce(F.col("header_status") == "deleted", F.lit(False))


def missing_metadata(rows: DataFrame) -> DataFrame:
    """Live records without metadata: they are listed, not stored."""
    return rows.where(~is_deleted() & F.col("metadata").isNull()).select("identifier")


#: Entries of an Identify response.
IDENTIFY = ["repositoryName", "baseURL", "protocolVersion", "adminEmail", "earliestDatestamp", "deletedRecord", "granularity", "compression"]


def identify(pages: DataFrame) -> DataFrame:
    """The response to Identify as a map."""
    return pages.select(F.create_map(*[x for tag in IDENTIFY for x in (F.lit(tag), _text(F.col("xml"), tag))]).alias("identify"))


def sets(pages: DataFrame) -> DataFrame:
    """The response to ListSets: set_spec and set_name."""
    rows = pages.select(F.explode(_blocks(F.col("xml"), "set")).alias("s"))
    return rows.select(_inner(F.col("s"), "setSpec").alias("set_spec"), _inner(F.col("s"), "setName").alias("set_name"))


def error_code(xml: Column) -> Column:
    return F.nullif(F.regexp_extract(xml, r"<(?:[\w.-]+:)?error[^>]*\scode\s*=\s*[\"']([^\"']*)", 1), F.lit(""))


def page_status(xml: Column) -> Column:
    """OK, NO_MATCHING_QUERY, ERROR_RETRY for a response that is no page, ERROR_FATAL for other errors."""
    code = error_code(xml)
    return F.when(code == "noRecordsMatch", "NO_MATCHING_QUERY").when(code.isNotNull(), "ERROR_FATAL").when(F.size(_blocks(xml, "ListRecords")) == 0, "ERROR_RETRY").otherwise("OK")
