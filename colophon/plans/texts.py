"""Queries of scalar functions: hashes, names, dates, tokens, codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions import dates, text
from colophon.plans.registry import query, table
from colophon.sources import files


@query("SELECT doc_id, md5('oai:' || doc_id) AS record_id, upper(md5(\"text\")) AS content_hash FROM documents")
def x_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.record_id(F.concat(F.lit("oai:"), F.col("doc_id").cast("string"))).alias("record_id"), text.content_hash(F.col("text")).alias("content_hash"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN '00_' || md5('p' || c_name) WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING_' || md5('p.b:' || c_name) ELSE c_mktsegment || '_' || md5('p' || c_name) END AS fingerprint,
upper(regexp_replace(upper(c_name), '[^A-Z0-9\\-_]', '_', 'g')) AS acronym FROM customer""")
def x_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    acronym = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment"))
    return customers.select("c_custkey", text.fingerprint(acronym, F.col("c_name"), "p", {"BUILDING": "b"}).alias("fingerprint"), text.sanitize_acronym(F.col("c_name")).alias("acronym"))


@query("""WITH n AS (SELECT doc_id, "text", len(regexp_extract_all("text", '[\\p{L}\\p{N}]+(?:[''’-][\\p{L}\\p{N}]+)*')) AS w, len(regexp_extract_all("text", '[[:punct:]]')) AS p FROM documents)
SELECT doc_id, CASE WHEN trim("text") = '' THEN 0 ELSE CAST(greatest(1, ceil(round(1.10::DOUBLE * w + 0.35::DOUBLE * p, 9))) AS INTEGER) END AS tokens FROM n""")
def x_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT o_orderkey, date_trunc('day', o_orderdate) AS dashed, date_trunc('day', o_orderdate) AS slashed, date_trunc('year', o_orderdate) AS year_only, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS machine, strftime(o_orderdate, '%Y-%m-%d') AS by_day, true AS ok, false AS bad FROM orders")
def x_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    shown = lambda f: F.date_format(d, f)
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(shown("yyyy-MM-dd")).cast("timestamp_ntz").alias("dashed"), dates.parse_date(shown("dd/MM/yyyy")).cast("timestamp_ntz").alias("slashed"), dates.parse_date(shown("yyyy")).cast("timestamp_ntz").alias("year_only"), dates.machine(d).alias("machine"), dates.format_for(d, "YYYY-MM-DD").alias("by_day"), dates.is_date(shown("yyyy/MM")).alias("ok"), dates.is_date(F.lit("sometime")).alias("bad"))


@query("SELECT o_orderkey, date_trunc('day', o_orderdate) AS start, date_trunc('day', o_orderdate) + INTERVAL 86399 SECOND AS finish FROM orders")
def x_legacy_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.date_format("o_orderdate", "d-M-yyyy")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_legacy(shown).cast("timestamp_ntz").alias("start"), dates.parse_legacy(shown, end_of_day=True).cast("timestamp_ntz").alias("finish"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*(\\.[A-Za-z-]{2,})'), ''), 'No clasificados') AS host FROM pages")
def x_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.domain_of(F.col("url")).alias("host"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(\"text\", '-\\s*\\n\\s*', '', 'g'), '\\s+', ' ', 'g'))) AS collapsed FROM documents")
def x_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.collapse(F.col("text"))).alias("collapsed"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(trim(left(\"text\", 30)), '\\s+'), lambda x: x <> '')) >= 5 AS counts FROM documents")
def x_title_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.title_counts(F.substring("text", 1, 30)).alias("counts"))


@query("SELECT p_partkey, 'brand:' || p_brand || ',' || p_size || ';type:' || p_type AS encoded, p_type AS decoded, p_brand AS prefixed, 'UNKNOWN' AS unknown FROM part")
def x_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.create_map(F.lit("brand"), F.array("p_brand", F.col("p_size").cast("string")), F.lit("type"), F.array("p_type"))
    encoded = text.encode_occurrences(values)
    return table(spark, sf_dir, "part").select("p_partkey", encoded.alias("encoded"), F.array_join(text.decode_occurrences(encoded)["type"], ",").alias("decoded"), text.prefixed_content(F.array(F.lit("b:none"), F.concat(F.lit("b: "), "p_brand")), "b:").alias("prefixed"), text.prefixed_content(F.array("p_type"), "zz:").alias("unknown"))


@query("SELECT conv_id, turn, strftime(TIMESTAMP '2020-01-01' + to_minutes(turn), '%Y-%m-%d %H:%M:%S.000') AS timestamp, trim(regexp_replace(\"text\", '[\\r\\n]+', ' ', 'g')) AS message FROM conversations")
def x_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines written and parsed again."""
    talks = table(spark, sf_dir, "conversations")
    at = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz") + F.make_interval(mins=F.col("turn").cast("int"))
    lines = talks.select("conv_id", "turn", files.log_line(F.col("text"), at).alias("value"))
    return files.parse_log(lines, keep=["conv_id", "turn"])


@query("SELECT conv_id AS record_id, string_agg(\"text\", ' ' ORDER BY turn) AS joined FROM conversations WHERE trim(\"text\") <> '' GROUP BY conv_id")
def a_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("record_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("texts"))
    return talks.select("record_id", text.joined_occurrences(F.col("texts")).alias("joined"))


@query("SELECT c_custkey, c_mktsegment || '_' || md5(c_name) AS fingerprint FROM customer")
def x_index_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.index_fingerprint(F.col("c_mktsegment"), text.record_id(F.col("c_name"))).alias("fingerprint"))


@query("""SELECT page_id AS record_id, 'ORIGINAL' AS type, 'f' || page_id || '.pdf' AS filename, 'http://h/a b/' || page_id AS url, CASE WHEN page_id % 2 = 0 THEN 'text/html' ELSE 'application/pdf' END AS mime,
CASE WHEN page_id % 3 = 0 THEN 'c' || page_id ELSE md5('http://h/a%20b/' || page_id) END AS checksum FROM pages""")
def x_bitstreams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attached files, read from record trees; format and checksum have defaults."""
    n = F.col("page_id").cast("string")
    field = lambda name, value: F.concat(F.lit(f'<field name="{name}">'), value, F.lit("</field>"))
    fields = F.concat(field("name", F.concat(F.lit("f"), n, F.lit(".pdf"))), field("url", F.concat(F.lit("http://h/a%20b/"), n)), F.when(F.col("page_id") % 2 == 0, field("format", F.lit("text/html"))).otherwise(""), F.when(F.col("page_id") % 3 == 0, field("checksum", F.concat(F.lit("c"), n))).otherwise(""))
    xml = F.concat(F.lit('<metadata><element name="bundles"><element name="bundle"><field name="name">ORIGINAL</field><element name="bitstreams"><element name="bitstream">'), fields, F.lit("</element></element></element></element></metadata>"))
    return files.bitstreams(table(spark, sf_dir, "pages").select(F.col("page_id").alias("record_id"), xml.alias("xml"))).drop("sid")


@query()
def x_xxhash64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.xxhash64_seed0(F.col("text")).alias("hash"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(nfc_normalize(\"text\"), '-\\s*\\n\\s*', '', 'g'), '\\s+', ' ', 'g'))) AS normal FROM documents")
def x_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalise(F.col("text"))).alias("normal"))


@query()
def x_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n")[0].alias("title"), "text")
    return docs.select("doc_id", F.posexplode(text.chunks(F.col("title"), F.col("text"))).alias("chunk_no", "chunk"))


@query()
def x_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", files.page_text(F.col("html")).alias("text"))


@query()
def x_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An injected encoder of four dimensions; null where it fails."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    encoder = lambda texts: [[float(len(t)), float(t.count("a")), 0.0, 1.0] for t in texts]
    return parts.mapInPandas(lambda batches: text.embed(batches, "p_name", encoder, 4), "p_partkey long, p_name string, embedding array<double>")
