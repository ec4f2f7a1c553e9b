"""Queries of snapshots, catalogs, contents and incremental loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.operators import catalog as c
from colophon.operators import digests
from colophon.operators import snapshots as s
from colophon.plans.adapters import CATALOG, SNAPSHOTS, catalog, snapshots
from colophon.plans.registry import query, table
from colophon.shipping import scratch
from colophon.sources import lists, oai
from colophon.streaming import harvest

_ROW = "id, network_id, status, end_time"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", "network_id", "status", "end_time")


def _latest_sql(where: str) -> str:
    return f"WITH {SNAPSHOTS} SELECT {_ROW} FROM (SELECT *, rank() OVER (PARTITION BY network_id ORDER BY end_time DESC) AS k FROM s WHERE {where}) WHERE k = 1"


@query(_latest_sql("status = 9 AND NOT deleted"))
def s_last_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(s.last_good(snapshots(spark, sf_dir)))


@query(_latest_sql("status IN (4, 9) AND NOT deleted"))
def s_last_harvested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(s.last_harvested(snapshots(spark, sf_dir)))


@query(_latest_sql("true"))
def s_last_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(s.last_of_any_status(snapshots(spark, sf_dir)))


@query(f"WITH l AS ({_latest_sql('true')}) SELECT DISTINCT network_id FROM l WHERE status = 4")
def s_status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.networks_by_latest_status(snapshots(spark, sf_dir), 4)


@query(f"""WITH {SNAPSHOTS}, g AS (SELECT network_id, max(end_time) AS t FROM s WHERE status = 9 AND NOT deleted GROUP BY 1), h AS (SELECT network_id, max(end_time) AS t FROM s WHERE status IN (4, 9) AND NOT deleted GROUP BY 1)
SELECT {_ROW} FROM s WHERE id NOT IN (SELECT id FROM s JOIN g USING (network_id) WHERE status = 9 AND NOT deleted AND end_time = t UNION SELECT id FROM s JOIN h USING (network_id) WHERE status IN (4, 9) AND NOT deleted AND end_time = t)""")
def s_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(s.to_delete(snapshots(spark, sf_dir)))


@query(f"WITH {SNAPSHOTS}, g AS (SELECT network_id, max(end_time) AS t FROM s WHERE status = 9 AND NOT deleted GROUP BY 1) SELECT id, coalesce(status = 9 AND NOT deleted AND end_time = t, false) AS is_last_good FROM s LEFT JOIN g USING (network_id)")
def s_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.summary(snapshots(spark, sf_dir)).select("id", "is_last_good")


@query(f"WITH {SNAPSHOTS} SELECT {_ROW} FROM s WHERE network_id = 7 AND NOT deleted AND status IN (3, 4) ORDER BY start_time DESC, id")
def s_by_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(s.by_network(snapshots(spark, sf_dir), 7, deleted=False, statuses=[3, 4]))


@query(f"WITH {SNAPSHOTS} SELECT {_ROW} FROM s WHERE end_time BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-03-31'")
def s_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(s.between(snapshots(spark, sf_dir), "1995-03-01", "1995-03-31"))


@query(f"WITH {SNAPSHOTS} SELECT id, CASE WHEN id = 3 THEN 9 ELSE status END AS status FROM s")
def s_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.apply_event(snapshots(spark, sf_dir), 3, "finish_validation", F.lit("2020-01-01").cast("timestamp_ntz")).select("id", "status")


@query(f"WITH {SNAPSHOTS} SELECT id, deleted OR id IN (1, 2, 3, 4, 5, 6) AS deleted FROM s WHERE NOT (id IN (1, 2, 3, 4, 5, 6) AND status NOT IN (4, 9))")
def s_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.clean(snapshots(spark, sf_dir), [1, 2, 3, 4, 5, 6]).select("id", "deleted")


@query(f"WITH {SNAPSHOTS} SELECT id, CASE WHEN id = 5 THEN 4 ELSE status END AS status, CASE WHEN id = 5 THEN 0 ELSE id % 100 END AS valid_size FROM s")
def s_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.reset_validation(snapshots(spark, sf_dir).withColumn("valid_size", F.col("id") % 100), 5).select("id", "status", "valid_size")


@query("SELECT o_orderkey AS id, (o_custkey << 27) | (o_orderkey & 134217727) AS unique_id FROM orders")
def w_unique_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), s.unique_id(F.col("o_custkey"), F.col("o_orderkey")).alias("unique_id"))


@query("SELECT c_custkey AS id, c_nationkey % 2 = 0 AND (c_nationkey < 10 OR c_acctbal > 0) AS due, c_acctbal > 0 AS rich FROM customer")
def q_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    properties = F.create_map(F.lit("low"), F.col("c_nationkey") < 10, F.lit("rich"), F.col("c_acctbal") > 0)
    due = s.action_due(F.col("c_nationkey") % 2 == 0, properties, ["low", "rich", "absent"])
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), due.alias("due"), s.network_property(properties, "rich").alias("rich"))


# ---- catalog and contents ----


@query(f"WITH {CATALOG} SELECT id, identifier, original_metadata_hash, deleted FROM c WHERE NOT deleted")
def k_catalog_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.live(catalog(spark, sf_dir)).select("id", "identifier", "original_metadata_hash", "deleted")


@query(f"WITH {CATALOG} SELECT count(*) AS total, count(*) FILTER (WHERE NOT deleted) AS live, count(*) FILTER (WHERE deleted) AS gone FROM c")
def a_catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.counts(catalog(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str, change: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.where(change).select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("content"), (F.col("event_type") == "error").alias("deleted"), F.col("event_id").alias("seq"))


_UPSERT = """b AS (SELECT CAST(user_id AS VARCHAR) AS id, event_type AS content, event_type = 'error' AS deleted, event_id AS seq FROM events WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
d AS (SELECT CAST(user_id AS VARCHAR) AS id, event_type AS content, event_type = 'error' AS deleted, event_id AS seq FROM events WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
m AS (SELECT id, content, deleted FROM d UNION ALL SELECT id, content, deleted FROM b WHERE id NOT IN (SELECT id FROM d))"""


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = c.last_write(_events(spark, sf_dir, "event_id % 2 = 0")).drop("seq")
    return c.upsert(base, _events(spark, sf_dir, "event_id % 2 = 1"))


@query(f"WITH {_UPSERT} SELECT id, content, deleted FROM m")
def i_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir)


@query(f"WITH {_UPSERT} SELECT count(*) AS total, count(*) FILTER (WHERE NOT deleted) AS live, count(*) FILTER (WHERE deleted) AS gone FROM m")
def i_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.counts(_upserted(spark, sf_dir))


@query("SELECT CAST(user_id AS VARCHAR) AS id, event_type AS content, event_type = 'error' AS deleted, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def u_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping sets, harvested one after the other."""
    return c.union_of_sets([_events(spark, sf_dir, "event_id % 2 = 0"), _events(spark, sf_dir, "event_id % 2 = 1 OR event_id % 3 = 0")])


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY")
def i_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    mark = events.agg((F.max("ts") - F.expr("INTERVAL 5 DAY")).alias("mark")).first()["mark"]
    return harvest.since(events, F.lit(mark), "ts")


_CONTENT = "SELECT DISTINCT 'N' || (doc_id % 2) AS network, upper(md5(\"text\")) AS hash FROM documents"


def _contents(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(where)
    return docs.select(F.concat(F.lit("N"), (F.col("doc_id") % 2).cast("string")).alias("network"), F.upper(F.md5("text")).alias("hash"), F.col("text").alias("content"))


@query(f"SELECT network, hash FROM ({_CONTENT}) EXCEPT SELECT network, hash FROM ({_CONTENT} WHERE doc_id % 3 = 0)")
def k_content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.new_contents(_contents(spark, sf_dir, "doc_id % 3 = 0").dropDuplicates(["network", "hash"]), _contents(spark, sf_dir, "true")).select("network", "hash")


@query(f"SELECT network, hash FROM ({_CONTENT}) WHERE hash NOT IN (SELECT upper(md5(\"text\")) FROM documents WHERE doc_id % 5 = 0)")
def k_content_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _contents(spark, sf_dir, "true").dropDuplicates(["network", "hash"])
    return c.without_contents(store, _contents(spark, sf_dir, "doc_id % 5 = 0")).select("network", "hash")


@query(f"WITH {CATALOG} SELECT id, length(s.\"text\") AS n, c.original_metadata_hash IS NOT NULL AND s.\"text\" IS NULL AS is_missing FROM c LEFT JOIN (SELECT DISTINCT upper(md5(\"text\")) AS h, \"text\" FROM documents WHERE doc_id % 4 <> 0) s ON s.h = c.original_metadata_hash")
def j_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _contents(spark, sf_dir, "doc_id % 4 <> 0").withColumn("network", F.lit("N")).dropDuplicates(["network", "hash"])
    return c.with_content(catalog(spark, sf_dir).drop("text").withColumn("network", F.lit("N")), store).select("id", F.length("content").alias("n"), "is_missing")


@query(f"WITH {CATALOG} SELECT identifier, doc_id FROM c WHERE doc_id % 2 = 0 AND identifier NOT IN (SELECT identifier FROM c WHERE doc_id % 2 = 1 OR doc_id % 3 = 0)")
def j_antijoin_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).select("identifier", "doc_id")
    return s.missing_in(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1 OR doc_id % 3 = 0"))


@query(f"WITH {CATALOG} SELECT identifier, doc_id FROM c")
def u_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).select("identifier", "doc_id")
    return s.carry_over(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1 OR doc_id % 3 = 0"))


@query("SELECT DISTINCT upper(md5(\"text\")) AS hash FROM documents x WHERE NOT EXISTS (SELECT 1 FROM documents y WHERE (y.doc_id % 3 = 0 AND md5(y.\"text\") = md5(x.\"text\")) OR (y.doc_id % 5 = 0 AND md5(y.\"text\") = md5(x.\"text\")))")
def j_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.upper(F.md5("text")).alias("hash"))
    used = docs.select(F.when(F.col("doc_id") % 3 == 0, F.col("hash")).alias("original_metadata_hash"), F.when(F.col("doc_id") % 5 == 0, F.col("hash")).alias("published_metadata_hash"))
    return s.orphans(docs.select("hash").distinct(), used)


@query("SELECT DISTINCT upper(md5(\"text\")) AS hash FROM documents WHERE md5(\"text\") IN (SELECT md5(\"text\") FROM documents WHERE doc_id % 3 = 0)")
def j_known_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = table(spark, sf_dir, "documents").select(F.upper(F.md5("text")).alias("hash")).distinct()
    return c.known_hashes(hashes, _contents(spark, sf_dir, "doc_id % 3 = 0"))


@query(f"""WITH {CATALOG}, a AS (SELECT id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE original_metadata_hash END AS h FROM c WHERE doc_id % 5 <> 0 AND NOT deleted), b AS (SELECT id, original_metadata_hash AS h FROM c WHERE (doc_id % 3 <> 0 OR doc_id % 5 = 0) AND NOT deleted)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.id = b.id""")
def s_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir)
    old = rows.where("doc_id % 5 <> 0").withColumn("original_metadata_hash", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("original_metadata_hash")))
    return s.difference(old, rows.where("doc_id % 3 <> 0 OR doc_id % 5 = 0"))


@query(f"""WITH {CATALOG}, a AS (SELECT id, CASE WHEN doc_id % 70 = 0 THEN 'old' ELSE original_metadata_hash END AS h FROM c WHERE doc_id % 50 <> 3 AND NOT deleted), b AS (SELECT id, original_metadata_hash AS h FROM c WHERE doc_id % 90 <> 4 AND NOT deleted)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.id = b.id""")
def s_diff_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots written by bucket; buckets with equal digests are not joined."""
    rows, there = catalog(spark, sf_dir), scratch(spark, "diff")
    old = rows.where("doc_id % 50 <> 3").withColumn("original_metadata_hash", F.when(F.col("doc_id") % 70 == 0, "old").otherwise(F.col("original_metadata_hash")))
    for name, snapshot in (("old", old), ("new", rows.where("doc_id % 90 <> 4"))):
        digests.write_buckets(snapshot.select("id", "original_metadata_hash", "deleted"), f"{there}/{name}")
    return digests.bucketed_difference(spark, f"{there}/old", f"{there}/new", with_same=True)


@query(f"WITH {CATALOG} SELECT id, identifier, original_metadata_hash FROM c WHERE NOT deleted")
def k_catalog_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog written as files and read again; tombstones, which have no hash, are left out."""
    there = scratch(spark, "catalog-file")
    c.write_catalog(catalog(spark, sf_dir).select("id", "identifier", F.lit("2020-01-01").cast("timestamp").alias("datestamp"), "original_metadata_hash", "deleted"), there, 500)
    return spark.read.parquet(there).select("id", "identifier", "original_metadata_hash")


@query(f"WITH {CATALOG} SELECT network, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'A' WHEN doc_id % 3 = 1 THEN 'B' ELSE 'C' END AS network FROM c WHERE NOT deleted) WHERE network <> 'B' GROUP BY network")
def k_unindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three networks are indexed, one of them twice, and one is taken out."""
    there, rows = scratch(spark, "index"), catalog(spark, sf_dir)
    for network, of in (("A", "doc_id % 3 = 1"), ("B", "doc_id % 3 = 1"), ("C", "doc_id % 3 = 2"), ("A", "doc_id % 3 = 0")):
        c.write_index(c.live(rows).where(of).select("id", "identifier"), there, network)
    c.unindex(spark, there, "B")
    return c.read_index(spark, there).groupBy("network").agg(F.count("*").alias("n"))


@query("SELECT 'N' || (o_custkey % 5) AS network, CAST(count(*) AS BIGINT) AS n FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1")
def k_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots in folders by network and snapshot; one snapshot is read by its folders alone."""
    there = scratch(spark, "layout")
    c.layout(table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("N"), (F.col("o_custkey") % 5).cast("string")).alias("network"), F.year("o_orderdate").alias("snapshot_id")), there)
    return spark.read.parquet(there).where("snapshot_id = 1995").groupBy("network").agg(F.count("*").alias("n"))


@query(f"WITH {CATALOG} SELECT id, identifier FROM c WHERE identifier IN (SELECT identifier FROM c WHERE doc_id IN (5, 77)) OR id IN (SELECT id FROM c WHERE doc_id = 99)")
def r_look_up_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups by hash and by identifier in files sorted by hash with Bloom filters."""
    there, rows = scratch(spark, "look-up"), catalog(spark, sf_dir)
    c.write_for_look_up(rows.select("id", "identifier"), there)
    wanted = rows.where("doc_id IN (5, 77, 99)").select("doc_id", "id", "identifier").collect()  # three rows
    by = lambda ids, column: [r[column] for r in wanted if r["doc_id"] in ids]
    return spark.read.parquet(there).where(F.col("identifier").isin(by((5, 77), "identifier")) | F.col("id").isin(by((99,), "id")))


# ---- harvesting ----


def _record(identifier: str, metadata: str) -> Column:
    """A record as a provider lists it; without metadata it is a deleted one."""
    return F.concat(
        F.lit("<record><header"), F.when(F.expr(metadata).isNull(), " status='deleted'").otherwise(""), F.lit("><identifier>"), F.expr(identifier), F.lit("</identifier><datestamp>2020-01-01</datestamp></header>"),
        F.coalesce(F.concat(F.lit("<metadata>"), F.expr(metadata), F.lit("</metadata>")), F.lit("")), F.lit("</record>"),
    )


def _list_pages(pages: DataFrame, metadata: str, path: str, size: int = 50) -> None:
    """Web pages as three lists of records, ``size`` on a page; each page names the next as its token."""
    rows = pages.select(F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")).alias("set"), F.expr(f"page_id div {3 * size}").alias("page"), "page_id", _record("'page:' || page_id", metadata).alias("record"))
    last = rows.groupBy("set").agg(F.max("page").alias("last"))  # three rows
    grouped = rows.groupBy("set", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "record"))), lambda r: r["record"]), "").alias("records"))
    token = F.when(F.col("page") < F.col("last"), (F.col("page") + 1).cast("string")).otherwise("")
    xml = F.concat(F.lit("<OAI-PMH><ListRecords>"), F.col("records"), F.lit("<resumptionToken>"), token, F.lit("</resumptionToken></ListRecords></OAI-PMH>"))
    grouped.join(last, "set").select("set", "page", xml.alias("value")).write.partitionBy("set", "page").text(path)


@query("""SELECT md5('page:' || page_id) AS id, 'page:' || page_id AS identifier, page_id % 7 = 0 AS deleted,
CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN upper(md5('<m>new ' || md5(html) || '</m>')) ELSE upper(md5('<m>' || md5(url) || '</m>')) END AS original_metadata_hash FROM pages""")
def i_list_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages listed by a provider in three sets: a full harvest, then an incremental one with changes and deletions."""
    pages, there = table(spark, sf_dir, "pages"), scratch(spark, "lists")
    store = harvest.VersionedCatalog(spark, f"{there}/catalog")
    _list_pages(pages, "'<m>' || md5(url) || '</m>'", f"{there}/all")
    changes = pages.where("page_id % 7 = 0 OR page_id % 5 = 0 OR page_id % 150 < 3")  # no list page is left out
    _list_pages(changes, "CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN '<m>new ' || md5(html) || '</m>' ELSE '<m>' || md5(url) || '</m>' END", f"{there}/changes")
    fetch_since = lambda mark: lists.folder_fetch(f"{there}/{'changes' if mark else 'all'}")
    for _ in range(2):
        harvest.harvest_lists(spark, fetch_since, ["s0", "s1", "s2"], store, f"{there}/checkpoint", pages=20)
    return store.read().select("id", "identifier", "deleted", "original_metadata_hash")


@query("SELECT 'page:' || page_id AS identifier FROM pages WHERE page_id % 4 = 1")
def i_missing_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live records that are listed without metadata; deleted ones are not missing."""
    record = F.concat(F.lit("<record><header"), F.when(F.col("page_id") % 4 == 2, " status='deleted'").otherwise(""), F.lit("><identifier>page:"), F.col("page_id").cast("string"), F.lit("</identifier></header>"), F.when(F.col("page_id") % 4 == 3, "<metadata><m/></metadata>").when(F.col("page_id") % 4 == 0, "<metadata>x</metadata>").otherwise(""), F.lit("</record>"))
    xml = F.concat(F.lit("<ListRecords>"), F.array_join(F.collect_list(record), ""), F.lit("</ListRecords>"))
    pages = table(spark, sf_dir, "pages").groupBy(F.expr("page_id div 40").alias("path")).agg(xml.alias("xml"))
    return oai.missing_metadata(oai.records(pages))


@query("SELECT n_name AS name, 'http://' || lower(r_name) AS url, CAST(NULL AS VARCHAR) AS compression FROM nation JOIN region ON n_regionkey = r_regionkey")
def x_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses to Identify as maps."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    xml = F.concat(F.lit("<o:OAI xmlns:o='u'><o:Identify><o:repositoryName>"), "n_name", F.lit("</o:repositoryName><o:baseURL> http://"), F.lower("r_name"), F.lit("</o:baseURL></o:Identify></o:OAI>"))
    entry = lambda k: F.try_element_at("identify", F.lit(k))
    return oai.identify(rows.select(xml.alias("xml"))).select(entry("repositoryName").alias("name"), entry("baseURL").alias("url"), entry("compression").alias("compression"))


@query("SELECT 's' || n_nationkey AS set_spec, CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS set_name FROM nation")
def x_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses to ListSets, one for each region; some sets have no name."""
    name = F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("<setName>"), "n_name", F.lit("</setName>"))).otherwise("")
    one = F.concat(F.lit("<set><setSpec>s"), F.col("n_nationkey").cast("string"), F.lit("</setSpec>"), name, F.lit("</set>"))
    return oai.sets(table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<ListSets>"), F.array_join(F.collect_list(one), ""), F.lit("</ListSets>")).alias("xml")))


@query("SELECT CAST(count(*) FILTER (WHERE doc_id % 9 <> 0) AS BIGINT) AS migrated, CAST(count(*) FILTER (WHERE doc_id % 9 = 0) AS BIGINT) AS skipped FROM documents")
def k_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).withColumn("identifier", F.when(F.col("doc_id") % 9 != 0, F.col("identifier")))
    return c.migrate(rows)[1]


@query("SELECT event_id FROM events WHERE user_id = 11 AND event_type = 'click' ORDER BY event_id LIMIT 5")
def q_broker_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a network and a topic, first page."""
    events = table(spark, sf_dir, "events").where("user_id = 11 AND event_type = 'click'")
    return events.select("event_id").orderBy("event_id").limit(5)
