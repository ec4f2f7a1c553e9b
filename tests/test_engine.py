"""Facts, statistics, snapshots, catalog, texts, dates, sources, harvesting."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from colophon.functions import dates, text
from colophon.operators import catalog, facts, snapshots, stats
from colophon.sources import files, oai
from colophon.streaming import harvest


@pytest.fixture(scope="module")
def records(spark):
    rows = [("h1", "id:abc", True, False, True, False), ("h2", "id:ABD", False, True, False, True), ("h3", "x_y", True, True, True, True)]
    return spark.createDataFrame(rows, "identifier_hash string, identifier string, is_valid boolean, is_transformed boolean, rule_7 boolean, rule_8 boolean")


@pytest.mark.parametrize(
    ("filters", "expected"),
    [
        (["is_valid@@true", 'valid_rules@@"7"'], ["h1", "h3"]),
        (["foo@@x"], ["h1", "h2", "h3"]),
        (["identifier:abc"], ["h1"]),
        (["identifier@@a%d"], ["h2"]),
        (["is_valid@@yes"], ["h2"]),
        (["record_is_transformed@@TRUE", "invalid_rules@@7"], ["h2"]),
        (["nonsense"], ["h1", "h2", "h3"]),
        (None, ["h1", "h2", "h3"]),
    ],
)
def test_filters(records, filters, expected):
    assert sorted(r[0] for r in stats.filtered(records, filters).collect()) == expected


def test_filter_checks():
    stats.check_filters(["a@@b"])
    for bad in (["identifier:abc"], ["a@@b@@c"]):
        with pytest.raises(stats.BadFilter):
            stats.check_filters(bad)
    with pytest.raises(stats.BadFilter):
        stats.filter_condition(["valid_rules@@1 OR 1=1"])


def test_counts_and_facets(records):
    assert stats.counts(records).first().asDict() == {"total": 3, "valid": 2, "transformed": 2, "valid_7": 2, "invalid_7": 1, "valid_8": 2, "invalid_8": 1}
    assert set(stats.counts(records.limit(0)).first()) == {0}
    shown = lambda f: {(r["facet"], r["value"], r["count"]) for r in stats.facets(records, f).collect() if r["facet"] == "record_is_valid"}
    assert shown(None) == {("record_is_valid", "true", 2), ("record_is_valid", "false", 1)}
    assert shown(["is_valid@@true"]) == {("record_is_valid", "true", 2), ("record_is_valid", "false", 0)}


def test_rule_statistics(spark, records):
    definitions = spark.createDataFrame([(7, "seven"), (9, "nine")], "rule_id long, name string")
    assert sorted(map(tuple, stats.rule_statistics(records, definitions).select("rule_id", "valid", "invalid").collect())) == [(7, 2, 1), (9, 0, None)]


def test_pages(records):
    assert [r["identifier"] for r in stats.page(records, 1, 2).collect()] == ["x_y"]
    assert [r["identifier"] for r in stats.next_page(records, "identifier", "id:ABD", 1).collect()] == ["id:abc"]
    assert stats.page_envelope(21, 2, 10) == {"total_elements": 21, "total_pages": 3, "number": 2, "size": 10, "has_next": False, "has_previous": True, "is_first": False, "is_last": True}
    assert stats.page_envelope(0, 0, 10)["is_last"]


def test_occurrence_counts_have_a_fixed_order(spark):
    rows = [("h", 1, True, v) for v in ("b", "a", "c", "c")] + [("h", 2, True, "z")]
    df = spark.createDataFrame(rows, "identifier_hash string, rule_id long, is_valid boolean, occurrence_value string")
    assert [(r["occurrence_value"], r["n"]) for r in stats.occurrence_counts(df, 1).collect()] == [("c", 2), ("a", 1), ("b", 1)]


def test_observations_and_verdict_maps(records):
    row = facts.observations(records, {"network": "N"}).orderBy("identifier_hash").first()
    assert (row["valid_rules"], row["invalid_rules"], row["set_spec"], row["network"]) == (["7"], ["8"], None, "N")
    again = facts.pivot_verdicts(records.select("identifier_hash", facts.verdict_map(records).alias("rule_results")), [7, 8])
    assert sorted(map(tuple, again.collect())) == sorted((r[0], r[4], r[5]) for r in records.collect())


def test_stats_json(records):
    one = stats.counts(records)
    again = stats.stats_from_json(stats.stats_to_json(one), ", ".join(f"{c} long" for c in one.columns))
    assert again.first() == one.first()


SNAPSHOT = "id long, network_id long, status int, end_time timestamp, start_time timestamp, deleted boolean, index_status int, valid_size int"


@pytest.fixture(scope="module")
def versions(spark):
    rows = [(1, 1, 9, "2020-01-01", False), (2, 1, 9, "2020-01-02", False), (3, 1, 9, "2020-01-02", False), (4, 1, 4, "2020-01-03", False), (5, 1, 9, "2020-01-09", True), (6, 1, 3, "2020-01-05", False), (7, 2, 3, None, False)]
    df = spark.createDataFrame([(*r, None, 5) for r in rows], "id long, network_id long, status int, end_time string, deleted boolean, index_status int, valid_size int")
    return df.withColumn("end_time", F.col("end_time").cast("timestamp")).withColumn("start_time", F.col("end_time"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_latest_snapshots(versions):
    assert ids(snapshots.last_good(versions)) == [2, 3]
    assert ids(snapshots.last_harvested(versions)) == [4]
    assert ids(snapshots.last_of_any_status(versions)) == [5]
    assert ids(snapshots.to_delete(versions)) == [1, 5, 6, 7]
    assert [r["id"] for r in snapshots.summary(versions).where("is_last_good").collect()] == [2, 3]
    assert [r[0] for r in snapshots.networks_by_latest_status(versions, 9).collect()] == [1]


def test_life_cycle(versions):
    out = snapshots.apply_event(versions, 7, "finish_harvesting", F.lit("2021-01-01").cast("timestamp")).where("id = 7").first()
    assert out["status"] == 4 and out["end_time"].year == 2021
    assert ids(snapshots.clean(versions, [4, 6])) == [1, 2, 3, 4, 5, 7]
    row = snapshots.reset_validation(versions, 2).where("id = 2").first()
    assert (row["status"], row["index_status"], row["valid_size"]) == (4, 10, 0)


def test_difference_treats_tombstones_as_absent(spark):
    schema = "id string, original_metadata_hash string, deleted boolean"
    old = spark.createDataFrame([("a", "1", False), ("b", "1", False), ("c", "1", False), ("d", None, True)], schema)
    new = spark.createDataFrame([("a", "1", False), ("b", "2", False), ("c", None, True), ("d", "1", False)], schema)
    assert dict(map(tuple, snapshots.difference(old, new).collect())) == {"a": "same", "b": "changed", "c": "deleted", "d": "new"}


def test_unique_ids_do_not_overlap(spark):
    row = spark.range(1).select(snapshots.unique_id(F.lit(3), F.lit(5)).alias("a"), snapshots.unique_id(F.lit(3), F.lit((1 << 27) + 5)).alias("b")).first()
    assert row["a"] == (3 << 27) + 5 == row["b"]


CATALOG = "id string, content string, deleted boolean"


def test_upsert(spark):
    base = spark.createDataFrame([("1", "old", False), ("2", "old", False)], CATALOG)
    delta = spark.createDataFrame([("2", "mid", False, 1), ("2", "new", False, 2), ("3", "new", False, 1), ("1", None, True, 3)], CATALOG + ", seq int")
    out = catalog.upsert(base, delta)
    assert sorted(map(tuple, out.collect())) == [("1", None, True), ("2", "new", False), ("3", "new", False)]
    assert tuple(catalog.counts(out).first()) == (3, 2, 1)
    assert sorted(map(tuple, catalog.upsert(base, delta.limit(0)).collect())) == sorted(map(tuple, base.collect()))


def test_contents(spark):
    store = spark.createDataFrame([("N", "A", "a")], "network string, hash string, content string")
    delta = spark.createDataFrame([("N", "A", "a"), ("N", "B", "b"), ("N", "B", "b"), ("M", "A", "a")], store.schema)
    assert sorted(map(tuple, catalog.new_contents(store, delta).select("network", "hash").collect())) == [("M", "A"), ("N", "B")]
    rows = spark.createDataFrame([("1", "N", "A"), ("2", "N", "Z"), ("3", "N", None)], "id string, network string, original_metadata_hash string")
    assert {r["id"]: r["is_missing"] for r in catalog.with_content(rows, store).collect()} == {"1": False, "2": True, "3": False}


def test_catalog_files(spark, tmp_path):
    df = spark.createDataFrame([(" a ", "i", "2020-01-01", "h", False), ("b", "j", "2020-01-01", None, True)], "id string, identifier string, datestamp string, original_metadata_hash string, deleted boolean").withColumn("datestamp", F.col("datestamp").cast("timestamp"))
    catalog.write_catalog(df, str(tmp_path / "c"))
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "c")).collect()] == ["a"]
    for n in (1, 2, 10):
        spark.range(n).coalesce(1).write.parquet(f"{tmp_path}/tmp{n}")
        part = next((tmp_path / f"tmp{n}").glob("*.parquet"))
        (tmp_path / "b").mkdir(exist_ok=True)
        part.rename(tmp_path / "b" / f"oai_records_batch_{n}.parquet")
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/b/other.parquet")
    assert files.read_catalog(spark, str(tmp_path / "b")).count() == 13
    assert [catalog.file_rows(n) for n in (10, 500_000, 5_000_000, 50_000_000)] == [50_000, 500_000, 1_000_000, 2_000_000]
    catalog.layout(df.select("id", F.lit("N").alias("network"), F.lit(4).alias("snapshot_id")), str(tmp_path / "l"))
    assert (tmp_path / "l" / "network=N" / "snapshot_id=4").is_dir()


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_names_and_hashes(spark):
    assert column(spark, [None, " ", "La-Ref 1", "ñ"], text.sanitize_acronym) == ["UNKNOWN", "UNKNOWN", "LA-REF_1", "_"]
    assert column(spark, ["abc", None], text.xxhash64_seed0) == ["44BC2CF5AD770999", None]
    assert column(spark, ["oai:repo.example.org:12", "none"], text.domain_of) == ["repo.example.org", "No clasificados"]
    assert column(spark, ["x"], lambda v: text.fingerprint(F.lit(None).cast("string"), v, "p")) == ["00_" + __import__("hashlib").md5(b"px").hexdigest()]


def test_tokens(spark):
    assert column(spark, [None, " ", "hello", "one two, three.", "日本語", "don't"], text.token_estimate) == [0, 0, 2, 4, 4, 2]
    assert [text.estimate(s) for s in (" ", "hello", "one two, three.", "日本語")] == [0, 2, 4, 4]


def test_chunks(spark):
    sentence = " ".join(f"word{i}" for i in range(20)) + "."
    abstract = " ".join([sentence] * 12)
    df = spark.createDataFrame([("Title", abstract), ("Title", " "), (None, "x"), ("T", " ".join(f"w{i}" for i in range(320)))], "t string, a string")
    out = [r[0] for r in df.select(text.chunks(F.col("t"), F.col("a"))).collect()]
    assert [len(c) for c in out] == [3, 0, 0, 3] and all(c.startswith("Title\n") for c in out[0])
    assert all(text.estimate(c.split("\n", 1)[1]) <= 128 for cs in out for c in cs)
    assert " ".join(c.split("\n", 1)[1] for c in out[0]) == abstract


def test_normalise(spark):
    assert column(spark, ["étude exam-\n  ple  of\t it "], text.normalise) == ["étude example of it"]


def test_codec_drops_what_it_cannot_keep(spark):
    out = column(spark, ["a:1, 2;b:;junk;a:3", "", None], text.decode_occurrences)
    assert out == [{"b": [], "a": ["3"]}, {}, {}]


@pytest.mark.parametrize("value", ["2020", "2020-01", "2020/01", "2020-01-01", "2020/01/01", "01/01/2020", "1/1/2020", "1/01/2020", "2020-01-01T00:00:00Z", "2020-01-01 00:00:00.000", "01Jan2020:00:00:00.000"])
def test_date_forms(spark, value):
    assert str(column(spark, [value], dates.parse_date)[0]) == "2020-01-01 00:00:00"


def test_dates(spark):
    assert column(spark, ["junk", None, "2020-13-01"], dates.is_date) == [False, False, False]
    assert column(spark, ["2020-05-06 07:08:09"], lambda v: dates.format_for(v.cast("timestamp"), None)) == ["2020-05-06T07:08:09Z"]
    assert column(spark, ["2020-05-06 07:08:09"], lambda v: dates.format_for(v.cast("timestamp"), "yyyy-MM-ddTHH")) == ["2020-05-06T07"]
    assert [str(d) for d in column(spark, ["3-4-2020", "2020/4/3 5:6", "3 4 2020"], dates.parse_legacy)] == ["2020-04-03 00:00:00", "2020-04-03 05:06:00", "2020-04-03 00:00:00"]


def test_logs(spark, tmp_path):
    (tmp_path / "log").write_text("[2025-11-12 12:45:30.123] one\nplain\n\n[2025-11-13 00:00:00.000] two ] x\n")
    assert [(r["timestamp"], r["message"]) for r in files.read_log(spark, str(tmp_path / "log")).collect()] == [("plain", "plain"), ("2025-11-13 00:00:00.000", "two ] x"), ("2025-11-12 12:45:30.123", "one")]
    assert column(spark, ["a\r\nb\nc"], lambda v: files.log_line(v, F.lit("2020-01-01").cast("timestamp"))) == ["[2020-01-01 00:00:00.000] a b c"]


def test_side_inputs(spark, tmp_path):
    (tmp_path / "values").write_text("a\n\nb\n")
    (tmp_path / "pairs").write_text("a\tx\nalone\nb\ty\n")
    assert [r[0] for r in files.read_values(spark, str(tmp_path / "values")).collect()] == ["a", "b"]
    assert [tuple(r) for r in files.read_translations(spark, str(tmp_path / "pairs")).collect()] == [("a", "x"), ("b", "y")]
    assert files.file_count(spark, str(tmp_path)) == 2


def test_page_text(spark):
    assert column(spark, ["<html><script>x<y</script><p>A &amp;&nbsp;B</p><!-- c --></html>"], files.page_text) == ["A & B"]


BITSTREAMS = """<metadata><element name="bundles"><element name="bundle"><field name="name">ORIGINAL</field><element name="bitstreams">
<element name="bitstream"><field name="name">a.pdf</field><field name="url">http://h/a%20b.pdf</field><field name="checksum">c1</field><field name="format">text/plain</field><field name="sid">1</field></element>
<element name="bitstream"><field name="name">b.pdf</field><field name="url">http://h/b.pdf</field></element></element></element></element></metadata>"""


def test_bitstreams(spark):
    rows = files.bitstreams(spark.createDataFrame([("r", BITSTREAMS)], "record_id string, xml string")).orderBy("filename").collect()
    assert [(r["type"], r["filename"], r["url"], r["mime"]) for r in rows] == [("ORIGINAL", "a.pdf", "http://h/a b.pdf", "text/plain"), ("ORIGINAL", "b.pdf", "http://h/b.pdf", "application/pdf")]
    assert rows[0]["checksum"] == "c1" and rows[1]["checksum"] == __import__("hashlib").md5(b"http://h/b.pdf").hexdigest()


def page(*records, token=""):
    return f'<OAI-PMH xmlns="http://o/"><ListRecords>{"".join(records)}<resumptionToken>{token}</resumptionToken></ListRecords></OAI-PMH>'


def oai_record(identifier, metadata="<m/>", status="", stamp="2020-01-01T00:00:00Z"):
    header = f'<header{f" status={chr(34)}{status}{chr(34)}" if status else ""}><identifier>{identifier}</identifier><datestamp>{stamp}</datestamp></header>'
    return f"<record>{header}{f'<metadata>{metadata}</metadata>' if metadata else ''}</record>"


def test_pages_of_records(spark):
    xml = page(oai_record("a"), oai_record("b", metadata=""), oai_record("c", metadata="", status="deleted"), token="next")
    rows = oai.records(spark.createDataFrame([("p", xml)], "path string, xml string"))
    assert [(r["identifier"], r["header_status"], r["metadata"], r["resumption_token"]) for r in rows.collect()] == [("a", None, "<m/>", "next"), ("b", None, None, "next"), ("c", "deleted", None, "next")]
    assert [r["identifier"] for r in oai.missing_metadata(rows).collect()] == ["b"]
    status = lambda x: column(spark, [x], oai.page_status)[0]
    assert [status(x) for x in (xml, '<o><error code="noRecordsMatch">x</error></o>', '<o><error code="badArgument"/></o>', "<html>")] == ["OK", "NO_MATCHING_QUERY", "ERROR_FATAL", "ERROR_RETRY"]
    assert [harvest.next_step(s, n) for s, n in (("OK", 0), ("ERROR_RETRY", 1), ("ERROR_RETRY", 3), ("NO_MATCHING_QUERY", 0), ("STOP", 0), ("ERROR_FATAL", 0))] == ["continue", "retry", "fail", "finish", "stop", "fail"]
    assert [harvest.back_off(n) for n in (0, 3, 20)] == [1.0, 8.0, 300.0]


def test_records_inside_metadata_and_references_in_headers(spark):
    marc = '<marc:collection xmlns:marc="m"><marc:record type="x"><marc:leader>1</marc:leader></marc:record><metadata>in</metadata></marc:collection>'
    header = "<oai:header status='deleted'><oai:identifier>oai:x?a=1&amp;b=&#50;</oai:identifier><oai:datestamp>2020-01-01</oai:datestamp><oai:setSpec><![CDATA[s&t]]></oai:setSpec></oai:header>"
    xml = page(oai_record("a", marc), f"<oai:record>\n {header}</oai:record>", oai_record("c"), token="t&amp;u")
    rows = oai.records(spark.createDataFrame([("p", xml)], "path string, xml string")).collect()
    assert [(r["identifier"], r["metadata"], r["set_spec"], r["header_status"], r["resumption_token"]) for r in rows] == [("a", marc, None, None, "t&u"), ("oai:x?a=1&b=2", None, "s&t", "deleted", "t&u"), ("c", "<m/>", None, None, "t&u")]


def test_a_fresh_checkpoint_loses_nothing(spark, tmp_path):
    store = harvest.VersionedCatalog(spark, str(tmp_path / "catalog"), buckets=4)
    for n, names in enumerate((["a", "b"], ["c", "d", "e"])):
        pages = tmp_path / f"pages{n}"
        pages.mkdir()
        (pages / "1.xml").write_text(page(*map(oai_record, names)))
        harvest.harvest(spark, str(pages), store, str(tmp_path / f"check{n}"))
    assert sorted(r["identifier"] for r in store.read().collect()) == ["a", "b", "c", "d", "e"]
    (tmp_path / "pages1" / "2.xml").write_text(page(oai_record("f"), oai_record("a", "<m>new</m>", stamp="2022-01-01T00:00:00Z")))
    assert harvest.harvest(spark, str(tmp_path / "pages1"), store, str(tmp_path / "check1")) == 6
    assert store.read().count() == 6


def test_broken_pages_are_read_again(spark, tmp_path):
    store, pages, waits = harvest.VersionedCatalog(spark, str(tmp_path / "catalog")), tmp_path / "pages", []
    pages.mkdir()
    (pages / "1.xml").write_text("<html>busy</html>")
    (pages / "2.xml").write_text("<html>busy</html>")
    (pages / "3.xml").write_text('<o><error code="noRecordsMatch">x</error></o>')
    (pages / "4.xml").write_text(page(oai_record("a")))

    def wait(seconds):
        waits.append(seconds)
        (pages / "1.xml").write_text(page(oai_record("b")))

    assert harvest.harvest(spark, str(pages), store, str(tmp_path / "check"), wait=wait) == 2
    notes = {r["path"][-5:]: (r["status"], r["step"], r["tries"]) for r in store.notes().collect()}
    assert notes == {"1.xml": ("OK", "continue", 1), "2.xml": ("ERROR_RETRY", "fail", 3), "3.xml": ("NO_MATCHING_QUERY", "finish", 0)} and waits == [1.0, 2.0, 4.0]


def test_identify_and_sets(spark):
    pages = spark.createDataFrame([("p", "<o:OAI xmlns:o='u'><o:repositoryName>R</o:repositoryName><o:granularity>YYYY-MM-DD</o:granularity></o:OAI>")], "path string, xml string")
    assert {k: v for k, v in oai.identify(pages).first()["identify"].items() if v} == {"repositoryName": "R", "granularity": "YYYY-MM-DD"}
    pages = spark.createDataFrame([("p", "<ListSets><set><setSpec>a</setSpec><setName>A</setName></set><set><setSpec>b</setSpec></set></ListSets>")], "path string, xml string")
    assert [tuple(r) for r in oai.sets(pages).collect()] == [("a", "A"), ("b", None)]


def test_harvest_stream(spark, tmp_path):
    pages, store = tmp_path / "pages", harvest.VersionedCatalog(spark, str(tmp_path / "catalog"))
    pages.mkdir()
    (pages / "1.xml").write_text(page(oai_record("a", "<m>1</m>"), oai_record("b", "<m>1</m>"), token="x"))
    assert harvest.harvest(spark, str(pages), store, str(tmp_path / "check")) == 2
    late = "2021-01-01T00:00:00Z"
    (pages / "2.xml").write_text(page(oai_record("b", "<m>2</m>", stamp=late), oai_record("c", "<m>2</m>", stamp=late), oai_record("a", "", "deleted", late), oai_record("d", "<bad/>", stamp=late)))
    live = harvest.harvest(spark, str(pages), store, str(tmp_path / "check"), prevalid=lambda rows: ~F.col("metadata").contains("bad"))
    out = {r["identifier"]: (r["deleted"], r["original_metadata_hash"]) for r in store.read().collect()}
    md5 = lambda s: __import__("hashlib").md5(s.encode()).hexdigest().upper()
    assert live == 2 and out == {"a": (True, None), "b": (False, md5("<m>2</m>")), "c": (False, md5("<m>2</m>"))}
    assert harvest.harvest(spark, str(pages), store, str(tmp_path / "check")) == 2  # nothing waits
    store.merge(spark.createDataFrame([], harvest.CATALOG + ", seq timestamp"), 0)  # a batch that is merged already
    assert store.read().count() == 3


def test_refused_updates_leave_the_old_version(spark):
    rows = spark.createDataFrame([("a", "2020-01-01", None, "<bad/>"), ("b", None, "deleted", None)], "identifier string, datestamp string, header_status string, metadata string")
    kept = lambda **k: sorted(r["identifier"] for r in harvest.changes(rows, prevalid=~F.col("metadata").contains("bad"), **k).collect())
    assert kept(incremental=True) == ["b"] and kept(incremental=False) == []
    assert harvest.is_incremental(True, False) and not harvest.is_incremental(True, True) and not harvest.is_incremental(False, False)


def test_index(spark, tmp_path, records):
    path = str(tmp_path / "index")
    catalog.write_index(facts.index_columns(records), path, "A")
    catalog.write_index(facts.index_columns(records), path, "B")
    catalog.write_index(facts.index_columns(facts.to_index(records)), path, "A")
    assert (catalog.read_index(spark, path, "A").count(), catalog.read_index(spark, path, "B").count()) == (2, 3)
    catalog.unindex(spark, path, "B")
    assert catalog.read_index(spark, path).count() == 2
