"""Contains search, page directories, prefix tables, URL checks by host, Bloom filters, transformers in turn."""

from __future__ import annotations

import socket

import pytest
from pyspark.sql import functions as F

from colophon.operators import catalog, contains, facts, stats
from colophon.operators import transformers as t
from colophon.operators import validators as v
from tests.conftest import SF


@pytest.fixture(scope="module")
def named(spark):
    names = [None, "", "ab", "abc", "ABCdef", "xx_abc%yy", "a\\bc", "Straße ABC", "ÄBC äbc", "aXc", "abcabcabc", "İstanbul"]
    return spark.createDataFrame(list(enumerate(names)), "id int, name string").cache()


@pytest.mark.parametrize("pattern", ["%abc%", "ABC%", "%a_c%", "%ab%", "%c%d%", "%abc\\%yy", "%\\_abc%", "a\\\\bc", "%abc%abc%", "%äbc%", "%İsta%", "%none%", "", "%", "abc"])
def test_contains_by_pieces_is_the_scan(named, pattern):
    want = sorted(r["id"] for r in named.where(F.col("name").ilike(pattern)).collect())
    assert sorted(r["id"] for r in contains.search(named, contains.index(named, "id", "name"), "id", "name", pattern).collect()) == want


def test_pieces_of_patterns():
    assert contains.pieces("%Abcd%x_yz1\\%%") == ["abc", "bcd", "yz1", "z1%"] and contains.pieces("%ab%é12%") == []


def test_page_directory(spark):
    rows = spark.range(0, 2000, 1, 7).select(F.md5(F.col("id").cast("string")).alias("key"), "id")
    for size in (1, 30, 1999, 5000):
        some = rows.where("id < 40") if size == 1 else rows
        directory = stats.page_directory(some, "key", size).cache()
        pages = -(-some.count() // size)
        assert sorted(r["page"] for r in directory.collect()) == list(range(pages))
        for number in {0, pages // 2, pages - 1}:
            out = stats.directory_page(some, directory, number, "key")
            assert sorted(r["key"] for r in out.collect()) == [r["key"] for r in stats.page(some, number, size, "key").collect()]
        assert stats.directory_page(some, directory, pages, "key").count() == 0
    assert stats.page_directory(rows.limit(0), "key", 10).count() == 0


def test_prefix_table_is_the_literal_form(spark):
    keys = {"a": "1", "Ab": "2", "ab": "3", "abc": "4", "z": "5", "zebra": "6", "é": "7"}
    values = ["abcd", "Abx", "b", "", "zebr", "zebras", "éa", "ABC"]
    records = spark.createDataFrame([(i, [x]) for i, x in enumerate(values)], "record_id int, occ array<string>")
    literal = t.transform(records.withColumn("out", F.array().cast("array<string>")), [t.Translate(test_field="occ", write_field="out", dictionary=keys, as_prefix=True, replace=False)])
    want = {r["record_id"]: r["out"] for r in literal.collect()}
    table = spark.createDataFrame(list(keys.items()), "key string, value string")
    got = {i: [] for i in want}
    for r in sorted(t.translate_by_prefix(records.select("record_id", F.explode("occ").alias("value")), table).collect(), key=lambda r: (r["record_id"], r["place"])):
        got[r["record_id"]].append(r["translated"])
    assert got == want


def test_a_large_prefix_table_is_joined(spark):
    keys = spark.range(100_000).select(F.concat(F.lit("k"), F.lpad("id", 6, "0")).alias("key"), F.col("id").cast("string").alias("value"))
    found = t.translate_by_prefix(spark.createDataFrame([("k000123-x",), ("k09",)], "value string"), keys)
    assert [tuple(r) for r in found.collect()] == [("k000123-x", "k000123", "123", 0)]


@pytest.mark.parametrize("settings", [{}, {"small": 0}])
def test_beginnings_are_never_broadcast(spark, settings):
    """Whatever the sizes: few occurrences and many keys, which Spark alone would join by a broadcast of the beginnings."""
    keys = spark.range(20_000).select(F.concat(F.lit("k"), F.lpad("id", 6, "0")).alias("key"), F.repeat(F.col("id").cast("string"), 20).alias("value"))
    occurrences = spark.range(50).select(F.concat(F.lit("k"), F.lpad("id", 6, "0"), F.lit("-x")).alias("value"))
    found = t.translate_by_prefix(occurrences, keys, **settings)
    assert sorted(tuple(r)[1:] for r in found.collect()) == [(f"k{i:06d}", str(i) * 20, 0) for i in range(50)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and ("BuildRight" in plan) == (not settings)


def test_of_keys_equal_but_for_case_the_last_counts(spark):
    keys = spark.createDataFrame([("RF", "a", 2), ("rf", "b", 1), ("x", "c", 0)], "key string, value string, n int")
    occurrences = spark.createDataFrame([("Rf",), ("X",), ("y",)], "value string")
    rows = lambda order: {r["value"]: r["translated"] for r in t.translate_by_table(occurrences, keys, order).collect()}
    assert rows("n") == {"Rf": "a", "X": "c", "y": None} and rows(None) == {"Rf": "b", "X": "c", "y": None}


def opener(url):
    host = url.split("://")[1].split("/")[0]
    if host == "gone":
        raise socket.gaierror("unknown")
    if host == "down":
        raise ConnectionRefusedError
    if host == "odd":
        raise KeyError(url)
    codes = {"ok": (200, None), "missing": (404, None), "moved": (301, "http://h/ok"), "twice": (302, "http://h/moved"), "other": (303, "http://h/missing"), "nowhere": (301, None), "permanent": (307, "http://h/ok")}
    return codes[url.rsplit("/", 1)[1]]


def test_urls_by_host(spark, tmp_path):
    want = {"http://h/ok": "OK", "http://h/missing": "ERROR", "http://h/moved": "OK", "http://h/twice": "ERROR", "http://h/other": "ERROR", "http://h/permanent": "ERROR", "http://gone/": "UnknownHost", "https://down/x": "ConnectionError", "ftp://odd/x": "UnknownError", "no url": "MalformedURL", "": "MalformedURL", None: "NULL"}
    log = str(tmp_path / "log")

    def asked(url):
        with open(log, "a") as out:
            out.write(url + "\n")
        return opener(url)

    rows = spark.createDataFrame([(i, u) for i, u in enumerate([*want, *want])], "id int, url string")
    out = v.check_urls_by_host(rows, "url", asked, per_second=1000).collect()
    assert len(out) == 2 * len(want) and {r["url"]: r["url_status"] for r in out} == want
    lines = open(log).read().split()
    assert lines.count("http://gone/") == 1 and lines.count("http://h/missing") == 2  # once for itself, once as where another leads


def test_hosts_wait_for_themselves(spark):
    """With a clock that stands still, every request of a host but its first waits a whole interval."""
    rows = spark.createDataFrame([(f"http://{h}/ok",) for h in ("a", "b")] + [(f"http://a/{i}/ok",) for i in range(3)], "url string").coalesce(1)

    def wait(seconds):
        raise TimeoutError(seconds)

    out = {r["url"]: r["url_status"] for r in v.check_urls_by_host(rows.where("url NOT LIKE '%/1/%' AND url NOT LIKE '%/2/%' AND url NOT LIKE '%/0/%'"), "url", opener, 0.001, wait).collect()}
    assert set(out.values()) == {"OK"}
    with pytest.raises(Exception, match="TimeoutError"):
        v.check_urls_by_host(rows, "url", opener, 0.001, wait).collect()


def test_a_look_up_reads_few_rows(spark, tmp_path):
    rows = spark.range(0, 200_000, 1, 4).select(F.md5(F.col("id").cast("string")).alias("id"), F.concat(F.lit("oai:"), F.col("id").cast("string")).alias("identifier"))
    catalog.write_for_look_up(rows, str(tmp_path / "c"), rows_per_group=10_000)
    for condition, n in ((F.col("identifier") == "oai:77", 1), (F.col("id") == "f457c545a9ded88f18ecee47145a72c0", 1), (F.col("identifier") == "oai:none", 0)):
        found = spark.read.parquet(str(tmp_path / "c")).where(condition)
        assert len(found.collect()) == n
        read = [int(m.value()) for m in _metrics(spark, found)]
        assert read and max(read) <= 30_000


def _metrics(spark, df):
    """The output rows of the scans of a plan that has run."""
    plan = df._jdf.queryExecution().executedPlan()
    nodes, out = [plan], []
    while nodes:
        node = nodes.pop()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
        if "Scan" in node.nodeName():
            out.append(node.metrics().apply("numOutputRows"))
    return out


def test_expression_details_and_transformers_in_turn(spark):
    records = spark.createDataFrame([(1, ["x"], [], "2020-01-01"), (2, [], ["y"], "2020-01-01")], "record_id int, a array<string>, b array<string>, datestamp string")
    rule = v.FieldExpression(rule_id=4, expression="a=='x' AND (b=='y' OR NOT c=%'.*')", store_occurrences=True)
    out = {r["record_id"]: [d["value"] for d in r["details"]] for r in v.validate(records, [rule], details=True).collect()}
    assert out == {1: ["no_occurrences_found"] * 2, 2: ["no_occurrences_found"] * 2}
    assert v.validate(records, [v.FieldExpression(rule_id=1, expression="broken", store_occurrences=True)], details=True).first()["details"] == []
    step = lambda a, b: [t.Translate(test_field="a", write_field="a", dictionary={a: b})]
    moved = {r["record_id"]: (r["a"], r["datestamp"], r["is_transformed"]) for r in t.transform_in_turn(records, step("x", "y"), step("y", "z"), F.lit("2024")).collect()}
    assert moved == {1: (["z"], "2024", True), 2: ([], "2020-01-01", False)}


def test_index_documents(spark):
    records = spark.createDataFrame([("h1", "i1", True), ("h2", "i2", True), ("h3", "i3", False), ("h4", "i4", True)], "identifier_hash string, identifier string, is_valid boolean")
    vectors = spark.createDataFrame([("h1", [1.0, 2.0]), ("h2", [1.0]), ("h3", [1.0, 2.0])], "identifier_hash string, embedding array<float>")
    out = facts.index_documents(records, vectors, "N", 2)
    assert sorted(map(tuple, out.collect())) == [("N_h1", "i1", "N", [1.0, 2.0]), ("N_h2", "i2", "N", None), ("N_h4", "i4", "N", None)]
    assert spark.read.parquet(f"{SF}/embeddings.parquet").count() > 0
