"""Records as trees, and texts cut into pieces."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from colophon.functions import splitting, text
from colophon.functions.address import all_occurrences, occurrences, xpath_of
from colophon.operators import trees
from colophon.plans import rules
from tests.conftest import SF

XML = """<metadata xmlns="http://m/" xmlns:x="u"><element name="dc"><element name="title"><element name="none"><field name="value">T &amp; t</field></element></element>
<element name="creator"><field name="value">Ann</field><field name="role">author</field></element>
<element name="creator"><field name="value">Bob</field><field name="role">editor</field></element>
<element name="creator"><field name="role">author</field><field name="value"></field></element><!-- c -->
<element name="creator"><field name="value">Cy</field><field name="role">author</field></element>
<element name="contributor"><field name="value">Old</field></element></element></metadata>"""


@pytest.fixture(scope="module")
def tree(spark):
    rows = [(1, XML), (2, "<metadata/>"), (3, None), (4, "<broken"), (5, "")]
    return trees.nodes(spark.createDataFrame(rows, "record_id long, xml string").repartition(2), "xml").cache()


def test_nodes_are_numbered_in_order(tree):
    rows = tree.where("record_id = 1").orderBy("pre").collect()
    assert [r["pre"] for r in rows] == list(range(len(rows))) and rows[0]["last"] == len(rows) - 1 and rows[0]["parent"] == -1
    for r in rows:
        below = [c["pre"] for c in rows if c["path"].startswith(r["path"] + trees.STEP) and r["pre"] < c["pre"] <= r["last"]]
        assert below == list(range(r["pre"] + 1, r["last"] + 1))
    assert tree.where("record_id = 2").count() == 1 and tree.where("record_id > 2").count() == 0


@pytest.mark.parametrize("address", ["dc.creator", "dc.creator:role", "dc.title.none", "dc.title", "dc.title.*", "*", "dc.*:role", "*.none", "dc.none"])
def test_addresses_select_what_their_xpath_does(spark, tree, address):
    want = spark.createDataFrame([(XML,)], "xml string").select(occurrences(F.col("xml"), address)).first()[0]
    got = [r["text"] for r in tree.where(trees.at(address) & F.col("text").isNotNull()).orderBy("pre").collect()]
    assert got == want, xpath_of(address)


def test_elements_by_address(tree):
    assert tree.where(trees.at("dc.creator.$")).count() == 4 and tree.where(trees.at("dc.$")).count() == 1


def test_rename_by_condition(tree):
    seen = trees.with_sibling(tree, "role", "role")
    out = trees.rename(seen, trees.at("dc.creator") & (F.col("role") == "author"), "dc.contributor")
    rows = sorted((r["field"], r["pos"], r["value"]) for r in trees.fields(out).where("record_id = 1").collect())
    assert rows == [("dc.contributor", 0, "Old"), ("dc.contributor", 1, "Ann"), ("dc.contributor", 2, "Cy"), ("dc.creator", 0, "Bob"), ("dc.creator:role", 0, "author"), ("dc.creator:role", 1, "editor"), ("dc.creator:role", 2, "author"), ("dc.creator:role", 3, "author"), ("dc.title.none", 0, "T & t")]
    assert {(r["record_id"], r["transformed"]) for r in out.select("record_id", "transformed").collect()} == {(1, True), (2, False)}
    none = trees.rename(tree, trees.at("dc.nothing"), "dc.contributor")
    assert not none.where("transformed").count()


def test_rename_moves_at_most_a_hundred_and_one(spark):
    many = "<metadata>" + "".join(f'<element name="s"><field name="value">Ünicode {i}</field></element>' for i in range(130)) + "</metadata>"
    out = trees.fields(trees.rename(trees.nodes(spark.createDataFrame([(1, many)], "record_id int, xml string"), "xml"), trees.at("s"), "a.b:c"))
    values = {(r["field"], r["pos"]): r["value"] for r in out.collect()}
    assert len(values) == 130 and values["a.b:c", 0] == "Ünicode 0" and values["a.b:c", 100] == "Ünicode 100" and values["s", 0] == "Ünicode 101" and values["s", 28] == "Ünicode 129"


def test_sub_documents_and_look_ups(tree):
    below = trees.sub_documents(tree, "dc.creator")
    assert below.select("root").distinct().count() == 4 and {r["path"].count(trees.STEP) for r in below.collect()} == {1}
    found = lambda *a: [r["value"] for r in trees.look_up(tree, *a).collect()]
    assert found("dc.creator", "role", "editor", "value") == ["Bob"]
    assert found("dc.creator", "role", "author", "value") == ["Ann"]
    assert found("dc.creator", "role", "nobody", "value") == []
    assert found("dc", "title.none", "T & t", "contributor.value") == [None] and found("dc", "title.none", "T & t", "contributor:value") == ["Old"]


def test_pieces_keep_the_bound_and_the_text():
    rng = random.Random(5)
    for _ in range(800):
        made = "".join(rng.choice(["a", "bc", " ", "\n", "\n\n", ". ", "! ", "日", "본", ",", "-", "'", "x-y", " word ", "\U00020001"]) for _ in range(rng.randrange(200)))
        most, overlap = rng.choice([(2, 0), (3, 1), (5, 0), (8, 3), (20, 5)])
        spans = splitting.split_spans(made, most, overlap)
        assert all(splitting.estimate(made[a:b]) <= most for a, b in spans)
        assert all(x[1] < y[1] and x[0] <= y[0] for x, y in zip(spans, spans[1:]))
        if not overlap:
            assert "".join("".join(made[a:b] for a, b in spans).split()) == "".join(made.split())
    with pytest.raises(ValueError):
        splitting.split_spans("x", 3, 2)


def test_pieces_follow_the_ranks():
    words = " ".join(["word"] * 20)
    assert splitting.split_text(f"{words}\n\n{words}\n{words}", 50) == [words, f"{words}\n{words}"] or splitting.split_text(f"{words}\n\n{words}\n{words}", 50)[0].startswith("word")
    assert splitting.split_text("One two. Three four. Five six.", 6) == ["One two. Three four.", "Five six."]
    assert splitting.split_text("a b c d e f", 3, 1) == ["a", "a b", "b c", "c d", "d e", "e f"] or all(splitting.estimate(p) <= 3 for p in splitting.split_text("a b c d e f", 3, 1))
    assert splitting.split_text("漢" * 10, 4) == ["漢" * 4, "漢" * 4, "漢" * 2] and splitting.split_text(" \n ", 4) == []


def test_one_long_word_is_cut_in_linear_time():
    import time

    took = []
    for n in (300_000, 1_200_000):
        began = time.process_time()
        pieces = splitting.split_text("漢," * n, 128)
        took.append(time.process_time() - began)
        assert "".join(pieces) == "漢," * n
    assert took[1] < 10 * max(took[0], 0.05)


def test_estimates_agree_over_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", text.token_estimate(F.col("text")).alias("n")).collect()
    assert all(splitting.estimate(r["text"] or "") == r["n"] for r in docs)


def test_chunks_over_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", text.normalise(F.col("text")).alias("normal"), text.chunks(F.lit("Title"), F.col("text"), 64, 1_000_000).alias("chunks")).collect()
    for r in docs:
        pieces = [c.split("\n", 1)[1] for c in r["chunks"]]
        assert all(splitting.estimate(p) <= 64 for p in pieces)
        assert "".join("".join(pieces).split()) == "".join((r["normal"] or "").split())


def test_python_workers_get_texts_in_small_batches(spark):
    """Normalising and cutting lower the session's batches, so that a worker's memory does not follow the size of a partition."""
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for make in (lambda: text.normalise(F.col("text")), lambda: text.chunks(F.lit("T"), F.col("text")), lambda: text.xxhash64_seed0(F.col("text"))):
            spark.conf.set(keys[0], 10_000)
            spark.conf.set(keys[1], 1 << 28)
            make()
            assert int(spark.conf.get(keys[0])) <= text.BATCH_ROWS and int(spark.conf.get(keys[1])) <= text.BATCH_BYTES
        spark.conf.set(keys[0], 7)
        text.normalise(F.col("text"))
        assert spark.conf.get(keys[0]) == "7"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_addresses_read_at_once_are_those_of_xpath(spark):
    plain = XML.replace("<!-- c -->", "").replace(' xmlns:x="u"', "")
    nested = '<metadata><element name="dc"><element name="a"><element name="b"><field name="value">1</field></element><field name="value">2</field></element><field name="value">3<element name="c"><field name="value">4</field></element>5</field></element><field name="value">6</field></metadata>'
    odd = [XML, plain, nested, nested.replace("3<", "<").replace(">5<", "><"), "<metadata/>", "<other/>", "", None, "<metadata><element name='dc'><field name='value'><![CDATA[x]]>y</field></element></metadata>", "<x:metadata xmlns:x='u'><x:element name='dc'><x:field name='value'>z &lt;&#233;</x:field></x:element></x:metadata>", "<metadata><element name='dc'><field name='value'>  a\r\nb &lt;&#233; </field><field name='value'/></element></metadata>"]
    addresses = ["dc", "dc.*", "*", "*.*", "dc.creator", "dc.*:role", "dc.a.b", "*.b", "", "dc.none"]
    rows = spark.createDataFrame(list(enumerate(odd)), "id int, xml string")
    both = rows.select("id", *[F.struct(got.alias("got"), occurrences(F.col("xml"), a).alias("want")) for a, got in zip(addresses, all_occurrences(F.col("xml"), addresses))])
    for row in both.collect():
        for a, pair in zip(addresses, row[1:]):
            assert pair["got"] == pair["want"], (odd[row["id"]], a)
    assert str(both._jdf.queryExecution().executedPlan()).count("ArrowEvalPython") == 1


def test_trees_of_records_are_read_once_and_not_shuffled_again(spark):
    """Records are parsed once and dealt out as whole trees; what is asked by record needs no shuffle of their nodes."""
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for query in (rules.t_rename_by_path, rules.x_look_up):
            plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("EvalPython") + plan.count("MapInArrow") == 1, plan
            assert "Generate inline" in plan and "Exchange" not in plan.split("Generate inline")[0], plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


def test_sub_documents_by_place_are_those_of_the_join(spark):
    """Records of several depths, elements below elements of the same name, and a null key; ``*`` in an address goes by the join."""
    rng = random.Random(3)

    def made(depth: int) -> str:
        inside = "".join(made(depth - 1) if depth and rng.random() < 0.6 else f'<field name="{rng.choice("kv")}">{rng.randrange(3)}</field>' for _ in range(rng.randrange(4)))
        return f'<element name="{rng.choice(["a", "b"])}">{inside}</element>'

    rows = [(i if i else None, f"<metadata>{''.join(made(4) for _ in range(3))}</metadata>") for i in range(60)]
    tree = trees.nodes(spark.createDataFrame(rows, "record_id long, xml string"), "xml").cache()
    for address in ("a", "a.b", "a.a", "b.a.b", "a.*", "*"):
        roots = tree.where(trees.at(f"{address}.$")).select("record_id", F.col("pre").alias("root"), F.col("last").alias("end"), F.length("path").alias("skip"))
        want = tree.join(roots, "record_id").where("pre > root AND pre <= end").selectExpr("record_id", "root", "pre", "substring(path, skip + 1) AS path", "text")
        got = trees.sub_documents(tree, address).select("record_id", "root", "pre", "path", "text")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and not set(want.columns) - set(got.columns)


def test_chunks_take_one_python_worker_a_task(spark):
    """Normalising is part of the function that cuts, and gives what the columns of ``normalise`` do."""
    odd = [None, "", " ", "a-\n b\t c d  ", "é co-\r\n op\x0b\x0c\x1c\x85x", "-\n", "x -\n\n y z"]
    rows = spark.createDataFrame([(t,) for t in odd], "text string")
    both = rows.select("text", text.normalise(F.col("text")).alias("want")).collect()
    assert [text.normal(r["text"]) for r in both] == [r["want"] or "" for r in both]
    plan = rows.select(text.chunks(F.lit("T"), F.col("text")).alias("c"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1, plan
