"""Catalogs in versions, full and late harvests, lists as a source, counters and differences."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from colophon.model import SnapshotStatus
from colophon.operators import catalog, counters, digests, facts, snapshots
from colophon.sources import lists
from colophon.streaming import harvest
from colophon.streaming.versions import Versions
from tests.test_engine import oai_record, page

ROW = "id string, identifier string, datestamp timestamp, original_metadata_hash string, deleted boolean, seq timestamp"


def delta(spark, rows):
    """(id, day, hash) rows; without a hash deleted."""
    full = [(i, f"oai:{i}", f"2020-01-{d:02}", h, h is None) for i, d, h in rows]
    return spark.createDataFrame(full, "id string, identifier string, datestamp string, original_metadata_hash string, deleted boolean").withColumn("datestamp", F.col("datestamp").cast("timestamp")).withColumn("seq", F.col("datestamp"))


def content(df):
    return {r["id"]: r["original_metadata_hash"] for r in df.collect()}


def listed(store, snapshot_id=None):
    return sorted(r["identifier"] for r in store.read(snapshot_id).where("NOT deleted").collect())


def folder(path, **pages):
    path.mkdir(exist_ok=True)
    for name, xml in pages.items():
        (path / f"{name}.xml").write_text(xml)
    return str(path)


def test_the_latest_datestamp_counts_and_then_the_later_batch(spark, tmp_path):
    store = Versions(spark, str(tmp_path))
    one = store.begin()
    want = {}
    batches = [[("a", 5, "1"), ("b", 5, "1")], [("a", 3, "late"), ("c", 1, "1")], [("b", 5, "2"), ("d", 9, None)], [("a", 7, "2")], [("d", 8, "late"), ("e", 1, "1")], [("c", 1, None)], [("e", 2, "2"), ("e", 3, "3")]]
    at = {}
    for n, batch in enumerate(batches):
        store.append(one, delta(spark, batch), n, "q")
        for i, day, h in batch:
            if day >= at.get(i, 0):
                at[i], want[i] = day, h
        assert content(store.rows(one)) == want
    store.append(one, delta(spark, [("z", 9, "again")]), 3, "q")  # known already
    assert content(store.rows(one)) == want and len({f.run for f in one.files}) < len(batches)
    assert content(store.rows(one, ["b", "d", "none"])) == {"b": "2", "d": None}
    store.append(one, delta(spark, []), 9, "q")
    assert content(store.rows(one)) == want


def test_work_follows_the_batch(spark, tmp_path):
    """A thousand ids on a catalog of a million: what is written is in proportion to the batch, and a look-up opens few files."""
    store = Versions(spark, str(tmp_path))
    first = store.begin()
    rows = lambda n, step, h: spark.range(0, n, step).select(F.md5(F.col("id").cast("string")).alias("id"), F.concat(F.lit("oai:"), F.col("id").cast("string")).alias("identifier"), F.lit("2020-01-01").cast("timestamp").alias("datestamp"), F.lit(h).alias("original_metadata_hash"), F.lit(False).alias("deleted"), F.lit("2020-01-01").cast("timestamp").alias("seq"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.append(first, rows(1_000_000, 1, "old"), 0, "q")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    base = sum(f.bytes for f in first.files)
    on_disk = lambda: sum(p.stat().st_size for p in (tmp_path / "data").rglob("*") if p.is_file())
    before, names = on_disk(), {f.path for f in first.files}
    for n in (1, 2):
        store.append(first, rows(1_000_000, 1_000, f"new{n}"), n, "q")
    written = on_disk() - before
    assert written < base / 100 and names <= {f.path for f in first.files}
    assert store.rows(first).where("original_metadata_hash = 'new2'").count() == 1_000 and store.rows(first).count() == 1_000_000
    key = "c4ca4238a0b923820dcc509a6f75849b"  # of 1
    opened = [f for f in first.files if f.low <= key <= f.high]
    assert sum(f.bytes for f in opened) < base / 2 and content(store.rows(first, [key])) == {key: "old"}


def test_a_full_harvest_begins_empty(spark, tmp_path):
    store = harvest.VersionedCatalog(spark, str(tmp_path / "catalog"))
    run = lambda n, **k: harvest.harvest(spark, str(tmp_path / f"p{n}"), store, str(tmp_path / f"c{n}"), **k)
    folder(tmp_path / "p1", x=page(oai_record("a"), oai_record("b"), oai_record("c")))
    assert run(1) == 3
    folder(tmp_path / "p2", x=page(oai_record("a", "", "deleted", "2021-01-01"), oai_record("d", stamp="2021-01-01")))
    assert run(2) == 3 and listed(store) == ["oai:b", "oai:c", "oai:d"] or listed(store) == ["b", "c", "d"]
    # Deleted at the source, and dropped without a word: neither is in a full harvest.
    folder(tmp_path / "p3", x=page(oai_record("a", "", "deleted", "2022-01-01"), oai_record("b", "", "deleted", "2022-01-01"), oai_record("d", stamp="2021-01-01")))
    assert run(3, force_full=True) == 1 and listed(store) == ["d"]
    assert listed(store, 1) == ["a", "b", "c"] and listed(store, 2) == ["b", "c", "d"]
    table = {r["id"]: (r["previous_id"], r["status"], r["size"]) for r in store.snapshots().collect()}
    assert table == {1: (None, 4, 3), 2: (1, 4, 3), 3: (None, 4, 1)}
    store.finish(store._load(store._manifests()[2]), SnapshotStatus.VALID, 3)  # validated: the last good one
    assert store.clean() == [1, 3] and listed(store, 2) == ["b", "c", "d"] and listed(store) == ["b", "c", "d"]
    runs = {f.path.split("/")[0] for f in store.all()[0].files}
    assert {p.name for p in (tmp_path / "catalog" / "data").iterdir()} == runs


def test_nothing_found_in_full_fails_and_is_not_inherited_from(spark, tmp_path):
    store = harvest.VersionedCatalog(spark, str(tmp_path / "catalog"))
    assert harvest.harvest(spark, folder(tmp_path / "p", x=page(oai_record("a"))), store, str(tmp_path / "c1")) == 1
    nothing = folder(tmp_path / "q", x='<o><error code="noRecordsMatch">x</error></o>')
    assert harvest.harvest(spark, nothing, store, str(tmp_path / "c2"), force_full=True) == 0
    assert [s.status for s in store.all()] == [4, 3] and listed(store) == ["a"]
    assert harvest.harvest(spark, nothing, store, str(tmp_path / "c3")) == 1  # incremental: nothing new is no failure
    assert [(s.status, s.previous_id) for s in store.all()] == [(4, None), (3, None), (4, 1)]


def test_a_page_read_late_brings_no_older_record_back(spark, tmp_path):
    store, pages = harvest.VersionedCatalog(spark, str(tmp_path / "catalog")), tmp_path / "pages"
    folder(pages, p1="<html>busy</html>", p2=page(oai_record("a", "<m>2022</m>", stamp="2022-01-01")))

    def wait(seconds):
        (pages / "p1.xml").write_text(page(oai_record("a", "<m>2020</m>", stamp="2020-01-01"), oai_record("b")))

    assert harvest.harvest(spark, str(pages), store, str(tmp_path / "check"), wait=wait) == 2
    assert {r["identifier"]: str(r["datestamp"])[:4] for r in store.read().collect()} == {"a": "2022", "b": "2020"}


def test_a_failed_harvest_is_gone_on_with(spark, tmp_path):
    store, pages = harvest.VersionedCatalog(spark, str(tmp_path / "catalog")), tmp_path / "pages"
    folder(pages, p1="<html>busy</html>", p2=page(oai_record("a")))
    with pytest.raises(harvest.HarvestFailed, match="p1.xml"):
        harvest.harvest(spark, str(pages), store, str(tmp_path / "check"), wait=lambda s: None, strict=True)
    assert store.last() is None and [s.status for s in store.all()] == [3]
    folder(pages, p1=page(oai_record("b")))
    assert harvest.harvest(spark, str(pages), store, str(tmp_path / "check"), wait=lambda s: None, strict=True) == 2
    assert [(s.id, s.status) for s in store.all()] == [(1, 4)] and listed(store) == ["a", "b"]


class Provider:
    """Lists in a folder, one file a page; what is asked for is noted, and pages named ``broken`` fail."""

    def __init__(self, root):
        self.root = str(root)

    def __call__(self, set_spec, token):
        with open(f"{self.root}/asked", "a") as log:
            log.write(json.dumps([set_spec, token]) + "\n")
        with open(f"{self.root}/{set_spec}-{token or 0}.xml") as file:
            return file.read()

    def asked(self, since=0):
        with open(f"{self.root}/asked") as log:
            return [tuple(json.loads(line)) for line in log][since:]


def test_lists_keep_their_order_and_stop_resumes_at_the_token(spark, tmp_path):
    root = tmp_path / "provider"
    folder(root, **{f"s1-{n}": page(oai_record(f"a{n}"), oai_record("both", f"<m>s1 {n}</m>", stamp=f"2020-01-0{n + 1}"), token=str(n + 1) if n < 4 else "") for n in range(5)})
    folder(root, **{"s2-0": page(oai_record("b0"), token="1"), "s2-1": page(oai_record("b1", "", "deleted"), oai_record("b2"))})
    folder(root, **{"none-0": '<o><error code="noRecordsMatch">x</error></o>'})
    (root / "s1-3.xml").rename(root / "hidden")
    provider, store, marks = Provider(root), harvest.VersionedCatalog(spark, str(tmp_path / "catalog")), []
    fetch_since = lambda mark: marks.append(mark) or provider
    run = lambda **k: harvest.harvest_lists(spark, fetch_since, ["s1", "s2", "none"], store, str(tmp_path / "check"), pages=2, tries=2, wait=lambda s: None, **k)
    with pytest.raises(harvest.HarvestFailed, match="s1#3"):
        run(strict=True)
    asked = provider.asked()
    assert [t for s, t in asked if s == "s1"] == ["", "1", "2", "3", "3"] and [t for s, t in asked if s == "s2"] == ["", "1"] and [t for s, t in asked if s == "none"] == [""]
    assert [s.status for s in store.all()] == [3] and store.last() is None
    (root / "hidden").rename(root / "s1-3.xml")
    assert run(strict=True) == 8
    assert provider.asked(len(asked)) == [("s1", "3"), ("s1", "4")]
    assert listed(store) == ["a0", "a1", "a2", "a3", "a4", "b0", "b2", "both"]
    assert {str(r["datestamp"])[:10] for r in store.read().where("identifier = 'both'").collect()} == {"2020-01-05"}
    # The next harvest is incremental, asks from the start of the last one on, and takes deletions.
    folder(root, **{"s1-0": page(oai_record("a0", "", "deleted", "2021-01-01")), "s2-0": page(oai_record("b9"))})
    assert run() == 8 and listed(store) == ["a1", "a2", "a3", "a4", "b0", "b2", "b9", "both"]
    assert marks[:2] == [None, None] and marks[2] == store.all()[0].start_time[:19] + "Z"
    assert run(full=True) == 1 and listed(store) == ["b9"] and marks[3] is None


def test_pages_are_judged_alike_in_python_and_in_columns(spark):
    from colophon.sources import oai

    pages = [page(oai_record("a"), token="t&amp;u"), page(oai_record("a")), '<o><error code="noRecordsMatch">x</error></o>', "<o><error code='badArgument'/></o>", "<html>", ""]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, xml string")
    assert [r["s"] for r in df.orderBy("i").select(oai.page_status(F.col("xml")).alias("s")).collect()] == [lists.status_of(p) for p in pages]
    assert [lists.next_token(p) for p in pages] == ["t&u", None, None, None, None, None]


RECORDS = "identifier_hash string, is_valid boolean, is_transformed boolean, rule_1 boolean, rule_2 boolean, details array<struct<rule_id: bigint, value: string, is_valid: boolean>>"


def test_counters_by_difference_equal_a_recount(spark):
    row = lambda i, v, t, a, b, *values: (f"h{i}", v, t, a, b, [(1, x, a) for x in values])
    was = [row(1, True, False, True, True, "x"), row(2, False, False, False, True, "x", "y"), row(3, True, True, True, False, "y"), row(4, True, True, True, True)]
    now = [row(1, True, False, True, True, "x"), row(2, True, False, True, True, "x"), row(5, False, True, False, False, "z"), row(3, True, True, True, False, "y")]
    old, new = (spark.createDataFrame(r, RECORDS) for r in (was, now))
    occurred = facts.rule_occurrences
    changed = spark.createDataFrame([("h2",), ("h4",), ("h5",), ("h3",), ("h3",)], "identifier_hash string")  # h3 is named and has not changed
    before, after = counters.of_changed(old, changed), counters.of_changed(new, changed)
    out = counters.moved(counters.counted(old, occurred(old)), before, after, occurred(before), occurred(after))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(out) == rows(counters.counted(new, occurred(new)))
    from colophon.operators import stats

    assert rows(counters.page_facets(out)) == rows(stats.facets(new))
    assert [tuple(r) for r in counters.occurrence_counts(out, 1).collect()] == [tuple(r) for r in stats.occurrence_counts(occurred(new), 1).select("is_valid", "occurrence_value", "n").collect()]
    assert rows(counters.moved(out, new, new.limit(0), occurred(new), occurred(new.limit(0)))) == []


def test_difference_reads_no_bucket_that_is_equal(spark, tmp_path):
    schema = "id string, original_metadata_hash string, deleted boolean"
    was = [(f"k{i}", f"h{i}", False) for i in range(400)] + [("gone", "h", False), ("dead", None, True), ("back", None, True)]
    now = [(f"k{i}", "new" if i == 7 else f"h{i}", False) for i in range(400)] + [("added", "h", False), ("back", "h", False)]
    for name, rows in (("was", was), ("now", now)):
        digests.write_buckets(spark.createDataFrame(rows, schema), str(tmp_path / name), buckets=64)
    changed = digests.bucketed_difference(spark, str(tmp_path / "was"), str(tmp_path / "now"))
    assert sorted(map(tuple, changed.collect())) == [("added", "new"), ("back", "new"), ("gone", "deleted"), ("k7", "changed")]
    whole = snapshots.difference(*(spark.createDataFrame(r, schema) for r in (was, now)))
    assert sorted(map(tuple, digests.bucketed_difference(spark, str(tmp_path / "was"), str(tmp_path / "now"), with_same=True).collect())) == sorted(map(tuple, whole.collect()))
    opened = {f.split("bucket=")[1].split("/")[0] for f in changed.inputFiles()}
    touched = {str(r[0]) for r in spark.createDataFrame([("gone",), ("added",), ("back",), ("k7",)], "id string").select(digests.bucket_of("id", 64)).collect()}
    assert touched <= opened
    plan = changed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan
    tree = digests.digests(spark.read.parquet(str(tmp_path / "was" / "rows")).where("NOT deleted"), ["id", "original_metadata_hash"], level=16)
    assert tree.count() == 4 and tree.agg(F.sum("n")).first()[0] == 401


def test_upsert_of_the_catalog_module_is_unchanged(spark):
    base = spark.createDataFrame([("1", "a")], "id string, content string")
    assert sorted(map(tuple, catalog.upsert(base, spark.createDataFrame([("1", "b", 1)], "id string, content string, seq int")).collect())) == [("1", "b")]


def test_a_small_batch_is_few_tasks(spark, tmp_path):
    """Whatever the session's number of partitions: appending and merging a few rows is a few tasks, each a result for the driver."""
    store, context, before = Versions(spark, str(tmp_path)), spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    one = store.begin()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        context.setJobGroup("few-tasks", "")
        for n in range(4):
            store.append(one, delta(spark, [(f"i{k}", 1 + n, str(n)) for k in range(n, n + 3)]).coalesce(1), n, "q")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds}
    tasks = [i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i]
    assert tasks and sum(tasks) < 60 and len({f.run for f in one.files}) < 4
    assert content(store.rows(one)) == {"i0": "0", "i1": "1", "i2": "2", "i3": "3", "i4": "3", "i5": "3"}
