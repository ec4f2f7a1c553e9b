"""Harvesting as a stream: each micro-batch of pages becomes tombstones and upserts of a snapshot of the catalog.

A harvest writes a snapshot of its own. An incremental one begins with what the last good one has; a full one begins
empty, so what the provider has dropped is gone. A snapshot counts once it is finished; one that was stopped or failed
is gone on with by the next harvest of the same checkpoint. A batch is written with its query and number, so one that
runs again is known. Pages that are no good pages are noted with what they lead to.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions.dates import format_for, parse_date
from colophon.functions.text import content_hash
from colophon.model import SnapshotStatus
from colophon.operators.catalog import catalog_rows
from colophon.sources import lists, oai
from colophon.streaming.versions import CATALOG, Snapshot, Versions

__all__ = ["CATALOG", "HarvestFailed", "VersionedCatalog", "harvest", "harvest_lists"]


def changes(rows: DataFrame, incremental: bool, prevalid: Column | None = None) -> DataFrame:
    """Catalog rows of harvested records, with ``seq``: live ones with metadata that pass the check, and tombstones.

    A refused update leaves what the catalog has. A full harvest begins empty and needs no tombstones.
    """
    at = parse_date(F.col("datestamp"))
    gone = oai.is_deleted()
    wanted = F.col("metadata").isNotNull() & (F.lit(True) if prevalid is None else F.coalesce(prevalid, F.lit(False)))
    kept = rows.where((gone & F.lit(incremental)) | (~gone & wanted)).where("identifier IS NOT NULL")
    order = F.col("seq") if "seq" in rows.columns else F.coalesce(at, F.lit(0).cast("timestamp"))
    return kept.select(*catalog_rows(F.col("identifier"), F.coalesce(at, F.lit(0).cast("timestamp")), F.col("metadata"), gone), order.alias("seq"))


def contents(rows: DataFrame, network: str) -> DataFrame:
    """What the content store must hold for harvested records."""
    return rows.where(~oai.is_deleted() & F.col("metadata").isNotNull()).select(F.lit(network).alias("network"), content_hash(F.col("metadata")).alias("hash"), F.col("metadata").alias("content"))


def since(rows: DataFrame, mark: Column, column: str = "datestamp") -> DataFrame:
    """Rows at or after the high-water mark."""
    return rows.where(F.col(column) >= mark)


def is_incremental(has_previous: bool, force_full: bool) -> bool:
    return has_previous and not force_full


def next_step(status: str, tries: int = 0, most_tries: int = 3) -> str:
    """What a page's status leads to: continue, retry, finish, fail or stop."""
    if status == "ERROR_RETRY":
        return "retry" if tries < most_tries else "fail"
    return {"OK": "continue", "NO_MATCHING_QUERY": "finish", "STOP": "stop"}.get(status, "fail")


def back_off(tries: int, base: float = 1.0, most: float = 300.0) -> float:
    """Seconds before a try."""
    return min(base * 2**tries, most)


class HarvestFailed(RuntimeError):
    """A harvest ended with pages that could not be read; they are named."""


class VersionedCatalog(Versions):
    """A catalog in versions, with notes about pages. ``buckets`` is taken for older callers; runs are cut by size."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, network_id: int = 0):
        super().__init__(spark, path, network_id)

    def merge(self, delta: DataFrame, batch: int, query: str = "") -> None:
        """One batch as a snapshot of its own; a batch of a query that has been merged already is left alone."""
        if any(s.batches.get(query, -1) >= batch for s in self.all()):
            return
        snapshot = self.begin()
        self.append(snapshot, delta, batch, query)
        self.finish(snapshot)

    def note(self, pages: DataFrame, tries: int, most_tries: int = 3, source: str = "") -> None:
        """Append pages (path, status) that gave no records, with the step that follows."""
        step = F.when(F.col("status") == "ERROR_RETRY", next_step("ERROR_RETRY", tries, most_tries))
        for status in ("OK", "NO_MATCHING_QUERY", "STOP", "ERROR_FATAL"):
            step = step.when(F.col("status") == status, next_step(status))
        pages.select("path", "status", F.lit(tries).alias("tries"), step.alias("step"), F.lit(source).alias("source"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.path}/notes")

    def notes(self) -> DataFrame:
        """The last note of every page that is no good page."""
        there = f"{self.path}/notes"
        empty = self.spark.createDataFrame([], "path string, status string, tries int, step string, source string, at timestamp")
        rows = self.spark.read.schema(empty.schema).parquet(there) if self._names("notes") else empty
        return rows.groupBy("path").agg(F.max_by(F.struct("status", "tries", "step", "source"), F.struct("at", "tries")).alias("n")).select("path", "n.*")


def _settle(catalog: VersionedCatalog, snapshot: Snapshot, failed: list[str], strict: bool) -> int:
    """Finish a harvest: with its exact size, or as failed if pages are missing or a full one found nothing."""
    size = catalog.rows(snapshot).where("NOT deleted").count()
    empty = size == 0 and snapshot.previous_id is None
    catalog.finish(snapshot, SnapshotStatus.HARVESTING_FINISHED_ERROR if failed or empty else SnapshotStatus.HARVESTING_FINISHED_VALID, size)
    if failed and strict:
        raise HarvestFailed(", ".join(failed))
    return size


def harvest(
    spark: SparkSession,
    pages: str,
    catalog: VersionedCatalog,
    checkpoint: str,
    incremental: bool | None = None,
    prevalid: Callable[[DataFrame], Column] | None = None,
    files_per_batch: int = 10,
    force_full: bool = False,
    most_tries: int = 3,
    wait: Callable[[float], None] = time.sleep,
    strict: bool = False,
) -> int:
    """Read all waiting pages in micro-batches into a snapshot; returns its number of live records.

    A harvest is incremental if there is a good snapshot to begin with, unless told otherwise. Pages that are no
    responses are read again, with growing pauses, ``most_tries`` times in all; others without records are noted. With
    pages that could not be read the snapshot has failed: it is not the last good one, the next harvest of the
    checkpoint reads them again, and ``strict`` raises.
    """
    snapshot = catalog.begin(force_full or incremental is False, checkpoint)
    resumed, incremental = snapshot.status == SnapshotStatus.RETRYING, snapshot.previous_id is not None

    def take(found: DataFrame, query: str, number: int, tries: int) -> None:
        judged = found.withColumn("status", oai.page_status(F.col("xml")))
        rows = oai.records(judged.where("status = 'OK'"))
        catalog.append(snapshot, changes(rows, incremental, prevalid(rows) if prevalid else None), number, query)
        bad = judged.where("status <> 'OK'").select("path", "status")
        if not bad.isEmpty():
            catalog.note(bad, tries, most_tries, checkpoint)

    def merge(batch: DataFrame, number: int) -> None:
        # The id in the checkpoint is that of the query: a fresh checkpoint is another query, whose batches count anew.
        take(batch, spark.read.json(f"{checkpoint}/metadata").first()["id"], number, 0)

    stream = oai.stream_pages(spark, pages, files_per_batch).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    own = F.col("source") == checkpoint
    for tries in range(1, most_tries + 1):
        wanted = (F.col("step") == "retry") | ((F.col("status") == "ERROR_RETRY") & F.lit(resumed and tries == 1))
        again = [r["path"] for r in catalog.notes().where(own & wanted).select("path").collect()]
        if not again:
            break
        wait(back_off(tries - 1))
        found = spark.read.text(again, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))
        good = found.where(oai.page_status(F.col("xml")) == "OK").select("path", F.lit("OK").alias("status"))
        take(found, f"retry-{uuid.uuid4().hex}", 0, tries)
        if not good.isEmpty():
            catalog.note(good, tries, most_tries, checkpoint)
    failed = [r["path"] for r in catalog.notes().where(own & (F.col("step") == "fail")).select("path").collect()]
    return _settle(catalog, snapshot, failed, strict)


def harvest_lists(
    spark: SparkSession,
    fetch_since: Callable[[str | None], Callable[[str, str], str]],
    sets: list[str],
    catalog: VersionedCatalog,
    checkpoint: str,
    full: bool = False,
    prevalid: Callable[[DataFrame], Column] | None = None,
    granularity: str | None = None,
    pages: int = 100,
    tries: int = 3,
    wait: Callable[[float], None] = time.sleep,
    strict: bool = False,
) -> int:
    """Harvest the lists of a provider, one for each set, into a snapshot; returns its number of live records.

    ``fetch_since`` gets the high-water mark (the start of the snapshot that an incremental harvest begins with, in the
    provider's granularity, or None) and returns the fetch of ``sources.lists``. A harvest that was stopped or failed
    goes on at its tokens.
    """
    snapshot = catalog.begin(full, checkpoint)
    previous = next((s for s in catalog.all() if s.id == snapshot.previous_id), None)
    mark = spark.range(1).select(format_for(F.lit(previous.start_time).cast("timestamp"), granularity)).first()[0] if previous else None
    own, failed = f"{checkpoint}/{snapshot.id}", []
    name = f"colophon_lists_{uuid.uuid4().hex}"
    lists.register(spark, name, fetch_since(mark), wait)

    def merge(batch: DataFrame, number: int) -> None:
        batch.persist()
        bad = batch.where("status <> 'OK'").select(F.concat_ws("#", "set_spec", F.col("page").cast("string")).alias("path"), "status", "tries").collect()  # one row for each list at most
        rows = oai.records(batch.where("status = 'OK'"))
        catalog.append(snapshot, changes(rows, previous is not None, prevalid(rows) if prevalid else None), number, own)
        batch.unpersist()
        if bad:
            catalog.note(spark.createDataFrame(bad), tries, tries, own)
        failed.extend(r["path"] for r in bad if r["status"].startswith("ERROR"))

    query = lists.stream_lists(spark, name, sets, f"{own}/lists", pages, tries).writeStream.foreachBatch(merge).option("checkpointLocation", f"{own}/query").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return _settle(catalog, snapshot, failed, strict)
