"""Snapshots: which one counts, what differs between two, what may go, and their life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.model import SnapshotStatus as S

GOOD = [int(S.VALID)]
HARVESTED = [int(S.HARVESTING_FINISHED_VALID), int(S.VALID)]
_BITS = 27


def latest(snapshots: DataFrame, statuses: list[int] | None = None, with_deleted: bool = False) -> DataFrame:
    """Each network's snapshots with the greatest end time among the given statuses; ties stay."""
    some = snapshots if with_deleted else snapshots.where("NOT deleted")
    some = some.where(F.col("status").isin(statuses)) if statuses else some
    newest = Window.partitionBy("network_id").orderBy(F.desc_nulls_last("end_time"))
    return some.where("end_time IS NOT NULL").withColumn("rank", F.rank().over(newest)).where("rank = 1").drop("rank")


def last_good(snapshots: DataFrame) -> DataFrame:
    return latest(snapshots, GOOD)


def last_harvested(snapshots: DataFrame) -> DataFrame:
    return latest(snapshots, HARVESTED)


def last_of_any_status(snapshots: DataFrame) -> DataFrame:
    return latest(snapshots, None, with_deleted=True)


def networks_by_latest_status(snapshots: DataFrame, status: int, column: str = "status") -> DataFrame:
    """Networks whose latest snapshot has the status (or index status)."""
    return last_of_any_status(snapshots).where(F.col(column) == status).select("network_id").distinct()


def to_delete(snapshots: DataFrame) -> DataFrame:
    """Everything but the last good and the last harvested snapshots of each network; one shuffle, no anti-join."""
    w = Window.partitionBy("network_id")
    live = F.when(~F.col("deleted"), F.col("end_time"))
    good, harvested = F.col("status").isin(GOOD), F.col("status").isin(HARVESTED)
    marked = snapshots.withColumns({"good_at": F.max(F.when(good, live)).over(w), "harvested_at": F.max(F.when(harvested, live)).over(w)})
    kept = ~F.col("deleted") & ((good & (F.col("end_time") == F.col("good_at"))) | (harvested & (F.col("end_time") == F.col("harvested_at"))))
    return marked.where(~F.coalesce(kept, F.lit(False))).drop("good_at", "harvested_at")


def summary(snapshots: DataFrame) -> DataFrame:
    """All snapshots, ``is_last_good`` beside them."""
    w = Window.partitionBy("network_id")
    good = F.col("status").isin(GOOD) & ~F.col("deleted")
    return snapshots.withColumn("is_last_good", F.coalesce(good & (F.col("end_time") == F.max(F.when(good, F.col("end_time"))).over(w)), F.lit(False)))


def missing_in(a: DataFrame, b: DataFrame, key: str = "identifier") -> DataFrame:
    """Rows of ``a`` whose key ``b`` does not have."""
    return a.join(b.select(key).distinct(), key, "left_anti")


def carry_over(previous: DataFrame, current: DataFrame, key: str = "identifier") -> DataFrame:
    """The current rows and those of the previous snapshot that it lacks."""
    return current.unionByName(missing_in(previous, current, key))


def orphans(contents: DataFrame, records: DataFrame) -> DataFrame:
    """Stored contents that no record refers to, as original or as published: two anti-joins, not one with OR."""
    out = contents
    for column in ("original_metadata_hash", "published_metadata_hash"):
        used = records.select(F.col(column).alias("hash")).where("hash IS NOT NULL").distinct()
        out = out.join(used, "hash", "left_anti")
    return out


def difference(previous: DataFrame, current: DataFrame, key: str = "id", content: str = "original_metadata_hash") -> DataFrame:
    """Every key of either snapshot as new, changed, deleted or same; a tombstone counts as absent."""
    was, now = (df.where("NOT deleted").select(key, F.col(content).alias(name)) for df, name in ((previous, "was"), (current, "now")))
    both = was.withColumn("in_was", F.lit(True)).join(now.withColumn("in_now", F.lit(True)), key, "full_outer")
    change = F.when(F.col("in_was").isNull(), "new").when(F.col("in_now").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("now")), "same").otherwise("changed")
    return both.select(key, change.alias("change"))


def unique_id(snapshot_id: Column, number: Column) -> Column:
    """A snapshot's 27-bit running number under its id."""
    return F.shiftleft(snapshot_id.cast("long"), _BITS).bitwiseOR(number.cast("long").bitwiseAND(F.lit((1 << _BITS) - 1)))


def by_network(snapshots: DataFrame, network_id: int, deleted: bool | None = None, statuses: list[int] | None = None) -> DataFrame:
    out = snapshots.where(F.col("network_id") == network_id)
    out = out if deleted is None else out.where(F.col("deleted") == deleted)
    out = out if statuses is None else out.where(F.col("status").isin(statuses))
    return out.orderBy(F.desc("start_time"), "id")


def between(snapshots: DataFrame, start: str, end: str) -> DataFrame:
    return snapshots.where(F.col("end_time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))).orderBy("end_time", "id")


#: Event to the status it leads to.
TRANSITIONS = {
    "create": S.INITIALIZED,
    "start_harvesting": S.HARVESTING,
    "retry": S.RETRYING,
    "finish_harvesting": S.HARVESTING_FINISHED_VALID,
    "finish_harvesting_empty": S.EMPTY_INCREMENTAL,
    "fail": S.HARVESTING_FINISHED_ERROR,
    "stop": S.HARVESTING_STOPPED,
    "start_validation": S.HARVESTING_FINISHED_VALID,
    "finish_validation": S.VALID,
}


def apply_event(snapshots: DataFrame, snapshot_id: int, event: str, at: Column) -> DataFrame:
    """The table after an event: status, and the start or end time where the event sets one."""
    of = F.col("id") == snapshot_id
    out = snapshots.withColumn("status", F.when(of, int(TRANSITIONS[event])).otherwise(F.col("status")))
    if event in ("create", "start_harvesting"):
        return out.withColumn("start_time", F.when(of, F.coalesce("start_time", at)).otherwise(F.col("start_time")))
    return out.withColumn("end_time", F.when(of, at).otherwise(F.col("end_time")))


def clean(snapshots: DataFrame, ids: list[int]) -> DataFrame:
    """Good or harvested snapshots are marked deleted, others leave the table."""
    of = F.col("id").isin(ids)
    good = F.col("status").isin(HARVESTED)
    return snapshots.where(~of | good).withColumn("deleted", F.col("deleted") | of)


def reset_validation(snapshots: DataFrame, snapshot_id: int) -> DataFrame:
    of = F.col("id") == snapshot_id
    values = {"status": int(S.HARVESTING_FINISHED_VALID), "index_status": int(S.UNKNOWN), "valid_size": 0, "transformed_size": 0}
    return snapshots.withColumns({c: F.when(of, F.lit(v)).otherwise(F.col(c)).cast(snapshots.schema[c].dataType) for c, v in values.items() if c in snapshots.columns})


def network_property(properties: Column, name: str) -> Column:
    """A boolean property of a network; missing means false."""
    return F.coalesce(F.try_element_at(properties, F.lit(name)), F.lit(False))


def action_due(scheduled: Column, properties: Column, names: list[str], always: bool = False) -> Column:
    """A scheduled action runs if one of its properties is set, or always."""
    wanted = F.lit(always)
    for name in names:
        wanted = wanted | network_property(properties, name)
    return scheduled & wanted


def order_for_display(df: DataFrame, order: str = "display_order", key: str = "key") -> DataFrame:
    return df.orderBy(F.asc_nulls_last(order), key)
