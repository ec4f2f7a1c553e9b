"""The record catalog and the content store: upserts, tombstones, inheritance, deduplicated contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colophon.functions.text import content_hash, record_id

REQUIRED = ["id", "identifier", "datestamp", "original_metadata_hash"]
#: Rows of a file by the size of the snapshot: (up to, rows).
FILE_ROWS = [(100_000, 50_000), (1_000_000, 500_000), (10_000_000, 1_000_000)]


def catalog_rows(identifier: Column, datestamp: Column, content: Column | None, deleted: Column) -> list[Column]:
    """The five columns; a tombstone has no content hash."""
    hashed = content_hash(content) if content is not None else F.lit(None).cast("string")
    return [record_id(identifier).alias("id"), identifier.alias("identifier"), datestamp.alias("datestamp"), F.when(~deleted, hashed).alias("original_metadata_hash"), deleted.alias("deleted")]


def live(catalog: DataFrame) -> DataFrame:
    return catalog.where("NOT deleted")


def tombstones(ids: DataFrame, at: Column) -> DataFrame:
    """Catalog rows that delete the given identifiers."""
    return ids.select(*catalog_rows(F.col("identifier"), at, None, F.lit(True)))


def last_write(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last row of each key; equal orders are broken by the row's content, so the result is always the same."""
    rest = [F.col(c).desc_nulls_last() for c in rows.columns if c not in (key, order) and dict(rows.dtypes)[c] != "map"]
    w = Window.partitionBy(key).orderBy(F.desc(order), *rest)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(base: DataFrame, delta: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The base with the delta's last row of each key in place of its own: one anti-join, the base is not sorted."""
    newest = last_write(delta, key, order).drop(order)
    return base.join(newest.select(key), key, "left_anti").select(*base.columns).unionByName(newest.select(*base.columns))


def union_of_sets(sets: list[DataFrame], key: str = "id", order: str = "seq") -> DataFrame:
    """Harvested sets may overlap; the last write of each key stays."""
    out = sets[0]
    for more in sets[1:]:
        out = out.unionByName(more)
    return last_write(out, key, order)


def counts(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count("*").alias("total"), F.count_if(~F.col("deleted")).alias("live"), F.count_if("deleted").alias("gone"))


def file_rows(size: int) -> int:
    return next((rows for most, rows in FILE_ROWS if size < most), 2_000_000)


def write_catalog(catalog: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Rows with a null in a required column are dropped, so tombstones cannot be kept in this form; text is trimmed."""
    ready = catalog.dropna(subset=REQUIRED).withColumns({c: F.trim(c) for c in ("id", "identifier", "original_metadata_hash")})
    ready.write.option("maxRecordsPerFile", rows_per_file).option("compression", "snappy").option("parquet.page.size", 1 << 20).option("parquet.block.size", 128 << 20).mode("overwrite").parquet(path)


def write_for_look_up(rows: DataFrame, path: str, key: str = "id", others: tuple[str, ...] = ("identifier",), rows_per_group: int = 100_000) -> None:
    """Files sorted by a hash key, with Bloom filters on other columns: a look-up by either reads few row groups."""
    writer = rows.repartitionByRange(key).sortWithinPartitions(key).write.option("parquet.block.row.count.limit", rows_per_group)
    for c in others:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", rows_per_group)
    writer.parquet(path)


def migrate(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows fit for the new catalog (a null ``deleted`` is false), and one row of counts: migrated, skipped."""
    fit = source.where("identifier IS NOT NULL").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    return fit, source.agg(F.count("identifier").alias("migrated"), F.count_if(F.col("identifier").isNull()).alias("skipped"))


def new_contents(store: DataFrame, delta: DataFrame) -> DataFrame:
    """Contents of the delta that the store lacks, each once: what an append must write."""
    once = delta.groupBy("network", "hash").agg(F.min("content").alias("content"))
    return once.join(store.select("network", "hash"), ["network", "hash"], "left_anti")


def without_contents(store: DataFrame, hashes: DataFrame) -> DataFrame:
    return store.join(hashes.select("hash").distinct(), "hash", "left_anti")


def with_content(catalog: DataFrame, store: DataFrame) -> DataFrame:
    """Records with their content; ``is_missing`` marks a hash that the store does not know."""
    joined = catalog.join(store.select("network", F.col("hash").alias("original_metadata_hash"), "content"), ["network", "original_metadata_hash"], "left")
    return joined.withColumn("is_missing", F.col("original_metadata_hash").isNotNull() & F.col("content").isNull())


def known_hashes(hashes: DataFrame, store: DataFrame) -> DataFrame:
    return hashes.join(store.select("hash").distinct(), "hash", "left_semi")


def layout(df: DataFrame, path: str) -> None:
    """Snapshots in folders by network and snapshot, so that either prunes the scan."""
    df.repartition("network", "snapshot_id").write.partitionBy("network", "snapshot_id").mode("overwrite").parquet(path)


def write_index(records: DataFrame, path: str, network: str) -> None:
    """Put a network's records in the index, in place of those it had; other networks stay."""
    records.withColumn("network", F.lit(network)).write.partitionBy("network").option("partitionOverwriteMode", "dynamic").mode("overwrite").json(path)


def read_index(spark: SparkSession, path: str, network: str | None = None) -> DataFrame:
    out = spark.read.json(path)
    return out if network is None else out.where(F.col("network") == network)


def unindex(spark: SparkSession, path: str, network: str) -> None:
    """Take a network out of the index: its folder goes."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/network={network}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
