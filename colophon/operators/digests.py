"""Differences of snapshots by digests: only buckets that differ are joined.

A snapshot lies in folders by a hash of its key. The digest of a bucket is the number of its rows and an order-free sum
of row hashes; digests of groups of buckets are sums of theirs, so a tree of any fan-out follows from the leaves. Two
snapshots are compared by their digests, which are small and kept beside them, and only the folders of buckets that
differ are read; Spark prunes the others from the scan. Equal digests are taken for equal buckets: two sums of 64 bits
each, over different hashes, and the count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.operators.snapshots import difference

BUCKETS = 256
DIGEST = "bucket int, n long, a decimal(38,0), b decimal(38,0)"


def bucket_of(key: str = "id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def digests(rows: DataFrame, columns: list[str], level: int = 1) -> DataFrame:
    """bucket, n, a, b of rows with a ``bucket``; with ``level`` over 1 that many neighbouring buckets count as one."""
    wide = lambda c: c.cast("decimal(38,0)")
    whole = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    of = (F.col("bucket") / level).cast("int").alias("bucket")
    return rows.groupBy(of).agg(F.count("*").alias("n"), F.sum(wide(F.xxhash64(whole))).alias("a"), F.sum(wide(F.xxhash64(F.lit("second"), whole))).alias("b"))


def write_buckets(rows: DataFrame, path: str, key: str = "id", columns: list[str] | None = None, buckets: int = BUCKETS) -> None:
    """Write a snapshot by bucket (``path``/rows) and its digests (``path``/digests); ``columns`` are those compared."""
    columns = columns or [key, "original_metadata_hash"]
    rows.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/rows")
    written = rows.sparkSession.read.parquet(f"{path}/rows")
    digests(written.where("NOT deleted"), columns).coalesce(1).write.parquet(f"{path}/digests")  # a row for each bucket


def differing(previous: DataFrame, current: DataFrame) -> list[int]:
    """The buckets whose digests differ; at most all of them, so a bounded list."""
    both = previous.alias("p").join(current.alias("c"), "bucket", "full_outer")
    same = F.coalesce((F.col("p.n") == F.col("c.n")) & (F.col("p.a") == F.col("c.a")) & (F.col("p.b") == F.col("c.b")), F.lit(False))
    return sorted(r["bucket"] for r in both.where(~same).select("bucket").collect())


def bucketed_difference(spark: SparkSession, previous: str, current: str, with_same: bool = False) -> DataFrame:
    """``difference`` of two snapshots of ``write_buckets``: new, changed and deleted keys, from differing buckets alone.

    ``with_same`` adds the keys that are the same, for which the equal buckets of one side are read without a join.
    """
    old, new = (spark.read.parquet(f"{p}/rows") for p in (previous, current))
    buckets = differing(*(spark.read.schema(DIGEST).parquet(f"{p}/digests") for p in (previous, current)))
    some = F.col("bucket").isin(buckets)
    out = difference(old.where(some), new.where(some))
    if not with_same:
        return out.where("change <> 'same'")
    return out.unionByName(new.where(~some & ~F.col("deleted")).select("id", F.lit("same").alias("change")))
