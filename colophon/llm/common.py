"""Shared helpers: tables in the shared folder, and words as numpy arrays over Arrow text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.shipping import ship

#: Text bytes handled by one numpy step, so that a task's memory does not follow the size of its partition.
STEP_BYTES = 1_000_000

#: MB of a post-shuffle partition in steps that write large tables.
LARGE = 32

#: Bits of the map of keys that have notes, and bits of one of its rows: 2,048 rows of 4 KB at most.
MAP_BITS, ROW_BITS = 1 << 26, 1 << 15

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_IS_WORD = ~_SPACE

#: bytes.translate table: A-Z to a-z, all other bytes unchanged.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or set on the context. Without either a temporary one is set, in local mode alone."""
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not place:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="colophon-"))
        place = context.getCheckpointDir()
    return f"{place.rstrip('/')}/colophon-{context.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def discard(written: DataFrame) -> None:
    """Remove a table of ``materialize`` that no later step reads."""
    _delete(written.sparkSession, written._written_to)


def clean(spark: SparkSession) -> None:
    """Remove all tables that this application has written; results that read them can then no longer be computed."""
    _delete(spark, shared_dir(spark))


def materialize(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut and lost executors do no harm.

    The write's shuffle files go as soon as it is done. ``large`` asks for post-shuffle partitions of ``LARGE`` MB
    at least, and so for few files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if large and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) < LARGE << 20:
        wanted[size] = f"{LARGE}m"
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches small enough that long texts do not fill a Python worker; larger settings are lowered.

    Called by every operator that runs Python, so the package is sent to the executors here too.
    """
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1_000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or int(now) == 0 or int(now) > most:
            spark.conf.set(key, most)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra columns of the input, whatever their names, cannot clash with ours."""
    return df.select(*[df[n].cast("long").alias(n) if n in ("doc_id", "vec_id") else df[n] for n in names])


def noted_apart(rows: DataFrame, key: str, notes: DataFrame, note_id: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among the notes, and the others, which need not be shuffled to meet any.

    A map with a bit for each hash of a key that has a note, 8 MB at most, is sent to all tasks. Where there are very
    many notes, most bits are set and most rows are in the first part. Null is a key like others.
    """
    place = F.pmod(F.xxhash64(F.col(note_id)), F.lit(MAP_BITS))
    bits = notes.select(place.alias("at")).groupBy(F.floor(F.col("at") / ROW_BITS).alias("_map_row")).agg(F.bitmap_construct_agg(F.col("at") % ROW_BITS).alias("_map_bits"))
    at = F.pmod(F.xxhash64(F.col(key).cast(notes.schema[note_id].dataType)), F.lit(MAP_BITS))
    mapped = rows.withColumn("_map_row", F.floor(at / ROW_BITS)).join(F.broadcast(materialize(bits, "note-map")), "_map_row", "left")
    byte = F.conv(F.hex(F.substring("_map_bits", F.floor(at % ROW_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    has = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return mapped.where(has).select(rows.columns), mapped.where(~has).select(rows.columns)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]] if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def text_steps(batches: Iterator[pa.RecordBatch], column: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``step`` text bytes; a longer text makes a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // step
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def split_words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and per row the index of its first word (one more entry than rows)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    w = is_word[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    heads, tails = offs[:-1][offs[1:] > offs[:-1]], offs[1:][offs[1:] > offs[:-1]] - 1
    first[heads], last[tails] = w[heads], w[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time over all words at once."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = ends - starts
    h = mix(length.astype(np.uint64) + _U((seed * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF))
    live, at = np.arange(len(starts)), 0
    while len(live):
        left = length[live] - at
        bits = np.minimum(left, 8).astype(np.uint64) * _U(8)
        mask = np.where(bits == 64, ~_U(0), (_U(1) << (bits & _U(63))) - _U(1))
        h[live] = mix((h[live] ^ (eight[starts[live] + at] & mask)) + _U(0x9E3779B97F4A7C15))
        at += 8
        live = live[left > 8]
    return h


def hash_windows(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of k word hashes (rows are not told apart here)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, (seed * 0xD6E8FEB86659FD93 + k) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(k):
        acc = acc * _U(0x9E3779B97F4A7C15) + words[j : j + n]
        acc ^= acc >> _U(29)
    return mix(acc)


def spans_of(word_offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For every position that starts k words of one row: the position and its row."""
    count = np.maximum(np.diff(word_offs) - k + 1, 0)
    total = int(count.sum())
    row = np.repeat(np.arange(len(count)), count)
    within = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    return word_offs[:-1][row] + within, row
