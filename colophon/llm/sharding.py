"""Sharding by sampled splitters, native: DataFrame functions only.

Records are ordered by a hash of their text and then of their id, so that equal texts lie together. A sample in
which a record's chance follows its size gives quantile splitters; they cut the records into many small ranges
(``PIECES`` a shard), and a range far over its share, such as a large group of equal texts, is subdivided by a
hash of id and row. Exact sizes of the ranges, a table of bounded length, then place every range on one line of bytes, a
window inside each range places its records, and a shard is an equal share of the line. Records larger than a
hundredth of a share (at most 100 a shard) are dealt out first, largest first to the emptiest shard,
and the line is cut where each shard has the rest of its share; so sizes differ by about a hundredth at most,
unless one record is larger than a share.

Law: ``bytes``. Equal texts lie side by side, but where a shard ends or an overfull range is divided the group is
cut: only the sizes are promised. Defined cases: a very long text is one record, dealt out whole; a null text has size 1 and the CRC of the empty text; a null doc_id is placed and
returned as null; repeated rows are placed each, ties in the order are broken arbitrarily among equal rows; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.common import materialize, own_columns

SHARDS = 16
#: Ranges a shard, and sampled records a range (their expected number; it bounds what the driver sees).
PIECES, SAMPLED = 32, 8
#: More ranges are cut where one would hold more rows, up to a bound, as the splitters travel in the plan.
ROWS_PER_RANGE, MOST_PIECES = 2_000_000, 256
#: A range over so many shares is subdivided.
OVERFULL = 2.0


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the order key and the tie-breaking id hash."""
    text = F.coalesce("text", F.lit(""))
    return own_columns(docs, "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("key"), F.xxhash64(F.lit(7), "doc_id").alias("tie")
    )


def splitters(records: DataFrame, total: int, ranges: int, per_range: int = SAMPLED) -> list[int]:
    """Quantiles of a size-weighted sample of about ranges * per_range keys."""
    chance = F.col("size") * F.lit(float(ranges * per_range)) / F.lit(float(max(total, 1)))
    draw = (F.xxhash64(F.lit(11), "key", "tie").bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))
    cuts = records.where(draw < chance).agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("q")).first()["q"]
    return sorted(set(cuts or []))


def _range_of(key: Column, cuts: list[int], fan: int = 24) -> Column:
    """The number of splitters at or below the key, looked up in two levels."""
    if not cuts:
        return F.lit(0)
    blocks = [cuts[i : i + fan] for i in range(0, len(cuts), fan)]
    heads = F.array(*[F.lit(b[0]).cast("long") for b in blocks])
    rows = F.array(*[F.array(*[F.lit(c).cast("long") for c in b]) for b in blocks])
    block = F.size(F.filter(heads, lambda c: c <= key))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * fan + F.size(F.filter(F.get(rows, block - 1), lambda c: c <= key)))


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, pieces: int = PIECES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    # The row number is written with the record, so that it holds; it parts rows that are equal in all else.
    records = materialize(keyed(docs).withColumn("row_hash", F.xxhash64(F.lit(13), "tie", F.monotonically_increasing_id())), "keyed")
    sums = records.agg(F.sum("size").alias("t"), F.count("*").alias("n")).first()
    total = sums["t"] or 0
    pieces = min(max(pieces, -(-sums["n"] // (shards * ROWS_PER_RANGE))), MOST_PIECES)
    share = total / shards
    large = F.col("size") > share / 100

    # Large records, at most 100 a shard: one array of bounded length, dealt out largest first to the emptiest shard.
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("minus"), "key", "tie", "doc_id", "text_crc32")))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("out"))

    def deal(acc: Column, x: Column) -> Column:
        to = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        loads = F.transform(acc["loads"], lambda load, i: F.when(i == to, load - x["minus"]).otherwise(load))
        return F.struct(loads.alias("loads"), F.array_append(acc["out"], to).alias("out"))

    dealt = records.where(large).agg(ordered.alias("rows")).select("rows", F.aggregate("rows", start, deal, lambda acc: acc["out"]).alias("shards"))
    each = dealt.select(F.posexplode(F.arrays_zip("rows", "shards")).alias("rank", "x"))
    giants = materialize(each.select("x.rows.doc_id", (-F.col("x.rows.minus")).alias("size"), "x.rows.text_crc32", F.col("x.shards").alias("shard"), "rank"), "giants")
    taken = {r["shard"]: (r["b"], r["n"]) for r in giants.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}

    # The rest: the line is cut where each shard has what it lacks.
    rest_total = total - sum(b for b, _ in taken.values())
    lacks = [max(share - taken.get(s, (0, 0))[0], 0.0) for s in range(shards)]
    scale = rest_total / sum(lacks) if sum(lacks) else 0.0
    ends, at = [], 0.0
    for x in lacks[:-1]:
        at += x * scale
        ends.append(at)

    rest = records.where(~large)
    ranges = shards * pieces
    cuts = splitters(rest, rest_total, ranges)
    ranged = rest.withColumn("range", _range_of(F.col("key"), cuts))
    goal = max(rest_total / ranges, 1.0)
    sizes = ranged.groupBy("range").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > OVERFULL * goal)
    parts = sizes.select("range", F.ceil(F.col("bytes") / goal).cast("long").alias("parts"))
    # Within an overfull range records go by the top bits of the row's hash, an even split even of equal rows.
    high = F.shiftrightunsigned("row_hash", 32)
    divided = ranged.join(F.broadcast(parts), "range", "left").withColumn("part", F.coalesce(F.shiftrightunsigned(high * F.col("parts"), 32), F.lit(0)).cast("long"))
    pieces_table = divided.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    line = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(pieces_table.select("range", "part", F.coalesce(F.sum("bytes").over(line), F.lit(0)).alias("from_byte"), F.coalesce(F.sum("n").over(line), F.lit(0)).alias("from_row")), "pieces")
    inside = Window.partitionBy("range", "part").orderBy("key", "tie")
    placed = (
        divided.withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("row", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["range", "part"])
        .withColumn("middle", F.col("from_byte") + F.col("before") + F.col("size") / 2)
        .withColumn("line_row", F.col("from_row") + F.col("row"))
    )
    shard = F.lit(0)
    for e in ends:
        shard = shard + (F.col("middle") >= F.lit(e)).cast("int")
    placed = materialize(placed.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), "line_row"), "placed")
    first = placed.groupBy("shard").agg(F.min("line_row").alias("first"))
    after = F.create_map(*[x for s in range(shards) for x in (F.lit(s), F.lit(taken.get(s, (0, 0))[1]).cast("long"))])
    small = placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("line_row") - F.col("first") + after[F.col("shard")]).alias("slot"))
    giant_slot = F.row_number().over(Window.partitionBy("shard").orderBy("rank")) - 1
    both = small.unionByName(giants.select("doc_id", "size", "text_crc32", "shard", giant_slot.cast("long").alias("slot")))
    return both.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
