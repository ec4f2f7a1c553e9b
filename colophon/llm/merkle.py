"""Merkle manifest of a dataset: one tree for each group, one over the groups' roots, and a proof for each row.

Rows are sorted by group and key into range partitions and written; the counts of each group in the partitions before
are its offset there, so every row knows its place in the group. Each partition then hashes what it can alone: of the
places it holds, the runs of ``ARITY`` that lie whole in it, level by level. The ragged nodes at its two ends, a few a
level, are shuffled by coordinate (group, level, place), and what they have in common is finished in strides of levels:
all nodes under one ancestor meet in one task, ``ARITY ** FIRST`` at most in the first stride and ``ARITY ** STRIDE``
in the next ones. The roots of the groups are the leaves of a last tree, built the same way. For the proofs each
partition asks for the few nodes that its end rows need from others, and writes the siblings of every row.

H is the lowercase hex SHA-256 of its inputs joined; digests go in as hex text. A leaf is H of the named columns, each
``-`` if null, else its UTF-8 byte count, a colon and its value (integers in decimal).

Defined cases: null is a group of its own, the first; groups ascend bytewise; rows of a group ascend by key, null keys
first, and rows of one key by leaf, so that equal rows are interchangeable and every repeated row is a leaf of its
own; empty and very long texts are values like any other; a group of one row has that leaf as its root, and a single
group's root is the root of all; an empty table has no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.common import bounded_batches, materialize

ARITY = 3
#: Rows of a range partition, about; fewer where all cores have less, but not under the second figure.
PART_ROWS, LEAST_ROWS = 100_000, 1_000
#: Levels finished in the first stride, and in each one after it.
FIRST, STRIDE = 11, 9

_NODES = "grp string, size long, level int, place long, digest string"
_PATH = "array<struct<before: string, after: string>>"


def _h(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(size: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while size > 1:
        size, levels = -(-size // ARITY), levels + 1
    return levels


def _own_nodes(leaves: list[str], start: int, size: int) -> list[tuple[int, list[str]]]:
    """For each level the place of the first node that these leaves give alone, and the nodes from there on."""
    out = [(start, leaves)]
    while size > 1 and leaves:
        end = start + len(leaves)
        first, last = -(-start // ARITY), -(-end // ARITY) if end == size else end // ARITY
        leaves = [_h(leaves[max(r * ARITY - start, 0) : r * ARITY + ARITY - start]) for r in range(first, last)]
        start, size = first, -(-size // ARITY)
        out.append((start, leaves))
    return out


def _ragged(levels: list[tuple[int, list[str]]], size: int) -> Iterator[tuple[int, int, str]]:
    """(level, place, digest) of the nodes whose parent needs nodes of others, and of the root."""
    top = height(size)
    for level, (start, nodes) in enumerate(levels):
        if level == top:
            yield from ((level, start + i, d) for i, d in enumerate(nodes))
            return
        above, parents = levels[level + 1] if level + 1 < len(levels) else (0, [])
        settled = range(above * ARITY - start, (above + len(parents)) * ARITY - start) if parents else range(0)
        ends = [*range(min(settled.start, len(nodes))), *range(settled.stop, len(nodes))] if parents else range(len(nodes))
        yield from ((level, start + i, nodes[i]) for i in ends)


def _groups_of(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[dict, list[dict]]]:
    """Rows come by part: first the ranges of its groups with what they need, then its rows by place. Yields each range with its rows."""
    ranges, held, now = deque(), [], None
    for batch in batches:
        for row in batch.to_pylist():
            if now is not None and (row["kind"] == 0 or row["grp"] != now["grp"]):
                yield now, held
                now, held = None, []
            if row["kind"] == 0:
                ranges.append(row)
                continue
            if now is None:
                now = ranges.popleft()
            held.append({c: row[c] for c in columns})
    if now is not None:
        yield now, held


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ragged nodes of each range."""
    for spot, rows in _groups_of(batches, ["digest"]):
        size = spot["size"]
        found = list(_ragged(_own_nodes([r["digest"] for r in rows], spot["start"], size), size))
        yield pa.record_batch(
            [pa.array([spot["grp"]] * len(found)), pa.array([size] * len(found), pa.int64()), *[pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.string()))]],
            names=["grp", "size", "level", "place", "digest"],
        )


def _finish(to_level: int):
    """All ancestors of some nodes up to a level, or to the root."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        grp, size = rows[0]["grp"], rows[0]["size"]
        by_level: dict[int, dict[int, str]] = {}
        for r in rows:
            by_level.setdefault(r["level"], {})[r["place"]] = r["digest"]
        found, top = [], min(to_level, height(size))
        count = size
        for level in range(top):
            nodes = by_level.get(level, {})
            for run_place in sorted({p // ARITY for p in nodes}):
                children = range(run_place * ARITY, min(run_place * ARITY + ARITY, count))
                digest = _h([nodes[c] for c in children])
                by_level.setdefault(level + 1, {})[run_place] = digest
                found.append((level + 1, run_place, digest))
            count = -(-count // ARITY)
        return pa.table({"grp": pa.array([grp] * len(found), pa.string()), "size": pa.array([size] * len(found), pa.int64()), **{n: pa.array([f[i] for f in found], t) for i, (n, t) in enumerate((("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string())))}})

    return run


class Forest:
    """The trees over ``leaves``: grp, digest and any columns that go along; in a group leaves ascend by ``key``. Groups are strings, never null."""

    def __init__(self, leaves: DataFrame, key: str, name: str, part_rows: int = PART_ROWS):
        bounded_batches(leaves.sparkSession)
        # Digests are written before rows are sampled for the range boundaries; the row number divides equal rows.
        leaves = materialize(leaves.withColumn("row", F.monotonically_increasing_id()), f"{name}-leaves")
        order = ["grp", key, "digest", "row"]
        rows, cores = leaves.count(), leaves.sparkSession.sparkContext.defaultParallelism
        self.parts = max(-(-rows // part_rows), min(-(-rows // LEAST_ROWS), cores), 1)
        in_order = leaves.repartitionByRange(self.parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
        placed = in_order.select("*", F.shiftright("at", 33).cast("int").alias("part")).drop("row")
        self.rows = materialize(placed, f"{name}-sorted", large=True)

        # A group's offset in a partition is what the partitions before hold of it.
        counts = self.rows.groupBy("grp", "part").agg(F.count("*").alias("here"))
        whole = Window.partitionBy("grp")
        before = F.sum("here").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("here")
        self.ranges = materialize(counts.select("grp", "part", "here", before.alias("start"), F.sum("here").over(whole).alias("size")), f"{name}-ranges")
        self.largest = self.ranges.agg(F.max("size")).first()[0] or 0

        nodes = materialize(self._by_part(self.ranges, [], ["digest"]).mapInArrow(_local, _NODES), f"{name}-nodes-0")
        self.nodes, level, step = nodes, 0, 0
        while level < height(self.largest):
            level += STRIDE if step else FIRST
            step += 1
            under = F.expr(f"place div CAST(power({ARITY}, {level} - level) AS BIGINT)")
            open_nodes = self.nodes.where(F.col("level") < F.least(F.lit(level), _height("size"))).where(F.lit(True) if step == 1 else F.col("level") >= level - STRIDE)
            # The ragged nodes of lower levels were all used up in the first stride.
            higher = open_nodes.withColumn("under", under).groupBy("grp", "under").applyInArrow(_finish(level), _NODES)
            self.nodes = self.nodes.unionByName(materialize(higher, f"{name}-nodes-{step}"))

    def _by_part(self, ranges: DataFrame, notes: list[str], columns: list[str]) -> DataFrame:
        """Ranges, each with its notes, and the columns of the rows, by part."""
        heads = ranges.select("part", F.lit(0).alias("kind"), "grp", F.lit(0).cast("long").alias("at"), "start", "size", *notes)
        rows = self.rows.select("part", F.lit(1).alias("kind"), "grp", "at", *columns)
        both = heads.unionByName(rows, allowMissingColumns=True)
        return both.repartition(self.parts, "part").sortWithinPartitions("part", "kind", F.when(F.col("kind") == 0, F.col("grp")), "at")

    def roots(self) -> DataFrame:
        """grp and digest of each tree's root."""
        return self.nodes.where(F.col("level") == _height("size")).select("grp", "digest")

    def proofs(self, columns: str, beyond: DataFrame | None = None) -> DataFrame:
        """The named columns of every row (DDL, digest among them), with its path, the root of its group and what ``beyond`` holds of the group.

        path is the text before and after the row's own digest on each level. ``beyond`` (grp, above, top) has the path
        of a group's root in a tree over it and that tree's root.
        """
        # The nodes that the first and last row of a range need from others: a run or two a level.
        asked = self.ranges.select("grp", "part", "start", "size", F.explode(F.array_distinct(F.array("start", F.col("start") + F.col("here") - 1))).alias("place"))
        levels = F.explode(F.transform(F.sequence(F.lit(0), _height("size")), lambda x: x.cast("int")))
        runs = asked.withColumn("level", levels).where(F.col("level") < _height("size")).withColumn("run", F.expr(f"place div CAST(power({ARITY}, level + 1) AS BIGINT)"))
        wanted = runs.select("grp", "part", "level", F.explode(F.sequence(F.col("run") * ARITY, F.col("run") * ARITY + ARITY - 1)).alias("place")).distinct()
        got = wanted.join(self.nodes.drop("size"), ["grp", "level", "place"]).groupBy("grp", "part").agg(F.collect_list(F.struct("level", "place", "digest")).alias("from_others"))
        ranges = self.ranges.join(got, ["grp", "part"], "left").join(self.roots().withColumnRenamed("digest", "subroot"), "grp")
        notes = ["from_others", "subroot"]
        if beyond is not None:
            ranges, notes = ranges.join(beyond, "grp"), [*notes, "above", "top"]
        names = [c.split()[0] for c in columns.split(", ")]
        extra = ", above " + _PATH + ", top string" if beyond is not None else ""
        return self._by_part(ranges, notes, names).mapInArrow(_prove(names, notes[2:]), f"{columns}, path {_PATH}, subroot string{extra}")


def _height(size: str) -> Column:
    """``height`` of a column, in whole numbers."""
    levels = F.sequence(F.lit(0), F.lit(39))
    return F.size(F.filter(levels, lambda k: F.pow(F.lit(float(ARITY)), k) < F.col(size)))


def _prove(names: list[str], beyond: list[str], step: int = 1_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for spot, rows in _groups_of(batches, names):
            size, start = spot["size"], spot["start"]
            levels = [dict(enumerate(nodes, first)) for first, nodes in _own_nodes([r["digest"] for r in rows], start, size)]
            levels += [{} for _ in range(height(size) + 1 - len(levels))]
            for node in spot["from_others"] or []:
                levels[node["level"]].setdefault(node["place"], node["digest"])
            schema = None
            for a in range(0, len(rows), step):
                out = []
                for i, row in enumerate(rows[a : a + step], start + a):
                    path, place, count = [], i, size
                    for nodes in levels[: height(size)]:
                        head = place // ARITY * ARITY
                        path.append({"before": "".join(nodes[p] for p in range(head, place)), "after": "".join(nodes[p] for p in range(place + 1, min(head + ARITY, count)))})
                        place, count = place // ARITY, -(-count // ARITY)
                    out.append({**row, "path": path, "subroot": spot["subroot"], **{c: spot[c] for c in beyond}})
                schema = schema or _schema(names, beyond)
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _schema(names: list[str], beyond: list[str]) -> pa.Schema:
    path = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    kinds = {"doc_id": pa.int64(), "path": path, "above": path}
    return pa.schema([(n, kinds.get(n, pa.string())) for n in [*names, "path", "subroot", *beyond]])


def leaf(*columns: Column) -> Column:
    """The leaf digest of a row."""
    text = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256)


def fold(path: Column, digest: Column) -> Column:
    """The root that a leaf digest leads to by a path."""
    return F.aggregate(path, digest, lambda below, sides: F.sha2(F.encode(F.concat(sides["before"], below, sides["after"]), "UTF-8"), 256))


def manifest(rows: DataFrame, group: Column, key: Column, digest: Column, part_rows: int = PART_ROWS, **along: Column) -> DataFrame:
    """A proof for each row: key, digest, path (from leaf to the root of all), subroot, root, and the string columns ``along``.

    ``digest`` is the leaf, as of ``leaf``; ``fold(path, digest)`` equals root for the row as it was, and for no other.
    """
    # Null is the first group; a sign before all others keeps their order.
    grouped = rows.select(F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("")).alias("grp"), key.cast("long").alias("doc_id"), digest.alias("digest"), *[c.alias(n) for n, c in along.items()])
    forest = Forest(grouped, "doc_id", "merkle", part_rows)
    tops = forest.roots().select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest")
    top = Forest(tops, "of", "merkle-top", part_rows)
    beyond = top.proofs("of string, digest string").select(F.col("of").alias("grp"), F.col("path").alias("above"), F.col("subroot").alias("top"))
    columns = ", ".join(["doc_id long", "digest string", *[f"{n} string" for n in along]])
    out = forest.proofs(columns, beyond)
    return out.select(F.col("doc_id").alias("key"), "digest", *along, F.concat("path", "above").alias("path"), "subroot", F.col("top").alias("root"))


def digest(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The columns of the query contract: every second document is tampered with, and its proof tried."""
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(tampered & F.col("text").contains("\n"), leaf(*fields, F.replace("text", F.lit("\n"), F.lit(""))))
    out = manifest(docs, F.col("source"), F.col("doc_id"), leaf(*fields, F.col("text")), part_rows, tampered=changed)
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), "")
    folded = fold(F.col("path"), F.coalesce("tampered", "digest"))
    out = out.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(F.encode(siblings, "UTF-8"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
