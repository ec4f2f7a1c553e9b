"""Near-duplicates by the Jaccard similarity of word-shingle sets, exact and without loss.

Equal sets are one node from the start. Candidates come from two steps, and all of them are compared exactly. First each
set has a SimHash fingerprint, and fingerprints are linked by segment-popcount embedding (``simhash.links_of``). Sets
within the similarity can be further apart than that radius, so a prefix filter finds those that fingerprints miss; it
does not test again what fingerprints have linked.

Two sets within the similarity share one of the first elements of each in any fixed order (of n elements the first n - ceil(similarity * n) + 1), so each set is filed under those; shingles that many
documents have come last in the order, which keeps cells small and changes no result. Sets that meet are compared by
size and by the parity of 1,024 hashed bits, and large sets by the counts in 1,024 hashed places, as parity tells nothing
of them: bits and counts never differ by more than the sets do, so only pairs that cannot be similar fall out. What is
left falls into blocks, whose whole sets are compared exactly. Cells and blocks pass on links that span their groups,
never all pairs.

A large cell or block is divided over tasks. First each of its nodes is in one tile, and some, drawn by hash, are in all
tiles, so that a group in many tiles is tied together. Then only nodes of different groups are left to compare: tiles of
the largest group meet tiles of the rest, and those meet each other, but the largest group never meets itself. A task
has two tiles at a time, and a cell that is all one group after the first step is done.

A set is known by 64 bits of hash: among some billion different texts two would be taken for one.

Defined cases: words are split and lower-cased as for SimHash; a text of fewer words than a shingle has one shingle, the
whole sequence; null and empty texts are copies of each other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm import simhash
from colophon.llm.common import LOWER_AZ, bounded_batches, hash_windows, hash_words, materialize, mix, spans_of, split_words, text_bytes, text_steps
from colophon.llm.components import components, stars

SHINGLE = 5
SIMILARITY = 0.8
BITS = 1024
#: Sets from this size on have counts besides.
LONG = 1500

_U = np.uint64
_LOWER = np.frombuffer(LOWER_AZ, np.uint8)
#: Pairs tested at once, the size of a cell from which it is searched set by set, shingles with a place at the end of the
#: order, and positions of the map of nodes whose sets are wanted.
_PAIRS, _LARGE, _HOT, _MAP = 1 << 16, 64, 1 << 16, 1 << 22
#: Nodes of a tile of a cell and of a block, and nodes that are in all tiles of one, about.
CELL_TILE, BLOCK_TILE, HUBS = 4096, 256, 16


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and the offsets of the texts."""
    data, offs = text_bytes(texts)
    data = _LOWER[data]
    starts, ends, word_offs = split_words(data, offs)
    words, count = hash_words(data, starts, ends), np.diff(word_offs)
    at, row = spans_of(word_offs, n)
    hashes, rows = [hash_windows(words, n)[at]], [row]
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            hashes.append(hash_windows(words, k)[word_offs[:-1][short]])
            rows.append(short)
    h, row = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(count) + 1))


def _rows(offs: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def node_keys(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; the empty set has 0."""
    total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(h ^ _U(0x5851F42D4C957F2D)), dtype=_U)])
    size = np.diff(offs)
    return np.where(size > 0, mix((total[offs[1:]] - total[offs[:-1]]) + size.astype(_U)), _U(0))


def parity(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per set the parity of its elements in each of BITS places, as 64-bit words."""
    odd = np.bincount(_rows(offs) * BITS + (h >> _U(30)).astype(np.int64) % BITS, minlength=(len(offs) - 1) * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, BITS), axis=1).view(_U)


def counts(h: np.ndarray) -> bytes:
    """Elements of a set in each of BITS places, 255 at most."""
    return np.minimum(np.bincount((h >> _U(30)).astype(np.int64) % BITS, minlength=BITS), 255).astype(np.uint8).tobytes()


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for part in text_steps(batches, "text"):
        h, offs = shingle_sets(part.column("text"), n)
        yield part, h, offs, node_keys(h, offs)


def _new(keys: np.ndarray, seen: set[int]) -> np.ndarray:
    """Rows whose key this task has not met before."""
    rows = []
    for i, key in enumerate(keys.tolist()):
        if key not in seen:
            seen.add(key)
            rows.append(i)
    return np.array(rows, np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


def _hot(docs: DataFrame, n: int) -> np.ndarray:
    """Shingles of many documents with their weights; any choice gives the same result, a good one smaller cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, h, offs, keys in _sets(batches, n):
            rows = np.zeros(len(keys), bool)
            rows[_new(keys, seen)] = True
            value, times = np.unique(h[rows[_rows(offs)]], return_counts=True)
            often = times >= max(4, len(keys) // 100)
            yield pa.record_batch([pa.array(value[often].view(np.int64)), pa.array(times[often].astype(np.int64))], names=["cell", "times"])

    found = docs.select("text").mapInArrow(run, "cell long, times long").groupBy("cell").agg(F.sum("times").alias("times"))
    top = found.orderBy(F.desc("times"), "cell").limit(_HOT).toArrow()
    return np.stack([top.column(k).to_numpy().astype(np.int64) for k in ("cell", "times")])


def _by_cell(batches: Iterator[pa.RecordBatch], name: str, work: Callable[[pa.Table], list[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``work`` on whole cells of sorted batches; the last cell of a batch may go on in the next."""
    held: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cells = batch.column(name).to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))[-1])
        if held and (last > 0 or held[0].column(name)[0].as_py() != cells[0]):
            yield from work(pa.concat_tables([*held, pa.Table.from_batches([batch.slice(0, last)])]))
            held = []
        elif last > 0:
            yield from work(pa.Table.from_batches([batch.slice(0, last)]))
        held.append(pa.Table.from_batches([batch.slice(last)]))
    if held:
        yield from work(pa.concat_tables(held))


def _once(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Sorted batches without the rows that have the cell and the key of the row before."""
    before = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cell, key = (batch.column(n).to_numpy() for n in (name, "key"))
        new = np.concatenate([[before != (cell[0], key[0])], (cell[1:] != cell[:-1]) | (key[1:] != key[:-1])])
        before = cell[-1], key[-1]
        yield batch if new.all() else batch.filter(pa.array(new))


def _bounds(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    head = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    return head, np.diff(np.concatenate([head, [len(cells)]]))


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _shared(table: pa.Table) -> list[pa.RecordBatch]:
    """Rows of cells in which two nodes meet."""
    cell, key = _columns(table, "cell", "key")
    order = np.lexsort((key, cell))
    cell, key = cell[order], key[order]
    new = np.ones(len(cell), bool)
    new[1:] = (cell[1:] != cell[:-1]) | (key[1:] != key[:-1])
    cell, key = cell[new], key[new]
    if len(cell) == 0:
        return []
    _, size = _bounds(cell)
    met = np.repeat(size > 1, size)
    return [pa.record_batch([pa.array(cell[met]), pa.array(key[met])], names=["cell", "key"])]


def _links(found: list[tuple[int, int]]) -> list[pa.RecordBatch]:
    """Links of every node found to the least one that they lead to."""
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return [pa.record_batch([pa.array(x) for x in stars(pairs[:, 0], pairs[:, 1])], names=["a", "b"])]


def _span(keys: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the groups; near(i, others) tells which of the others are linked to i."""
    rest, links = np.arange(len(keys)), []
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            at = front.pop()
            hit = near(at, rest)
            if hit.any():
                links += [(int(x), int(keys[at])) for x in keys[rest[hit]]]
                front += rest[hit].tolist()
                rest = rest[~hit]
    return links


def _may_be_near(n: np.ndarray, bits: np.ndarray, held: np.ndarray, at: np.ndarray, a, b, p: int, q: int) -> np.ndarray:
    """False only for pairs that differ in too many elements, by sizes, places of odd parity, or counts (held[at], where at is not -1)."""
    most = (n[a] + n[b]) * (q - p)
    ok = np.abs(n[a] - n[b]) * (p + q) <= most
    a, b, most = (np.broadcast_to(x, ok.shape)[ok] for x in (a, b, most))
    out = np.zeros(len(ok), bool)
    even = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) * (p + q) <= most
    both = np.flatnonzero(even & (at[a] >= 0) & (at[b] >= 0))
    for i in range(0, len(both), 4096):
        k = both[i : i + 4096]
        even[k] = np.abs(held[at[a[k]]].astype(np.int16) - held[at[b[k]]]).sum(axis=1, dtype=np.int64) * (p + q) <= most[k]
    out[ok] = even
    return out


def _met(table: pa.Table, p: int, q: int) -> list[pa.RecordBatch]:
    """Links of the sets that may be near within units; sets known to be of one group need no test."""
    cell, key, known, n = _columns(table, "unit", "key", "known", "n")
    if len(cell) == 0:
        return []
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), _U).reshape(len(cell), -1)
    raw = table.column("counts").to_pylist()
    held = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, BITS)
    at = np.array([len(x) > 0 for x in raw])
    at = np.where(at, np.cumsum(at) - 1, -1)
    head, size = _bounds(cell)
    found: list[tuple[int, int]] = []
    for i in np.flatnonzero(size > _LARGE).tolist():
        cut = slice(head[i], head[i] + size[i])

        def near(one: int, rest: np.ndarray, known=known[cut], n=n[cut], bits=bits[cut], at=at[cut]) -> np.ndarray:
            out = known[rest] == known[one]
            out[~out] = _may_be_near(n, bits, held, at, one, rest[~out], p, q)
            return out

        found += _span(key[cut], near)
    small = size <= _LARGE
    left = np.flatnonzero(np.repeat(small, size))
    partners = np.repeat(head + size, size)[left] - left - 1
    cuts = np.searchsorted(np.cumsum(partners), np.arange(0, int(partners.sum()) + _PAIRS, _PAIRS), side="left")
    for a, b in zip(cuts, [*cuts[1:], len(left)]):
        m = partners[a:b]
        x = np.repeat(left[a:b], m)
        y = x + 1 + (np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m))
        near = _may_be_near(n, bits, held, at, x, y, p, q)
        found += list(zip(key[x[near]].tolist(), key[y[near]].tolist()))
    return _links(found)


def _verified(table: pa.Table, p: int, q: int) -> list[pa.RecordBatch]:
    """Groups (a, b) of the sets of units by exact comparison, but for those known to be of one group: b is the least node of the group of a."""
    found: list[tuple[int, int]] = []
    unit, keys, known = _columns(table, "unit", "key", "known")
    if len(unit) == 0:
        return []
    shingles, mine, low = table.column("shingles"), np.zeros(_MAP, bool), _U(_MAP - 1)
    for start, size in zip(*_bounds(unit)):
        key, first = np.unique(keys[start : start + size], return_index=True)
        # Views of the Arrow buffers: a unit's sets are in memory once.
        sets = [np.frombuffer(shingles[int(start + i)].as_buffer(), _U) for i in first]
        n = np.array([len(x) for x in sets])

        def near(at: int, rest: np.ndarray, sets=sets, n=n, known=known[start + first]) -> np.ndarray:
            least = -(-(n[at] + n[rest]) * p // (p + q))
            same = known[rest] == known[at]
            out = same | ((n[at] >= least) & (n[rest] >= least))
            mine[sets[at] & low] = True
            for k in np.flatnonzero(out & ~same).tolist():
                other = sets[rest[k]]
                # Common low bits are never fewer than common elements.
                out[k] = np.count_nonzero(mine[other & low]) >= least[k] and len(np.intersect1d(sets[at], other, assume_unique=True)) >= least[k]
            mine[sets[at] & low] = False
            return out

        found += _span(key, near)
    return _links(found)


def _tiled(members: DataFrame, large: DataFrame, tile: int) -> DataFrame:
    """(unit, key, known) of the first step: a tile for each node of a large cell, all of them for some; other cells are whole."""
    tiles = F.ceil(F.col("size") / tile)
    hub = F.pmod(F.xxhash64("key", F.lit(1)), F.col("size")) < HUBS
    own = F.pmod(F.xxhash64("key"), tiles)
    at = F.when(F.col("size").isNull(), F.array(F.lit(0).cast("long"))).when(hub, F.sequence(F.lit(0).cast("long"), tiles - 1)).otherwise(F.array(own))
    placed = members.join(large, "cell", "left").select("cell", "key", "known", "size", F.explode(at).alias("at"))
    unit = F.when(F.col("size").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", "at"))
    return placed.select(unit.alias("unit"), "key", "known")


def _tile_pairs(members: DataFrame, tile: int) -> DataFrame:
    """(unit, key, known) of the second step: pairs of tiles of a cell in which nodes of different known groups meet.

    The largest group of a cell has ``a`` tiles and the rest ``b``; each of the one meets each of the other, and those
    of the rest meet each other. What is copied is small where one group has most of the cell.
    """
    sizes = members.groupBy("cell", "known").agg(F.count("*").alias("n")).groupBy("cell")
    cells = sizes.agg(F.max(F.struct("n", "known")).alias("main"), F.sum("n").alias("size"), F.count("*").alias("groups")).where("groups > 1")
    cells = cells.select("cell", F.col("main.known").alias("main"), F.ceil(F.col("main.n") / tile).alias("a"), F.ceil((F.col("size") - F.col("main.n")) / tile).alias("b"))
    main = F.col("known") == F.col("main")
    placed = members.join(cells, "cell").withColumn("at", F.pmod(F.xxhash64("key"), F.when(main, F.col("a")).otherwise(F.col("b"))))
    upto = lambda end: F.sequence(F.lit(0).cast("long"), F.col(end) - 1)
    pair = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    of_main = F.transform(upto("b"), lambda r: pair(0, F.col("at"), r))
    others = F.filter(upto("b"), lambda r: r != F.col("at"))
    of_rest = F.concat(F.transform(upto("a"), lambda g: pair(0, g, F.col("at"))), F.transform(others, lambda r: pair(1, F.least(r, F.col("at")), F.greatest(r, F.col("at")))))
    placed = placed.select("cell", "key", "known", F.explode(F.when(main, of_main).otherwise(of_rest)).alias("pair"))
    return placed.select(F.xxhash64("cell", "pair.kind", "pair.i", "pair.j").alias("unit"), "key", "known")


def _linked(members: DataFrame, compare: Callable[[DataFrame], DataFrame], tile: int, apart: bool = False, links: DataFrame | None = None) -> DataFrame:
    """(node, root) of the groups that links within cells give, for members (cell, key, known) without repeats.

    ``links`` (a, b) are there from the start; ``known`` is the least node that they lead to, or else the key.
    ``compare`` gives links (a, b) that span the groups of each unit of (unit, key, known) rows. If a node is in one
    cell only (``apart``) and no cell is divided, they lead to the least node already. Units of equal hash do no harm.
    """
    large = materialize(members.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > tile), "large")
    tied = lambda found: components(materialize(found if links is None else found.unionByName(links), "found"))
    if large.isEmpty():
        found = compare(members.select(F.col("cell").alias("unit"), "key", "known"))
        return found.toDF("node", "root") if apart else tied(found)
    roots = tied(compare(_tiled(members, large, tile)))
    known = members.drop("known").join(large.select("cell"), "cell").join(roots.withColumnRenamed("node", "key"), "key", "left")
    known = materialize(known.select("cell", "key", F.coalesce("root", "key").alias("known")), "known")
    pairs = materialize(_tile_pairs(known, tile), "pairs")
    if pairs.isEmpty():
        return roots
    return components(materialize(compare(pairs).unionByName(roots.toDF("a", "b")), "found"))


def near_fingerprints(marked: DataFrame) -> DataFrame:
    """(key, known) of the sets whose SimHash fingerprint is that of others or linked to theirs: the least key of each such group."""
    nodes = materialize(marked.groupBy("key").agg(F.first("fp").alias("fp")), "fingerprints")
    roots = components(simhash.links_of(nodes.select("fp").distinct()))
    rooted = materialize(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("key", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("key").alias("known"), F.count("*").alias("n")).where("n > 1")
    return materialize(rooted.join(least, "root").select("key", "known"), "near-fingerprints")


def roots_of(docs: DataFrame, marked: DataFrame, n: int, similarity: float) -> DataFrame:
    """(node, root) of the groups that all pairs of sets within the similarity give; roots themselves are not listed."""
    exact = Fraction(str(similarity))
    p, q = exact.numerator, exact.denominator
    near = near_fingerprints(marked)
    cells, weights = _hot(docs, n)
    order = np.argsort(cells.view(_U))
    hot, weight = cells.view(_U)[order], weights[order]

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, h, offs, keys in _sets(batches, n):
            row, size = _rows(offs), np.diff(offs)
            if len(hot) and len(h):
                at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                order = np.lexsort((h, np.where(hot[at] == h, weight[at], 0), row))
                h = h[order]
            take = size - -(-size * p // q) + 1
            first = np.arange(len(h)) - offs[:-1][row] < take[row]
            once = np.zeros(len(keys), bool)
            once[_new(keys, seen)] = True
            first &= once[row]
            yield pa.record_batch([pa.array(h[first].view(np.int64)), pa.array(keys[row[first]].view(np.int64))], names=["cell", "key"])

    filed = docs.select("text").mapInArrow(file, "cell long, key long")
    shared = materialize(filed.repartition(F.col("cell")).sortWithinPartitions("cell").mapInArrow(lambda b: _by_cell(b, "cell", _shared), "cell long, key long"), "cells")
    looks = marked.join(shared.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("counts").alias("counts"))

    def meet(placed: DataFrame) -> DataFrame:
        met = placed.join(looks, "key").select("unit", "key", "known", "n", "bits", "counts").repartition(F.col("unit")).sortWithinPartitions("unit")
        return met.mapInArrow(lambda b: _by_cell(b, "unit", lambda t: _met(t, p, q)), "a long, b long").distinct()

    members = materialize(shared.join(near, "key", "left").select("cell", "key", F.coalesce("known", "key").alias("known")), "members")
    roots = _linked(members, meet, CELL_TILE, links=near.where("key <> known").toDF("a", "b"))
    blocks = roots.select(F.col("node").alias("key"), F.col("root").alias("cell")).unionByName(roots.select(F.col("root").alias("key"), F.col("root").alias("cell")).distinct())
    blocks = materialize(blocks.withColumn("known", F.col("key")), "blocks")

    def verify(placed: DataFrame) -> DataFrame:
        mask = np.zeros(_MAP, bool)
        mask[placed.select(F.col("key").bitwiseAND(_MAP - 1).alias("at")).distinct().toArrow().column("at").to_numpy()] = True
        packed = np.packbits(mask)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, wanted = set(), np.unpackbits(packed).astype(bool)
            for _, h, offs, keys in _sets(batches, n):
                rows = _new(keys, seen)
                rows = rows[wanted[(keys[rows] & _U(_MAP - 1)).astype(np.int64)]]
                yield pa.record_batch([pa.array(keys[rows].view(np.int64)), _binary([h[offs[i] : offs[i + 1]] for i in rows.tolist()])], names=["key", "shingles"])

        sets = docs.select("text").mapInArrow(whole, "key long, shingles binary").join(placed, "key").select("unit", "key", "known", "shingles")
        sorted_ = sets.repartition(F.col("unit")).sortWithinPartitions("unit", "key")
        return sorted_.mapInArrow(lambda b: _by_cell(_once(b, "unit"), "unit", lambda t: _verified(t, p, q)), "a long, b long")

    return _linked(blocks, verify, BLOCK_TILE, apart=True)


def groups(docs: DataFrame, *ids: str, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The columns ``ids`` of every row, the key of its shingle set and its group: rows that links lead to have the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, offs, keys in _sets(batches, shingle):
            yield pa.record_batch([*[part.column(c) for c in ids], pa.array(keys.view(np.int64)), pa.array(np.diff(offs)), pa.array(np.array([simhash.fingerprint(h[a:b]) for a, b in zip(offs, offs[1:])], _U).view(np.int64)), _binary(parity(h, offs)), pa.array([counts(h[a:b]) if b - a >= LONG else b"" for a, b in zip(offs, offs[1:])], pa.binary())], names=[*ids, "key", "n", "fp", "bits", "counts"])

    bounded_batches(docs.sparkSession)
    docs = docs.select(*ids, "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name in ids)
    marked = materialize(docs.mapInArrow(run, f"{schema}, key long, n long, fp long, bits binary, counts binary"), "sets")
    roots = materialize(roots_of(docs, marked, shingle, similarity), "roots")
    return marked.select(*ids, "key").join(roots.withColumnRenamed("node", "key"), "key", "left").select(*ids, "key", F.coalesce("root", "key").alias("group"))
