"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint is mapped to the bit counts of its segments of ``SEGMENT`` bits. The Manhattan distance of two such
vectors is never above the Hamming distance, so all links lie within Manhattan distance ``RADIUS`` of each other.
The range join runs on a grid: the vector is cut in two halves, and of two linked fingerprints one half differs
by at most RADIUS // 2 = 1, so a fingerprint is filed under both half vectors and, as a guest, under the half
vectors with one count raised. Pairs that meet are tested for Manhattan distance, then verified bit by bit.
A cell of many fingerprints is divided again, in the same way, by the two quarters of its other half vector.
Inside a cell only links that span its groups are passed on, never all pairs; equal fingerprints are joined first.
The largest cell, half of whose segments have one bit each, holds about one in 65,536 fingerprints as residents.

Defined cases: null and empty texts have the fingerprint zero and link like any other; texts of fewer than
three words have one shingle, the whole sequence; a null doc_id keeps its row, but is no component's id unless the
group has no other; repeated rows fall in one component; a very long text is hashed
whole, with its words and shingle hashes in memory at once; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm.common import LOWER_AZ, bounded_batches, materialize, own_columns, text_steps
from colophon.llm.components import components

SHINGLE = 3
SEED = 42
SEGMENT = 2
RADIUS = 2

_U = np.uint64
_STEP = 1 << 16
#: Pairs tested at once, and the size of a cell from which it is divided, or searched fingerprint by fingerprint if it has been.
_PAIRS, _LARGE = 1 << 20, 64


def shingle_hashes(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each n-word shingle of the text, A-Z lower-cased, words joined by one space."""
    words = (text or "").encode().translate(LOWER_AZ).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= n:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - n + 1].tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist())), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _STEP):
        bits = np.unpackbits(hashes[i : i + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):
            ones += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_steps(batches, "text"):
            fps = np.array([fingerprint(shingle_hashes(t)) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([part.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return own_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """The embedding: per fingerprint 32 counts of set bits, each a 2-bit field of one 64-bit word."""
    low = _U(0x5555555555555555)
    return (fps & low) + ((fps >> _U(1)) & low)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 20_000) for i in range(0, batch.num_rows, 20_000)):
            fps = part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            counts = segment_counts(fps)
            keys, guests, who = [], [], []
            for half in (0, 1):
                vector = (counts >> _U(32 * half)) & _U(0xFFFFFFFF)
                base = vector | (_U(half) << _U(32))
                keys.append(base), guests.append(np.zeros(len(fps), bool)), who.append(fps)
                for s in range(16):
                    room = ((vector >> _U(2 * s)) & _U(3)) < _U(SEGMENT)
                    keys.append(base[room] + (_U(1) << _U(2 * s))), guests.append(np.ones(int(room.sum()), bool)), who.append(fps[room])
            yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(guests)), pa.array(np.concatenate(who).view(np.int64))], names=["cell", "guest", "fp"])


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of the embeddings within the radius, then the exact Hamming distance."""
    x, y = segment_counts(a), segment_counts(b)
    apart = np.zeros(len(a), np.uint8)
    for s in range(0, 64, SEGMENT):
        apart += np.abs(((x >> _U(s)) & _U(3)).astype(np.int8) - ((y >> _U(s)) & _U(3)).astype(np.int8)).astype(np.uint8)
    out = apart <= RADIUS
    out[out] = np.bitwise_count(a[out] ^ b[out]) <= RADIUS
    return out


def _span(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the groups of a large cell; memory and links are in proportion to its size."""
    rest, links = fps.copy(), []
    bits = np.bitwise_count(rest).astype(np.int16)
    while len(rest):
        front, rest, bits = [rest[0]], rest[1:], bits[1:]
        while front and len(rest):
            at = front.pop()
            # The Manhattan distance is at least the difference of all set bits.
            hit = np.abs(bits - np.int16(int(at).bit_count())) <= RADIUS
            hit[hit] = np.bitwise_count(rest[hit] ^ at) <= RADIUS
            if hit.any():
                links += [(int(x), int(at)) for x in rest[hit]]
                front += list(rest[hit])
                rest, bits = rest[~hit], bits[~hit]
    return links


def _divided(cell: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fingerprints of a cell under the quarters of its other half vector, and as guests under those with one count raised."""
    other = 1 - (int(cell) >> 32 & 1)
    vector = (segment_counts(fps) >> _U(32 * other)) & _U(0xFFFFFFFF)
    keys, guests, who = [], [], []
    for quarter in (0, 1):
        part = (vector >> _U(16 * quarter)) & _U(0xFFFF)
        base = part | (_U(quarter) << _U(16))
        keys.append(base), guests.append(np.zeros(len(fps), bool)), who.append(fps)
        for s in range(8):
            room = ((part >> _U(2 * s)) & _U(3)) < _U(SEGMENT)
            keys.append(base[room] + (_U(1) << _U(2 * s))), guests.append(np.ones(int(room.sum()), bool)), who.append(fps[room])
    key, guest, fp = np.concatenate(keys), np.concatenate(guests), np.concatenate(who)
    order = np.lexsort((guest, key))
    return key[order], guest[order], fp[order]


def _cell_links(cell: np.ndarray, guest: np.ndarray, fp: np.ndarray, divided: bool = False) -> list[tuple[int, int]]:
    """Links inside whole cells, sorted by cell with residents first."""
    head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.concatenate([head, [len(cell)]]))
    residents = np.add.reduceat((~guest).astype(np.int64), head)
    links: list[tuple[int, int]] = []
    for i in np.flatnonzero((size > _LARGE) & (residents > 0)).tolist():
        inside = fp[head[i] : head[i] + size[i]]
        links += _span(inside) if divided else _cell_links(*_divided(cell[head[i]], inside), divided=True)
    small = np.flatnonzero((size <= _LARGE) & (size > 1) & (residents > 0))
    # Each resident meets what follows it in its cell: other residents, then guests.
    first = np.repeat(head[small], residents[small])
    n = residents[small]
    left = first + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    partners = np.repeat(head[small] + size[small], n) - left - 1
    cuts = np.searchsorted(np.cumsum(partners), np.arange(0, int(partners.sum()) + _PAIRS, _PAIRS), side="left")
    for a, b in zip(cuts, [*cuts[1:], len(left)]):
        m = partners[a:b]
        x = np.repeat(left[a:b], m)
        y = x + 1 + (np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m))
        near = _near(fp[x], fp[y])
        links += list(zip(fp[x[near]].tolist(), fp[y[near]].tolist()))
    return links


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] | None = None

    def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
        found = np.array(sorted(set(links)), np.uint64).reshape(-1, 2)
        return pa.record_batch([pa.array(np.ascontiguousarray(found[:, k]).view(np.int64)) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        got = [batch.column("cell").to_numpy(zero_copy_only=False), batch.column("guest").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)]
        if held is not None:
            got = [np.concatenate(x) for x in zip(held, got)]
        if len(got[0]) == 0:
            continue
        last = int(np.searchsorted(got[0], got[0][-1], side="left"))  # the last cell may go on in the next batch
        held = [x[last:].copy() for x in got]
        if last:
            yield out(_cell_links(*(x[:last] for x in got)))
    if held is not None and len(held[0]):
        yield out(_cell_links(*held))


def links_of(fps: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints that give the same groups as all pairs within the radius."""
    cells = fps.select("fp").mapInArrow(_cells, "cell long, guest boolean, fp long")
    return cells.repartition(F.col("cell")).sortWithinPartitions("cell", "guest").mapInArrow(_join, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links lead to."""
    marked = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links_of(distinct))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    of = materialize(grouped.select("fp", "root").join(least, "root").select("fp", "component_id"), "components")
    return marked.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
