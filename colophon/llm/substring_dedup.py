"""Substring dedup by level-wise doubling.

The search starts with short runs of ``base`` words and extends only what is repeated: runs that two different texts
share are extended to about twice their length, the window, these to two windows, these to four, until no candidates
survive. The first level is sampled without loss: of the short runs inside each window only the one with the least
hash (an anchor) is looked at, and equal windows have equal anchors. Windows in a row with one anchor are one
candidate, which starts where the first of them does; its hashes at all doubled lengths travel with it, each made of
the two halves before it, so that every level is one grouping and one join of those that survived the last.

A candidate whose run of two windows also occurs in a document with a smaller doc_id covers all its windows: the run
stands for them. The windows of the other candidates are compared one by one. Levels beyond tell how long the
repeats are (``longest``). Keys are 128 bits, of the anchor and of the run; both rest on a 64-bit hash of each word,
so different words of one hash would be taken for equal (expected only from some billion distinct words on).

Defined cases: a null text has no words; a null doc_id takes no part in comparisons, and its row keeps all its words;
rows that repeat a doc_id are judged alike if their texts are equal and each by its own text otherwise, and never
against each other; ties cannot occur, as only smaller doc_ids count; a very long text is handled whole (its word
hashes are in a task's memory at once, some 100 bytes a word); an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.llm.common import bounded_batches, discard, hash_windows, hash_words, materialize, mix, own_columns, spans_of, split_words, text_bytes, text_steps

#: Words in a window, and in the short runs of the first level: twice as many reach the window.
WINDOW = 13
BASE = 7

_U = np.uint64
_CANDIDATES = "anchor long, doc_id long, mark long, start int, windows array<long>, doubled array<long>"


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice, and per row the index of its first word."""
    data, offs = text_bytes(part.column("text"))
    starts, ends, word_offs = split_words(data, offs)
    return hash_words(data, starts, ends), word_offs


def _anchors(words: np.ndarray, word_offs: np.ndarray, window: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The starts and rows of all windows, and each window's least short-run hash."""
    short = hash_windows(words, base)
    starts, rows = spans_of(word_offs, window)
    if len(starts) == 0:
        return starts, rows, np.zeros(0, np.uint64)
    least = short[starts].copy()
    for j in range(1, window - base + 1):
        np.minimum(least, short[starts + j], out=least)
    return starts, rows, least


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the row before it."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _first_level(window: int, base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_steps(batches, "text"):
            words, word_offs = _words(part)
            _, rows, least = _anchors(words, word_offs, window, base)
            keep = _changes(least, rows)
            least, rows = least[keep], rows[keep]
            order = np.lexsort((least, rows))
            least, rows = least[order], rows[order]
            keep = _changes(least, rows)
            least, rows = least[keep], rows[keep]
            yield pa.record_batch([pa.array(least.view(np.int64)), *[pa.array(part.column(c).to_numpy(zero_copy_only=False)[rows]) for c in ("doc_id", "mark")]], names=["anchor", "doc_id", "mark"])

    return run


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _extend(window: int, base: int):
    """Of documents with shared anchors: their candidates with the hashes of their windows and doubled runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_steps(batches, "text"):
            words, word_offs = _words(part)
            at, rows, least = _anchors(words, word_offs, window, base)
            anchors = part.column("anchors")
            ends_of, known = anchors.offsets.to_numpy(), anchors.values.to_numpy(zero_copy_only=False).view(np.uint64)
            shared = np.zeros(len(at), bool)
            bounds = np.searchsorted(rows, np.arange(part.num_rows + 1))
            for i in range(part.num_rows):
                a, b = bounds[i], bounds[i + 1]
                shared[a:b] = np.isin(least[a:b], known[ends_of[i] : ends_of[i + 1]])
            if not shared.any():
                continue
            # Windows in a row with one anchor, at most as many as one short run lies in, are a candidate.
            head = np.flatnonzero(_changes(least, rows))
            within = np.arange(len(at)) - np.repeat(head, np.diff(np.concatenate([head, [len(at)]])))
            first = shared & (within % (window - base + 1) == 0)
            start = np.flatnonzero(first)
            own = np.bincount(np.cumsum(first)[shared] - 1, minlength=len(start))
            run_hash = hash_windows(words, window, 1)
            hashes = run_hash[at[shared]]
            at, rows = at[start], rows[start]
            room = word_offs[rows + 1] - at
            # Each doubled run is hashed from its halves.
            columns, length = [], window
            while (room >= 2 * length).any():
                run_hash = mix(run_hash[:-length] * _U(0x9E3779B97F4A7C15) + (run_hash[length:] ^ _U(0xD6E8FEB86659FD93)))
                length *= 2
                fits = room >= length
                value = np.zeros(len(at), np.uint64)
                value[fits] = run_hash[at[fits]]
                columns.append((fits, value))
            fits = np.stack([f for f, _ in columns], axis=1) if columns else np.zeros((len(at), 0), bool)
            values = np.stack([v for _, v in columns], axis=1) if columns else np.zeros((len(at), 0), np.uint64)
            ids, marks = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))
            yield pa.record_batch(
                [
                    pa.array(least[start].view(np.int64)),
                    pa.array(ids[rows]),
                    pa.array(marks[rows]),
                    pa.array((at - word_offs[rows]).astype(np.int32)),
                    _lists(hashes, own),
                    _lists(values[fits], fits.sum(axis=1)),
                ],
                names=["anchor", "doc_id", "mark", "start", "windows", "doubled"],
            )

    return run


def _cut(window: int, digests: bool):
    """The words that no span covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_steps(batches, "text"):
            n_words, removed, kept = [], [], []
            spans = part.column("spans")
            lists = spans.offsets.to_numpy()
            from_word, size = (spans.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            for i, (text, copy) in enumerate(zip(part.column("text").to_pylist(), part.column("copy").to_pylist())):
                words = (text or "").encode().split()
                gone = np.zeros(len(words), bool)
                a, b = lists[i], lists[i + 1]
                if copy and len(words) >= window:
                    gone[:] = True
                elif b > a:
                    delta = np.zeros(len(words) + 1, np.int64)
                    np.add.at(delta, from_word[a:b], 1)
                    np.add.at(delta, from_word[a:b] + size[a:b], -1)
                    gone = np.cumsum(delta[:-1]) > 0
                left = b" ".join(words if not gone.any() else [w for w, g in zip(words, gone.tolist()) if not g])
                n_words.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(hashlib.sha256(left).hexdigest() if digests else left.decode())
            yield pa.record_batch([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), part.column("longest")], names=["doc_id", "n_words", "n_removed", "kept", "longest"])

    return run


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that more than one document has, with the smallest doc_id."""
    return rows.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")


def _extended(rows: DataFrame, run: Column, name: str) -> DataFrame:
    """``rows`` with ``first``, the smallest doc_id that has the run too, or null if no other has.

    What is repeated is written first: joined to a grouping of its own stage, rows of a hot run could not be split.
    """
    keyed = rows.withColumn("run", run)
    shared = materialize(_repeated(keyed.where("run IS NOT NULL"), "anchor", "run"), f"{name}-repeated", large=True)
    return keyed.join(shared, ["anchor", "run"], "left")


def remove_repeats(docs: DataFrame, window: int = WINDOW, base: int = BASE, digests: bool = False) -> DataFrame:
    """Remove each word covered by a window of words that also starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept (the words that stay joined by single spaces, or with ``digests`` the
    SHA-256 of that text) and longest: the greatest of the lengths window, twice the window and so on at which a run that
    starts with a candidate occurs in another document; null for texts without one, and for copies of a whole text.
    """
    if not 0 < base <= window:
        raise ValueError("base must lie between 1 and window")
    bounded_batches(docs.sparkSession)
    # Rows are told apart by doc_id and text; texts stay where they are, and only marks travel.
    docs = own_columns(docs, "doc_id", "text").withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    known = docs.where("doc_id IS NOT NULL")
    ids = known.where(F.length("text") >= 2 * window - 1).select("doc_id", "mark", F.md5("text").alias("digest"))
    firsts = materialize(_repeated(ids, "digest"), "copies", large=True)
    copies = ids.join(firsts, "digest").where("doc_id > first").select("doc_id", "mark", F.lit(True).alias("copy"))

    # Short runs that two different texts share.
    anchors = known.mapInArrow(_first_level(window, base), "anchor long, doc_id long, mark long")
    shared = materialize(anchors.groupBy("anchor").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("a < b").select("anchor"), "level-short", large=True)
    found = anchors.join(shared, "anchor").select("doc_id", "mark", F.lit(False).alias("copy"), "anchor")
    notes = found.unionByName(copies.withColumn("anchor", F.lit(None).cast("long"))).groupBy("doc_id", "mark").agg(F.max("copy").alias("copy"), F.collect_list("anchor").alias("anchors"))
    open_docs = known.join(notes.where("NOT copy"), ["doc_id", "mark"]).select("doc_id", "mark", "text", "anchors")
    candidates = materialize(open_docs.mapInArrow(_extend(window, base), _CANDIDATES), "candidates", large=True)

    # The window: candidates whose first one is repeated go on.
    level = _extended(candidates, F.get("windows", F.lit(0)), "level-window")
    rest = F.when(F.col("first").isNotNull(), F.col("doubled"))
    one = materialize(level.select("anchor", "doc_id", "mark", "start", "windows", rest.alias("doubled")), "level-window", large=True)
    discard(candidates)

    # Two windows: a run that a smaller doc_id has stands for all windows of its candidate.
    level = _extended(one, F.get("doubled", F.lit(0)), "level-double")
    settled = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    longer = F.when(F.col("first").isNotNull(), F.slice("doubled", 2, F.size("doubled")))
    length = F.when(F.col("first").isNotNull(), 2 * window).when(F.col("doubled").isNotNull(), window)
    two = materialize(level.select("anchor", "doc_id", "mark", "start", F.when(~settled, F.col("windows")).alias("windows"), longer.alias("doubled"), length.alias("length")), "level-double", large=True)
    discard(one)
    lengths = [two.where("length IS NOT NULL").groupBy("doc_id", "mark").agg(F.max("length").alias("length"))]

    # The windows that no longer run stands for.
    single = two.where("windows IS NOT NULL").select("anchor", "doc_id", "mark", "start", F.posexplode("windows").alias("at", "run")).withColumn("start", (F.col("start") + F.col("at")).cast("int"))
    repeated = materialize(_repeated(single, "anchor", "run"), "windows", large=True)
    hits = single.join(repeated, ["anchor", "run"]).where("doc_id > first").select("doc_id", "mark", "start", F.lit(window).alias("size"))
    runs = two.where("windows IS NULL").select("doc_id", "mark", "start", F.lit(2 * window).alias("size"))

    # Longer and longer runs, until no candidates survive.
    alive, words, before = two.where("size(doubled) > 0").select("anchor", "doc_id", "mark", "doubled"), 2 * window, None
    while True:
        words *= 2
        level = _extended(alive, F.get("doubled", F.lit(0)), "level-longer").where("first IS NOT NULL").select("anchor", "doc_id", "mark", F.slice("doubled", 2, F.size("doubled")).alias("doubled"))
        now = materialize(level, "level-longer", large=True)
        if before is not None:
            discard(before)
        found = materialize(now.select("doc_id", "mark").distinct().withColumn("length", F.lit(words)), "lengths")
        if found.isEmpty():
            break
        lengths.append(found)
        before, alive = now, now.where("size(doubled) > 0")

    copied = F.lit(None).cast("int")
    notes = copies.select("doc_id", "mark", "copy", copied.alias("start"), copied.alias("size"), copied.alias("length"))
    for spans in (hits, runs):
        notes = notes.unionByName(spans.select("doc_id", "mark", F.lit(False).alias("copy"), "start", "size", copied.alias("length")))
    for found in lengths:
        notes = notes.unionByName(found.select("doc_id", "mark", F.lit(False).alias("copy"), copied.alias("start"), copied.alias("size"), "length"))
    span = F.when(F.col("start").isNotNull(), F.struct("start", "size"))
    notes = materialize(notes.groupBy("doc_id", "mark").agg(F.max("copy").alias("copy"), F.collect_list(span).alias("spans"), F.coalesce(F.max("length"), F.when(F.count(span) > 0, window)).cast("long").alias("longest")), "spans", large=True)
    discard(two)
    cut = docs.join(notes.hint("merge"), ["doc_id", "mark"], "left").select("doc_id", "text", "copy", "spans", "longest")
    return cut.mapInArrow(_cut(window, digests), "doc_id long, n_words long, n_removed long, kept string, longest long")


def digest(docs: DataFrame, window: int = WINDOW, base: int = BASE) -> DataFrame:
    """The columns of the query contract, and longest."""
    return remove_repeats(docs, window, base, digests=True).withColumnRenamed("kept", "kept_sha256")
