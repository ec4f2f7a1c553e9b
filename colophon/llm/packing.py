"""Best-fit packing of documents into sequences, in hierarchical residual rounds.

Documents become token ids and an end id; only those longer than a sequence are cut, with the short piece first.
In each round the open items (pieces, later underfull bins) are dealt to tasks of bounded size, packed there by
best fit decreasing, and bins with at most ``slack`` free places leave; the underfull ones are the items of the
next round, of fewer tasks. Rounds end when one task has seen all that was left, or when a round leaves more than
``STUCK`` of its items open: items that large do not fit together in any task, and as many rounds would follow as
there are bins to spare (with 20,000 items a task the sequences of 10,000 documents are one more than the tokens need). A bin travels as its fill and a byte string of fixed-size member records.

Defined cases: null and empty texts are the end id alone; a null doc_id is packed and returned as null; repeated
rows are packed each; a very long text is cut into as many pieces as it needs, its ids in memory at once; ties go to the bin opened first; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm.common import bounded_batches, materialize, own_columns, text_steps

CAPACITY = 1024
END_ID = 2
#: Free places up to which a bin counts as nearly full, and the items that one task packs.
SLACK = 2
ITEMS_PER_TASK = 20_000
#: Share of a round's items that stay open when packing has come to its end.
STUCK = 0.98

_MEMBER = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
#: This string is one id (50256) to the tokenizer; the rank file has no special tokens, so such texts go to the tokenizer itself.
_SPECIAL = "<|endoftext|>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=4)
def _encoder(path: str):
    """Text to ids. Where the same vocabulary lies beside ``path`` as ranks, tiktoken gives the same ids about four times as fast."""
    import os

    from tokenizers import Tokenizer

    slow = functools.lru_cache(maxsize=1)(lambda: Tokenizer.from_file(path))

    def by_tokenizer(text: str) -> np.ndarray:
        return np.array(slow().encode(text, add_special_tokens=False).ids, np.uint32)

    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return by_tokenizer
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return lambda text: by_tokenizer(text) if _SPECIAL in text else fast.encode_to_numpy(text, disallowed_special=())


def tokenize(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for part in text_steps(batches, "text"):
            doc, piece, start, length, crc, ids_out = [], [], [], [], [], []
            for d, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = np.append(encode(text) if text else np.zeros(0, np.uint32), end_id).astype("<u4")
                at, k = 0, 0
                while at < len(ids):
                    n = len(ids) - at if len(ids) <= capacity else (len(ids) - at) % capacity or capacity
                    cut = ids[at : at + n]
                    doc.append(d), piece.append(k), start.append(at), length.append(n), crc.append(zlib.crc32(cut.tobytes()))
                    if with_ids:
                        ids_out.append(cut.astype(np.int32))
                    at, k = at + n, k + 1
            columns = {"doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array(ids_out, pa.list_(pa.int32()))
            yield pa.record_batch(list(columns.values()), names=list(columns))

    bounded_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return own_columns(docs, "doc_id", "text").mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit decreasing; bins as lists of item numbers. Free places are looked up in one bit field."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    field = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fits = field >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                field ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room - n:
            by_room[room - n].append(b)
            field |= 1 << (room - n)
    return bins


def _pack(capacity: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("fill").to_numpy(zero_copy_only=False), b.column("members").to_pylist()) for b in batches]
        if not parts:
            return
        fills, members = np.concatenate([x for x, _ in parts]), [m for _, ms in parts for m in ms]
        # The order in which rows arrive may differ when a lost task runs again; this order does not.
        order = sorted(range(len(members)), key=members.__getitem__)
        fills, members = fills[order], [members[i] for i in order]
        bins = best_fit(fills, capacity)
        sums = np.array([int(fills[b].sum()) for b in bins], np.int64)
        for i in range(0, len(bins), 5_000):
            yield pa.record_batch([pa.array(sums[i : i + 5_000]), pa.array([b"".join(members[j] for j in b) for b in bins[i : i + 5_000]], pa.binary()), pa.array(sums[i : i + 5_000] < capacity - slack)], names=["fill", "members", "open"])

    return run


def _as_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = np.zeros(b.num_rows, _MEMBER)
        doc = b.column("doc_id")
        rows["known"] = np.asarray(doc.is_valid())
        rows["doc_id"] = doc.fill_null(0).to_numpy(zero_copy_only=False)
        for name, column in (("piece", "piece"), ("start", "start"), ("length", "length"), ("crc", "ids_crc32")):
            rows[name] = b.column(column).to_numpy(zero_copy_only=False)
        raw, w = rows.tobytes(), _MEMBER.itemsize
        yield pa.record_batch([b.column("length"), pa.array([raw[i : i + w] for i in range(0, len(raw), w)], pa.binary())], names=["fill", "members"])


def _as_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 5_000):
            part = b.slice(i, 5_000)
            raw = part.column("members").to_pylist()
            rows = np.frombuffer(b"".join(raw), _MEMBER)
            count = np.array([len(x) // _MEMBER.itemsize for x in raw])
            ends = np.cumsum(rows["length"].astype(np.int64))
            before = np.concatenate([[0], ends])[np.cumsum(count) - count]
            offset = ends - rows["length"] - np.repeat(before, count)
            sequence = np.repeat(part.column("sequence_id").to_numpy(zero_copy_only=False), count)
            yield pa.record_batch(
                [pa.array(rows["doc_id"].copy(), mask=rows["known"] == 0), pa.array(rows["piece"].copy()), pa.array(rows["start"].copy()), pa.array(rows["length"].astype(np.int64)), pa.array(rows["crc"].astype(np.int64)), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """Places for the rows of ``tokenize``: the pieces with sequence_id and offset."""
    pieces = materialize(pieces.drop("ids"), "pieces")
    full = pieces.where(F.col("length") >= capacity)
    items = pieces.where(F.col("length") < capacity).mapInArrow(_as_items, "fill long, members binary")
    closed = [full.mapInArrow(_as_items, "fill long, members binary")]
    count = pieces.where(F.col("length") < capacity).count()
    while count:
        tasks = -(-count // per_task)
        # By row too, so that rows equal byte for byte are dealt to all tasks; the items are read from written tables, so a row keeps its number.
        dealt = items.repartition(tasks, F.xxhash64("members", F.monotonically_increasing_id() % 1021))
        packed = materialize(dealt.mapInArrow(_pack(capacity, slack), "fill long, members binary, open boolean"), "packed")
        left = packed.where("open").count()
        if tasks == 1 or left > STUCK * count:
            closed.append(packed.select("fill", "members"))
            break
        closed.append(packed.where("NOT open").select("fill", "members"))
        items, count = packed.where("open").select("fill", "members"), left
    bins = closed[0]
    for more in closed[1:]:
        bins = bins.unionByName(more)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return bins.select("members", F.monotonically_increasing_id().alias("sequence_id")).mapInArrow(_as_pieces, schema)
