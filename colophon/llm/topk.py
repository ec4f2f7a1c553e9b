"""Exact top-k inner products by columnar branch-and-bound.

Candidates lie in groups of bounded size, dimension by dimension (vertical layout). For a query, partial scores
grow one block of dimensions at a time; by Cauchy-Schwarz the remaining mass of query and candidate bounds what
can still come, and candidates whose bound is under the k-th best score known are compacted away. Blocks of
queries are sent to every group; nothing is broadcast, and a group's best k per query meet in one grouping. So what
is shuffled grows as queries times groups; that is one vector for every 32,768 comparisons, and a grid of query and
candidate blocks of the same memory would send as much, as each side then goes to all blocks of the other.

Defined cases: rows with a null id or vector, or a null or non-finite component, take no part; a shorter vector
counts as zero in the missing dimensions; ties go to the smaller vec_id; repeated candidate rows take a rank each,
while repeated query rows are one query (of different vectors under one id the least one); a query without
candidates has no rows; extra columns are ignored. Scores are exact for components of up to 2**20 in size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.common import bounded_batches, own_columns

SCALE = 1024
K = 10
#: Dimensions added at once, candidates in a group, queries in a block.
DIMENSIONS, GROUP, BLOCK = 16, 32_768, 256


def usable(vectors: DataFrame) -> DataFrame:
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return own_columns(vectors, "vec_id", "embedding").where(F.coalesce(ok, F.lit(False)))


def _matrix(vectors: pa.Array, scale: int) -> np.ndarray:
    """Integer components as exact doubles, one row per dimension; shorter vectors are filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    d = int(sizes.max(initial=0))
    if len(sizes) and (sizes == d).all():
        return np.ascontiguousarray(values.reshape(len(sizes), d).T)
    out = np.zeros((d, len(sizes)))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = values
    return out


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """Matrices side by side, all as tall as the tallest."""
    d = max((len(p) for p in parts), default=0)
    return np.hstack([np.pad(p, ((0, d - len(p)), (0, 0))) for p in parts]) if parts else np.zeros((0, 0))


def search(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int, step: int = DIMENSIONS) -> list[tuple[int, int, int]]:
    """(query, id, score) of each query's k best. ``queries`` and ``columns`` are dimension by row."""
    d = max(len(queries), len(columns))
    queries, columns = (np.pad(x, ((0, d - len(x)), (0, 0))) for x in (queries, columns))
    cuts = list(range(0, d, step)) or [0]
    mass = [np.sqrt((columns[c:] ** 2).sum(axis=0)) for c in cuts] + [np.zeros(columns.shape[1])]
    out: list[tuple[int, int, int]] = []
    for j, qid in enumerate(query_ids.tolist()):
        q = queries[:, j]
        alive = np.flatnonzero(ids != qid)
        partial = np.zeros(len(alive))
        least = -np.inf
        for n, c in enumerate(cuts):
            if not len(alive):
                break
            partial = partial + q[c : c + step] @ columns[c : c + step][:, alive]
            rest = np.sqrt((q[c + step :] ** 2).sum()) * mass[n + 1][alive]
            bound = partial + rest
            if len(alive) > k:
                if c + step < d:
                    some = np.argpartition(-bound, k - 1)[:k]
                    least = max(least, np.sort(q @ columns[:, alive[some]])[0])
                else:
                    least = max(least, -np.partition(-partial, k - 1)[k - 1])
                keep = bound * (1 + 1e-9 * np.sign(bound)) + 1e-6 >= least
                alive, partial = alive[keep], partial[keep]
        best = np.lexsort((ids[alive], -partial))[:k]
        out += [(qid, int(ids[alive[b]]), int(partial[b])) for b in best]
    return out


def _search_groups(k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group, in each group the candidates before the queries."""
        group, ids, parts, columns = None, [], [], None
        for batch in batches:
            grp, asks = batch.column("grp").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((grp[1:] != grp[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                if grp[a] != group:
                    group, ids, parts, columns = grp[a], [], [], None
                for i in range(a, b, BLOCK if asks[a] else GROUP):
                    part = batch.slice(i, min(b - i, BLOCK if asks[a] else GROUP))
                    numbers = part.column("vec_id").to_numpy()
                    matrix = _matrix(part.column("embedding"), scale)
                    if not asks[a]:
                        ids.append(numbers)
                        parts.append(matrix)
                        continue
                    if columns is None:
                        columns, held, parts = _joined(parts), np.concatenate(ids) if ids else np.zeros(0, np.int64), []
                    found = search(matrix, numbers, columns, held, k) if len(held) else []
                    yield pa.record_batch([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query, its own row left out."""
    bounded_batches(candidates.sparkSession)
    cand = usable(candidates)
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    groups = max(-(-cand.count() // group), 6)
    # By row, as equal rows may be many.
    dealt = cand.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")).withColumn("is_query", F.lit(False))
    sent = asked.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("is_query", F.lit(True))
    both = dealt.unionByName(sent).repartition(groups, "grp").sortWithinPartitions("grp", "is_query")
    found = both.mapInArrow(_search_groups(k, scale), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
