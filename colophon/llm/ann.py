"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Rows are dealt to shards of bounded size. In a shard equal vectors are one node with all their ids. The graph begins
at random; then, in two rounds, a batch of nodes at a time searches greedily from the middle node, what it met on the
way proposes neighbours, and pruning keeps a proposal unless a nearer neighbour already kept is nearer to it by the
factor ``ALPHA`` (the first round prunes without slack). Every edge is offered to its other end too, which prunes again
when it has too many. Queries are searched in every shard with a beam of the best nodes known; the shards' finds, with
their exact cosines, meet in one grouping. Every row is in an index, none is sampled.

Vectors are compared at unit length, where the nearest by distance is the nearest by cosine.

Defined cases: rows with a null id or vector, a null or non-finite component, or no length take no part; a shorter
vector counts as zero in its missing dimensions; ties go to the smaller vec_id, and rows of equal vectors never stand
in each other's way, as they are one node; repeated candidate rows take a rank each, while repeated query rows are one
query (of different vectors under one id the least one); a query without candidates has no rows, and one with fewer
than ``k`` has them all; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.common import bounded_batches
from colophon.llm.topk import usable

K = 5
#: Rows in a shard, edges of a node, beam while building and while searching, and the slack of pruning.
SHARD, DEGREE, BUILD_BEAM, BEAM, ALPHA = 16_384, 32, 64, 128, 1.2
#: Searches that run side by side.
BATCH = 256


class Graph:
    """A directed graph over unit vectors, all different."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7):
        self.vectors, self.degree = vectors, degree
        n = len(vectors)
        rng = np.random.default_rng(seed)
        # A missing edge leads to the node itself.
        self.edges = np.repeat(np.arange(n)[:, None], degree, axis=1)
        if n > 1:
            fill = min(degree, n - 1)
            self.edges[:, :fill] = (np.arange(n)[:, None] + rng.integers(1, n, (n, fill))) % n
        self.start = int(np.argmax(vectors @ vectors.mean(axis=0))) if n else 0
        for slack in (1.0, alpha):
            order = rng.permutation(n)
            for a in range(0, n, BATCH):
                self._insert(order[a : a + BATCH], beam, slack)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best nodes of each query by falling cosine, -1 where there are fewer than the beam; and those cosines."""
        b, n = len(queries), len(self.vectors)
        seen = np.zeros((b, n), bool)
        nodes = np.full((b, beam), -1)
        score = np.full((b, beam), -np.inf, np.float32)
        done = np.ones((b, beam), bool)
        nodes[:, 0], score[:, 0], done[:, 0], seen[:, self.start] = self.start, queries @ self.vectors[self.start], False, True
        live = np.arange(b)
        while len(live):
            # Each search expands its best node not yet expanded.
            at = np.argmin(done[live], axis=1)
            done[live, at] = True
            near = self.edges[nodes[live, at]]
            fresh = ~seen[live[:, None], near]
            near_sorted = np.sort(np.where(fresh, near, -1), axis=1)
            near = np.where(np.diff(near_sorted, axis=1, prepend=-2) != 0, near_sorted, -1)
            rows, columns = np.nonzero(near >= 0)
            seen[live[rows], near[rows, columns]] = True
            gained = np.full(near.shape, -np.inf, np.float32)
            gained[rows, columns] = np.einsum("ij,ij->i", self.vectors[near[rows, columns]], queries[live[rows]])
            all_nodes, all_score = np.hstack([nodes[live], near]), np.hstack([score[live], gained])
            all_done = np.hstack([done[live], near < 0])
            best = np.argsort(-all_score, axis=1, kind="stable")[:, :beam]
            nodes[live], score[live], done[live] = (np.take_along_axis(x, best, 1) for x in (all_nodes, all_score, all_done))
            live = live[~done[live].all(axis=1)]
        return nodes, score

    def _insert(self, batch: np.ndarray, beam: int, slack: float) -> None:
        found, _ = self.search(self.vectors[batch], beam)
        proposed = np.hstack([found, self.edges[batch]])
        self.edges[batch] = self._pruned(batch, proposed, slack)
        # The other ends: what is offered to a node is pruned together with what it has.
        to, by = self.edges[batch].ravel(), np.repeat(batch, self.degree)
        real = to != by
        to, by = to[real], by[real]
        order = np.argsort(to, kind="stable")
        to, by = to[order], by[order]
        ends, first, count = np.unique(to, return_index=True, return_counts=True)
        for low, high in ((1, self.degree), (self.degree + 1, len(self.vectors))):
            some = np.flatnonzero((count >= low) & (count <= high))
            for a in range(0, len(some), BATCH):
                part = some[a : a + BATCH]
                width = int(count[part].max())
                spot = first[part][:, None] + np.arange(width)
                offered = np.where(np.arange(width) < count[part][:, None], by[np.minimum(spot, len(by) - 1)], -1)
                self.edges[ends[part]] = self._pruned(ends[part], np.hstack([self.edges[ends[part]], offered]), slack)

    def _pruned(self, nodes: np.ndarray, proposed: np.ndarray, slack: float) -> np.ndarray:
        """For each node the diverse ones of its proposals (-1: none), nearest first; free places lead to the node itself."""
        proposed = np.sort(np.where(proposed == nodes[:, None], -1, proposed), axis=1)
        proposed = np.where(np.diff(proposed, axis=1, prepend=-2) != 0, proposed, -1)
        there = proposed >= 0
        to_node = np.where(there, 2 - 2 * np.matmul(self.vectors[proposed], self.vectors[nodes][:, :, None])[:, :, 0], np.inf)
        order = np.argsort(to_node, axis=1, kind="stable")[:, : int(there.sum(axis=1).max(initial=0))]
        proposed, to_node = np.take_along_axis(proposed, order, 1), np.take_along_axis(to_node, order, 1)
        near = self.vectors[proposed]
        between = 2 - 2 * np.matmul(near, near.transpose(0, 2, 1))
        out = np.repeat(nodes[:, None], self.degree, axis=1)
        open_, rows = np.isfinite(to_node), np.arange(len(nodes))
        for place in range(self.degree):
            live = open_.any(axis=1)
            if not live.any():
                break
            nearest = np.argmax(open_, axis=1)
            out[live, place] = proposed[rows[live], nearest[live]]
            # Squared distances, so the factor counts twice.
            open_ &= ~(slack * slack * between[rows, nearest] <= to_node)
            open_[rows, nearest] = False
        return out


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of doubles, shorter ones filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _padded(parts: list[np.ndarray], width: int) -> np.ndarray:
    return np.vstack([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


class Shard:
    """The index of some rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, degree: int, beam: int, alpha: float):
        self.vectors, which = np.unique(vectors, axis=0, return_inverse=True)
        which = which.ravel()
        order = np.lexsort((ids, which))
        self.ids, self.first = ids[order], np.searchsorted(which[order], np.arange(len(self.vectors) + 1))
        self.length = np.sqrt((self.vectors**2).sum(axis=1))
        # Single precision leads the way; what is found is measured in double precision.
        self.graph = Graph((self.vectors / self.length[:, None]).astype(np.float32), degree, beam, alpha)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, int, float]]:
        """(query, id, cosine) of the k nearest found of each query."""
        width = max(queries.shape[1], self.vectors.shape[1])
        queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
        lengths = np.sqrt((queries**2).sum(axis=1))
        own = width - self.vectors.shape[1]
        for a in range(0, len(queries), BATCH):
            q = queries[a : a + BATCH]
            nodes, _ = self.graph.search((q / lengths[a : a + BATCH, None])[:, : width - own].astype(np.float32), beam)
            for i, found in enumerate(nodes, a):
                found = found[found >= 0]
                # The measure itself, on the vectors as they came.
                exact = (self.vectors[found] * queries[i, : width - own]).sum(axis=1) / (self.length[found] * lengths[i])
                ranked, taken = found[np.lexsort((self.ids[self.first[found]], -exact))], []
                scores = dict(zip(found.tolist(), exact.tolist()))
                for node in ranked.tolist():
                    # Equal scores may come from different vectors, so all of the last score are kept for the merge.
                    if len(taken) >= k and scores[node] < taken[-1][1]:
                        break
                    ids = self.ids[self.first[node] : self.first[node + 1]]
                    ids = ids[ids != query_ids[i]][:k]
                    taken += [(int(x), scores[node]) for x in ids]
                taken.sort(key=lambda t: (-t[1], t[0]))
                yield from ((int(query_ids[i]), x, s) for x, s in taken[:k])


def _search_shards(k: int, degree: int, build_beam: int, beam: int, alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard, in each shard the candidates before the queries."""
        shard, ids, parts, index = None, [], [], None
        for batch in batches:
            numbers, asks = batch.column("shard").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                if numbers[a] != shard:
                    shard, ids, parts, index = numbers[a], [], [], None
                part = batch.slice(a, b - a)
                vec_ids, matrix = part.column("vec_id").to_numpy(), _matrix(part.column("embedding"))
                if not asks[a]:
                    ids.append(vec_ids)
                    parts.append(matrix)
                    continue
                if index is None and ids:
                    index = Shard(np.concatenate(ids), _padded(parts, max(p.shape[1] for p in parts)), degree, build_beam, alpha)
                    ids, parts = [], []
                if index is not None:
                    found = list(index.nearest(vec_ids, matrix, k, beam))
                    yield pa.record_batch([pa.array([f[c] for f in found], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def nearest(candidates: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, degree: int = DEGREE, build_beam: int = BUILD_BEAM, beam: int = BEAM, alpha: float = ALPHA) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine that the graphs find for each query, its own row left out."""
    spark = candidates.sparkSession
    bounded_batches(spark)
    has_length = F.exists("embedding", lambda x: x != 0)
    cand = usable(candidates).where(has_length)
    asked = usable(queries).where(has_length).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    shards = max(-(-cand.count() // shard), min(spark.sparkContext.defaultParallelism, 6))
    # By row, as equal rows may be many.
    dealt = cand.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")).withColumn("is_query", F.lit(False))
    sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("is_query", F.lit(True))
    both = dealt.unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", "is_query", "vec_id")
    found = both.mapInArrow(_search_shards(k, degree, build_beam, beam, alpha), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
