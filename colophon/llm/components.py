"""Connected components of a link table by alternating large-star and small-star steps.

Each step links every node to the least node that it knows. Groups are reduced with min() before they are
shuffled, joins are plain equi-joins that adaptive execution can split, and each round is written to the
shared folder, so neither a hot node nor a lost executor stops it. Before a round the tasks settle what lies in
their own share of the links, a bounded number at a time, so that few rounds are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm.common import bounded_batches, materialize

#: Links that a task settles at once.
SETTLED = 1_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node reachable) with the same components as the links (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (label[x] != label[y]).any():
        least, before = np.minimum(label[x], label[y]), label.copy()
        for end in (before[x], before[y]):
            np.minimum.at(label, end, least)
        while (label[label] != label).any():
            label = label[label]
    leaf = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[leaf], nodes[label[leaf]]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        return pa.record_batch([pa.array(x) for x in stars(table.column("a").to_numpy(), table.column("b").to_numpy())], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= SETTLED:
            yield out()
            held = []
    if held:
        yield out()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b) with a > b. Large star: all larger neighbours go to the least one; small star: all smaller ones."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    least = materialize(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    near = links.join(least, "a")
    return near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def _settled(links: DataFrame) -> bool:
    """Whether every node has one link only, or none but those that lead to it."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    open_ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 OR (out = 1 AND in = 1)")
    return open_ends.agg(F.count("*")).first()[0] == 0


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links of long ids to (node, root): the least node reachable; roots themselves are not listed."""
    bounded_batches(links.sparkSession)
    links = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    for _ in range(max_rounds):
        links = materialize(links.mapInArrow(_settle, "a long, b long"), "settled")
        if _settled(links):
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        links = materialize(_star(links, large=True).where("a <> b").distinct(), "large")
        links = materialize(_star(links, large=False).where("a <> b").distinct(), "small")
    raise RuntimeError("components did not settle")
