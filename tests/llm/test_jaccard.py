"""Near-duplicates by Jaccard similarity, and the stage that uses them, against brute force over all pairs."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline
from colophon.llm import jaccard, simhash
from tests.conftest import SF
from tests.llm.brute import LOWER, SPACE
from tests.llm.test_operators import awkward_rows


def shingles(text: str | None, n: int) -> frozenset[bytes]:
    words = SPACE.findall((text or "").translate(LOWER).encode())
    return frozenset(b" ".join(words[i : i + n]) for i in range(max(len(words) - n, 0) + 1)) if words else frozenset()


def partition(texts: list[str | None], n: int = 5, num: int = 4, den: int = 5) -> list[int]:
    """For each text the first text of its group; every pair that shares a shingle is compared exactly."""
    sets = [shingles(t, n) for t in texts]
    root, by = list(range(len(sets))), defaultdict(list)

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    def link(i: int, j: int) -> None:
        a, b = sorted((find(i), find(j)))
        root[b] = a

    empty = [i for i, s in enumerate(sets) if not s]
    for i in empty[1:]:
        link(empty[0], i)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in by[x])
        for j, both in common.items():
            if both * den >= num * (len(s) + len(sets[j]) - both):
                link(i, j)
        for x in s:
            by[x].append(i)
    return [find(i) for i in range(len(sets))]


def near_copies() -> list[str]:
    """Copies of texts of 30 to 600 words with 0 to 8 words changed, on both sides of the similarity, and a hot passage."""
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(3000)}"
    out = []
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(30, 600))]
        for changed in range(9):
            copy = base[:]
            for _ in range(changed):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    for size in (1600, 5000, 5000):  # sets with counts
        base = [word() for _ in range(size)]
        out += [" ".join(w if i % step else word() for i, w in enumerate(base)) for step in (38, 50, 90, 400)]
    passage = [word() for _ in range(80)]
    return out + [" ".join([*passage, *(word() for _ in range(12))]) for _ in range(150)] + [" ".join([*passage, word()]) for _ in range(90)]


def grouped(spark, texts, **how) -> list[int]:
    docs = spark.createDataFrame(list(enumerate(texts)), "at long, text string").repartition(5)
    by = defaultdict(list)
    for r in jaccard.groups(docs, "at", **how).collect():
        by[r["group"]].append(r["at"])
    first = {i: min(rows) for rows in by.values() for i in rows}
    return [first[i] for i in range(len(texts))]


@pytest.mark.parametrize("texts", ["near", "awkward", "small"])
def test_groups_are_those_of_all_pairs(spark, texts):
    rows = near_copies() if texts == "near" else [t for _, t, _ in awkward_rows()] if texts == "awkward" else [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    assert grouped(spark, rows) == partition(rows)


def test_groups_of_other_shingles_and_similarities(spark):
    rows = near_copies()[:270] + [t for _, t, _ in awkward_rows()]
    assert grouped(spark, rows, shingle=2, similarity=0.55) == partition(rows, 2, 11, 20)


def test_groups_do_not_depend_on_tiles(spark, monkeypatch):
    """Cells and blocks cut into tiles of a few nodes, with and without nodes that are in all of them."""
    rows = near_copies()[:180] + near_copies()[-240:] + [t for _, t, _ in awkward_rows()]
    want = partition(rows)
    for tile, hubs in ((5, 2), (40, 0)):
        for name, value in (("CELL_TILE", tile), ("BLOCK_TILE", tile), ("HUBS", hubs)):
            monkeypatch.setattr(jaccard, name, value)
        assert grouped(spark, rows) == want


def test_a_large_group_is_divided_and_not_copied(spark):
    """A cell of 4,000 nodes, 3,990 of one group: the group's nodes are in one unit each, the others in all; no unit has over two tiles."""
    rows = [(9, k, 0 if k < 3990 else k) for k in range(4000)] + [(8, k, 1) for k in range(500)]
    units = jaccard._tile_pairs(spark.createDataFrame(rows, "cell long, key long, known long"), 256).collect()
    copies = Counter(r["key"] for r in units)
    assert all(copies[k] == 1 for k in range(3990)) and all(copies[k] == 16 for k in range(3990, 4000))
    assert max(Counter(r["unit"] for r in units).values()) < 2 * 256


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_the_stage_drops_copies_of_similarity_of_at_least_four_fifths(spark):
    words = [f"w{i}" for i in range(200)]
    near = [*words[:50], "x", *words[51:100], "y", *words[101:150], "z", *words[151:]]  # 181 of 211 shingles
    far = [w if i % 33 else "q" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(words).upper())]
    out = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def test_the_stage_keeps_one_row_of_each_group(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(None, text("a"))] * 3 + [(None, text("b")), (7, text("b")), (7, text("b")), (7, text("b") + " end"), (8, text("b"))]
    rows += [(9, text("c")), (9, text("d")), (10, text("c")), (None, None), (None, ""), (None, text("e"))]
    out = [(r["doc_id"], (r["text"] or "")[:2]) for r in corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows).repartition(4), "").collect()]
    assert Counter(out) == Counter([(None, "a0"), (7, "b0"), (9, "c0"), (9, "d0"), (None, ""), (None, "e0")])


def test_fingerprints_find_candidates_that_are_compared_exactly(spark, monkeypatch):
    """SimHash groups are those of all pairs of fingerprints; alone, without the prefix filter, they lead to near copies and to nothing else."""
    rng = random.Random(9)
    bases = [[f"v{rng.randrange(3000)}" for _ in range(900)] for _ in range(20)]
    rows = [" ".join(b) for b in bases] + [" ".join([*b[:-1], "end"]) for b in bases] + ["one", "two", "", " "]
    docs = spark.createDataFrame(list(enumerate(rows)), "at long, text string").repartition(3)
    prints = [simhash.fingerprint(jaccard.shingle_sets(pa.array([t]))[0]) for t in rows]
    near = [[j for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS] for i in range(len(rows))]
    assert sum(20 + i in near[i] for i in range(20)) > 10
    seen = []
    monkeypatch.setattr(jaccard, "near_fingerprints", lambda marked, f=jaccard.near_fingerprints: seen.append((marked, f(marked))) or seen[-1][1])
    assert grouped(spark, rows) == partition(rows)
    marked, found = seen.pop()
    known = {r["key"]: r["known"] for r in found.collect()}
    group = {r["at"]: known.get(r["key"], r["key"]) for r in marked.select("at", "key").collect()}
    assert all((group[i] == group[j]) == (j in near[i]) for i in range(len(rows)) for j in range(len(rows)))
    monkeypatch.setattr(jaccard, "_shared", lambda table: [])
    assert grouped(spark, rows) == [min(x) for x in near]
    monkeypatch.setattr(jaccard, "near_fingerprints", lambda marked: marked.select("key").distinct().withColumn("known", F.min("key").over(Window.partitionBy(F.lit(1)))))
    assert grouped(spark, rows) == partition(rows)
