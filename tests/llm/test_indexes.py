"""Merkle manifest, nearest neighbours and whitening against brute force, on the smallest tables and on awkward rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colophon.llm import ann, merkle, queries, whitening
from tests.conftest import SF

VECTORS = "grp string, vec_id long, embedding array<float>, shard int, is_query int, part int"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 3]) for i in range(0, len(below), 3)])
    return levels


def siblings(levels: list[list[str]], place: int) -> list[tuple[list[str], list[str]]]:
    out = []
    for nodes in levels[:-1]:
        head = place // 3 * 3
        out.append((nodes[head:place], nodes[place + 1 : head + 3]))
        place //= 3
    return out


def merkle_rows(rows: list[tuple]) -> list[tuple]:
    """(doc_id, source, lang, n_chars, text) to the digest columns."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by_source: dict[bytes | None, list[tuple]] = {}
    for row in rows:
        by_source.setdefault(None if row[1] is None else row[1].encode(), []).append((row, h(*map(enc, row))))
    order = sorted(by_source, key=lambda s: (s is not None, s or b""))
    for source in order:
        by_source[source].sort(key=lambda r: (r[0][0] is not None, r[0][0] or 0, r[1]))
    trees = {s: tree([leaf for _, leaf in by_source[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, source in enumerate(order):
        for place, (row, leaf) in enumerate(by_source[source]):
            path = siblings(trees[source], place) + siblings(top, k)
            text = row[4]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = h(*map(enc, (*row[:4], text)))
            for before, after in path:
                folded = h(*before, folded, *after)
            root = top[-1][0]
            out.append((row[0], leaf, trees[source][-1][0], root, h(*[d for b, a in path for d in b + a]), folded, folded == root))
    return out


MERKLE_ROWS = [(None, None, None, None, None), (None, None, None, None, None), (7, "", "en", 0, ""), (7, "", "en", 0, ""), (-3, "ä", "de", 4, "a\nb\n"), (8, "z", None, 5, "x" * 200_000 + "\n")]
MERKLE_ROWS += [(i, "hot", "en", i, f"text {i}\nline") for i in range(100)] + [(5, "hot", "en", 5, "of one id\n"), (5, "hot", "en", 5, "text 5\nline")] + [(1000 + i, f"s{i}", "fr", 1, None) for i in range(11)]


def merkle_frame(spark, rows):
    full = [("grp", *r, 3, "digest", 9) for r in rows]
    return spark.createDataFrame(full, "grp string, doc_id long, source string, lang string, n_chars long, text string, part int, digest string, level int").repartition(5)


@pytest.mark.parametrize("part_rows, first, stride", [(100_000, 11, 9), (7, 2, 1), (1, 1, 2)])
def test_merkle(spark, monkeypatch, part_rows, first, stride):
    monkeypatch.setattr(merkle, "FIRST", first)
    monkeypatch.setattr(merkle, "STRIDE", stride)
    monkeypatch.setattr(merkle, "PART_ROWS", part_rows)
    rows = MERKLE_ROWS if part_rows > 1 else MERKLE_ROWS[:40]
    out = merkle.digest(merkle_frame(spark, rows), part_rows)
    assert Counter(map(tuple, out.collect())) == Counter(merkle_rows(rows))


def test_merkle_of_nothing_and_of_one(spark):
    assert merkle.digest(merkle_frame(spark, [])).collect() == []
    assert [tuple(r) for r in merkle.digest(merkle_frame(spark, MERKLE_ROWS[4:5])).collect()] == merkle_rows(MERKLE_ROWS[4:5])


def test_merkle_proofs_hold_for_their_leaf_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = merkle.manifest(docs, F.col("source"), F.col("doc_id"), merkle.leaf(F.col("doc_id"), F.col("text")), 30, other=merkle.leaf(F.col("text")))
    held = out.select((merkle.fold(F.col("path"), F.col("digest")) == F.col("root")).alias("own"), (merkle.fold(F.col("path"), F.col("other")) == F.col("root")).alias("other"))
    assert {tuple(r) for r in held.collect()} == {(True, False)}


def nearest_rows(rows: list[tuple], is_query, k: int = 5) -> dict[int, list[tuple[int, float]]]:
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for q, v in kept:
        if is_query(q):
            scored = [(-float((v * w).sum() / np.sqrt((v**2).sum()) / np.sqrt((w**2).sum())), i) for i, w in kept if i != q]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_ann_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = nearest_rows([(r["vec_id"], r["embedding"]) for r in table.collect()], lambda q: q % 50 == 0)
    got = queries.op12_ann(spark, SF).collect()
    scores = {q: dict(found) for q, found in want.items()}
    assert len(got) == 5 * len(want) and {r["query_id"] for r in got} == set(want)
    hits = [scores[r["query_id"]].get(r["vec_id"]) for r in got]
    assert sum(s is not None for s in hits) >= 0.9 * len(got)
    assert all(s is None or abs(s - r["score"]) < 1e-12 for s, r in zip(hits, got))


def test_ann_on_awkward_rows(spark):
    rng = np.random.default_rng(2)
    vector = lambda: [float(x) for x in rng.normal(size=6)]
    hot = vector()
    rows = [(None, hot), (1, None), (2, [None] * 6), (3, [float("nan")] * 6), (4, [0.0] * 6), (5, [float("inf")] + [1.0] * 5), (0, hot), (50, hot), (100, vector()), (150, vector()), (150, vector())]
    rows += [(200 + i, hot) for i in range(40)] + [(300 + i, vector()) for i in range(40)]
    frame = spark.createDataFrame([("g", i, v, 3, 1, 2) for i, v in rows], VECTORS).repartition(4)
    out = ann.nearest(frame, frame.where("vec_id % 50 = 0"), shard=30)
    got: dict[int, list] = {}
    for r in sorted(out.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    want = nearest_rows([r for r in rows if r[0] != 150], lambda q: q % 50 == 0)
    # All vectors of a small shard are met, so the result is exact; of the repeated query the least vector asks.
    for q in (0, 50, 200, 300):
        assert [i for i, _ in got[q]] == [i for i, _ in nearest_rows(rows, lambda x: x == q)[q]]
    assert set(got) == set(want) | {150} and all(len(v) == 5 for v in got.values())
    assert out.columns == ["query_id", "rank", "vec_id", "score"]


def test_ann_of_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0]), (7, [0.0, 2.0])], "vec_id long, embedding array<float>")
    out = sorted(tuple(r) for r in ann.nearest(frame, frame.where("vec_id % 50 = 0")).collect())
    assert out == [(0, 1, 50, 1.0), (0, 2, 7, 0.0), (50, 1, 0, 1.0), (50, 2, 7, 0.0)]
    assert ann.nearest(frame.where("vec_id = 0"), frame.where("vec_id = 0")).collect() == []
    assert ann.nearest(frame.limit(0), frame.where("vec_id = 0")).collect() == []


def whitened_rows(rows: list[tuple]) -> tuple:
    """Exact deviations, whitened coordinates and shares of the variance, by numpy's eigenvectors."""
    kept = [v for _, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max(map(len, kept))
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) for c in v] + [0] * (d - len(v)) for v in kept], object) + 1_000_000
    n = len(x)
    off = n * x - x.sum(axis=0)
    centred = (off / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return (off**2).sum(axis=1), centred @ vectors / np.sqrt(np.maximum(values, 1e-300)), values / values.sum()


@pytest.mark.parametrize("which", ["small", "awkward"])
def test_whitening(spark, which):
    if which == "small":
        rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    else:
        rng = np.random.default_rng(1)
        rows = [(i, [float(c) for c in rng.normal(size=5) * [1, 10, 100, 0.1, 3]]) for i in range(150)] + [(300, [1.0, -2.0]), (301, None), (302, [None] * 5), (303, [float("nan")] * 5), (304, [float("-inf")] * 5)]
        rows += [(305 + i, [4.0] * 5) for i in range(60)]
    frame = spark.createDataFrame([("g", i, v, 3, 1, 2) for i, v in rows], VECTORS).repartition(6)
    out = whitening.whiten(frame).toPandas().sort_values(["vec_id", "component"])
    deviations, whitened, shares = whitened_rows(sorted(rows, key=lambda r: r[0]))
    k = min(32, whitened.shape[1])
    assert len(out) == k * len(whitened) and set(out["component"]) == set(range(1, k + 1)) and set(out["n"]) == {len(whitened)}
    assert out["deviation"].tolist()[::k] == deviations.tolist()
    got = out["whitened"].to_numpy().reshape(-1, k)
    signs = np.sign((got * whitened[:, :k]).sum(axis=0))
    assert np.abs(got * signs - whitened[:, :k]).max() < 1e-8
    assert np.abs(out["explained"].to_numpy()[:k] - shares[:k]).max() < 1e-12
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-10


def test_whitening_of_what_does_not_vary(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    one = whitening.whiten(frame([(1, [1.0, 2.0])])).collect()
    assert [tuple(r) for r in one] == [(1, 1, 1, 0, None, None, None), (1, 2, 1, 0, None, None, None)]
    flat = whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (None, [1.0, 3.0])])).collect()
    assert [r["whitened"] is None for r in sorted(flat, key=lambda r: r["component"])] == [False] * 3 + [True] * 3
    assert whitening.whiten(frame([(1, []), (2, None)])).collect() == [] and whitening.whiten(frame([])).collect() == []
    with pytest.raises(Exception, match="summed exactly"):
        whitening.whiten(frame([(1, [1e30])])).collect()


def test_jacobi_is_accurate_for_small_singular_values():
    rng = np.random.default_rng(4)
    for a in (rng.normal(size=(31, 31)), rng.normal(size=(8, 8)) * np.logspace(0, -12, 8), np.zeros((3, 3)), np.ones((4, 4))):
        size, v = whitening.jacobi(a)
        assert np.allclose(v.T @ v, np.eye(len(a)), atol=1e-13)
        assert np.allclose(size, np.linalg.svd(a)[1], rtol=1e-10, atol=1e-15)
        assert np.allclose(np.linalg.norm(a @ v, axis=0), size, rtol=1e-10, atol=1e-12)


def test_deviation_beyond_machine_integers():
    x = np.array([[1 << 39, 5], [0, 5]], np.int64)
    n, sums = 1 << 30, np.array([1 << 60, 7 << 30], object)
    want = [(n * (1 << 39) - (1 << 60)) ** 2 + (n * 5 - (7 << 30)) ** 2, (1 << 60) ** 2 + (n * 2) ** 2]
    assert whitening._deviation(x, n, sums) == want
