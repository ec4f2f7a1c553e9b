"""The classifiers: held-out accuracy, folds, defined cases; the pipeline against brute force."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from colophon.llm import quality, queries, toxicity
from tests.conftest import SF
from tests.llm import brute
from tests.llm.test_jaccard import partition
from tests.llm.test_operators import awkward_rows

MEDIUM = "/root/testdata/sf0.01"


def auc(score, label):
    _, inverse, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count + 1) / 2)[inverse]
    n = label.sum()
    return (rank[label == 1].sum() - n * (n - 1) / 2) / n / (len(label) - n)


@pytest.mark.parametrize(("name", "label", "threshold", "least"), [("op2_toxicity", "toxic", 0.3, 0.8), ("op4_quality", "quality", 0.7, 0.98)])
def test_held_out(spark, name, label, threshold, least):
    out = queries.queries()[name](spark, MEDIUM).toPandas()
    assert out["doc_id"].is_unique and len(out) == 1000 and out["score"].between(0, 1).all()
    assert (out["held_out"] == [zlib.crc32(str(d).encode()) % 4 == 2 for d in out["doc_id"]]).all()
    assert (out["predicted"] == (out["score"] >= threshold)).all()
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").toPandas()
    held = out[out["held_out"]].merge(labels, on="doc_id")
    assert auc(held["score"].to_numpy(), held[label].to_numpy()) > least


def _docs(spark, extra=()):
    rows = [(None, None), (1, None), (2, ""), (3, " \n "), (4, "x" * 50_000), (5, "word " * 30_000), *extra]
    return spark.createDataFrame([(d, t, 0.5, "p") for d, t in rows], "doc_id long, text string, score double, p string")


def test_awkward_texts_are_scored(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    for module in (toxicity, quality):
        out = module.score(_docs(spark), module.train(docs, labels)).collect()
        assert len(out) == 6 and all(0 <= r["score"] <= 1 and not r["held_out"] == (r["doc_id"] is None) or r["doc_id"] is not None for r in out)
        assert len({r["score"] for r in out if r["doc_id"] in (None, 1, 2)}) == 1


def test_scores_do_not_depend_on_the_rows_beside_them(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    some = docs.select("doc_id", "text").limit(90).unionByName(_docs(spark).select("doc_id", "text")).collect()
    for module in (toxicity, quality):
        model, seen = module.train(docs, labels), []
        for parts in (1, 7, 40):
            rows = spark.createDataFrame(some, "doc_id long, text string").repartition(parts)
            seen.append(sorted((r["doc_id"] or -1, r["score"]) for r in module.score(rows, model).collect()))
        assert seen[0] == seen[1] == seen[2]


def test_long_texts_are_pooled_whole(monkeypatch):
    table = quality.index_vectors()
    texts = ["a few words", "one two three four five " * 40, "", "x y " * 9]
    want = quality._features(quality.pa.array(texts), table)
    monkeypatch.setattr(quality, "PIECE", 16)
    assert np.allclose(quality._features(quality.pa.array(texts), table), want, atol=1e-5)


def test_toxic_scores_against_plain_python(spark):
    """Distances, counts and the calibrated probability of each text, one by one."""
    import math

    import zstandard

    docs, labels = spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")
    model = toxicity.train(docs, labels)

    def size(dictionary, window):
        made = zstandard.ZstdCompressionDict(toxicity._CARRIER + dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters(window_log=18, chain_log=17, hash_log=17, search_log=6, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
        return len(zstandard.ZstdCompressor(dict_data=made, compression_params=how).compress(window + toxicity._CARRIER))

    for r in toxicity.score(docs.where("length(text) < 300").limit(8), model).collect():
        words = [w for w in ("".join(c for c in r["text"] if c not in '.,;:!?"()')).translate(brute.LOWER).encode().split()]
        d = [size(model.ordinary, b" " + w + b" ") - size(model.toxic, b" " + w + b" ") for w in words]
        counts = [sum(x >= k for x in d) for k in toxicity.DISTANCES]
        x = [math.log1p(c) for c in counts] + [math.log1p(1000 * c / max(len(d), 1)) for c in counts] + [max(max(d, default=0), 0) / 4, sum(d) / max(len(d), 1), 1.0]
        total = sum(a * b for a, b in zip(x, model.weights))
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-9


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "IF(crc32(encode(CAST(doc_id AS STRING), 'UTF-8')) % 4 = 2, 1 - quality, quality) AS quality", "IF(crc32(encode(CAST(doc_id AS STRING), 'UTF-8')) % 4 = 2, 1 - toxic, toxic) AS toxic")
    for module in (toxicity, quality):
        a, b = (sorted(module.score(docs, module.train(docs, x)).select("doc_id", "score").collect()) for x in (labels, turned))
        assert a == b


def test_labels_of_one_class(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = docs.selectExpr("doc_id", "0 AS toxic", "1 AS quality")
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()} == {0.0}
    assert {r["score"] for r in quality.score(docs, quality.train(docs, labels)).collect()} == {0.5}


def test_planted_toxic_words_are_found(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(60)) + (" vile scoundrel" if i % 5 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 5 = 0 AS INT) AS toxic")
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in out) >= 0.98 * len(out)


def test_network_temperature_lowers_overconfidence():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 10))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    net = quality.fit_network(x, y, epochs=1500, decay=0.0)
    assert net.temperature > 1


def test_pipeline_stages_on_awkward_rows(spark):
    """Nulls, repeated rows, empty texts and columns with clashing names go through every stage."""
    rows = [(d, t, "en", s, None if t is None else len(t), 0.5, d, "x", 7) for d, t, s in awkward_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, note_id long, h string, n_words int").repartition(3)
    stages, texts = dict(corpus_pipeline.STAGES), [(r[0], r[1], r[3]) for r in rows]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    others = lambda r: (r["lang"], r["score"], r["note_id"], r["h"], r["n_words"])
    out = {name: stages[name](spark, docs, SF) for name in ("toxicity", "line_dedup", "near_duplicates", "decontamination")}
    for df in out.values():
        assert df.dtypes == docs.dtypes and all(others(r) == ("en", 0.5, r["doc_id"], "x", 7) for r in df.collect())
    assert out["line_dedup"].count() == len(rows)
    assert Counter((r["doc_id"], brute.sha(r["text"] or "")) for r in out["line_dedup"].collect()) == Counter((d, s) for d, _, _, s in brute.line_dedup(texts))
    clean = Counter(r[0] for r in brute.contamination([(d, t) for d, t, _ in texts], items) if not r[-1])
    assert Counter(r["doc_id"] for r in out["decontamination"].collect()) == clean
    kept = Counter((r["doc_id"], r["text"]) for r in out["toxicity"].collect())
    assert not kept - Counter((d, t) for d, t, _ in texts) and kept[(None, None)] == 1 and kept[(2, "")] == 1
    packed = stages["packing"](spark, docs, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == Counter(brute.pieces([(d, t) for d, t, _ in texts]))


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    held = docs
    for name in ("toxicity", "line_dedup", "near_duplicates", "decontamination"):
        out = stages[name](spark, held, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        before, after = ([(r["doc_id"], r["text"], r["source"]) for r in df.collect()] for df in (held, out))
        ids = [d for d, _, _ in after]
        if name == "line_dedup":
            want = {d: s for d, _, _, s in brute.line_dedup(before)}
            assert {d: brute.sha(t or "") for d, t, _ in after} == want
        if name == "near_duplicates":
            # The stage is by Jaccard similarity of five-word shingles; of each group of all pairs the smallest id stays.
            least = {}
            for (d, _, _), group in zip(before, partition([t for _, t, _ in before])):
                least[group] = min(d, least.get(group, d))
            assert sorted(ids) == sorted(least.values())
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert sorted(ids) == sorted(r[0] for r in brute.contamination([(d, t) for d, t, _ in before], items) if not r[-1])
        if name == "toxicity":
            assert set(ids) <= {d for d, _, _ in before} and len(ids) > 0.8 * len(before)
        held = spark.createDataFrame(out.collect(), docs.schema)
    packed = stages["packing"](spark, held, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == sorted(brute.pieces([(r["doc_id"], r["text"]) for r in held.collect()]))
    assert len(corpus_pipeline.run(spark, SF).collect()) == len(packed)
