"""The corpus pipeline: toxicity, line dedup, near-duplicates, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return all columns of ``docs``, those
of documents and any others, whatever their names. Defined cases, in every stage: rows are judged one by one, so rows
that repeat a doc_id or are equal each stay or go on their own (near-duplicates: of equal rows one stays); a null
doc_id is no reason to go; null and empty texts stay (near-duplicates: one of them all); very long texts are handled
whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.llm import decontam, jaccard, line_dedup, packing, toxicity
from colophon.llm.common import materialize

#: Columns that the stages read; all others are set aside under names of their own meanwhile.
READ = ["doc_id", "text", "source", "n_chars"]


def _aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with plain names for the columns that no stage reads, and the way back, in their order."""
    names = {c: c if c in READ else f"_other{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[docs[c].alias(n) for c, n in names.items()]), lambda out: out.select(*[out[n].alias(c) for c, n in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it is trained on the labels of this stage's documents."""
    plain, back = _aside(docs)
    model = toxicity.train(plain, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return back(toxicity.score(plain, model).where("predicted = 0"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; every document stays."""
    plain, back = _aside(docs)
    n_chars = F.when(F.col("n_lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return back(line_dedup.clean_lines(plain).withColumn("n_chars", n_chars))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates have 0.8 or more of their five-word shingles in common; of each group one row stays.

    Candidates are found by SimHash fingerprints of the shingles, joined by segment-popcount embedding, and those that
    fingerprints miss by a prefix filter; all are compared exactly.
    It is the row with the smallest doc_id, nulls last; of repeated rows of that id, or of rows that are all without
    one, the first by text digest and then by place stays. Rows are numbered once and written, so that the number holds.
    """
    plain, back = _aside(docs)
    rows = materialize(plain.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    ranked = rows.select("doc_id", "text", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("digest"), F.col("_row").alias("row")).alias("rank"))
    groups = materialize(jaccard.groups(ranked, "rank", shingle=5, similarity=0.8), "groups")
    kept = groups.groupBy("group").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("_row"))
    return back(rows.join(kept, "_row", "left_semi"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    plain, back = _aside(docs)
    return back(decontam.contamination(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("NOT contaminated"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of at most 1024 tokens."""
    return packing.pack(packing.tokenize(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Toxicity scores, fingerprints and token ids cannot be expressed in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
