"""Line dedup by distinct-site spread, native: DataFrame functions only.

Every line gets a HyperLogLog sketch of the sites (``source``) that show it, straight from the lines: sketches are
small, and partial ones of every task merge by aggregation. Lines whose estimate is clearly over ``min_sites`` are
boilerplate; only of lines near the threshold the distinct sites are counted exactly, from a table that is distinct by
line and site. Of a boilerplate line only the first occurrence in the document with the smallest doc_id stays; all
others are removed. Lines are told apart by 128 bits of hash.

Defined cases: a null text has no lines and stays null; an empty text is one blank line; blank lines are never
boilerplate; a null site is one site of its own, apart from the empty one; a null doc_id comes after all others; rows
that repeat a doc_id are treated alike; a very long text is handled whole, as one array of lines in one row; an empty
table gives an empty result; extra columns are kept by ``clean_lines`` and not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.llm.common import materialize, own_columns

#: Distinct sites that make a line boilerplate, and the share of it by which an estimate counts as near.
MIN_SITES = 10
NEAR = 0.25
LG_K = 10


def _key(line: Column) -> Column:
    """128 bits of hash, by two seeds."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, site and key of every line that is not blank; a sketch would pass over an empty site, so sites have a sign before them."""
    return (
        own_columns(docs, "doc_id", "text", "source")
        .select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("site"), F.explode(F.split("text", "\n", -1)).alias("line"))
        .where(F.trim("line") != "")
        .select("doc_id", "site", _key(F.col("line")).alias("h"))
    )


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """h and first_doc of the lines on at least ``min_sites`` sites."""
    lines = _lines(docs)
    sketched = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.min("doc_id").alias("first_doc"))
    spread = materialize(sketched.where(F.col("sites") >= min_sites * (1 - near)), "spread")
    clear = spread.where(F.col("sites") > min_sites * (1 + near)).select("h", "first_doc")
    close = spread.where(F.col("sites") <= min_sites * (1 + near)).select("h", "first_doc")
    pairs = lines.select("h", "site").join(close, "h").groupBy("h", "site").agg(F.min("first_doc").alias("first_doc"))
    exact = pairs.groupBy("h").agg(F.count("*").alias("n"), F.min("first_doc").alias("first_doc"))
    return materialize(clear.unionByName(exact.where(F.col("n") >= min_sites).select("h", "first_doc")), "boilerplate")


def clean_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The rows of ``docs`` with cleaned text, and n_lines and n_lines_removed beside it (in place of columns so named)."""
    docs = docs.drop("n_lines", "n_lines_removed")
    marked = boilerplate(docs, min_sites)
    hit = _lines(docs).join(marked, "h").select("doc_id", "h", F.col("doc_id").eqNullSafe(F.col("first_doc")).alias("first"))
    notes = hit.groupBy(F.col("doc_id").alias("note_id")).agg(F.collect_set("h").alias("gone"), F.collect_set(F.when(F.col("first"), F.col("h"))).alias("stay_once"))
    # The notes grow with the corpus, so they are merged with it and never broadcast.
    joined = docs.join(notes.hint("merge"), docs["doc_id"].eqNullSafe(notes["note_id"]), "left")
    names = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    text = F.col(names["text"])
    parts = joined.select(*[docs[c].alias(n) for c, n in names.items()], "gone", "stay_once", F.split(docs["text"], "\n", -1).alias("lines"))
    hashed = parts.withColumn("hashes", F.when(F.col("gone").isNotNull(), F.transform("lines", _key)))

    def stays(x: Column, i: Column) -> Column:
        h = F.get("hashes", i)
        return (F.trim(x) == "") | ~F.array_contains("gone", h) | (F.array_contains("stay_once", h) & (F.array_position("hashes", h) == i + 1))

    kept = hashed.withColumn("kept", F.when(F.col("gone").isNotNull(), F.filter("lines", stays)))
    out = [F.when(F.col("kept").isNull(), text).otherwise(F.array_join("kept", "\n")).alias("text") if c == "text" else F.col(n).alias(c) for c, n in names.items()]
    n_lines = F.when(text.isNull(), 0).otherwise(F.size("lines")).cast("long")
    removed = F.when(F.col("kept").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long")
    return kept.select(*out, n_lines.alias("n_lines"), removed.alias("n_lines_removed"))


def digest(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256."""
    cleaned = clean_lines(own_columns(docs, "doc_id", "text", "source"), min_sites)
    return cleaned.select("doc_id", "n_lines", F.col("n_lines_removed").alias("n_removed"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
