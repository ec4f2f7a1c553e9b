"""Benchmark decontamination by a distributed positional inverted index, native: DataFrame functions only.

``build_index`` stores postings (term, doc_id, pos) of the training text, sorted by term in every file, for the
terms that test items use; other terms cannot be asked for. Of every test window the two rarest terms are looked
up, and their postings, adjusted by the term's place in the item, must agree on one alignment of item and
document; nearly all documents drop out here. The alignments left are compared word by word with the document;
documents without one stay where they are.
``proximity`` returns the looser matches: both terms within ``slop`` words in any order.

Defined cases: null and empty texts have no words and no hits, and an item without words has no window; an item
of fewer words than the window is one window; a null doc_id or item_id matches only exactly known rows: its words
are compared like all others, and the item is named by an empty string; repeated rows are judged alike; empty
tables give no hits; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.common import materialize, noted_apart, own_columns

WINDOW = 10
#: Lists that are intersected before texts are compared.
LISTS = 2

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased; a last element may be empty."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.split(F.regexp_replace(low, r"\A" + _GAP, ""), _GAP, -1)


def _full(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def items_of(benchmark: DataFrame) -> DataFrame:
    """ikey, item_id, words and len, the length of the item's windows."""
    items = own_columns(benchmark, "item_id", "text").distinct()
    words = items.select(F.xxhash64("item_id", "text").alias("ikey"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), _full(words_of(F.col("text"))).alias("words"))
    return words.where(F.size("words") > 0)


def build_index(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Stored postings (term, doc_id, pos); term is a hash, as texts are compared in the end."""
    terms = materialize(items.select(F.explode("words").alias("w")).select(F.xxhash64("w").alias("term")).distinct(), "terms")
    tokens = own_columns(docs, "doc_id", "text").select("doc_id", F.posexplode(words_of(F.col("text"))).alias("pos", "word"))
    postings = tokens.select(F.xxhash64("word").alias("term"), "doc_id", "pos").join(terms, "term")
    return materialize(postings.sortWithinPartitions("term", "doc_id", "pos"), "postings")


def probes(index: DataFrame, items: DataFrame, window: int = WINDOW, lists: int = LISTS) -> DataFrame:
    """(ikey, start, rank, at, term): of every window the places of its rarest terms, unless a term never occurs."""
    # Written, so that its size is known: it is broadcast while small, and otherwise joined by an exchange that can be split.
    frequency = materialize(index.groupBy("term").agg(F.count("*").alias("df")), "frequency")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    windows = items.select("ikey", "words", F.explode(starts).alias("start"))
    places = windows.select("ikey", "start", F.posexplode(F.slice("words", F.col("start") + 1, F.lit(window))).alias("k", "w"))
    counted = places.select("ikey", "start", (F.col("start") + F.col("k")).alias("at"), F.xxhash64("w").alias("term")).join(frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    one = Window.partitionBy("ikey", "start")
    ranked = counted.withColumn("rank", F.row_number().over(one.orderBy("df", "at")) - 1).withColumn("least", F.min("df").over(one))
    return materialize(ranked.where((F.col("least") > 0) & (F.col("rank") < lists)).select("ikey", "start", "rank", "at", "term"), "probes")


def alignments(index: DataFrame, items: DataFrame, probe: DataFrame, lists: int = LISTS) -> DataFrame:
    """(ikey, doc_id, shift) where offset-adjusted lists agree: word j of the item would be word shift + j."""
    places = materialize(probe.select("ikey", "at", "term").distinct(), "places")
    moved = index.join(places, "term").select("ikey", "doc_id", (F.col("pos") - F.col("at")).alias("shift"), "at")
    met = moved.groupBy("ikey", "doc_id", "shift").agg(F.count("*").alias("n"))
    need = items.select("ikey", F.least(F.size("words"), F.lit(lists)).alias("need"))
    return met.join(need, "ikey").where("n >= need").select("ikey", "doc_id", "shift")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with n_words, n_hit, items (sorted ids) and contaminated beside them (in place of columns so named)."""
    docs = docs.drop("n_words", "n_hit", "items", "contaminated")
    items = materialize(items_of(benchmark), "items")
    index = build_index(docs, items)
    found = alignments(index, items, probes(index, items, window))
    candidate = F.struct("item_id", "words", "shift")
    notes = materialize(found.join(items, "ikey").groupBy(F.col("doc_id").alias("note_id")).agg(F.collect_list(candidate).alias("aligned")), "alignments")
    # Few texts have an alignment, and only they are shuffled. The alignments grow with the corpus, so they are merged with the texts and never broadcast.
    names = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    some, others = noted_apart(docs.select(*[docs[c].alias(n) for c, n in names.items()]), names["doc_id"], notes, "note_id")
    met = some.join(notes.hint("merge"), some[names["doc_id"]].eqNullSafe(notes["note_id"]), "left").drop("note_id")
    tokens = met.unionByName(others.withColumn("aligned", F.lit(None).cast(notes.schema["aligned"].dataType))).withColumn("tokens", words_of(F.col(names["text"])))

    def windows_at(c: Column) -> Column:
        n = F.least(F.size(c["words"]), F.lit(window))
        starts = F.filter(F.sequence(F.lit(0), F.size(c["words"]) - n), lambda k: (c["shift"] + k >= 0) & (F.slice("tokens", F.greatest(c["shift"] + k + 1, F.lit(1)), n) == F.slice(c["words"], k + 1, n)))
        return F.transform(starts, lambda k: F.struct(c["item_id"].alias("item_id"), (c["shift"] + k).alias("from"), (c["shift"] + k + n - 1).alias("to")))

    n_words = F.size("tokens") - F.when(F.element_at("tokens", -1) == "", 1).otherwise(0)
    matched = tokens.withColumn("n_words", n_words.cast("long")).withColumn("hits", F.flatten(F.transform("aligned", windows_at)))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["from"], h["to"]))))
    out = matched.withColumn("n_hit", F.coalesce(F.size(covered), F.lit(0)).cast("long")).withColumn("items", F.coalesce(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"]))), F.array().cast("array<string>")))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "n_words", F.when(F.col("hits").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_hit")).alias("n_hit"), "items", (F.col("hits").isNotNull() & (F.col("n_hit") > 0)).alias("contaminated"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of the query contract."""
    found = contamination(own_columns(docs, "doc_id", "text"), benchmark)
    ids = F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


def proximity(docs: DataFrame, benchmark: DataFrame, slop: int, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, start: windows whose two rarest terms stand at most ``slop`` words apart, in any order."""
    items = materialize(items_of(benchmark), "items")
    index = build_index(docs, items)
    probe = probes(index, items, window)
    hits = index.join(probe, "term").select("ikey", "start", "rank", "doc_id", "pos")
    bins = F.floor(F.col("pos") / (slop + 1))
    one = hits.where("rank = 0").select("ikey", "start", "doc_id", F.col("pos").alias("p"), F.explode(F.array(bins - 1, bins, bins + 1)).alias("bin"))
    two = hits.where("rank = 1").select("ikey", "start", "doc_id", F.col("pos").alias("q"), bins.alias("bin"))
    near = one.join(two, ["ikey", "start", "doc_id", "bin"]).where(F.abs(F.col("p") - F.col("q")) <= slop)
    return near.join(items.select("ikey", "item_id"), "ikey").select("doc_id", "item_id", "start").distinct()
