"""Secret scans, native: DataFrame functions only.

Base rules find three kinds of spans by pattern: leftmost, non-overlapping matches are cut out with split(), whose
gaps give the positions. A fourth kind, ``random``, comes from two character Markov models (bigrams), one trained on
random strings and one on ordinary identifiers, both labelled samples. In a run of key characters the part with the
greatest sum of log-likelihood ratios is looked at, so that a name before or after a key does not hide it; the part is
reported if it is long and varied enough, its sum is over a threshold, and it touches no base span. Threshold and
variety are calibrated on both samples.

Defined cases: a null text is empty; a null doc_id is returned as null; repeated rows are scanned each; a very long text
is scanned whole, its places are summed in blocks; an empty table gives an empty result (the models are then trained
without the corpus's words); extra columns are ignored; of spans with one start the order is assign, access, hex,
random. A run gives one random span at most, its best part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.llm.common import materialize, own_columns

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of under 24 hex digits fail anyway, so they need not be cut out first.
HEX = r"[0-9a-f]{24,}"
#: Candidates of the Markov models: runs of so many characters and more. A sign of equality parts a name from its value, so it ends a run.
LEAST = 16
RUN = rf"[A-Za-z0-9+/_-]{{{LEAST},}}"

#: Matches that are placed together.
BLOCK = 256

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_N = len(ALPHABET) + 1
#: Bounds of the labelled samples: random strings, documents whose words serve as ordinary identifiers, and identifiers of common words.
RANDOM_STRINGS, SAMPLE_DOCS, COMMON_NAMES = 8000, 1000, 6000
#: Share of ordinary identifiers under the threshold, and of random strings that are varied enough.
QUANTILE = 0.9995
#: Words that names in programs and paths are made of.
COMMON = (
    "abstract access account action address admin alpha apache api app array async auth authorization backup base binary block body boolean bridge buffer build bundle button byte cache call channel char check class client cloud code collection column command "
    "common compile component config connection console container content context controller convert cookie core count create credential current data database date debug default delete deploy description dev dialog directory document domain download driver dynamic "
    "editor element email encoder engine entity environment error event exception execute export factory field file filter folder font form format framework function gateway generator get global group hadoop handler hash header helper home host html http https "
    "icon image implementation import index init input install instance integer interface internal invalid item java job json key label language layout lib library limit line link list listener local location log logger login main manager map mapper mapreduce "
    "message meta method model module monitor mysql name native network node null number object option order org output package page parameter parent parser password path pattern permission platform plugin pool port process processor profile project property protocol "
    "provider proxy public python query queue random read record redirect reference register registry release remote render report repository request resource response result return role root route rule runtime sample schema script search security select sequence "
    "serializer server service servlet session setting share shell simple singleton site size socket source spring sql state static status storage store stream string style subject submit support switch system table target task template test text theme thread time "
    "timeout token tool tracker transaction transform tree trigger type unit update upload url user usr util value variable vendor version view virtual web widget window worker wrapper write xml zone"
).split()


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs of start, end (code points, end exclusive) and the match.

    Places are running sums of the lengths of gaps and matches. They are summed in blocks, as an array that grows
    by one is copied at every step, which would cost the square of the number of matches.
    """
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.coalesce(F.length(p["hit"]), F.lit(0))
        grown = F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("hit")))
        return F.struct(end.alias("at"), F.when(p["hit"].isNull(), acc["out"]).otherwise(grown).alias("out"))

    def in_block(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def moved(acc: Column, b: Column) -> Column:
        found = F.transform(b["out"], lambda x: F.struct((x["start"] + acc["at"]).alias("start"), (x["end"] + acc["at"]).alias("end"), x["hit"].alias("hit")))
        return F.struct((acc["at"] + b["at"]).alias("at"), F.array_append(acc["out"], found).alias("out"))

    def summed(all_pieces: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_pieces) - 1) / BLOCK).cast("int")), lambda i: in_block(F.slice(all_pieces, i * BLOCK + 1, F.lit(BLOCK))))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,hit:string>>>").alias("out")), moved, lambda acc: F.flatten(acc["out"]))

    # A one-element array binds the pieces to a name, so that they are cut once and not in every step.
    return F.get(F.transform(F.array(pieces), summed), F.lit(0))


def _code(c: Column) -> Column:
    return F.call_function("instr", F.lit(ALPHABET), c)


def _pairs(s: Column) -> Column:
    """Codes of neighbouring characters as one number each."""
    codes = F.transform(F.split(s, ""), _code)

    def joined(c: Column) -> Column:
        n = F.greatest(F.size(c) - 1, F.lit(0))
        return F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda x, y: x * _N + y)

    return F.get(F.transform(F.array(codes), joined), F.lit(0))


def _styled(four: Column, at: Column) -> Column:
    """Three of eight ways to write words as one name, in turn by place."""
    low, title = F.transform(four, F.lower), F.transform(F.transform(four, F.lower), F.initcap)
    number = F.pmod(F.xxhash64(F.array_join(four, "")), F.lit(2100)).cast("string")
    ways = F.array(
        F.array_join(low, ""), F.array_join(low, "_"), F.array_join(low, "-"), F.array_join(title, ""), F.upper(F.array_join(four, "_")), F.concat(F.lit("/"), F.array_join(low, "/")),
        F.concat(F.get(low, F.lit(0)), F.array_join(F.slice(title, 2, 3), "")), F.concat(F.array_join(low, "_"), F.lit("_"), number),
    )
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.get(ways, F.pmod(at * 3 + k, F.lit(8))))


def labelled_sample(docs: DataFrame) -> DataFrame:
    """(s, random): bounded samples of random strings and of names, made of the corpus's words and of common ones.

    Random ones are base64, hex, upper-case, lower-case and decimal strings of 16 characters to the whole digest;
    ordinary ones are also letters that repeat and characters in sequence.
    """
    spark = docs.sparkSession
    seed = F.sha2(F.col("id").cast("string"), 256)
    raw = F.regexp_replace(F.base64(F.unhex(seed)), "=+$", "")
    digits = F.translate(seed, "abcdef", "")
    kinds = F.array(raw, seed, F.upper(F.regexp_replace(raw, "[+/]", "")), F.lower(F.regexp_replace(raw, "[+/]", "")), F.regexp_replace(raw, "[+/]", ""), digits)
    whole = F.get(kinds, F.pmod(F.col("id"), F.lit(6)).cast("int"))
    random = spark.range(RANDOM_STRINGS).select(F.substr(whole, F.lit(1), F.lit(LEAST) + F.pmod(F.xxhash64("id"), F.lit(28)).cast("int")).alias("s"), F.lit(True).alias("random")).where(F.length("s") >= LEAST)
    # The ids are chosen first, so that no text goes through the one task that picks them.
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    # Written once: both passes of the training read these rows, and no pattern is searched for in other texts.
    some = materialize(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "sample")
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))
    fours = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 4).cast("int"))
    corpus = some.select(words.alias("w")).where(F.size("w") > 0).select(F.explode(F.flatten(F.transform(fours, lambda i: _styled(F.slice("w", i * 4 + 1, F.lit(4)), i)))).alias("s"))
    known = F.split(F.lit(" ".join(COMMON)), " ")
    pick = F.transform(F.sequence(F.lit(0), F.pmod(F.xxhash64("id"), F.lit(3)).cast("int") + 1), lambda k: F.get(known, F.pmod(F.xxhash64(F.col("id"), k), F.lit(len(COMMON))).cast("int")))
    common = spark.range(COMMON_NAMES).select(F.explode(_styled(pick, F.col("id").cast("int"))).alias("s"))
    lines = spark.range(len(ALPHABET)).select(F.explode(F.array(F.repeat(F.substr(F.lit(ALPHABET), (F.col("id") + 1).cast("int"), F.lit(1)), F.lit(24)), F.substr(F.lit(ALPHABET * 2), (F.col("id") + 1).cast("int"), F.lit(20)))).alias("s"))
    ordinary = corpus.unionByName(common).unionByName(lines).where(F.length("s") >= 8)
    return random.unionByName(ordinary.select("s", F.lit(False).alias("random")))


def train(docs: DataFrame) -> tuple[list[float], float, int]:
    """The table of log-likelihood ratios by pair, the threshold and the least variety. At most 2 * 68 * 68 counts reach the driver."""
    sample = labelled_sample(own_columns(docs, "doc_id", "text"))
    counts = sample.select("random", F.explode(_pairs(F.col("s"))).alias("pair")).groupBy("random", "pair").agg(F.count("*").alias("n")).collect()
    logs = {}
    for label in (True, False):
        n = {r["pair"]: r["n"] for r in counts if r["random"] == label}
        by_first = [sum(n.get(a * _N + b, 0) for b in range(_N)) for a in range(_N)]
        logs[label] = [math.log((n.get(p, 0) + 0.5) / (by_first[p // _N] + 0.5 * _N)) for p in range(_N * _N)]
    table = [a - b for a, b in zip(logs[True], logs[False])]
    judged = sample.where(F.length("s") >= LEAST).select("random", best_part(F.col("s"), table).alias("b"), "s")
    ratio, long = F.col("b.sum"), F.col("b.to") - F.col("b.from") >= LEAST
    quantiles = judged.agg(
        F.percentile_approx(F.when(~F.col("random"), F.when(long, ratio).otherwise(0.0)), QUANTILE, 10_000).alias("ordinary"),
        F.percentile_approx(F.when(F.col("random"), ratio), 1 - QUANTILE, 10_000).alias("random"),
        F.percentile_approx(F.when(F.col("random"), F.size(F.array_distinct(F.split("s", "")))), 1 - QUANTILE, 10_000).alias("variety"),
    ).first()
    # Half-way between the samples where they stand apart, and never under the ordinary ones.
    return table, max(quantiles["ordinary"], (quantiles["ordinary"] + quantiles["random"]) / 2, 0.0), int(quantiles["variety"])


def best_part(s: Column, table: list[float]) -> Column:
    """The part of a string whose pairs have the greatest sum of log-likelihood ratios: from, to (exclusive) and sum."""
    ratios = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("now"), F.lit(0).alias("since"), F.lit(0.0).alias("sum"), F.lit(0).alias("from"), F.lit(0).alias("to"))

    def step(acc: Column, p: Column) -> Column:
        fresh = acc["now"] <= 0
        now = F.when(fresh, 0.0).otherwise(acc["now"]) + F.get(ratios, p)
        since, better = F.when(fresh, acc["at"]).otherwise(acc["since"]), now > acc["sum"]
        pick = lambda new, old: F.when(better, new).otherwise(old)
        return F.struct((acc["at"] + 1).alias("at"), now.alias("now"), since.alias("since"), pick(now, acc["sum"]).alias("sum"), pick(since, acc["from"]).alias("from"), pick(acc["at"] + 2, acc["to"]).alias("to"))

    return F.aggregate(_pairs(s), start, step)


def scan(docs: DataFrame, model: tuple[list[float], float, int] | None = None) -> DataFrame:
    """doc_id and arrays of spans: assign, access, hex and random."""
    table, cut, variety = model or train(docs)
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    t = F.col("t")
    found = own_columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    assign = F.filter(spans(t, ASSIGN), lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 6)
    access = F.filter(spans(t, ACCESS), lambda x: F.length(x["hit"]) >= 20)
    base = found.select(
        "doc_id",
        "t",
        F.when(t.contains(":") | t.contains("="), assign).otherwise(none).alias("assign"),
        F.when(t.contains("AKIA"), access).otherwise(none).alias("access"),
        F.when(t.rlike(HEX), spans(t, HEX)).otherwise(none).alias("hex"),
        F.when(t.rlike(RUN), spans(t, RUN)).otherwise(none).alias("run"),
    )

    def part(r: Column) -> Column:
        b = best_part(r["hit"], table)
        return F.get(F.transform(F.array(b), lambda x: F.struct((r["start"] + x["from"]).alias("start"), (r["start"] + x["to"]).alias("end"), F.substr(r["hit"], x["from"] + 1, x["to"] - x["from"]).alias("hit"), x["sum"].alias("sum"))), F.lit(0))

    taken = F.concat("assign", "access", "hex")
    random = lambda p: (p["sum"] > cut) & (p["end"] - p["start"] >= LEAST) & (F.size(F.array_distinct(F.split(p["hit"], ""))) >= variety)
    fresh = F.filter("parts", lambda p: random(p) & ~F.exists(taken, lambda b: (b["start"] < p["end"]) & (p["start"] < b["end"])))
    parts = base.select("doc_id", "assign", "access", "hex", F.transform("run", part).alias("parts"))
    return parts.select("doc_id", "assign", "access", "hex", F.transform(fresh, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["hit"].alias("hit"))).alias("random"))


def _joined(*kinds: str) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""

    def tagged(i: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")).alias("s")))

    return F.array_join(F.transform(F.array_sort(F.concat(*[tagged(i, k) for i, k in enumerate(kinds)])), lambda x: x["s"]), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query contract."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex", "random")]
    return scan(docs).select("doc_id", *counts[:3], F.sha2(F.encode(_joined("assign", "access", "hex"), "UTF-8"), 256).alias("base_sha256"), _joined("assign", "access", "hex", "random").alias("spans"), counts[3])
