"""Hashes, names, normalisation, token estimates, chunks and codecs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

UNCLASSIFIED = "No clasificados"
UNKNOWN = "UNKNOWN"
#: Texts and bytes that a Python worker gets at once.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20

# Patterns that token counts and host names are defined by.
WORD_OR_NUMBER = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
PUNCTUATION = r"\p{Punct}"
CJK_RANGES = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2CEB0, 0x2EBEF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0xAC00, 0xD7AF)]
CJK = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in CJK_RANGES) + "]"
WORD_WEIGHT, PUNCTUATION_WEIGHT, CJK_WEIGHT = 1.10, 0.35, 0.65
DOMAIN = r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*(\.[A-Za-z-]{2,})"


def bounded_batches() -> None:
    """Python workers get texts in small batches, as a batch is held several times over; larger settings are lowered."""
    session = SparkSession.getActiveSession()
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)) if session else ():
        now = session.conf.get(key, None)
        if now is None or not now.isdigit() or int(now) == 0 or int(now) > most:
            session.conf.set(key, most)


def record_id(identifier: Column) -> Column:
    """The id of a catalog record: lower-case MD5 of its identifier."""
    return F.md5(identifier)


def content_hash(content: Column) -> Column:
    """The id of a stored content: upper-case MD5."""
    return F.upper(F.md5(content))


@F.pandas_udf(StringType())
def _xxhash64(content: pd.Series) -> pd.Series:
    import xxhash

    return content.map(lambda s: None if s is None else f"{xxhash.xxh64_intdigest(s.encode()):016X}")


def xxhash64_seed0(content: Column) -> Column:
    """XXH64 with seed 0 as 16 upper-case hex digits; Spark's own function has seed 42."""
    bounded_batches()
    return _xxhash64(content)


def fingerprint(acronym: Column, identifier: Column, prefix: str = "", translate: dict[str, str] | None = None) -> Column:
    """``ACRONYM_md5``; the hashed text names the translated acronym if there is one. Without acronym: ``00_md5``."""
    plain = F.concat(F.lit(prefix), identifier)
    hashed = plain
    for name, other in (translate or {}).items():
        hashed = F.when(acronym == name, F.concat(F.lit(f"{prefix}.{other}:"), identifier)).otherwise(hashed)
    return F.when(acronym.isNull(), F.concat(F.lit("00_"), F.md5(plain))).otherwise(F.concat_ws("_", acronym, F.md5(hashed)))


def index_fingerprint(acronym: Column, id_hash: Column) -> Column:
    return F.concat_ws("_", acronym, id_hash)


def sanitize_acronym(acronym: Column) -> Column:
    """Upper case with anything but ``A-Z0-9-_`` replaced; UNKNOWN for null and blank."""
    return F.when(acronym.isNull() | (F.trim(acronym) == ""), UNKNOWN).otherwise(F.regexp_replace(F.upper(acronym), r"[^A-Z0-9\-_]", "_"))


def token_estimate(text: Column) -> Column:
    """Estimated model tokens: 0 for blank text, else at least 1."""
    n = sum((F.regexp_count(text, F.lit(p)) * F.lit(w) for p, w in ((WORD_OR_NUMBER, WORD_WEIGHT), (PUNCTUATION, PUNCTUATION_WEIGHT), (CJK, CJK_WEIGHT))), F.lit(0.0))
    # Sums such as 1.1 * 10 carry a rounding error that must not lift the ceiling.
    return F.when(text.isNull() | text.rlike(r"\A\s*\z"), 0).otherwise(F.greatest(F.lit(1), F.ceil(F.round(n, 9)).cast("int")))


def collapse(text: Column) -> Column:
    """Words broken at line ends joined, white space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"-\s*\n\s*", ""), r"\s+", " "))


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def normalise(text: Column) -> Column:
    """NFC, then ``collapse``."""
    bounded_batches()
    return collapse(_nfc(text))


def normal(text: str | None) -> str:
    """``normalise`` for one Python string; null gives the empty one."""
    joined = re.sub(r"-\s*\n\s*", "", unicodedata.normalize("NFC", text or ""), flags=re.ASCII)
    return re.sub(r"\s+", " ", joined, flags=re.ASCII).strip(" ")


def estimate(text: str) -> int:
    """``token_estimate`` for one Python string."""
    from colophon.functions import splitting

    return splitting.estimate(text)


def chunks(title: Column, abstract: Column, most_tokens: int = 128, most_chunks: int = 5, overlap: int = 0) -> Column:
    """Up to ``most_chunks`` texts of title, line break, piece of the abstract; empty if either is blank.

    Both are normalised in the Python function that cuts, so a task has one Python worker.
    """
    from colophon.functions.splitting import split_text

    @F.pandas_udf(ArrayType(StringType()))
    def cut(titles: pd.Series, abstracts: pd.Series) -> pd.Series:
        return pd.Series([[f"{t}\n{c}" for c in split_text(a, most_tokens, overlap)[:most_chunks]] if t and a else [] for t, a in zip(titles.fillna("").map(normal), abstracts.fillna("").map(normal))])

    bounded_batches()
    return cut(title, abstract)


def title_counts(title: Column, least: int = 5) -> Column:
    """True for titles of enough words to be embedded on their own."""
    return F.size(F.filter(F.split(F.trim(title), r"\s+"), lambda w: w != "")) >= least


def prefixed_content(occ: Column, prefix: str) -> Column:
    """What follows the prefix in the last value that has it, trimmed; UNKNOWN if none has."""
    found = F.filter(occ, lambda v: v.startswith(prefix))
    return F.coalesce(F.trim(F.substr(F.try_element_at(found, F.lit(-1)), F.lit(len(prefix) + 1))), F.lit(UNKNOWN))


def domain_of(identifier: Column) -> Column:
    """The first host name in the identifier, or the name for unclassified ones."""
    return F.coalesce(F.nullif(F.regexp_extract(identifier, DOMAIN, 0), F.lit("")), F.lit(UNCLASSIFIED))


def encode_occurrences(values: Column) -> Column:
    """map<string, array<string>> as ``k:v1,v2;k2:v3``; values with ``,;:`` do not survive."""
    return F.array_join(F.transform(F.map_entries(values), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], ","))), ";")


def decode_occurrences(text: Column) -> Column:
    """The way back: blank values are dropped, entries without a colon too, and the last of equal keys wins."""
    entries = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda e: e.contains(":"))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: F.substring_index(o, ":", 1) == F.substring_index(e, ":", 1)))
    pair = lambda e: F.struct(F.substring_index(e, ":", 1), F.filter(F.transform(F.split(F.regexp_replace(e, r"\A[^:]*:", ""), ","), F.trim), lambda v: v != ""))
    return F.map_from_entries(F.transform(last, pair))


def rule_details(details: Column) -> Column:
    """array<struct<rule_id, value>> as ``rule:value;rule:value``."""
    return F.array_join(F.transform(details, lambda d: F.concat_ws(":", d["rule_id"].cast("string"), d["value"])), ";")


def joined_occurrences(occ: Column) -> Column:
    """Values joined by a space, blank ones left out."""
    return F.array_join(F.filter(occ, lambda v: F.trim(v) != ""), " ")


def embed(batches: Iterator[pd.DataFrame], text: str, encoder, dimension: int) -> Iterator[pd.DataFrame]:
    """For mapInPandas: adds ``embedding`` by an injected batch encoder; null on failure or a wrong dimension."""
    for batch in batches:
        try:
            vectors = list(encoder(batch[text].tolist()))
        except Exception:
            vectors = [None] * len(batch)
        yield batch.assign(embedding=[v if v is not None and len(v) == dimension else None for v in vectors])
