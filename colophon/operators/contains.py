"""Search for texts that contain something, by an index of three-letter pieces.

The index has a row for each piece that a value holds, in lower case. A search takes the pieces of its pattern's
literal parts, intersects their rows by counting, and tries the pattern on what is left; so ``%`` and ``_`` stay
wildcards. A pattern without a literal part of three ASCII characters has no piece, and is searched by a scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 3


def index(df: DataFrame, key: str, column: str) -> DataFrame:
    """piece and key, each pair once. Written sorted by piece, a search reads the row groups of its pieces alone."""
    text = F.lower(F.col(column))
    last = F.length(text) - PIECE + 1
    pieces = F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(PIECE))))
    return df.select(F.explode(F.array_distinct(pieces)).alias("piece"), key)


def write_index(df: DataFrame, key: str, column: str, path: str) -> None:
    index(df, key, column).repartitionByRange("piece").sortWithinPartitions("piece").write.parquet(path)


def _literals(pattern: str) -> list[str]:
    """The parts of a LIKE pattern between wildcards; a backslash makes the next character a literal."""
    out, now, quoted = [], "", False
    for c in pattern:
        if quoted or c not in "%_\\":
            now, quoted = now + c, False
        elif c == "\\":
            quoted = True
        else:
            out.append(now)
            now = ""
    return [*out, now]


def pieces(pattern: str) -> list[str]:
    """The pieces that every match holds. Only ASCII ones, whose lower case is the same everywhere."""
    parts = [p.lower() for p in _literals(pattern)]
    return sorted({p[i : i + PIECE] for p in parts for i in range(len(p) - PIECE + 1) if p[i : i + PIECE].isascii()})


def search(df: DataFrame, postings: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    """The rows whose column matches a LIKE pattern, whatever the case: those of a scan with ``ilike``."""
    wanted, fits = pieces(pattern), F.col(column).ilike(pattern)
    if not wanted:
        return df.where(fits)
    hits = postings.where(F.col("piece").isin(wanted)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted))
    return df.join(hits.select(key), key, "left_semi").where(fits)


def containing(text: str) -> str:
    """The pattern of values that contain a text; its own wildcards stay, as in filters of identifiers."""
    return "%" + text.replace("\\", "\\\\") + "%"
