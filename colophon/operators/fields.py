"""Records as rows with one ordered array column for each field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = "array<string>"


def field(df: DataFrame, name: str) -> Column:
    """The occurrences of a field; a missing field, like a null, has none."""
    none = F.array().cast(EMPTY)
    return F.coalesce(F.col(f"`{name}`"), none) if name in df.columns else none


def records_from_occurrences(occurrences: DataFrame, fields: list[str], key: str = "record_id") -> DataFrame:
    """(record_id, field, pos, value) rows to records; one shuffle, fields named beforehand."""
    wanted = occurrences.where(F.col("field").isin(fields))
    cells = [F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("pos", "value")))), lambda s: s["value"]).alias(f) for f in fields]
    return wanted.groupBy(key).agg(*cells)


def occurrences_from_records(records: DataFrame, fields: list[str], key: str = "record_id") -> DataFrame:
    """The way back; empty fields give no rows."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), field(records, f).alias("values")) for f in fields])
    return records.select(key, F.explode(cells).alias("cell")).select(key, F.col("cell.field").alias("field"), F.posexplode("cell.values").alias("pos", "value"))


def records_from_xml(df: DataFrame, xml: str, addresses: dict[str, str]) -> DataFrame:
    """One array column for each name, read from the record tree by its address."""
    from colophon.functions.address import all_occurrences

    return df.withColumns(dict(zip(addresses, all_occurrences(F.col(xml), list(addresses.values())))))
