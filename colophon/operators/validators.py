"""Validation rules: a predicate on each occurrence, a quantifier over them, a verdict for each record."""

from __future__ import annotations

import socket
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.functions.address import node_count
from colophon.functions.expression import atom_fields, compile_expression, whole
from colophon.model import QUANTIFIERS, BadRule, Registered
from colophon.operators import fields
from colophon.shipping import ship

NO_OCCURRENCES = "no_occurrences_found"
#: Values beyond which a vocabulary is joined as a table (``mark_controlled``) and not written into the plan.
MANY_VALUES = 10_000


def content_verdict(n: Column, valid: Column, quantifier: str) -> Column:
    """Content rules; ZERO_OR_MORE is false only where there are occurrences and none is valid."""
    return {"ONE_ONLY": valid == 1, "ONE_OR_MORE": valid >= 1, "ZERO_OR_MORE": (n == 0) | (valid > 0), "ZERO_ONLY": valid == 0, "ALL": valid == n}[quantifier]


def node_verdict(n: Column, quantifier: str) -> Column:
    """Node rules: ZERO_OR_MORE always holds, ALL needs a node."""
    return {"ONE_ONLY": n == 1, "ONE_OR_MORE": n >= 1, "ZERO_OR_MORE": F.lit(True), "ZERO_ONLY": n == 0, "ALL": n > 0}[quantifier]


def shortened(value: Column, most: int) -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit("..."))).otherwise(value)


@dataclass(kw_only=True)
class ValidatorRule(Registered):
    """Settings that all rules share."""

    registry = {}
    rule_id: int = 0
    name: str = ""
    description: str = ""
    mandatory: bool = False
    quantifier: str = "ONE_OR_MORE"
    store_occurrences: bool = False

    def __post_init__(self) -> None:
        if self.quantifier not in QUANTIFIERS:
            raise BadRule(f"unknown quantifier {self.quantifier}")

    def verdict(self, get: Callable[[str], Column]) -> Column:
        raise NotImplementedError

    def details(self, get: Callable[[str], Column]) -> Column:
        """array<struct<is_valid, value>> of the occurrences."""
        return F.array().cast("array<struct<is_valid:boolean,value:string>>")


@dataclass(kw_only=True)
class ContentRule(ValidatorRule):
    """A predicate on the values of one field. Subclass it and define ``predicate`` to add a rule."""

    field: str = ""

    def predicate(self, value: Column) -> Column:
        raise NotImplementedError

    def report(self, value: Column) -> Column:
        return value

    def verdict(self, get: Callable[[str], Column]) -> Column:
        occ = get(self.field)
        return content_verdict(F.size(occ), F.size(F.filter(occ, self.predicate)), self.quantifier)

    def details(self, get: Callable[[str], Column]) -> Column:
        occ = get(self.field)
        each = F.transform(occ, lambda v: F.struct(F.coalesce(self.predicate(v), F.lit(False)).alias("is_valid"), self.report(v).alias("value")))
        none = F.array(F.struct(F.lit(False).alias("is_valid"), F.lit(NO_OCCURRENCES).alias("value")))
        return F.when(F.size(occ) == 0, none).otherwise(each)


@dataclass(kw_only=True)
class ContentLength(ContentRule):
    """The number of characters lies between two bounds."""

    type = "content_length"
    min_length: int = 0
    max_length: int = 2**31 - 1

    def predicate(self, value: Column) -> Column:
        return F.length(value).between(self.min_length, self.max_length)

    def report(self, value: Column) -> Column:
        return F.when(F.length(value) > 50, shortened(value, 50)).otherwise(F.concat(value, F.lit(" | "), F.length(value).cast("string")))


@dataclass(kw_only=True)
class ControlledValue(ContentRule):
    """The value is one of a list, exactly."""

    type = "controlled_value"
    values: list[str] = field(default_factory=list)
    store_occurrences: bool = True

    def predicate(self, value: Column) -> Column:
        return value.isin(*self.values) if self.values else F.lit(False)

    def report(self, value: Column) -> Column:
        return shortened(value, 100)


@dataclass(kw_only=True)
class LargeControlledValue(ControlledValue):
    """The same with values from one ``;``-separated text as well."""

    type = "large_controlled_value"
    values_text: str = ""

    def __post_init__(self) -> None:
        super().__post_init__()
        self.values = [*self.values, *(v for v in self.values_text.split(";") if v)]
        self.values_text = ""
        if len(self.values) > MANY_VALUES:
            raise BadRule(f"over {MANY_VALUES} values: use mark_controlled with a table")


@dataclass(kw_only=True)
class Regex(ContentRule):
    """The pattern matches the whole value."""

    type = "regex"
    pattern: str = ".*"

    def predicate(self, value: Column) -> Column:
        return whole(value, self.pattern)


@dataclass(kw_only=True)
class YearRange(ContentRule):
    """The first match of a pattern is a year near ``current_year``, which is a setting so that results do not drift."""

    type = "year_range"
    pattern: str = "^([0-9]{3,4})"
    lower: int = 0
    upper: int = 0
    current_year: int = 0

    def _found(self, value: Column) -> Column:
        return F.regexp_extract(value, self.pattern, 0)

    def predicate(self, value: Column) -> Column:
        found = self._found(value)
        year = F.when(found.rlike(r"\A[0-9]+\z"), found.try_cast("long"))
        return F.coalesce(year.between(self.current_year - self.lower, self.current_year + self.upper), F.lit(False))

    def report(self, value: Column) -> Column:
        return F.when(value.isNull() | (value == ""), F.lit("NULL or Empty")).otherwise(value)


@dataclass(kw_only=True)
class UrlSyntax(ContentRule):
    """The value is a well-formed URL with a host. Whether it answers is told by ``check_urls``."""

    type = "url_syntax"

    def predicate(self, value: Column) -> Column:
        return F.coalesce(F.try_parse_url(value, F.lit("HOST")).isNotNull(), F.lit(False))


@dataclass(kw_only=True)
class NodeOccurs(ValidatorRule):
    """Counts the nodes of an XPath in the record's XML column."""

    type = "node_occurs"
    xpath: str = "/*"
    xml: str = "xml"

    def verdict(self, get: Callable[[str], Column]) -> Column:
        return node_verdict(node_count(F.col(self.xml), self.xpath), self.quantifier)


@dataclass(kw_only=True)
class FieldExpression(ValidatorRule):
    """A boolean expression over fields. ``legacy_quantifier`` reads all atoms as ONE_OR_MORE."""

    type = "field_expression"
    expression: str = ""
    legacy_quantifier: bool = False

    def verdict(self, get: Callable[[str], Column]) -> Column:
        return compile_expression(self.expression, get, "ONE_OR_MORE" if self.legacy_quantifier else self.quantifier)

    def details(self, get: Callable[[str], Column]) -> Column:
        """A row for each atom whose field has no occurrence; the others leave none."""
        none = F.struct(F.lit(False).alias("is_valid"), F.lit(NO_OCCURRENCES).alias("value"))
        rows = [F.when(F.size(get(name)) == 0, none) for name in atom_fields(self.expression)]
        return F.array_compact(F.array(*rows)) if rows else super().details(get)


def record_verdict(rules: list[ValidatorRule], verdicts: list[Column]) -> Column:
    """True where every mandatory rule holds."""
    return reduce(lambda a, b: a & b, [v if r.mandatory else F.lit(True) for r, v in zip(rules, verdicts)], F.lit(True))


def validate(records: DataFrame, rules: list[ValidatorRule], details: bool = False) -> DataFrame:
    """Adds a boolean ``rule_<id>`` for each rule, ``is_valid``, and on request ``details`` of rules that store them."""
    get = lambda name: fields.field(records, name)
    out = records.withColumns({f"rule_{r.rule_id}": F.coalesce(r.verdict(get), F.lit(False)) for r in rules})
    out = out.withColumn("is_valid", record_verdict(rules, [F.col(f"rule_{r.rule_id}") for r in rules]))
    if not details:
        return out
    parts = [F.transform(r.details(get), _with_rule(r.rule_id)) for r in rules if r.store_occurrences]
    none = F.array().cast("array<struct<rule_id:bigint,is_valid:boolean,value:string>>")
    return out.withColumn("details", F.concat(*parts) if parts else none)


def _with_rule(rule_id: int) -> Callable[[Column], Column]:
    return lambda d: F.struct(F.lit(rule_id).cast("long").alias("rule_id"), d["is_valid"].alias("is_valid"), d["value"].alias("value"))


def mark_controlled(occurrences: DataFrame, vocabulary: DataFrame, value: str = "value") -> DataFrame:
    """Vocabularies of any size: occurrence rows with ``is_valid``; Spark broadcasts the table only while it is small."""
    known = vocabulary.select(F.col(value).alias("known_value")).distinct().withColumn("is_known", F.lit(True))
    joined = occurrences.join(known, occurrences[value] == known["known_value"], "left")
    return joined.withColumn("is_valid", F.coalesce("is_known", F.lit(False))).drop("known_value", "is_known")


def check_urls(df: DataFrame, url: str, checker: Callable[[str], str]) -> DataFrame:
    """Adds ``url_status`` by an injected checker (OK, ERROR, ...); malformed URLs are not asked for, nor is one twice in a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict[str | None, str] = {}
            for u in batch[url].unique():
                try:
                    known[u] = checker(u) if isinstance(u, str) and "://" in u else "MalformedURL"
                except Exception:
                    known[u] = "UnknownError"
            yield batch.assign(url_status=batch[url].map(known))

    schema = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes) + ", url_status string"
    return df.mapInPandas(run, schema)


#: Codes that lead elsewhere; one step is followed. Fixed values.
REDIRECTS = (301, 302, 303)


def _url_status(url: str, opener: Callable[[str], tuple[int, str | None]]) -> str:
    """OK, ERROR, or what kind of failure it was; ``opener`` gives the code and where it leads."""
    try:
        if "://" not in url:
            return "MalformedURL"
        code, elsewhere = opener(url)
        if code in REDIRECTS:
            code, _ = opener(elsewhere or "")
        return "OK" if code == 200 else "ERROR"
    except socket.gaierror:
        return "UnknownHost"
    except ValueError:
        return "MalformedURL"
    except OSError:
        return "ConnectionError"
    except Exception:
        return "UnknownError"


def check_urls_by_host(df: DataFrame, url: str, opener: Callable[[str], tuple[int, str | None]], per_second: float = 1.0, wait: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """Adds ``url_status``: every distinct URL is asked for once, a host at most ``per_second`` times a second.

    All URLs of a host are in one task, which is what a rate for each host asks for; the hosts of a task take turns, so
    that they wait for themselves alone. Null has the status NULL.
    """
    ship(df.sparkSession)
    asked = df.select(F.col(url).alias("_url")).where("_url IS NOT NULL").distinct()
    asked = asked.withColumn("_host", F.lower(F.regexp_extract("_url", r"\A[^:/?#]+://(?:[^/?#@]*@)?([^/:?#]*)", 1)))
    turns = asked.withColumn("_turn", F.row_number().over(Window.partitionBy("_host").orderBy("_url")))
    ordered = turns.repartition("_host").sortWithinPartitions("_turn", "_host")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for batch in batches:
            found = []
            for u, host in zip(batch["_url"], batch["_host"]):
                pause = last.get(host, -1e9) + 1 / per_second - clock()
                if host and pause > 0:
                    wait(pause)
                last[host] = clock()
                found.append(_url_status(u, opener))
            yield pd.DataFrame({"_url": batch["_url"], "url_status": found})

    known = ordered.select("_url", "_host").mapInPandas(run, "_url string, url_status string")
    joined = df.join(known, F.col(url) == F.col("_url"), "left").drop("_url")
    return joined.withColumn("url_status", F.coalesce("url_status", F.lit("NULL")))
