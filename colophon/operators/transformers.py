"""Transformation rules: each rewrites ordered multi-valued fields and says whether a record changed."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.functions.expression import compile_expression, whole
from colophon.model import Registered
from colophon.operators import fields
from colophon.operators.validators import ContentRule, ValidatorRule

Get = Callable[[str], Column]
Rewrite = tuple[dict[str, Column], Column]

_NONE = "array<string>"
#: Values that a rename moves at most.
RENAME_CAP = 101
#: Bytes of a dictionary that is sent to all tasks, and what a key of it takes besides its text.
SMALL_DICTIONARY, KEY_BYTES = 8 << 20, 64


def _without(occ: Column, at: Column) -> Column:
    """The array without its 1-based element."""
    return F.concat(F.slice(occ, 1, at - 1), F.slice(occ, at + 1, F.size(occ)))


def _shorter(before: Column, after: Column) -> Column:
    return F.size(before) != F.size(after)


@dataclass(kw_only=True)
class TransformerRule(Registered):
    """Settings that all rules share. Subclass it and define ``rewrite`` to add a rule."""

    registry = {}
    name: str = ""
    run_order: int = 0

    def rewrite(self, get: Get) -> Rewrite:
        """New columns by field, and whether anything changed."""
        raise NotImplementedError


@dataclass(kw_only=True)
class AddField(TransformerRule):
    """Appends a constant."""

    type = "add_field"
    field: str
    value: str

    def rewrite(self, get: Get) -> Rewrite:
        return {self.field: F.array_append(get(self.field), F.lit(self.value))}, F.lit(True)


@dataclass(kw_only=True)
class ConditionalAdd(TransformerRule):
    """Appends a constant where an expression holds; duplicates go on request, even where it does not."""

    type = "conditional_add"
    field: str
    value: str
    expression: str
    quantifier: str = "ONE_OR_MORE"
    remove_duplicates: bool = False

    def rewrite(self, get: Get) -> Rewrite:
        holds = F.coalesce(compile_expression(self.expression, get, self.quantifier), F.lit(False))
        added = F.when(holds, F.array_append(get(self.field), F.lit(self.value))).otherwise(get(self.field))
        return {self.field: F.array_distinct(added) if self.remove_duplicates else added}, holds


@dataclass(kw_only=True)
class Normalize(TransformerRule):
    """Drops values that a content rule refuses, later duplicates, or both."""

    type = "normalize"
    field: str
    validator: ContentRule | None = field(default=None, metadata={"rules": lambda: ValidatorRule})
    remove_invalid: bool = True
    remove_duplicates: bool = True

    def rewrite(self, get: Get) -> Rewrite:
        occ = out = get(self.field)
        if self.remove_invalid and self.validator is not None:
            out = F.filter(out, lambda v: F.coalesce(self.validator.predicate(v), F.lit(False)))
        if self.remove_duplicates:
            out = F.array_distinct(out)
        return {self.field: out}, _shorter(occ, out)


@dataclass(kw_only=True)
class PriorityTranslate(TransformerRule):
    """Tries translations in order; each may replace the first value that it fits, unless its result is there already.

    ``legacy_flag`` reports the last comparison, as older systems did, in place of whether anything changed.
    """

    type = "priority_translate"
    test_field: str
    write_field: str
    translations: list[list[str]]
    as_prefix: bool = False
    replace: bool = True
    replace_all: bool = True
    legacy_flag: bool = False

    def rewrite(self, get: Get) -> Rewrite:
        same = self.test_field == self.write_field
        pairs = F.array(*[F.struct(F.lit(a).alias("search"), F.lit(b).alias("replace")) for a, b in self.translations])
        start = F.struct(get(self.test_field).alias("test"), F.array().cast(_NONE).alias("added"), get(self.test_field).alias("seen"), F.lit(False).alias("stop"), F.lit(False).alias("changed"), F.lit(False).alias("last"))

        def step(acc: Column, pair: Column) -> Column:
            fits = F.transform(acc["test"], lambda v: v.startswith(pair["search"]) if self.as_prefix else v == pair["search"])
            at = F.array_position(fits, F.lit(True)).cast("int")
            found = at > 0
            hit = found & ~acc["stop"] & ~F.array_contains(acc["seen"], pair["replace"])
            test = F.when(hit, _without(acc["test"], at)).otherwise(acc["test"]) if self.replace else acc["test"]
            grow = lambda a: F.when(hit, F.array_append(a, pair["replace"])).otherwise(a)
            stop = acc["stop"] | found if not self.replace_all else F.lit(False)
            last = F.when(F.size(fits) == 0, acc["last"]).otherwise(F.try_element_at(fits, F.lit(-1)))
            if not self.replace_all:
                last = F.when(acc["stop"] | found, True).otherwise(last)
            return F.struct((grow(test) if same else test).alias("test"), grow(acc["added"]).alias("added"), grow(acc["seen"]).alias("seen"), stop.alias("stop"), (acc["changed"] | hit).alias("changed"), last.alias("last"))

        state = F.aggregate(pairs, start, step)
        out = {self.test_field: state["test"]}
        if not same:
            out[self.write_field] = F.concat(get(self.write_field), state["added"])
        return out, state["last" if self.legacy_flag else "changed"]


@dataclass(kw_only=True)
class Translate(TransformerRule):
    """Dictionary lookup: whole values without regard to case, or every key that is a prefix of the value."""

    type = "translate"
    test_field: str
    write_field: str
    dictionary: dict[str, str]
    as_prefix: bool = False
    replace: bool = True

    def rewrite(self, get: Get) -> Rewrite:
        test, same = get(self.test_field), self.test_field == self.write_field
        keys = sorted(self.dictionary, key=str.lower)
        if self.as_prefix:
            pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(self.dictionary[k]).alias("v")) for k in keys])
            added = F.flatten(F.transform(test, lambda v: F.transform(F.filter(pairs, lambda p: v.startswith(p["k"])), lambda p: p["v"])))
            kept = F.filter(test, lambda v: ~F.exists(pairs, lambda p: v.startswith(p["k"]))) if self.replace else test
            changed = F.size(added) > 0
        else:
            # Of keys that differ in case alone the last one counts.
            table = F.create_map(*[F.lit(x) for k, v in {k.upper().lower(): self.dictionary[k] for k in self.dictionary}.items() for x in (k, v)])
            start = F.struct(F.array().cast(_NONE).alias("kept"), F.array().cast(_NONE).alias("added"), test.alias("seen"), F.lit(False).alias("changed"))

            def step(acc: Column, v: Column) -> Column:
                to = F.try_element_at(table, F.lower(F.upper(v)))
                hit = to.isNotNull() & ~F.array_contains(acc["seen"], F.coalesce(to, F.lit("")))
                keep = F.array_append(acc["kept"], v)
                grow = lambda a: F.when(hit, F.array_append(a, to)).otherwise(a)
                return F.struct((F.when(hit, acc["kept"]).otherwise(keep) if self.replace else keep).alias("kept"), grow(acc["added"]).alias("added"), grow(acc["seen"]).alias("seen"), (acc["changed"] | (hit & (v != to))).alias("changed"))

            state = F.aggregate(test, start, step)
            kept, added, changed = state["kept"], state["added"], state["changed"]
        out = {self.test_field: F.concat(kept, added) if same else kept}
        if not same:
            out[self.write_field] = F.concat(get(self.write_field), added)
        return out, changed


@dataclass(kw_only=True)
class RemoveWhitespace(TransformerRule):
    """Deletes white space in every value."""

    type = "remove_whitespace"
    field: str

    def rewrite(self, get: Get) -> Rewrite:
        bare = lambda v: F.regexp_replace(v, r"\s", "")
        return {self.field: F.transform(get(self.field), bare)}, F.exists(get(self.field), lambda v: F.length(bare(v)) != F.length(v))


def _moved(source: Column, target: Column, cap: int | None) -> tuple[Column, Column]:
    if cap is None:
        return F.array().cast(_NONE), F.concat(target, source)
    return F.slice(source, cap + 1, F.size(source)), F.concat(target, F.slice(source, 1, cap))


@dataclass(kw_only=True)
class Rename(TransformerRule):
    """Moves values to another field, 101 at most."""

    type = "rename"
    source: str
    target: str

    def rewrite(self, get: Get) -> Rewrite:
        left, grown = _moved(get(self.source), get(self.target), RENAME_CAP)
        return {self.source: left, self.target: grown}, F.size(get(self.source)) > 0


@dataclass(kw_only=True)
class BulkRename(TransformerRule):
    """Moves all values for a list of pairs, one pair after the other, so that chains work."""

    type = "bulk_rename"
    pairs: list[list[str]]

    def rewrite(self, get: Get) -> Rewrite:
        now: dict[str, Column] = {}
        see = lambda name: now.get(name, get(name))
        changed = F.lit(False)
        for source, target in self.pairs:
            changed = changed | (F.size(see(source)) > 0)
            now[source], now[target] = _moved(see(source), see(target), None)
        return now, changed


@dataclass(kw_only=True)
class ConditionalRename(TransformerRule):
    """Moves the values that a pattern matches as a whole, 101 at most."""

    type = "conditional_rename"
    source: str
    target: str
    pattern: str

    def rewrite(self, get: Get) -> Rewrite:
        occ = get(self.source)
        fits = F.filter(occ, lambda v: whole(v, self.pattern))
        limit = F.when(F.size(fits) > RENAME_CAP, RENAME_CAP).otherwise(F.size(fits))
        # The first fitting values go; further ones, if any, stay in their order.
        marked = F.transform(occ, lambda v, i: F.struct(v.alias("v"), whole(v, self.pattern).alias("fit"), F.size(F.filter(F.slice(occ, 1, i), lambda o: whole(o, self.pattern))).alias("before")))
        stay = F.transform(F.filter(marked, lambda m: ~m["fit"] | (m["before"] >= RENAME_CAP)), lambda m: m["v"])
        return {self.source: stay, self.target: F.concat(get(self.target), F.slice(fits, F.lit(1), limit))}, F.size(fits) > 0


@dataclass(kw_only=True)
class IdentifierRegex(TransformerRule):
    """Rewrites the record's identifier; its id stays as it is."""

    type = "identifier_regex"
    pattern: str
    replacement: str
    column: str = "identifier"

    def rewrite(self, get: Get) -> Rewrite:
        return {self.column: F.regexp_replace(F.col(self.column), self.pattern, self.replacement)}, F.lit(True)


@dataclass(kw_only=True)
class ReduceHeavy(TransformerRule):
    """Empties the listed fields."""

    type = "reduce_heavy"
    fields: list[str]

    def rewrite(self, get: Get) -> Rewrite:
        changed = reduce(lambda a, b: a | b, [F.size(get(f)) > 0 for f in self.fields], F.lit(False))
        return {f: F.array().cast(_NONE) for f in self.fields}, changed


def _first_only(value: Column, pattern: str, replacement: str) -> Column:
    """Replace the first match alone: a lazy head is matched with it, which shifts all groups by one."""
    shifted = re.sub(r"(?<!\\)\\([1-9])", lambda m: f"\\{int(m[1]) + 1}", pattern)
    return F.regexp_replace(value, rf"\A([\s\S]*?)(?:{shifted})", "$1" + re.sub(r"(?<!\\)\$([0-9])", lambda m: f"${int(m[1]) + 1}" if m[1] != "0" else "$0", replacement))


@dataclass(kw_only=True)
class RegexTranslate(TransformerRule):
    """Replaces the first match of a pattern; results that the source field has already are left out."""

    type = "regex_translate"
    source: str
    target: str
    pattern: str
    replacement: str
    remove_matching: bool = True

    def rewrite(self, get: Get) -> Rewrite:
        source, same = get(self.source), self.source == self.target
        start = F.struct(F.array().cast(_NONE).alias("kept"), F.array().cast(_NONE).alias("added"), source.alias("seen"))

        def step(acc: Column, v: Column) -> Column:
            to = _first_only(v, self.pattern, self.replacement)
            hit = ~F.array_contains(acc["seen"], to)
            keep = F.array_append(acc["kept"], v)
            grow = lambda a: F.when(hit, F.array_append(a, to)).otherwise(a)
            return F.struct((F.when(hit, acc["kept"]).otherwise(keep) if self.remove_matching else keep).alias("kept"), grow(acc["added"]).alias("added"), grow(acc["seen"]).alias("seen"))

        state = F.aggregate(source, start, step)
        out = {self.source: F.concat(state["kept"], state["added"]) if same else state["kept"]}
        if not same:
            out[self.target] = F.concat(get(self.target), state["added"])
        return out, F.size(state["added"]) > 0


@dataclass(kw_only=True)
class RemoveDuplicates(TransformerRule):
    """Keeps the first of equal values."""

    type = "remove_duplicates"
    field: str

    def rewrite(self, get: Get) -> Rewrite:
        out = F.array_distinct(get(self.field))
        return {self.field: out}, _shorter(get(self.field), out)


@dataclass(kw_only=True)
class RemoveBlacklisted(TransformerRule):
    """Drops the listed values; other duplicates stay."""

    type = "remove_blacklisted"
    field: str
    values: list[str]

    def rewrite(self, get: Get) -> Rewrite:
        out = F.filter(get(self.field), lambda v: ~v.isin(*self.values))
        return {self.field: out}, _shorter(get(self.field), out)


@dataclass(kw_only=True)
class KeepFirst(TransformerRule):
    """Keeps the first value alone."""

    type = "keep_first"
    field: str

    def rewrite(self, get: Get) -> Rewrite:
        return {self.field: F.slice(get(self.field), 1, 1)}, F.size(get(self.field)) > 1


@dataclass(kw_only=True)
class RemoveEmpty(TransformerRule):
    """Drops values of nothing but characters up to the space."""

    type = "remove_empty"
    field: str

    def rewrite(self, get: Get) -> Rewrite:
        out = F.filter(get(self.field), lambda v: ~v.rlike(r"\A[\x00-\x20]*\z"))
        return {self.field: out}, _shorter(get(self.field), out)


@dataclass(kw_only=True)
class BestOfVocabulary(TransformerRule):
    """Of the values in an ordered vocabulary the best-ranked one stays; others are not touched."""

    type = "best_of_vocabulary"
    field: str
    vocabulary: list[str]

    def rewrite(self, get: Get) -> Rewrite:
        occ = get(self.field)
        words = F.array(*map(F.lit, self.vocabulary))
        rank = lambda v: F.array_position(words, v)
        ranks = F.transform(occ, rank)
        best = F.array_min(F.filter(ranks, lambda r: r > 0))
        keep = F.array_position(ranks, F.coalesce(best, F.lit(0))) - 1
        out = F.filter(occ, lambda v, i: (rank(v) == 0) | (i == keep))
        return {self.field: out}, _shorter(occ, out)


@dataclass(kw_only=True)
class FirstOfPrefix(TransformerRule):
    """Of the values with a prefix the first stays."""

    type = "first_of_prefix"
    field: str
    prefix: str

    def rewrite(self, get: Get) -> Rewrite:
        occ = get(self.field)
        first = F.array_position(F.transform(occ, lambda v: v.startswith(self.prefix)), F.lit(True)) - 1
        out = F.filter(occ, lambda v, i: ~v.startswith(self.prefix) | (i == first))
        return {self.field: out}, _shorter(occ, out)


@dataclass(kw_only=True)
class AppendNames(TransformerRule):
    """Appends ``prefix + column`` to fields: where no value has the prefix, or in place of the last one that has.

    ``names`` lists [field, prefix, column]; the columns come from the network of the record.
    """

    type = "append_names"
    names: list[list[str]]
    replace: bool = False

    def rewrite(self, get: Get) -> Rewrite:
        now: dict[str, Column] = {}
        for name, prefix, column in self.names:
            occ = now.get(name, get(name))
            value = F.concat(F.lit(prefix), F.coalesce(F.col(column), F.lit("null")))
            has = F.transform(occ, lambda v: v.startswith(prefix))  # noqa: B023
            last = F.size(occ) + 1 - F.array_position(F.reverse(has), F.lit(True)).cast("int")
            instead = F.array_append(_without(occ, last), value) if self.replace else occ
            now[name] = F.when(F.array_contains(has, True), instead).otherwise(F.array_append(occ, value))
        return now, F.lit(bool(self.names))


# Fields that provenance writes, and the network attributes they come from.
PROVENANCE = {
    "repository:repositoryType": "source_type",
    "repository:repositoryURL": "source_url",
    "repository:institutionType": "institution_type",
    "repository:institutionURL": "institution_url",
    "repository:baseURL": "oai_url",
    "repository:mail": "contact_email",
    "repository:country": "country",
    "repository:DOI": "doi",
    "repository:ISSN": "issn",
    "repository:ISSN_L": "issn_l",
}
PROVENANCE_CLEARED = ("repository:name", "repository:mail", "others:identifier")


@dataclass(kw_only=True)
class AddProvenance(TransformerRule):
    """Writes the source of a record from the columns of its network: attributes, name, institution; and its datestamp."""

    type = "add_provenance"
    attributes: str = "attributes"
    network_name: str = "network_name"
    institution_name: str = "institution_name"
    identifier: str = "identifier"
    datestamp: str = "datestamp"

    def rewrite(self, get: Get) -> Rewrite:
        attribute = lambda key: F.coalesce(F.try_element_at(F.col(self.attributes), F.lit(key)), F.lit(""))
        text = lambda c: F.coalesce(F.col(c), F.lit("null"))
        values = {name: attribute(key) for name, key in PROVENANCE.items()} | {
            "others:identifier": F.col(self.identifier),
            "repository:repositoryID": F.concat(F.lit("opendoar:"), attribute("repository_id")),
            "repository:harvestDate": F.date_format(self.datestamp, "yyyy-MM-dd'T'HH:mm:ss"),
            "repository:name": F.concat(text(self.network_name), F.lit(" - "), text(self.institution_name)),
        }
        return {name: F.array(v) if name in PROVENANCE_CLEARED else F.array_append(get(name), v) for name, v in values.items()}, F.lit(True)


def transform(records: DataFrame, rules: list[TransformerRule], flag: str = "is_transformed") -> DataFrame:
    """Run the rules in their order, each on the result of the one before; ``flag`` tells whether any changed a record."""
    out = records if flag in records.columns else records.withColumn(flag, F.lit(False))
    for rule in sorted(rules, key=lambda r: r.run_order):
        columns, changed = rule.rewrite(lambda name, df=out: fields.field(df, name))
        out = out.withColumns({**columns, flag: F.col(flag) | F.coalesce(changed, F.lit(False))})
    return out


def transform_in_turn(records: DataFrame, primary: list[TransformerRule], secondary: list[TransformerRule], now: Column, datestamp: str = "datestamp", flag: str = "is_transformed") -> DataFrame:
    """The primary rules and then the secondary ones; a record that any of them changed has the datestamp ``now``."""
    out = transform(transform(records, primary, flag), secondary, flag)
    return out.withColumn(datestamp, F.when(F.col(flag), now).otherwise(F.col(datestamp)))


def translate_by_table(occurrences: DataFrame, dictionary: DataFrame, order: str | None = None) -> DataFrame:
    """Dictionaries of any size: occurrence rows with ``translated``, looked up without regard to case.

    Of keys that differ in case alone the last one counts, by the column ``order`` of the dictionary or else by the key.
    """
    last = F.struct(order, "key") if order else F.struct("key")
    keys = dictionary.groupBy(F.lower(F.upper("key")).alias("fold")).agg(F.max_by("value", last).alias("translated"))
    return occurrences.withColumn("fold", F.lower(F.upper("value"))).join(keys, "fold", "left").drop("fold")


def translate_by_prefix(occurrences: DataFrame, dictionary: DataFrame, small: int = SMALL_DICTIONARY) -> DataFrame:
    """Prefix dictionaries of any size: a row for each occurrence and key that its value begins with.

    For each length that keys have, the beginning of that length is looked up by an equi-join, so what the plan holds
    grows with the number of lengths and not with the keys. Beginnings are many times the occurrences, which estimates
    of their size do not show, so they are never broadcast: a dictionary of up to ``small`` bytes is, else both sides
    are shuffled. ``place`` is the key's place among those of its value, in the order in which the literal form appends
    them: without regard to case, then by the key itself.
    """
    bytes_ = F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0)) + KEY_BYTES
    by_length = dictionary.groupBy(F.length("key").alias("n")).agg(F.sum(bytes_).alias("bytes")).where("n IS NOT NULL").collect()  # as many as the longest key has letters
    lengths = sorted(r["n"] for r in by_length)
    keys = dictionary.groupBy("key").agg(F.max("value").alias("translated"))
    keys = F.broadcast(keys) if sum(r["bytes"] for r in by_length) <= small else keys.hint("merge")
    numbered = occurrences.withColumn("_occurrence", F.monotonically_increasing_id())
    cuts = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("value"))
    found = numbered.withColumn("_length", F.explode(cuts)).withColumn("key", F.substring(F.col("value"), F.lit(1), F.col("_length"))).join(keys, "key")
    place = F.row_number().over(Window.partitionBy("_occurrence").orderBy(F.lower("key"), "key")) - 1
    return found.withColumn("place", place).select(*occurrences.columns, "key", "translated", "place")
