"""Queries of validation and transformation rules."""

from __future__ import annotations

import socket

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions.expression import compile_expression
from colophon.model import QUANTIFIERS
from colophon.operators import fields
from colophon.operators import transformers as t
from colophon.operators import trees
from colophon.operators import validators as v
from colophon.plans.adapters import LINE_RECORDS, TALK_RECORDS, line_records, talk_records
from colophon.plans.registry import query, table

# ---- validators: one boolean for each quantifier ----


def _all_quantifiers(records: DataFrame, make) -> DataFrame:
    get = lambda name: fields.field(records, name)
    return records.select("record_id", *[make(q).verdict(get).alias(q.lower()) for q in QUANTIFIERS])


def _quantifier_sql(with_: str, field: str, predicate: str) -> str:
    return f"""WITH {with_}, n AS (SELECT record_id, len({field}) AS n, len(list_filter({field}, lambda x: {predicate})) AS v FROM r)
SELECT record_id, v = 1 AS one_only, v >= 1 AS one_or_more, n = 0 OR v > 0 AS zero_or_more, v = 0 AS zero_only, v = n AS "all" FROM n"""


@query(_quantifier_sql(TALK_RECORDS, '"user"', "length(x) BETWEEN 40 AND 200"))
def v_length_quant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_quantifiers(talk_records(spark, sf_dir), lambda q: v.ContentLength(field="user", min_length=40, max_length=200, quantifier=q))


@query(_quantifier_sql(LINE_RECORDS, "flags", "x IN ('RF', 'NO')"))
def v_controlled_quant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_quantifiers(line_records(spark, sf_dir), lambda q: v.ControlledValue(field="flags", values=["RF", "NO"], quantifier=q))


@query(_quantifier_sql(LINE_RECORDS, "flags", "x IN ('RF', 'NF', 'AF')"))
def v_large_controlled_quant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_quantifiers(line_records(spark, sf_dir), lambda q: v.LargeControlledValue(field="flags", values=["RF"], values_text="NF;AF", quantifier=q))


@query(_quantifier_sql(LINE_RECORDS, "sizes", "regexp_full_match(x, '[1-4]?[05]')"))
def v_regex_quant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_quantifiers(line_records(spark, sf_dir), lambda q: v.Regex(field="sizes", pattern="[1-4]?[05]", quantifier=q))


@query("SELECT o_orderkey AS record_id, year(o_orderdate) BETWEEN 1994 AND 1997 AS valid FROM orders")
def v_year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.array(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))
    rule = v.YearRange(field="date", lower=2, upper=1, current_year=1996)
    return orders.select("record_id", rule.verdict(lambda name: F.col(name)).alias("valid"))


@query("SELECT page_id AS record_id, regexp_matches(url, '^[a-z]+://[^/ ]+') AS valid FROM pages")
def v_url_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("record_id"), F.array("url").alias("url"))
    return pages.select("record_id", v.UrlSyntax(field="url").verdict(lambda name: F.col(name)).alias("valid"))


def _opened(url: str) -> tuple[int, str | None]:
    """What a web of its own rule answers, by the length of the URL: found, absent, elsewhere, or no such host."""
    if len(url) % 4 == 3:
        raise socket.gaierror("no such host")
    return {0: (404, None), 1: (200, None), 2: (302, url + "abc")}[len(url) % 4]


@query("SELECT page_id AS record_id, CASE WHEN url IS NULL THEN 'NULL' WHEN NOT contains(url, '://') THEN 'MalformedURL' WHEN length(url) % 4 = 0 THEN 'ERROR' WHEN length(url) % 4 = 3 THEN 'UnknownHost' ELSE 'OK' END AS url_status FROM pages")
def v_url_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("record_id"), "url")
    return v.check_urls_by_host(pages, "url", _opened, per_second=1e9).select("record_id", "url_status")


def _xml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line flags as record trees."""
    values = F.array_join(F.transform("flags", lambda x: F.concat(F.lit('<field name="value">'), x, F.lit("</field>"))), "")
    xml = F.concat(F.lit('<metadata><element name="dc"><element name="type"><element name="none">'), values, F.lit("</element></element></element></metadata>"))
    return line_records(spark, sf_dir).select("record_id", xml.alias("xml"))


@query(f"WITH {LINE_RECORDS}, n AS (SELECT record_id, len(flags) AS n FROM r) SELECT record_id, n = 1 AS one_only, n >= 1 AS one_or_more, true AS zero_or_more, n = 0 AS zero_only, n > 0 AS \"all\" FROM n")
def v_node_occurs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = "//*[local-name()='element' and @name='none']/*[local-name()='field']"
    return _all_quantifiers(_xml_records(spark, sf_dir), lambda q: v.NodeOccurs(xpath=path, quantifier=q))


@query(f"WITH {LINE_RECORDS} SELECT record_id, array_to_string(flags, '|') AS none_level, '' AS upper_level, array_to_string(flags, '|') AS any_level FROM r")
def x_field_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fields.records_from_xml(_xml_records(spark, sf_dir), "xml", {"a": "dc.type.none", "b": "dc.type", "c": "dc.*"})
    return out.select("record_id", F.array_join("a", "|").alias("none_level"), F.array_join("b", "|").alias("upper_level"), F.array_join("c", "|").alias("any_level"))


EXPRESSIONS = {
    "either": "(flags=='RF' AND sizes=%'[0-9]') OR flags=='NO'",
    "neither": "NOT (flags=='RF' OR flags=='AF')",
    "broken": "flags=='RF' AND",
}


@query(f"""WITH {LINE_RECORDS} SELECT record_id, (list_contains(flags, 'RF') AND len(list_filter(sizes, lambda x: regexp_full_match(x, '[0-9]'))) > 0) OR list_contains(flags, 'NO') AS either,
NOT (list_contains(flags, 'RF') OR list_contains(flags, 'AF')) AS neither, false AS broken FROM r""")
def v_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = line_records(spark, sf_dir)
    return records.select("record_id", *[compile_expression(e, lambda name: F.col(name)).alias(k) for k, e in EXPRESSIONS.items()])


@query("""SELECT doc_id AS record_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT doc_id, CASE WHEN lang IN ('fr', 'de') THEN 0 ELSE 2 END + CASE WHEN source LIKE '%1%' THEN 1 ELSE 0 END AS n FROM documents) GROUP BY doc_id""")
def v_expression_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many atoms of an expression found no occurrence of their field."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.array_compact(F.array(F.when(F.col("lang").isin("fr", "de"), F.col("lang")))).alias("lang"), F.array_compact(F.array(F.when(~F.col("source").like("%1%"), F.col("source")))).alias("source"))
    rule = v.FieldExpression(rule_id=1, expression="(lang=='fr' OR lang=='de') AND NOT source=='src2'", store_occurrences=True)
    found = v.validate(docs, [rule], details=True)
    return found.select("record_id", F.size(F.filter("details", lambda d: d["value"] == v.NO_OCCURRENCES)).alias("n")).groupBy("record_id").agg(F.sum("n").alias("n"))


@query(f"""WITH {LINE_RECORDS}, n AS (SELECT record_id, len(flags) AS n, len(list_filter(flags, lambda x: x = 'RF')) AS v FROM r)
SELECT record_id, v = 1 AS one_only, v >= 1 AS one_or_more, true AS zero_or_more, v = 0 AS zero_only, v = n AS "all" FROM n""")
def v_expression_quant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_quantifiers(line_records(spark, sf_dir), lambda q: v.FieldExpression(expression="flags=='RF'", quantifier=q))


@query("""SELECT l_orderkey AS record_id, count(*) AS n, CAST(count(*) FILTER (WHERE p_brand IS NOT NULL) AS BIGINT) AS n_valid
FROM lineitem LEFT JOIN (SELECT p_partkey, p_brand FROM part WHERE p_size <= 10) ON l_partkey = p_partkey GROUP BY l_orderkey""")
def v_controlled_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    occurrences = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("value"))
    vocabulary = table(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").alias("value"))
    return v.mark_controlled(occurrences, vocabulary).groupBy("record_id").agg(F.count("*").alias("n"), F.count_if("is_valid").alias("n_valid"))


# ---- transformers ----


def _shown(rule: t.TransformerRule | list[t.TransformerRule], *names: str):
    """The records after rules: the named fields joined by ``|``, and the flag."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = t.transform(line_records(spark, sf_dir), rule if isinstance(rule, list) else [rule])
        return out.select("record_id", *[F.array_join(n, "|").alias(n) for n in names], "is_transformed")

    return run


def _register(name: str, sql: str, rule, *names: str) -> None:
    run = _shown(rule, *names)
    run.__name__ = name
    query(f"WITH {LINE_RECORDS} {sql}")(run)


def _sql(changed: str, **shown: str) -> str:
    return "SELECT record_id, " + ", ".join(f"array_to_string({e}, '|') AS {c}" for c, e in shown.items()) + f", {changed} AS is_transformed FROM r"


_register("t_add", _sql("true", flags="list_append(flags, 'XX')"), t.AddField(field="flags", value="XX"), "flags")
_register("t_dedup", _sql("len(list_distinct(flags)) <> len(flags)", flags="list_filter(flags, lambda x, i: list_position(flags, x) = i)"), t.RemoveDuplicates(field="flags"), "flags")
_register("t_first", _sql("len(flags) > 1", flags="flags[1:1]"), t.KeepFirst(field="flags"), "flags")
_register("t_blacklist", _sql("list_has_any(flags, ['RF', 'AF'])", flags="list_filter(flags, lambda x: x NOT IN ('RF', 'AF'))"), t.RemoveBlacklisted(field="flags", values=["RF", "AF"]), "flags")
_register("t_rename", _sql("len(flags) > 0", flags="[]::VARCHAR[]", sizes="list_concat(sizes, flags)"), t.Rename(source="flags", target="sizes"), "flags", "sizes")
_register("t_bulk_rename", _sql("len(flags) > 0", flags="[]::VARCHAR[]", sizes="[]::VARCHAR[]", kept="list_concat(sizes, flags)"), t.BulkRename(pairs=[["flags", "sizes"], ["sizes", "kept"]]), "flags", "sizes", "kept")
_register("t_reduce", _sql("len(sizes) > 0", flags="flags", sizes="[]::VARCHAR[]"), t.ReduceHeavy(fields=["sizes", "absent"]), "flags", "sizes")
_register("t_normalize", _sql("len(list_distinct(list_filter(flags, lambda x: x IN ('RF', 'NO')))) <> len(flags)", flags="list_filter(flags, lambda x, i: x IN ('RF', 'NO') AND list_position(flags, x) = i)"), t.Normalize(field="flags", validator=v.ControlledValue(values=["RF", "NO"])), "flags")
_register("t_conditional_add", _sql("list_contains(flags, 'RF') AND NOT list_contains(flags, 'NO')", flags="list_filter(CASE WHEN list_contains(flags, 'RF') AND NOT list_contains(flags, 'NO') THEN list_append(flags, 'ZZ') ELSE flags END, lambda x, i: list_position(CASE WHEN list_contains(flags, 'RF') AND NOT list_contains(flags, 'NO') THEN list_append(flags, 'ZZ') ELSE flags END, x) = i)"), t.ConditionalAdd(field="flags", value="ZZ", expression="flags=='RF' AND NOT flags=='NO'", remove_duplicates=True), "flags")
_VOCABULARY = ["AF", "RF", "NF"]
_RANKS = "list_transform(flags, lambda x: coalesce(list_position(['AF', 'RF', 'NF'], x), 0))"
_BEST = f"list_position({_RANKS}, list_min(list_filter({_RANKS}, lambda k: k > 0)))"
_register("t_vocab", _sql("len(list_filter(flags, lambda x: x IN ('AF', 'RF', 'NF'))) > 1", flags=f"list_filter(flags, lambda x, i: x NOT IN ('AF', 'RF', 'NF') OR i = {_BEST})"), t.BestOfVocabulary(field="flags", vocabulary=_VOCABULARY), "flags")
_register("t_prefix_dedup", _sql("len(list_filter(flags, lambda x: starts_with(x, 'N'))) > 1", flags="list_filter(flags, lambda x, i: NOT starts_with(x, 'N') OR i = list_position(list_transform(flags, lambda y: starts_with(y, 'N')), true))"), t.FirstOfPrefix(field="flags", prefix="N"), "flags")

_TARGET = "list_transform(flags, lambda x: CASE lower(x) WHEN 'rf' THEN 'X' WHEN 'no' THEN 'Y' WHEN 'af' THEN 'NF' ELSE '' END)"
_HIT = f"({_TARGET}[i] <> '' AND NOT list_contains(flags, {_TARGET}[i]) AND list_position({_TARGET}, {_TARGET}[i]) = i)"
_ADDED = f"list_filter({_TARGET}, lambda y, i: {_HIT})"
_register("t_translate", _sql(f"len({_ADDED}) > 0", flags=f"list_concat(list_filter(flags, lambda x, i: NOT {_HIT}), {_ADDED})"), t.Translate(test_field="flags", write_field="flags", dictionary={"rf": "X", "No": "Y", "AF": "NF"}), "flags")
_register("t_translate_prefix", _sql("len(list_filter(flags, lambda x: starts_with(x, 'N'))) > 0", flags="flags", sizes="list_concat(sizes, list_concat(list_transform(list_filter(flags, lambda x: starts_with(x, 'N')), lambda x: CASE WHEN x = 'NO' THEN 'n|no' ELSE 'n' END), []::VARCHAR[]))"), t.Translate(test_field="flags", write_field="sizes", dictionary={"N": "n", "NO": "no"}, as_prefix=True, replace=False), "flags", "sizes")

_FIRST = "list_transform(sizes, lambda x: regexp_replace(x, '([0-9])0', '\\1-'))"
_NEW = f"(NOT list_contains(sizes, {_FIRST}[i]) AND list_position({_FIRST}, {_FIRST}[i]) = i)"
_register("t_regex_first", _sql(f"len(list_filter({_FIRST}, lambda y, i: {_NEW})) > 0", sizes=f"list_concat(list_filter(sizes, lambda x, i: NOT {_NEW}), list_filter({_FIRST}, lambda y, i: {_NEW}))"), t.RegexTranslate(source="sizes", target="sizes", pattern="([0-9])0", replacement="$1-"), "sizes")


def _priority_sql(pairs: list[list[str]]) -> str:
    """Each translation as a step of its own."""
    steps, now = ["p0 AS (SELECT record_id, flags AS l, flags AS seen, false AS changed FROM r)"], "p0"
    for n, (a, b) in enumerate(pairs, 1):
        hit = f"(list_contains(l, '{a}') AND NOT list_contains(seen, '{b}'))"
        steps.append(f"p{n} AS (SELECT record_id, CASE WHEN {hit} THEN list_append(list_filter(l, lambda x, i: i <> list_position(l, '{a}')), '{b}') ELSE l END AS l, CASE WHEN {hit} THEN list_append(seen, '{b}') ELSE seen END AS seen, changed OR {hit} AS changed FROM {now})")
        now = f"p{n}"
    return f", {', '.join(steps)} SELECT record_id, array_to_string(l, '|') AS flags, changed AS is_transformed FROM {now}"


_PAIRS = [["RF", "Q"], ["AF", "Q"], ["Q", "Z"], ["NO", "NF"]]
_register("t_priority", _priority_sql(_PAIRS), t.PriorityTranslate(test_field="flags", write_field="flags", translations=_PAIRS), "flags")
_register("t_conditional_rename", _sql("len(list_filter(sizes, lambda x: regexp_full_match(x, '[0-9]'))) > 0", flags="list_concat(flags, list_filter(sizes, lambda x: regexp_full_match(x, '[0-9]')))", sizes="list_filter(sizes, lambda x: NOT regexp_full_match(x, '[0-9]'))"), t.ConditionalRename(source="sizes", target="flags", pattern="[0-9]"), "flags", "sizes")


def _text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.split(F.col("text"), "\n").alias("lines"))


@query("SELECT doc_id AS record_id, md5(array_to_string(list_transform(string_split(\"text\", chr(10)), lambda x: regexp_replace(x, '\\s', '', 'g')), '|')) AS lines, regexp_matches(replace(\"text\", chr(10), ''), '\\s') AS is_transformed FROM documents")
def t_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = t.transform(_text_records(spark, sf_dir), [t.RemoveWhitespace(field="lines")])
    return out.select("record_id", F.md5(F.array_join("lines", "|")).alias("lines"), "is_transformed")


@query("SELECT doc_id AS record_id, md5(array_to_string(list_filter(string_split(\"text\", chr(10)), lambda x: trim(x) <> ''), '|')) AS lines, len(list_filter(string_split(\"text\", chr(10)), lambda x: trim(x) = '')) > 0 AS is_transformed FROM documents")
def t_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = t.transform(_text_records(spark, sf_dir), [t.RemoveEmpty(field="lines")])
    return out.select("record_id", F.md5(F.array_join("lines", "|")).alias("lines"), "is_transformed")


@query("SELECT doc_id AS record_id, 'id:' || source || ':' || doc_id AS identifier, true AS is_transformed FROM documents")
def t_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.concat_ws(":", F.lit("oai"), "source", F.col("doc_id").cast("string")).alias("identifier"))
    return t.transform(docs, [t.IdentifierRegex(pattern="^oai:", replacement="id:")])


def _networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records of their nation's network."""
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    attributes = F.create_map(F.lit("country"), F.col("n_name"), F.lit("source_type"), F.col("r_name"), F.lit("repository_id"), F.col("n_nationkey").cast("string"))
    dims = F.broadcast(n.join(r, n["n_regionkey"] == r["r_regionkey"])).select("n_nationkey", F.col("n_name").alias("network_name"), F.col("r_name").alias("institution_name"), attributes.alias("attributes"))  # 25 nations
    return c.join(dims, c["c_nationkey"] == dims["n_nationkey"]).select(F.col("c_custkey").alias("record_id"), F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("identifier"), F.lit("2020-01-01 00:00:00").cast("timestamp").alias("datestamp"), "network_name", "institution_name", "attributes", F.array(F.concat(F.lit("reponame:"), "c_name"), F.lit("x")).alias("source"))


_NETWORKS = "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(f"SELECT c_custkey AS record_id, 'x|reponame:' || n_name || '|instname:' || r_name AS replaced, 'reponame:' || c_name || '|x|instname:' || r_name AS kept {_NETWORKS}")
def t_append_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [["source", "reponame:", "network_name"], ["source", "instname:", "institution_name"]]
    records = _networks(spark, sf_dir)
    show = lambda replace: t.AppendNames(names=names, replace=replace).rewrite(lambda name: F.col(name))[0]["source"]
    return records.select("record_id", F.array_join(show(True), "|").alias("replaced"), F.array_join(show(False), "|").alias("kept"))


@query(f"SELECT c_custkey AS record_id, n_name || ' - ' || r_name AS name, 'opendoar:' || n_nationkey AS repository_id, n_name AS country, '' AS doi, 'c:' || c_custkey AS identifier, '2020-01-01T00:00:00' AS harvested {_NETWORKS}")
def t_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = t.transform(_networks(spark, sf_dir), [t.AddProvenance()])
    one = lambda c: F.array_join(F.col(f"`{c}`"), "|")
    return out.select("record_id", one("repository:name").alias("name"), one("repository:repositoryID").alias("repository_id"), one("repository:country").alias("country"), one("repository:DOI").alias("doi"), one("others:identifier").alias("identifier"), one("repository:harvestDate").alias("harvested"))


@query("""SELECT l_orderkey AS record_id, count(*) AS n, CAST(count(t) AS BIGINT) AS n_translated, max(t) AS last_translated
FROM (SELECT l_orderkey, l_shipmode_t AS t FROM (SELECT l_orderkey, p_type AS l_shipmode_t FROM lineitem LEFT JOIN (SELECT p_partkey, p_type FROM part WHERE p_size > 25) ON l_partkey = p_partkey)) GROUP BY l_orderkey""")
def t_translate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    occurrences = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("value"))
    dictionary = table(spark, sf_dir, "part").where("p_size > 25").select(F.concat(F.lit("PART "), F.col("p_partkey").cast("string")).alias("key"), F.col("p_type").alias("value"))
    out = t.translate_by_table(occurrences, dictionary)
    return out.groupBy("record_id").agg(F.count("*").alias("n"), F.count("translated").alias("n_translated"), F.max("translated").alias("last_translated"))


@query(f"""WITH {LINE_RECORDS} SELECT record_id, array_to_string(list_transform(flags, lambda x: CASE x WHEN 'RF' THEN 'Z' ELSE x END), '|') AS flags, CASE WHEN list_contains(flags, 'RF') THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2020-01-01' END AS datestamp, list_contains(flags, 'RF') AS is_transformed
FROM (SELECT record_id, list_filter(flags, lambda x, i: x <> 'RF' OR list_position(flags, x) = i) AS kept, flags FROM r) WHERE len(list_filter(flags, lambda x: x = 'RF')) <= 1 AND (NOT list_contains(flags, 'RF') OR flags[-1] = 'RF')""")
def t_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A primary and a secondary transformer: RF to Y and Y to Z; the datestamp is renewed where either changed a record. Records whose one RF stands last, or without any."""
    records = line_records(spark, sf_dir).withColumn("datestamp", F.lit("2020-01-01").cast("timestamp_ntz"))
    shown = records.where("size(filter(flags, x -> x = 'RF')) = 0 OR (size(filter(flags, x -> x = 'RF')) = 1 AND element_at(flags, -1) = 'RF')")
    step = lambda a, b: [t.Translate(test_field="flags", write_field="flags", dictionary={a: b})]
    out = t.transform_in_turn(shown, step("RF", "Y"), step("Y", "Z"), F.lit("2024-01-01").cast("timestamp_ntz"))
    return out.select("record_id", F.array_join("flags", "|").alias("flags"), "datestamp", "is_transformed")


@query(f"WITH {LINE_RECORDS} SELECT record_id, 'flags' AS field, unnest(range(len(flags)))::INTEGER AS pos, unnest(flags) AS value FROM r")
def d_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to occurrence rows and back to records and rows again."""
    rows = fields.occurrences_from_records(line_records(spark, sf_dir), ["flags"])
    return fields.occurrences_from_records(fields.records_from_occurrences(rows, ["flags"]), ["flags"])


_LINES = "l AS (SELECT l_orderkey AS record_id, l_linenumber AS n, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS size, l_returnflag AS flag FROM lineitem)"


def _line_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as record trees: an element for each line, with a value and a flag."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("record_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").cast("string").alias("size"), "l_returnflag"))).alias("lines"))
    element = lambda s: F.concat(F.lit('<element name="line"><field name="value">'), s["size"], F.lit('</field><field name="flag">'), s["l_returnflag"], F.lit("</field></element>"))
    xml = F.concat(F.lit('<metadata><element name="order">'), F.array_join(F.transform("lines", element), ""), F.lit("</element></metadata>"))
    return trees.nodes(lines.select("record_id", xml.alias("xml")), "xml")


@query(f"""WITH {_LINES} SELECT record_id, 'order.line' AS field, CAST(row_number() OVER (PARTITION BY record_id ORDER BY n, size, flag) - 1 AS INTEGER) AS pos, size AS value FROM l WHERE flag <> 'R'
UNION ALL SELECT record_id, 'order.returned', CAST(row_number() OVER (PARTITION BY record_id ORDER BY n, size, flag) - 1 AS INTEGER), size FROM l WHERE flag = 'R'
UNION ALL SELECT record_id, 'order.line:flag', CAST(row_number() OVER (PARTITION BY record_id ORDER BY n, size, flag) - 1 AS INTEGER), flag FROM l""")
def t_rename_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of lines whose flag, a sibling node, is R become values of another field."""
    tree = trees.with_sibling(_line_tree(spark, sf_dir), "flag", "flag")
    return trees.fields(trees.rename(tree, trees.at("order.line") & (F.col("flag") == "R"), "order.returned"))


@query(f"WITH {_LINES} SELECT record_id, first(size ORDER BY n, size, flag) AS value FROM l WHERE flag = 'R' GROUP BY record_id")
def x_look_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the first line whose flag is R."""
    return trees.look_up(_line_tree(spark, sf_dir), "order.line", "flag", "R", "value")


@query("""WITH k AS (SELECT DISTINCT left(p_name, 1 + (p_partkey % 9)::INTEGER) AS key FROM part), o AS (SELECT p_partkey AS record_id, p_name AS value FROM part)
SELECT record_id, key, upper(key) AS translated, CAST(row_number() OVER (PARTITION BY record_id ORDER BY lower(key), key) - 1 AS INTEGER) AS place FROM o JOIN k ON starts_with(value, key)""")
def t_translate_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of beginnings of part names, looked up in all part names."""
    parts = table(spark, sf_dir, "part")
    keys = parts.select(F.substring(F.col("p_name"), F.lit(1), (F.col("p_partkey") % 9 + 1).cast("int")).alias("key")).distinct()
    return t.translate_by_prefix(parts.select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("value")), keys.withColumn("value", F.upper("key"))).drop("value")
