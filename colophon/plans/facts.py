"""Queries of validation facts: counts, facets, statistics, pages, observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.operators import contains, counters
from colophon.operators import facts as f
from colophon.operators import stats as s
from colophon.plans.adapters import DOC_FACTS, RULES, doc_facts, stored_facts
from colophon.plans.registry import query, table
from colophon.shipping import scratch

IDS = [1, 2, 3, 4]
_RULE_COUNTS = ", ".join(f"count(*) FILTER (WHERE rule_{i}) AS valid_{i}, count(*) FILTER (WHERE NOT rule_{i}) AS invalid_{i}" for i in IDS)
_COUNTS = f"SELECT count(*) AS total, count(*) FILTER (WHERE is_valid) AS valid, count(*) FILTER (WHERE is_transformed) AS transformed, {_RULE_COUNTS} FROM f"
#: A filter of each kind, one unknown field and one without a separator.
FILTERS = ["is_valid@@true", 'valid_rules@@"2"', "invalid_rules@@3", "identifier:SRC1", "colour@@red", "nothing"]
_FILTERED = "is_valid AND rule_2 AND NOT rule_3 AND identifier ILIKE '%SRC1%'"


@query(f"WITH {DOC_FACTS} SELECT identifier_hash, rule_1, rule_2, rule_3, rule_4, is_valid, is_transformed FROM f")
def v_record_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_facts(spark, sf_dir).select("identifier_hash", *[f"rule_{i}" for i in IDS], "is_valid", "is_transformed")


@query(f"WITH {DOC_FACTS} {_COUNTS}")
def r_multi_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.counts(stored_facts(spark, sf_dir))


@query(f"WITH {DOC_FACTS} {_COUNTS} WHERE {_FILTERED}")
def r_filtered_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.counts(stored_facts(spark, sf_dir), FILTERS)


@query(f"WITH {DOC_FACTS} {_COUNTS} WHERE false")
def r_empty_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.counts(stored_facts(spark, sf_dir), ["identifier@@no such identifier"])


_FACETS = f"""c AS ({{counts}}), u AS (
  SELECT 'record_is_valid' AS facet, 'true' AS value, valid AS count FROM c UNION ALL SELECT 'record_is_valid', 'false', total - valid FROM c
  UNION ALL SELECT 'record_is_transformed', 'true', transformed FROM c UNION ALL SELECT 'record_is_transformed', 'false', total - transformed FROM c
  {' '.join(f"UNION ALL SELECT 'valid_rules', '{i}', valid_{i} FROM c UNION ALL SELECT 'invalid_rules', '{i}', invalid_{i} FROM c" for i in IDS)}
)"""


@query(f"WITH {DOC_FACTS}, {_FACETS.format(counts=_COUNTS)} SELECT facet, value, count FROM u WHERE count > 0")
def r_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.facets(stored_facts(spark, sf_dir))


@query(f"WITH {DOC_FACTS}, {_FACETS.format(counts=_COUNTS + ' WHERE ' + _FILTERED)} SELECT facet, value, count FROM u WHERE count > 0 OR facet LIKE 'record%'")
def r_filtered_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.facets(stored_facts(spark, sf_dir), FILTERS)


_NAMES = ", ".join(f"({r.rule_id}, '{r.name}', '{r.quantifier}', {str(r.mandatory).lower()})" for r in RULES) + ", (9, 'unused', 'ALL', false)"


@query(f"""WITH {DOC_FACTS}, c AS ({_COUNTS} WHERE {_FILTERED}), k AS ({' UNION ALL '.join(f'SELECT {i} AS rule_id, valid_{i} AS valid, invalid_{i} AS invalid FROM c' for i in IDS)})
SELECT CAST(d.rule_id AS BIGINT) AS rule_id, d.name, d.quantifier, d.mandatory, coalesce(k.valid, 0) AS valid, k.invalid FROM (VALUES {_NAMES}) d(rule_id, name, quantifier, mandatory) LEFT JOIN k USING (rule_id)""")
def r_rule_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    definitions = f.rule_definitions(spark, [*RULES, type(RULES[1])(rule_id=9, name="unused", quantifier="ALL")])
    return s.rule_statistics(stored_facts(spark, sf_dir), definitions, FILTERS).select("rule_id", "name", "quantifier", "mandatory", "valid", "invalid")


_OCCURRENCES = "o AS (SELECT identifier_hash, CAST(3 AS BIGINT) AS rule_id, rule_3 AS is_valid, source AS occurrence_value FROM v UNION ALL SELECT identifier_hash, CAST(2 AS BIGINT), rule_2, CASE lang WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' ELSE lang END FROM v UNION ALL SELECT identifier_hash, CAST(4 AS BIGINT), x = '1', x FROM (SELECT identifier_hash, unnest(CASE WHEN q.quality IS NULL THEN ['no_occurrences_found'] ELSE q.quality END) AS x FROM v LEFT JOIN q ON v.doc_id = q.doc_id))"


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.rule_occurrences(stored_facts(spark, sf_dir, details=True))


@query(f"WITH {DOC_FACTS}, {_OCCURRENCES} SELECT * FROM o")
def v_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occurrences(spark, sf_dir)


@query(f"WITH {DOC_FACTS}, {_OCCURRENCES} SELECT is_valid, occurrence_value, count(*) AS n FROM o WHERE rule_id = 3 GROUP BY ALL")
def r_occ_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.occurrence_counts(_occurrences(spark, sf_dir), 3)


@query(f"WITH {DOC_FACTS}, {_OCCURRENCES} SELECT is_valid, occurrence_value, count(*) AS n FROM o WHERE rule_id = 4 AND NOT is_valid GROUP BY ALL")
def r_occ_counts_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.occurrence_counts(_occurrences(spark, sf_dir), 4, is_valid=False)


_ALL_COUNTERS = f"""p AS ({' UNION ALL '.join([
    "SELECT 'total' AS facet, '' AS value FROM g", "SELECT 'record_is_valid', CAST(is_valid AS VARCHAR) FROM g", "SELECT 'record_is_transformed', CAST(is_transformed AS VARCHAR) FROM g",
    *[f"SELECT CASE WHEN rule_{i} THEN 'valid_rules' ELSE 'invalid_rules' END, '{i}' FROM g" for i in IDS],
    "SELECT CASE WHEN is_valid THEN 'valid_occurrences:' ELSE 'invalid_occurrences:' END || rule_id, occurrence_value FROM o WHERE identifier_hash IN (SELECT identifier_hash FROM g)"])}) SELECT facet, value, count(*) AS count FROM p GROUP BY ALL"""


@query(f"WITH {DOC_FACTS}, {_OCCURRENCES}, g AS (SELECT * FROM f WHERE doc_id % 11 <> 0), {_ALL_COUNTERS}")
def a_counters_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a snapshot from those of the one before: inserted, changed and deleted records."""
    facts = stored_facts(spark, sf_dir, details=True).withColumn("doc_id", F.element_at(F.split("identifier", ":"), -1).cast("long"))
    now = facts.where("doc_id % 11 <> 0")
    # Before: every fifth document is not there yet, every seventh was not transformed and failed two rules, every eleventh is still there.
    was = facts.where("doc_id % 5 <> 0")
    bad = F.col("doc_id") % 7 == 0
    was = was.withColumns({"is_transformed": F.col("is_transformed") & ~bad, "is_valid": F.col("is_valid") & ~bad, "rule_1": F.col("rule_1") & ~bad, "rule_3": F.col("rule_3") & ~bad})
    was = was.withColumn("details", F.when(bad, F.transform("details", lambda d: d.withField("is_valid", F.lit(False)))).otherwise(F.col("details")))
    touched = facts.where("doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0").select("identifier_hash")
    before, after = (counters.of_changed(rows, touched) for rows in (was, now))
    kept = counters.counted(was, f.rule_occurrences(was))
    return counters.moved(kept, before, after, f.rule_occurrences(before), f.rule_occurrences(after))


@query(f"WITH {DOC_FACTS} SELECT identifier, is_valid FROM f WHERE rule_2 ORDER BY identifier LIMIT 20 OFFSET 40")
def r_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.page(stored_facts(spark, sf_dir), 2, 20, filters=["valid_rules@@2"]).select("identifier", "is_valid")


@query(f"WITH {DOC_FACTS} SELECT identifier, is_valid FROM f WHERE identifier > 'oai:src1' AND is_valid ORDER BY identifier LIMIT 25")
def r_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.next_page(stored_facts(spark, sf_dir), "identifier", "oai:src1", 25, F.col("is_valid")).select("identifier", "is_valid")


@query(f"WITH {DOC_FACTS} SELECT identifier_hash, is_valid FROM f WHERE identifier = (SELECT max(identifier) FROM f WHERE doc_id = 5)")
def r_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "documents").where("doc_id = 5").select("source")
    wanted = source.select(F.concat_ws(":", F.lit("oai"), "source", F.lit("5")).alias("identifier"))
    return stored_facts(spark, sf_dir).join(F.broadcast(wanted), "identifier", "left_semi").select("identifier_hash", "is_valid")  # one row


@query(f"WITH {DOC_FACTS} SELECT identifier_hash, array_to_string(list_filter(['1', '2', '3', '4'], lambda x, i: [rule_1, rule_2, rule_3, rule_4][i]), ',') AS valid_rules, array_to_string(list_filter(['1', '2', '3', '4'], lambda x, i: NOT [rule_1, rule_2, rule_3, rule_4][i]), ',') AS invalid_rules, CAST(NULL AS VARCHAR) AS set_spec, 'N1' AS network_acronym FROM f")
def f_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f.observations(stored_facts(spark, sf_dir), {"network_acronym": "N1"})
    return out.select("identifier_hash", F.array_join("valid_rules", ",").alias("valid_rules"), F.array_join("invalid_rules", ",").alias("invalid_rules"), "set_spec", "network_acronym")


@query(f"""WITH {DOC_FACTS}, {_OCCURRENCES}, l AS (SELECT identifier_hash, unnest([1, 2, 3, 4])::BIGINT AS rule_id, unnest([rule_1, rule_2, rule_3, rule_4]) AS rule_is_valid FROM f),
g AS (SELECT identifier_hash, rule_id, string_agg(occurrence_value, ',' ORDER BY occurrence_value) FILTER (WHERE is_valid) AS a, string_agg(occurrence_value, ',' ORDER BY occurrence_value) FILTER (WHERE NOT is_valid) AS b FROM o GROUP BY ALL)
SELECT identifier_hash, rule_id, rule_is_valid, coalesce(a, '') AS valid_values, coalesce(b, '') AS invalid_values FROM l LEFT JOIN g USING (identifier_hash, rule_id)""")
def f_record_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f.facts_of_records(stored_facts(spark, sf_dir), _occurrences(spark, sf_dir))
    return out.select("identifier_hash", "rule_id", "rule_is_valid", F.array_join("valid_values", ",").alias("valid_values"), F.array_join("invalid_values", ",").alias("invalid_values"))


@query(f"""WITH {DOC_FACTS}, {_OCCURRENCES} SELECT o.identifier_hash AS id, f.identifier, 1 AS snapshot_id, 'http://o' AS origin, 'N1' AS network, 'R' AS repository, 'I' AS institution, o.rule_id, o.occurrence_value AS value,
o.is_valid, f.is_valid AS record_is_valid, f.is_transformed, 'oai_dc' AS metadata_prefix, 'all' AS set_spec FROM o JOIN f USING (identifier_hash)""")
def d_fact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = spark.createDataFrame([(1, "http://o", "N1", "R", "I", "oai_dc", "all")], "snapshot_id int, origin string, network string, repository string, institution string, metadata_prefix string, set_spec string")
    return f.fact_table(stored_facts(spark, sf_dir), _occurrences(spark, sf_dir), dims)


@query(f"""WITH {DOC_FACTS} SELECT 'N1_' || identifier_hash AS id, identifier, 'N1' AS network, len(e.embedding) AS dimensions, CAST(e.embedding[1] AS DOUBLE) AS first
FROM f LEFT JOIN embeddings e ON e.vec_id = f.doc_id AND e.vec_id % 3 <> 0 WHERE is_valid""")
def k_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid documents with their vectors; every third vector is of another dimension and counts as absent."""
    facts = stored_facts(spark, sf_dir)
    of = facts.select("identifier_hash", F.element_at(F.split("identifier", ":"), -1).cast("long").alias("vec_id"))
    cut = F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", cut.alias("embedding")).join(of, "vec_id").select("identifier_hash", "embedding")
    out = f.index_documents(facts, vectors, "N1", 64)
    return out.select("id", "identifier", "network", F.when(F.col("vector").isNotNull(), F.size("vector")).cast("long").alias("dimensions"), F.get("vector", F.lit(0)).cast("double").alias("first"))


@query(f"WITH {DOC_FACTS} SELECT identifier_hash, identifier, is_valid, is_transformed FROM f WHERE is_valid AND lang IN ('en', 'de') AND source IN ('src0', 'src7', 'src12')")
def f_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f.to_index(stored_facts(spark, sf_dir), content={"lang": ["en", "deu"], "source": ["src0", "src7", "src12"]})
    return f.index_columns(out).select("identifier_hash", "identifier", "is_valid", "is_transformed")


@query(f"WITH {DOC_FACTS} SELECT identifier_hash, rule_1, rule_3, false AS rule_8 FROM f")
def d_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = stored_facts(spark, sf_dir)
    return f.pivot_verdicts(facts.select("identifier_hash", f.verdict_map(facts).alias("rule_results")), [1, 3, 8])


@query(f"WITH {DOC_FACTS}, {_OCCURRENCES} SELECT identifier_hash, string_agg(rule_id || ':' || occurrence_value, ';' ORDER BY rule_id, occurrence_value) AS details FROM o GROUP BY ALL")
def a_rule_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colophon.functions.text import rule_details

    ordered = stored_facts(spark, sf_dir, details=True).withColumn("d", F.array_sort(F.transform("details", lambda d: F.struct(d["rule_id"].alias("rule_id"), d["value"].alias("value")))))
    return ordered.select("identifier_hash", rule_details(F.col("d")).alias("details"))


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%customer#%7%' OR contains(lower(c_mktsegment), 'build')")
def f_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    both = s.contains_ignoring_case(F.col("c_mktsegment"), "BUILD") | F.lower("c_name").like("%customer#%7%")
    return customers.where(both).select("c_custkey", "c_name")


_PATTERNS = ["%customer#%12%", "%Y B%", "%99", "%o_st%", "none of them%"]


@query(" UNION ALL ".join(f"SELECT '{p}' AS pattern, p_partkey AS id FROM part WHERE p_name ILIKE '{p}' UNION ALL SELECT '{p}', c_custkey FROM customer WHERE c_name ILIKE '{p}'" for p in _PATTERNS))
def f_contains_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns with wildcards, searched by the pieces of names; short ones by a scan."""
    out = None
    for name, key, column in (("part", "p_partkey", "p_name"), ("customer", "c_custkey", "c_name")):
        rows = table(spark, sf_dir, name).select(F.col(key).alias("id"), F.col(column).alias("name"))
        there = scratch(spark, "pieces")
        contains.write_index(rows, "id", "name", there)
        for pattern in _PATTERNS:
            found = contains.search(rows, spark.read.parquet(there), "id", "name", pattern).select(F.lit(pattern).alias("pattern"), "id")
            out = found if out is None else out.unionByName(found)
    return out


@query(f"""WITH {DOC_FACTS}, n AS (SELECT identifier, is_valid, (row_number() OVER (ORDER BY identifier) - 1) // 20 AS page, (count(*) OVER () - 1) // 20 AS last FROM f)
SELECT page, identifier, is_valid FROM n WHERE page IN (0, last // 2, last)""")
def r_page_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, middle and last page, each a range of keys."""
    records = stored_facts(spark, sf_dir)
    there = scratch(spark, "directory")
    s.page_directory(records, "identifier", 20).write.parquet(there)
    directory = spark.read.parquet(there)
    last = directory.agg(F.max("page")).first()[0]
    out = None
    for number in sorted({0, last // 2, last}):
        found = s.directory_page(records, directory, number, "identifier").select(F.lit(number).cast("long").alias("page"), "identifier", "is_valid")
        out = found if out is None else out.unionByName(found)
    return out


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' AND o_custkey IN (1, 2, 3, 5, 8, 13) AND o_orderdate BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1997-12-31'")
def f_status_in_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(s.status_is(F.col("o_orderstatus"), "F", negated=True))
    dates = F.col("o_orderdate").between(F.lit("1993-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz"))
    return orders.where(F.col("o_custkey").isin(1, 2, 3, 5, 8, 13) & dates).select("o_orderkey", "o_orderstatus")


@query(f"WITH {DOC_FACTS} SELECT count(*) AS n, count(*) FILTER (WHERE is_transformed) AS n_transformed FROM f WHERE rule_2")
def a_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.count_by_status(stored_facts(spark, sf_dir).withColumn("status", F.col("rule_2").cast("int")), [1])


@query(f"WITH {DOC_FACTS} {_COUNTS}")
def k_stats_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics written as JSON and read back."""
    one = s.counts(stored_facts(spark, sf_dir))
    return s.stats_from_json(s.stats_to_json(one), ", ".join(f"{c} long" for c in one.columns))
