"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colophon.llm import ann, decontam, line_dedup, merkle, packing, quality, secrets, sharding, simhash, substring_dedup, topk, toxicity, whitening


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_read(spark, sf_dir, "documents")).drop("longest")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("text")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenize(_read(spark, sf_dir, "documents")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _read(spark, sf_dir, "labels")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_read(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(_read(spark, sf_dir, "documents"))


def op12_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM w WHERE len(words) >= 13
), k AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win FROM p
), f AS (
  SELECT win, min(doc_id) AS first FROM k GROUP BY win
), gone AS (
  SELECT DISTINCT k.doc_id, unnest(range(k.i, k.i + 13)) AS i FROM k JOIN f USING (win) WHERE k.doc_id > f.first
), kept AS (
  SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.i) FILTER (WHERE g.i IS NULL) AS kept, count(g.i) AS n_removed
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w) a
  LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.i = g.i GROUP BY a.doc_id
)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(kept.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


OP7_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, words, least(len(words), 10) AS n, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)
), ns AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, ns WHERE len(words) >= n)
), h AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), k AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(k.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(k.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""

OP9_SQL = """
WITH l AS (
  SELECT doc_id, coalesce('=' || source, '') AS site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), b AS (
  SELECT line, min(doc_id) AS first_doc FROM l WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT site) >= 10
), m AS (
  SELECT l.doc_id, l.line, l.pos,
         b.line IS NOT NULL AND NOT (l.doc_id = b.first_doc AND l.pos = min(l.pos) OVER (PARTITION BY l.doc_id, l.line)) AS gone
  FROM l LEFT JOIN b ON l.line = b.line
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP11_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp, text,
         concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
         list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(regexp_extract_all(CAST(doc_id AS VARCHAR), '.'), lambda c: [CAST(256 + ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
           lambda crc, x: CASE WHEN xor(crc, x & 255) & 1 = 1 THEN xor(xor(crc, x & 255) >> 1, 3988292384) ELSE xor(crc, x & 255) >> 1 END) & 1 AS odd
  FROM documents
), l AS (
  SELECT doc_id, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN odd = 1 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS tampered
  FROM d
), p AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY grp) AS size FROM l
), t AS (
  SELECT grp, 0 AS level, place, size, leaf AS digest FROM p
  UNION ALL
  SELECT grp, level + 1, place // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM t WHERE size > 1 GROUP BY grp, level, place // 3, size
), r AS (
  SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS size FROM t WHERE size = 1
), u AS (
  SELECT 0 AS level, place, size, subroot AS digest FROM r
  UNION ALL
  SELECT level + 1, place // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM u WHERE size > 1 GROUP BY level, place // 3, size
), s AS (
  SELECT p.grp, p.place, t.level, coalesce(string_agg(t.digest, '' ORDER BY t.place) FILTER (WHERE t.place < p.place // CAST(pow(3, t.level) AS BIGINT)), '') AS before,
         coalesce(string_agg(t.digest, '' ORDER BY t.place) FILTER (WHERE t.place > p.place // CAST(pow(3, t.level) AS BIGINT)), '') AS after
  FROM p JOIN t ON t.grp = p.grp AND t.size > 1 AND t.place // 3 = p.place // CAST(pow(3, t.level + 1) AS BIGINT) GROUP BY p.grp, p.place, t.level
), v AS (
  SELECT r.grp, u.level, coalesce(string_agg(u.digest, '' ORDER BY u.place) FILTER (WHERE u.place < r.place // CAST(pow(3, u.level) AS BIGINT)), '') AS before,
         coalesce(string_agg(u.digest, '' ORDER BY u.place) FILTER (WHERE u.place > r.place // CAST(pow(3, u.level) AS BIGINT)), '') AS after
  FROM r JOIN u ON u.size > 1 AND u.place // 3 = r.place // CAST(pow(3, u.level + 1) AS BIGINT) GROUP BY r.grp, u.level
), low AS (
  SELECT grp, place, list(before || '|' || after ORDER BY level) AS path FROM s GROUP BY grp, place
), high AS (
  SELECT grp, list(before || '|' || after ORDER BY level) AS path FROM v GROUP BY grp
), f AS (
  SELECT p.doc_id, p.leaf, p.tampered, r.subroot, (SELECT digest FROM u WHERE size = 1) AS root, coalesce(low.path, []) || coalesce(high.path, []) AS path
  FROM p JOIN r ON p.grp = r.grp LEFT JOIN low ON low.grp = p.grp AND low.place = p.place LEFT JOIN high ON high.grp = p.grp
), g AS (
  SELECT *, list_reduce([tampered] || path, lambda below, x: sha256(split_part(x, '|', 1) || below || split_part(x, '|', 2))) AS folded_root FROM f
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM g
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_packing, op4_quality, op5_simhash, op6_secrets, op7_decontamination, op8_topk, op9_line_dedup, op10_sharding, op11_merkle, op12_ann, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op7_decontamination": OP7_SQL, "op8_topk": OP8_SQL, "op9_line_dedup": OP9_SQL, "op11_merkle": OP11_SQL}
