"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.llm import ann, bpe, embed_dedup, lm, mixing, neardup, prefix_trie, quality, resampling, secrets, token_counts, toxicity, wavelet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_wavelet_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_digest(wavelet.write_shards(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), 85)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.98)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest=True)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10, least=20)


def queries() -> dict:
    found = (op1_token_counts, op2_secret_scans, op3_quality_classifier, op4_mixing, op5_wavelet_output, op6_minhash_dedup, op7_nearest_neighbours, op8_embedding_dedup, op9_bpe, op10_toxicity, op11_prefix_trie, op12_lm_scoring, op13_importance_resampling)
    return {f.__name__: f for f in found}


_REACH = """
, reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
"""

_OP6 = (
    r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id)
, pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)
)"""
    + _REACH
    + """
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
"""
)

_OP8 = (
    """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.98
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)"""
    + _REACH
    + """
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts ON counts.a = e.vec_id LEFT JOIN low ON low.a = e.vec_id
"""
)


#: The table of the 32-bit checksum, from its rule, and the bytes of a text as numbers.
_CRC_TABLE = """
crc_rows AS (
  SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n)
), crc_table AS (SELECT list(v ORDER BY n) AS t FROM crc_rows)
"""


def _crc(of: str) -> str:
    byte = f"('0x' || substr(hex(encode({of})), 2 * i + 1, 2))::BIGINT"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(encode({of}))), lambda i: {byte}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_OP11 = (
    """
WITH """
    + _CRC_TABLE
    + """, turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || ':' || coalesce(text, ''))) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (SELECT conv_id, conv_id - conv_id % 5 AS of, """
    + _crc("conv_id::VARCHAR")
    + """ % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table)
, rebuilt AS (
  SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY own, place) AS depth, role, text
  FROM (SELECT c.conv_id, false AS own, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.of AND place <= h UNION ALL SELECT c.conv_id, true, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND place > h) c
), path AS (
  SELECT conv_id, depth, octet_length(encode(text)) AS bytes, md5(list(len(role) || ':' || role || text) OVER (PARTITION BY conv_id ORDER BY depth)::VARCHAR) AS key FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs
), nodes AS (
  SELECT key, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved FROM path GROUP BY key
), family AS (
  SELECT n.key, p.key AS parent FROM nodes n JOIN path p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
), kids AS (SELECT parent AS key, count(*) AS n FROM family GROUP BY parent)
, totals AS (
  SELECT p.key, sum(saved) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
  FROM nodes n LEFT JOIN kids ON kids.key = n.key JOIN path p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.key
), ends AS (
  SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT key, conv_id FROM path QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY key
)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, leaves::BIGINT AS n_leaves, totals.saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM nodes n JOIN totals ON totals.key = n.key LEFT JOIN kids ON kids.key = n.key LEFT JOIN family f ON f.key = n.key LEFT JOIN nodes up ON up.key = f.parent LEFT JOIN ends ON ends.key = n.key
"""
)

_OP13 = (
    r"""
WITH """
    + _CRC_TABLE
    + r""", doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), goal_words AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), doc_runs AS (SELECT doc_id, unnest(w) AS f FROM doc_words), goal_runs AS (SELECT unnest(w) AS f FROM goal_words)
, known AS (SELECT DISTINCT f FROM (SELECT f FROM doc_runs UNION ALL SELECT f FROM goal_runs))
, buckets AS (SELECT f, """
    + _crc("f")
    + """ % 10000 AS b FROM known, crc_table)
, s_counts AS (SELECT b, count(*) AS s FROM doc_runs JOIN buckets USING (f) GROUP BY b), t_counts AS (SELECT b, count(*) AS t FROM goal_runs JOIN buckets USING (f) GROUP BY b)
, sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s_counts)::DOUBLE AS big_s, (SELECT coalesce(sum(t), 0) FROM t_counts)::DOUBLE AS big_t)
, gains AS (
  SELECT n AS b, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (big_s + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (big_t + 10000))))::BIGINT AS gain
  FROM range(10000) r(n) CROSS JOIN sums LEFT JOIN s_counts ON s_counts.b = n LEFT JOIN t_counts ON t_counts.b = n
), weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM doc_runs JOIN buckets USING (f) JOIN gains USING (b) GROUP BY doc_id)
, scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM doc_words LEFT JOIN weights USING (doc_id)
), placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
)


def oracle_sql() -> dict[str, str]:
    return {"op6_minhash_dedup": _OP6, "op8_embedding_dedup": _OP8, "op11_prefix_trie": _OP11, "op13_importance_resampling": _OP13}
