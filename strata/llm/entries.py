"""The queries of this subpackage for __spark_entry__.py, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import bpe, counts, embed, exact, minhash, mixing, pii, ppm, substring, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_span_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digests(pii.find_personal_data(docs, pii.train(docs)))


def op4_pstable_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_embeddings(table(spark, sf_dir, "embeddings"))


def op5_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"))


def fold(mod: int) -> F.Column:
    """crc32 of the id as text, modulo mod."""
    return F.crc32(F.col("doc_id").cast("string")) % mod


def op1_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ppm.score_documents(table(spark, sf_dir, "documents"), fold(10) != 0)
    return scored.select("doc_id", F.coalesce(fold(10) == 0, F.lit(True)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_minmax_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.85)


def op7_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_ppm_score": op1_ppm_score,
    "op2_cover_anchors": op2_cover_anchors,
    "op3_span_tagger": op3_span_tagger,
    "op4_pstable_hashing": op4_pstable_hashing,
    "op5_prefix_bpe": op5_prefix_bpe,
    "op6_minmax_hashing": op6_minmax_hashing,
    "op7_toxicity_cnn": op7_toxicity_cnn,
    "op8_block_naming": op8_block_naming,
    "op9_token_counts": op9_token_counts,
    "op10_source_mix": op10_source_mix,
}

ORACLE_SQL = {
    "op2_cover_anchors": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT x, min(doc_id) AS low FROM v GROUP BY x),
g AS (SELECT DISTINCT v.doc_id, unnest(range(v.i, v.i + 50)) AS p FROM v JOIN f ON f.x = v.x AND f.low < v.doc_id),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.p) AS kept, count(*) AS n FROM t ANTI JOIN g ON g.doc_id = t.doc_id AND g.p = t.p GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op6_minmax_hashing": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b WHERE 100 * c.k >= 85 * (p.n + q.n - c.k)),
r(node, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT m.node AS doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, m.node = m.component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.node""",
    "op4_pstable_hashing": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS length FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.length * b.length) >= 0.9),
r(node, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT m.vec_id, coalesce(k.n_links, 0) AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m JOIN c ON c.node = m.vec_id LEFT JOIN k ON k.a = m.vec_id""",
    "op8_block_naming": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS n FROM documents),
w AS (SELECT doc_id, sha256(n) AS text_sha256, CAST(length(t) AS BIGINT) AS n_points,
             first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY n) AS group_size, row_number() OVER g AS place
      FROM d WINDOW g AS (PARTITION BY n ORDER BY length(t) DESC, doc_id))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256, n_points FROM w""",
    "op10_source_mix": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             greatest(0.05::DOUBLE, 1.0::DOUBLE - coalesce(length(regexp_replace(t, '[\p{L} \n]+', '', 'g'))::DOUBLE / nullif(length(t), 0)::DOUBLE, 0.0::DOUBLE)) AS quality,
             (('0x' || substr(md5('mix:' || doc_id), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE AS unit FROM d),
k AS (SELECT *, -ln(unit) / quality AS key FROM r),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, source_size::DOUBLE * 3 AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM l WHERE level <= ratio) * weight) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST((epochs + CASE WHEN rest > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM p""",
}
