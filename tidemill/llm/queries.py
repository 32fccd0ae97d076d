"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import align, bpe, hardneg, html_text, license, lm_score, mix, neardup, ngram_join, ogg, quality, shard, substring

#: A public tokenizer's file, or a path.
VOCABULARY = os.environ.get("TIDEMILL_BPE", "byte_bpe_50k.json")
PIECES = os.environ.get("TIDEMILL_PIECES", "piece_bpe_32k.model")
SHARD_NAMES = [f"shard-{k:02d}" for k in range(shard.SHARDS)]
Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir), digest=True).withColumnRenamed("kept", "kept_sha256")


def op3_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir))


def op4_html_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), VOCABULARY)


def op6_lookup_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.assign(documents(spark, sf_dir).select("doc_id"), SHARD_NAMES)


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = ogg.store(documents(spark, sf_dir))
    back = ogg.read(media.select(F.struct("doc_id", "n_bytes", F.length("media").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")).alias("of"), "media"), key="of")
    return back.select(
        "of.doc_id",
        "of.n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"),
        F.col("of.media_bytes").cast("long").alias("media_bytes"),
        "of.media_sha256",
        "feature",
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mix.plan(documents(spark, sf_dir))
    return p.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(quality.features(documents(spark, sf_dir)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def op10_license_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(documents(spark, sf_dir))


def op11_merge_path_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(documents(spark, sf_dir), VOCABULARY, PIECES)


def op12_hilbert_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hardneg.mine(moved, F.col("vec_id") % 100 == 0)


def op13_count_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    found = [op1_context_tree_scores, op2_substring_dedup, op3_minhash_near_duplicates, op4_html_line_blocks, op5_bpe_codec, op6_lookup_shards, op7_ogg_media, op8_mix_sources, op9_quality_votes, op10_license_spans, op11_merge_path_alignment, op12_hilbert_hard_negatives, op13_count_tree_join]
    return {f.__name__: f for f in found}


_OP8 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
r AS (SELECT *, source_size::DOUBLE / weight AS room FROM w),
l AS (SELECT *, sum(source_size) OVER ()::BIGINT - coalesce(sum(3 * source_size) OVER b, 0)::BIGINT AS left_,
        sum(weight) OVER ()::BIGINT - coalesce(sum(weight) OVER b, 0)::BIGINT AS among
      FROM r WINDOW b AS (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (3 * source_size)::DOUBLE * among <= weight::DOUBLE * left_ AS stops FROM l),
t AS (SELECT source, source_size, CASE WHEN stops THEN (3 * source_size)::DOUBLE ELSE weight::DOUBLE *
        (max(left_) FILTER (NOT stops) OVER ())::DOUBLE / (max(among) FILTER (NOT stops) OVER ())::DOUBLE END AS target FROM c),
x AS (SELECT d.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
        ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) * size AS taken FROM x
"""


_OP2 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, unnest(range(1, greatest(len(words) - 48, 1))) AS i, words FROM w WHERE len(words) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
r AS (SELECT h.doc_id, list(i) AS starts FROM h JOIN f ON h.h = f.h AND f.first < h.doc_id GROUP BY h.doc_id),
g AS (SELECT doc_id, list_distinct(flatten([range(s, s + 50) for s in starts])) AS gone FROM r),
k AS (SELECT w.doc_id, words, gone FROM w LEFT JOIN g ON w.doc_id = g.doc_id),
x AS (SELECT doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
        CASE WHEN gone IS NULL THEN words ELSE [words[j] for j in range(1, len(words) + 1) if NOT list_contains(gone, j)] END AS kept FROM k)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM x
"""

_OP3 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 4], ' ')) AS h
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS seen FROM w UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a),
m AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM w JOIN m ON m.id = w.doc_id LEFT JOIN n USING (doc_id)
"""


_OP13 = _OP3.replace("100 * common >= 75 *", "100 * common >= 80 *").replace(", doc_id = component_id AS kept", "")

_OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id AS id, list_inner_product(a.q, v.q)::BIGINT AS score
      FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10
"""


def oracle_sql() -> dict[str, str]:
    owners = ",".join(SHARD_NAMES[s] for s in shard.lookup_table(SHARD_NAMES))
    op6 = f"""
WITH k AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {shard.SLOTS} AS slot FROM documents),
t AS (SELECT string_split('{owners}', ',') AS owners)
SELECT doc_id, slot, owners[slot + 1] AS shard FROM k, t
"""
    return {"op2_substring_dedup": _OP2, "op3_minhash_near_duplicates": _OP3, "op6_lookup_shards": op6, "op8_mix_sources": _OP8, "op12_hilbert_hard_negatives": _OP12, "op13_count_tree_join": _OP13}
