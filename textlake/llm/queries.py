"""One query for each operator, over its whole table, and its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_dedup
from .lm import score_documents
from .mixing import mix
from . import pieces as sentence_pieces
from .quality import FUNCTION_WORDS, em_sql, judge_quality
from .sharding import shard
from .simhash import simhash_groups
from .suffix_dedup import repeat_digest
from .token_counts import MODEL, token_counts
from .url_filter import filter_urls, labelled_by_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query(
    "op3_exact_dedup",
    f"""
    WITH d AS (SELECT doc_id, sha256({LOWER_SQL}) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


WORDS_SQL = r"len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))"


@_query(
    "op7_mix_sources",
    f"""
    WITH d AS (SELECT doc_id, source, {WORDS_SQL}::BIGINT AS size, md5(concat('mix:', coalesce(doc_id::VARCHAR, ''), ':', md5(coalesce(text, '')))) AS key FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s),
    w AS (SELECT *, [3.0, 1.0, 2.0][i % 3 + 1]::DOUBLE AS w, source_size * 2 AS cap FROM r),
    l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER b, 0)::DOUBLE)
                    / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level
          FROM w WINDOW b AS (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * w) AS target FROM l),
    q AS (SELECT d.doc_id, d.size, t.source_size, t.target,
                 (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key))::DOUBLE AS before
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    v AS (SELECT *, CASE WHEN target > 0 THEN before / target END AS v1,
                 CASE WHEN target > 0 THEN (source_size + before) / target END AS v2 FROM q),
    c AS (SELECT v1 AS v, size FROM v WHERE size > 0 UNION ALL SELECT v2, size FROM v WHERE size > 0),
    g AS (SELECT v, sum(size) OVER (ORDER BY v) AS spent FROM c),
    e AS (SELECT coalesce(max(v), -1) AS last FROM g WHERE spent <= (SELECT sum(target) FROM t))
    SELECT doc_id, size, source_size, target,
           (size * ((coalesce(v1 <= last, false))::BIGINT + (coalesce(v2 <= last, false))::BIGINT))::BIGINT AS taken
    FROM v, e
    """,
)
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


@_query(
    "op10_shard",
    """
    WITH RECURSIVE bits AS (
        SELECT b::BIGINT AS b, b::BIGINT AS v, 0 AS k FROM range(256) t(b) UNION ALL
        SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
    crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
    d AS (SELECT doc_id, (strlen(coalesce(text, '')) + 8)::BIGINT AS size,
                 list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::BIGINT) AS bytes,
                 concat(md5(coalesce(text, '')), md5(coalesce(doc_id::VARCHAR, ''))) AS key FROM documents),
    c AS (SELECT d.* EXCLUDE (bytes), xor(list_reduce(bytes, lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
          FROM d, crc),
    o AS (SELECT *, sum(size) OVER (ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto,
                 row_number() OVER (ORDER BY key, doc_id) AS rank, sum(size) OVER () AS total FROM c),
    p AS (SELECT *, ((2 * upto - size) * 24 // (2 * total))::INTEGER AS shard FROM o)
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
           (rank - min(rank) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM p
    """,
)
def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


FEATURES_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
    g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d),
    k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times FROM g),
    c AS (SELECT doc_id, count(DISTINCT pos)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM k WHERE times > 1) GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
           len(lines)::BIGINT AS n_lines, len(list_distinct(w))::BIGINT AS n_distinct,
           len(list_filter(w, lambda x: x IN (FUNCTION_WORDS)))::BIGINT AS n_function,
           length(regexp_replace(t, '[^.!?]', '', 'g'))::BIGINT AS n_ends, length(regexp_replace(t, '[^0-9]', '', 'g'))::BIGINT AS n_digits
    FROM d LEFT JOIN c USING (doc_id)
""".replace("FUNCTION_WORDS", ", ".join(f"'{w}'" for w in FUNCTION_WORDS))


@_query("op1_quality_rules", em_sql(FEATURES_SQL))
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))


@_query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


@_query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(table(spark, sf_dir, "documents"))


@_query("op5_url_filter")
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, labelled_by_rules(pages))


@_query("op6_lm_scoring")
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


@_query("op8_sentencepiece_nbest")
def op8_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return sentence_pieces.encode_documents(docs, public_tokenizers.path(sentence_pieces.MODEL)).select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), "score", "nbest_scores", "round_trip")


@_query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
