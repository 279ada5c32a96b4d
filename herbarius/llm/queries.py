"""The queries of this subpackage over the test tables, and their SQL where it can be given."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import leaks
from .hamming_topk import binary_codes, hamming_topk
from .lexical_topk import lexical_topk
from .ngram_jaccard import jaccard_components
from .pii import personal_data
from .quality import quality_scores
from .secret_scan import secret_spans
from .sentencepiece_dropout import decode_ids, encode
from .suffix_dedup import remove_repeats
from .token_align import align_tokens
from .token_counts import token_counts
from .toxicity import toxicity_scores
from .warc import round_trip


def op1_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with merge-dropout, and the digest of what they decode to."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    tokens = encode(table(spark, sf_dir, "documents"), path, dropout=0.1, seed=1)
    return decode_ids(tokens, path).select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op8_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = binary_codes(table(spark, sf_dir, "embeddings"))
    return hamming_topk(codes, codes.filter(F.col("id") % 100 == 0), k=10)


def op11_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_topk(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=400).drop("spans")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_sentencepiece_dropout": op1_sentencepiece_dropout,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_secret_scan": op3_secret_scan,
    "op4_decontamination": op4_decontamination,
    "op5_token_counts": op5_token_counts,
    "op6_warc": op6_warc,
    "op7_personal_data": op7_personal_data,
    "op8_quality_cotraining": op8_quality_cotraining,
    "op9_toxicity": op9_toxicity,
    "op10_hamming_topk": op10_hamming_topk,
    "op11_lexical_topk": op11_lexical_topk,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL = {
    "op6_warc": """
        WITH rows_ AS (
          SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
        firsts AS (SELECT sha, min(page_id) AS first FROM rows_ GROUP BY sha),
        digits AS (
          SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, CASE WHEN first < page_id THEN first END AS refers_to,
            list_transform(range(8), lambda j: CAST('0x' || substr(sha, CAST(5 * j + 1 AS BIGINT), 5) AS BIGINT)) AS fives
          FROM rows_ JOIN firsts USING (sha))
        SELECT page_id, payload_bytes, refers_to,
          array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            CAST(1 + (fives[CAST(1 + i // 4 AS BIGINT)] >> CAST(15 - 5 * (i % 4) AS INTEGER)) % 32 AS BIGINT), 1)), '') AS payload_digest,
          CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type
        FROM digits
    """,
    "op10_hamming_topk": """
        WITH codes AS (
          SELECT DISTINCT vec_id AS id,
            CAST(array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS BIT) AS code
          FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        pairs AS (
          SELECT q.id AS query_id, c.id AS neighbour_id, CAST(bit_count(xor(q.code, c.code)) AS INTEGER) AS distance
          FROM codes q JOIN codes c ON c.id <> q.id WHERE q.id % 100 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbour_id, distance FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM pairs)
        WHERE rank <= 10
    """,
    "op11_lexical_topk": r"""
        WITH docs AS (
          SELECT row_number() OVER () AS r, doc_id,
            regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ts
          FROM documents WHERE text IS NOT NULL),
        flat AS (SELECT r, doc_id, unnest(ts) AS t FROM docs),
        held AS (SELECT r, doc_id, t, count(*) AS tf FROM flat GROUP BY r, doc_id, t),
        lengths AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY r),
        totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
        weights AS (
          SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
          FROM held, totals GROUP BY t, n_docs),
        asked AS (
          SELECT q, item_id, unnest(ts) AS t FROM (
            SELECT row_number() OVER () AS q, item_id,
              regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ts
            FROM benchmark WHERE text IS NOT NULL)),
        scores AS (
          SELECT q, item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
          FROM asked JOIN weights USING (t) JOIN held USING (t) JOIN lengths USING (r), totals
          GROUP BY q, item_id, doc_id, r)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
        WHERE rank <= 20
    """,
}
