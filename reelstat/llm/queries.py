"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (byte_bpe, centroids, exact_dedup, license_scan, line_dedup, ngram_lm, packing,
               quality, simhash, token_files, toxicity, variants, weighted_sampling)
from .common import documents, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
NGRAM_ORDER = 3
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir))


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_held_out(documents(spark, sf_dir), order=NGRAM_ORDER)


def pack(docs: DataFrame) -> DataFrame:
    return packing.pack_documents(docs, WORD_BPE, added_tokens=True).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(documents(spark, sf_dir), BYTE_RANKS, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, BYTE_RANKS, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)
         .alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.fingerprints(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "llm", f"token-files-{uuid.uuid4().hex}")
    token_files.write_token_files(documents(spark, sf_dir), path, BYTE_BPE, added_tokens=True)
    return token_files.read_token_files(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(documents(spark, sf_dir))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_held_out(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(documents(spark, sf_dir))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ngram_lm": op2_ngram_lm,
    "op3_packing": op3_packing,
    "op4_simhash": op4_simhash,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_weighted_sampling": op6_weighted_sampling,
    "op7_license_scan": op7_license_scan,
    "op8_toxicity": op8_toxicity,
    "op9_token_files": op9_token_files,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_quality": op11_quality,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_centroids": op13_centroids,
}

def _lloyd_sql(k: int = centroids.CLUSTERS, rounds: int = centroids.ROUNDS) -> str:
    """Lloyd's rounds, every vector against every centroid, one pair of tables a round."""
    nearest = """ AS MATERIALIZED (
        SELECT n, any_value(vec_id) AS vec_id, any_value(v) AS v,
               min(d * {k} + c) % {k} AS c, min(d * {k} + c) // {k} AS d
        FROM (SELECT n, vec_id, p.v AS v, c.c AS c,
                     list_sum([(p.v[i] - c.v[i]) * (p.v[i] - c.v[i])
                               FOR i IN range(1, 65)])::BIGINT AS d
              FROM points AS p, centres_{r} AS c) GROUP BY n)"""
    moved = """ AS MATERIALIZED (
        SELECT old.c, coalesce(new.v, old.v) AS v FROM centres_{r} AS old LEFT JOIN (
            SELECT c, list((s - ((s % m) + m) % m) // m ORDER BY i) AS v
            FROM (SELECT c, i, sum(x) AS s, count(*) AS m
                  FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM near_{r})
                  GROUP BY c, i) GROUP BY c) AS new ON old.c = new.c)"""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"near_{r}" + nearest.format(k=k, r=r))
        if r < rounds:
            steps.append(f"centres_{r + 1}" + moved.format(r=r))
    return f"""
        WITH points AS MATERIALIZED (
            SELECT row_number() OVER () AS n, vec_id,
                   [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
            FROM embeddings
            WHERE len(embedding) = 64
              AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
        centres_0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v
            FROM points ORDER BY sha256('3:' || vec_id) LIMIT {k}),
        {", ".join(steps)}
        SELECT vec_id, near_{rounds}.c::INT AS cluster, d::BIGINT AS distance,
               (sum(d) OVER (PARTITION BY near_{rounds}.c))::BIGINT AS cluster_inertia,
               (sum(d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(centres_{rounds}.v, ',')) AS centroid_sha256
        FROM near_{rounds} JOIN centres_{rounds} USING (c)
    """


#: DuckDB SQL of the queries that SQL can express.
SQL = {
    "op10_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op13_centroids": _lloyd_sql(),
}
