"""The operators' queries over the tables of a folder, each with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm._base import table


def op1_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriloom.llm._base import written
    from veriloom.llm.hamming import nearest_codes, sign_codes

    codes = written(sign_codes(table(spark, sf_dir, "embeddings")), "codes")
    return nearest_codes(codes, codes.where("id % 50 = 0"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriloom.llm.packing import packed_documents

    return packed_documents(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriloom.llm.quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriloom.llm.warc import archive_report

    return archive_report(table(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriloom.llm.pieces import coding_report

    return coding_report(table(spark, sf_dir, "documents"))


def op6_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriloom.llm.reshard import rewritten_shards

    rows, _, _ = rewritten_shards(table(spark, sf_dir, "documents"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriloom.llm.suffix import repeat_report

    return repeat_report(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriloom.llm.lm import score_report

    return score_report(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriloom.llm.lsm import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hamming_topk": op1_hamming_topk,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_warc": op4_warc,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_reshard": op6_reshard,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_simhash": op8_simhash,
    "op9_lm": op9_lm,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_hamming_topk": r"""
        WITH bits AS (SELECT vec_id, i, embedding[i] > 0 AS bit FROM embeddings, range(1, 65) AS r(i)),
        d AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, CAST(sum(CASE WHEN q.bit <> v.bit THEN 1 ELSE 0 END) AS INTEGER) AS distance
              FROM bits q JOIN bits v ON q.i = v.i AND q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, v.vec_id),
        k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM d)
        SELECT query_id, rank, neighbour_id, distance FROM k WHERE rank <= 10""",
    "op4_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
        g AS (SELECT page_id, n, sha1(body) AS digest, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS last FROM p)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN last <> page_id THEN last END AS refers_to FROM g""",
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body, length(coalesce(text, '')) AS n FROM documents),
        g AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS place, count(*) OVER (PARTITION BY body) AS copies,
              first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id FROM t)
        SELECT doc_id, keep_id, CAST(copies AS BIGINT) AS group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM g""",
}
