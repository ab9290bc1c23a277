"""Queries of the text operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.llm import conversations, decontaminate, dominance, idstore, jaccard, languages, lines, packing, ppm, quality, suffixes, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scored(_table(spark, sf_dir, "documents"))


def op4_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"))


def op5_line_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.by_document(_table(spark, sf_dir, "documents"))


def op6_content_addressed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idstore.write(_table(spark, sf_dir, "documents")).read().drop("ids")


def op7_two_stage_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.cleaned(_table(spark, sf_dir, "documents")).drop("kept")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op9_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identified(_table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.repaired(conversations.damaged(_table(spark, sf_dir, "conversations")))
    text = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return rows.withColumn("repaired_sha256", F.sha2(text, 256)).drop("repaired")


def op12_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.packed(_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash_containment, op2_warc_normaliser, op3_partial_matching, op4_tokeniser_fertility, op5_line_similarity, op6_content_addressed_store, op7_two_stage_suffixes, op8_best_fit_packing, op9_nearest_centroid, op10_ngram_jaccard, op11_conversation_repair, op12_dominance_packing, op13_embedding_whitening)}
#: Five-word shingles of a table's texts, as lists of words.
_SHINGLES = r"""SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM (
    SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM (
        SELECT {id} AS id, regexp_extract_all(lower(text), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM {table}))"""

SQL: dict[str, str] = {
    "op1_minhash_containment": f"""
        WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}), b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
        n AS (SELECT id, count(*) AS n_shingles FROM b GROUP BY id),
        f AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_found FROM d JOIN b USING (s) GROUP BY ALL)
        SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
        FROM f JOIN n ON n.id = f.item_id WHERE 10 * n_found >= 8 * n_shingles""",
    "op2_warc_normaliser": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
        FROM m""",
}
