"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import ann, decontam, licenses, packing, pii, quality, quotes, simhash, suffixes, toxicity
from quern.llm.frames import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, needles, edits) of each benchmark item that a document holds."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score) of each document that the classifier accepts."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.scores(docs.select("doc_id", "text"), quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("score") >= quality.THRESHOLD).select("doc_id", "score")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, n_messages, n_quotes, chat) of each conversation, in reply order and without quotes."""
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, end) of each span of 50 words or more that occurs elsewhere too, in another document or in the same."""
    return suffixes.repeats(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kept_id) of each document that a kept near copy stands for."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, license, score, origin, origin_path) of each document that has or inherits a licence."""
    return licenses.scan(licenses.as_files(table(spark, sf_dir, "documents"))).withColumn("score", F.round("score", 6))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each sequence of 8192 byte tokens: its documents, their starts and lengths, and the tokens."""
    return packing.sequences(table(spark, sf_dir, "documents"))


def op8_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, neighbour_id, distance, rank): the ten nearest others of every embedding whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, vectors.where("vec_id % 20 = 0"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kind, start, end) of each personal identifier, however disguised."""
    return pii.identifiers(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score) of each document that the classifier takes for toxic."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.scores(docs.select("doc_id", "text"), toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("score") >= toxicity.THRESHOLD).select("doc_id", "score")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_quality_classifier,
        op3_chat_formatting,
        op4_suffix_array_dedup,
        op5_simhash_near_dedup,
        op6_license_scan,
        op7_best_fit_packing,
        op8_inverted_multi_index,
        op9_pii,
        op10_toxicity,
    )
}
SQL: dict[str, str] = {
    "op6_license_scan": licenses.SQL,
    "op3_chat_formatting": quotes.SQL,
    "op4_suffix_array_dedup": r"""
        WITH words AS (
            SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        windows AS (
            SELECT doc_id, unnest(range(0, len(w) - 49)) AS s, w FROM words WHERE len(w) >= 50),
        hashed AS (SELECT doc_id, s, md5(array_to_string(w[s + 1 : s + 50], ' ')) AS h FROM windows),
        dup AS (SELECT h FROM hashed GROUP BY h HAVING count(DISTINCT (doc_id, s)) > 1),
        hits AS (SELECT DISTINCT doc_id, s FROM hashed JOIN dup USING (h)),
        marked AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS fresh FROM hits),
        islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM marked)
        SELECT doc_id, min(s) AS "start", max(s) + 50 AS "end" FROM islands GROUP BY doc_id, island""",
}
