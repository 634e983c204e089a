"""The operators as stages over a documents table (doc_id, text, and any other columns): each takes and, but for packing, returns
its columns.

Defined cases of all: an empty table gives an empty one; whole texts are used, however long; columns that the documents carry
besides keep their values, whatever they are called, also those named as a stage's own; rows that stay are not changed but by masking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import decontam, packing, pii, quality, simhash
from quern.llm.frames import free, sized, table, without
from quern.session import settle


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    A null text, or one without a word, scores 0 and is rejected; a null id is judged by its text and stays null; repeated rows are judged each.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    own, score = [f"`{c}`" for c in docs.columns], free(docs, "score")
    return quality.scores(docs, model, score_col=score).where(F.col(f"`{score}`") >= quality.THRESHOLD).select(*own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the least id.

    Rows with a null id, or a text that is null or has no word, are in no group and stay; of rows equal in id and text one stays, the least by
    the other columns; rows of one id with different texts go together, and all stay if none of them is near a lesser id.
    """
    out = without(docs, settle(simhash.near_duplicates(docs), "near"))
    repeated = settle(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return out
    names = [f"`{c}`" for c in docs.columns]
    rest = [f"`{c}`" for c in docs.columns if c not in ("doc_id", "text")]
    nth = free(docs, "nth")
    order = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(*(rest or ["doc_id"])))
    again = out.join(sized(repeated), "doc_id", "left_semi").withColumn(nth, order).where(f"`{nth}` = 1")
    return without(out, repeated).select(*names).unionByName(again.select(*names))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Rows with a null id or null text match nothing and stay; an id of several rows goes with all of them if one holds a passage.
    """
    return without(docs, settle(decontam.leaks(docs, table(spark, sf_dir, "benchmark")), "leaks"))


def mask_identifiers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, identifiers in the text replaced by their kind, n_chars (where there is such a column) as the text now is.

    A null text stays null with its n_chars, an empty one empty; a null id is kept; repeated rows are masked each.
    """
    out = pii.without_identifiers(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(bin_id, used, doc_ids, starts, lengths, tokens): the documents as sequences of 8192 byte tokens.

    A null id, and a null or empty text, are in no sequence; repeated rows are packed each.
    """
    return packing.sequences(docs)
