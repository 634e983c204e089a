"""File sinks: articles one by one, and the shortlist as one JSON document."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import files

SHORTLIST = (
    "name string, path string, domain string, domain_confidence double, maturity string, tech_stack array<string>, last_modified string, topic_overlap double, "
    "file_count int, summary string, suggested_priority int, priority_rationale string"
)
_NAMES = [x.strip().split(" ")[0] for x in SHORTLIST.split(",")]
_WHOLE = f"scanned_at string, root_directory string, prototypes_found int, prototypes array<struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in SHORTLIST.split(','))}>>"


def write_articles(articles: DataFrame, root: str) -> None:
    """One file for each (path, content as text or bytes), written by the executors; each is put in place at once, and a task that runs twice leaves the same file."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content")):  # one object at a time beside the batch
                files.write_text(f"{root}/{path.as_py()}", content.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    articles.select("path", "content").mapInArrow(put, "n long").agg(F.sum("n")).collect()


def write_shortlist(scanned: DataFrame, path: str, scanned_at: str = "", root_directory: str = "") -> None:
    """A document of the scan's time, folder and number, and its projects by rank; a scan has a bounded number of projects."""
    if "path" not in scanned.columns:
        scanned = scanned.withColumn("path", F.concat(F.lit(f"{root_directory.rstrip('/')}/" if root_directory else ""), "name"))
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct(*_NAMES).alias("p")))), lambda x: x["p"])
    whole = scanned.agg(ranked.alias("prototypes")).select(F.lit(scanned_at).alias("scanned_at"), F.lit(root_directory).alias("root_directory"), F.size("prototypes").alias("prototypes_found"), "prototypes")
    files.write_text(path, whole.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"})).first()[0])


def shortlist_document(spark: SparkSession, path: str) -> DataFrame | None:
    """(scanned_at, root_directory, prototypes_found, prototypes), missing keys defaulted; None where there is no such document or it is none."""
    text = files.read_text(path)
    try:
        if text is None or not isinstance(json.loads(text), dict):
            return None
    except ValueError:
        return None
    d = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", _WHOLE).alias("d"))
    empty = F.from_json(F.lit("[]"), _WHOLE.split("prototypes ", 1)[1])
    return d.select(F.coalesce("d.scanned_at", F.lit("")).alias("scanned_at"), F.coalesce("d.root_directory", F.lit("")).alias("root_directory"), F.coalesce("d.prototypes_found", F.lit(0)).alias("prototypes_found"), F.coalesce("d.prototypes", empty).alias("prototypes"))


def read_shortlist(spark: SparkSession, path: str) -> DataFrame:
    """The projects of a shortlist, in its order as rank; a missing or broken document is an empty table."""
    d = shortlist_document(spark, path)
    if d is None:
        return spark.createDataFrame([], f"rank int, {SHORTLIST}")
    return d.select(F.posexplode("prototypes").alias("rank", "p")).select((F.col("rank") + 1).alias("rank"), "p.*")
