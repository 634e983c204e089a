"""Continuous ingest: new and changed files as a stream, each batch run through the batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions import text
from quern.operators import ingest
from quern.sources import files as sources
from quern.sources import state


def file_stream(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    """(path, mtime, content) of files as they arrive in the folders of a base."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_batch).load(f"{root}/*/*.md")
    body = F.when(F.is_valid_utf8("content"), text.newlines(F.col("content").cast("string")))
    return raw.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), body.alias("content"))


def ingest_stream(files: DataFrame, state_root: str, checkpoint: str, run_ts: str, limits: dict | None = None, once: bool = True, base: str | None = None) -> StreamingQuery:
    """Keeps the ingest snapshot up to date. A file stream tells of arrivals only; deletions are found by the batch ingest.

    Spark's file stream doesn't see names that begin with ``_`` or ``.``; with ``base``, the folder of the base, each batch lists those and takes in what is new of them.

    A batch that is run again after a failure finds its files' hashes in the snapshot and skips them, so versions don't
    rise twice.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        prev = state.read(spark, state_root, ingest.STATE)
        if base:
            hidden = sources.articles_listing(spark, base).where(F.col("path").rlike(r"/[._][^/]*$"))
            hidden = hidden.join(prev.select("path", F.col("mtime").alias("then")), "path", "left").where(~F.col("mtime").eqNullSafe(F.col("then")))
            df = df.select("path", "mtime", "content").unionByName(sources.read(spark, base, hidden).select("path", "mtime", "content"))
        latest = df.groupBy("path").agg(F.max_by(F.struct("content", "mtime"), "mtime").alias("f")).select("path", "f.*")
        acts = ingest.actions(*ingest.of(latest.where("content IS NOT NULL")), prev.join(latest.select("path"), "path", "left_semi"), limits)
        seen = ingest.next_state(acts, run_ts)
        rest = prev.join(latest.select("path"), "path", "left_anti")
        state.write(rest.unionByName(seen), state_root)

    w = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start()
