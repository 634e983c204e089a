"""Incremental ingest: change detection against a snapshot, the gate, the next snapshot, and status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.articles import articles
from quern.operators.gate import gate, score

STATE = "path string, title string, hash string, mtime double, score double, ingested_at string, source_version int, ingest_date string, quality_warnings array<string>"


def actions(listed: DataFrame, read: Callable[[DataFrame], DataFrame], state: DataFrame, limits: dict | None = None, force_all: bool = False) -> DataFrame:
    """One row for each article on disk or tracked: its action, reason, and the fields of the next snapshot.

    ``listed`` has (path, mtime) of all files. It meets the snapshot first: files that are gone are deleted, those of the same time
    skipped. Only what is left is read: ``read`` gives (path, mtime, content) of rows (path, mtime), and ``valid`` if it can tell. A read file
    is an error if it isn't valid, skipped by its hash, or passes the gate and is inserted, or updated with the next version.
    """
    prev = state.select("path", F.struct(*[c for c in state.columns if c != "path"]).alias("prev"))
    j = listed.select("path", "mtime", F.lit(True).alias("there")).join(prev, "path", "full")
    known = F.col("prev").isNotNull()
    may_skip = known & F.lit(not force_all)
    same_time, same_hash = F.col("prev.mtime") == F.col("mtime"), F.col("prev.hash") == F.col("hash")
    early = F.when(F.col("there").isNull(), "delete").when(may_skip & F.coalesce(same_time, F.lit(False)), "skip")
    j = j.withColumn("action", early)
    reason = F.when(F.col("action") == "delete", "file_removed").when(F.col("action") == "skip", "mtime_match")
    none = lambda t: F.lit(None).cast(t)
    unread = j.where("action IS NOT NULL").select("path", "action", reason.alias("reason"), none("double").alias("score"), none("int").alias("source_version"), none("array<string>").alias("warnings"), none("string").alias("title"), none("string").alias("hash"), "mtime", "prev")
    need = j.where("action IS NULL").select("path", "mtime", "prev")
    arts = gate(articles(read(need.select("path", "mtime"))), limits)
    if "valid" not in arts.columns:
        arts = arts.withColumn("valid", F.lit(True))
    k = arts.join(need.select("path", "prev"), "path")
    action = (
        F.when(~F.col("valid"), "error")
        .when(may_skip & F.coalesce(same_hash, F.lit(False)), "skip")
        .when(~F.col("accepted"), "reject")
        .when(known, "update")
        .otherwise("insert")
    )
    reason = F.when(F.col("action") == "skip", "same_hash").when(F.col("action") == "error", "invalid utf-8").when(F.col("action") == "reject", F.col("messages")[0])
    taken = F.col("action").isin("insert", "update")
    k = k.withColumn("action", action)
    found = k.select(
        "path",
        "action",
        reason.alias("reason"),
        F.when(taken | (F.col("action") == "reject"), F.col("score")).alias("score"),
        F.when(taken, F.coalesce(F.col("prev.source_version"), F.lit(0)) + 1).cast("int").alias("source_version"),
        F.when(taken, F.col("messages")).alias("warnings"),
        F.when(taken, F.coalesce(F.col("fm")["title"], F.col("stem"))).alias("title"),
        "hash",
        "mtime",
        "prev",
    )
    return unread.unionByName(found)


def of(files: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(listed, read) of a table of files that is there already: the rows asked for, before anything is computed of them."""
    return files.select("path", "mtime"), lambda need: files.join(need.select("path"), "path", "left_semi")


def next_state(acts: DataFrame, run_ts: str) -> DataFrame:
    """The snapshot after a run: taken and skipped files. A rejected or failed file is forgotten, so its next success is an insert."""
    new = F.struct(
        F.col("title"), F.col("hash"), F.col("mtime").cast("double").alias("mtime"), F.col("score"), F.lit(run_ts).alias("ingested_at"),
        F.col("source_version"), F.lit(run_ts).alias("ingest_date"), F.col("warnings").alias("quality_warnings"),
    )
    old = F.struct(*[F.col("mtime").cast("double").alias("mtime") if c == "mtime" else F.col(f"prev.{c}").alias(c) for c in ("title", "hash", "mtime", "score", "ingested_at", "source_version", "ingest_date", "quality_warnings")])
    kept = acts.where(F.col("action").isin("insert", "update", "skip"))
    return kept.select("path", F.when(F.col("action") == "skip", old).otherwise(new).alias("s")).select("path", "s.*")


def summary(acts: DataFrame) -> DataFrame:
    """The run's counters, in one row."""
    n = lambda a: F.count_if(F.col("action") == a)
    return acts.agg(
        F.count_if(F.col("action") != "delete").alias("scanned"), n("insert").alias("inserted"), n("update").alias("updated"), n("skip").alias("skipped"), n("delete").alias("deleted"),
        n("error").alias("errors"), n("reject").alias("rejected"), F.count_if(F.col("action").isin("insert", "update") & (F.size("warnings") > 0)).alias("warned"),
    )


def dry_run(arts: DataFrame) -> DataFrame:
    """What would be ingested; the score is text here."""
    return arts.select("path", F.lit("would_ingest").alias("action"), score(F.col("fm"), F.col("body")).cast("string").alias("score"))


def compare(arts: DataFrame, state: DataFrame) -> DataFrame:
    """(path, status): new, stale (another time), orphaned, or synced."""
    j = arts.select("path", F.col("mtime").alias("now"), F.lit(1).alias("d")).join(state.select("path", F.col("mtime").alias("then"), F.lit(1).alias("t")), "path", "full")
    status = F.when(F.col("t").isNull(), "new").when(F.col("d").isNull(), "orphaned").when(~F.col("now").eqNullSafe(F.col("then")), "stale").otherwise("synced")
    return j.select("path", status.alias("status"))


def status(compared: DataFrame) -> DataFrame:
    """One row: counts, and whether nothing is new, stale or orphaned."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = compared.agg(F.count_if(F.col("status") != "new").alias("article_count"), F.count_if(F.col("status") != "orphaned").alias("disk_count"), n("new").alias("new_count"), n("stale").alias("stale_count"), n("orphaned").alias("orphaned_count"))
    return out.withColumn("synced", (F.col("new_count") + F.col("stale_count") + F.col("orphaned_count")) == 0)
