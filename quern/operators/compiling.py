"""Daily logs into articles: sections, classes, rendering, upserts, and the table of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.constants import KEY_POINTS, SECTION_WORDS
from quern.session import numbered


def sections(logs: DataFrame) -> DataFrame:
    """(log_name, pos, heading, body) of every ``## `` heading; what precedes the first is dropped, deeper headings stay in the body."""
    joined = F.concat(F.lit("\n"), F.array_join(text.lines(text.newlines(F.coalesce("content", F.lit("")))), "\n"))
    parts = F.split(joined, "\n## ")
    parts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    s = logs.select("log_name", F.posexplode(parts).alias("pos", "part"))
    cut = F.instr("part", "\n")
    head = F.when(cut > 0, F.col("part").substr(F.lit(1), cut - 1)).otherwise(F.col("part"))
    rest = F.when(cut > 0, F.col("part").substr(cut + 1, F.length("part"))).otherwise("")
    return s.select("log_name", "pos", text.strip(head).alias("heading"), text.strip(rest).alias("body"))


def article_type(heading: Column) -> Column:
    h = F.lower(heading)
    has = lambda *w: F.greatest(*[h.contains(x) for x in w]) if len(w) > 1 else h.contains(w[0])
    return (
        F.when(has("connection", "link"), "connection")
        .when(has("mechanism", "pattern"), "mechanism")
        .when(has("outcome", "result", "validation"), "outcome")
        .when(has("reference", "resource"), "reference")
        .otherwise("concept")
    )


def classified(secs: DataFrame, least: int = SECTION_WORDS) -> DataFrame:
    """Sections of at least ``least`` words, with type, folder and slug."""
    s = secs.where(text.word_count(F.col("body")) >= least).withColumn("article_type", article_type(F.col("heading")))
    return s.withColumn("subdir", F.concat("article_type", F.lit("s"))).withColumn("slug", text.slug(F.col("heading")))


def frontmatter_text(title: Column, kind: Column, run_date: Column, source: Column, log_name: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit('title: "'), title, F.lit('"')),
        F.concat(F.lit("type: "), kind),
        F.concat(F.lit("tags: ["), kind, F.lit("]")),
        F.concat(F.lit("sources: ["), source, F.lit("]")),
        F.concat(F.lit("created: "), run_date),
        F.concat(F.lit("updated: "), run_date),
        F.lit("source_version: 1"),
        F.concat(F.lit("ingest_date: "), run_date),
        F.concat(F.lit('historical_context: "Compiled from daily log '), log_name, F.lit('"')),
        F.lit("---"),
    )


def rendered(classed: DataFrame, run_date: str) -> DataFrame:
    """With path and whole article text, as of ``run_date``."""
    fm = frontmatter_text(F.col("heading"), F.col("article_type"), F.lit(run_date), F.concat(F.lit("daily/"), "log_name"), F.col("log_name"))
    body = F.concat(F.lit("## Key Points\n\n"), text.key_points(F.col("body"), KEY_POINTS), F.lit("\n\n## Details\n\n"), "body")
    return classed.withColumn("path", F.concat("subdir", F.lit("/"), "slug", F.lit(".md"))).withColumn("content", F.concat(fm, F.lit("\n\n"), body, F.lit("\n")))


def upsert(rend: DataFrame, existing: DataFrame) -> DataFrame:
    """(log_name, pos, path, slug, heading, content, action, final): create, update or skip, in the order of log and section.

    Sections that share a path write one after the other: each is compared with the one before it, the first with the
    file that exists; the last is the one that stays.
    """
    w = Window.partitionBy("path").orderBy("log_name", "pos")
    r = rend.withColumn("hash", text.content_hash(F.col("content"))).join(existing.select("path", F.col("hash").alias("there")), "path", "left")
    before = F.coalesce(F.lag("hash").over(w), F.col("there"))
    r = r.withColumn("action", F.when(before.isNull(), "create").when(before == F.col("hash"), "skip").otherwise("update"))
    back = Window.partitionBy("path").orderBy(F.desc("log_name"), F.desc("pos"))
    return r.withColumn("final", F.row_number().over(back) == 1).select("log_name", "pos", "path", "subdir", "slug", "heading", "content", "hash", "action", "final")


def pending(logs: DataFrame, state: DataFrame, all_logs: bool = False, file: str | None = None) -> DataFrame:
    """Logs to compile: a named one, all, or those without the hash of their last compilation."""
    logs = logs.withColumn("hash", text.content_hash(text.newlines(F.coalesce("content", F.lit("")))))
    if file is not None:
        return logs.where(F.col("log_name") == file)
    if all_logs:
        return logs
    then = state.select("log_name", F.col("hash").alias("then"))
    return logs.join(then, "log_name", "left").where(~F.col("hash").eqNullSafe(F.col("then"))).drop("then")


def summary(logs: DataFrame, ups: DataFrame) -> DataFrame:
    """One row: files processed, articles created, updated, skipped, and logs that couldn't be read (``valid`` false)."""
    n = lambda a: F.count_if(F.col("action") == a)
    bad = F.count_if(~F.col("valid")) if "valid" in logs.columns else F.lit(0).cast("long")
    return logs.agg(F.count("*").alias("files_processed"), bad.alias("errors")).crossJoin(ups.agg(n("create").alias("articles_created"), n("update").alias("articles_updated"), n("skip").alias("articles_skipped")))


def next_compile_state(prev: DataFrame, done: DataFrame, run_ts: str) -> DataFrame:
    """Compiled logs with their hash; entries of other logs are carried over."""
    return prev.join(done.select("log_name"), "log_name", "left_anti").select("log_name", "hash", "compiled_at").union(done.select("log_name", "hash", F.lit(run_ts)))


def contents(prev: DataFrame, ups: DataFrame, run_date: str) -> DataFrame:
    """(slug, summary, compiled_from, updated): a known entry only gets the new date, a new one is what its first writer says."""
    wrote = ups.where("action <> 'skip'")
    first = wrote.groupBy(F.regexp_replace("path", r"\.md$", "").alias("slug")).agg(F.min_by(F.struct("heading", "log_name"), F.struct("log_name", "pos")).alias("by"))
    j = prev.join(first, "slug", "full")
    return j.select(
        "slug",
        F.coalesce("summary", "by.heading").alias("summary"),
        F.coalesce("compiled_from", F.concat(F.lit("daily/"), "by.log_name")).alias("compiled_from"),
        F.when(F.col("by").isNotNull(), F.lit(run_date)).otherwise(F.col("updated")).alias("updated"),
    )


def contents_text(table: DataFrame) -> DataFrame:
    """(pos, line): the table of contents as markdown rows, ordered by slug."""
    line = F.concat(F.lit("| [["), "slug", F.lit("]] | "), "summary", F.lit(" | "), "compiled_from", F.lit(" | "), "updated", F.lit(" |"))
    return numbered(table, "slug").select("pos", line.alias("line"))


def read_contents(lines: DataFrame) -> DataFrame:
    """The rows of a markdown table of contents (pos, line): those that open with a link and have enough cells; the last of a slug holds."""
    cells = F.transform(F.split("line", r"\|"), text.strip)
    t = lines.where(F.col("line").startswith("| [[")).withColumn("c", cells).where(F.size("c") >= 5)
    slug = F.replace(F.replace(F.col("c")[1], F.lit("[["), F.lit("")), F.lit("]]"), F.lit(""))
    t = t.groupBy(slug.alias("slug")).agg(F.max_by("c", "pos").alias("c"))
    return t.select("slug", F.col("c")[2].alias("summary"), F.col("c")[3].alias("compiled_from"), F.col("c")[4].alias("updated"))
