"""Six checks of the link graph, of lineage and of freshness. Each gives (severity, check, file, detail, auto_fixable)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.constants import SPARSE_WORDS, SUBDIRS

CHECKS = ["broken_link", "orphan_page", "orphan_source", "stale_article", "missing_backlink", "sparse_article"]


def _issue(df: DataFrame, severity: str, check: str, file: Column, detail: Column, fixable: bool = False) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), file.alias("file"), detail.alias("detail"), F.lit(fixable).alias("auto_fixable"))


def _told(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def broken_links(links: DataFrame, arts: DataFrame, all_paths: DataFrame | None = None) -> DataFrame:
    """A link with a slash names any markdown file of the base by its path, another one an article by its stem."""
    known = (all_paths if all_paths is not None else arts).select(F.regexp_replace("path", r"\.md$", "").alias("link")).where(F.col("link").contains("/"))
    stems = arts.select(F.col("stem").alias("link")).where(~F.col("link").contains("/"))
    bad = links.where(~F.col("link").startswith("daily/")).join(known.union(stems).distinct(), "link", "left_anti")
    return _issue(bad, "error", "broken_link", F.col("path"), _told("Broken link: [[", F.col("link"), "]] has no target"))


def orphan_pages(links: DataFrame, arts: DataFrame) -> DataFrame:
    """Articles that no link names by their full path; their own links count."""
    named = links.where(~F.col("link").startswith("daily/")).select(F.col("link").alias("src_link")).distinct()
    lone = arts.select("path", text.link_of(F.col("path")).alias("src_link")).join(named, "src_link", "left_anti")
    return _issue(lone, "warning", "orphan_page", F.col("path"), _told("Orphan page: nothing links to [[", F.col("src_link"), "]]"))


def source_refs(arts: DataFrame) -> DataFrame:
    """(log_name): what follows ``daily/`` up to a closing bracket in the sources lines of frontmatter."""
    lines = F.filter(F.transform(text.lines(F.coalesce("head", F.lit(""))), text.strip), lambda x: x.startswith("sources:"))
    return arts.select(F.explode(lines).alias("line")).select(F.explode(F.regexp_extract_all("line", F.lit(r"daily/([^\x5D]+)\x5D"), F.lit(1))).alias("log_name")).distinct()


def orphan_sources(logs: DataFrame, arts: DataFrame) -> DataFrame:
    lone = logs.select("log_name").join(source_refs(arts), "log_name", "left_anti")
    return _issue(lone, "warning", "orphan_source", _told("daily/", F.col("log_name")), _told("Uncompiled log: no article refers to ", F.col("log_name")))


def stale_articles(logs: DataFrame, compile_state: DataFrame) -> DataFrame:
    now = logs.select("log_name", text.content_hash(text.newlines(F.coalesce("content", F.lit("")))).alias("now"))
    old = now.join(compile_state.select("log_name", "hash"), "log_name").where((F.col("hash") != "") & (F.col("hash") != F.col("now")))
    return _issue(old, "warning", "stale_article", _told("daily/", F.col("log_name")), _told("Stale: ", F.col("log_name"), " changed after it was compiled"))


def missing_backlinks(links: DataFrame, arts: DataFrame) -> DataFrame:
    """Links whose target doesn't name the source by its full path; one row for each occurrence.

    A bare link means the article of that stem in the first folder that has one.
    """
    used = links.where(~F.col("link").startswith("daily/") & ~F.col("link").contains("..") & ~F.col("link").startswith("/"))
    rank = F.array_position(F.array(*[F.lit(s) for s in SUBDIRS]), F.col("subdir"))
    by_stem = arts.groupBy(F.col("stem").alias("link")).agg(F.min_by("path", rank).alias("target")).where(~F.col("link").contains("/"))
    by_path = arts.select(F.regexp_replace("path", r"\.md$", "").alias("link"), F.col("path").alias("target"))
    resolved = used.join(by_path.union(by_stem), "link")
    back = links.select(F.col("path").alias("target"), F.col("link").alias("src_link")).distinct()
    lone = resolved.join(back, ["target", "src_link"], "left_anti")
    return _issue(lone, "suggestion", "missing_backlink", F.col("path"), _told("[[", F.col("src_link"), "]] links to [[", F.col("link"), "]], which doesn't link back"), True)


def sparse_articles(arts: DataFrame, least: int = SPARSE_WORDS) -> DataFrame:
    """Articles whose whole file, frontmatter included, has too few words."""
    few = arts.select("path", text.word_count(F.col("content")).alias("n")).where(F.col("n") < least)
    return _issue(few, "suggestion", "sparse_article", F.col("path"), _told("Sparse article: ", F.col("n").cast("string"), f" words of {least} recommended"))


def validate(arts: DataFrame, links: DataFrame, logs: DataFrame, compile_state: DataFrame, all_paths: DataFrame | None = None) -> DataFrame:
    """All issues, with the rank of their check."""
    parts = [broken_links(links, arts, all_paths), orphan_pages(links, arts), orphan_sources(logs, arts), stale_articles(logs, compile_state), missing_backlinks(links, arts), sparse_articles(arts)]
    return reduce(DataFrame.unionByName, parts).withColumn("check_rank", F.array_position(F.array(*[F.lit(c) for c in CHECKS]), F.col("check")))


def report(issues: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s)
    out = issues.agg(n("error").alias("errors"), n("warning").alias("warnings"), n("suggestion").alias("suggestions"), F.count("*").alias("total"))
    return out.withColumn("is_healthy", F.col("errors") == 0)
