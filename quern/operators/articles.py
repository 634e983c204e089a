"""Articles: files of a knowledge base with their frontmatter parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import frontmatter, text


def articles(files: DataFrame) -> DataFrame:
    """(path, subdir, stem, content, mtime, head, fm, body, hash) of files (path, content, mtime); line ends are translated first.

    A null content counts as empty. A flag ``valid`` of the files is kept.
    """
    flag = ["valid"] if "valid" in files.columns else []
    f = files.select("path", text.newlines(F.coalesce("content", F.lit(""))).alias("content"), "mtime", *flag)
    f = f.withColumn("__end", frontmatter.end(F.col("content")))
    f = f.withColumn("head", frontmatter.head(F.col("content"), F.col("__end")))
    return f.select(
        "path",
        F.substring_index("path", "/", 1).alias("subdir"),
        F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "").alias("stem"),
        "content",
        "mtime",
        "head",
        frontmatter.fields(F.col("head")).alias("fm"),
        frontmatter.body(F.col("content"), F.col("__end")).alias("body"),
        text.content_hash(F.col("content")).alias("hash"),
        *flag,
    )


def records(arts: DataFrame) -> DataFrame:
    """What the search index keeps of each article, and the text that is searched (metadata counts twice)."""
    fm = lambda k: F.col("fm")[k]
    many = lambda k: F.coalesce(frontmatter.typed_list(fm(k)), F.array().cast("array<string>"))
    out = arts.select(
        "path",
        F.coalesce(fm("title"), F.col("stem")).alias("title"),
        F.coalesce(fm("summary"), F.lit("")).alias("summary"),
        many("tags").alias("tags"),
        many("aliases").alias("aliases"),
        many("sources").alias("sources"),
        F.coalesce(fm("updated"), F.lit("")).alias("updated"),
        F.coalesce(F.coalesce(fm("source_version"), F.lit("1")).try_cast("int"), F.lit(1)).alias("source_version"),
        F.coalesce(fm("ingest_date"), F.lit("")).alias("ingest_date"),
        "hash",
        "content",
    )
    joined = lambda c: F.when(F.size(c) > 0, F.concat_ws(" ", c))
    return out.withColumn("searchable", F.concat_ws(" ", "title", joined("tags"), joined("aliases"), joined("sources"), "content"))


def links(arts: DataFrame) -> DataFrame:
    """(path, src_link, pos, link): every wikilink of the content, in order."""
    return arts.select("path", text.link_of(F.col("path")).alias("src_link"), F.posexplode(text.wikilinks(F.col("content"))).alias("pos", "link"))
