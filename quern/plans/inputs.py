"""Knowledge-base inputs rendered from the driver's tables: test input, not operators.

Each rule is written once as Spark expressions and once as SQL, from whole tables and whole texts. Residues of the ids
choose which fields, links and changes an article has, so that every branch of the operators occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import spread

RUN_DATE, RUN_TS = "2026-05-01", "2026-05-01T00:00:00+00:00"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


_FILES = r"""
SELECT concat(subdir, '/', stem, '.md') AS path, doc_id, lang, source,
    concat(fm, text, '\n\nSee ', concat_ws(' ',
        CASE WHEN doc_id % 10 <> 4 THEN concat('[[', elt(cast((doc_id - doc_id % 10 + (doc_id + 1) % 10) % 5 + 1 AS int), 'concepts', 'connections', 'mechanisms', 'outcomes', 'references'), '/doc-', doc_id - doc_id % 10 + (doc_id + 1) % 10, ']]') END,
        CASE WHEN doc_id % 10 IN (1, 2, 3) THEN concat('[[', elt(cast((doc_id - 1) % 5 + 1 AS int), 'concepts', 'connections', 'mechanisms', 'outcomes', 'references'), '/doc-', doc_id - 1, ']]') END,
        CASE WHEN doc_id % 7 = 0 THEN concat('[[doc-', doc_id + 3, ']]') END,
        CASE WHEN doc_id % 11 = 0 THEN concat('[[concepts/missing-', doc_id, ']]') END,
        CASE WHEN doc_id % 13 = 0 THEN concat('[[daily/log-', doc_id % 50, '.md]]') END,
        CASE WHEN doc_id % 17 = 0 THEN concat('[[', subdir, '/', stem, ']]') END), '\n') AS content,
    cast(1767225600 + doc_id AS double) AS mtime
FROM (SELECT *, doc_id % 12 AS r, concat('doc-', doc_id) AS stem,
        elt(cast(doc_id % 5 + 1 AS int), 'concepts', 'connections', 'mechanisms', 'outcomes', 'references') AS subdir,
        CASE WHEN doc_id % 12 = 0 THEN '' WHEN doc_id % 12 = 11 THEN '---\ntitle: never closed\n' ELSE concat(concat_ws('\n', '---',
            CASE WHEN doc_id % 12 <> 1 THEN concat('title: "Document ', doc_id, ' in ', lang, '"') END,
            CASE WHEN doc_id % 12 <> 4 THEN 'type: concept' END,
            CASE WHEN doc_id % 12 NOT IN (2, 4) THEN concat('tags: [', lang, ', "', source, '", ]') END,
            CASE WHEN doc_id % 12 = 6 THEN concat('aliases: plain', doc_id) END,
            CASE WHEN doc_id % 12 = 7 THEN concat('sources: ["daily/log-', doc_id % 80, '.md"]') WHEN doc_id % 12 NOT IN (3, 4) THEN concat('sources: [daily/log-', doc_id % 80, '.md]') END,
            concat('updated: 2026-', lpad(cast(doc_id % 12 + 1 AS string), 2, '0'), '-', lpad(cast(doc_id % 28 + 1 AS string), 2, '0')),
            CASE WHEN doc_id % 12 = 9 THEN 'source_version: none' ELSE concat('source_version: ', 1 + doc_id % 5) END,
            CASE WHEN doc_id % 12 = 8 THEN 'summary: one --- two' END,
            CASE WHEN doc_id % 12 = 10 THEN concat('title: Other ', doc_id) END, '---'), '\n\n') END AS fm
    FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"""


def _duck(sql: str) -> str:
    """The Spark text of a rule as DuckDB reads it."""
    sql = sql.replace(r"'\n\nSee '", "(chr(10) || chr(10) || 'See ')").replace(r"'---\ntitle: never closed\n'", "('---' || chr(10) || 'title: never closed' || chr(10))")
    sql = sql.replace(r"'\n\n'", "(chr(10) || chr(10))").replace(r"'\n'", "chr(10)").replace("AS string)", "AS varchar)")
    names = "'concepts', 'connections', 'mechanisms', 'outcomes', 'references')"
    out = ""
    while "elt(" in sql:
        a = sql.index("elt(")
        b = sql.index(names, a)
        out += sql[:a] + "(['concepts', 'connections', 'mechanisms', 'outcomes', 'references'])[" + sql[a + 4 : b].strip().rstrip(",") + "]"
        sql = sql[b + len(names) :]
    return out + sql


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, doc_id, lang, source, content, mtime)."""
    return spark.sql(_FILES.replace("FROM documents", "FROM {documents}"), documents=_table(spark, sf_dir, "documents"))


FILES_SQL = _duck(_FILES)

HEADINGS = ["Mechanism of topic", "Connections", "Outcome & result", "Reference desk", "Loose notes", "Pattern_language - one"]


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_name, conv_id, content): one log for each conversation, one section for each turn."""
    head = F.element_at(F.array(*[F.lit(h) for h in HEADINGS]), (F.col("turn") % 6 + 1).cast("int"))
    part = F.concat(F.lit("## "), head, F.lit(" "), F.col("conv_id") % 40, F.lit("\n\n"), "text", F.lit("\n- "), "role", F.lit(" said so\n  - turn "), "turn", F.lit("\n"))
    c = _table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    c = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("p"))
    return c.select(F.concat(F.lit("log-"), "conv_id", F.lit(".md")).alias("log_name"), "conv_id", F.concat(F.lit("preamble\n"), F.array_join(F.transform("p", lambda x: x["part"]), "\n")).alias("content"))


LOGS_SQL = f"""
SELECT 'log-' || conv_id || '.md' AS log_name, conv_id, 'preamble' || chr(10) || string_agg('## ' || ({HEADINGS!r})[turn % 6 + 1] || ' ' || (conv_id % 40) || chr(10) || chr(10) || text || chr(10) || '- ' || role || ' said so' || chr(10) || '  - turn ' || turn || chr(10), chr(10) ORDER BY turn) AS content
FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL GROUP BY conv_id"""


def compile_state(logs_with_hash: DataFrame) -> DataFrame:
    """(log_name, hash, compiled_at): a third is untracked, a third up to date, a third changed."""
    h = F.when(F.col("conv_id") % 3 == 1, F.col("hash")).otherwise("0000000000000000")
    return logs_with_hash.where("conv_id % 3 > 0").select("log_name", h.alias("hash"), F.lit(RUN_TS).alias("compiled_at"))


def ingest_state(arts: DataFrame) -> DataFrame:
    """The snapshot of an earlier run over articles that carry doc_id: residues are new, changed, touched, or deleted since."""
    r = F.col("doc_id") % 10
    kept = arts.where(r > 0).select(
        F.when(r == 4, F.concat(F.lit("outcomes/ghost-"), "doc_id", F.lit(".md"))).otherwise(F.col("path")).alias("path"),
        F.lit("before").alias("title"),
        F.when(r.isin(1, 3), "ffffffffffffffff").otherwise(F.col("hash")).alias("hash"),
        (F.col("mtime") - F.when(r.isin(1, 2), 60).otherwise(0)).alias("mtime"),
        F.lit(0.4).alias("score"),
        F.lit("2026-04-01T00:00:00+00:00").alias("ingested_at"),
        (F.col("doc_id") % 3 + 1).cast("int").alias("source_version"),
        F.lit("2026-04-01T00:00:00+00:00").alias("ingest_date"),
        F.array().cast("array<string>").alias("quality_warnings"),
    )
    return kept


STATE_SQL = """
SELECT CASE WHEN doc_id % 10 = 4 THEN 'outcomes/ghost-' || doc_id || '.md' ELSE path END AS path, 'before' AS title,
    CASE WHEN doc_id % 10 IN (1, 3) THEN 'ffffffffffffffff' ELSE hash END AS hash, mtime - CASE WHEN doc_id % 10 IN (1, 2) THEN 60 ELSE 0 END AS mtime,
    0.4::DOUBLE AS score, (doc_id % 3 + 1)::INT AS source_version FROM arts WHERE doc_id % 10 > 0"""

_MARKS = {0: ["README.md"], 1: ["pyproject.toml", "src/a.py"], 2: ["a.py", "b.py"], 3: ["Dockerfile", "tests/test_a.py"], 4: ["x.ipynb"], 5: [".github/workflows/ci.yml", "Cargo.toml"], 6: ["src/only.py"], 7: ["go.mod", "Makefile", "scratch/n.txt", "README"]}


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the files of their host's project, with marker files by residue of the host's first page."""
    p = _table(spark, sf_dir, "pages").where("page_id IS NOT NULL AND url IS NOT NULL")
    p = p.withColumn("project", F.regexp_extract("url", "^https?://([^/?#]+)", 1)).withColumn("rel", F.regexp_extract("url", "^https?://[^/?#]+/([^?#]*)", 1))
    pages = p.select("project", F.concat_ws("/", F.nullif(F.col("rel"), F.lit("")), F.concat(F.lit("page-"), "page_id", F.lit(".html"))).alias("rel_path"), F.coalesce("html", F.lit("")).alias("content"), "page_id")
    by = F.array(*[F.array(*[F.lit(x) for x in _MARKS[k]]) for k in sorted(_MARKS)])
    marks = p.groupBy("project").agg(F.min("page_id").alias("page_id")).select("project", F.explode(F.element_at(by, (F.col("page_id") % 8 + 1).cast("int"))).alias("rel_path"), F.concat(F.lit("about "), "project", F.lit("\na test pipeline and its storage")).alias("content"), "page_id")
    f = pages.union(marks.select("project", "rel_path", "content", "page_id")).withColumn("name", F.substring_index("rel_path", "/", -1))
    return f.select("project", "rel_path", "name", F.regexp_extract("name", r"[^.](\.[^.]+)$", 1).alias("suffix"), F.octet_length("content").cast("long").alias("length"), F.timestamp_seconds(1767225600 + F.col("page_id")).alias("mtime"), "content")


PROJECTS_SQL = f"""
SELECT project, rel_path, name, regexp_extract(name, '[^.](\\.[^.]+)$', 1) AS suffix, octet_length(encode(content)) AS length, 1767225600 + page_id AS mtime, content FROM (
    SELECT project, rel_path, content, page_id, split_part(rel_path, '/', -1) AS name FROM (
        SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS project, concat_ws('/', nullif(regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1), ''), 'page-' || page_id || '.html') AS rel_path, coalesce(html, '') AS content, page_id FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL
        UNION ALL SELECT project, unnest(({[_MARKS[k] for k in sorted(_MARKS)]!r})[page_id % 8 + 1]), 'about ' || project || chr(10) || 'a test pipeline and its storage', page_id
        FROM (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS project, min(page_id) AS page_id FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL GROUP BY 1)))"""


def article_files(docs: DataFrame) -> DataFrame:
    """(path, content): documents as files whose names are hidden, private or need quoting, by residue; each seventh isn't UTF-8."""
    name = r"""elt(cast(doc_id % 6 + 1 AS int), concat('doc-', doc_id), concat('_doc-', doc_id), concat('.doc-', doc_id), concat('100%-', doc_id), concat('a%20b-', doc_id), concat('doc ', doc_id, '+é'))"""
    d = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["doc_id"])
    path = F.expr(f"concat(elt(cast(doc_id % 5 + 1 AS int), 'concepts', 'connections', 'mechanisms', 'outcomes', 'references'), '/', {name}, '.md')")
    raw = F.encode("text", "UTF-8")
    return d.select(path.alias("path"), F.when(F.col("doc_id") % 7 == 0, F.concat(raw, F.lit(bytearray(b"\xff\xfe")))).otherwise(raw).alias("content"))


SOURCE_ARTICLES_SQL = """
SELECT (['concepts', 'connections', 'mechanisms', 'outcomes', 'references'])[doc_id % 5 + 1] || '/' || (['doc-' || doc_id, '_doc-' || doc_id, '.doc-' || doc_id, '100%-' || doc_id, 'a%20b-' || doc_id, 'doc ' || doc_id || '+é'])[doc_id % 6 + 1] || '.md' AS path,
    doc_id % 7 <> 0 AS valid, CASE WHEN doc_id % 7 <> 0 THEN md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) END AS content_md5
FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL"""

_TREE = ["page-{}.html", ".github/workflows/page-{}.yml", "pkg/{}/__init__.py", "_conf/100%-{}.yml", "a%20b/{}.md", "noext/{}"]


def tree_files(pages: DataFrame) -> DataFrame:
    """(path, content): pages as files of fifty projects, names by residue."""
    at = F.array(*[F.concat(F.lit(t.split("{}")[0]), "page_id", F.lit(t.split("{}")[1])) for t in _TREE])
    p = pages.where("page_id IS NOT NULL AND html IS NOT NULL").dropDuplicates(["page_id"])
    return p.select(F.concat(F.lit("p-"), F.col("page_id") % 50, F.lit("/"), F.element_at(at, (F.col("page_id") % len(_TREE) + 1).cast("int"))).alias("path"), F.col("html").alias("content"))


SOURCE_TREE_SQL = f"""
SELECT project, rel_path, split_part(rel_path, '/', -1) AS name, regexp_extract(split_part(rel_path, '/', -1), '[^.](\\.[^.]+)$', 1) AS suffix, length,
    CASE WHEN length <= 50000 THEN md5(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10))) END AS content_md5
FROM (SELECT 'p-' || page_id % 50 AS project, ([{", ".join("'" + t.replace("{}", "' || page_id || '") + "'" for t in _TREE)}])[page_id % {len(_TREE)} + 1] AS rel_path, octet_length(encode(html)) AS length, html FROM pages WHERE page_id IS NOT NULL AND html IS NOT NULL)"""

SOURCE_LOGS_SQL = "SELECT '_' || log_name AS log_name, true AS valid, md5(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS content_md5 FROM logs"
