"""Project directories: what they are about, how mature they are, and in which order to take them in.

Input is one row a file: (project, rel_path, name, suffix, length, mtime, content), rel_path within the project.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import frontmatter
from quern.functions.constants import DOMAINS, MARKERS, MATURITY, PROJECTS, README_BYTES, README_CHARS, READMES, STACK, SUFFIXES, TEXT_FILES, TOPIC_BYTES, TOPIC_FILES, TREE_BYTES
from quern.session import settle

ROOT = "instr(rel_path, '/') = 0"


def projects(files: DataFrame, most: int = PROJECTS) -> DataFrame:
    """(project): directories with a marker file, a notebook, or two Python files at their root; not hidden; the first ``most`` by name."""
    root = files.where(ROOT).where(~F.col("project").startswith("."))
    is_one = F.bool_or(F.col("name").isin(MARKERS) | F.col("name").endswith(".ipynb")) | (F.count_if(F.col("name").endswith(".py")) >= 2)
    return root.groupBy("project").agg(is_one.alias("ok")).where("ok").select("project").orderBy("project").limit(most)


def text_files(files: DataFrame, most: int = TEXT_FILES) -> DataFrame:
    """Files of a text suffix, the first ``most`` of a project by path, with their place."""
    w = Window.partitionBy("project").orderBy("rel_path")
    return files.where(F.col("suffix").isin(SUFFIXES)).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def read_safe(most: int):
    """The content, empty for a file of more than ``most`` bytes."""
    return F.when(F.col("length") <= most, F.coalesce("content", F.lit(""))).otherwise("")


def domains(picked: DataFrame, most_bytes: int = TREE_BYTES, joined: bool = False) -> DataFrame:
    """(project, domain, confidence): the share of a domain's words that some file of the project holds; ties by the order of domains.

    Words are matched file by file and then united, so no project's text is put together in one row. ``joined`` matches the files' texts with
    a space between them instead, in the order of their place ``n``: words of several parts may then span two files. Only so much of
    each file as such a word can reach is put together.
    """
    words = [(d, k, w) for k, d in enumerate(DOMAINS) for w in DOMAINS[d]]
    low = picked.select("project", F.lower(read_safe(most_bytes)).alias("t"), *(["n"] if joined else []))
    if joined:
        reach = max(len(w) for _, _, w in words) - 1
        ends = low.select("project", "n", "t", F.substring("t", 1, reach).alias("head"), F.substring("t", -reach, reach).alias("tail"))
        # the ends of a file, joined to those of up to `reach` files after it: short files may lie between the parts of a word
        after = Window.partitionBy("project").orderBy("n").rowsBetween(1, reach)
        next_heads = F.substring(F.array_join(F.collect_list("head").over(after), " "), 1, reach)
        low = low.select("project", "t").union(ends.select("project", F.concat_ws(" ", "tail", next_heads).alias("t")))
    hit = F.filter(F.array(*[F.when(F.col("t").contains(w), F.lit(n)) for n, (_, _, w) in enumerate(words)]), lambda x: x.isNotNull())
    found = low.select("project", F.explode(hit).alias("n")).distinct()
    of = F.element_at(F.array(*[F.lit(k) for _, k, _ in words]), F.col("n") + 1)
    sizes = F.array(*[F.lit(len(v)) for v in DOMAINS.values()])
    names = F.array(*[F.lit(d) for d in DOMAINS])
    score = found.groupBy("project", of.alias("k")).agg(F.count("*").alias("hits")).withColumn("s", F.col("hits") / F.element_at(sizes, F.col("k") + 1))
    best = score.groupBy("project").agg(F.max(F.struct("s", (-F.col("k")).alias("k"))).alias("b"))
    return best.select("project", F.element_at(names, 1 - F.col("b.k")).alias("domain"), F.round("b.s", 2).alias("domain_confidence"))


def maturity(files: DataFrame) -> DataFrame:
    """(project, maturity): the first level of which an indicator is there: a name at any depth, or a directory for one that ends in a slash."""
    flat = [(level, k, i) for k, (level, names) in enumerate(MATURITY.items()) for i in names]
    path = F.concat(F.lit("/"), "rel_path")

    def there(i: str):
        if i.endswith("/"):
            return F.concat(path, F.when(F.instr("rel_path", "/") == 0, "/").otherwise("")).contains(f"/{i}")
        return F.concat(path, F.lit("/")).contains(f"/{i}/")

    level = F.least(*[F.when(there(i), F.lit(k)).otherwise(99) for _, k, i in flat])
    best = files.groupBy("project").agg(F.min(level).alias("k"))
    return best.select("project", F.coalesce(F.get(F.array(*[F.lit(x) for x in MATURITY]), F.col("k")), F.lit("unknown")).alias("maturity"))


def stacks(files: DataFrame) -> DataFrame:
    """(project, tech_stack): the sorted techniques of root files, or just "unknown"."""
    both = [(n, s) for s, names in STACK.items() for n in names]
    each = F.filter(F.array(*[F.when((F.instr("rel_path", "/") == 0) & (F.col("name") == n), s) for n, s in both]), lambda x: x.isNotNull())
    got = files.groupBy("project").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(each)))).alias("s"))
    return got.select("project", F.when(F.size("s") > 0, F.col("s")).otherwise(F.array(F.lit("unknown"))).alias("tech_stack"))


def topics(arts: DataFrame) -> DataFrame:
    """(topic): distinct titles and tags of articles."""
    tags = frontmatter.typed_list(F.col("fm")["tags"])
    tags = F.when(F.col("fm")["tags"].startswith("["), tags)
    one = arts.select(F.col("fm")["title"].alias("topic")).union(arts.select(F.explode(tags).alias("topic")))
    return one.where("topic IS NOT NULL").distinct()


#: Characters of topics that one automaton holds, about (some 60 bytes each); more topics take several passes over the texts.
AUTOMATON_CHARS = 1_000_000
#: The automaton that a worker process made last, by its broadcast's number.
_MACHINE: dict[int, tuple] = {}


def _machine(sent) -> tuple[ahocorasick.Automaton, list[str]]:
    """The automaton of a broadcast, and what every text holds; made once in a worker process, not in each task."""
    if (key := id(sent.value)) not in _MACHINE:
        _MACHINE.clear()
        machine = ahocorasick.Automaton()
        for w, topics_of in sent.value.items():
            if w:
                machine.add_word(w, topics_of)
        machine.make_automaton()
        _MACHINE[key] = (machine, sent.value.get("", []), sent.value)
    return _MACHINE[key][:2]


def topic_hits(low: DataFrame, kb_topics: DataFrame, most_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(project, topic) for each topic that a lower-cased text ``t`` holds, distinct.

    One pass of an Aho-Corasick automaton over the texts for every ``most_chars`` of topics; each pass sends its own topics, picked by hash, whatever
    the number of all. Texts are bounded: so many files of so many bytes a project.
    """
    lowered = kb_topics.select("topic", F.lower("topic").alias("lt"))
    chars = lowered.agg(F.coalesce(F.sum(F.length("lt") + 1), F.lit(0))).first()[0]
    passes = max(1, -(-chars // most_chars))
    if passes > 1:
        low = settle(low.select("project", "t"), "texts")
    found = None
    for p in range(passes):
        words: dict[str, list[str]] = {}
        for r in lowered.where(F.pmod(F.xxhash64("lt"), F.lit(passes)) == p).collect():
            words.setdefault(r.lt, []).append(r.topic)
        sent = low.sparkSession.sparkContext.broadcast(words)

        def match(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            machine, always = _machine(sent)
            for b in batches:
                found = set()
                for p, t in zip(b.column("project").to_pylist(), b.column("t").to_pylist()):
                    got = [*always]
                    if len(machine):
                        for _, ts in machine.iter(t or ""):
                            got += ts
                    found |= {(p, x) for x in got}
                rows = sorted(found)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["project", "topic"])

        got = low.select("project", "t").mapInArrow(match, "project string, topic string")
        found = got if found is None else found.union(got)
    return found.distinct()


def overlaps(picked: DataFrame, kb_topics: DataFrame, most_files: int = TOPIC_FILES, most_bytes: int = TOPIC_BYTES) -> DataFrame:
    """(project, topic_overlap): the share of topics that the project's first files of not too many bytes hold."""
    kb_topics = settle(kb_topics, "topics")  # else the articles would be parsed for each use
    n = kb_topics.agg(F.count("*").alias("n_topics"))
    low = picked.where(F.col("n") <= most_files).select("project", F.lower(read_safe(most_bytes)).alias("t"))
    held = topic_hits(low, kb_topics).groupBy("project").agg(F.count("*").alias("hits"))
    every = picked.select("project").distinct().join(held, "project", "left").crossJoin(F.broadcast(n))
    return every.select("project", F.when(F.col("n_topics") > 0, F.round(F.coalesce("hits", F.lit(0)) / F.col("n_topics"), 2)).otherwise(0.0).alias("topic_overlap"))


def modified(files: DataFrame) -> DataFrame:
    """(project, last_modified): the latest time of any file."""
    return files.groupBy("project").agg(F.date_format(F.max("mtime"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("last_modified")).select("project", F.regexp_replace("last_modified", "Z$", "+00:00").alias("last_modified"))


def summaries(files: DataFrame, most_bytes: int = README_BYTES, chars: int = README_CHARS) -> DataFrame:
    """(project, summary): the first line of the first README there is, of its first characters; one of too many bytes gives none."""
    rank = F.array_position(F.array(*[F.lit(x) for x in READMES]), F.col("name"))
    first = files.where(ROOT).where(F.col("name").isin(READMES)).groupBy("project").agg(F.min_by(F.struct("length", "content"), rank).alias("r"))
    said = F.when(F.col("r.length") <= most_bytes, F.coalesce("r.content", F.lit(""))).otherwise("")
    return first.select("project", F.substring_index(F.substring(said, 1, chars), "\n", 1).alias("summary"))


def prioritised(meta: DataFrame) -> DataFrame:
    """With suggested_priority (1 is first) and why."""
    strong, weak = F.col("domain_confidence") >= 0.3, F.col("domain_confidence") > 0
    ripe, alpha = F.col("maturity").isin("production", "beta"), F.col("maturity") == "alpha"
    known = (F.size("tech_stack") > 0) & ~((F.size("tech_stack") == 1) & (F.col("tech_stack")[0] == "unknown"))
    overlap, many = F.col("topic_overlap") >= 0.2, F.col("file_count") >= 20
    one = lambda c: F.when(c, 1).otherwise(0)
    points = F.when(strong, 2).when(weak, 1).otherwise(0) + F.when(ripe, 2).when(alpha, 1).otherwise(0) + one(known) + one(overlap) + one(many)
    why = F.concat_ws(
        "; ",
        F.when(strong, F.concat(F.lit("strong domain signal ("), "domain", F.lit(")"))).when(weak, F.concat(F.lit("weak domain signal ("), "domain", F.lit(")"))),
        F.when(ripe | alpha, F.concat("maturity", F.lit("-level maturity"))),
        F.when(known, F.concat(F.lit("known stack: "), F.array_join("tech_stack", ", "))),
        F.when(overlap, "high topic overlap with existing KB"),
        F.when(many, "substantial file count"),
    )
    p = F.when(points >= 6, 1).when(points >= 4, 2).when(points >= 2, 3).when(points >= 1, 4).otherwise(5)
    return meta.withColumn("suggested_priority", p).withColumn("priority_rationale", F.coalesce(F.nullif(why, F.lit("")), F.lit("no strong signals")))


def scan(files: DataFrame, kb_topics: DataFrame, most: int = PROJECTS) -> DataFrame:
    """The shortlist: every project with its metadata and rank (priority, then confidence, then name)."""
    # a bounded number of projects, read eight times below
    mine = settle(files.join(F.broadcast(projects(files, most)), "project", "left_semi"), "projects")
    picked = text_files(mine)
    out = mine.select("project").distinct()
    count = picked.groupBy("project").agg(F.count("*").cast("int").alias("file_count"))
    for part in (domains(picked), maturity(mine), stacks(mine), modified(mine), overlaps(picked, kb_topics), count, summaries(mine)):
        out = out.join(part, "project", "left")
    out = out.select(
        F.col("project").alias("name"), F.coalesce("domain", F.lit("unknown")).alias("domain"), F.coalesce("domain_confidence", F.lit(0.0)).alias("domain_confidence"), "maturity", "tech_stack", "last_modified",
        F.coalesce("topic_overlap", F.lit(0.0)).alias("topic_overlap"), F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("summary", F.lit("")).alias("summary"),
    )
    return prioritised(out).withColumn("rank", F.row_number().over(Window.orderBy("suggested_priority", F.desc("domain_confidence"), "name")))


def shortlist(scanned: DataFrame, min_priority: int | None = None, domain: str | None = None) -> DataFrame:
    if domain is not None:
        scanned = scanned.where(F.col("domain") == domain)
    if min_priority is not None:
        scanned = scanned.where(F.coalesce("suggested_priority", F.lit(5)) <= min_priority)
    return scanned
