"""One knowledge base in folders: the operations that its tools offer, as methods that return DataFrames."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from os import environ, getcwd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import rules
from quern.functions.constants import MODES, PROJECTS, TOP_K
from quern.operators import articles as A
from quern.operators import compiling, gate, index, ingest, projects, validation
from quern.session import settle
from quern.sources import export, files, state

COMPILED = "log_name string, hash string, compiled_at string"
CONTENTS = "slug string, summary string, compiled_from string, updated string"


@dataclass
class KnowledgeBase:
    """``root`` holds the five folders of articles, ``logs`` the daily logs, ``work`` the snapshots and index.

    The clock is an argument: ``run_ts`` is an ISO time whose date part dates what is compiled. The folders may be on any file system that the
    executors reach.
    """

    spark: SparkSession
    root: str
    logs: str
    work: str
    run_ts: str
    mode: str = "developer"
    projects_dir: str = ""
    shortlist_file: str = ""
    _mode_file: str = field(default="", repr=False)
    #: Logs that the last compilation took in.
    compiled: int = field(default=0, repr=False)

    def __post_init__(self) -> None:
        self.root = environ.get("QUERN_KB_DIR", self.root)
        self.projects_dir = self.projects_dir or self.root.rpartition("/")[0]
        self.shortlist_file = self.shortlist_file or f"{self.work}/shortlist.json"
        self._mode_file = self._mode_file or f"{self.work}/mode.json"
        try:
            saved = json.loads(files.read_text(self._mode_file) or "{}").get("mode")
        except (ValueError, AttributeError):
            saved = None
        self.mode = saved if saved in MODES else self.mode

    @classmethod
    def of_project(cls, spark: SparkSession, run_ts: str, root: str | None = None) -> KnowledgeBase:
        """The base of a project folder (else of QUERN_PROJECT_ROOT, else the working folder): articles in ``kb``, logs in ``logs/daily``, state in ``.quern``."""
        root = (root or environ.get("QUERN_PROJECT_ROOT") or getcwd()).rstrip("/")
        return cls(spark, f"{root}/kb", f"{root}/logs/daily", f"{root}/.quern", run_ts, projects_dir=root.rpartition("/")[0] or "/")

    # ---- modes and rules ----

    def set_mode(self, mode: str) -> bool:
        """Whether the mode exists; if so it is kept for later sessions."""
        if mode not in MODES:
            return False
        self.mode = mode
        files.write_text(self._mode_file, json.dumps({"mode": mode}))
        return True

    def get_mode(self) -> dict:
        return {"mode": self.mode, "thresholds": gate.thresholds(self.mode), "modes": list(MODES)}

    def rules(self) -> DataFrame:
        """(path, value): how the base works, for a caller that has to find out."""
        return rules.table(self.spark)

    # ---- tables ----

    def articles(self) -> DataFrame:
        """Parsed articles; files that aren't valid text are left out."""
        return A.articles(files.knowledge_base(self.spark, self.root).where("valid"))

    def _state(self) -> DataFrame:
        return state.read(self.spark, f"{self.work}/ingest_state", ingest.STATE)

    def _compiled(self) -> DataFrame:
        return state.read(self.spark, f"{self.work}/compile_state", COMPILED)

    # ---- operations ----

    def ingest(self, force_all: bool = False, dry_run: bool = False, limits: dict | None = None) -> DataFrame:
        """What became of each file; writes the next snapshot unless it is a dry run. Files that the time tells to be known aren't read."""
        listed = files.articles_listing(self.spark, self.root)
        if dry_run:
            return ingest.dry_run(A.articles(files.read(self.spark, self.root, listed).where("valid")))
        read = lambda need: files.read(self.spark, self.root, listed.join(need.select("path"), "path", "left_semi"))
        acts = ingest.actions(listed, read, self._state(), limits or gate.thresholds(self.mode), force_all)
        # written once: files may change between two readings
        version = state.write(acts, f"{self.work}/last_ingest")
        acts = self.spark.read.parquet(f"{self.work}/last_ingest/{version}")
        state.write(ingest.next_state(acts, self.run_ts), f"{self.work}/ingest_state")
        return acts.drop("prev")

    def compile(self, file: str | None = None, dry_run: bool = False, all_logs: bool = False) -> DataFrame:
        """One row for each section that was compiled (or each log that would be), and an error for each log that can't be read; writes articles,
        contents, and last the state: a run that dies before compiles its logs again."""
        every = settle(files.logs(self.spark, self.logs), "logs")
        todo = compiling.pending(every.where("valid"), self._compiled(), all_logs, file)
        bad = every.where("NOT valid") if file is None else every.where("NOT valid").where(F.col("log_name") == file)
        names = "log_name string, pos int, slug string, action string, title string"
        broken = bad.select("log_name", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("slug"), F.lit("error").alias("action"), F.lit("invalid utf-8").alias("title"))
        self.compiled = 0
        if file is not None and every.where(F.col("log_name") == file).isEmpty():
            return self.spark.createDataFrame([(file, None, None, "error", "no such log")], names)
        if dry_run:
            return todo.select("log_name", F.lit("would_compile").alias("action"))
        date = self.run_ts[:10]
        todo = settle(todo, "todo")
        self.compiled = todo.count()
        rend = compiling.rendered(compiling.classified(compiling.sections(todo)), date)
        ups = compiling.upsert(rend, self.articles().select("path", "hash"))
        version = state.write(ups, f"{self.work}/last_compile")
        ups = self.spark.read.parquet(f"{self.work}/last_compile/{version}")
        export.write_articles(ups.where("final AND action <> 'skip'"), self.root)
        contents = state.read(self.spark, f"{self.work}/contents", CONTENTS)
        state.write(compiling.contents(contents, ups, date), f"{self.work}/contents")
        state.write(compiling.next_compile_state(self._compiled(), todo, self.run_ts), f"{self.work}/compile_state")
        return ups.select("log_name", "pos", "slug", "action", F.col("heading").alias("title")).unionByName(broken)

    def query(self, question: str, top_k: int = TOP_K, min_version: int | None = None, max_version: int | None = None) -> DataFrame:
        q = self.spark.createDataFrame([(1, question or "")], "qid long, question string")
        return index.search(q, *self._index(), k=top_k, least=min_version, most=max_version).drop("qid")

    def _index(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The stored index, built anew if any article was added, changed or removed: three tables in one version, and when it was built."""
        root, recs = f"{self.work}/index", A.records(self.articles())
        load = lambda v: tuple(self.spark.read.parquet(f"{root}/{v}/{n}") for n in ("meta", "vectors", "idf"))
        v = state.current(self.spark, root)
        if v is None or not files.exists(f"{root}/{v}/vectors") or not index.stale(recs, load(v)[0]).isEmpty():
            v = f"v-{uuid.uuid4().hex}"
            for n, df in zip(("meta", "vectors", "idf"), index.build(recs)):
                df.write.parquet(f"{root}/{v}/{n}")
            files.write_text(f"{root}/{v}/built_at", self.run_ts)
            files.write_text(f"{root}/{v}/_SUCCESS", "")
            state.point(self.spark, root, v)
        return load(v)

    def index_updated(self) -> str:
        """When the stored index was built; empty without one."""
        root = f"{self.work}/index"
        v = state.current(self.spark, root)
        return files.read_text(f"{root}/{v}/built_at") or "" if v else ""

    def context(self, question: str, top_k: int = TOP_K, max_chars: int = 8000) -> str:
        hits = self.query(question, top_k).withColumn("qid", F.lit(1))
        got = index.context(hits, self.articles(), max_chars).first()
        return got.context if got else ""

    def validate(self) -> DataFrame:
        arts = self.articles()
        return validation.validate(arts, A.links(arts), files.logs(self.spark, self.logs).where("valid"), self._compiled(), files.all_markdown(self.spark, self.root)).orderBy("check_rank", "file", "detail")

    def status(self) -> DataFrame:
        counts = ingest.status(ingest.compare(files.articles_listing(self.spark, self.root), self._state()))
        lint = validation.report(self.validate()).select(F.col("total").alias("lint_issues"))
        last = self._state().agg(F.max("ingested_at").alias("last_ingest")).crossJoin(self._compiled().agg(F.max("compiled_at").alias("last_compile")))
        return counts.crossJoin(lint).crossJoin(last)

    def scan_projects(self, folder: str, output: str | None = None, most: int = PROJECTS) -> DataFrame:
        """The ranking of the folders in ``folder``, with their paths."""
        found = settle(projects.scan(files.project_tree(self.spark, folder), projects.topics(self.articles()), most), "scan")
        found = found.withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), "name"))
        if output:
            export.write_shortlist(found, output, self.run_ts, folder)
        return found.orderBy("rank")

    def shortlist(self, path: str, min_priority: int | None = None, domain: str | None = None) -> DataFrame:
        return projects.shortlist(export.read_shortlist(self.spark, path), min_priority, domain)
