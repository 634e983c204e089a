"""The ten tools of a base as functions that return an envelope: ``ok``, counters and settings as plain values, and what may be long as DataFrames."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.constants import MODES, TOP_K
from quern.kb import KnowledgeBase
from quern.operators import compiling, ingest as ingesting, validation
from quern.rules import rules
from quern.sources import export, files


def _missing(what: str, where: str) -> dict:
    return {"ok": False, "error": f"{what} not found: {where}"}


def set_mode(kb: KnowledgeBase, mode: str) -> dict:
    if not kb.set_mode(mode):
        return {"ok": False, "error": f"no mode {mode!r}; there are {', '.join(MODES)}"}
    return {"ok": True, **kb.get_mode()}


def get_mode(kb: KnowledgeBase) -> dict:
    return {"ok": True, **kb.get_mode()}


def ingest(kb: KnowledgeBase, force_all: bool = False, dry_run: bool = False, limits: dict | None = None) -> dict:
    if not files.exists(kb.root):
        return _missing("knowledge base", kb.root)
    acts = kb.ingest(force_all, dry_run, limits)
    counters = {"scanned": acts.count()} if dry_run else ingesting.summary(acts).first().asDict()
    return {"ok": True, **counters, "details": acts}


def compile(kb: KnowledgeBase, all_logs: bool = False, file: str | None = None, dry_run: bool = False) -> dict:
    if not files.exists(kb.logs):
        return _missing("logs", kb.logs)
    done = kb.compile(file, dry_run, all_logs)
    n = lambda a: F.count_if(F.col("action") == a)
    seen = F.count_distinct(F.when(F.col("action") != "error", F.col("log_name"))) if dry_run else F.lit(kb.compiled)
    c = done.agg(seen.alias("files_processed"), n("create").alias("articles_created"), n("update").alias("articles_updated"), n("skip").alias("articles_skipped"), n("error").alias("errors")).first()
    return {"ok": True, **c.asDict(), "details": done}


def query(kb: KnowledgeBase, question: str, top_k: int = TOP_K, min_version: int | None = None, max_version: int | None = None) -> dict:
    if not files.exists(kb.root):
        return _missing("knowledge base", kb.root)
    hits = kb.query(question, top_k, min_version, max_version)
    return {"ok": True, "question": question, "results": [r.asDict() for r in hits.orderBy("rank").collect()], "index_updated": kb.index_updated()}


def validate(kb: KnowledgeBase) -> dict:
    if not files.exists(kb.root):
        return _missing("knowledge base", kb.root)
    issues = kb.validate()
    return {"ok": True, **validation.report(issues).first().asDict(), "issues": issues}


def status(kb: KnowledgeBase) -> dict:
    return {"ok": True, "mode": kb.mode, **kb.status().first().asDict()}


def get_rules(kb: KnowledgeBase) -> dict:
    return rules()


def scan_prototypes(kb: KnowledgeBase, scan_dir: str | None = None, output_file: str | None = None) -> dict:
    folder, out = scan_dir or kb.projects_dir, output_file or kb.shortlist_file
    found = kb.scan_projects(folder, out)
    rows = [r.asDict() for r in found.drop("rank").collect()]  # a scan has a bounded number of projects
    return {"ok": True, "scanned_at": kb.run_ts, "root_directory": folder, "prototypes_found": len(rows), "shortlist_path": out, "prototypes": rows}


def get_shortlist(kb: KnowledgeBase, shortlist_path: str | None = None, domain: str | None = None, min_priority: int | None = None) -> dict:
    path = shortlist_path or kb.shortlist_file
    d = export.shortlist_document(kb.spark, path)
    if d is None:
        return _missing("shortlist", path)
    head = d.first()
    rows = [r.asDict() for r in kb.shortlist(path, min_priority, domain).orderBy("rank").drop("rank").collect()]
    return {"ok": True, "scanned_at": head.scanned_at, "root_directory": head.root_directory, "prototypes_found": len(rows), "total_in_shortlist": head.prototypes_found, "prototypes": rows}


TOOLS = {f.__name__: f for f in (set_mode, get_mode, ingest, compile, query, validate, status, get_rules, scan_prototypes, get_shortlist)}
