import os

import pytest

from quern.kb import KnowledgeBase
from quern.operators import ingest as ingest_op
from quern.sources import files, state
from quern import tools
from quern.sources import export
from quern.streaming.ingest import file_stream, ingest_stream

BODY = "useful words on gardens and seeds " * 12


@pytest.fixture
def kb(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "kb").mkdir()
    (tmp_path / "logs" / "d1.md").write_text(f"## Seeds\n- sow early\n{BODY}\n## Mechanism of growth\n{BODY}\n")
    return KnowledgeBase(spark, str(tmp_path / "kb"), str(tmp_path / "logs"), str(tmp_path / "work"), "2026-05-01T10:00:00+00:00")


def test_compile_ingest_query_validate_status(kb, tmp_path):
    assert [r.action for r in kb.compile(dry_run=True).collect()] == ["would_compile"]
    assert {(r.slug, r.action) for r in kb.compile().collect()} == {("seeds", "create"), ("mechanism-of-growth", "create")}
    assert [(r.log_name, r.action) for r in kb.compile(file="none.md").collect()] == [("none.md", "error")]
    assert {r.action for r in kb.compile(file="d1.md").collect()} == {"skip"}
    assert kb.compile().count() == 0 and (tmp_path / "kb/concepts/seeds.md").is_file()
    assert {r.action for r in kb.ingest(dry_run=True).collect()} == {"would_ingest"}
    assert {r.action for r in kb.ingest().collect()} == {"insert"} and {r.action for r in kb.ingest().collect()} == {"skip"}
    (tmp_path / "kb/concepts/bad.md").write_bytes(b"\xff\xfe not text")
    assert {(r.path, r.action) for r in kb.ingest().collect()} >= {("concepts/bad.md", "error")}
    os.remove(tmp_path / "kb/concepts/bad.md")
    hit = kb.query("sow seeds").first()
    assert hit.path == "concepts/seeds.md" and "## concepts/seeds" in kb.context("sow")
    (tmp_path / "kb/concepts/new.md").write_text("---\ntitle: Zebra\n---\nzebra stripes " + "[[concepts/seeds]] [[gone]]")
    assert kb.query("zebra stripes").first().path == "concepts/new.md"
    checks = {r.check for r in kb.validate().collect()}
    assert "broken_link" in checks and "missing_backlink" in checks and "orphan_source" not in checks
    s = kb.status().first()
    assert (s.article_count, s.disk_count, s.new_count, s.synced) == (2, 3, 1, False) and s.lint_issues > 0 and s.last_compile == kb.run_ts


def test_modes_rules_and_projects(kb, tmp_path, spark):
    assert kb.set_mode("review") and not kb.set_mode("nope") and kb.get_mode()["mode"] == "review"
    assert KnowledgeBase(spark, kb.root, kb.logs, kb.work, kb.run_ts).mode == "review"
    assert kb.rules().where("path LIKE 'tools[%].tool'").count() == 10
    p = tmp_path / "projects" / "tool"
    p.mkdir(parents=True)
    (p / "README.md").write_text("A pipeline\nwith storage")
    (p / "big.md").write_text("llm " * 20_000)
    assert [r.name for r in kb.scan_projects(str(tmp_path / "projects"), str(tmp_path / "short.json")).collect()] == ["tool"]
    r = kb.shortlist(str(tmp_path / "short.json"), domain="data-engineering").first()
    assert r.name == "tool" and r.summary == "A pipeline" and r.file_count == 2
    assert kb.shortlist(str(tmp_path / "none.json")).count() == 0 and kb.scan_projects(str(tmp_path / "nothing")).count() == 0


def test_missing_folders_are_empty(spark, tmp_path):
    assert files.knowledge_base(spark, str(tmp_path / "x")).count() == 0 and files.logs(spark, str(tmp_path / "x")).count() == 0
    assert state.read(spark, str(tmp_path / "s"), "a int").count() == 0


def test_snapshots_survive_reading_while_written(spark, tmp_path):
    root = str(tmp_path / "snap")
    state.write(spark.range(3), root)
    df = state.read(spark, root, "id long")
    state.write(df.where("id > 0"), root)
    assert df.count() == 3 and state.read(spark, root, "id long").count() == 2
    state.prune(spark, root)
    assert state.read(spark, root, "id long").count() == 2


def test_stream_keeps_the_snapshot(spark, tmp_path):
    base = tmp_path / "kb/concepts"
    base.mkdir(parents=True)
    fm = "---\ntitle: a\ntags: [b]\n---\n" + BODY
    run = lambda ts: ingest_stream(file_stream(spark, str(tmp_path / "kb")), str(tmp_path / "st"), str(tmp_path / "cp"), ts).awaitTermination()
    (base / "a.md").write_text(fm)
    run("t1")
    (base / "b.md").write_text(fm + "!")
    (base / "c.md").write_text("too short")
    run("t2")
    got = {r.path: (r.source_version, r.ingested_at) for r in state.read(spark, str(tmp_path / "st"), ingest_op.STATE).collect()}
    assert got == {"concepts/a.md": (1, "t1"), "concepts/b.md": (1, "t2")}


NAMES = ["plain.md", "_draft.md", ".hid.md", "100%.md", "a%20b.md", "a b+é.md"]


def test_every_legal_name_is_read_as_it_is(spark, tmp_path):
    base = tmp_path / "kb/concepts"
    base.mkdir(parents=True)
    for n in NAMES:
        (base / n).write_bytes(f"text of {n}\r\nend".encode())
    (base / "bad.md").write_bytes(b"\xff\xfe")
    (base / "no.txt").write_text("x")
    (base / "deep").mkdir()
    (base / "deep/x.md").write_text("not right in the folder")
    got = {r.path: (r.content, r.valid) for r in files.knowledge_base(spark, f"file://{tmp_path}/kb").collect()}
    assert got == {f"concepts/{n}": (f"text of {n}\nend", True) for n in NAMES} | {"concepts/bad.md": (None, False)}
    assert {r.path for r in files.all_markdown(spark, str(tmp_path / "kb")).collect()} == {*got, "concepts/deep/x.md"}
    assert {r.log_name for r in files.logs(spark, str(base)).where("valid").collect()} == set(NAMES)


def test_project_trees_are_whole(kb, tmp_path):
    top = tmp_path / "projects"
    for f in ("a/.github/workflows/ci.yml", "b/__init__.py", "b/__main__.py", "c/README.md", "c/100%.md"):
        (top / f).parent.mkdir(parents=True, exist_ok=True)
        (top / f).write_text("x")
    (top / "a/setup.py").write_bytes(b"bad \xff byte")
    (top / "c/tests").mkdir()
    (top / "loose.md").write_text("in no project")
    tree = {(r.project, r.rel_path): r.content for r in files.project_tree(kb.spark, str(top)).collect()}
    assert tree[("a", "setup.py")] == "bad \ufffd byte" and ("c", "tests/") in tree and len(tree) == 7
    got = {r.name: (r.maturity, r.file_count, r.path) for r in kb.scan_projects(str(top)).collect()}
    assert got == {"a": ("production", 2, f"{top}/a"), "b": ("unknown", 2, f"{top}/b"), "c": ("beta", 2, f"{top}/c")}


def test_broken_pointers_and_versions_count_for_nothing(spark, tmp_path):
    root = str(tmp_path / "snap")
    state.write(spark.range(3), root)
    state.point(spark, root, "v-of-a-run-that-died")
    (tmp_path / "snap/_pointers/zzz").write_text("junk")
    assert state.read(spark, root, "id long").count() == 3
    state.write(spark.range(5), root)
    assert state.read(spark, root, "id long").count() == 5
    state.prune(spark, root)
    assert state.read(spark, root, "id long").count() == 5
    for f in (tmp_path / "snap").glob("v-*/*.parquet"):
        f.write_bytes(b"not parquet at all")
    for f in (tmp_path / "snap").glob("v-*/.*.crc"):
        f.unlink()
    assert state.read(spark, root, "id long").count() == 0
    (next((tmp_path / "snap").glob("v-*")) / "_SUCCESS").unlink()
    assert state.current(spark, root) is None and state.read(spark, root, "id long").count() == 0


def test_a_run_that_dies_before_its_articles_compiles_again(kb, monkeypatch):
    def die(*_):
        raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setattr(export, "write_articles", die)
        with pytest.raises(OSError, match="disk full"):
            kb.compile()
    assert {r.action for r in kb.compile().collect()} == {"create"} and kb.compile().count() == 0


def test_hidden_files_of_a_stream(spark, tmp_path):
    base = tmp_path / "kb/concepts"
    base.mkdir(parents=True)
    for n in ("a.md", "_b.md"):
        (base / n).write_text("---\ntitle: a\ntags: [b]\n---\n" + BODY)
    for ts in ("t1", "t2"):
        ingest_stream(file_stream(spark, str(tmp_path / "kb")), str(tmp_path / "st"), str(tmp_path / "cp"), ts, base=str(tmp_path / "kb")).awaitTermination()
        (base / "c.md").write_text("too short")
    got = {r.path: (r.source_version, r.ingested_at) for r in state.read(spark, str(tmp_path / "st"), ingest_op.STATE).collect()}
    assert got == {"concepts/a.md": (1, "t1"), "concepts/_b.md": (1, "t1")}


def test_tools_return_envelopes(kb, tmp_path, spark):
    (tmp_path / "logs/_bad.md").write_bytes(b"## x\n\xff")
    assert set(tools.TOOLS) == {"set_mode", "get_mode", "ingest", "compile", "query", "validate", "status", "get_rules", "scan_prototypes", "get_shortlist"}
    assert not tools.set_mode(kb, "nope")["ok"] and tools.set_mode(kb, "ops")["mode"] == "ops" and tools.get_mode(kb)["thresholds"]["min_words"] == 30
    c = tools.compile(kb)
    assert (c["ok"], c["files_processed"], c["articles_created"], c["errors"]) == (True, 1, 2, 1)
    assert tools.compile(kb, file="none.md")["errors"] == 1 and tools.compile(kb, dry_run=True)["files_processed"] == 0
    i = tools.ingest(kb)
    assert (i["scanned"], i["inserted"]) == (2, 2) and i["details"].count() == 2 and tools.ingest(kb, dry_run=True)["scanned"] == 2
    q = tools.query(kb, "sow seeds")
    assert q["results"][0]["path"] == "concepts/seeds.md" and q["index_updated"] == kb.run_ts
    assert tools.validate(kb)["ok"] and tools.status(kb)["article_count"] == 2
    assert len(tools.get_rules(kb)["tools"]) == 10 and tools.get_rules(kb)["kb_schema"]["artifact_format"]["example"].startswith("---")
    lost = tools.get_shortlist(kb)
    assert not lost["ok"] and "shortlist" in lost["error"]
    for n in ("x", "y"):
        (tmp_path / f"projects/{n}").mkdir(parents=True)
        (tmp_path / f"projects/{n}/README.md").write_text("A pipeline\nwith storage" if n == "x" else "none")
    s = tools.scan_prototypes(kb, str(tmp_path / "projects"))
    assert (s["prototypes_found"], s["root_directory"], s["scanned_at"]) == (2, str(tmp_path / "projects"), kb.run_ts) and s["prototypes"][0]["path"] == f"{tmp_path}/projects/x"
    g = tools.get_shortlist(kb, domain="data-engineering")
    assert (g["ok"], g["prototypes_found"], g["total_in_shortlist"], g["scanned_at"]) == (True, 1, 2, kb.run_ts)
    (tmp_path / "old.json").write_text('{"prototypes": [{"name": "n", "domain": "d"}]}')
    old = tools.get_shortlist(kb, str(tmp_path / "old.json"), min_priority=5)
    assert (old["prototypes_found"], old["total_in_shortlist"], old["scanned_at"]) == (1, 0, "") and old["prototypes"][0]["name"] == "n"
    (tmp_path / "broken.json").write_text("{ no json")
    assert not tools.get_shortlist(kb, str(tmp_path / "broken.json"))["ok"]
    gone = KnowledgeBase(spark, str(tmp_path / "nowhere"), str(tmp_path / "nologs"), kb.work, kb.run_ts)
    assert not any(f(gone)["ok"] for f in (tools.ingest, tools.compile, tools.validate)) and not tools.query(gone, "x")["ok"] and tools.status(gone)["ok"]


def test_base_of_a_project_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("QUERN_PROJECT_ROOT", str(tmp_path / "p"))
    k = KnowledgeBase.of_project(spark, "2026-05-01T00:00:00+00:00")
    assert (k.root, k.logs, k.projects_dir) == (f"{tmp_path}/p/kb", f"{tmp_path}/p/logs/daily", str(tmp_path))
