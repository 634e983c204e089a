import pytest
from pyspark.sql import functions as F

from quern.operators import articles as A
from quern.operators import compiling, gate, index, ingest, projects, validation


def arts(spark, rows):
    return A.articles(spark.createDataFrame([(*r, 1.0)[:3] for r in rows], "path string, content string, mtime double"))


def fm(*lines, body="word " * 5):
    return "\n".join(["---", *lines, "---", "", body])


LONG = "word " * 102 + "[[x]]"


@pytest.mark.parametrize(
    ("content", "limits", "ok", "message"),
    [
        (fm("title: a", "tags: [b]", "sources: [c]", "type: d", body=LONG), None, True, None),
        (fm("title: a", body="one"), None, False, "word count 1 below"),
        (fm("type: a", body=LONG), None, False, "missing required frontmatter: title"),
        (fm("title: a", body="w " * 15), None, True, "word count 15 below minimum 50"),
        (fm("title: a", body="w " * 60), None, True, "only 1 frontmatter fields"),
        (fm("title: a", body="w " * 60), {"reject_quality_score": 0.2}, False, "quality score 0.2 at or below"),
        (fm("title: ", body="w " * 60), {"reject_quality_score": -1.0}, True, "quality score 0.0 below minimum 0.2"),
        (fm("title: a", body="w " * 60), gate.thresholds("review"), False, "missing required frontmatter: type, tags"),
        (fm("title: a", body="w"), gate.thresholds("personal"), True, "word count 1 below minimum 10"),
        (fm("title: a", body="w " * 9), gate.thresholds("no such mode"), False, "word count 9"),
    ],
)
def test_gate(spark, content, limits, ok, message):
    r = gate.gate(arts(spark, [("concepts/a.md", content)]), limits).first()
    assert r.accepted is ok and (message is None and r.messages == [] or any(message in m for m in r.messages))


def test_score_counts_fifths(spark):
    cs = [fm("title: a", "tags: [b]", "sources: [c]", body=LONG), fm("x: y"), fm("title: a"), "no frontmatter at all"]
    df = arts(spark, [(f"concepts/{i}.md", c) for i, c in enumerate(cs)])
    assert [r.s for r in df.select(gate.score(F.col("fm"), F.col("body")).alias("s"), "path").orderBy("path").collect()] == [1.0, 0.0, 0.2, 0.0]


def test_ingest_cycle(spark):
    good, bad = fm("title: a", "tags: [b]", body=LONG), fm("title: a", body="w")
    mk = lambda rows: spark.createDataFrame(rows, "path string, content string, mtime double")
    none = spark.createDataFrame([], ingest.STATE)
    one = mk([("concepts/a.md", good, 1.0), ("concepts/b.md", good, 1.0), ("concepts/c.md", bad, 1.0)])
    acts = ingest.actions(*ingest.of(one), none)
    assert {r.path: r.action for r in acts.collect()} == {"concepts/a.md": "insert", "concepts/b.md": "insert", "concepts/c.md": "reject"}
    snap = ingest.next_state(acts, "t1")
    assert {r.path for r in snap.collect()} == {"concepts/a.md", "concepts/b.md"}
    two = mk([("concepts/a.md", good + " more", 2.0), ("concepts/c.md", good, 2.0), ("concepts/d.md", good, 1.0)])
    acts = ingest.actions(*ingest.of(two), snap)
    got = {r.path: (r.action, r.reason, r.source_version) for r in acts.collect()}
    assert got == {"concepts/a.md": ("update", None, 2), "concepts/b.md": ("delete", "file_removed", None), "concepts/c.md": ("insert", None, 1), "concepts/d.md": ("insert", None, 1)}
    s = ingest.summary(acts).first()
    assert (s.scanned, s.inserted, s.updated, s.deleted, s.rejected) == (3, 2, 1, 1, 0)
    # the time alone skips; another time with the same text skips, too, and keeps the new time
    snap = ingest.next_state(acts, "t2")
    three = mk([("concepts/a.md", "other text", 2.0), ("concepts/c.md", good, 9.0)])
    acts = ingest.actions(*ingest.of(three), snap)
    assert {(r.path, r.reason) for r in acts.where("action = 'skip'").collect()} == {("concepts/a.md", "mtime_match"), ("concepts/c.md", "same_hash")}
    kept = {r.path: (r.mtime, r.ingested_at) for r in ingest.next_state(acts, "t3").collect()}
    assert kept == {"concepts/a.md": (2.0, "t2"), "concepts/c.md": (9.0, "t2")}
    forced = ingest.actions(*ingest.of(three), snap, force_all=True)
    assert {r.path: r.action for r in forced.where("action <> 'delete'").collect()} == {"concepts/a.md": "reject", "concepts/c.md": "update"}
    st = ingest.status(ingest.compare(three, snap)).first()
    assert (st.article_count, st.disk_count, st.stale_count, st.orphaned_count, st.synced) == (3, 2, 1, 1, False)


@pytest.fixture(scope="module")
def base(spark):
    rows = [
        ("concepts/python.md", fm('title: "Python"', "updated: 2026-01-02", "source_version: 1", body="python snake language typing shared")),
        ("concepts/rust.md", fm('title: "Rust"', "updated: 2026-03-01", "source_version: 5", body="rust borrow compiler shared")),
        ("mechanisms/of.md", "the and of"),
    ]
    return index.build(A.records(arts(spark, rows)))


def ask(spark, base, q, **o):
    return [(r.path, round(r.score, 3)) for r in index.search(spark.createDataFrame([(1, q)], "qid long, question string"), *base, **o).orderBy("rank").collect()]


def test_search(spark, base):
    top = ask(spark, base, "python typing")
    assert top[0][0] == "concepts/python.md" and top[0][1] > 0.1 and top[1] == ("concepts/rust.md", 0.0) and len(top) == 2
    recent = ["concepts/rust.md", "concepts/python.md", "mechanisms/of.md"]
    assert [p for p, _ in ask(spark, base, "unheard words")] == recent == [p for p, _ in ask(spark, base, "")] and ask(spark, base, "")[0][1] == 0
    assert [p for p, _ in ask(spark, base, "compiler", least=3)] == ["concepts/rust.md"]
    assert "concepts/rust.md" not in [p for p, _ in ask(spark, base, "shared compiler", most=2)]
    assert ask(spark, base, "python", k=0) == []
    with pytest.raises(ValueError, match="negative"):
        ask(spark, base, "python", k=-1)


def test_staleness_and_context(spark, base):
    recs = A.records(arts(spark, [("concepts/rust.md", "new text"), ("concepts/x.md", "x")]))
    assert {tuple(r) for r in index.stale(recs, base[0]).collect()} == {("concepts/rust.md", "changed"), ("concepts/x.md", "added"), ("concepts/python.md", "removed"), ("mechanisms/of.md", "removed")}
    ranked = spark.createDataFrame([(1, 1, "a.md", 0.5), (1, 2, "b.md", 0.0), (1, 3, "c.md", 0.0)], "qid int, rank int, path string, score double")
    texts = spark.createDataFrame([("a.md", "A" * 100), ("b.md", "B" * 900), ("c.md", "c")], "path string, content string")
    got = index.context(ranked, texts, 500).first().context
    assert got.startswith("## a (relevance: 0.50)\n\nAAA") and got.endswith("\n\n...(truncated)") and "\n\n---\n\n## b\n\nBB" in got and "## c" not in got


def test_compile(spark):
    body = "word " * 60
    log = f"lead\n## Pattern: X!\n- one\n  - two\n{body}\n## Links & so\nshort\n## Pattern X\n{body}\n### deep\nmore"
    logs = spark.createDataFrame([("d1.md", log), ("d2.md", f"## Pattern x\n{body}"), ("d3.md", None)], "log_name string, content string")
    secs = compiling.sections(logs)
    assert [(r.log_name, r.pos, r.heading) for r in secs.orderBy("log_name", "pos").collect()] == [("d1.md", 0, "Pattern: X!"), ("d1.md", 1, "Links & so"), ("d1.md", 2, "Pattern X"), ("d2.md", 0, "Pattern x")]
    rend = compiling.rendered(compiling.classified(secs), "2026-05-01")
    first = rend.orderBy("log_name", "pos").first()
    assert first.path == "mechanisms/pattern-x.md" and "## Key Points\n\n- one\n- two\n\n## Details" in first.content and first.content.startswith('---\ntitle: "Pattern: X!"\ntype: mechanism\ntags: [mechanism]\nsources: [daily/d1.md]\n')
    ups = compiling.upsert(rend, spark.createDataFrame([], "path string, hash string"))
    assert [(r.log_name, r.action, r.final) for r in ups.orderBy("log_name", "pos").collect()] == [("d1.md", "create", False), ("d1.md", "update", False), ("d2.md", "update", True)]
    again = compiling.upsert(rend.where("log_name = 'd2.md'"), ups.where("final").select("path", "hash"))
    assert again.first().action == "skip"
    types = ["My Links", "Mechanisms", "Test results", "Resources", "Plain", "Outcome connection"]
    got = spark.createDataFrame([(t,) for t in types], "h string").select(compiling.article_type(F.col("h")).alias("t")).collect()
    assert [r.t for r in got] == ["connection", "mechanism", "outcome", "reference", "concept", "connection"]
    prev = spark.createDataFrame([("mechanisms/pattern-x", "old", "daily/d0.md", "2026-01-01")], "slug string, summary string, compiled_from string, updated string")
    table = compiling.contents(prev, ups, "2026-05-01")
    assert [tuple(r) for r in compiling.read_contents(compiling.contents_text(table)).collect()] == [("mechanisms/pattern-x", "old", "daily/d0.md", "2026-05-01")]
    none = spark.createDataFrame([], "log_name string, hash string, compiled_at string")
    done = compiling.next_compile_state(none, compiling.pending(logs, none), "t")
    assert compiling.pending(logs, done).count() == 0 and compiling.pending(logs, done, all_logs=True).count() == 3 and compiling.pending(logs, done, file="d2.md").count() == 1


def test_validation(spark):
    a = arts(spark, [("concepts/a.md", "[[concepts/b]] [[b]] [[nowhere]] [[daily/x.md]] [[concepts/a]] " + "w " * 60), ("concepts/b.md", fm("sources: [daily/d1.md]", body="[[/abs]]")), ("references/b.md", "w " * 60)])
    logs = spark.createDataFrame([("d1.md", "x"), ("d2.md", "y")], "log_name string, content string")
    state = spark.createDataFrame([("d1.md", "0" * 16, "t"), ("d2.md", "", "t")], "log_name string, hash string, compiled_at string")
    got = validation.validate(a, A.links(a), logs, state)
    per = {(r.check, r.file) for r in got.collect()}
    assert per == {("broken_link", "concepts/a.md"), ("broken_link", "concepts/b.md"), ("orphan_page", "references/b.md"), ("orphan_source", "daily/d2.md"), ("stale_article", "daily/d1.md"), ("missing_backlink", "concepts/a.md"), ("sparse_article", "concepts/b.md")}
    assert got.where("check = 'missing_backlink' AND auto_fixable").count() == 2
    r = validation.report(got).first()
    assert (r.errors, r.warnings, r.suggestions, r.is_healthy) == (2, 3, 3, False)


def tree(spark, files):
    rows = [(p, rel, rel.split("/")[-1], "." + rel.split(".")[-1] if "." in rel.split("/")[-1] else "", len(c), c) for p, rel, c in files]
    return spark.createDataFrame(rows, "project string, rel_path string, name string, suffix string, length long, content string").withColumn("mtime", F.timestamp_seconds(F.lit(1767225600)))


def test_projects(spark):
    files = [
        ("ml", "README.md", "An llm agent\nmore"), ("ml", ".github/workflows/ci.yml", "x"), ("ml", "src/m.py", "Deep Learning and machine learning with a transformer and embedding for inference"),
        ("two", "a.py", "nothing"), ("two", "b.py", ""), ("one", "a.py", "x"), (".hid", "README.md", "x"), ("nb", "n.ipynb", "dopamine"), ("nb", "deep/tests/t.py", ""),
    ]
    f = tree(spark, files)
    topics = spark.createDataFrame([("transformer",), ("nothing like it",), ("LLM",)], "topic string")
    got = {r.name: r for r in projects.scan(f, topics).collect()}
    assert set(got) == {"ml", "two", "nb"}
    m = got["ml"]
    assert (m.domain, m.maturity, m.tech_stack, m.summary, m.suggested_priority, m.file_count) == ("ai-ml", "production", ["unknown"], "An llm agent", 2, 3) and m.domain_confidence == round(7 / 15, 2) and m.topic_overlap == 0.67
    assert m.priority_rationale == "strong domain signal (ai-ml); production-level maturity; high topic overlap with existing KB"
    assert got["nb"].maturity == "beta" and got["nb"].domain == "neuroscience" and got["two"].domain == "unknown" and got["two"].priority_rationale == "no strong signals" and got["two"].suggested_priority == 5
    assert m.last_modified == "2026-01-01T00:00:00+00:00"
    assert [r.name for r in projects.shortlist(projects.scan(f, topics), min_priority=2).collect()] == ["ml"]
    assert projects.scan(f.limit(0), topics).count() == 0


def test_topics_in_one_pass_and_in_several_agree(spark):
    low = spark.createDataFrame([("p", "an llm in a shell"), ("p", "rust"), ("q", ""), ("q", None)], "project string, t string")
    topics = spark.createDataFrame([("LLM",), ("llm",), ("hell",), ("s",), ("no",), ("",)], "topic string")
    want = {("p", "LLM"), ("p", "llm"), ("p", "hell"), ("p", "s"), ("p", ""), ("q", "")}
    for most in (10**6, 9, 1):
        hits = projects.topic_hits(low, topics, most)
        assert {tuple(r) for r in hits.collect()} == want and "NestedLoop" not in hits._jdf.queryExecution().toString()


def test_words_may_span_files_if_these_are_joined(spark):
    texts = ["x" * 90 + " machine", "learning " + "y" * 90, "deep", "", "z", "knowledge", "base"]
    f = spark.createDataFrame([("p", t, len(t), n + 1) for n, t in enumerate(texts)], "project string, content string, length long, n int")
    from quern.functions.constants import DOMAINS

    whole = " ".join(texts)
    want = max((sum(w in whole for w in ws) / len(ws), -k) for k, ws in enumerate(DOMAINS.values()))
    got = projects.domains(f, joined=True).first()
    assert got.domain == list(DOMAINS)[-want[1]] and got.domain_confidence == round(want[0], 2)
    assert projects.domains(f).count() == 0


def test_ingest_reads_only_what_the_time_does_not_skip(spark):
    files = spark.createDataFrame([(f"concepts/{k}.md", fm("title: a", body=LONG), float(k)) for k in range(6)], "path string, content string, mtime double")
    snap = ingest.next_state(ingest.actions(*ingest.of(files), spark.createDataFrame([], ingest.STATE)), "t1").withColumn("mtime", F.when(F.col("path") == "concepts/3.md", 99.0).otherwise(F.col("mtime")))
    listed, read = ingest.of(files)
    asked = []
    acts = ingest.actions(listed, lambda need: asked.append(need) or read(need), snap)
    assert {r.path: r.action for r in acts.collect()} == {f"concepts/{k}.md": "skip" for k in range(6)}
    assert [r.path for r in asked[0].collect()] == ["concepts/3.md"]


def test_rows_are_numbered_without_one_partition(spark):
    from quern.session import numbered

    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k", "id AS v").repartition(5)
    got = numbered(df, "k")
    assert [(r.k, r.pos) for r in got.orderBy("pos").collect()] == [(k, k + 1) for k in range(1000)] and got.columns == ["k", "v", "pos"]
    assert numbered(df.limit(0), "k").collect() == []
    table = spark.createDataFrame([(f"s{k}", "a", "b", "c") for k in range(20)], "slug string, summary string, compiled_from string, updated string")
    assert "SinglePartition" not in compiling.contents_text(table)._jdf.queryExecution().toString()
