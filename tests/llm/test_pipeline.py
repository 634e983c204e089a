import random

import pytest

import corpus_pipeline
from quern.llm import stages

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, score string, nth string, _score string"
VOCAB = [a + b + c for a in ("th", "er", "st", "on", "re", "an") for b in ("ou", "ea", "in", "at") for c in ("", "ly", "ed", "ble")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, rows by what is planted in them)."""
    rng = random.Random(11)
    prose = lambda n: (" ".join(rng.choices(VOCAB, k=n)) + ".").capitalize()
    unique = lambda d, n: " ".join(f"{rng.choice(VOCAB)}{rng.choice(VOCAB)}" for _ in range(n)) + "."
    junk = lambda n: " ".join(rng.choice(VOCAB).upper() + "!!" for _ in range(n))
    bench = [(i, unique(i, 30)) for i in range(5)]
    kind, rows = {}, []

    def add(what, text):
        d = len(rows)
        kind[d] = what
        rows.append((d, text, "en", "s", len(text), 5, "x", "n", "keep"))
        return d

    for _ in range(40):
        add("clean", unique(0, 80))
    for _ in range(25):
        add("junk", junk(60))
    for i in range(6):
        base = rows[i][1].split()
        base[7] = "other"
        add("copy", " ".join(base))
    for i in range(5):
        add("leak", unique(0, 40) + " " + bench[i][1] + " " + unique(0, 40))
    for i in range(5):
        add("private", unique(0, 40) + f" write to user{i} [at] mail [dot] com today " + unique(0, 30))
    rows += [(900, None, "en", "s", 0, None, None, None, "keep"), (901, "", "en", "s", 0, None, None, None, "keep"), (None, unique(0, 70), None, None, None, None, None, None, "keep"), rows[0], rows[3]]
    labels = [(d, int(kind[d] != "junk"), 0) for d in kind if d % 3 != 1]
    at = str(tmp_path_factory.mktemp("pipe"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, kind


def test_each_stage_does_just_its_own(spark, tables):
    at, kind = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    whole = ids(docs)
    good = stages.accept_quality(spark, docs, at)
    assert good.columns == docs.columns
    assert ids(good) == [d for d in whole if d not in (900, 901) and kind.get(d) != "junk"]
    assert {(r._score, r.nth) for r in good.where("doc_id IS NOT NULL").collect()} == {("keep", "n")}
    once = stages.drop_near_duplicates(spark, docs, at)
    assert once.columns == docs.columns
    assert ids(once) == sorted({d for d in whole if kind.get(d) != "copy"} | {None}, key=str)
    assert {r._score for r in once.collect()} == {"keep"}
    pure = stages.drop_leaks(spark, docs, at)
    assert pure.columns == docs.columns and ids(pure) == [d for d in whole if kind.get(d) != "leak"]
    public = stages.mask_identifiers(spark, docs, at)
    assert public.columns == docs.columns and ids(public) == whole
    for r in public.collect():
        assert ("<EMAIL>" in (r.text or "")) == (kind.get(r.doc_id) == "private")
        assert r.n_chars == (len(r.text) if r.text is not None else 0)


def test_the_whole_keeps_the_clean_and_packs_them_once(spark, tables):
    at, kind = tables
    bins = corpus_pipeline.run(spark, at).collect()
    got = [d for b in bins for d in b.doc_ids]
    assert sorted(got) == [d for d, k in kind.items() if k in ("clean", "private")]
    assert all(sum(b.lengths) == b.used == len(b.tokens) <= 8192 for b in bins)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_classifier" and len(corpus_pipeline.STAGES) == 5


def test_empty_tables(spark, tables, tmp_path):
    at, _ = tables
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_very_long_and_repeated_texts_pass_all_stages(spark, tables, tmp_path):
    at, _ = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    rng = random.Random(4)
    long = " ".join(rng.choice(VOCAB) + rng.choice(VOCAB) for _ in range(60_000)) + "."
    more = docs.where("doc_id = 1").selectExpr("950L AS doc_id", f"'{long}' AS text", *[f"`{c}`" for c in docs.columns[2:]])
    docs.unionByName(more).unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{at}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    bins = corpus_pipeline.run(spark, str(tmp_path)).collect()
    mine = sorted((s, n) for b in bins for d, s, n in zip(b.doc_ids, b.starts, b.lengths) if d == 950)
    assert sum(n for _, n in mine) == len(long) + 1 and [s for s, _ in mine] == list(range(0, len(long) + 1, 8192))
