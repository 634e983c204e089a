import re

import pytest
from pyspark.sql import functions as F

from quern.functions import frontmatter, text
from quern.functions.constants import STOP_WORDS

HOSTILE = ["", " ", "Hello, World! It's A test_case x2 ab", "naïve café résumé", "tabs\tand nbsp em\u0085nel", "a-b_c d--e", "UPPER lower MiXeD", "émigré abc²x x́y", "line\r\nline\rline\n", "ß ﬀ ½ 日本語 ab", "the and of", "a" * 5000 + " word"]


def one(spark, texts, col):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in df.select("i", col.alias("v")).orderBy("i").collect()]


def test_word_count_and_strip(spark):
    assert one(spark, HOSTILE, text.word_count(F.col("t"))) == [len(t.split()) for t in HOSTILE]
    assert one(spark, HOSTILE, text.strip(F.col("t"))) == [t.strip() for t in HOSTILE]


def test_lines(spark):
    texts = ["a\nb", "a\n", "a\n\n", "a\r\nb\rc\x0bd e", "x"]
    assert one(spark, texts, text.lines(F.col("t"))) == [t.splitlines() for t in texts]


def test_tokens(spark):
    def plain(t):
        return [w for w in re.findall(r"\w+", t.lower()) if re.fullmatch("[a-z][a-z]+", w) and w not in STOP_WORDS]

    assert one(spark, HOSTILE, text.tokens(F.col("t"))) == [plain(t) for t in HOSTILE]
    assert len(STOP_WORDS) == 113


def test_slug(spark):
    def plain(t):
        kept = "".join(c for c in t.lower().strip() if c.isalnum() or c.isspace() or c in "_-")
        return "-".join(re.split("[\\s_]+", kept)).strip("-")

    texts = ["Hello World", "A - B", "  x_y  z ", "!!!", "Café & Tee", "-a-", "tab\tnel\u0085x"]
    assert one(spark, texts, text.slug(F.col("t"))) == [plain(t) for t in texts]


def test_links(spark):
    t = ["[[a]] [[b/c]] [[x\ny]] [[]] [not] [[[d]]]", "none"]
    assert one(spark, t, text.wikilinks(F.col("t"))) == [re.findall(r"\[{2}([^\]]+)\]{2}", x) for x in t]


def bare(v):
    for q in ('"', "'"):
        v = v.strip(q)
    return v


def parse(t):
    if not t.startswith("---") or t.find("---", 3) < 0:
        return {}, t
    e = t.find("---", 3)
    out = {}
    for line in t[3:e].strip().splitlines():
        k, sep, v = line.strip().partition(":")
        if sep:
            out[k.strip()] = bare(v.strip())
    return out, t[e + 3 :].strip()


FM = [
    '---\ntitle: "A: b"\ntags: [x, "y"]\nno colon\n---\n\nbody here\n', "no frontmatter", "---\nunclosed: 1\n", "---\nsummary: a --- b\n---\nrest", "---\nk: 1\nk: 2\n---\nx",
    " ---\nk: 1\n---\n", "------\nbody", "---\n: empty key\nq: 'it''s'\n---", "---\r\nk: v\r\n---\r\nbody\r\nb",
]


def test_frontmatter(spark):
    df = spark.createDataFrame(list(enumerate(FM)), "i int, t string").withColumn("e", frontmatter.end(F.col("t"))).withColumn("h", frontmatter.head(F.col("t"), F.col("e")))
    got = df.select("i", frontmatter.fields(F.col("h")).alias("f"), frontmatter.body(F.col("t"), F.col("e")).alias("b")).orderBy("i").collect()
    assert [(r.f, r.b) for r in got] == [parse(t) for t in FM]


@pytest.mark.parametrize(("value", "typed", "gate"), [("[a, b, c]", ["a", "b", "c"], ["a", "b", "c"]), ("", [""], []), ("[x]", ["x"], ["x"]), ("a, b", ["a, b"], ["a", "b"]), ('[""]', [], [""]), ("[a, , 'b']", ["a", "b"], ["a", "b"]), ("[", ["["], ["["]), (None, None, [])])
def test_list_fields(spark, value, typed, gate):
    df = spark.createDataFrame([(value,)], "v string")
    r = df.select(frontmatter.typed_list(F.col("v")), frontmatter.gate_list(F.col("v"))).first()
    assert (r[0], r[1]) == (typed, gate)
