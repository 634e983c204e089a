import random

import numpy as np
import pytest

from quern.llm import decontam, vec
from quern.llm.decontam import Index, leaks, normal


def norm(s):
    b = s.encode()
    v, _ = normal(*vec.codepoints(np.frombuffer(b, np.uint8), np.array([0, len(b)])))
    return "".join(map(chr, v)).strip()


def sellers(needle, text):
    """Fewest edits of needle against any run of text, by the full table."""
    prev = [0] * (len(text) + 1)
    for i, a in enumerate(needle, 1):
        cur = [i]
        for j, b in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (a != b), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def brute(docs, items):
    out = set()
    for i, t in items:
        v = norm(t)
        if len(v) < decontam.Q:
            continue
        starts = [*range(0, len(v) - 95, 96)] or [0]
        if starts[-1] + 96 < len(v):
            starts.append(len(v) - 96)
        for d, text in docs:
            for s in starts:
                n = v[s : s + 96]
                if sellers(n, norm(text)) <= min(len(n) // 16, (len(n) - decontam.Q) // decontam.Q):
                    out.add((d, i))
    return out


def edit(rng, s, n):
    s = list(s)
    for _ in range(n):
        p = rng.randrange(len(s))
        k = rng.random()
        if k < 0.4:
            s[p] = rng.choice("aeiouth")
        elif k < 0.7:
            del s[p]
        else:
            s.insert(p, rng.choice("aeiouth"))
    return "".join(s)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    vocab = ["th", "er", "an", "on", "the", "thand", "inga", "Été", "of", "ness", "tion,", "stre."]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([8, 20, 30]))) for i in range(6)]
    docs = []
    for d in range(36):
        t = text(25)
        if d % 3 == 0:
            t = t + " " + edit(rng, items[d % 6][1], rng.choice([0, 2, 4, 6, 9])) + " " + text(9)
        docs.append((d, t))
    return docs, items


def test_same_as_full_alignment(spark, data):
    docs, items = data
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 5


def test_several_passes_find_the_same(spark, data):
    docs, items = data
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = leaks(d, b), leaks(d, b, index_chars=200)
    assert sorted(one.collect()) == sorted(many.collect())


def test_passes_do_not_merge_the_texts_of_one_item(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdefghijkl") for _ in range(100 + 2 * k)) for k in range(3)]
    b = spark.createDataFrame([(7, t) for t in texts], "item_id long, text string")
    d = spark.createDataFrame([(1, " and ".join(texts))], "doc_id long, text string")
    want = [(1, 7, 5 + 7 + 9, 0)]
    for chars in (10**6, 250, 150, 60, 1):
        got = [tuple(r) for r in leaks(d, b, index_chars=chars).collect()]
        assert [(a, i, e) for a, i, _, e in got] == [(1, 7, 0)] and got[0][2] >= want[0][2]
        assert got == [tuple(r) for r in leaks(d, b).collect()]


def test_punctuation_of_other_scripts_is_no_letter(spark):
    item = "漢字の文章はここにあり十分に長いので見つかるはずである" * 2
    doc = "前" + item.replace("は", "は、").replace("の", "の😀 ") + "後"
    got = leaks(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(9, item.replace("は", "は "). replace("の", "の "))], "item_id long, text string"))
    assert [(r.doc_id, r.item_id, r.edits) for r in got.collect()] == [(1, 9, 0)]


def test_index_is_small():
    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(97, 123, 400_000)))
    ix = Index([(1, 1, text)])
    assert sum(x.nbytes for x in vars(ix).values() if isinstance(x, np.ndarray)) < 30 * len(text)


def test_case_punctuation_and_spacing_do_not_hide(spark):
    item = "Was ever a passage, of some length; so well-hidden in plain sight as this one is, here and now?"
    doc = "xx " + item.upper().replace(" ", " \n ").replace(",", " -- ") + " yy"
    r = leaks(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(x.doc_id, x.item_id, x.edits) for x in r] == [(1, 9, 0)]


def test_defined_cases(spark):
    item = "a benchmark passage that is long enough to be found wherever it has been copied to"
    items = [(1, item, 5, "n"), (2, item, 5, "n"), (3, None, 5, "n"), (None, item, 5, "n"), (4, "short", 5, "n"), (5, "", None, None), (1, item, 5, "n")]
    long = " ".join(f"filler{i % 977}" for i in range(90000))
    docs = [(1, None, 1, "x"), (2, "", 1, "x"), (None, item, 1, "x"), (3, item, 1, "x"), (3, item, 1, "x"), (4, long + " " + item + " " + long, None, None), (5, "short", 0, "y"), (6, long, 0, "y")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id long, needle string")
    b = spark.createDataFrame(items, "item_id long, text string, id long, item string")
    want = [(3, 1, 1, 0), (3, 2, 1, 0), (4, 1, 1, 0), (4, 2, 1, 0)]
    assert sorted(map(tuple, leaks(d, b).collect())) == want
    assert leaks(d.limit(0), b).collect() == [] and leaks(d, b.limit(0)).collect() == []


def test_index_of_nothing():
    assert len(Index([]).matches(np.arange(40, dtype=np.uint32), np.array([0, 40]))[0]) == 0


def test_same_as_full_alignment_of_all_runs_of_an_item(spark, data):
    rng = random.Random(8)
    _, items = data
    items = [(i, norm(t)) for i, t in items]
    filler = " ".join(f"filler{i}" for i in range(12))
    docs = []
    for d in range(24):
        t = items[d % 6][1]
        a = rng.randrange(max(1, len(t) - 95))
        docs.append((d, f"{filler} {edit(rng, t[a : a + rng.choice([70, 96, 110, 150])], rng.choice([0, 0, 3, 6]))} {filler}"))
    want = set()
    for i, t in items:
        m = min(96, len(t))
        for s in range(len(t) - m + 1):
            most = min(m // 16, (m - decontam.Q) // decontam.Q)
            want |= {(d, i, s) for d, text in docs if d % 6 == i and sellers(t[s : s + m], norm(text)) <= most}
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.needles for r in got} == {(d, i): len({s for e, j, s in want if (e, j) == (d, i)}) for d, i, _ in want}
    assert len(got) > 8


@pytest.mark.parametrize(("length", "a", "b"), [(233, 10, 140), (394, 30, 180), (394, 60, 156)])
def test_a_verbatim_fragment_is_found_wherever_it_begins(spark, length, a, b):
    rng = random.Random(length)
    item = "".join(rng.choice("abcdefghijkl") for _ in range(length))
    got = leaks(spark.createDataFrame([(1, "before " + item[a:b] + " after")], "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.edits) for r in got] == [(1, 9, 0)] and got[0].needles >= b - a - 95
