import random
from collections import defaultdict

import numpy as np
import pytest

from quern.llm import vec
from quern.llm.suffixes import Splitters, as_bytes, common_prefix, lead_keys, levels, multikey_quicksort, pack, repeats, starts_of, unpack


def brute(rows, length):
    seen, where = defaultdict(set), defaultdict(set)
    for d, t in rows:
        if d is None or t is None:
            continue
        w = t.split()
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            seen[k].add((d, s))
            where[d].add((s, k))
    out = set()
    for d, at in where.items():
        span = None
        for s in sorted({s for s, k in at if len(seen[k]) > 1}):
            if span and s <= span[1]:
                span[1] = s + length
            else:
                if span:
                    out.add((d, *span))
                span = [s, s + length]
        if span:
            out.add((d, *span))
    return out


def corpus(seed, n=80):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    shared = [rng.choices(vocab, k=rng.choice([12, 19, 20, 21, 30, 70])) for _ in range(8)]
    rows = []
    for d in range(n):
        w = rng.choices(vocab, k=rng.randrange(0, 60))
        for _ in range(rng.choice([0, 1, 2])):
            p = rng.randrange(len(w) + 1)
            w[p:p] = rng.choice(shared)
        if d % 9 == 0:
            w += ["same"] * 30
        rows.append((d, rng.choice([" ", "\n", "  "]).join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute(rows, 20)
    got = repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=20, stride=10, gram=3).collect()
    assert len(got) == len(want) > 10 and set(map(tuple, got)) == want


def test_production_parameters(spark):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(51)]
    rows = [(d, " ".join([f"u{rng.randrange(10**6)}" for _ in range(200)] + (passage if d % 2 else passage[:49]) + ["z"] * d)) for d in range(6)]
    got = {tuple(r) for r in repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 50) and {g[0] for g in got} >= {1, 3, 5}


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    for n in (0, 1, 50, 5000):
        k = [rng.integers(0, 9, n), rng.integers(0, 4, n), rng.integers(0, 3, n)]
        o = multikey_quicksort(k, base=16)
        assert [tuple(x[i] for x in k) for i in o] == sorted(zip(*k)) and sorted(o) == list(range(n))


def test_splitters_spread_one_hot_suffix_and_keep_order():
    rng = np.random.default_rng(1)
    a = np.where(rng.random(4000) < 0.6, 7, rng.integers(0, 99, 4000)).astype(np.uint16)
    key = as_bytes(np.stack([a, np.where(a == 7, 5, rng.integers(0, 9, 4000)).astype(np.uint16)], 1))
    doc, pos = rng.integers(0, 3, 4000), rng.integers(0, 10**6, 4000)
    s = Splitters(list(zip(key.tolist(), doc.tolist(), pos.tolist())), 16, 4)
    k = s.bucket(key, doc, pos)
    assert np.bincount(k, minlength=16).max() < 2 * 4000 / 16
    order = np.lexsort((pos, doc, key))
    assert (np.diff(k[order]) >= 0).all()


def test_keys_are_in_the_order_of_their_tokens():
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 3, 500).astype(np.uint16) * np.uint16(257)
    at = rng.permutation(470)
    key = lead_keys(tokens, at, 26)
    order = multikey_quicksort(levels(key), base=16)
    rows = [tuple(tokens[i : i + 26].tolist()) for i in at]
    assert [rows[i] for i in order] == sorted(rows)
    want = [0] + [next((n for n, (x, y) in enumerate(zip(rows[i], rows[j])) if x != y), 26) for i, j in zip(order, order[1:])]
    assert common_prefix(key[order], 2).tolist() == want


def test_least_grams_are_those_of_every_window():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 4, 300).astype(np.uint64)
    row = np.sort(rng.integers(0, 3, 300))
    sums = vec.prefix_sums(h)
    g = vec.spans(sums, np.arange(298), np.arange(298) + 3)
    want = {s + int(np.argmin(g[s : s + 10])) for s in range(281) if row[s] == row[s + 19]}
    assert starts_of(sums, row, 20, 10, 3).tolist() == sorted(want)


def test_repeats_within_one_document(spark):
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    noise = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(1, " ".join(noise(90) + passage + noise(40) + passage + noise(9))), (2, " ".join(noise(300))), (3, "a " * 51), (4, "b " * 50), (5, " ".join(passage[:49]))]
    got = {tuple(r) for r in repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 90, 150), (1, 190, 250), (3, 0, 51)} == brute(rows, 50)


def test_buckets_are_counted(spark):
    rows = corpus(4)
    want = brute(rows, 20)
    got = repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=20, stride=10, gram=3, bucket=40).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)


def test_runs_across_boundaries_are_compared(spark):
    """One passage in each of many documents: its equal suffixes fall into several buckets."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(d, passage) for d in range(3000)]
    got = repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == {(d, 0, 60) for d in range(3000)} and len(got) == 3000


def test_packing_round_trip():
    doc, pos = np.array([5, 5, -3, 2**60]), np.array([0, 9, 4, 2])
    d, p = unpack(pack(doc, pos))
    assert list(d) == list(doc) and list(p) == list(pos)


def test_defined_cases(spark):
    p = " ".join(f"p{i}" for i in range(55))
    long = " ".join(f"q{i}" for i in range(120_000))
    rows = [(1, None), (2, ""), (None, p), (3, p), (3, p), (4, p + " tail"), (5, p + " " + p), (6, long), (7, "head " + long), (8, "r " * 200)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, data string, start int")
    assert {tuple(r) for r in repeats(df).collect()} == {(3, 0, 55), (4, 0, 55), (5, 0, 110), (6, 0, 120_000), (7, 1, 120_001), (8, 0, 200)}
    assert repeats(df.limit(0)).collect() == []
    assert repeats(df.where("doc_id IN (2, 3)")).collect() == []
