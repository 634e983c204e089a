import random

import numpy as np
import pyarrow as pa

from quern.llm import simhash

SCHEMA = "doc_id long, text string, key string, id long, hi string"


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(900)]
    out = []
    for d in range(n):
        w = rng.choices(vocab, k=120)
        out.append((d * 10, " ".join(w), "x", None, None))
        if d % 4 == 0:
            for c in range(1, 4):
                v = list(w)
                for _ in range(c):
                    v[rng.randrange(len(v))] = "changed%d" % rng.randrange(99)
                out.append((d * 10 + c, " ".join(v), "x", None, None))
    return out


def brute(rows, distance):
    hi, lo, n = simhash.sketch(pa.array([r[1] for r in rows]))
    ids = [r[0] for r in rows]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = 0
    for i in range(len(ids)):
        for j in range(i):
            d = bin((int(hi[i]) ^ int(hi[j])) & (2**64 - 1)).count("1") + bin((int(lo[i]) ^ int(lo[j])) & (2**64 - 1)).count("1")
            if d <= distance and n[i] and n[j]:
                pairs += 1
                a, b = sorted((find(ids[i]), find(ids[j])))
                parent[b] = a
    return {(i, find(i)) for i in ids if find(i) != i}, pairs


def test_groups_match_brute_force(spark):
    rows = corpus()
    got = {tuple(r) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want, pairs = brute(rows, simhash.DISTANCE)
    assert pairs > 40
    assert len(got & want) >= 0.9 * len(want) and got <= want | got and len(got - want) == 0


def test_planted_copies_are_found_and_others_left_alone(spark):
    rows = corpus()
    got = {r.doc_id for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {r[0] for r in rows if r[0] % 10}


def test_oversized_buckets_are_split_not_dropped(spark):
    rows = corpus()
    got = {r.doc_id for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), bits=1, most=8).collect()}
    want = {r[0] for r in rows if r[0] % 10}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_defined_cases(spark):
    rows = [
        (1, None, "a", 1, "h"), (2, "", "a", 1, "h"), (3, " \n ", None, None, None), (None, "same text here", None, None, None), (None, "same text here", None, None, None),
        (7, "one and only", "k", 7, "x"), (7, "one and only", "k", 7, "x"), (8, "ties are kept by least id", "k", 0, "x"), (9, "Ties are kept by least id", "k", 0, "x"),
        (10, " ".join(f"w{i}" for i in range(60000)), "k", 0, "x"), (11, " ".join(f"w{i}" for i in range(60000)), "k", 0, "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in simhash.near_duplicates(df).collect()} == {(9, 8), (11, 10)}
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_sketch_ignores_slicing(monkeypatch):
    texts = pa.array([r[1] for r in corpus(20)] + [None, "", "é ü"])
    a = simhash.sketch(texts)
    monkeypatch.setattr(simhash.vec, "SLICE", 700)
    monkeypatch.setattr(simhash.vec.slices, "__defaults__", (700,))
    b = simhash.sketch(texts)
    assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_lone_pairs_at_the_threshold_are_found_in_crowded_buckets(spark):
    # all fingerprints share 28 coordinates; buckets of 6 bits hold far more than 8
    rng = np.random.default_rng(5)
    n, planted = 12000, 400
    hi, lo = rng.integers(0, 1 << 36, n, dtype=np.uint64), rng.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)
    want = set()
    for i in range(planted):  # groups of two at exactly the threshold
        mask_hi = mask_lo = 0
        for c in rng.choice(128, simhash.DISTANCE, replace=False).tolist():
            if c < 64:
                mask_lo |= 1 << c
            else:
                mask_hi |= 1 << (c - 64)
        lo[n - 1 - i], hi[n - 1 - i] = int(lo[i]) ^ mask_lo, int(hi[i]) ^ mask_hi
        want.add((i, n - 1 - i))
    frame = spark.createDataFrame([(i, int(h), int(v)) for i, (h, v) in enumerate(zip(hi.view(np.int64), lo.view(np.int64)))], "id long, hi long, lo long").repartition(4)
    for bits, most in ((6, 8), (simhash.BITS, simhash.BUCKET)):
        found = {tuple(r) for r in simhash.near_edges(frame, bits=bits, most=most).collect()}
        assert len(found & want) >= 0.9 * planted, (bits, len(found & want))
