import numpy as np
import pytest

from quern.llm import ann
from quern.llm.ann import neighbours, squared, walk

DIR = "/root/testdata/sf0.1"


def brute(ids, x, k):
    d = squared(x, x)
    out = {}
    for i, q in enumerate(ids):
        o = [j for j in np.lexsort((ids, d[i])) if ids[j] != q]
        out[q] = [ids[j] for j in o[:k]]
    return out


def test_walk_goes_by_summed_distance_and_stops_in_time():
    rng = np.random.default_rng(0)
    for _ in range(40):
        a, b, n = rng.random(7), rng.random(5), rng.integers(0, 4, (7, 5))
        every = sorted((a[i] + b[j], i, j) for i in range(7) for j in range(5) if n[i, j])
        assert walk(a, b, n.tolist(), 10**9)[0] == [(i, j) for _, i, j in every]
        some, last = walk(a, b, n.tolist(), 12)
        assert some == [(i, j) for _, i, j in every][: len(some)]
        assert sum(n[c] for c in some) >= 12 > sum(n[c] for c in some[:-1]) and last == pytest.approx(a[some[-1][0]] + b[some[-1][1]])


def test_recall_over_the_whole_table(spark):
    df = spark.read.parquet(f"{DIR}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    want = brute(ids, x, 10)
    got = {}
    for r in neighbours(df).collect():
        got.setdefault(r.vec_id, {})[r["rank"]] = (r.neighbour_id, r.distance)
    assert len(got) == len(ids) and all(sorted(g) == list(range(1, 11)) for g in got.values())
    recall = np.mean([len({n for n, _ in got[q].values()} & set(want[q])) / 10 for q in ids])
    assert recall >= 0.9
    at = {i: k for k, i in enumerate(ids)}
    for q in ids[:50]:
        assert all(abs(np.linalg.norm(x[at[q]] - x[at[n]]) - d) < 1e-9 for n, d in got[q].values())


def test_the_production_form_reaches_its_recall(spark):
    """Every id divisible by 20 against all rows, on two sizes; brute force over the whole table."""
    for at in ("/root/testdata/sf0.01", DIR):
        df = spark.read.parquet(f"{at}/embeddings.parquet")
        rows = df.collect()
        ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
        want = brute(ids, x, 10)
        got = {}
        for r in neighbours(df, df.where("vec_id % 20 = 0")).collect():
            got.setdefault(r.vec_id, set()).add(r.neighbour_id)
        assert set(got) == {i for i in ids.tolist() if i % 20 == 0} and {len(g) for g in got.values()} == {10}
        assert np.mean([len(got[q] & set(want[q])) / 10 for q in got]) >= 0.9


def test_clustered_vectors_need_a_small_share(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16)) * 4
    x = (centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16)) * 0.3).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    shares = []
    real = ann.needed
    monkeypatch.setattr(ann, "needed", lambda *a: shares.append(real(*a)) or shares[-1])
    got = {}
    for r in neighbours(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour_id)
    d = squared(x, x)
    hits = [len(got[q] & set([j for j in np.argsort(d[q], kind="stable") if j != q][:10])) / 10 for q in got]
    assert np.mean(hits) >= 0.9 and shares[0] < 0.1


def test_walking_all_cells_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 6)).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours(df, k=5, centroids=4, share=1.0).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append(r.neighbour_id)
    assert got == brute(np.arange(150), x, 5)


def test_defined_cases(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], "k", 1), (1, [1.0, 0.0], "k", 1), (2, [0.0, 1.0], "k", 1), (3, [0.0, 1.0], None, None), (None, [1.0, 1.0], "k", 1), (4, None, "k", 1), (5, [], "k", 1), (6, [1.0], "k", 1), (7, [nan, 0.0], "k", 1), (8, [None, 1.0], "k", 1), (9, [0.0, 0.0], "k", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell string, rank int")
    got = [(r.vec_id, r.neighbour_id, r["rank"]) for r in neighbours(df, k=2).orderBy("vec_id", "rank").collect()]
    assert got == [(1, 9, 1), (1, 2, 2), (2, 3, 1), (2, 9, 2), (3, 2, 1), (3, 9, 2), (9, 1, 1), (9, 2, 2)]
    assert neighbours(df.limit(0)).collect() == [] and neighbours(df.where("vec_id = 9")).collect() == []


def test_ties_and_repeated_ids_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [1.0, 1.0, 1.0, 1.0]) for i in rng.permutation(60)]  # one distance for all
    rows += [(100, [3.0, 3.0, 3.0, 3.0 + j / 1024]) for j in range(40)]  # one id many times
    rows += [(200 + j, [4.0, 4.0, 4.0, 4.0 + j]) for j in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    want = {}
    for q in set(ids.tolist()):
        d = {}
        for v in x[ids == q]:
            for i, e in zip(ids.tolist(), np.sqrt(((x - v) ** 2).sum(1))):
                if i != q:
                    d[i] = min(e, d.get(i, np.inf))
        want[q] = sorted(d, key=lambda i: (d[i], i))[:10]
    got = {}
    for r in neighbours(df, centroids=4, share=1.0).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append(r.neighbour_id)
    assert got == want
    short = neighbours(df, centroids=4, share=0.0).groupBy("vec_id").count().collect()
    assert {r.vec_id: r["count"] for r in short} == {q: 10 for q in want}
