import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import quality
from quern.llm.quality import fit, passages, sample, scores, train

DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score string, id long, label string"


def test_gradient_lowers_loss_to_separation():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 9, 120)
    bag = np.repeat(np.arange(120), sizes)
    x = rng.normal(size=(len(bag), quality.WIDTH))
    y = (np.arange(120) % 2).astype(float)
    at = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]])
    x[at[y == 1], :3] += 4  # one passage of each positive bag tells
    m = fit(x, bag, y)
    bags, p = m.score(x, bag)
    assert ((p > 0.5) == y).mean() > 0.97 and list(bags) == list(range(120))
    a = m.forward(x, at, bag)["a"]
    assert a[at[(y == 1) & (sizes > 3)]].mean() > 1.5 / sizes[(y == 1) & (sizes > 3)].mean()


def test_scores_and_gradient_are_those_of_plain_loops():
    rng = np.random.default_rng(3)
    bag = np.array([0, 0, 0, 1, 2, 2])
    x, y = rng.normal(size=(6, quality.WIDTH)), np.array([1.0, 0.0, 1.0])
    p = fit(x, bag, y, epochs=3, hidden=4).p
    dot = lambda a, b: sum(float(i) * float(j) for i, j in zip(a, b))
    sig = lambda v: 1 / (1 + math.exp(-v))

    def outputs(p):
        out = []
        for k in range(3):
            hs, es = [], []
            for v in x[bag == k]:
                v = [(a - m) / s for a, m, s in zip(v, p["mean"], p["std"])]
                h = [math.tanh(dot(v, p["W"][:, j]) + p["b"][j]) for j in range(4)]
                es.append(sum(math.tanh(dot(h, p["V"][:, j])) * sig(dot(h, p["U"][:, j])) * p["w"][j] for j in range(2)))
                hs.append(h)
            top = [math.exp(e) for e in es]
            z = [sum(a / sum(top) * h[j] for a, h in zip(top, hs)) for j in range(4)]
            out.append(sig(dot(z, p["c"]) + float(p["d"])))
        return out

    def loss(p):
        return -sum(math.log(o if t else 1 - o) for o, t in zip(outputs(p), y)) / 3 + 0.05 / 2 * sum((p[n] ** 2).sum() for n in "WVUwc")

    m = quality.Attention(p)
    assert np.allclose(m.score(x, bag)[1], outputs(p))
    grad = quality.gradient(m, x, np.array([0, 3, 4]), bag, y, 0.05)
    for n in quality.NAMES:
        for at in list(np.ndindex(p[n].shape))[:6]:
            side = []
            for e in (1e-5, -1e-5):
                q = {k: np.array(v) for k, v in p.items()}
                q[n][at] += e
                side.append(loss(q))
            assert grad[n][at] == pytest.approx((side[0] - side[1]) / 2e-5, abs=1e-6)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0
    model = train(docs, labels.where(~held))
    got = scores(docs, model).join(labels.where(held), "doc_id").select("score", "quality").collect()
    good = [r.score >= quality.THRESHOLD for r in got if r.quality == 1]
    bad = [r.score < quality.THRESHOLD for r in got if r.quality == 0]
    assert len(good) > 80 and sum(good) / len(good) > 0.97 and sum(bad) / len(bad) > 0.8


def test_passages_cover_whole_texts_and_ignore_slicing(monkeypatch):
    texts = pa.array(["a b " * 100, None, "", "ü " * 65, "x" * 3000, " \n"])
    one = [np.concatenate(c) for c in zip(*passages(texts))]
    assert [int((one[0] == r).sum()) for r in range(6)] == [4, 0, 0, 2, 1, 0]
    monkeypatch.setattr(quality.vec.slices, "__defaults__", (100,))
    two = [np.concatenate(c) for c in zip(*passages(texts))]
    assert np.array_equal(one[0], two[0]) and np.allclose(one[1], two[1])


def test_the_sample_is_bounded(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    assert len(sample(docs, labels, most=50)[2]) == 50


def test_defined_cases(spark):
    rows = [(1, "plain words here", "s", 1, "l"), (2, None, "s", 1, "l"), (3, "", None, None, None), (None, "plain words here", "s", 1, "l"), (1, "plain words here", "s", 1, "l"), (4, "junk*** " * 50000, "s", 1, "l")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (4, 0, "x"), (None, 1, "x"), (9, 1, "x"), (2, None, "x")], "doc_id long, quality int, text string")
    assert train(docs, labels) == 0.0 and train(docs, labels.limit(0)) == 0.5 and train(docs.limit(0), labels) == 0.5
    out = scores(docs, 0.25).collect()
    assert sorted(r.score for r in out) == [0, 0, 0.25, 0.25, 0.25, 0.25] and out[0].asDict().keys() == {"doc_id", "text", "score", "id", "label"}
    model = train(docs, labels.where("quality IS NOT NULL").union(spark.createDataFrame([(3, 1, "x")], labels.schema)))
    assert isinstance(model, float)
    two = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in scores(docs, train(docs, two)).collect() if r.doc_id in (1, 4)}
    assert got[1] > 0.5 > got[4]
    assert scores(docs.limit(0), 0.5).collect() == []
