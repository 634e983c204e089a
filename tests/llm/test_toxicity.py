import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import toxicity, vec
from quern.llm.toxicity import fit, scores, swaps, train

DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0
    model = train(docs, labels.where(~held))
    got = scores(docs, model).join(labels.where(held), "doc_id").select("score", "toxic").collect()
    toxic = [r.score >= toxicity.THRESHOLD for r in got if r.toxic]
    clean = [r.score < toxicity.THRESHOLD for r in got if not r.toxic]
    # about one in fourteen of the documents labelled toxic has no telling word
    assert len(toxic) > 100 and sum(toxic) / len(toxic) > 0.8 and sum(clean) / len(clean) > 0.985


@pytest.fixture(scope="module")
def biased():
    """Labelled texts in which one group is mostly named in toxic ones, and neutral texts on groups."""
    rng = random.Random(3)
    bland = [f"word{i}" for i in range(60)]
    texts, y = [], []
    for i in range(600):
        w = rng.choices(bland, k=12)
        toxic = i % 2
        if toxic:
            w.insert(3, rng.choice(["vile", "scum", "idiot"]))
        if rng.random() < (0.7 if toxic else 0.02):
            w.insert(6, "muslims")
        if rng.random() < 0.1:
            w.insert(2, "christians")
        texts.append(" ".join(w) + ".")
        y.append(float(toxic))
    say = lambda g: " ".join(rng.choices(bland, k=5)) + f" {g} " + " ".join(rng.choices(bland, k=5)) + "."
    return texts, np.array(y), [say("muslims") for _ in range(100)], [say("scum") for _ in range(100)], say


def test_swapping_groups_cuts_false_positives(biased):
    texts, y, neutral, toxic, say = biased
    plain, fair = fit(texts, y, counterfactual=0), fit(texts, y)
    mean = lambda m, t: m.scores(pa.array(t)).mean()
    assert mean(fair, neutral) < 0.7 * mean(plain, neutral) and mean(fair, neutral) < 0.5
    assert mean(fair, toxic) > 0.5
    gap = lambda m: abs(mean(m, [t.replace("muslims", "christians") for t in neutral]) - mean(m, neutral))
    assert gap(fair) < 0.25 * gap(plain)


def test_gradient_and_scores_are_those_of_plain_loops():
    rng = np.random.default_rng(4)
    sentences = [sorted(set(rng.integers(0, 9, 4).tolist())) for _ in range(7)]
    y, weight = rng.integers(0, 2, 7).astype(float), rng.random(7)
    pairs = [(sorted(set(rng.integers(0, 9, 3).tolist())), sorted(set(rng.integers(0, 9, 3).tolist()))) for _ in range(5)]
    flat = lambda sets: (np.array([i for i, s in enumerate(sets) for _ in s]), np.array([f for s in sets for f in s]))

    def loss(w, b):
        total = 0.0
        for s, t, k in zip(sentences, y, weight):
            p = 1 / (1 + math.exp(-(b + sum(w[f] for f in s))))
            total -= k * (math.log(p) if t else math.log(1 - p))
        total += 3.0 * sum((sum(w[f] for f in a) - sum(w[f] for f in c)) ** 2 for a, c in pairs) / len(pairs)
        return total + 0.01 / 2 * sum(x * x for x in w)

    w, b = rng.normal(size=9), 0.3
    g, gb = toxicity.gradient(w, b, *flat(sentences), y, weight, [flat([p[0] for p in pairs]), flat([p[1] for p in pairs])], 5, 3.0, 0.01)
    step = lambda k, e: loss([x + e * (i == k) for i, x in enumerate(w)], b)
    assert np.allclose(g, [(step(k, 1e-5) - step(k, -1e-5)) / 2e-5 for k in range(9)], atol=1e-6)
    assert gb == pytest.approx((loss(w, b + 1e-5) - loss(w, b - 1e-5)) / 2e-5, abs=1e-6)

    texts = ["One fish. Two fish! Red", "lone words here", "a. b. c. d?", "...", "Überall ist es schön\nnicht hier"]
    m = toxicity.Model(rng.normal(size=1 << toxicity.BITS), -0.2)
    want = []
    for t in texts:
        sums = []
        for s in re.split(r"[.!?\n]", t):
            feats = set()
            for x in re.findall(rb"[a-z\x80-\xff]+", "".join(c.lower() if c.isascii() else c for c in s).encode()):
                whole = vec.prefix_sums(np.frombuffer(x, np.uint8))
                feats.add(int(vec.spans(whole, np.array([0]), np.array([len(x)]))[0]) % (1 << toxicity.BITS))
                feats |= {(int(vec.spans(whole, np.array([0]), np.array([n]))[0]) + n) % (1 << toxicity.BITS) for n in toxicity.PREFIXES if len(x) > n}
            if feats:
                sums.append(m.b + sum(float(m.w[f]) for f in feats))
        sums.sort(reverse=True)
        want.append(1 / (1 + math.exp(-(sums[0] + sums[min(1, len(sums) - 1)]) / 2)) if sums else 0.0)
    assert np.allclose(m.scores(pa.array(texts)), want, atol=1e-6)


def test_no_texts_and_few_sentences_go_to_the_driver():
    (n, own, feat), a, b = toxicity.encode("Women sing here. " + "word. " * 5000, most=40)
    assert n == 40 and own.max() == 39 and len(own) == len(feat) < 400 and a[0] == b[0] == 3
    whole = toxicity.encode("Women sing here. " + "word. " * 39, most=40)[0]
    assert whole[0] == 40 and set(whole[2]) == set(feat)


def test_swaps_name_each_other_group_once():
    assert swaps(["Women sing. Nobody else.", "menace", "no group"]) == [("Women sing", x + " sing") for x in ("men", "girls", "boys")]


def test_slicing_does_not_matter(monkeypatch, biased):
    texts, y, *_ = biased
    m = fit(texts, y, epochs=5)
    t = pa.array(["One. Two! scum idiot?\nthree", None, "", "é", "12 34", "vile " * 4000])
    a = m.scores(t)
    monkeypatch.setattr(toxicity.vec.slices, "__defaults__", (16,))
    assert np.allclose(a, m.scores(t)) and a[1] == a[2] == a[4] == 0


def test_defined_cases(spark):
    rows = [(1, "a scum. line"), (2, None), (3, ""), (None, "a scum. line"), (1, "a scum. line"), (4, "fine " * 60000), (5, "fine line"), (6, "123")]
    docs = spark.createDataFrame([(*r, "k", 2) for r in rows], "doc_id long, text string, score string, toxic int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (5, 0), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    assert train(docs, labels.where("doc_id = 1")) == 1.0 and train(docs, labels.limit(0)) == 0.0 and train(docs.limit(0), labels) == 0.0
    out = scores(docs, train(docs, labels, least=1)).collect()
    got = {r.doc_id: r.score for r in out}
    assert len(out) == 8 and out[0].asDict().keys() == {"doc_id", "text", "score", "toxic"}
    assert got[2] == got[3] == got[6] == 0 and got[1] == got[None] > got[5]
    assert {r.doc_id for r in scores(docs, 0.7).collect() if r.score == 0.7} == {1, None, 4, 5}
    assert scores(docs.limit(0), 0.7).collect() == []
