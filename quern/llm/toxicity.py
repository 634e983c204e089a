"""Toxicity by a counterfactually regularised classifier.

A text is a set of sentences (up to ``. ! ?`` or a line's end), a sentence the set of its words and word beginnings, hashed. A linear score of each
sentence is fitted to the document's label, and the document's score is that of its two worst sentences. For every labelled sentence
that names a group, swapped sentences put other groups in its place, and the squared change of score is added to the
loss: naming a group, as such, then moves the score no more than naming another. Features that occur in fewer than
``LEAST`` of the labelled documents have no weight, so a group never seen in training has none either.

Fitted on at most ``SAMPLE`` labelled documents (those of least id hash) and ``SENTENCES`` sentences of each, evenly spaced; what goes to the driver
are hashed features, no texts. All documents are scored, all their sentences.

Defined cases: a null text or one without a letter scores 0; a null id is scored as any row; contradicting labels of one id count as toxic;
null labels are ignored; repeated rows are scored each; with labels of one kind only, or none, the score is their share of toxic
(0 for none); columns besides the named are ignored by the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quern.llm import vec
from quern.llm.frames import cols

SAMPLE = 4000
SENTENCES = 512
THRESHOLD = 0.4
LEAST = 5
BITS = 18
PREFIXES = (3, 4, 5, 6, 7)
EPOCHS = 100
DECAY = 3e-4
COUNTERFACTUAL = 10.0
#: Terms that stand for each other; a sentence that holds one is also seen with the others of its line.
IDENTITIES = """
women men girls boys
muslims christians jews hindus buddhists atheists catholics sikhs
muslim christian jewish hindu buddhist atheist catholic sikh
gays lesbians heterosexuals transgender bisexuals
gay lesbian straight bisexual queer
blacks whites asians latinos africans europeans arabs
black white asian latino african european arab
immigrants refugees foreigners natives
frauen männer
muslime christen juden hindus atheisten
schwule lesben heterosexuelle
femmes hommes
musulmans chrétiens juifs athées
mujeres hombres
musulmanes cristianos judíos ateos
"""
_SENTENCE = np.zeros(256, bool)
_SENTENCE[[ord(c) for c in ".!?\n"]] = True


def groups(identities: str = IDENTITIES) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for line in identities.strip().splitlines():
        for w in line.split():
            out.setdefault(w, []).extend(x for x in line.split() if x != w)
    return out


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each sentence, sentence of each feature, feature), distinct in a sentence, slice by slice."""
    mask = np.uint64((1 << BITS) - 1)
    for i, _, buf, off in vec.slices(texts):
        buf = vec.LOWER[buf]
        start, end, row = vec.words(buf, off, vec.LETTER)
        if not len(start):
            continue
        stops = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(_SENTENCE[buf], out=stops[1:])
        after = stops[start]
        new = np.r_[True, (after[1:] != after[:-1]) | (row[1:] != row[:-1])]
        sent = np.cumsum(new) - 1
        sums = vec.prefix_sums(buf)
        own, feat = [sent], [vec.spans(sums, start, end) & mask]
        for n in PREFIXES:
            long = end - start > n
            own.append(sent[long])
            feat.append(vec.spans(sums, start[long], start[long] + n) + np.uint64(n) & mask)
        key = np.unique(np.concatenate(own).astype(np.uint64) << np.uint64(BITS) | np.concatenate(feat))
        yield i + row[new], (key >> np.uint64(BITS)).astype(np.int64), (key & mask).astype(np.int64)


def _sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`features`, over all slices."""
    rows, own, feat, n = [], [], [], 0
    for r, s, f in features(pa.array(texts, pa.large_string())):
        rows.append(r)
        own.append(s + n)
        feat.append(f)
        n += len(r)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, own, feat))


def swaps(texts: list[str], identities: str = IDENTITIES) -> list[tuple[str, str]]:
    """(sentence, the sentence with another group) for each group named in a sentence of the texts."""
    other = groups(identities)
    name = re.compile(rf"(?i)(?<!\w)(?:{'|'.join(map(re.escape, other))})(?!\w)")
    out = []
    for t in texts:
        if not name.search(t):
            continue
        for s in re.split(r"[.!?\n]", t):
            for m in name.finditer(s):
                out += [(s, s[: m.start()] + o + s[m.end() :]) for o in other[m.group().lower()]]
    return out


def worst_of(z: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The mean of the two highest sentences of each of n texts, or its only one's; -inf without one. ``row`` rises."""
    out = np.full(n, -np.inf)
    if len(row):
        z = z[np.lexsort((-z, row))]
        at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        second = np.minimum(at + 1, np.r_[at[1:], len(row)] - 1)
        out[row[at]] = (z[at] + z[second]) / 2
    return out


class Model:
    """A weight for each hashed feature, and what every sentence starts from."""

    def __init__(self, w: np.ndarray, b: float) -> None:
        self.w, self.b = w.astype(np.float32), float(b)

    def worst(self, texts: pa.Array) -> np.ndarray:
        """The mean sum of the two highest sentences of each text, or its only one's."""
        out = np.full(len(texts), -np.inf)
        for row, own, feat in features(texts):
            some = worst_of(self.b + np.bincount(own, self.w[feat], len(row)), row, len(texts))
            out = np.where(np.isfinite(some), some, out)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        """From 0 to 1: that of the two worst sentences."""
        return 1 / (1 + np.exp(-self.worst(texts)))


Sets = tuple[int, np.ndarray, np.ndarray]


def encode(text: str, identities: str = IDENTITIES, most: int = SENTENCES) -> tuple[Sets, Sets, Sets]:
    """(number, sentence of each feature, feature) of a text's sentences, of those that name a group once for each swap, and of the swapped."""
    row, own, feat = _sets([text])
    if len(row) > most:
        kept = np.linspace(0, len(row) - 1, most).astype(np.int64)
        place = np.full(len(row), -1)
        place[kept] = np.arange(most)
        m = place[own] >= 0
        row, own, feat = row[kept], place[own[m]], feat[m]
    pairs = swaps([text], identities)
    out: list[Sets] = [(len(row), own, feat)]
    for k in (0, 1):
        r, s, f = _sets([p[k] for p in pairs])
        out.append((len(pairs), r[s], f))
    return out[0], out[1], out[2]


def _joined(parts: list[Sets]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each sentence, sentence of each feature, feature) of several texts."""
    n = np.array([p[0] for p in parts], np.int64)
    before = np.cumsum(n) - n
    empty = [np.zeros(0, np.int64)]
    return np.repeat(np.arange(len(parts)), n), np.concatenate([p[1] + b for p, b in zip(parts, before)] or empty), np.concatenate([p[2] for p in parts] or empty)


def gradient(w: np.ndarray, b: float, own: np.ndarray, feat: np.ndarray, y: np.ndarray, weight: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]], pairs: int, counterfactual: float, decay: float) -> tuple[np.ndarray, float]:
    """Of the weighted log loss of sentences with labels y, counterfactual times the mean squared change over pairs, and decay / 2 times the squared weights."""
    z = b + np.bincount(own, w[feat], len(y))
    gs = (1 / (1 + np.exp(-z)) - y) * weight
    g = np.bincount(feat, gs[own], len(w)) + decay * w
    if pairs:
        d = np.bincount(sides[0][0], w[sides[0][1]], pairs) - np.bincount(sides[1][0], w[sides[1][1]], pairs)
        d *= 2 * counterfactual / pairs
        g += np.bincount(sides[0][1], d[sides[0][0]], len(w)) - np.bincount(sides[1][1], d[sides[1][0]], len(w))
    return g, gs.sum()


def fit(texts: list[str], y: np.ndarray, identities: str = IDENTITIES, **options) -> Model:
    """:func:`fit_encoded` on texts."""
    return fit_encoded([encode(t, identities) for t in texts], y, **options)


def fit_encoded(encoded: list[tuple[Sets, Sets, Sets]], y: np.ndarray, counterfactual: float = COUNTERFACTUAL, epochs: int = EPOCHS, decay: float = DECAY, rate: float = 0.05, least: int = LEAST) -> Model:
    """Adam on the log loss of the sentences under their documents' labels, both labels and all documents of equal
    weight; then scale and start fitted to the worst sentences of every fourth document, which the weights haven't seen."""
    n = len(encoded)
    row, every_own, every_feat = _joined([e[0] for e in encoded])
    seen = np.bincount(np.unique(every_feat * n + row[every_own]) // n, minlength=1 << BITS)
    learn = np.zeros(n, bool)
    for k in (0, 1):
        learn[[i for j, i in enumerate(np.flatnonzero(y == k)) if j % 4 or j == 0]] = True
    keep = (seen[every_feat] >= least) & learn[row[every_own]]
    own, feat = every_own[keep], every_feat[keep]
    used, feat = np.unique(feat, return_inverse=True)
    count = np.bincount(row, minlength=n)
    share = y[learn].mean()
    weight = np.where(learn & (count > 0), np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / np.maximum(count, 1), 0)[row] / learn.sum()
    pairs, sides = 0, []
    for k in (1, 2):
        which, s, f = _joined([e[k] for e, x in zip(encoded, learn) if x])
        pairs = len(which) if counterfactual else 0
        pos = np.minimum(np.searchsorted(used, f), max(len(used) - 1, 0))
        ok = used[pos] == f if len(used) else np.zeros(0, bool)
        sides.append((s[ok], pos[ok]))
    w, b = np.zeros(len(used)), 0.0
    m1, m2 = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, epochs + 1):
        g = np.r_[gradient(w, b, own, feat, y[row], weight, sides, pairs, counterfactual, decay)]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    full = np.zeros(1 << BITS)
    full[used] = w
    test = ~learn if len(np.unique(y[~learn])) == 2 else learn
    z = worst_of(b + np.bincount(every_own, full.astype(np.float32)[every_feat], len(row)), row, n)
    test &= np.isfinite(z)
    scale, start = platt(z[test], y[test])
    return Model(full * scale, b * scale + start)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and start of the logistic curve through (z, y), by Newton's method under a weak prior."""
    mean, std = z.mean(), z.std() + 1e-9
    x = np.stack([(z - mean) / std, np.ones_like(z)], 1)
    v = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        move = np.linalg.solve(h, x.T @ (p - y) + 0.1 * (v - [1.0, 0.0]))
        v = v - move / max(1.0, float(np.abs(move).max()))
    return (float(v[0] / std), float(v[1] - v[0] * mean / std)) if v[0] > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE, **options) -> Model | float:
    """The fitted model; the labels' share of toxic where they are not of both kinds."""
    named = cols(labels, id=id_col, label=label_col).where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
    chosen = named.orderBy(F.xxhash64("id"), "id").limit(most)
    text = cols(docs, id=id_col, text=text_col).where("id IS NOT NULL AND text IS NOT NULL")
    # at most `most` rows are sent and come back, as features
    picked = text.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    ints = pa.list_(pa.int32())
    identities = options.pop("identities", IDENTITIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column("text").to_pylist()):
                if vec.LETTER[np.frombuffer(t.encode(), np.uint8)].any():
                    e = encode(t, identities)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(c).slice(i, 1) for c in ("id", "label")] + [pa.array([[x[0] for x in e]], ints)] + [pa.array([x[k].astype(np.int32)], ints) for x in e for k in (1, 2)], ["id", "label", "n", *"abcdef"]
                    )

    sent = picked.select(F.col("id").cast("long").alias("id"), "text", F.col("label").cast("long").alias("label")).mapInArrow(run, "id long, label long, n array<int>, " + ", ".join(f"{c} array<int>" for c in "abcdef"))
    got = sent.toArrow().combine_chunks().sort_by("id")
    y = (np.asarray(got.column("label")) > 0).astype(float)
    if len(np.unique(y)) < 2:
        return float(y.mean()) if len(y) else 0.0
    lists = {c: got.column(c).combine_chunks() for c in "abcdef"}
    of = lambda c, i: np.asarray(lists[c][i].values).astype(np.int64)
    encoded = [tuple((n, of(a, i), of(b, i)) for n, a, b in zip(ns, "ace", "bdf")) for i, ns in enumerate(got.column("n").to_pylist())]
    return fit_encoded(encoded, y, **options)


def scores(docs: DataFrame, model: Model | float, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each row; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for texts in batches:
            if isinstance(m, Model):
                yield pa.array(m.scores(texts))
            else:
                some = np.zeros(len(texts))
                for row, _, _ in features(texts):
                    some[row] = m
                yield pa.array(some)

    score = score.asNondeterministic()
    return docs.withColumn(score_col, score(F.col(f"`{text_col}`")))
