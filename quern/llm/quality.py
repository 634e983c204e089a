"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded by a small network over
its character classes, word statistics and hashed byte pairs; a gated attention (tanh times sigmoid)
weighs the passages, and the weighted representation is scored. Encoder, attention and score are
fitted together from document labels by full-batch Adam on at most ``SAMPLE`` labelled documents (those of
least id hash); everything else is scored as a whole.

Defined cases: a null or blank text has no passage and scores 0; a null id is scored and kept as any row; contradicting
labels of one id count as the lowest; a label that is null or has no text is ignored; repeated rows are scored each; with
labels of one kind only, or none, the score is their share (0.5 for none); columns besides the named are ignored by the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import vec
from quern.llm.frames import cols

PASSAGE = 64
SAMPLE = 2000
THRESHOLD = 0.5
EPOCHS = 300
HIDDEN = 24
PAIRS = 32
_CLASSES = 12
WIDTH = _CLASSES + 7 + PAIRS

_CLASS = np.full(256, 9, np.uint8)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[32] = 3
_CLASS[[9, 10, 13]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-?"]] = 5
_CLASS[ord("!")] = 6
_CLASS[[ord(c) for c in "#$%&*@^~"]] = 7
_CLASS[[ord(c) for c in "|<>{}[]()=+/\\_`"]] = 8
_CLASS[128:192] = 10
_CLASS[192:] = 11


def passages(texts: pa.Array, size: int = PASSAGE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, features) of all passages, slice by slice."""
    for i, _, buf, off in vec.slices(texts):
        start, end, row = vec.words(buf, off)
        if not len(start):
            continue
        first_of_row = np.r_[True, row[1:] != row[:-1]]
        at = np.flatnonzero(first_of_row)
        nth = np.arange(len(start)) - np.repeat(at, np.diff(np.r_[at, len(start)]))
        head = nth % size == 0
        pid = np.cumsum(head) - 1
        n = int(pid[-1]) + 1
        begin, first = start[head], np.flatnonzero(head)
        words = np.diff(np.r_[first, len(start)])
        stop = end[np.r_[first[1:] - 1, len(end) - 1]]
        own = np.repeat(np.arange(n), stop - begin)
        where = np.repeat(begin - np.r_[0, np.cumsum(stop - begin)[:-1]], stop - begin) + np.arange((stop - begin).sum())
        b = buf[where]
        size_b = (stop - begin).astype(np.float32)
        f = np.zeros((n, WIDTH), np.float32)
        f[:, :_CLASSES] = np.bincount(own * _CLASSES + _CLASS[b], minlength=n * _CLASSES).reshape(n, _CLASSES) / size_b[:, None]
        low = vec.LOWER[b].astype(np.int64)
        pair = ((low[:-1] * 31 + low[1:]) * 0x9E3779B1 >> 16) % PAIRS
        slot = (own[:-1] * PAIRS + pair)[own[1:] == own[:-1]]
        f[:, -PAIRS:] = np.bincount(slot, minlength=n * PAIRS).reshape(n, PAIRS) * (8 / size_b[:, None])
        h = vec.word_hashes(vec.LOWER[buf], start, end)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & ~head[1:]
        order = np.lexsort((h, pid))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (pid[order][1:] != pid[order][:-1])]
        last, init = buf[end - 1], buf[start]
        length = (end - start).astype(np.float32)
        stats = (same, None, (_CLASS[last] == 6) | (_CLASS[last] == 7), _CLASS[init] == 1, length / 8, np.minimum(length, 40) ** 2 / 200)
        for k, s in enumerate(stats):
            own_w, val = (pid[order], new) if s is None else (pid, s)
            f[:, _CLASSES + k] = np.bincount(own_w, weights=val.astype(np.float32), minlength=n) / words
        f[:, _CLASSES + 6] = np.log1p(words) / 4
        yield i + row[first], f


def _sum(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, at, axis=0)


class Attention:
    """Passage encoder, gated attention and score."""

    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.p = parts

    def forward(self, x: np.ndarray, at: np.ndarray, own: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh((x - p["mean"]) / p["std"] @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, at)[own])
        a /= _sum(a, at)[own]
        z = _sum(a[:, None] * h, at)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))}

    def score(self, x: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bags, scores) of passages that are ordered by bag."""
        at = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]])
        own = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(bag)]))
        return bag[at], self.forward(x, at, own)["y"]


NAMES = ("W", "b", "V", "U", "w", "c", "d")


def gradient(m: Attention, x: np.ndarray, at: np.ndarray, own: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
    """Of the mean log loss of the bags, and decay / 2 times the squared weights but for b and d."""
    p, xn = m.p, (x - m.p["mean"]) / m.p["std"]
    f = m.forward(x, at, own)
    h, t, s, a, z = (f[n] for n in ("h", "t", "s", "a", "z"))
    do = (f["y"] - y) / len(y)
    dz = np.outer(do, p["c"])[own]
    da = (h * dz).sum(1)
    de = a * (da - _sum(a * da, at)[own])
    g = np.outer(de, p["w"])
    dt, ds = g * s * (1 - t * t), g * t * s * (1 - s)
    dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
    grad = {"W": xn.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ do, "d": do.sum()}
    return {n: grad[n] + decay * p[n] * (n not in "bd") for n in NAMES}


def fit(x: np.ndarray, bag: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, hidden: int = HIDDEN, decay: float = 1e-4, rate: float = 0.01, seed: int = 2) -> Attention:
    """Adam on the mean log loss of the bags; bag counts from 0 in order, y has a label for each bag."""
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    k = hidden // 2
    p = {"mean": x.mean(0), "std": x.std(0) + 1e-3, "W": draw(x.shape[1], hidden), "b": np.zeros(hidden), "V": draw(hidden, k), "U": draw(hidden, k), "w": draw(k), "c": draw(hidden), "d": np.zeros(())}
    m = Attention(p)
    at = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]])
    own = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(bag)]))
    m1, m2 = ({n: np.zeros_like(p[n]) for n in NAMES} for _ in range(2))
    for step in range(1, epochs + 1):
        grad = gradient(m, x, at, own, y, decay)
        for n in NAMES:
            m1[n] = 0.9 * m1[n] + 0.1 * grad[n]
            m2[n] = 0.999 * m2[n] + 0.001 * grad[n] * grad[n]
            p[n] = p[n] - rate * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.999**step)) + 1e-8)
    return m


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bag, label) of the passages of at most ``most`` labelled documents, by least id hash."""
    named = cols(labels, id=id_col, label=label_col).where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.min("label").alias("label"))
    chosen = named.orderBy(F.xxhash64("id"), "id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, f in passages(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), b.column("label").take(pa.array(row)), pa.array(list(f), pa.list_(pa.float32()))], ["id", "label", "f"])

    text = cols(docs, id=id_col, text=text_col).where("id IS NOT NULL AND text IS NOT NULL")
    # the chosen ids are at most `most` rows; one row of text stands for an id
    picked = text.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    t = picked.select(F.col("id").cast("long").alias("id"), "text", F.col("label").cast("long").alias("label")).mapInArrow(run, "id long, label long, f array<float>").toArrow()
    if not t.num_rows:
        return np.zeros((0, WIDTH)), np.zeros(0, np.int64), np.zeros(0)
    f = np.asarray(t.column("f").combine_chunks().flatten()).reshape(t.num_rows, WIDTH).astype(np.float64)
    ids, label = np.asarray(t.column("id")), np.asarray(t.column("label")).astype(np.float64)
    order = np.argsort(ids, kind="stable")
    ids, bag = np.unique(ids[order], return_inverse=True)
    first = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]])
    return f[order], bag, label[order][first]


def train(docs: DataFrame, labels: DataFrame, **named: str) -> Attention | float:
    """The fitted model; the labels' share of good where they are not of both kinds."""
    x, bag, y = sample(docs, labels, **named)
    if len(np.unique(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    return fit(x, bag, y)


def scores(docs: DataFrame, model: Attention | float, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each row; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for texts in batches:
            out = np.zeros(len(texts))
            for row, f in passages(texts):
                bags, y = (np.unique(row), m) if isinstance(m, float) else m.score(f, row)
                out[bags] = y
            yield pa.array(out)

    # else the optimiser would copy the call into a filter on the score
    score = score.asNondeterministic()
    return docs.withColumn(score_col, score(F.col(f"`{text_col}`")))
