"""SimHash near-duplicates by random bit sampling.

A document's 128-bit SimHash sums over its distinct lower-cased words. Documents of one fingerprint
are joined at once. Distinct fingerprints then go to hash tables; each table groups by its
own sample of ``BITS`` coordinates, and each pair of a bucket within ``DISTANCE`` differing bits is verified. There are
as many tables as a lone pair at that distance needs to be found with a probability of ``RECALL``, whatever the
input's size: a bucket of more than ``BUCKET`` fingerprints is compared in full, or by tables of its own, over the
remaining coordinates and as many as give ``INNER`` of its pairs, whichever is less work. ``INNER`` is counted in
``RECALL``. Verified pairs are reduced to a spanning forest in each bucket, so output
stays linear even in a group of thousands, and the groups are the connected components.

Defined cases: a null or blank text has no words, so no fingerprint, and is in no group; a null id is in
no group; repeated rows of one id count once (a group needs two ids); an empty table gives no rows; columns besides the two named are
ignored. Very long texts are hashed whole. Word case is folded for ASCII letters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import vec
from quern.llm.frames import cols, components
from quern.session import settle

NBITS = 128
DISTANCE = 24
BITS = 14
BUCKET = 512
RECALL = 0.93
INNER = 0.95
#: Buckets of up to so many fingerprints are compared all at once, neighbour by neighbour.
SMALL = 64
SEED = 20


def shared(distance: int, bits: int, nbits: int = NBITS) -> float:
    """Probability that a pair at ``distance`` agrees in a sample of ``bits`` of ``nbits`` coordinates."""
    return math.comb(max(0, nbits - distance), bits) / math.comb(nbits, bits)


def needed(p: float, recall: float) -> int:
    """Tables after which a pair that each finds with probability ``p`` is found with ``recall``."""
    return 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log(1 - max(p, 1e-6)))


def tables_for(distance: int = DISTANCE, bits: int = BITS) -> int:
    return needed(shared(distance, bits) * INNER, RECALL)


def sketch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, number of distinct words) of each row, as int64."""
    n = len(texts)
    hi, lo, count = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    for i, j, buf, off in vec.slices(texts):
        buf = vec.LOWER[buf]
        start, end, row = vec.words(buf, off)
        if not len(start):
            continue
        h = vec.word_hashes(buf, start, end)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[first], row[first]
        at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        rows, per = row[at], np.diff(np.r_[at, len(row)])
        count[i + rows] = per
        for out, v in ((hi, h), (lo, vec.mix(h ^ np.uint64(0x5851F42D4C957F2D)))):
            bits = np.unpackbits(v.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            sums = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
            out[i + rows] = ((2 * sums > per[:, None]) * weights).sum(1, dtype=np.uint64)
    return hi.view(np.int64), lo.view(np.int64), count


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hi, lo) of each document that has an id and a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hi, lo, count = sketch(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(hi), pa.array(lo)], ["id", "hi", "lo"]).filter(pa.array(count > 0))

    own = cols(docs, id=id_col, text=text_col).where("id IS NOT NULL AND text IS NOT NULL").select(F.col("id").cast("long").alias("id"), "text")
    return own.mapInArrow(run, "id long, hi long, lo long")


def coordinates(tables: int, nbits: int = NBITS, seed: int = SEED) -> np.ndarray:
    """A random order of all coordinates for each table: the first ones are its key, the others are for its large buckets."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(nbits) for _ in range(tables)])


def bit(hi: np.ndarray, lo: np.ndarray, c: int) -> np.ndarray:
    return ((lo if c < 64 else hi) >> np.uint64(c % 64)) & np.uint64(1)


def keys(hi: np.ndarray, lo: np.ndarray, coords: np.ndarray) -> np.ndarray:
    """The bits at the coordinates, as a number."""
    key = np.zeros(len(hi), np.int64)
    for c in coords:
        key = key << 1 | bit(hi, lo, int(c)).astype(np.int64)
    return key


def runs(key: np.ndarray) -> Iterator[np.ndarray]:
    """The places of each key that occurs more than once."""
    by = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1], True])
    for s, e in zip(cut[:-1][np.diff(cut) > 1], cut[1:][np.diff(cut) > 1]):
        yield by[s:e]


def groups(hi: np.ndarray, lo: np.ndarray, rest: np.ndarray, distance: int, most: int, seed: int) -> Iterator[np.ndarray]:
    """Sets in which a pair within ``distance`` meets with probability INNER or more: all, or those of tables over ``rest``."""
    n = len(hi)
    least, bits, count = n * n, 0, 1
    if n > most:
        rng = np.random.default_rng([SEED, seed])
        trial = rng.permutation(rest)
        for b in range(2, min(24, len(rest) - distance), 2):
            t = needed(shared(distance, b, len(rest)), INNER)
            sizes = np.unique(keys(hi, lo, trial[:b]), return_counts=True)[1].astype(np.int64)
            if (work := t * (int((sizes * sizes).sum()) + 64 * n)) < least:
                least, bits, count = work, b, t
    if not bits:
        yield np.arange(n)
        return
    for _ in range(count):
        yield from runs(keys(hi, lo, rng.permutation(rest)[:bits]))


def linked(hi: np.ndarray, lo: np.ndarray, sets: Iterator[np.ndarray], distance: int, side: int = BUCKET) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the pairs within ``distance`` of any set; compared in squares of ``side``."""
    root = np.arange(len(hi))
    out: list[tuple[int, int]] = []
    for idx in sets:
        for i in range(0, len(idx), side):
            for j in range(i, len(idx), side):
                x, y = idx[i : i + side], idx[j : j + side]
                apart = root[x][:, None] != root[y]
                if not apart.any():
                    continue
                near = np.bitwise_count(hi[x][:, None] ^ hi[y]) + np.bitwise_count(lo[x][:, None] ^ lo[y]) <= distance
                while len(a := np.flatnonzero((near & apart).any(1))):
                    for u, v in zip(x[a].tolist(), y[(near & apart)[a].argmax(1)].tolist()):
                        ru, rv = u, v
                        while root[ru] != ru:
                            ru = root[ru]
                        while root[rv] != rv:
                            rv = root[rv]
                        if ru != rv:
                            root[max(ru, rv)] = min(ru, rv)
                            out.append((u, v))
                    while (root[root] != root).any():
                        root = root[root]
                    apart = root[x][:, None] != root[y]
    return out


def with_pairs(key: np.ndarray, hi: np.ndarray, lo: np.ndarray, distance: int) -> np.ndarray:
    """Which rows, ordered by key, begin a key's run of at most SMALL rows that has a pair within ``distance``, or a longer run."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    run = np.repeat(np.arange(len(start)), size)
    found = size > SMALL
    at = np.flatnonzero(~found[run])
    for k in range(1, SMALL):
        at = at[at + k < len(key)]
        at = at[key[at + k] == key[at]]
        if not len(at):
            break
        near = np.bitwise_count(hi[at] ^ hi[at + k]) + np.bitwise_count(lo[at] ^ lo[at + k]) <= distance
        found[run[at[near]]] = True
    return start[found]


def near_edges(prints: DataFrame, distance: int = DISTANCE, tables: int | None = None, bits: int = BITS, most: int = BUCKET) -> DataFrame:
    """(a, b): a spanning forest of the verified pairs of each bucket; ``prints`` has distinct (hi, lo)."""
    tables = tables or tables_for(distance, bits)
    order = coordinates(tables)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hi, lo = (np.asarray(b.column(c)).view(np.uint64) for c in ("hi", "lo"))
            for t in range(tables):
                key = keys(hi, lo, order[t, :bits]) | t << bits
                yield pa.RecordBatch.from_arrays([pa.array(key), *(b.column(c) for c in ("id", "hi", "lo"))], ["key", "id", "hi", "lo"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (got := [b for b in batches if b.num_rows]):
            return
        t = pa.Table.from_batches(got)
        key, ids, hi, lo = (t.column(c).to_numpy() for c in ("key", "id", "hi", "lo"))
        hi, lo = hi.view(np.uint64), lo.view(np.uint64)
        by = np.lexsort((ids, key))
        key, ids, hi, lo = key[by], ids[by], hi[by], lo[by]
        a: list[int] = []
        b: list[int] = []
        for s in with_pairs(key, hi, lo, distance):
            e = np.searchsorted(key, key[s], "right")
            sets = groups(hi[s:e], lo[s:e], order[int(key[s]) >> bits, bits:], distance, most, int(key[s]))
            for x, y in linked(hi[s:e], lo[s:e], sets, distance):
                a.append(int(ids[s + x]))
                b.append(int(ids[s + y]))
        a_, b_ = np.array(a, np.int64), np.array(b, np.int64)
        pairs = np.unique(np.stack([np.minimum(a_, b_), np.maximum(a_, b_)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    rows = prints.select("id", "hi", "lo").mapInArrow(keyed, "key long, id long, hi long, lo long")
    return rows.repartition("key").mapInArrow(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, tables: int | None = None, bits: int = BITS, most: int = BUCKET) -> DataFrame:
    """(doc_id, kept_id): each document of a group but the kept one, which has the group's least id."""
    prints = settle(fingerprints(docs, id_col, text_col).distinct(), "prints")
    heads = prints.groupBy("hi", "lo").agg(F.min("id").alias("head"))
    same = prints.join(heads, ["hi", "lo"]).where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    edges = near_edges(heads.withColumnRenamed("head", "id"), distance, tables, bits, most)
    found = components(same.union(edges))
    return found.select(F.col("node").alias("doc_id"), F.col("root").alias("kept_id"))
