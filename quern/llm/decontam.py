"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared as runs of lower-cased letters and digits with one space between. The needles of a benchmark
item are all its runs of ``NEEDLE`` characters (a shorter item is one needle). A needle of m characters that
occurs with at most k = m * ERRORS edits shares at least m - q + 1 - k*q of its q-grams with the document within
k + 1 neighbouring diagonals (document position less item position). So the q-grams that a document shares
with an item are put in overlapping bands of 2(k+1) diagonals, each band one half further than the last; the needles
that hold as many of a band's q-grams as the bound says are verified by a banded alignment. The filter loses no
occurrence. A document leaks an item if any needle of it verifies, as does any verbatim run of ``NEEDLE`` characters.

The index of the q-grams is sent to the executors, at most about ``INDEX_CHARS`` of benchmark text at a time (28 bytes a character at most); a
larger benchmark takes several passes over the documents, which find the same rows: a needle is known by its text and place.

Defined cases: rows with a null id or null text match nothing; an item of fewer than ``Q`` such characters
has no q-gram and is left out; items of equal text are all reported; an item id may have several texts, whose needles all count;
repeated document rows are reported once; empty tables give no rows; texts are searched whole; columns besides the four named are
ignored. Letters and digits are those of Unicode in all planes up to the second, above which all up to the third are ideographs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import vec
from quern.llm.frames import cols

Q = 12
NEEDLE = 96
ERRORS = 1 / 16
INDEX_CHARS = 4_000_000
_TABLE: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point to its lower-case letter or digit, 0 for anything else; the last place stands for all above the table."""
    if not _TABLE:
        t = np.zeros(0x40001, np.uint32)
        t[0x20000:0x40000] = np.arange(0x20000, 0x40000)
        for c in range(0x20000):
            if chr(c).isalnum():
                low = chr(c).lower()
                t[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(t)
    return _TABLE[0]


def normal(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points without punctuation and with single spaces, and the rows' offsets in them."""
    t = fold_table()
    if not len(cp):
        return cp, np.zeros_like(off)
    m = t[np.minimum(cp, len(t) - 1)]
    solid = m > 0
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    at = np.flatnonzero(keep)
    return np.where(solid[at], m[at], 32).astype(np.uint32), np.searchsorted(at, off)


def grams(values: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of q values."""
    if len(values) < q:
        return np.zeros(0, np.uint64)
    s = vec.prefix_sums(values)
    _, inv = vec.powers(len(s))
    h = (s[q:] - s[:-q]) * inv[: len(values) - q + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


class Index:
    """The q-grams of all items (id, key of the text, text), sorted, with a bitmap before them."""

    def __init__(self, items: list[tuple[int, int, str]], q: int = Q, needle: int = NEEDLE, errors: float = ERRORS) -> None:
        self.q = q
        item, key, text, sizes = [], [], [], []
        for i, k, t in sorted(items):
            v, _ = normal(*vec.codepoints(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])))
            v = v[:-1] if len(v) and v[-1] == 32 else v
            if len(v) >= q:
                item.append(i)
                key.append(k)
                text.append(v)
        self.item, self.key = np.array(item, np.int64), np.array(key, np.int64)
        self.length = np.array([len(x) for x in text], np.int64)
        self.size = np.minimum(self.length, needle)
        self.first = np.cumsum(self.length) - self.length
        # beyond this many edits the bound would fall under one shared q-gram
        self.edits = np.array([min(int(m * errors), (m - q) // q) for m in self.size], np.int64)
        self.least = self.size - q + 1 - self.edits * q
        self.text = np.concatenate([*text, np.zeros(needle, np.uint32)])
        h = [grams(v, q) for v in text]
        sizes = [len(x) for x in h]
        all_h = np.concatenate(h) if h else np.zeros(0, np.uint64)
        order = np.argsort(all_h, kind="stable")
        self.hash = all_h[order]
        self.own = np.repeat(np.arange(len(text), dtype=np.int32), sizes)[order]
        self.pos = (np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) if sizes else np.zeros(0, np.int32))[order]
        # 32 to 64 bits a q-gram, packed
        self.shift = np.uint64(64 - max(16, math.ceil(math.log2(32 * len(all_h) + 1))))
        flags = np.zeros(1 << (64 - int(self.shift)), bool)
        flags[self.hash >> self.shift] = True
        self.bitmap = np.packbits(flags, bitorder="little")

    def known(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be of a q-gram of some item."""
        slot = h >> self.shift
        return np.flatnonzero(self.bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)

    def matches(self, values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, entry of ``item``, needle's start in it, edits) of each verified needle and band; values and off from :func:`normal`."""
        none = np.zeros(0, np.int64)
        if not len(self.item) or len(values) < self.q:
            return none, none, none, none
        h = grams(values, self.q)
        at = self.known(h)
        lo = np.searchsorted(self.hash, h[at], "left")
        n = np.searchsorted(self.hash, h[at], "right") - lo
        row = np.searchsorted(off, at, "right") - 1
        n[at + self.q > off[row + 1]] = 0
        at, row, lo, n = (x[n > 0] for x in (at, row, lo, n))
        if not len(at):
            return none, none, none, none
        where = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        it, pos = self.own[where].astype(np.int64), self.pos[where].astype(np.int64)
        at, row = np.repeat(at, n), np.repeat(row, n)
        band = (at - pos) // (self.edits[it] + 1)
        row, it, pos, band = np.r_[row, row], np.r_[it, it], np.r_[pos, pos], np.r_[band, band - 1]
        order = np.lexsort((pos, band, it, row))
        row, it, pos, band = row[order], it[order], pos[order], band[order]
        new_band = np.r_[True, (row[1:] != row[:-1]) | (it[1:] != it[:-1]) | (band[1:] != band[:-1])]
        distinct = new_band | np.r_[True, pos[1:] != pos[:-1]]
        row, it, pos, band, group = row[distinct], it[distinct], pos[distinct], band[distinct], np.cumsum(new_band)[distinct]
        # from each q-gram on, the needles that hold it and enough of those that follow
        last = np.arange(len(pos)) + self.least[it] - 1
        end = np.minimum(last, len(pos) - 1)
        span = self.size[it] - self.q
        near = np.flatnonzero((last < len(pos)) & (group[end] == group) & (pos[end] - pos <= span))
        lo, hi, group = np.maximum(pos[end] - span, 0)[near], np.minimum(pos, self.length[it] - self.size[it])[near], group[near]
        # both ends rise within a band
        again = np.r_[False, group[1:] == group[:-1]]
        lo = np.where(again, np.maximum(lo, np.r_[0, hi[:-1] + 1]), lo)
        n = np.maximum(hi - lo + 1, 0)
        row, it, band = (np.repeat(x[near], n) for x in (row, it, band))
        start = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else none
        edits = np.concatenate([self.align(values, off, row[i : i + 4096], it[i : i + 4096], start[i : i + 4096], band[i : i + 4096]) for i in range(0, len(row), 4096)]) if len(row) else none
        ok = edits <= self.edits[it]
        return row[ok], it[ok], start[ok], edits[ok]

    def align(self, values: np.ndarray, off: np.ndarray, row: np.ndarray, it: np.ndarray, start: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Fewest edits between the needle at an item's start and any run of the row that starts in the band, all candidates at once."""
        k = self.edits[it]
        step = k + 1
        width = int((2 * step + 2 * k).max())
        base = band * step - k + start
        needle = self.first[it] + start
        col = np.arange(width)
        d = np.zeros((len(it), width), np.int32)
        best = np.full(len(it), 1 << 20)
        for i in range(int(self.size[it].max())):
            j = base[:, None] + i + col
            inside = (j >= off[row][:, None]) & (j < off[row + 1][:, None])
            c = np.where(inside, values[np.clip(j, 0, len(values) - 1)], 0)
            new = d + (c != self.text[np.minimum(needle + i, len(self.text) - 1)][:, None])
            new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
            d = np.minimum.accumulate(new - col, axis=1) + col
            done = self.size[it] == i + 1
            best[done] = d[done].min(1)
        return best


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = Q, needle: int = NEEDLE, errors: float = ERRORS, index_chars: int = INDEX_CHARS) -> DataFrame:
    """(doc_id, item_id, needles, edits): each item of which a document holds some needle, how many of its needles, and the fewest edits."""
    spark = docs.sparkSession
    own = cols(docs, id=id_col, text=text_col).where("id IS NOT NULL AND text IS NOT NULL").select(F.col("id").cast("long").alias("id"), "text")
    items = cols(benchmark, item=item_col, text=item_text_col).where("item IS NOT NULL AND text IS NOT NULL").select(F.col("item").cast("long").alias("item"), "text").distinct().withColumn("key", F.xxhash64("item", "text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-chars // index_chars))
    found = None
    for p in range(passes):
        part = (items.where(F.pmod("key", F.lit(passes)) == p) if passes > 1 else items).select("item", "key", "text")
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in part.collect()], q, needle, errors))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for b in batches:
                ids = np.asarray(b.column("id"))
                for i, _, buf, off in vec.slices(b.column("text")):
                    row, it, start, edits = ix.matches(*normal(*vec.codepoints(buf, off)))
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[i + row]), pa.array(ix.item[it]), pa.array(ix.key[it]), pa.array(start), pa.array(edits.astype(np.int64))], ["doc_id", "item_id", "key", "start", "edits"])

        got = own.mapInArrow(run, "doc_id long, item_id long, key long, start long, edits long")
        found = got if found is None else found.union(got)
    return found.groupBy("doc_id", "item_id").agg(F.countDistinct("key", "start").alias("needles"), F.min("edits").alias("edits"))
