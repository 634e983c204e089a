"""Passages of at least ``LENGTH`` words that occur more than once, in several documents or in one, by sorted suffixes.

Suffixes are sorted twice. First the sparse ones: those that start at the least of any ``STRIDE``
neighbouring word-gram hashes. Any repeated passage holds such a start among its first ``STRIDE`` words, the
same one in each copy, with at least LENGTH - STRIDE + 1 words of the passage after it, its lead. These suffixes are sorted by the tokens of their leads, and
those that have a lead's length in common with a neighbour are the only places around which a passage can repeat; none is missed.
Then all suffixes around those places are sorted by the hash of their first LENGTH words, and equal ones are kept and joined into maximal spans:
a repeat of any length from LENGTH on is the union of its windows.

For a sort, splitters sampled over the corpus range-partition the suffixes by their leading tokens, equal ones by document and place, so that
even one passage of millions of copies is spread. There are as many buckets as the counted suffixes need. Each bucket is sorted by multikey quicksort, four
tokens a level; common prefixes of neighbours make its runs, and the runs that touch a bucket's ends are compared across the boundary.

A word is a run of bytes other than ASCII white space, compared exactly; a token, 16 bits of a word's hash, so what leads have in
common is made sure by the second sort (96 bits a window). Positions count words from 0.

Defined cases: rows with a null id or null text take no part; windows of one document may overlap their repeats ("a a a ..." repeats itself);
repeated rows of one id count once; texts under LENGTH words have none; whole texts are used; an empty table gives no rows; columns besides the two
named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import vec
from quern.llm.frames import cols
from quern.session import settle

LENGTH = 50
STRIDE = 25
GRAM = 4
LEAD = 2
#: Documents sampled for splitters, at most about so many; each gives one of SAMPLE_EACH of its starts.
SAMPLE_DOCS = 1 << 16
SAMPLE_EACH = 32
#: Suffixes that a task gathers before it packs them by bucket, and suffixes of a bucket, about.
PACK = 1 << 20
BUCKET = 1 << 20


def starts_of(sums: np.ndarray, row: np.ndarray, length: int, stride: int, gram: int) -> np.ndarray:
    """Word positions of the least gram of every ``stride`` neighbours that begin a run of ``length`` words in a row."""
    n = len(row)
    if n < length:
        return np.zeros(0, np.int64)
    g = np.arange(n - gram + 1)
    key = vec.spans(sums, g, g + gram)

    def lesser(step: int) -> np.ndarray:
        """Of each two places of least grams that far apart, the one with the lesser, else the first."""
        a, b = least[:-step], least[step:]
        return np.where(key[b] < key[a], b, a)

    size, least = 1, g
    while size * 2 <= stride:
        least = lesser(size)
        size *= 2
    if (rest := stride - size) > 0:
        least = lesser(rest)
    s = np.flatnonzero(row[: n - length + 1] == row[length - 1 :])
    return np.unique(least[s])


def pack(doc: np.ndarray, pos: np.ndarray) -> bytes:
    raw = b"".join(x.tobytes() for x in (np.diff(doc, prepend=0).astype(np.int64), np.diff(pos, prepend=0).astype(np.int32)))
    return len(doc).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    raw = pa.Codec("zstd").decompress(data[4:], 12 * n, asbytes=True)
    return np.cumsum(np.frombuffer(raw, np.int64, n)), np.cumsum(np.frombuffer(raw, np.int32, n, 8 * n).astype(np.int64))


def multikey_quicksort(keys: list[np.ndarray], base: int = 1 << 13) -> np.ndarray:
    """The order of rows by keys[0], then keys[1] and so on: three-way partitions, the middle part by the next key."""
    out, stack = [], [(np.arange(len(keys[0])), 0)]
    while stack:
        idx, d = stack.pop()
        if d == len(keys):
            out.append(idx)
        elif len(idx) <= base:
            out.append(idx[np.lexsort([k[idx] for k in reversed(keys[d:])])])
        else:
            v = keys[d][idx]
            p = np.sort(v[:: max(1, len(v) // 99)])
            p = p[len(p) // 2]
            less, more = v < p, v > p
            stack += [(idx[more], d), (idx[~(less | more)], d + 1), (idx[less], d)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Splitters:
    """Bounds between buckets, ordered by key, document and position; a key is a string of bytes."""

    def __init__(self, sample: list[tuple[bytes, int, int]], buckets: int, width: int) -> None:
        s = sorted(sample)
        s = [s[i * len(s) // buckets] for i in range(1, buckets)] if s else []
        self.key = np.array([x[0] for x in s], f"S{width}")
        self.doc, self.pos = (np.array([x[k] for x in s], np.int64) for k in (1, 2))

    def bucket(self, key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        out = lo.copy()
        tied = np.flatnonzero(lo < hi)
        j = 0
        while len(tied):
            k = lo[tied] + j
            tied = tied[k < hi[tied]]
            k = lo[tied] + j
            past = (doc[tied] > self.doc[k]) | ((doc[tied] == self.doc[k]) & (pos[tied] >= self.pos[k]))
            out[tied[past]] += 1
            tied, j = tied[past], j + 1
        return out


def as_bytes(columns: np.ndarray) -> np.ndarray:
    """Rows of unsigned numbers as strings of bytes that are ordered as they are."""
    big = np.ascontiguousarray(columns.astype(columns.dtype.newbyteorder(">")))
    return big.view(f"S{big.shape[1] * big.itemsize}").ravel()


def lead_keys(tokens: np.ndarray, at: np.ndarray, lead: int) -> np.ndarray:
    """The tokens of the leads that start at the places."""
    return as_bytes(tokens[at[:, None] + np.arange(lead)])


def window_keys(sums: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The hash of each window's first words, and of its others."""
    a, b = vec.spans(sums, at, at + LEAD), vec.spans(sums, at + LEAD, at + length)
    return as_bytes(np.stack([(a >> np.uint64(32)).astype(np.uint32), (b >> np.uint64(32)).astype(np.uint32), b.astype(np.uint32)], 1))


def levels(key: np.ndarray) -> list[np.ndarray]:
    """Keys as numbers of eight bytes, the first one leading."""
    width = key.dtype.itemsize
    padded = np.zeros((len(key), -(-width // 8) * 8), np.uint8)
    padded[:, :width] = np.frombuffer(key.tobytes(), np.uint8).reshape(-1, width)
    return list(np.ascontiguousarray(padded.view(">u8").astype(np.uint64).T))


def common_prefix(key: np.ndarray, unit: int) -> np.ndarray:
    """Units of so many bytes that each key has in common with the one before it; the first has none."""
    m = np.frombuffer(key.tobytes(), np.uint8).reshape(len(key), -1, unit)
    differ = (m[1:] != m[:-1]).any(2)
    return np.r_[0, np.where(differ.any(1), differ.argmax(1), m.shape[1])] if len(key) else np.zeros(0, np.int64)


class _Packer:
    """Gathers suffixes and gives them out packed by bucket."""

    def __init__(self, split: Splitters) -> None:
        self.split, self.held, self.n = split, [], 0

    def add(self, *part: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(part)
        self.n += len(part[0])
        if self.n >= PACK:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            key, doc, pos = (np.concatenate(x) for x in zip(*self.held))
            k = self.split.bucket(key, doc, pos)
            order = np.argsort(k, kind="stable")
            cut = np.flatnonzero(np.r_[True, k[order][1:] != k[order][:-1], True])
            rows = []
            for s, e in zip(cut[:-1], cut[1:]):
                o = order[s:e]
                rows.append((int(k[o[0]]), key[o].tobytes(), pack(doc[o], pos[o])))
            self.held, self.n = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "keys", "data"])


def _words(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(first row, row of each word, first word of each row, prefix sums, tokens) of the batch's slices."""
    for i, _, buf, off in vec.slices(batch.column("text")):
        start, end, row = vec.words(buf, off)
        if len(start):
            h = vec.word_hashes(buf, start, end)
            yield i, row, np.searchsorted(row, np.arange(len(off))), vec.prefix_sums(h), (h >> np.uint64(48)).astype(np.uint16)


def shared(packed: DataFrame, width: int, unit: int, buckets: int, parts: int) -> DataFrame:
    """(part, data, n): documents and positions of all suffixes whose key another suffix has, packed by document, and their number."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for t in batches:
            for k, d in zip(t.column("keys").to_pylist(), t.column("data").to_pylist()):
                got.append((np.frombuffer(k, f"S{width}"), *unpack(d)))
        if not got:
            return
        key, doc, pos = (np.concatenate(x) for x in zip(*got))
        del got
        order = multikey_quicksort([*levels(key), doc, pos])
        key, doc, pos = key[order], doc[order], pos[order]
        new = common_prefix(key, unit) < width // unit
        at = np.flatnonzero(new)
        last = np.r_[at[1:], len(key)] - 1
        group = np.cumsum(new) - 1
        # rows of one document and place are repeated rows
        several = (doc[at] != doc[last]) | (pos[at] != pos[last])
        edge = np.zeros(len(at), bool)
        edge[[0, -1]] = True
        out = []
        for g in np.flatnonzero(edge):
            m = group == g
            ends = [int(x) for x in (doc[at[g]], pos[at[g]], doc[last[g]], pos[last[g]])]
            run = key[at[g] : at[g] + 1].tobytes()
            out += [(*x, run, *ends) for x in by_document(doc[m], pos[m])]
        m = (several & ~edge)[group]
        out += [(*x, None, None, None, None, None) for x in by_document(doc[m], pos[m])]
        types = (pa.int32(), pa.binary(), pa.int64(), pa.binary(), *[pa.int64()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["part", "data", "n", "run", "d0", "p0", "d1", "p1"])

    def by_document(doc: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, bytes, int]]:
        part = (vec.mix(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((pos, doc, part))
        cut = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1], True]) if len(doc) else []
        for s, e in zip(cut[:-1], cut[1:]):
            yield int(part[order[s]]), pack(doc[order[s:e]], pos[order[s:e]]), int(e - s)

    found = settle(packed.repartitionById(buckets, "bucket").select("keys", "data").mapInArrow(sort, "part int, data binary, n long, run binary, d0 long, p0 long, d1 long, p1 long"), "suffixes")
    # at most two runs for each bucket
    ends = F.min(F.struct("d0", "p0")).alias("lo"), F.max(F.struct("d1", "p1")).alias("hi")
    edges = found.where("run IS NOT NULL").groupBy("run").agg(*ends).where("lo.d0 <> hi.d1 OR lo.p0 <> hi.p1").select("run")
    return found.where("run IS NULL").select("part", "data", "n").union(found.where("run IS NOT NULL").join(F.broadcast(edges), "run").select("part", "data", "n"))


def _positions(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray] | None:
    """(documents, positions), ordered by both, of all packed rows."""
    got = [unpack(x) for t in batches for x in t.column("data").to_pylist()]
    if not got:
        return None
    doc, pos = (np.concatenate(x) for x in zip(*got))
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])]
    return doc[new], pos[new]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, stride: int = STRIDE, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, start, end): each maximal span of words every ``length`` of which, or whose windows' union, occur elsewhere too."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lead = length - stride + 1
    if lead < max(gram, LEAD + 1):
        raise ValueError("stride leaves too few words to compare")
    own = cols(docs, id=id_col, text=text_col).where("id IS NOT NULL AND text IS NOT NULL").select(F.col("id").cast("long").alias("id"), "text")

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ids = np.asarray(t.column("id"))
            for i, row, first, sums, tokens in _words(t):
                starts = starts_of(sums, row, length, stride, gram)
                windows = np.flatnonzero(row[: len(row) - length + 1] == row[length - 1 :]) if len(row) >= length else starts[:0]
                for kind, at, every in ((1, starts, SAMPLE_EACH), (2, windows, 8 * SAMPLE_EACH)):
                    doc, pos = ids[i + row[at]], at - first[row[at]]
                    keep = vec.mix(vec.mix(doc.view(np.uint64)) ^ pos.view(np.uint64)) % np.uint64(every) == 0
                    at, doc, pos = at[keep], doc[keep], pos[keep]
                    key = lead_keys(tokens, at, lead) if kind == 1 else window_keys(sums, at, length)
                    raw, width = key.tobytes(), key.dtype.itemsize
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.int32()), pa.array([raw[j : j + width] for j in range(0, len(raw), width)], pa.binary()), pa.array(doc), pa.array(pos)], ["kind", "key", "doc", "pos"])

    rate = max(16, own.count() // SAMPLE_DOCS)
    few = own.where(F.pmod(F.xxhash64("id"), F.lit(rate)) == 0).mapInArrow(sampled, "kind int, key binary, doc long, pos long").toArrow().to_pylist()
    samples = {k: [(r["key"], r["doc"], r["pos"]) for r in few if r["kind"] == k] for k in (1, 2)}
    buckets = max(least, -(-len(samples[1]) * rate * SAMPLE_EACH // bucket))
    split = spark.sparkContext.broadcast(Splitters(samples[1], buckets, 2 * lead))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Packer(split.value)
        for t in batches:
            ids = np.asarray(t.column("id"))
            for i, row, first, sums, tokens in _words(t):
                at = starts_of(sums, row, length, stride, gram)
                yield from out.add(lead_keys(tokens, at, lead), ids[i + row[at]], at - first[row[at]])
        yield from out.flush()

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _positions(batches)) is None:
            return
        doc, pos = got
        at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.ListArray.from_arrays(pa.array(np.r_[at, len(doc)], pa.int32()), pa.array(pos, pa.int64()))], ["id", "at"])

    packed = "bucket int, keys binary, data binary"
    leads = shared(own.mapInArrow(emit, packed), 2 * lead, 2, buckets, buckets)
    # a place has about half a stride of windows that no other place has
    again = max(least, -(-(leads.agg(F.sum("n")).first()[0] or 0) * (stride // 2 + 1) // bucket))
    split_again = spark.sparkContext.broadcast(Splitters(samples[2], again, 12))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Packer(split_again.value)
        for t in batches:
            ids = np.asarray(t.column("id"))
            lists = t.column("at")
            for i, row, first, sums, _ in _words(t):
                rows = len(first) - 1
                mine = lists.slice(i, rows)
                per = np.asarray(mine.value_lengths())
                at = np.asarray(mine.flatten()) + np.repeat(first[:-1], per)
                last = np.repeat(first[1:], per) - length
                near = at[:, None] - np.arange(stride)
                ok = (near >= np.repeat(first[:-1], per)[:, None]) & (near <= last[:, None])
                s = np.unique(near[ok])
                yield from out.add(window_keys(sums, s, length), ids[i + row[s]], s - first[row[s]])
        yield from out.flush()

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _positions(batches)) is None:
            return
        doc, pos = got
        new = np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + length)]
        at = np.flatnonzero(new)
        last = np.r_[at[1:] - 1, len(doc) - 1]
        yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(pos[at]), pa.array(pos[last] + length)], ["doc_id", "start", "end"])

    near = leads.repartitionById(buckets, "part").select("data").mapInArrow(per_document, "id long, at array<long>")
    around = own.join(near, "id").mapInArrow(dense, packed)
    return shared(around, 12, 12, again, again).repartitionById(again, "part").select("data").mapInArrow(spans, "doc_id long, start long, end long")
