"""Hierarchical residual best-fit packing of documents into sequences of ``CAPACITY`` tokens.

Documents are split by a hash of their ids into partitions of about ``ITEMS``; each packs its own by best-fit decreasing
and closes the bins that are at least ``FULL`` of the capacity. The underfull bins go up a tree: ``FAN_IN``
partitions at a time pool them and pack them again as items of their load, best-fit decreasing, until one is left.
Only ids and lengths go through the tree, and each round's bins are written to the shared folder.

A pool stays small without loss. After best-fit no two bins of a partition are half empty, or the later one would have
gone into the earlier one; so a partition sends up one bin of half the capacity at most, and only such bins can go into others.
Of the bins of one load, then, at most ``FAN_IN`` can take one in each round that is left, and the others are closed.

The result depends on the rows and parameters only: not on the number of cores, files or partitions of the input.

A token here is a byte of UTF-8, as in a byte-level model, and one more ends each document (``END``, a byte that UTF-8 never
uses); any other integer column may be named as the length. A document longer than a bin is cut into whole bins and a rest.

Defined cases: a null id, and a null, zero or negative length (so null and empty texts), are in no bin; each repeated row is
packed for itself, also under an id that other texts have; equal lengths are taken in the order of id, text and start; very long texts
fill as many bins as they need; an empty table gives no rows; columns besides the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.frames import sized
from quern.session import settle

CAPACITY = 8192
FULL = 0.98
FAN_IN = 8
#: Documents of a partition of the first round, about.
ITEMS = 1 << 15
#: Repeated rows are kept as one with their number, of at most this many.
COPIES = 1024
END = b"\xff"

_NAMES = ["bin_id", "used", "doc_ids", "starts", "lengths", "keys", "copies"]
_SCHEMA = "bin_id string, used long, doc_ids array<long>, starts array<long>, lengths array<long>, keys array<long>, copies array<long>, part long, closed boolean"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of each bin's items; items are taken in the given order, each to the fullest bin that has room."""
    room: dict[int, list[int]] = {}
    mask, bins = 0, []
    for i, s in enumerate(sizes):
        fit = mask >> s
        if fit:
            space = s + (fit & -fit).bit_length() - 1
            b = room[space].pop()
            if not room[space]:
                mask ^= 1 << space
        else:
            space, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        space -= s
        if space:
            if not room.setdefault(space, []):
                mask |= 1 << space
            room[space].append(b)
    return bins


_LIST = pa.list_(pa.int64())
_OUT = pa.schema([("bin_id", pa.string()), ("used", pa.int64()), *[(c, _LIST) for c in _NAMES[2:]], ("part", pa.int64()), ("closed", pa.bool_())])


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 5000):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 5000]), _OUT)], schema=_OUT)


def closing(used: list[int], capacity: int, full: float, most: int) -> list[bool]:
    """Which bins, in order, go no further: full ones, and of each load those after the first ``most``."""
    seen: dict[int, int] = {}
    out = []
    for u in used:
        seen[u] = seen.get(u, 0) + 1
        out.append(u >= full * capacity or seen[u] > most)
    return out


def items_of(docs: DataFrame, id_col: str, text_col: str, length_col: str | None) -> DataFrame:
    """(id, key, n, chunk, copies): equal rows as one with their number, in chunks of ``COPIES``; key tells texts of one id apart."""
    text = F.col(f"`{text_col}`")
    if length_col:
        own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.lit(0).cast("long").alias("key"), F.col(f"`{length_col}`").cast("long").alias("n"))
    else:
        own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("key"), (F.octet_length(text) + 1).cast("long").alias("n")).where("n > 1")
    counted = own.where("id IS NOT NULL AND n > 0").groupBy("id", "key", "n").agg(F.count("*").alias("m"))
    counted = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {COPIES}"))))
    return counted.select("id", "key", "n", "chunk", F.least(F.lit(COPIES), F.col("m") - F.col("chunk") * COPIES).alias("copies"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, capacity: int = CAPACITY, full: float = FULL, fan_in: int = FAN_IN, items: int = ITEMS) -> DataFrame:
    """(bin_id, used, doc_ids, starts, lengths): one row for each bin, its pieces in order."""
    return _bins(settle(items_of(docs, id_col, text_col, length_col), "items"), capacity, full, fan_in, items).select(*_NAMES[:5])


def _bins(own: DataFrame, capacity: int, full: float, fan_in: int, items: int) -> DataFrame:
    """With the key and copy number of each piece besides."""
    parts = max(1, -(-(own.agg(F.sum("copies")).first()[0] or 0) // items))
    rounds, n = 0, parts
    while n > 1:
        n, rounds = -(-n // fan_in), rounds + 1

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (got := [b for b in batches if b.num_rows]):
            return
        part = TaskContext.get().partitionId()
        ids, key, n, chunk, copies = (np.concatenate([np.asarray(b.column(c)) for b in got]) for c in ("id", "key", "n", "chunk", "copies"))
        which = np.repeat(np.arange(len(ids)), copies)
        copy = np.arange(len(which)) - np.repeat(np.cumsum(copies) - copies, copies) + chunk[which] * COPIES
        ids, key, n = ids[which], key[which], n[which]
        order = np.lexsort((copy, key, ids, -n))
        ids, key, n, copy = ids[order], key[order], n[order], copy[order]
        rows = []
        for i in np.flatnonzero(n >= capacity):
            for s in range(0, int(n[i]) - capacity + 1, capacity):
                rows.append((f"0-{part}-w{len(rows)}", capacity, [int(ids[i])], [s], [capacity], [int(key[i])], [int(copy[i])], part, True))
        start = n // capacity * capacity
        rest = n - start
        order = np.lexsort((copy, start, key, ids, -rest))
        order = order[rest[order] > 0]
        bins = [order[b] for b in best_fit(rest[order].tolist(), capacity)]
        used = [int(rest[b].sum()) for b in bins]
        for k, (b, u, shut) in enumerate(zip(bins, used, closing(used, capacity, full, fan_in * rounds))):
            rows.append((f"0-{part}-{k}", u, *(x[b].tolist() for x in (ids, start, rest, key, copy)), part, shut))
        yield from _batches(rows)

    def merge(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not (got := [r for b in batches for r in b.to_pylist()]):
                return
            part = TaskContext.get().partitionId()
            got.sort(key=lambda r: (-r["used"], r["bin_id"]))
            bins = best_fit([r["used"] for r in got], capacity)
            used = [sum(got[x]["used"] for x in b) for b in bins]
            rows = []
            for k, (b, u, shut) in enumerate(zip(bins, used, closing(used, capacity, full, fan_in * (rounds - level)))):
                own = [[v for x in b for v in got[x][c]] for c in _NAMES[2:]]
                rows.append((f"{level}-{part}-{k}" if len(b) > 1 else got[b[0]]["bin_id"], u, *own, part, shut))
            yield from _batches(rows)

        return run

    bins = settle(own.repartitionById(parts, F.pmod(F.xxhash64("id", "key", "chunk"), F.lit(parts)).cast("int")).mapInArrow(local, _SCHEMA), "bins")
    done = bins.where("closed").select(*_NAMES)
    for level in range(1, rounds + 1):
        parts = -(-parts // fan_in)
        pool = bins.where("NOT closed").repartitionById(parts, F.expr(f"cast(part div {fan_in} as int)"))
        bins = settle(pool.select(*_NAMES).mapInArrow(merge(level), _SCHEMA), "bins")
        done = done.union(bins.where("closed").select(*_NAMES))
    return done.union(bins.where("NOT closed").select(*_NAMES))


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, full: float = FULL, fan_in: int = FAN_IN, items: int = ITEMS) -> DataFrame:
    """(bin_id, used, doc_ids, starts, lengths, tokens): with the ``used`` bytes of each bin, documents ending in ``END``.

    Documents are cut into their pieces before they meet the bins, so no more than a bin's text is in any row; the
    pieces of equal rows are sent once, or once for every ``COPIES`` of them.
    """
    own = settle(items_of(docs, id_col, text_col, None), "items")
    bins = _bins(own, capacity, full, fan_in, items)
    slots = bins.select("bin_id", F.posexplode(F.arrays_zip("doc_ids", "keys", "starts", "copies")).alias("slot", "p"))
    slots = slots.select("bin_id", "slot", F.col("p.doc_ids").alias("id"), F.col("p.keys").alias("key"), F.col("p.starts").alias("start"), F.expr(f"p.copies div {COPIES}").alias("chunk"))
    text = F.col(f"`{text_col}`")
    raw = docs.where(f"`{id_col}` IS NOT NULL AND octet_length(`{text_col}`) > 0").select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("key"), F.concat(F.encode(text, "UTF-8"), F.lit(bytearray(END))).alias("raw"))
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"(octet_length(raw) - 1) div {capacity}")), lambda k: F.struct((k * capacity).cast("long").alias("start"), F.substring("raw", k * capacity + 1, F.lit(capacity)).alias("piece")))
    pieces = raw.select("id", "key", F.inline(cut)).withColumn("chunk", F.lit(0).cast("long"))
    often = settle(own.where("chunk > 0").groupBy("id", "key").agg(F.max("chunk").alias("last")), "often")
    again = pieces.drop("chunk").join(sized(often), ["id", "key"]).withColumn("chunk", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last")))).drop("last")
    # rows that are equal give one piece, or one for each chunk
    pieces = pieces.unionByName(again).groupBy("id", "key", "start", "chunk").agg(F.first("piece").alias("piece"))
    filled = slots.join(pieces, ["id", "key", "start", "chunk"])
    by_slot = F.array_sort(F.collect_list(F.struct("slot", "piece")))
    tokens = filled.groupBy("bin_id").agg(by_slot.alias("p")).select("bin_id", F.aggregate("p", F.lit(bytearray(b"")), lambda a, x: F.concat(a, x["piece"])).alias("tokens"))
    return bins.select(*_NAMES[:5]).join(tokens, "bin_id")
