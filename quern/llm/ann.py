"""Approximate nearest neighbours by an inverted multi-index.

Vectors are split into two halves, each quantised to the nearest of its centroids, which Lloyd's iterations place over
at most ``FIT`` vectors (those of least id hash). Their number grows with the table from ``CENTROIDS`` on, so that a cell, the pair of
a vector's centroids, holds about ``CELL`` vectors, up to ``MOST`` centroids. Every vector is indexed. A query walks the cells in the
order of the two halves' summed squared distances, by a heap over the centroid pairs (the multi-sequence algorithm), until the cells hold a
share of all vectors; their entries, and those of any cell at the very same sum, are ranked by the true distance.

The share is measured, not set: for ``PROBES`` vectors as queries (those of least hash under another seed) the true neighbours among all
vectors are found by brute force, and the share is the least that reaches ``RECALL`` of them. Clustered vectors need a small
one; vectors without any structure a large one, so that the work is quadratic as an exact search's.

Walks and entries meet by blocks: neighbouring cells of about ``BLOCK`` entries are one block, queries come in
chunks of about ``CHUNK`` to each block that they walk, with the sum at which their walk ended; each block gives the best k ids of
a query, chosen by exact distance among all that float32 may have among them, and the best of these remain. Where ids have several vectors, queries
whose walk met fewer than k other ids walk all cells.

Defined cases: a null id or vector, a vector with a null, NaN or infinite part, an empty one, or one of another length than
the most common, is neither query nor entry; vectors of zero length are like any; repeated rows of one id and vector count once, of one id with several
vectors each count (an id is not its own neighbour); a query need not be among the entries; ties go to the lesser id; fewer than k others give fewer rows; an
empty table gives no rows; columns besides the two named are ignored. Distances are Euclidean.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.frames import cols
from quern.session import settle

CENTROIDS = 32
MOST = 256
CELL = 8
FIT = 1 << 15
ROUNDS = 8
PROBES = 256
RECALL = 0.94
BLOCK = 8192
CHUNK = 32768
K = 10
SEED = 8


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.float32).reshape(-1, dim)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def walk(d1: np.ndarray, d2: np.ndarray, sizes: list[list[int]], want: int) -> tuple[list[tuple[int, int]], float]:
    """Filled cells in the order of d1[i] + d2[j] until they hold ``want`` entries, and the last one's sum."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b, o1, o2 = d1[o1].tolist(), d2[o2].tolist(), o1.tolist(), o2.tolist()
    heap, out, got, last = [(a[0] + b[0], 0, 0)], [], 0, 0.0
    while heap and got < want:
        last, i, j = heapq.heappop(heap)
        if n := sizes[o1[i]][o2[j]]:
            out.append((o1[i], o2[j]))
            got += n
        # (i, j + 1) comes from (i, j); (i + 1, 0) from (i, 0): each pair is pushed once
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out, last


def codebooks(x: np.ndarray, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's centroids of both halves of the rows; the first rows are where they start."""
    half = x.shape[1] // 2
    books = []
    for part in (x[:, :half], x[:, half:]):
        c = np.unique(part[:centroids], axis=0)
        for _ in range(rounds):
            own = np.concatenate([squared(part[i : i + 8192], c).argmin(1) for i in range(0, len(part), 8192)])
            total = np.zeros_like(c)
            np.add.at(total, own, part)
            n = np.bincount(own, minlength=len(c))
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        books.append(c)
    return books[0], books[1]


def needed(sums: np.ndarray, found: np.ndarray, sizes: np.ndarray, recall: float) -> float:
    """The share of entries after which the walks by ``sums`` (probe, cell) have met ``recall`` of the found (probe, cell) pairs."""
    share = []
    total = max(1, sizes.sum())
    for p in np.unique(found[:, 0]):
        order = np.argsort(sums[p], kind="stable")
        before = np.empty(len(order))
        before[order] = (np.cumsum(sizes[order]) - sizes[order]) / total
        share.append(before[found[found[:, 0] == p, 1]])
    share = np.sort(np.concatenate(share)) if share else np.zeros(1)
    return float(share[min(len(share) - 1, int(np.ceil(recall * len(share))))])


def neighbours(vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, centroids: int | None = None, share: float | None = None, recall: float = RECALL, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, neighbour_id, distance, rank): the k nearest others among ``vectors`` of every query, or of every vector."""
    spark = vectors.sparkSession

    def good(df: DataFrame) -> DataFrame:
        own = cols(df, id=id_col, v=vec_col).where("id IS NOT NULL AND v IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v"))
        return own.where(F.size("v") > 0).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))

    fine = good(vectors)
    top = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "vec_id long, neighbour_id long, distance double, rank int"
    if top is None or top.n < 2:
        return spark.createDataFrame([], schema)
    dim, half = top.n, top.n // 2
    own = settle(fine.where(F.size("v") == dim).distinct(), "vectors")
    total = own.count()
    least = own.orderBy(F.xxhash64("id", F.lit(SEED)), "id", "v")
    if centroids is None:
        centroids = min(MOST, max(CENTROIDS, round((total / CELL) ** 0.5)))
    books = codebooks(_matrix(least.limit(FIT).toArrow().column("v").combine_chunks(), dim).astype(np.float64), centroids, rounds)
    n1, n2 = len(books[0]), len(books[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x = _matrix(t.column("v"), dim).astype(np.float64)
            cell = squared(x[:, :half], books[0]).argmin(1) * n2 + squared(x[:, half:], books[1]).argmin(1)
            yield pa.RecordBatch.from_arrays([t.column("id"), t.column("v"), pa.array(cell, pa.int32())], ["id", "v", "cell"])

    entries = settle(own.mapInArrow(assign, "id long, v array<float>, cell int"), "entries")
    # at most n1 * n2 rows, whatever the table's size
    sizes = np.zeros(n1 * n2, np.int64)
    for r in entries.groupBy("cell").count().collect():
        sizes[r.cell] = r["count"]

    if share is None:
        few = own.orderBy(F.xxhash64("id", F.lit(SEED + 1)), "id", "v").limit(PROBES).toArrow()
        probe_id, probe = np.asarray(few.column("id")), _matrix(few.column("v").combine_chunks(), dim).astype(np.float64)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                x, ids = _matrix(t.column("v"), dim).astype(np.float64), np.asarray(t.column("id"))
                d = squared(probe, x)
                d[probe_id[:, None] == ids] = np.inf
                m = min(k, len(ids))
                at = np.argpartition(d, m - 1, axis=1)[:, :m].ravel()
                p = np.repeat(np.arange(len(probe)), m)
                ok = np.isfinite(d[p, at])
                p, at = p[ok], at[ok]
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(ids[at]), pa.array(np.asarray(t.column("cell"))[at]), pa.array(d[p, at])], ["p", "id", "cell", "d"])

        nth = F.row_number().over(Window.partitionBy("p").orderBy("d", "id"))
        # PROBES times k rows at most
        true = entries.mapInArrow(measure, "p int, id long, cell int, d double").withColumn("n", nth).where(F.col("n") <= k).select("p", "cell").toArrow()
        sums = (squared(probe[:, :half], books[0])[:, :, None] + squared(probe[:, half:], books[1])[:, None, :]).reshape(len(probe), -1)
        share = needed(sums, np.stack([np.asarray(true.column(c)) for c in ("p", "cell")], 1), sizes, recall)
    want = max(1, int(np.ceil(share * total)))

    asked = entries.select("id", "v") if queries is None else settle(good(queries).where(F.size("v") == dim).distinct(), "queries")
    blocks, chunks = max(1, round(total / BLOCK)), max(1, round(asked.count() / CHUNK))
    block = np.minimum((np.cumsum(sizes) - sizes) * blocks // max(1, total), blocks - 1).astype(np.int32)
    grid, of_cell = sizes.reshape(n1, n2).tolist(), block.reshape(n1, n2).tolist()

    def route(batches: Iterator[pa.RecordBatch], want: int) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x = _matrix(t.column("v"), dim).astype(np.float64)
            d1, d2 = squared(x[:, :half], books[0]), squared(x[:, half:], books[1])
            for s in range(0, len(x), 2000):
                row, to, sums = [], [], []
                for q in range(s, min(len(x), s + 2000)):
                    cells, last = walk(d1[q], d2[q], grid, want)
                    for u in sorted({of_cell[i][j] for i, j in cells}):
                        row.append(q)
                        to.append(u)
                        sums.append(last)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([t.column("id").take(at), t.column("v").take(at), pa.array(sums, pa.float64()), pa.array(to, pa.int32())], ["id", "v", "last", "block"])

    def rank(queries: pa.Table, own: pa.Table) -> pa.Table:
        none = pa.table({"vec_id": pa.array([], pa.int64()), "neighbour_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        if not len(queries) or not len(own):
            return none
        ids, cell, x = np.asarray(own.column("id")), np.asarray(own.column("cell")), _matrix(own.column("v").combine_chunks(), dim).astype(np.float64)
        qids, qs, lasts = np.asarray(queries.column("id")), _matrix(queries.column("v").combine_chunks(), dim), np.asarray(queries.column("last"))
        order = np.argsort(ids, kind="stable")
        ids, x, c1, c2 = ids[order], x[order], cell[order] // n2, cell[order] % n2
        # squares of the largest parts must not overflow
        kind = np.float32 if max(np.abs(x).max(), np.abs(qs).max()) < 1e15 else np.float64
        x32 = x.astype(kind)
        norm = (x32 * x32).sum(1)
        # twice what rounding may change in a squared distance, for norms of 1
        slack = 4 * (dim + 8) * np.finfo(kind).eps
        each = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        found = [none]
        for s in range(0, len(qids), 256):
            qi, q = qids[s : s + 256], qs[s : s + 256].astype(np.float64)
            d1, d2 = squared(q[:, :half], books[0]), squared(q[:, half:], books[1])
            reach = (lasts[s : s + 256] * (1 + 1e-9) + 1e-12)[:, None]
            q32 = q.astype(kind)
            own_norm = (q32 * q32).sum(1)
            d = own_norm[:, None] - 2 * q32 @ x32.T + norm
            d[(d1[:, c1] + d2[:, c2] > reach) | (ids == qi[:, None])] = np.inf
            # all rows that may be nearer than the k-th id's nearest
            by_id = d if len(each) == len(ids) else np.minimum.reduceat(d, each, axis=1)
            m = min(k, by_id.shape[1])
            limit = np.partition(by_id, m - 1, axis=1)[:, m - 1] + slack * (own_norm + norm.max())
            r, at = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
            exact = np.concatenate([np.zeros(0), *[np.sqrt(((x[at[i : i + 32768]] - q[r[i : i + 32768]]) ** 2).sum(1)) for i in range(0, len(r), 32768)]])
            # each id's best row, then each query's best k ids
            o = np.lexsort((exact, ids[at], r))
            r, at, exact = r[o], at[o], exact[o]
            one = np.r_[True, (r[1:] != r[:-1]) | (ids[at][1:] != ids[at][:-1])][: len(r)]
            r, at, exact = r[one], at[one], exact[one]
            o = np.lexsort((ids[at], exact, r))
            r, at, exact = r[o], at[o], exact[o]
            top = np.arange(len(r)) - np.searchsorted(r, r) < k
            found.append(pa.table({"vec_id": qi[r[top]], "neighbour_id": ids[at[top]], "distance": exact[top]}))
        return pa.concat_tables(found)

    # one row for each cell
    places = spark.createDataFrame([(c, int(b)) for c, b in enumerate(block)], "cell int, block int")
    placed = entries.join(F.broadcast(places), "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def nearest(of: DataFrame, want: int) -> DataFrame:
        sent = of.select("id", "v").mapInArrow(lambda batches: route(batches, want), "id long, v array<float>, last double, block int").withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
        got = sent.groupBy("block", "chunk").cogroup(placed.groupBy("block", "chunk")).applyInArrow(rank, "vec_id long, neighbour_id long, distance double")
        return got.groupBy("vec_id", "neighbour_id").agg(F.min("distance").alias("distance"))

    best = nearest(asked, want)
    if (ids := entries.select("id").distinct().count()) < total or want < k + 1:  # else a walk meets as many ids as entries
        best = settle(best, "nearest")
        full = best.groupBy("vec_id").count().where(F.col("count") >= min(k, ids - 1)).select(F.col("vec_id").alias("id"))
        rest = asked.join(full, "id", "left_anti")
        best = best.join(rest.select(F.col("id").alias("vec_id")).distinct(), "vec_id", "left_anti").union(nearest(rest, total))
    nth = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbour_id"))
    return best.withColumn("rank", nth).where(F.col("rank") <= k).select("vec_id", "neighbour_id", "distance", "rank")
