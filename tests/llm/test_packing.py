import random
from collections import Counter

from quern.llm.packing import END, best_fit, pack, sequences


def naive(sizes, cap):
    bins, room = [], []
    for i, s in enumerate(sizes):
        fits = [(r, b) for b, r in enumerate(room) if r >= s]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append([])
            room.append(cap)
        bins[b].append(i)
        room[b] -= s
    return bins


def test_best_fit_is_best_fit():
    rng = random.Random(1)
    for _ in range(60):
        cap = rng.randrange(5, 80)
        sizes = [rng.randrange(1, cap + 1) for _ in range(rng.randrange(0, 70))]
        a, b = best_fit(sizes, cap), naive(sizes, cap)
        assert sorted(sum(sizes[i] for i in x) for x in a) == sorted(sum(sizes[i] for i in x) for x in b)
        assert sorted(i for x in a for i in x) == list(range(len(sizes)))


def check(rows, bins, cap):
    seen = Counter()
    for b in bins:
        assert b.used == sum(b.lengths) <= cap and len(b.doc_ids) == len(b.starts) == len(b.lengths)
        for d, s, n in zip(b.doc_ids, b.starts, b.lengths):
            seen[d, s, n] += 1
    want = Counter()
    for i, t in rows:
        n = len(t.encode()) + 1 if t else 0
        if i is None:
            continue
        for s in range(0, n, cap):
            want[i, s, min(cap, n - s)] += 1
    assert seen == want
    assert len({b.bin_id for b in bins}) == len(bins)
    return len(bins), len(best_fit(sorted((n for (_, _, n), k in want.items() for _ in range(k)), reverse=True), cap))


def test_everything_is_packed_once_and_tightly(spark):
    rng = random.Random(2)
    rows = [(i, "é" * rng.choice([3, 20, 90, 300, 700])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(13, "doc_id")
    for items in (10**6, 230):
        n, at_once = check(rows, pack(df, capacity=1000, items=items).collect(), 1000)
        assert n <= 1.02 * at_once


def test_cores_files_and_partitions_do_not_matter(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(1, 900)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(pack(df.repartition(n), capacity=1000, fan_in=3, items=125).collect()) for n in (1, 4, 16)]
    assert got[0] == got[1] == got[2]
    check(rows, got[0], 1000)


def test_closing_what_no_round_can_use_loses_nothing(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "x" * rng.choice([rng.randrange(1, 200), 540, 560, 610, 700])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    n, _ = check(rows, pack(df, capacity=1000, fan_in=2, items=40).collect(), 1000)
    monkeypatch.setattr("quern.llm.packing.closing", lambda used, capacity, full, most: [u >= full * capacity for u in used])
    assert check(rows, pack(df, capacity=1000, fan_in=2, items=40).collect(), 1000)[0] == n


def test_residuals_meet_across_partitions(spark):
    rows = [(i, "x" * 299) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert check(rows, pack(df, capacity=1000, fan_in=2, items=1).collect(), 1000)[0] <= 4


def test_items_that_cannot_be_combined_end_the_rounds(spark):
    rows = [(i, "x" * 649) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert check(rows, pack(df, capacity=1000, fan_in=2, items=25).collect(), 1000)[0] == 400


def test_sequences_give_the_documents_back(spark, monkeypatch):
    monkeypatch.setattr("quern.llm.packing.COPIES", 4)
    rng = random.Random(5)
    rows = [(i, "é🙂x" * rng.choice([1, 7, 60, 900])) for i in range(120)] + [(7, "same id, other text")] * 11 + [(8, None), (9, ""), (None, "z")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, piece string, start int")
    bins = sequences(df, capacity=500, items=50).collect()
    check(rows, bins, 500)
    pieces = {}
    for b in bins:
        assert len(b.tokens) == b.used
        at = 0
        for d, s, n in zip(b.doc_ids, b.starts, b.lengths):
            pieces.setdefault(d, []).append((s, bytes(b.tokens[at : at + n])))
            at += n
    for d in {r[0] for r in rows} - {None}:
        texts = sorted(t.encode() + END for i, t in rows if i == d and t)
        got = sorted(pieces.get(d, []))
        if len(set(texts)) == 1 or len(texts) == 1:
            assert b"".join(p for _, p in got) == b"".join(texts)
        assert sorted(p for _, p in got) == sorted(t[s : s + 500] for t in texts for s in range(0, len(t), 500))
    assert sequences(df.limit(0)).collect() == []


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (None, "abc"), (3, "abc"), (3, "abc"), (4, "y" * 100_000), (5, "z" * 999)]
    df = spark.createDataFrame([(*r, "k", 5, 7) for r in rows], "doc_id long, text string, bin_id string, used long, n long")
    check(rows, pack(df, capacity=1000).collect(), 1000)
    assert pack(df.limit(0)).collect() == []
    assert pack(df, length_col="n", capacity=20).count() == 3
