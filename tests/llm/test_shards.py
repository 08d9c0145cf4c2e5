import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenweave.llm import shards


def brute_capacity(sizes, k):
    best = [0] + [float("inf")] * len(sizes)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for _ in range(k):
        best = [min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(sizes) + 1)]
    return int(best[-1])


@pytest.mark.parametrize("seed", range(8))
def test_capacity_is_the_least(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 50, rng.integers(1, 40))
    k = int(rng.integers(1, 20))
    capacity, cuts = shards.minimax_cuts(sizes, k)
    parts = np.split(sizes, cuts[:-1])
    assert capacity == brute_capacity(sizes.tolist(), k) == max(int(p.sum()) for p in parts)
    assert len(cuts) == k and cuts[-1] == len(sizes)


def test_a_large_run_leaves_no_shard_empty():
    rng = np.random.default_rng(1)
    for at in (0, 7, 300, 999):
        for large in (5000, 50_000):
            sizes = rng.integers(1, 50, 1000)
            sizes[at] = large
            cuts = shards.even_cuts(sizes, 16)
            loads = [int(p.sum()) for p in np.split(sizes, cuts[:-1])]
            others = sorted(loads)[:-1]
            assert len(cuts) == 16 and cuts[-1] == 1000 and max(loads) == large and min(others) > 0
            if at in (0, 300, 999):
                assert others[-1] <= 1.3 * sum(others) / 15 + 50
    for _ in range(300):
        sizes = rng.integers(1, 9, rng.integers(0, 12)) ** rng.integers(1, 4)
        k = int(rng.integers(1, 9))
        cuts = shards.even_cuts(sizes, k)
        assert len(cuts) == k and cuts[-1] == len(sizes) and (np.diff(cuts) >= 0).all()
        if len(sizes):
            assert max(int(p.sum()) for p in np.split(sizes, cuts[:-1])) == shards.minimax_cuts(sizes, k)[0]


def check(rows, docs, k):
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots, groups, load = defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < k
        slots[r.shard].append(r.slot)
        groups[r.text_crc32, r["size"]].add(r.shard)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())
    return load


def test_documents(spark):
    docs = [(i, f"text {i % 50} " * (i % 7 + 1)) for i in range(300)] + [(None, "é"), (7, None), (7, None), (8, ""), (9, "x" * 9000)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, size int, shard int")
    check(shards.assign(df).collect(), docs, 16)
    check(shards.assign(df, 3).collect(), docs, 3)
    assert shards.assign(df.limit(0)).collect() == []
    check(shards.assign(df.limit(1)).collect(), docs[:1], 16)


def test_query(spark):
    from lumenweave.llm.queries import op7_sharding

    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    load = check(op7_sharding(spark, d).collect(), docs, 16)
    assert max(load.values()) <= sum(load.values()) / 16 + max(len(t.encode()) + 1 for _, t in docs)


@pytest.mark.parametrize("bits, most", [(2, 8), (3, 64), (16, 1 << 16)])
def test_capacity_is_that_of_the_groups_however_they_are_gathered(spark, monkeypatch, bits, most):
    from pyspark.sql import functions as F

    monkeypatch.setattr(shards, "BUCKET_BITS", bits)
    monkeypatch.setattr(shards, "MOST_RUNS", most)
    rng = np.random.default_rng(bits)
    texts = [f"{i} " + "x" * int(n) for i, n in enumerate(rng.integers(0, 400, 300))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[::7] + texts[5:6] * (200 if bits == 3 else 0))], "doc_id long, text string")
    groups = docs.groupBy(F.xxhash64("text").alias("h")).agg(F.sum(F.octet_length("text") + 1).alias("n")).orderBy("h").collect()
    want = shards.minimax_cuts(np.array([r.n for r in groups], dtype=np.int64), 16)[0]
    got = shards.assign(docs).groupBy("shard").agg(F.sum("size").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.count("*").alias("c")).collect()
    assert max(r.n for r in got) == want and all(r.a == 0 and r.b == r.c - 1 for r in got)
    same = shards.assign(docs).groupBy("text_crc32", "size").agg(F.count_distinct("shard").alias("k"))
    assert same.agg(F.max("k")).first()[0] == 1


def test_a_hot_run_does_not_open_all_others():
    size = np.full(1 << 16, 1000, dtype=np.int64)
    size[40_000] = 30_000_000
    runs = np.column_stack([np.arange(1 << 16, dtype=np.int64) - (1 << 15) << 48, size, size // 100, np.zeros_like(size), np.full_like(size, 16)])
    assert np.flatnonzero(shards.open_runs(runs, 16)).tolist() == [40_000]
    runs[40_000, 3] = 1
    assert not shards.open_runs(runs, 16).any()
    even = np.column_stack([runs[:, 0], np.random.default_rng(1).integers(500, 1500, 1 << 16), size, np.zeros_like(size), np.full_like(size, 16)])
    assert 15 <= shards.open_runs(even, 16).sum() < 1000
