import numpy as np
import pytest
import xxhash

from lumenweave.llm import simhash


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """{doc_id: component_id} for [(doc_id, fp)]."""
    at = {d: d for d, _ in fps}

    def root(d):
        while at[d] != d:
            d = at[d]
        return d

    a = np.array([f for _, f in fps], np.uint64)
    for i, (d, _) in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3) + i + 1:
            x, y = root(d), root(fps[j][0])
            at[max(x, y)] = min(x, y)
    return {d: root(d) for d, _ in fps}


def test_fingerprint_cases(monkeypatch):
    for t in (None, "", " \n", "A", "a B", "the The THE", "ä\x85Ö x\x1cy z", "a b c d e f g " * 50):
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    monkeypatch.setattr(simhash, "TEXT_BYTES", 16)
    for t in ("a b c d e f g " * 50, "x" * 100 + " y", "longwordlongwordlongword b c dddddddddddddddddddddddddddd e"):
        assert simhash.fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("seed", range(4))
def test_trie_join_finds_what_comparing_all_finds(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = np.unique(np.array([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 7)).astype(np.uint64)) for c in centres for _ in range(300)], np.uint64))
    label = simhash.trie_forest(np.zeros(len(fps), np.int64), fps)
    want = brute_components([(i, int(f)) for i, f in enumerate(fps)])
    assert [want[i] for i in range(len(fps))] == label.tolist()


@pytest.mark.parametrize("most", [simhash.MOST_IN_GROUP, 20])
def test_links_on_the_cluster(spark, most):
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2)
    fps = np.unique(np.array([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 6)).astype(np.uint64)) for c in centres for _ in range(60)], np.uint64))
    rows = [(int(f.view(np.int64)), 1000 + i) for i, f in enumerate(fps)]
    links = simhash.link_forest(spark.createDataFrame(rows, "fp long, node long"), most)
    got = {r.u: r.v for r in simhash.components(links).collect()}
    want = brute_components([(1000 + i, int(f)) for i, f in enumerate(fps)])
    assert {d: got.get(d, d) for d in want} == want


def test_documents(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(5, text, "x"), (3, text + " tail", "y"), (9, text, None), (9, text, None), (None, text, "z"), (7, None, "n"), (8, "", "n"), (1, "other words entirely here", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(simhash.near_duplicates(docs).collect(), key=str)
    fps = sorted({(r.doc_id, r.fp % (1 << 64)) for r in got if r.doc_id is not None})
    assert {(d, brute_fingerprint(dict((a, b) for a, b, _ in rows)[d])) for d, _ in fps} == set(fps)
    want = brute_components(fps)
    assert len(got) == len(rows) and all(r.component_id == want.get(r.doc_id) for r in got)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted({*want.values(), -1})
    assert simhash.near_duplicates(docs.limit(0)).collect() == [] and simhash.keep_one(docs.limit(0)).collect() == []


def test_query(spark):
    from lumenweave.llm.queries import op1_simhash

    d = "/root/testdata/sf0.001"
    got = op1_simhash(spark, d).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    fps = sorted((k, brute_fingerprint(t)) for k, t in docs.items())
    want = brute_components(fps)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == [(k, f"{f:016x}", want[k]) for k, f in fps]


def test_every_group_is_descended_from_its_root():
    rng = np.random.default_rng(11)
    fps = np.unique(rng.integers(0, 1 << 63, 6000, dtype=np.uint64))
    near = fps[::50] ^ np.uint64(0b1001 << 20)
    fps = np.unique(np.concatenate([fps, near]))
    trie = simhash.Trie(fps)
    label = simhash.trie_forest(np.zeros(len(fps), np.int64), fps, trie=trie)
    want = brute_components([(i, int(f)) for i, f in enumerate(fps)])
    assert [want[i] for i in range(len(fps))] == label.tolist()
    # Far more node pairs than leaves of one group would need, far fewer than all pairs.
    assert len(fps) < trie.descents < len(fps) ** 2 / 20
    for small in (np.sort(rng.integers(0, 1 << 63, k, dtype=np.uint64)) for k in (2, 3)):
        trie = simhash.Trie(small)
        simhash.trie_forest(np.zeros(len(small), np.int64), small, trie=trie)
        assert trie.descents > 0


def batches_of(key, fp, node, rows):
    import pyarrow as pa

    for at in range(0, len(key), rows):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + rows]) for x in (key, fp, node)], names=["key", "fp", "node"])


def test_stretches_hold_whole_groups():
    rng = np.random.default_rng(2)
    for most, rows in ((1, 7), (10, 3), (10, 64), (1000, 5)):
        key = np.repeat(np.arange(40), rng.integers(1, 9, 40))
        got = list(simhash.stretches(batches_of(key, key * 2, key * 3, rows), most))
        assert np.array_equal(np.concatenate([k for k, _, _ in got]), key)
        assert all(np.array_equal(f, 2 * k) and np.array_equal(n, 3 * k) for k, f, n in got)
        assert all(a[0][-1] != b[0][0] for a, b in zip(got, got[1:])) and max(len(k) for k, _, _ in got) < most + 9
    assert list(simhash.stretches(iter([]))) == []


def test_memory_is_bounded_by_groups_not_by_partitions():
    import tracemalloc

    rng = np.random.default_rng(4)

    def batches():
        for i in range(400):
            key = np.repeat(np.arange(i * 10, i * 10 + 10), 1000)
            fp = np.sort(rng.integers(-(1 << 62), 1 << 62, (10, 1000)), axis=1).ravel()
            yield from batches_of(key, fp, np.arange(len(key)) + i * 10_000, 10_000)

    tracemalloc.start()
    rows = sum(len(k) for k, _, _ in simhash.stretches(batches()))
    assert rows == 4_000_000 and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.reset_peak()
    few = (b for i, b in zip(range(60), batches()))
    assert sum(b.num_rows for b in simhash.forest_of_partition(few)) == 0
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_first_blocks_make_groups_of_thousands():
    assert [simhash.first_block(n) for n in (0, 1, 8000, 9296, 256_410, 15_000_000, 10**9, 10**12)] == [0, 0, 0, 1, 5, 11, 16, 16]


def test_repeated_ids_and_clashing_names(spark):
    text, other = " ".join(f"word{i}" for i in range(200)), " ".join(f"none{i}" for i in range(200))
    rows = [(5, text, "a"), (5, other, "b"), (7, other, "c"), (9, text, "d"), (5, text, "e"), (None, text, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _keep string").selectExpr("*", "_keep h", "_keep id", "_keep root", "_keep u", "_keep fp")
    got = sorted((str(r.doc_id), r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert [c for _, _, c in got] == [5] * 5 + [None] and len({f for _, f, _ in got}) == 2
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("5", text), ("5", other), ("None", text)])
    unique = docs.filter("h in ('a', 'c', 'd')")
    assert sorted((r.doc_id, r.h) for r in simhash.keep_one(unique).collect()) == [(5, "a"), (7, "c")]
