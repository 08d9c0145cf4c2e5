import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenweave.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def check(rows, docs, length):
    """rows as the operator returns them; docs (doc_id, text)."""
    want = {}
    for d, t in docs:
        ids = np.array(LIBRARY.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for s in range(0, len(ids), length):
            key = (d, s, min(length, len(ids) - s), zlib.crc32(ids[s : s + length].tobytes()), len(ids))
            want[key] = want.get(key, 0) + 1
    got, sequences = {}, {}
    for r in rows:
        key = (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
        got[key] = got.get(key, 0) + 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    assert sorted(sequences) == list(range(len(sequences)))
    return sequences


@pytest.mark.parametrize("length", [16, 2048])
def test_documents(spark, length):
    text = "the quick brown fox jumps over the lazy dog "
    rows = [(i, text * (i % 13), i) for i in range(120)] + [(7, text, 0), (7, text, 0), (None, text, 1), (500, None, None), (501, "", 2), (502, text * 2000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = packing.pack_documents(docs, PATH, length).collect()
    check(got, [(d, t) for d, t, _ in rows], length)
    assert packing.pack_documents(docs.limit(0), PATH, length).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_histogram_is_packed_whole_and_tight(seed):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(rng.integers(1, 50)) for n in rng.integers(1, 2049, 300)}
    patterns = packing.pack_histogram(counts)
    packed = {}
    for count, lengths in patterns:
        assert sum(lengths) <= 2048 and list(lengths) == sorted(lengths, reverse=True)
        for n in lengths:
            packed[n] = packed.get(n, 0) + count
    assert packed == counts
    total = sum(n * c for n, c in counts.items())
    assert sum(c for c, _ in patterns) * 2048 <= 1.1 * total + 4096


def test_a_length_that_fits_twice():
    assert sorted(packing.pack_histogram({4: 3, 8: 1, 3: 2}, 8)) == [(1, (3,)), (1, (4, 3)), (1, (4, 4)), (1, (8,))]
    assert sorted(packing.pack_histogram({100: 45})) == [(1, (100,) * 5), (2, (100,) * 20)]


def test_query(spark):
    from lumenweave.llm.queries import op2_packing

    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    sequences = check(op2_packing(spark, d).collect(), docs, 2048)
    used = [sum(n for _, n in p) for p in sequences.values()]
    assert sum(2048 - u for u in used if u & (u - 1)) < 0.05 * sum(used)
