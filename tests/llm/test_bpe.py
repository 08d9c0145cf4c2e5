import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.load(PATH)


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def check(text):
    want = library_ids(text)
    for by_library in (False, True):
        ids = OWN.encode(text, by_library)
        assert np.frombuffer(ids, "<u4").tolist() == want, (text, by_library)
    assert OWN.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


CASES = [
    "", " ", "  ", "a  b", "a   b ", " a", "\n", "\n\na", "a\nb", "a \n b", "a\n\n  b\n", "a\tb", "a b 　c d", "x\x1cy \x85z\x1f ", "don't we'll I'M it's'",
    "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|", "1234567890 12,345.67", "ünïcödé ñ 漢字かな 👩‍👩‍👧 ́e", "a" * 3000, "=-" * 900, "abcdefghij" * 80,
    "word.!? word### %%% |", "ſtraße ǅ ʰ", "﻿x​y᠎z", " 's 't", "x 's", "A\r\nB\r\n\r\nC", "e" * 300 + "." * 300,
]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    check(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(list("ab c\n.,' \t1é漢|#") + ["the", " th", " ", "<|endoftext|>"]), st.characters(exclude_categories=("Cs", "Cn", "Co"), max_codepoint=0x2FFF)), max_size=40).map("".join))
def test_any_text(text):
    check(text)


def test_own_merges_equal_the_library():
    other = bpe.ByteBPE(PATH)
    other.core = None
    for text in [*CASES, "the quick brown fox jumps over unbelievable antidisestablishmentarianism " * 3]:
        assert np.frombuffer(other.encode(text), "<u4").tolist() == library_ids(text)
        for f in other.fragments(text.encode() or b"a"):
            assert other._merged_long([other.byte_id[b] for b in f]) == other.merged(f)


def test_bounded_table(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_UNITS", 3)
    own = bpe.ByteBPE(PATH)
    text = "one two three four five six one two three, four."
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library_ids(text)
    assert len(own.after_space) <= 3


def test_documents(spark):
    rows = [(1, "a b", 1), (1, "a b", 1), (2, None, None), (None, "x" * 100_000, 2), (3, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, ((d, t or "") for d, t, _ in rows)))
    assert bpe.digests(docs.limit(0), PATH).collect() == []


def test_query(spark):
    from lumenweave.llm.queries import op8_bpe

    d = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        ids = library_ids(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, op8_bpe(spark, d).collect())) == sorted(want)
