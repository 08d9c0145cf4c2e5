import re
from collections import Counter

import pytest

from lumenweave.llm import quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXTS = [
    None, "", " \n\t", "one", "a b c a b c", "a a a a a", "x\x0by\x0cz\x1cq é漢 |<>#", "dup line\ndup line\n \n \nother\ndup line", "word " * 60,
    " ".join(f"w{i}" for i in range(60)), "LOUD " * 3 + " ".join(f"SHOUT{i}" for i in range(60)), " ".join(f"w{i}###" for i in range(60)), "m" * 5000, " ".join("ab" for _ in range(40)) + " " + " ".join(f"q{i}" for i in range(60)),
]


def test_measures_and_verdicts(spark):
    rows = [(i, t, True, 3) for i, t in enumerate(TEXTS)] + [(None, TEXTS[9], False, 1), (9, TEXTS[9], None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept boolean, n_words int")
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[9 if r.doc_id is None else r.doc_id]
        n, chars, symbols, dup, repeat = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert r.kept == (r.rejected_by is None) and not (r.kept and r.base_failed)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept) == {9: 2, None: 1, 13: 1}
    assert quality.judge(docs.limit(0)).collect() == [] == quality.keep_good(docs.limit(0)).collect()


def test_order_is_rejections_per_cost_and_short_circuits():
    calls = []
    rules = tuple(quality.Rule(n, lambda t, n=n: calls.append(n) or n == "c") for n in "abc")
    ordered = quality.order_rules({"a": (1.0, 0.5), "b": (0.1, 0.4), "c": (0.01, 0.3)}, rules)
    assert [r.name for r in ordered] == ["c", "b", "a"]
    assert quality.verdict(quality.Text("x"), ordered) == "c" and calls == ["c"]


@pytest.mark.parametrize("order", [1, -1])
def test_order_does_not_change_verdicts(order):
    for t in TEXTS:
        assert (quality.verdict(quality.Text(t), quality.RULES[::order]) is None) == (quality.verdict(quality.Text(t), quality.RULES) is None)


def test_letters_by_category():
    import unicodedata

    for t in ("ªºⅧⒶʰ aB", "ÀÉà", "", "漢字", "ǅ ẞß", "AbC" * 9 + "É"):
        upper, lower = (sum(unicodedata.category(c) == k for c in t) for k in ("Lu", "Ll"))
        assert quality.Text(t).shouted == upper / max(1, upper + lower)


def test_long_texts_are_measured_alike(monkeypatch):
    texts = [t for t in TEXTS if t] + ["a b c d a b c", "x y", "x y z", "x y z x y z " * 50]
    for long in (0, 7, 64):
        monkeypatch.setattr(quality, "LONG", long)
        for t in texts:
            got = quality.Text(t)
            n, _, _, _, repeat = brute(t)
            assert (got.n_words, got.n_repeat_words) == (n, repeat)


def test_memory_of_a_long_text():
    import tracemalloc

    import numpy as np

    text = " ".join(map(str, np.random.default_rng(1).integers(0, 1 << 30, 600_000)))
    assert len(text) > quality.LONG
    tracemalloc.start()
    t = quality.Text(text)
    assert t.n_words == 600_000 and t.n_repeat_words == 0
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_order_counts_shared_measures_once_and_only_what_is_left():
    rules = tuple(quality.Rule(n, lambda t: False, False, needs) for n, needs in (("a", ("n_repeat_words",)), ("b", ("n_words",)), ("c", ("lines",)), ("d", ("n_words",))))
    seconds = {"data": 1.0, "n_words": 4.0, "n_repeat_words": 10.0, "lines": 2.0}
    # b rejects 30, a 40 of which 30 are b's; c rejects 5; d rejects none that b lets through.
    sample = quality.Sample(100, seconds, {0b0011: 20, 0b1011: 10, 0b0001: 10, 0b0100: 5, 0: 55})
    assert [r.name for r in quality.order_by_sample(sample, rules)] == ["b", "c", "a", "d"]
    assert quality.order_by_sample(quality.Sample(0, {}, {}), rules) == rules


def test_sample_is_drawn_from_the_whole_table(spark):
    docs = spark.range(0, 20_000, 1, 4).selectExpr("id doc_id", "case when id < 15000 then 'short' else repeat('many words ', 60) end text")
    s = quality.measure_rules(docs)
    assert 150 < s.n < 400 and sum(s.rejected.values()) == s.n
    assert 0.6 < sum(n for mask, n in s.rejected.items() if mask & 1) / s.n < 0.9
    one = docs.selectExpr("cast(null as long) doc_id", "'same' text")
    assert quality.measure_rules(one).n <= 4 * quality.SAMPLE_ROWS
    assert quality.measure_rules(docs.limit(0)).n == 0
