import zlib

import numpy as np
import pytest

from lumenweave.llm import langid

RNG = np.random.default_rng(0)
SYLLABLES = {"aa": "ka to mi su ne ho ri".split(), "bb": "sch ung heit ver zu ein ä".split(), "cc": "ción ar dos ñ es lla que".split(), "dd": "th ing er wh ea on nd".split()}


def text(lang, n=60):
    s = SYLLABLES[lang]
    return " ".join("".join(s[i] for i in RNG.integers(0, 7, RNG.integers(1, 4))) for _ in range(n))


def rows(n=200):
    langs = list(SYLLABLES)
    return [(i, text(langs[i % 4]), langs[i % 4]) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame([(*r, 0.5, "s") for r in data], "doc_id long, text string, lang string, score double, held_out string")


def test_held_out_accuracy_and_split(spark):
    data = rows()
    df = frame(spark, data)
    got = {r.doc_id: r for r in langid.predict(df, langid.train(df)).collect()}
    assert len(got) == len(data)
    for i, _, lang in data:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [(got[i].lang_pred == lang) for i, _, lang in data if got[i].held_out]
    assert len(held) > 30 and np.mean(held) > 0.95


def test_labels_of_held_out_documents_are_not_learned(spark):
    data = rows()
    other = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in data]
    a, b = langid.train(frame(spark, data)), langid.train(frame(spark, other))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_odd_texts(spark):
    df = frame(spark, rows())
    model = langid.train(df)
    odd = frame(spark, [(1, None, None), (2, "", "aa"), (3, "12 ,.!", "aa"), (None, text("bb"), None), (5, text("cc", 200_000), "cc"), (5, text("cc"), "aa"), (6, "漢字", None)])
    got = sorted((str(r.doc_id), r.lang_pred, r.score > 0) for r in langid.predict(odd, model).collect())
    assert got[:3] == [("1", "und", False), ("2", "und", False), ("3", "und", False)]
    assert [g[1] for g in got[3:5]] == ["cc", "cc"] and got[-1][:2] == ("None", "bb") and got[5][1] in SYLLABLES
    assert langid.predict(odd.limit(0), model).collect() == []


def test_few_labels(spark):
    none = frame(spark, [(i, text("aa"), None) for i in range(9)])
    assert langid.train(none) is None
    assert {r.lang_pred for r in langid.predict(none, None).collect()} == {"und"}
    one = frame(spark, [(i, text("aa"), "aa") for i in range(9)])
    assert {r.lang_pred for r in langid.predict(one, langid.train(one)).collect()} == {"aa"}
    empty = one.limit(0)
    assert langid.predict(empty, langid.train(empty)).collect() == []


@pytest.mark.parametrize("k", [2, 3, 4, 7, 8, 20])
def test_codewords_differ(k):
    code = langid.codewords(k)
    assert len(np.unique(code, axis=0)) == k and (np.abs(code.sum(0)) < k).all()


def test_features_of_long_texts_do_not_depend_on_stretches(monkeypatch):
    t = text("dd", 3000)
    whole = langid.features(t)
    monkeypatch.setattr(langid, "TEXT_BYTES", 1000)
    assert np.array_equal(langid.features(t), whole)


def test_stage_keeps_clean_documents(spark):
    data = rows()
    df = frame(spark, [*data, (900, None, "aa"), (901, "!!", None)])
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, _, _ in data}


@pytest.mark.parametrize("k", [2, 3, 4, 7, 8, 20])
def test_a_tie_is_ambiguous_for_any_number_of_languages(k):
    code = langid.codewords(k)
    x = np.zeros((1, langid.DIMENSIONS))
    for out, ambiguous in ((code[0] + code[1]) / 2, True), (0.8 * (code[0] + code[1]) / 2, True), (code[0], False), (0.8 * code[0], False):
        model = langid.Model([f"l{i}" for i in range(k)], code, np.zeros((langid.DIMENSIONS, code.shape[1])), out, np.full(code.shape[1], 1 / code.shape[1]))
        best, score = model.decide(x)
        assert best[0] in (0, 1) and (score[0] < langid.AMBIGUOUS) == ambiguous


@pytest.mark.parametrize("langs", [("aa", "bb"), tuple(SYLLABLES)])
def test_texts_of_two_languages_are_flagged(spark, langs):
    df = frame(spark, [(i, text(langs[i % len(langs)]), langs[i % len(langs)]) for i in range(200)])
    a, b = text("aa").split(), text("bb").split()
    mixed = frame(spark, [(n, " ".join(a[: 60 - n] + b[:n]), None) for n in range(61)])
    flagged = {r.doc_id for r in langid.predict(mixed, langid.train(df)).collect() if r.ambiguous}
    assert flagged and flagged <= set(range(10, 51))


def test_query(spark):
    from lumenweave.llm.queries import op4_language_id

    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op4_language_id(spark, d).collect()
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    held = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out and docs[r.doc_id].lang]
    assert np.mean(held) > 0.9


def test_decoding_against_all_codewords_by_hand(spark):
    import math

    data = rows(80)
    df = frame(spark, data)
    model = langid.train(df)
    mixed = [(i, text("aa", 6 + i) + " " + text("cc", 14 - i), None) for i in range(12)]
    got = {r.doc_id: r for r in langid.predict(frame(spark, mixed), model).collect()}
    for i, t, _ in mixed:
        x = langid.features(t).astype(float)
        bits = [max(-3.0, min(3.0, sum(x[d] * model.weights[d, b] for d in range(langid.DIMENSIONS)) + model.bias[b])) for b in range(model.code.shape[1])]
        losses = [sum(model.trust[b] * math.exp(-bits[b] * model.code[k, b]) for b in range(len(bits))) for k in range(len(model.languages))]
        first, second = sorted(losses)[:2]
        score = 1 - math.exp(-langid.SHARPNESS * (second - first))
        assert got[i].lang_pred == model.languages[losses.index(first)] and abs(got[i].score - score) < 1e-4
        assert got[i].ambiguous == (got[i].score < langid.AMBIGUOUS)
    assert any(r.ambiguous for r in got.values())


def test_sample_is_bounded_and_repeated_rows_count_once(spark, monkeypatch):
    same = [(7, text("aa"), "aa")] * 2000 + [(9, text("bb", 20 + i % 50), "bb") for i in range(300)]
    model = langid.train(frame(spark, same))
    assert model.languages == ["aa", "bb"]
    seen = []
    monkeypatch.setattr(langid, "fit", lambda labels, x, fit=langid.fit: seen.append(labels) or fit(labels, x))
    langid.train(frame(spark, same))
    assert seen[0].count("aa") == 1 and seen[0].count("bb") == 300
    monkeypatch.setattr(langid, "MOST_SAMPLED", 40)
    langid.train(frame(spark, rows(400)))
    assert len(seen[1]) <= 80 and set(seen[1]) == set(SYLLABLES)
