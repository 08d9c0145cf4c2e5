import corpus_pipeline
from lumenweave.llm import langid, quality

from test_packing import check as check_packing
from test_simhash import brute_components, brute_fingerprint


def expected(spark, docs):
    """Each stage by brute force on its predecessor's rows."""
    good = [r for r in docs if quality.verdict(quality.Text(r.text), quality.RULES) is None]
    df = spark.createDataFrame(good, SCHEMA)
    _, scores = langid.identify(langid.train(df), [r.text for r in good])
    known = [r for r, s in zip(good, scores) if s >= langid.AMBIGUOUS]
    at = brute_components(sorted((r.doc_id, brute_fingerprint(r.text)) for r in known))
    return good, known, [r for r in known if at[r.doc_id] == r.doc_id]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_and_run(spark):
    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/documents.parquet")
    docs = table.collect()
    stages = expected(spark, docs)
    df = table
    for (name, stage), want in zip(corpus_pipeline.STAGES, stages):
        df = stage(spark, df, d)
        assert df.columns == table.columns, name
        assert sorted(r.doc_id for r in df.collect()) == sorted(r.doc_id for r in want), name
    assert len(docs) > len(stages[0]) >= len(stages[1]) > len(stages[2]) > 0
    check_packing(corpus_pipeline.run(spark, d).collect(), [(r.doc_id, r.text) for r in stages[2]], 2048)


def test_cases_of_each_stage(spark):
    d = "/root/testdata/sf0.001"
    good = [r for r in spark.read.parquet(f"{d}/documents.parquet").collect() if quality.verdict(quality.Text(r.text), quality.RULES) is None][:40]
    long = " ".join(r.text for r in good if r.lang == good[0].lang) * 40
    # Columns that bear names of the operators' own.
    names = [*SCHEMA.replace("doc_id long, text string, lang string, ", "").split(", "), "h int", "id int", "fp int", "key int", "root int", "component_id int"]
    schema = "doc_id long, text string, lang string, " + ", ".join(names)
    row = lambda i, t, lang: (i, t, lang, "s", len(t or ""), 1, 2, 3, 4, 5, 6)
    rows = [row(r.doc_id, r.text, r.lang) for r in good]
    odd = [row(10_001, None, None), row(10_002, "", None), row(10_003, " \n", "en"), row(10_004, None, "en")]
    twice, nameless, huge = row(10_005, good[0].text, good[0].lang), row(None, good[0].text, good[0].lang), row(10_006, long, None)
    df = spark.createDataFrame([*rows, *odd, twice, twice, nameless, huge], schema)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality_rules", "language_id"):
        out = stages[name](spark, df, d)
        assert out.columns == df.columns
        ids = [r.doc_id for r in out.collect()]
        assert not {10_001, 10_002, 10_003, 10_004} & set(ids) and ids.count(10_005) in (0, 2), name
        assert (None in ids) == (10_005 in ids), name
    out = stages["near_duplicates"](spark, df, d)
    kept = out.collect()
    ids = [r.doc_id for r in kept]
    assert out.columns == df.columns and len(ids) == len(set(ids)) and None in ids and 10_005 not in ids
    assert {10_001, 10_002, 10_003, 10_004} & set(ids) == {10_001} and all(r[5:] == (1, 2, 3, 4, 5, 6) for r in kept)
    assert next(r.text for r in kept if r.doc_id == 10_006) == long
    check_packing(stages["packing"](spark, df, d).collect(), [(r[0], r[1]) for r in [*rows, *odd, twice, twice, nameless, huge]], 2048)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, "")
        assert out.collect() == []


def test_registered(spark):
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
