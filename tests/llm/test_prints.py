import hashlib

from pyspark.sql import functions as F

from lumenweave.llm import prints


def edited(rows, i):
    """The edited text of row i of (doc_id, text): ids ascending, nulls last."""
    key = lambda d: (d is None, d or 0)
    ids = sorted({d for d, _ in rows}, key=key)
    d, t = rows[i][0], rows[i][1] or ""
    after = ids[(ids.index(d) + 1) % len(ids)]
    head = min((x or "")[: len(t) // 4] for k, x in rows if k == after)
    return t[: len(t) - len(t) // 4] + head


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, next string, n long")
    got = prints.compare_edits(docs).collect()
    want = sorted((str(d), len(t or ""), hashlib.sha256(edited(rows, i).encode()).hexdigest()) for i, (d, t) in enumerate(rows))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    return got


TEXT = "\n".join(" ".join(f"w{i * 31 % 97}x{j}" for j in range(12)) for i in range(20))


def test_edits_and_likeness(spark):
    got = {r.doc_id: r for r in check(spark, [(1, TEXT), (4, "ünïcode\n" * 9), (9, TEXT), (12, None), (13, "a"), (-5, "\n")])}
    assert got[1].fingerprint == got[9].fingerprint != got[4].fingerprint
    assert got[1].near_edited > 0.5 > got[1].near_next


def test_repeated_rows_and_missing_ids(spark):
    got = check(spark, [(1, TEXT), (1, TEXT), (1, "other " * 9), (None, TEXT), (None, "z"), (2, "abcdefgh")])
    same = {r.fingerprint for r in got if r.n_chars == len(TEXT)}
    assert len(same) == 1


def test_one_and_no_document(spark):
    (r,) = check(spark, [(3, "some words here")])
    assert r.near_next == 1.0
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert prints.compare_edits(docs).collect() == [] == prints.fingerprints(docs).collect()


def test_order_and_increments(spark):
    docs = spark.createDataFrame([(1, "a b\nc d e\nf"), (2, "f\na b\nc d e"), (3, "a b\nf"), (4, "c d e"), (5, "b a\nc d e\nf")], "doc_id long, text string")
    f = {r.doc_id: r.fingerprint for r in prints.fingerprints(docs).collect()}
    assert f[1] == f[2] != f[5]
    row = spark.createDataFrame([(f[1], f[3], f[4])], "whole string, rest string, gone string")
    r = row.select(prints.add(F.col("rest"), F.col("gone")).alias("sum"), prints.subtract(F.col("whole"), F.col("gone")).alias("less")).first()
    assert (r.sum, r.less) == (f[1], f[3])


def by_hand(spark, text):
    """The fingerprint of a text, its hashes from SQL and all the rest in Python."""
    paragraphs = text.split("\n")
    pairs = [(w, v) for p in paragraphs for words in [p.split(" ")] for w, v in zip(words, [*words[1:], None])]
    df = spark.createDataFrame([(p,) for p in paragraphs], "p string")
    wide = [sum(r[0] % (1 << 32) for r in df.select(F.xxhash64("p", F.lit(j))).collect()) % (1 << 32) for j in range(8)]
    hashes = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(F.xxhash64("a", "b")).collect()]
    lanes = [(sum(1 if h >> k & 1 else -1 for h in hashes)) % (1 << 24) for k in range(64)]
    return "".join(f"{x:08x}" for x in wide) + "".join(f"{x:06x}" for x in lanes)


def alike(a, b):
    """Likeness of two written fingerprints."""
    x, y = ([int(f[64 + 6 * k : 70 + 6 * k], 16) for k in range(64)] for f in (a, b))
    near = lambda v: (v + (1 << 23)) % (1 << 24) - (1 << 23)
    apart, both = sum(near(i - j) ** 2 for i, j in zip(x, y)), sum(near(i) ** 2 + near(j) ** 2 for i, j in zip(x, y))
    return 1.0 if apart == 0 else max(0.0, 1 - apart / both)


def test_sums_against_hashing_by_hand(spark):
    texts = {1: "a b c\nd", 2: "", 3: "\n\n", 4: "one  two\ttwo\none  two\ttwo", 5: TEXT}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in prints.fingerprints(docs).collect()}
    assert got == {k: by_hand(spark, t) for k, t in texts.items()}


def test_edited_prints_and_likeness_against_brute_force(spark):
    other = "\n".join(" ".join(f"o{i * 17 % 89}z{j}" for j in range(9)) for i in range(12))
    rows = [(1, TEXT), (2, other), (3, TEXT[:600] + other[300:]), (4, None), (5, "x"), (6, "one two three four five six seven"), (None, TEXT)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in prints.compare_edits(docs).collect()}
    ids = [d for d, _ in rows]
    for i, (d, t) in enumerate(rows):
        r, after = got[d], got[ids[(i + 1) % len(ids)]]
        assert r.fingerprint == by_hand(spark, t or "") and r.edited_fingerprint == by_hand(spark, edited(rows, i))
        assert abs(r.near_edited - alike(r.fingerprint, r.edited_fingerprint)) < 1e-12
        assert abs(r.near_next - alike(r.fingerprint, after.fingerprint)) < 1e-12
    pair = spark.createDataFrame([(got[1].fingerprint, got[3].fingerprint)], "a string, b string")
    assert abs(pair.select(prints.print_likeness(F.col("a"), F.col("b"))).first()[0] - alike(got[1].fingerprint, got[3].fingerprint)) < 1e-12
    # A sketch of 64 entries: the share of word pairs that both texts have, give or take.
    assert 0.6 < got[1].near_edited < 0.95 and got[1].near_next < 0.35


def test_hot_ids_and_a_long_paragraph(spark):
    rows = [(7, f"text {i % 5} of one id") for i in range(300)] + [(None, "no id") for _ in range(300)] + [(8, "long " * 200_000)]
    got = check(spark, rows)
    assert len({r.fingerprint for r in got}) == 7


def test_query(spark):
    from lumenweave.llm.queries import op3_fingerprints

    d = "/root/testdata/sf0.001"
    got = op3_fingerprints(spark, d).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = sorted((k, len(t), hashlib.sha256(edited(rows, i).encode()).hexdigest()) for i, (k, t) in enumerate(rows))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert sum(r.near_edited > r.near_next for r in got) > 0.9 * len(got)
