"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A text is the multiset of its paragraphs (stretches between line feeds). A paragraph's vector is wide: ``WIDE`` entries
of 32 bits are hashes of the whole paragraph, each with a seed of its own, and ``LANES`` entries of ``LANE_BITS`` bits add
up +1 or -1, the bits of a 64-bit hash, over the paragraph's pairs of neighbouring words (the last word is paired with
none). A fingerprint is the sum of the vectors of all paragraphs, each entry modulo its power of two, written as hex
digits: it doesn't depend on the order of paragraphs, and a paragraph is inserted or deleted by adding or subtracting
its vector (``add`` and ``subtract``). An edited text is fingerprinted that way: paragraphs that the edit leaves alone
are hashed once, those that it takes away and brings in are hashed for themselves.

The wide entries decide equality. The others serve likeness, which is found from two fingerprints alone: their
difference, entry by entry and modulo the power of two, is an unbiased sketch of the pairs of words that only one text
has, so likeness is 1 less the squared length of the difference over the sum of both squared lengths, held to 0 to 1.
Equal fingerprints are alike by 1.

Defined results: a null text counts as an empty one, which is one paragraph of one empty word; the next document of one
is that of the smallest larger doc_id (of the largest: the smallest), if rows repeat an id its smallest text; rows
without a doc_id come last of all ids; each row gives one row, copies of a row too; very long texts are split in their
task, a paragraph's words being held at a time; an empty table gives an empty table; columns other than the id and the
text are not read and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.llm.shared import cut, store, utf8

#: Entries of 32 bits that decide equality, entries that serve likeness, bits of each of those.
WIDE, LANES, LANE_BITS = 8, 64, 24
DIGITS, HALF = LANE_BITS // 4, 1 << (LANE_BITS - 1)
LINE, BLANK = "\n", " "


# --- the vectors of paragraphs ---------------------------------------------------------------------------------


def wide_sums(paragraphs: Column) -> list[Column]:
    """For each seed the sum of the paragraphs' hashes, 32 bits of each."""

    def of(seed: int) -> Column:
        return F.aggregate(paragraphs, F.lit(0).cast("long"), lambda s, p: s + F.xxhash64(p, F.lit(seed)).bitwiseAND((1 << 32) - 1))

    return [of(j) for j in range(WIDE)]


def written(values: list[Column], digits: int) -> Column:
    """Numbers modulo a power of 16 as hex digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.pmod(v, F.lit(1 << 4 * digits))), digits, "0") for v in values]))


def written_lanes(lanes: Column) -> Column:
    return F.lower(F.array_join(F.transform(lanes, lambda v: F.lpad(F.hex(v.cast("long")), DIGITS, "0")), ""))


def bit_sums(h: Column) -> list[Column]:
    """Aggregates over hashes: the set bits k and k + 32 side by side in one number, and the number of hashes.

    A text has under 2**31 words (a string is under 2**31 bytes), so neither sum reaches the other.
    """
    pairs = F.lit((1 << 32) + 1)
    return [F.sum(F.shiftright(h, k).bitwiseAND(pairs)).alias(f"p{k}") for k in range(LANES // 2)] + [F.count(h).alias("n")]


def word_sums(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, part and the ``bit_sums`` over the words of the paragraphs p of each part; ``texts`` has parts, an array of (part, p)."""
    words = texts.select(*keys, F.explode("parts").alias("e")).select(*keys, "e.part", F.split("e.p", BLANK).alias("a"))
    pairs = words.withColumn("b", F.slice("a", F.lit(2), F.size("a"))).select(*keys, "part", F.explode(F.arrays_zip("a", "b")).alias("w"))
    return pairs.groupBy(*keys, "part").agg(*bit_sums(F.xxhash64("w.a", "w.b")))


def lanes_of(parts: list[int]) -> Column:
    """An aggregate over ``word_sums``: the entries for likeness of these parts together, an array."""
    held = F.col("part").isin(parts)
    n = F.sum(F.when(held, F.col("n")).otherwise(0))
    low = [F.sum(F.when(held, F.col(f"p{k}").bitwiseAND((1 << 32) - 1)).otherwise(0)) for k in range(LANES // 2)]
    high = [F.sum(F.when(held, F.shiftrightunsigned(f"p{k}", 32)).otherwise(0)) for k in range(LANES // 2)]
    return F.transform(F.array(*low, *high), lambda s: F.pmod(2 * s - n, F.lit(1 << LANE_BITS)).cast("int"))


def centred(v: Column) -> Column:
    """The number nearest to zero that equals ``v`` modulo the entries' power of two."""
    return (F.pmod(v + HALF, F.lit(1 << LANE_BITS)) - HALF).cast("double")


def squares(lanes: Column) -> Column:
    return F.aggregate(lanes, F.lit(0.0), lambda s, v: s + centred(v) * centred(v))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints by their entries for likeness."""
    apart = squares(F.zip_with(a, b, lambda x, y: x - y))
    both = squares(a) + squares(b)
    return F.when(apart == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - apart / both))


def print_likeness(a: Column, b: Column) -> Column:
    """Of two written fingerprints."""
    return likeness(_entries(a, WIDE * 8, DIGITS, LANES), _entries(b, WIDE * 8, DIGITS, LANES))


def _entries(fingerprint: Column, at: int, digits: int, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.conv(F.substring(fingerprint, i * digits + at + 1, F.lit(digits)), 16, 10).cast("long"))


def _combine(a: Column, b: Column, sign: int) -> Column:
    def of(at: int, digits: int, n: int) -> Column:
        sums = F.zip_with(_entries(a, at, digits, n), _entries(b, at, digits, n), lambda x, y: F.pmod(x + sign * y, F.lit(1 << 4 * digits)))
        return F.array_join(F.transform(sums, lambda v: F.lpad(F.lower(F.hex(v)), digits, "0")), "")

    return F.concat(of(0, 8, WIDE), of(WIDE * 8, DIGITS, LANES))


def add(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of both."""
    return _combine(a, b, 1)


def subtract(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of ``a`` without those of ``b``."""
    return _combine(a, b, -1)


# --- documents and their edits -----------------------------------------------------------------------------------


def followers(ids: DataFrame) -> DataFrame:
    """(id, next) of distinct ids in ascending order, nulls last, the first following the last.

    Ranges of ids are ordered each on its own; only the first id of each range meets those of the others.
    """
    placed = cut(ids.distinct().repartitionByRange(F.col("id").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    order = Window.orderBy("part")
    firsts = placed.groupBy("part").agg(F.struct(F.min("id").alias("id")).alias("head"))
    ring = firsts.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(order)).alias("head"))
    after = F.lead(F.struct("id")).over(Window.partitionBy("part").orderBy(F.col("id").asc_nulls_last()))
    return placed.withColumn("after", after).join(F.broadcast(ring), "part").select("id", F.coalesce("after", "head")["id"].alias("next"))


def has_repeats(docs: DataFrame, doc_id: str) -> bool:
    return docs.groupBy(doc_id).count().filter("count > 1").limit(1).count() > 0


def keyed(name: Column, prefix: str = "") -> list[Column]:
    """An id as two columns that are never null, so that joins on them are plain ones."""
    return [F.coalesce(name.cast("long"), F.lit(0)).alias(f"{prefix}k"), name.isNull().alias(f"{prefix}nul")]


QUARTER = "cast(char_length(t) div 4 as int)"


def edits(docs: DataFrame, repeats: bool, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, nul, t, copies, next_k, next_nul, next_hash, head): each text, and what replaces its last quarter.

    Without repeated ids whole texts are dealt once, by id, and stay where they are. With them equal rows are taken
    together first, and of an id's texts only the smallest meets the documents before it: the least of all texts'
    beginnings is the beginning of the least text.
    """
    rows = docs.select(*keyed(F.col(doc_id)), utf8(F.col(text)).alias("t"))
    firsts = rows
    if repeats:
        firsts = rows.groupBy("k", "nul").agg(F.min("t").alias("t"))
        rows = rows.groupBy("k", "nul", "t").agg(F.count("*").alias("copies"))
    ring = followers(docs.select(F.col(doc_id).cast("long").alias("id"))).select(*keyed(F.col("id")), *keyed(F.col("next"), "next_"))
    sizes = docs.select(*keyed(F.col(doc_id)), F.expr(f"cast(char_length(coalesce(`{text}`, '')) div 4 as int)").alias("q")).distinct()
    links = cut(sizes.join(ring, ["k", "nul"]))
    after = firsts.select(F.col("k").alias("next_k"), F.col("nul").alias("next_nul"), F.col("t").alias("after"))
    heads = after.join(links, ["next_k", "next_nul"]).select("k", "nul", "q", "next_k", "next_nul", F.xxhash64("after").alias("next_hash"), F.expr("substring(after, 1, q)").alias("head"))
    if repeats:
        return rows.withColumn("q", F.expr(QUARTER)).join(heads, ["k", "nul", "q"]).drop("q")
    return rows.join(heads.drop("q"), ["k", "nul"]).withColumn("copies", F.lit(1).cast("long"))


def parts_of(edited: DataFrame) -> DataFrame:
    """Of each text the paragraphs that the edit leaves alone (part 0), takes away (1) and brings in (2), and what is known of the whole."""
    rows = edited.withColumn("kept", F.expr(f"substring(t, 1, char_length(t) - {QUARTER})")).withColumn("stems", F.split("kept", LINE))
    open_ = F.element_at("stems", -1)
    rows = rows.withColumns({
        "stem": F.slice("stems", F.lit(1), F.size("stems") - 1),
        "old": F.split(F.concat(open_, F.expr("substring(t, char_length(kept) + 1, char_length(t))")), LINE),
        "new": F.split(F.concat(open_, "head"), LINE),
        "sha": F.sha2(F.encode(F.concat("kept", "head"), "UTF-8"), 256),
    })
    stem, old, new = (wide_sums(F.col(c)) for c in ("stem", "old", "new"))
    named = lambda c, i: F.transform(c, lambda p: F.struct(F.lit(i).alias("part"), p.alias("p")))
    return rows.select(
        "k", "nul", F.xxhash64("t").alias("text_hash"), "copies", "next_k", "next_nul", "next_hash", F.char_length("t").cast("long").alias("n_chars"), "sha",
        written([a + b for a, b in zip(stem, old)], 8).alias("own_wide"), written([a + b for a, b in zip(stem, new)], 8).alias("new_wide"),
        F.concat(*[named(F.col(c), i) for i, c in enumerate(("stem", "old", "new"))]).alias("parts"),
    )


def compare_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: its fingerprint, its edited text's, and the likeness to that and to the next document's."""
    texts = parts_of(edits(docs, has_repeats(docs, doc_id), doc_id, text))
    keys = [c for c in texts.columns if c != "parts"]
    prints = store(word_sums(texts, keys).groupBy(*keys).agg(lanes_of([0, 1]).alias("own"), lanes_of([0, 2]).alias("new")), "prints")
    after = prints.select(F.col("k").alias("next_k"), F.col("nul").alias("next_nul"), F.col("text_hash").alias("next_hash"), F.col("own").alias("after"))
    rows = prints.join(after, ["next_k", "next_nul", "next_hash"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(
        F.when(~F.col("nul"), F.col("k")).alias("doc_id"), "n_chars", F.col("sha").alias("edited_sha256"),
        F.concat("own_wide", written_lanes(F.col("own"))).alias("fingerprint"), F.concat("new_wide", written_lanes(F.col("new"))).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
    )


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a distinct pair of id and text: doc_id, fingerprint."""
    rows = docs.select(*keyed(F.col(doc_id)), utf8(F.col(text)).alias("t"))
    if has_repeats(docs, doc_id):
        rows = rows.distinct()
    rows = rows.withColumn("paragraphs", F.split("t", LINE))
    parts = F.transform("paragraphs", lambda p: F.struct(F.lit(0).alias("part"), p.alias("p")))
    texts = rows.select("k", "nul", F.xxhash64("t").alias("text_hash"), written(wide_sums(F.col("paragraphs")), 8).alias("wide"), parts.alias("parts"))
    keys = ["k", "nul", "text_hash", "wide"]
    lanes = word_sums(texts, keys).groupBy(*keys).agg(lanes_of([0]).alias("lanes"))
    return lanes.select(F.when(~F.col("nul"), F.col("k")).alias("doc_id"), F.concat("wide", written_lanes(F.col("lanes"))).alias("fingerprint"))
