"""URL rules by a Bloom filter cascade, in DataFrame functions only.

Level 0 encodes the listed keys. Level 1 encodes those other keys of the corpus that level 0 lets through,
level 2 the listed keys that level 1 lets through, and so on until nothing passes wrongly. Over the key
universe the cascade was built on, a key is listed exactly if the first level that refuses it is an odd one.
Keys are then looked up without a join; the levels are literals of the plan, of at most ``MAX_BITS`` bits each.
A level's bits follow from the keys that it holds and from how many of the others may pass it wrongly, so that the
next level holds no more than ``LEAST_PASSING`` keys (or as many as this one) however large the corpus is.

Defined results: a null url or one without ``://`` has an empty host and path and fits no rule; a url that no
rule fits is allowed; of equally long rules that fit, the one that sorts last wins; rows that repeat are judged one
by one; very long urls cost time by their length only, since no more labels of a host are looked up than a rule has;
an empty table gives an empty table; of other columns only the id and the url are read. Where a level would not fit
``MAX_BITS`` (a list of some hundred thousand rules) keys are joined with the rules instead, with equal results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.llm.shared import cut

#: Hash positions of a key, the proven bound of a level's bits, wrongly passing keys that any level may leave to the next.
HASHES, MAX_BITS, LEAST_PASSING = 4, 1 << 23, 4096

#: The rules of the registered query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a url; both empty if it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def candidates(host: Column, path: Column, most_labels: int, path_lengths: Sequence[int]) -> Column:
    """Keys under which a url may be listed, longest first: the host's last labels, up to ``most_labels``, with each path prefix of a listed length."""
    n = F.length(host) - F.length(F.replace(host, F.lit("."))) + 1
    suffixes = [F.when(n >= i, F.substring_index(host, ".", -i)) for i in range(1, most_labels + 1)]
    prefixes = [F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in path_lengths]
    # concat of a missing part is missing
    keys = F.array_compact(F.array(*[F.concat(s, p) for s in suffixes for p in prefixes]))
    return F.when(host != "", F.reverse(F.array_sort(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]))


def _places(key: Column, bits: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * HASHES + i)), F.lit(bits)) for i in range(HASHES)]


@dataclass(frozen=True)
class Level:
    seed: int
    bits: int
    words: tuple[int, ...]

    def passes(self, key: Column) -> Column:
        """Whether all of the key's bits are set."""
        held = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        hit = F.lit(True)
        for place in _places(key, self.bits, self.seed):
            hit = hit & (F.getbit(F.get(held, F.shiftright(place, 6).cast("int")), F.pmod(place, F.lit(64)).cast("int")) == 1)
        return hit


def bits_for(n: int, others: int) -> int:
    """Bits of a level of ``n`` keys that about as many or LEAST_PASSING of ``others`` pass wrongly, half of them at most."""
    share = min(0.5, max(n, LEAST_PASSING) / max(1, others))
    return 64 * max(1, math.ceil(n * HASHES / -math.log1p(-(share ** (1 / HASHES))) / 64))


def level_of(keys: DataFrame, bits: int, seed: int) -> Level:
    """The filter of the keys in column ``key``; its words, at most MAX_BITS / 64, come to the driver."""
    place = F.explode(F.array(*_places(F.col("key"), bits, seed)))
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
    held = dict(words.collect())
    return Level(seed, bits, tuple(held.get(i, 0) for i in range(bits // 64)))


def build_cascade(universe: DataFrame, most_levels: int = 64) -> list[Level] | None:
    """Levels for the distinct rows (key, listed) of ``universe``; None if one would exceed MAX_BITS or if they don't end."""
    levels: list[Level] = []
    inside, others = universe.filter("listed").select("key"), universe.filter("not listed").select("key")
    n, rest = inside.count(), others.count()
    while n:
        bits = bits_for(n, rest)
        if bits > MAX_BITS or len(levels) == most_levels:
            return None
        levels.append(level_of(inside, bits, len(levels)))
        inside, others = others.filter(levels[-1].passes(F.col("key"))), inside
        n, rest = inside.count(), n
    return levels


def listed(levels: Sequence[Level], key: Column) -> Column:
    """Exact membership of a key of the universe."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(~levels[i].passes(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict. ``rules`` are (host, path prefix, allow or block)."""
    host, path = split_url(F.col(url))
    parts = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    names = {h + p: v for h, p, v in rules if h and (not p or p[0] == "/")}  # no other rule fits a url
    if not names:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    lengths = sorted({len(k) - len(k.partition("/")[0]) for k in names})
    most_labels = max(k.partition("/")[0].count(".") + 1 for k in names)
    keyed = parts.withColumn("keys", candidates(F.col("host"), F.col("path"), most_labels, lengths))
    universe = cut(keyed.select(F.explode("keys").alias("key")).distinct().withColumn("listed", F.col("key").isin(list(names))).withColumn("blocks", F.col("key").isin([k for k, v in names.items() if v == "block"])))
    all_keys = build_cascade(universe.select("key", "listed"))
    blocking = build_cascade(universe.select("key", F.col("blocks").alias("listed")))
    if all_keys is None or blocking is None:
        return judge_by_join(keyed, names)
    rule = F.get(F.filter("keys", lambda k: listed(all_keys, k)), F.lit(0))
    ruled = keyed.withColumn("rule", rule)
    verdict = F.when(F.col("rule").isNotNull() & listed(blocking, F.col("rule")), "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def judge_by_join(keyed: DataFrame, names: dict[str, str]) -> DataFrame:
    """As ``judge`` for lists that no cascade holds: only distinct pairs of host and path meet the rules."""
    rules = keyed.sparkSession.createDataFrame(list(names.items()), "key string, said string")
    urls = keyed.select("host", "path", "keys").distinct().select("host", "path", F.explode("keys").alias("key"))
    fits = urls.join(rules, "key").groupBy("host", "path").agg(F.max(F.struct(F.length("key"), "key", "said")).alias("best"))
    return keyed.join(fits, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.said", F.lit("allow")).alias("verdict"))


def member(keys: DataFrame, listing: DataFrame, key: str = "key") -> DataFrame:
    """``keys`` with a column ``listed``: whether the key is in ``listing``, of any size, by a cascade (or, past its bound, a join)."""
    known = listing.select(F.col(key).alias("key")).distinct().withColumn("hit", F.lit(True))
    universe = cut(keys.select(F.col(key).alias("key")).filter(F.col(key).isNotNull()).distinct().join(known, "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("listed")))
    levels = build_cascade(universe)
    if levels is None:
        return keys.join(known.select(F.col("key").alias(key), F.col("hit").alias("listed")), key, "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return keys.withColumn("listed", F.coalesce(F.col(key).isNotNull() & listed(levels, F.col(key)), F.lit(False)))
