"""Main text of HTML pages: a suffix array of each host's token streams finds boilerplate.

The pages of a host, ``CHUNK_PAGES`` at a time, are concatenated as streams of words, and the suffixes of the whole
are sorted by prefix doubling as far as ``RUN`` words. Where a host takes several chunks and repetition decides on any
of its pages, hashes of all its runs of RUN words are counted over the whole host, so that chunks don't change results.
Runs of RUN words or more that stand on distinct pages are covered; a block (a paragraph, heading, list item ...) whose words are mostly covered is boilerplate, the other runs
are unique to their page and kept.

Repetition alone can't give the article of every page: articles are copied between pages, and a menu may stand on
one page only. So an exact check by structure follows the array's verdict. It overturns it where a repeated block
stands within ``article`` or ``main`` (restored), and it is asked about unique blocks, which go if they stand within
menus, headers, footers, asides, forms, adverts, notices, comments and the like, or outside the page's ``article`` or
``main``. A repeated block elsewhere goes by the array alone. Each page's row says how many of its blocks went by the
array, how many by structure and how many were restored. Pages without ``article`` or ``main`` rest on repetition
for all that such structure doesn't name.

Defined results: a null html gives an empty text; broken markup is read as far as it goes; pages that repeat are
extracted one by one (and make each other's blocks repeated); of ties there are none, a run on two pages is repeated
on both; very long pages make a chunk of their own and are read whole; a null url or one without a host shares the
host ""; an empty table gives an empty table; other columns are not read and may have any names. Whether a block
counts as gone by the array or by structure is told within a chunk where no page of the host depends on it.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.llm.shared import cut, slices, store
from lumenweave.llm.urls import split_url

#: Words of a repeated run, pages of a host taken together, hosts whose pages are dealt to several tasks.
RUN, CHUNK_PAGES, HOT_HOSTS = 8, 256, 10_000
#: Share of a block's words that must be covered for it to count as boilerplate.
COVERED = 0.8
#: Characters of html that a chunk holds at most (one page at least), and that a task gets on average.
CHUNK_CHARS, TASK_BYTES = 16 << 20, 16 << 20

#: Elements that break blocks, that hold no content, that are void, whose attributes may name boilerplate, and what names it.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split())
DROPPED = frozenset("nav header footer aside form head script style noscript template iframe svg math button select option textarea menu dialog object embed canvas audio video title fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMES = frozenset("ad ads advert advertisement adverts advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus footer masthead share sharing social related newsletter subscribe signup popup modal overlay pagination widget toolbar".split())
NAMED = (BLOCKS | {"td", "th", "caption"}) - {"html", "body"}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
#: One attribute after another, values taken whole, so that none is found within the value of another.
ATTRIBUTE = re.compile(r"(=?[^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
WORD = re.compile(r"[a-z0-9]+")


@dataclass
class Block:
    text: str
    main: bool
    dropped: bool


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    has_main: bool = False


def names_boilerplate(attributes: str) -> bool:
    if not attributes or attributes.isspace():
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id") and not NAMES.isdisjoint(WORD.findall(value)):
            return True
        if (key == "role" and value.strip() in ROLES) or (key == "hidden") or (key == "aria-hidden" and value == "true"):
            return True
    return False


def parse(html: str) -> Page:
    """The page's blocks of text in order, with what their elements say of them."""
    page, held = Page(), []
    stack: list[tuple[str, bool, bool]] = []  # name, within main, within something dropped
    opened: Counter[str] = Counter()
    main = dropped = False

    def close() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                page.blocks.append(Block(text, main, dropped))

    def state() -> tuple[bool, bool]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, False)

    at = 0
    for m in MARKUP.finditer(html):
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            if m[1]:
                held.append(" ")
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCKS or name in DROPPED:
            close()
        elif name in ("td", "th"):
            held.append(" ")
        if m[2] or m[5]:
            if opened[name]:
                while (last := stack.pop()[0]) != name:
                    opened[last] -= 1
                opened[name] -= 1
                now = state()
                if now != (main, dropped):
                    close()
                    main, dropped = now
            continue
        if name in VOID:
            continue
        if name in BLOCKS and stack and stack[-1][0] == "p":
            stack.pop()
            opened["p"] -= 1
        main, dropped = state()
        if name in ("article", "main"):
            # An article inside an unclosed menu or advert is an article all the same.
            main, dropped, page.has_main = True, names_boilerplate(m[4] or m[7] or ""), True
        elif name in DROPPED or (name in NAMED and names_boilerplate(m[4] or m[7] or "")):
            if not dropped:
                close()
            dropped = True
        stack.append((name, main, dropped))
        opened[name] += 1
    if at < len(html):
        held.append(html[at:])
    close()
    return page


def covered_words(streams: list[np.ndarray], run: int = RUN) -> list[np.ndarray]:
    """For each stream of word numbers, which words lie in runs that also stand in another stream."""
    lengths = [len(s) for s in streams]
    total = sum(lengths) + len(streams)
    text, owner = np.empty(total, np.int64), np.empty(total, np.int64)
    at, starts = 0, []
    for k, s in enumerate(streams):
        starts.append(at)
        text[at : at + len(s)] = s
        text[at + len(s)] = -1 - k  # ends a stream and equals nothing else
        owner[at : at + len(s) + 1] = k
        at += len(s) + 1
    # Prefix doubling: rank is the order of suffixes by their first ``width`` words.
    _, rank = np.unique(text, return_inverse=True)
    width = 1
    while width < run:
        step = min(width, run - width)
        other = np.concatenate([rank[step:], np.full(min(step, total), -1)])[:total] + 1
        _, rank = np.unique(rank * (total + 2) + other, return_inverse=True)
        width += step
    order = np.argsort(rank, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(rank[order]) > 0]))
    shared = np.minimum.reduceat(owner[order], first) != np.maximum.reduceat(owner[order], first)
    hit = np.zeros(total + run + 1, np.int64)
    begin = np.flatnonzero(shared[rank])
    np.add.at(hit, begin, 1)
    np.add.at(hit, begin + run, -1)
    covered = np.cumsum(hit)[:total] > 0
    return [covered[s : s + n] for s, n in zip(starts, lengths)]


def streams_of(parsed: list[Page]) -> tuple[list[np.ndarray], list[list[int]], dict[str, int]]:
    """Of each page the numbers of its words and the words in each block; the words' numbers."""
    number: dict[str, int] = {}
    streams, sizes = [], []
    for page in parsed:
        words = [b.text.split(" ") for b in page.blocks]
        sizes.append([len(w) for w in words])
        streams.append(np.array([number.setdefault(x, len(number)) for w in words for x in w], np.int64))
    return streams, sizes, number


def window_keys(streams: list[np.ndarray], number: dict[str, int], host: str) -> list[np.ndarray]:
    """Of each stream a 64-bit hash of the host and each run of RUN words."""
    hashes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in number], np.uint64)
    seed, out = np.uint64(xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"), 1)), []
    for s in streams:
        words, n = hashes[s], max(0, len(s) - RUN + 1)
        h = np.full(n, seed, np.uint64)
        for k in range(RUN):
            h = (h ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append(h.view(np.int64))
    return out


def undecided(page: Page) -> bool:
    """Whether repetition decides on a block of the page."""
    return not page.has_main and not all(b.dropped for b in page.blocks)


def chunk_windows(htmls: list[str | None], host: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of all runs on pages of one host, on how many of the pages they stand (2 for more), and whether a block depends on them."""
    parsed = [parse(h or "") for h in htmls]
    streams, sizes, number = streams_of(parsed)
    keys = window_keys(streams, number, host)
    needed = [np.empty(0, np.int64)]
    for page, size, k in zip(parsed, sizes, keys):
        if len(k) and undecided(page):
            open_words = np.cumsum([0, *np.repeat([not b.dropped for b in page.blocks], size)])
            needed.append(k[open_words[RUN:] > open_words[:-RUN]])
    found, n = np.unique(np.concatenate([np.empty(0, np.int64), *map(np.unique, keys)]), return_counts=True)
    return found, np.minimum(n, 2), np.isin(found, np.concatenate(needed))


@dataclass
class Main:
    """A page's main text, and its blocks that went by the array, went by structure and were restored."""

    text: str
    by_array: int = 0
    by_structure: int = 0
    restored: int = 0


def judged(page: Page, repeated: list[bool]) -> Main:
    """The array's verdict on each block, then the check by structure."""
    out, kept = Main(""), []
    for block, again in zip(page.blocks, repeated):
        article = block.main and not block.dropped
        if again and not article:
            out.by_array += 1
        elif not article and (block.dropped or page.has_main):
            out.by_structure += 1
        else:
            out.restored += again
            kept.append(block.text)
    out.text = "\n\n".join(kept)
    return out


def judge(htmls: list[str | None], host: str = "", shared: np.ndarray | None = None) -> list[Main]:
    """Main texts of pages of one host; ``shared`` has the keys of runs that stand on several pages of it, these or others."""
    parsed = [parse(h or "") for h in htmls]
    streams, sizes, number = streams_of(parsed)
    covers = covered_words(streams)
    if shared is not None and len(shared):
        for cover, keys in zip(covers, window_keys(streams, number, host)):
            hit = np.zeros(len(cover) + 1, np.int64)
            begin = np.flatnonzero(np.isin(keys, shared))
            np.add.at(hit, begin, 1)
            np.add.at(hit, begin + RUN, -1)
            cover |= np.cumsum(hit)[:-1] > 0
    out = []
    for page, size, covered in zip(parsed, sizes, covers):
        ends = np.cumsum([0, *size])
        words = np.concatenate([[0], np.cumsum(covered)])[ends]
        out.append(judged(page, [bool(c >= COVERED * n) for c, n in zip(np.diff(words), size)]))
    return out


def extract(htmls: list[str | None], host: str = "", shared: np.ndarray | None = None) -> list[str]:
    """The texts alone."""
    return [m.text for m in judge(htmls, host, shared)]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], np.ndarray | None]]:
    """Rows (page_id, url, html, host, salt, chunk, keys) of one host and salt, so many at a time, and the shared keys that lead the chunk."""
    held: list[tuple] = []
    chars, chunk, shared = 0, None, None
    for batch in batches:
        keys = batch.column(6)
        for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns[:6]))):
            size = len(row[2] or "")
            if held and (keys[i].is_valid or row[3:] != held[0][3:] or len(held) >= CHUNK_PAGES or chars + size > CHUNK_CHARS):
                yield held, shared if chunk == held[0][5] else None
                held, chars = [], 0
            if keys[i].is_valid:
                chunk, shared = row[5], np.sort(keys[i].values.to_numpy())
                continue
            held.append(row)
            chars += size
    if held:
        yield held, shared if chunk == held[0][5] else None


def few(hosts: DataFrame) -> DataFrame:
    """``hosts``, to be broadcast if there are at most HOT_HOSTS of them, so that pages needn't travel to be filtered."""
    names = hosts.select("host")
    return F.broadcast(names) if names.limit(HOT_HOSTS + 1).count() <= HOT_HOSTS else names


def shared_runs(dealt: DataFrame, rows: DataFrame, wide: DataFrame) -> DataFrame | None:
    """(chunk, keys): of each chunk of the hosts that take several, the runs its undecided blocks share with any page of the host.

    None if no such host has an undecided block. The runs of those hosts are counted by their hashes, each once a page.
    """

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = {h for h, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if undecided(parse(x or ""))}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["host"])

    open_hosts = cut(rows.join(few(wide), "host", "left_semi").select("host", "html").mapInArrow(hosts, "host string").distinct())
    if not open_hosts.limit(1).count():
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, _ in chunks(batches):
            keys, n, needed = chunk_windows([r[2] for r in held], held[0][3])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), held[0][5], np.int64)), pa.array(keys), pa.array(n), pa.array(needed)], names=["chunk", "key", "n", "needed"])

    counted = store(dealt(rows.join(few(open_hosts), "host", "left_semi"), None).mapInArrow(run, "chunk long, key long, n long, needed boolean"), "runs")
    several = counted.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")
    return counted.filter("needed").select("chunk", "key").join(several, "key").groupBy("chunk").agg(F.collect_set("key").alias("keys"))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars, and its blocks that went by_array, by_structure and were restored."""
    host, _ = split_url(F.col(url))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    sizes = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("chars"))
    wide = cut(sizes.select("host", F.ceil(F.greatest(F.col("n") / CHUNK_PAGES, F.coalesce("chars", F.lit(0)) / CHUNK_CHARS)).alias("salts")).filter("salts > 1"))
    salts = wide.orderBy(F.desc("salts"), "host").limit(HOT_HOSTS)
    total = rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))

    def dealt(some: DataFrame, shared: DataFrame | None) -> DataFrame:
        """Rows dealt by chunk, the shared keys of a chunk before its pages."""
        # At most HOT_HOSTS rows are broadcast; hosts beyond them are cut into chunks within their task.
        salted = some.join(F.broadcast(salts), "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.coalesce("salts", F.lit(1))))
        out = salted.select("page_id", "url", "html", "host", "salt", F.xxhash64("host", "salt").alias("chunk"), F.lit(None).cast("array<bigint>").alias("keys"))
        if shared is not None:
            out = out.unionByName(shared, allowMissingColumns=True)
        return out.repartition(int(parts), "chunk").sortWithinPartitions("chunk", F.col("keys").isNull(), "host", "salt", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, shared in chunks(batches):
            found = judge([r[2] for r in held], held[0][3], shared)
            counts = [pa.array([getattr(m, c) for m in found], pa.int64()) for c in ("by_array", "by_structure", "restored")]
            ids, urls = pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.string())
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array([m.text for m in found], pa.string()), pa.array([len(m.text) for m in found], pa.int64()), *counts], names=["page_id", "url", "text", "n_chars", "by_array", "by_structure", "restored"])

    return dealt(rows, shared_runs(dealt, rows, wide)).mapInArrow(run, "page_id long, url string, text string, n_chars long, by_array long, by_structure long, restored long")
