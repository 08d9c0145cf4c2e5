"""SimHash near-duplicates by a binary trie self-join.

Distinct fingerprints are dealt to groups, and a group is a binary trie (a sorted array, a node being a range of it)
that is joined with itself: pairs of nodes go down together from the root, add up the bits in which they differ and
are dropped once these exceed the budget. Groups: fingerprints that differ in at most ``BUDGET`` of 64 bits agree in
one of BUDGET + 1 = 4 blocks of bits, so each is dealt to the four groups named by its blocks. Blocks are as wide as
makes groups of about ``GROUP`` fingerprints (a small corpus is one trie, blocks have 16 bits at most). A group of
more than ``MOST_IN_GROUP`` is dealt again by blocks of its remaining bits, until none is left or no four bits are,
which keeps the join exact and every group bounded. A task reads its groups in order and holds some at a time.
It returns no pairs but a forest of the links it found, so a dense group costs as many rows as it has members;
node pairs inside one found component are not descended any more. Components are the connected components of
the forests, by alternating large-star and small-star steps on the cluster.

Defined results: a null or wordless text has fingerprint zero; documents with equal fingerprints (repeated rows
too) share a component; rows that share a doc_id but not the text are documents of their own, linked only by their
fingerprints; rows without a doc_id get a fingerprint, link nothing and have no component_id; very long texts are
read in stretches of words; an empty table gives an empty table; columns other than the id and the text are not read
and may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.llm.shared import arrow_map, cut

#: Words in a shingle, seed of its hash, bits that linked fingerprints may differ in.
SHINGLE, SEED, BUDGET = 3, 42, 3
#: Fingerprints of a group to aim for, those above which it is dealt again and that a task holds at a time, node pairs that are held at a time.
GROUP, MOST_IN_GROUP, MOST_PAIRS = 4096, 200_000, 1 << 20
#: Pairs of fingerprints below two nodes from which they count as leaves, below the root.
LEAF_PAIRS = 16
#: Bytes of a text whose words are held at a time.
TEXT_BYTES = 4 << 20

LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
SPACE = re.compile(rb"[\x20\x09-\x0D]")


# --- fingerprints ------------------------------------------------------------------------------------------


def word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in stretches that overlap by SHINGLE - 1 words."""
    if len(data) <= TEXT_BYTES:
        yield data.split()
        return
    at, carried = 0, []
    while at < len(data):
        end = SPACE.search(data, min(len(data), at + TEXT_BYTES))
        end = end.start() if end else len(data)
        words = carried + data[at:end].split()
        at = end
        if len(words) >= SHINGLE or at >= len(data):
            yield words
            carried = words[1 - SHINGLE :]
        else:
            carried = words


def fingerprint(text: str | None) -> int:
    total, counts, only = 0, np.zeros(64, np.int64), []
    for words in word_blocks((text or "").encode("utf-8", "surrogatepass").translate(LOWER)):
        if len(words) < SHINGLE:
            only = words if not total else []
            continue
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        hashes = [xxhash.xxh64_intdigest(joined[s : e - 1], SEED) for s, e in zip([0, *ends], ends[SHINGLE - 1 :])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int32)
        total += len(hashes)
    if only and not total:
        return xxhash.xxh64_intdigest(b" ".join(only), SEED)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit number) and text_hash, which tells texts of one id apart."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), batch.column(2)], names=["doc_id", "fp", "text_hash"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    return arrow_map(rows, run, "doc_id long, fp long, text_hash long")


# --- the trie join of the groups in one partition ------------------------------------------------------------


class Forest:
    """Components of array positions; a label is the least position of its component."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._uniform()

    def _uniform(self) -> None:
        self.changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])]) if len(self.label) else np.zeros(1, np.int64)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the components of a[i] and b[i]."""
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                break
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(jump := label[label], label):
                label = jump
        self.label = label
        self._uniform()

    def joined(self, alo, ahi, blo, bhi) -> np.ndarray:
        """Whether all of both ranges are in one component already."""
        c, label = self.changes, self.label
        return (c[ahi - 1] == c[alo]) & (c[bhi - 1] == c[blo]) & (label[alo] == label[blo])


class Trie:
    """Sorted groups of fingerprints as binary tries; a node is a range of positions and its children meet at ``middle``."""

    def __init__(self, fp: np.ndarray):
        self.fp, self.descents = fp, 0
        self.ones: dict[int, np.ndarray] = {}

    def middle(self, depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where the fingerprints with a set bit at this depth begin in each node."""
        if depth not in self.ones:
            bit = (self.fp >> np.uint64(63 - depth)) & np.uint64(1)
            self.ones[depth] = np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)])
        ones = self.ones[depth]
        return hi - (ones[hi] - ones[lo])


def trie_forest(key: np.ndarray, fp: np.ndarray, budget: int = BUDGET, trie: Trie | None = None) -> np.ndarray:
    """Labels of ``fp`` (unsigned, sorted within sorted ``key``): linked positions of a group share their component's least."""
    n = len(fp)
    forest, trie = Forest(n), trie or Trie(fp)
    if n < 2:
        return forest.label
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.concatenate([starts[1:], [n]])
    i = np.flatnonzero((key[1:] == key[:-1]) & (np.bitwise_count(fp[1:] ^ fp[:-1]) <= budget))
    forest.link(i, i + 1)
    roots = ends - starts > 1
    zero = np.zeros(int(roots.sum()), np.int64)
    stack = [(0, starts[roots], ends[roots], starts[roots], ends[roots], zero)]
    while stack:
        depth, *pairs = stack.pop()
        if len(pairs[0]) > MOST_PAIRS // 8:
            half = len(pairs[0]) // 2
            stack += [(depth, *(x[half:] for x in pairs)), (depth, *(x[:half] for x in pairs))]
            continue
        alo, ahi, blo, bhi, diff = pairs
        keep = ~forest.joined(alo, ahi, blo, bhi)
        alo, ahi, blo, bhi, diff = (x[keep] for x in pairs)
        if depth:
            leaf = (ahi - alo) * (bhi - blo) <= LEAF_PAIRS if depth < 64 else np.ones(len(alo), bool)
            compare(forest, fp, alo[leaf], ahi[leaf], blo[leaf], bhi[leaf], budget)
            alo, ahi, blo, bhi, diff = (x[~leaf] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        trie.descents += len(alo)
        amid, bmid = trie.middle(depth, alo, ahi), trie.middle(depth, blo, bhi)
        same = (alo == blo) & (ahi == bhi)
        down = [
            (alo, amid, blo, bmid, diff, slice(None)),
            (amid, ahi, bmid, bhi, diff, slice(None)),
            (alo, amid, bmid, bhi, diff + 1, slice(None)),
            (amid, ahi, blo, bmid, diff + 1, ~same),
        ]
        nexts = [np.concatenate([x[k][x[5]] for x in down]) for k in range(5)]
        keep = (nexts[0] < nexts[1]) & (nexts[2] < nexts[3]) & (nexts[4] <= budget)
        keep &= ~((nexts[0] == nexts[2]) & (nexts[1] - nexts[0] == 1) & (nexts[3] - nexts[2] == 1))
        stack.append((depth + 1, *(x[keep] for x in nexts)))
    return forest.label


def compare(forest: Forest, fp: np.ndarray, alo, ahi, blo, bhi, budget: int) -> None:
    """Link the members of small node pairs that differ in few enough bits."""
    sizes = (ahi - alo) * (bhi - blo)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_PAIRS, side="right")))
        size = sizes[at:to]
        k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        width = np.repeat(bhi[at:to] - blo[at:to], size)
        a, b = np.repeat(alo[at:to], size) + k // width, np.repeat(blo[at:to], size) + k % width
        near = np.bitwise_count(fp[a] ^ fp[b]) <= budget
        forest.link(a[near], b[near])
        at = to


def stretches(batches: Iterator[pa.RecordBatch], most: int = MOST_IN_GROUP) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, fp, node) of whole groups, ``most`` rows at a time (one group at least), of batches sorted by key and fp."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        # Copies, so that no batch outlives its turn.
        key, fp, node = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("key", "fp", "node"))
        at = 0
        while at < len(key):
            room = max(0, most - size)
            # The first end of a group at which the stretch is full; a group that began in it belongs to it.
            turns = np.flatnonzero(key[at + 1 :] != key[at:-1]) + at + 1 if len(key) - at > 1 else np.empty(0, np.int64)
            if held and held[-1][0][-1] != key[at] and size >= most:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
                continue
            k = int(np.searchsorted(turns, at + room))
            to = int(turns[k]) if k < len(turns) else len(key)
            held.append((key[at:to], fp[at:to], node[at:to]))
            size += to - at
            at = to
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def forest_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp, node) rows of whole groups, sorted by key, to links (node, least node of its component here)."""
    for key, fp, node in stretches(batches):
        fp = fp.view(np.uint64)
        order = np.lexsort((fp, key))
        key, fp, node = key[order], fp[order], node[order]
        label = trie_forest(key, fp)
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, label, node)
        found = np.flatnonzero(node != least[label])
        for at in range(0, len(found), 1 << 16):
            some = found[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(least[label[some]])], names=["u", "v"])


# --- the join on the cluster ---------------------------------------------------------------------------------


def deal(rows: DataFrame, width: int, size: int) -> DataFrame:
    """Each row of (key, fp, node, rest) once for each of BUDGET + 1 blocks of ``size`` of the ``width`` bits in ``rest``, without them there."""
    blocks = []
    for i in range(BUDGET + 1):
        low = i * size
        value = F.shiftrightunsigned("rest", low).bitwiseAND((1 << size) - 1)
        high = F.shiftrightunsigned("rest", low + size) if low + size < 64 else F.lit(0).cast("long")
        rest = F.shiftleft(high, low).bitwiseOR(F.col("rest").bitwiseAND((1 << low) - 1))
        # Should two keys ever be hashed to one, their groups are one trie: no link is lost by it.
        blocks.append(F.struct(F.xxhash64("key", F.lit(width * 8 + i), value).alias("key"), rest.alias("rest")))
    return rows.select("fp", "node", F.explode(F.array(*blocks)).alias("b")).select(F.col("b.key").alias("key"), "fp", "node", F.col("b.rest").alias("rest"))


def first_block(n: int) -> int:
    """Bits of the first blocks of ``n`` fingerprints: 0 (one trie), or such that groups hold about GROUP of them."""
    return min(64 // (BUDGET + 1), max(0, (n - 1) // (2 * GROUP)).bit_length())


def link_forest(nodes: DataFrame, most_in_group: int = MOST_IN_GROUP) -> DataFrame:
    """Links (u, v), v the smaller, that connect what is linked among ``nodes`` (fp, node), both unique."""
    rows = nodes.select(F.lit(0).cast("long").alias("key"), "fp", "node", F.col("fp").alias("rest"))
    parts, width, size = [], 64, first_block(nodes.count())
    while True:
        if size:
            rows = cut(deal(rows, width, size))
            width -= size
        large = cut(rows.groupBy("key").count().filter(F.col("count") > most_in_group).select("key"))
        size = width // (BUDGET + 1)
        if not size or large.count() == 0:
            parts.append(rows)
            break
        parts.append(rows.join(large, "key", "left_anti"))
        rows = rows.join(large, "key", "left_semi")
    out = None
    for part in parts:
        links = part.select("key", "fp", "node").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(forest_of_partition, "u long, v long")
        out = links if out is None else out.unionByName(links)
    return cut(out.distinct())


def components(links: DataFrame) -> DataFrame:
    """(u, v) for each node u that is linked to a smaller one, v the least of its component: alternating star steps."""
    edges, before = links, None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = cut(both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))
        edges = cut(least.select("u", F.col("m").alias("v")).union(small).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges
        before = now


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, fp, text_hash, component_id and root, which names the component."""
    fps = cut(fingerprints(docs, doc_id, text))
    ids = cut(fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")))
    if ids.groupBy("id").count().filter("count > 1").limit(1).count():
        # One id has several texts, so fingerprints name the nodes, and a component's least id is looked up after.
        roots = components(link_forest(ids.select("fp", F.col("fp").alias("node"))))
        rooted = cut(ids.join(roots, ids["fp"] == roots["u"], "left").select("fp", "id", F.coalesce("v", "fp").alias("root")))
        named = cut(rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("fp", "component_id", "root"))
    else:
        roots = components(link_forest(ids.withColumnRenamed("id", "node")))
        least = F.coalesce("v", "id")
        named = cut(ids.join(roots, ids["id"] == roots["u"], "left").select("fp", least.alias("component_id"), least.alias("root")))
    out = fps.join(named, "fp", "left")
    return out.select("doc_id", "fp", "text_hash", *[F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("component_id", "root")])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, fp (signed), component_id."""
    return grouped(docs, doc_id, text).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, columns as they are: the one of the least id, if several texts have
    it the one of the least fingerprint, and any one of the rows that are equal in id and text. Rows without an id stay."""
    found = cut(grouped(docs, doc_id, text).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("id"), "fp", "text_hash", "root"))
    rest = docs.filter(F.col(doc_id).isNull())
    if not found.groupBy("id").count().filter("count > 1").limit(1).count():
        return docs.join(found, docs[doc_id] == found["id"], "left_semi").unionByName(rest)
    one = found.groupBy("root").agg(F.min(F.struct("fp", "text_hash", "id")).alias("one")).select("one.id", "one.text_hash")
    name = "h"
    while name in docs.columns:
        name += "h"
    hashed = docs.withColumn(name, F.xxhash64(F.col(text)))
    kept = hashed.join(one, (hashed[doc_id] == one["id"]) & (hashed[name] == one["text_hash"]), "left_semi")
    return kept.dropDuplicates([doc_id, name]).drop(name).unionByName(rest)
