"""Packing documents into sequences, shortest pack first over the length histogram.

Each document's ids, with an end id after them, are cut into pieces of the sequence length and one rest. The
histogram of piece lengths (at most ``length`` numbers) is packed on the driver: lengths go longest first, each into
the shortest open packs, whose patterns and counts are updated; where even the shortest has no room new packs open and fill up.
Patterns are joined back by rank: the r-th piece of a length takes the r-th place that the patterns have for it.

Defined results: a null text counts as an empty one and gives the end id alone; rows that repeat are packed one by
one; ties in rank are pieces equal in all that is returned; very long texts are encoded whole, one at a time, and give
as many pieces as they need; an empty table gives an empty table; columns other than the id and the text are not read and
may have any names.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.llm import bpe
from lumenweave.llm.shared import cut, numbered, slices

#: Tokens of a sequence, and the id after each document.
LENGTH, END_ID = 2048, 1


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.load(path).encode
        for batch in batches:
            for part in slices(batch):
                rows = []
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(t, by_library=True) + end
                    n = len(ids) // 4
                    rows += [(d, s, min(length, n - s), zlib.crc32(ids[4 * s : 4 * (s + length)]), n) for s in range(0, n, length)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_histogram(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (count, lengths) that hold ``counts[n]`` pieces of each length n."""
    open_packs: list[tuple[int, int, int, tuple[int, ...]]] = []  # used, order, count, lengths: a heap
    order = 0
    for n in sorted((n for n, c in counts.items() if c), reverse=True):
        if not 0 < n <= length:
            raise ValueError(f"a piece of {n} tokens does not fit {length}")
        left, grown = counts[n], []
        while left:
            if not open_packs or open_packs[0][0] + n > length:
                # Each new pack is the only one with room until it is full.
                each = length // n
                grown += [(n * k, c, (n,) * k) for c, k in ((left // each, each), (1, left % each)) if c and k]
                break
            used, _, count, lengths = heapq.heappop(open_packs)
            take = min(count, left)
            left -= take
            if take < count:
                order += 1
                heapq.heappush(open_packs, (used, order, count - take, lengths))
            # A pack that just grew may still be the shortest, so it goes back at once.
            order += 1
            heapq.heappush(open_packs, (used + n, order, take, (*lengths, n)))
        for used, count, lengths in grown:
            order += 1
            heapq.heappush(open_packs, (used, order, count, lengths))
    return [(count, lengths) for _, _, count, lengths in sorted(open_packs, key=lambda p: p[1])]


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Runs of places: the r-th piece of ``length`` from rank ``first`` on lies in sequence ``sequence`` + r - first at ``offset``."""
    runs, sequence, ranks = [], 0, {}
    for count, lengths in patterns:
        offset = 0
        for n in lengths:
            runs.append((n, ranks.get(n, 0), sequence, offset))
            ranks[n] = ranks.get(n, 0) + count
            offset += n
        sequence += count
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "sequence", "offset"), table.T))


def pack(cut_pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset."""
    histogram = {r[0]: r[1] for r in cut_pieces.groupBy("length").count().collect()}
    if not histogram:
        return cut_pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    runs = places(pack_histogram(histogram, length))
    # A piece's rank among those of its length: its number in the order by length less the first of that length.
    ranked = numbered(cut_pieces, "length", "doc_id", "start", "ids_crc32", "doc_tokens")
    firsts, total = np.zeros(length + 1, np.int64), 0
    for n in sorted(histogram):
        firsts[n] = total
        total += histogram[n]
    span = np.int64(1) << 40
    keys = runs["length"] * span + runs["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("length").to_numpy()
            rank = batch.column("number").to_numpy() - firsts[n]
            at = np.searchsorted(keys, n * span + rank, side="right") - 1
            found = [pa.array(runs["sequence"][at] + rank - runs["first"][at]), pa.array(runs["offset"][at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *found], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return ranked.select(*names, "number").mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "sequence_id", "offset"]))


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(cut(pieces(docs, path, length, end_id, doc_id, text)), length)
