"""Sharding by a minimax contiguous partition, in DataFrame functions only.

Documents with equal texts form a group that no cut may split, and groups are ordered by the 64-bit hash of their
text. Their sizes are gathered into runs by the hash's leading ``BUCKET_BITS`` bits; only sizes of runs (at most
``MOST_RUNS`` at a time, at every size of the corpus) reach the driver. There the smallest feasible capacity of a shard
is found by bisection, each capacity checked greedily. Runs that a cut of any such capacity may fall into are then
opened, their groups gathered by more bits, and the search repeated, until every such run is one group: the capacity
is that of the groups themselves.
Where a single run sets the capacity it gets a shard of its own, and the runs on its two sides are cut anew.

Defined results: a null text counts as an empty one (size 1) and shares its group; rows that repeat share a
shard and take slots of their own; ties in a slot's order are rows equal in all that is returned; very long texts are
only measured and hashed; an empty table gives an empty table; columns other than the id and the text are not read and
may have any names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.llm.shared import numbered, numbers, utf8

#: Leading bits of the text's hash that name a run of groups, and the most runs that are gathered at a time.
BUCKET_BITS, MOST_RUNS = 16, 1 << 16


def cuts_for(capacity: int, ends: np.ndarray, shards: int) -> np.ndarray | None:
    """Greedy cuts (number of runs before each shard's end) at this capacity, or None if ``shards`` don't suffice."""
    cuts, before = [], 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, before + capacity, side="right"))
        cuts.append(at)
        if at == len(ends):
            return np.array(cuts + [at] * (shards - len(cuts)))
        if ends[at] - before > capacity and (at == 0 or ends[at - 1] <= before):
            return None
        before = int(ends[at - 1])
    return None


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, np.ndarray]:
    """The smallest capacity for which ordered ``sizes`` fit into ``shards`` contiguous shards, and its cuts."""
    if len(sizes) == 0:
        return 0, np.zeros(shards, dtype=np.int64)
    ends = np.cumsum(sizes, dtype=np.int64)
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        mid = (low + high) // 2
        if cuts_for(mid, ends, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low, cuts_for(low, ends, shards)


def even_cuts(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Cuts of the smallest capacity, and where one run alone sets it, the runs before and after it cut the same way over the other shards."""
    if len(sizes) == 0 or shards < 2:
        return minimax_cuts(sizes, shards)[1]
    capacity, cuts = minimax_cuts(sizes, shards)
    k = int(sizes.argmax())
    if sizes[k] < capacity or capacity * shards <= sizes.sum():
        return cuts
    before, after = sizes[:k], sizes[k + 1 :]
    if not before.sum() or not after.sum():
        left = shards - 1 if before.sum() else 0
    else:
        # The split of the other shards with the least capacity on both sides; a side with runs gets one at least.
        low, high = 1, shards - 2
        if high < low:
            return cuts
        while low < high:
            mid = (low + high) // 2
            if minimax_cuts(before, mid)[0] <= minimax_cuts(after, shards - 1 - mid)[0]:
                high = mid
            else:
                low = mid + 1
        left = min((x for x in (low - 1, low) if 1 <= x <= shards - 2), key=lambda x: max(minimax_cuts(before, x)[0], minimax_cuts(after, shards - 1 - x)[0]))
    parts = [even_cuts(before, left)] if left else []
    right = shards - 1 - left
    parts += [np.array([k + 1])] + ([k + 1 + even_cuts(after, right)] if right else [])
    out = np.concatenate(parts)
    return np.where(np.arange(shards) == shards - 1, len(sizes), out)


def bucket(h: Column, bits: int) -> Column:
    return F.shiftright(h, 64 - bits)


def gathered(placed: DataFrame, bits: int) -> np.ndarray:
    """Of each run of groups whose hashes share their leading bits: its least possible hash, its size and rows, whether it is one group, the bits."""
    runs = placed.groupBy(bucket(F.col("h"), bits).alias("b")).agg(F.sum("size"), F.count("*"), F.min("h") == F.max("h")).orderBy("b").collect()
    return np.array([(r[0] << (64 - bits), *r[1:], bits) for r in runs], dtype=np.int64).reshape(-1, 5)


def open_runs(runs: np.ndarray, shards: int) -> np.ndarray:
    """Which runs of several groups to open next: those a cut may fall into, for any capacity up to the smallest of these runs.

    They are a few hundred unless a run exceeds a fair share by far; then only large ones, at most 64 a shard, are opened.
    """
    size, one = runs[:, 1], runs[:, 3] > 0
    capacity, _ = minimax_cuts(size, shards)
    ends, total = np.cumsum(size), int(size.sum())
    found = np.zeros(len(runs), bool)
    if capacity > max([-(-total // shards), *size[one].tolist()]):
        for s in range(1, shards):
            # What precedes cut s fits into s shards, what follows into the others.
            found |= (ends > total - (shards - s) * capacity) & (ends - size < s * capacity)
    found &= ~one & (runs[:, 4] < 64)
    if found.sum() * 8 > MOST_RUNS:
        found &= size * 64 * shards > total
    return found & (runs[:, 4] == runs[found, 4].min(initial=64))


def atoms(placed: DataFrame, shards: int) -> np.ndarray:
    """Runs as ``gathered``, opened until the smallest capacity is that of the groups."""
    runs = gathered(placed, BUCKET_BITS)
    while len(runs) and (found := open_runs(runs, shards)).any():
        bits = int(runs[found, 4][0])
        more = min(64 - bits, max(1, (MOST_RUNS // int(found.sum())).bit_length() - 1))
        names = [int(x) for x in runs[found, 0] >> (64 - bits)]
        finer = gathered(placed.filter(bucket(F.col("h"), bits).isin(names)), bits + more)
        runs = np.concatenate([runs[~found], finer])
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
    return runs


def assign(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    t = utf8(F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"), F.xxhash64(t).alias("h"))
    # Numbered in the order of (hash, id), so that a large group of equal texts spreads over many tasks.
    placed = numbered(rows, "h", "doc_id", "text_crc32", "size")
    runs = atoms(placed, shards)
    cuts = even_cuts(runs[:, 1], shards)
    ranks = np.concatenate([[0], np.cumsum(runs[:, 2])])
    # A shard begins at the first run after the cut before it; shards past the last run stay empty.
    starts = [0, *cuts[:-1].tolist()]
    shard = sum((F.when(F.col("h") >= F.lit(int(runs[s, 0])), 1).otherwise(0) for s in starts[1:] if s < len(runs)), F.lit(0)).cast("int")
    firsts = [int(ranks[s]) for s in starts]
    out = placed.withColumn("shard", shard).withColumn("slot", F.col("number") - F.get(numbers(firsts), F.col("shard")))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
