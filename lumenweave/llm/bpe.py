"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can never be joined by a merge, so it marks a certain cut:
the fragments between such cuts are encoded on their own and their ids concatenated. The splitting pattern that
comes before the merges is respected: a text is first cut where one space or line feed stands between characters
that are not white space (before a space and on both sides of a line feed, where that pattern cuts too), each unit
by the pattern, and each of these at its forced boundaries. Ids of units are kept in a bounded table.

Defined results: a null text counts as an empty one, which has no ids; the special token's string in a text is its
one id; rows that repeat are encoded one by one; of two merges with equal rank (a tie) the leftmost comes first; very
long texts are encoded whole, one at a time, and a fragment of ``LONG_FRAGMENT`` bytes or more by a heap of its merges; an
empty table gives an empty table; columns other than the id and the text are not read and may have any names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.llm.shared import arrow_map

#: Units whose ids are kept, and the longest unit that is (in characters).
KEPT_UNITS, KEPT_CHARS = 600_000, 64
#: Bytes of a fragment from which merges are found through a heap.
LONG_FRAGMENT = 256

#: Marks that follow words; none is a letter, a digit, white space or an apostrophe.
MARKS = ".,;:!?#*$%&|"

#: The white space of the splitting pattern, and the pattern.
WHITE = "\\t-\\r \\x85\\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
SIMPLE_PATTERN = PATTERN.replace(f"|[{WHITE}]+(?![^{WHITE}])", "")


def byte_letters() -> dict[str, int]:
    """The letters that vocabulary files write for bytes: printable ones for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


def forced_boundaries(inside: set[bytes]) -> list[bytes]:
    """For each byte, a table of those that never follow it inside a token (1 where a boundary is forced)."""
    return [bytes(bytes([a, b]) not in inside for b in range(256)) for a in range(256)]


class _Units(dict):
    """Ids (little-endian unsigned 32-bit) of units, made when first asked for."""

    def __init__(self, make, before: str, marks: _Units | None = None):
        self.make, self.before, self.marks = make, before, self if marks is None else marks

    def __missing__(self, unit: str) -> bytes:
        stem = unit.rstrip(MARKS)
        if len(stem) < len(unit) and stem.isalpha():  # the pattern cuts between the letters and the marks
            ids = self[stem] + self.marks[unit[len(stem) :]]
        else:
            ids = self.make(self.before + unit)
        if len(unit) <= KEPT_CHARS:
            if len(self) >= KEPT_UNITS:
                self.clear()
            self[unit] = ids
        return ids


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in token): i for token, i in held["model"]["vocab"].items() if all(c in letters for c in token)}
        self.special = {t["content"]: t["id"] for t in held.get("added_tokens", [])}
        for content in self.special:
            vocab.pop(content.encode(), None)
        named = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.tokens = [named.get(i, b"") for i in range(max(named) + 1)]
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(held["model"]["merges"]):
            left, right = (bytes(letters[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        inside = {t[i : i + 2] for t in vocab for i in range(len(t) - 1)}
        self.forced = forced_boundaries(inside)
        self.pattern = regex.compile(PATTERN)
        # Where ids grow with the merges' ranks, the rank-file library's merges give the same ids, faster.
        made = [new for _, new in self.merges.values()]
        self.core = None
        if made == sorted(made):
            library = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=vocab, special_tokens={})._core_bpe
            full = library("full", PATTERN)
            self.core, self.whole, self.whole_simple = full.encode_single_piece, full.encode_ordinary, library("simple", SIMPLE_PATTERN).encode_ordinary
        self.bare = _Units(self._unit, "")
        self.after_space = _Units(self._unit, " ", self.bare)
        self.line_feed = self._unit("\n")
        self.cut_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    # --- encoding

    def fragments(self, piece: bytes) -> list[bytes]:
        """A stretch of the pattern, cut at its forced boundaries."""
        forced, cuts, row = self.forced, [], self.forced[piece[0]]
        for i, b in enumerate(piece):
            if i and row[b]:
                cuts.append(i)
            row = forced[b]
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)])] if cuts else [piece]

    def merged(self, fragment: bytes) -> list[int]:
        """Ids of a fragment: the lowest-ranked merge first, the leftmost of equals."""
        if self.core is not None and len(fragment) < LONG_FRAGMENT:
            return self.core(fragment)
        ids, merges = [self.byte_id[b] for b in fragment], self.merges
        if len(ids) >= LONG_FRAGMENT:
            return self._merged_long(ids)
        while len(ids) > 1:
            best = min(((m[0], i, m[1]) for i, pair in enumerate(zip(ids, ids[1:])) if (m := merges.get(pair))), default=None)
            if best is None:
                break
            ids[best[1] : best[1] + 2] = [best[2]]
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        merges, n = self.merges, len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [i for i in ids if i >= 0]

    def _unit(self, unit: str) -> bytes:
        """Ids of a unit: at most one space, then letters only, or whatever the pattern cuts."""
        if unit[1:].isalpha() and (unit[0] == " " or unit[0].isalpha()):
            found = self.fragments(unit.encode())
        else:
            found = [f for p in self.pattern.findall(unit) for f in self.fragments(p.encode("utf-8", "surrogatepass"))]
        if len(found) == 1:
            return array("I", self.merged(found[0])).tobytes()
        return array("I", chain.from_iterable(map(self.merged, found))).tobytes()

    def _plain(self, text: str) -> bytes:
        out = []
        if _WIDE.search(text) is None:
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                out.append(self.bare[first] + b"".join(map(self.after_space.__getitem__, rest)))
            return self.line_feed.join(out)
        first, *rest = _FLANKED.split(text)
        out.append(self.bare[first])
        for sep, unit in zip(rest[::2], rest[1::2]):
            out += [self.after_space[unit]] if sep == " " else [self.line_feed, self.bare[unit]]
        return b"".join(out)

    def _by_library(self, text: str) -> bytes:
        """As ``_plain``, all of it by the rank-file library. Without white-space runs the pattern needs no look ahead."""
        return array("I", (self.whole_simple if _WIDE.search(text) is None else self.whole)(text)).tobytes()

    def encode(self, text: str | None, by_library: bool = False) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        text = text or ""
        plain = self._by_library if by_library and self.core is not None else self._plain
        if self.cut_special is None or self.cut_special.search(text) is None:
            return plain(text)
        out, at = [], 0
        for m in self.cut_special.finditer(text):
            out += [plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, plain(text[at:])])

    # --- decoding

    def decode(self, ids: bytes) -> str:
        """The text of ids as ``encode`` gives them; ids that are not in the vocabulary give nothing."""
        known = np.frombuffer(ids, "<u4")
        known = known[known < len(self.tokens)]
        return b"".join(map(self.tokens.__getitem__, known.tolist())).decode("utf-8", "replace")


#: Two white-space characters in a row (by the wider of Python's and the pattern's notions); separators flanked by none.
_WIDE = re.compile(r"\s\s")
_FLANKED = re.compile(r"(?<=\S)( |\n)(?=\S)")


@cache
def load(path: str) -> ByteBPE:
    """One encoder a path and process."""
    return ByteBPE(path)


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id and its ids."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = load(path).encode
        ids = [np.frombuffer(encode(t), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """One row a row of (doc_id, ids): doc_id and text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        decode = load(path).decode
        texts = [decode(np.asarray(ids or [], "<u4").tobytes()) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens and the SHA-256 of its ids and of the text decoded from them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, n, ids_sha, text_sha = load(path), [], [], []
        for t in batch.column(1).to_pylist():
            ids = bpe.encode(t)
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
