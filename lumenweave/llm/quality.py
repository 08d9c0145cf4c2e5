"""Quality rules as a short-circuit cascade.

A sample gives the seconds that each measure of a text takes and which rules reject which share of documents
together. Rules are then ordered greedily: next comes the one with most rejections, among the documents that those
before it let through, per second of what it has yet to measure (rules share measures such as the words). A document
stops at the first rule that rejects it. Rules are a conjunction, so their order changes the time and never the
verdict; since seconds differ from run to run, so may the order and with it ``rejected_by``.
The sample is drawn by a hash of the rows, about ``SAMPLE_ROWS`` of them from the whole table (as many from any one
task at most), and is measured in its tasks: only sums come to the driver.

Defined results: a null text counts as an empty one; a text without words fails ``min_words``; ties in the order go to
the rule that is listed first; rows that repeat are judged one by one (and sampled together or not at all); an empty
table gives an empty table; columns other than the id and the text are not read and may have any names; a text of over
``LONG`` bytes is read in stretches and its windows are compared by 64-bit hashes, in some 60 bytes a word. Words are runs of characters other
than space and U+0009 to U+000D.
"""

from __future__ import annotations

import re
import string
import time
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.llm.shared import slices

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Documents of the sample that sets the order of the rules, and bytes of a text from which its words are hashed.
SAMPLE_ROWS, LONG = 256, 4 << 20

ASCII = re.compile(r"[\x00-\x7f]+")
SPACE = re.compile(rb"[\x20\x09-\x0D]")


class Text:
    """A text whose measures are computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    def __getattr__(self, name: str):
        value = getattr(self, f"_{name}")()
        self.__dict__[name] = value
        return value

    def _data(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    def _words(self) -> list[bytes]:
        return self.data.split()

    def _hashes(self) -> np.ndarray:
        """64-bit hashes of the words, which are held a stretch at a time."""
        out, at, data = [], 0, self.data
        while at < len(data):
            end = SPACE.search(data, min(len(data), at + max(1, LONG)))
            end = end.start() if end else len(data)
            out.append(np.array([xxhash.xxh64_intdigest(w) for w in data[at:end].split()], np.uint64))
            at = end
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def _n_words(self) -> int:
        return len(self.words) if len(self.data) <= LONG else len(self.hashes)

    def _word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    def _n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    def _lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if line.strip(SPACES)]

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _n_repeat_words(self) -> int:
        if len(self.data) > LONG:
            return repeated_words(self.hashes)
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        first: dict[tuple, int] = {}
        covered = bytearray(len(w))
        for i, window in enumerate(windows):
            j = first.setdefault(window, i)
            if j != i:
                covered[i : i + 3] = covered[j : j + 3] = b"\1\1\1"
        return sum(covered)

    def _shouted(self) -> float:
        """The share of capital letters (category Lu) among these and small ones (Ll)."""
        ascii_, rest = self.data, () if self.text.isascii() else Counter(ASCII.sub("", self.text)).items()
        upper = len(ascii_) - len(ascii_.translate(None, string.ascii_uppercase.encode()))
        lower = len(ascii_) - len(ascii_.translate(None, string.ascii_lowercase.encode()))
        for c, n in rest:
            kind = unicodedata.category(c)
            upper, lower = upper + n * (kind == "Lu"), lower + n * (kind == "Ll")
        return upper / max(1, upper + lower)


def repeated_words(h: np.ndarray) -> int:
    """Words in windows of three that stand twice or more, by the words' hashes."""
    if len(h) < 4:
        return 0
    key = h[:-2] * np.uint64(0x9E3779B97F4A7C15)
    for part in (h[1:-1], h[2:]):
        key ^= key >> np.uint64(32)
        key += part
        key *= np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    again = np.zeros(len(key), bool)
    again[:-1] |= same
    again[1:] |= same
    covered = np.zeros(len(h), bool)
    at = order[again]
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]
    base: bool = False
    needs: tuple[str, ...] = ()


#: Thresholds are parameters of the rules and hold at every size of the corpus.
RULES = (
    Rule("min_words", lambda t: t.n_words < 50, True, ("n_words",)),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 50 * t.n_words, True, ("n_repeat_words", "n_words")),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words, False, ("n_symbols", "n_words")),
    Rule("duplicate_lines", lambda t: 2 * t.n_dup_lines > len(t.lines), False, ("n_dup_lines",)),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words, False, ("word_chars", "n_words")),
    Rule("shouting", lambda t: t.shouted > 0.5, False, ("shouted",)),
)

#: What each measure is made from, in an order in which they can be made.
SOURCES = {"data": (), "n_words": ("data",), "word_chars": (), "n_symbols": (), "lines": (), "n_dup_lines": ("lines",), "n_repeat_words": ("n_words",), "shouted": ("data",)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Sample:
    """Documents measured, seconds by measure and by rule (once its measures are there), documents by the set of rules that reject them (a bit a rule)."""

    n: int
    seconds: dict[str, float]
    rejected: dict[int, int]


def measure_texts(texts: list[str | None], rules: tuple[Rule, ...]) -> Sample:
    seconds, rejected = Counter(), Counter()
    for x in texts:
        t, mask = Text(x), 0
        for name in SOURCES:
            began = time.perf_counter()
            getattr(t, name)
            seconds[name] += time.perf_counter() - began
        for i, rule in enumerate(rules):
            began = time.perf_counter()
            mask |= bool(rule.rejects(t)) << i
            seconds[f"rule {rule.name}"] += time.perf_counter() - began
        rejected[mask] += 1
    return Sample(len(texts), dict(seconds), dict(rejected))


def measure_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> Sample:
    """The sample, drawn by a hash of id and text from the whole table and measured in its tasks, ``sample_rows`` rows in any one at most."""
    n = docs.count()
    bar = (1 << 32) if n <= sample_rows else -(-(sample_rows << 32) // n)
    chosen = docs.filter(F.pmod(F.xxhash64(F.col(doc_id), F.xxhash64(F.col(text))), F.lit(1 << 32)) < bar).select(F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in islice((t for b in batches for part in slices(b) for t in part.column(0).to_pylist()), sample_rows):
            s = measure_texts([t], rules)
            (mask,) = s.rejected
            yield pa.RecordBatch.from_pydict({"mask": pa.array([mask], pa.int64()), **{f"s{i}": [v] for i, v in enumerate(s.seconds.values())}})

    names = [*SOURCES, *(f"rule {r.name}" for r in rules)]
    measured = chosen.mapInArrow(run, "mask long, " + ", ".join(f"s{i} double" for i in range(len(names))))
    rows = measured.groupBy("mask").agg(F.count("*").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(names))]).collect()
    seconds = {name: sum(r[f"s{i}"] for r in rows) for i, name in enumerate(names)}
    return Sample(sum(r.n for r in rows), seconds, {r["mask"]: r.n for r in rows})


def order_by_sample(sample: Sample, rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Greedily by rejections, among documents not yet rejected, per second of what is not yet measured; ties keep the given order."""

    def made_from(names: tuple[str, ...]) -> set[str]:
        return {x for n in names for x in ({n} | made_from(SOURCES.get(n, ())))}

    left, made, passed, out = list(range(len(rules))), set(), dict(sample.rejected), []
    while left:

        def rate(i: int) -> float:
            hits = sum(n for mask, n in passed.items() if mask >> i & 1)
            cost = sum(sample.seconds.get(x, 0.0) for x in made_from(rules[i].needs) - made) + sample.seconds.get(f"rule {rules[i].name}", 0.0)
            return hits / max(cost, 1e-9)

        best = max(left, key=lambda i: (rate(i), -i))
        left.remove(best)
        out.append(rules[best])
        made |= made_from(rules[best].needs)
        passed = {mask: n for mask, n in passed.items() if not mask >> best & 1}
    return tuple(out)


def order_rules(measured: dict[str, tuple[float, float]], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Most rejections per cost first; ties keep the given order."""
    rate = {r.name: measured.get(r.name, (1.0, 0.0)) for r in rules}
    return tuple(sorted(rules, key=lambda r: -rate[r.name][1] / max(rate[r.name][0], 1e-9)))


def verdict(t: Text, ordered: tuple[Rule, ...]) -> str | None:
    """The name of the first rule that rejects the text."""
    return next((r.name for r in ordered if r.rejects(t)), None)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", measures: bool = True, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a document: its id, kept, rejected_by and, if asked for, base_failed and the measures."""
    ordered = order_by_sample(measure_rules(docs, doc_id, text, rules), rules)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: dict[str, list] = {"rejected_by": [], "kept": []} | ({m: [] for m in MEASURES} | {"base_failed": []} if measures else {})
        for x in batch.column(1).to_pylist():
            t = Text(x)
            said = verdict(t, ordered)
            rows["rejected_by"].append(said)
            rows["kept"].append(said is None)
            if measures:
                for m in MEASURES:
                    rows[m].append(getattr(t, m))
                rows["base_failed"].append(any(r.base and r.rejects(t) for r in rules))
        arrays = {"doc_id": batch.column(0)} | {k: pa.array(v, pa.bool_() if k in ("kept", "base_failed") else pa.string() if k == "rejected_by" else pa.int64()) for k, v in rows.items()}
        return pa.RecordBatch.from_pydict(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield one(part)

    schema = "doc_id long, rejected_by string, kept boolean" + (", " + ", ".join(f"{m} long" for m in MEASURES) + ", base_failed boolean" if measures else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id") -> DataFrame:
    """The rows that every rule passes, with their columns as they are."""
    ordered = order_by_sample(measure_rules(docs, doc_id, text, rules), rules)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([verdict(Text(x), ordered) is None for x in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
