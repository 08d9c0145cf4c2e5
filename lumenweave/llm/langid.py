"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a linear classifier on hashed byte n-grams of the lower-cased text
predicts it (ridge regression, fitted together). A text gets the language of the nearest codeword, bits being
weighted by how well their classifiers do on the training sample and by the exponential loss of their outputs.
The score is how far the second codeword's loss lies above the best one's (0 at a tie, towards 1 as it grows), so
that it means the same for any number of languages; a text with a low score is ambiguous.
The training sample is bounded: about ``SAMPLE_PER_LANGUAGE`` distinct documents a language, fewer if the languages
are so many that all would be more than ``MOST_SAMPLED``, chosen by a hash of id and text; the features of these
(twice MOST_SAMPLED vectors of ``DIMENSIONS`` half-precision numbers at most, 50 MB) come to the driver.

Defined results: a null text or one without a letter is ``und`` with score 0 and ambiguous; a null doc_id counts as
an empty one in the split; without labelled documents every text is ``und``; with one language every text with
letters is of it; ties go to the language that sorts first; rows that repeat get one result each and are learned from
once; very long texts are read whole, ``TEXT_BYTES`` at a time; an empty table gives an empty table; columns other
than the id, the text and, in training, the language are not read and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.llm.shared import slices

#: Hashed n-grams of these lengths in bytes, their number, the bound of the sample, the ridge, bytes held at a time.
GRAMS, DIMENSIONS, SAMPLE_PER_LANGUAGE, RIDGE, TEXT_BYTES = (1, 2, 3), 2048, 600, 1e-3, 1 << 20
#: Documents of all languages that the sample aims for at most.
MOST_SAMPLED = 6000
#: A prediction whose score is below this is flagged as ambiguous.
AMBIGUOUS = 0.4
#: How sharply the margin between two losses turns into a score.
SHARPNESS = 4.0

_SPACED = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed n-grams of the text's letters, scaled to length 1 by construction."""
    data = text.lower().encode("utf-8", "surrogatepass").translate(_SPACED)
    counts = np.zeros(DIMENSIONS, np.int64)
    shift = np.uint32(32 - (DIMENSIONS - 1).bit_length())
    for at in range(0, len(data), TEXT_BYTES):
        a = np.frombuffer(data[at : at + TEXT_BYTES + max(GRAMS) - 1], np.uint8).astype(np.uint32)
        for n in GRAMS:
            windows = min(TEXT_BYTES, len(a) - n + 1)
            if windows <= 0:
                continue
            h = np.full(windows, n * 40503, np.uint32)
            for k in range(n):
                h = (h ^ a[k : k + windows]) * _MULTIPLIERS[k]
                h ^= h >> np.uint32(15)
            counts += np.bincount(h >> shift, minlength=DIMENSIONS)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def codewords(k: int) -> np.ndarray:
    """A codeword (a row of +1 and -1) for each of k languages: all different splits for few, random ones for many."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 7:
        splits = [[1 if i == 0 or not s >> (i - 1) & 1 else -1 for i in range(k)] for s in range(1, 1 << (k - 1))]
        return np.array(splits, float).T
    bits = int(np.ceil(10 * np.log2(k)))
    rng = np.random.default_rng(k)
    while True:
        code = rng.choice([-1.0, 1.0], (k, bits))
        if len(np.unique(code, axis=0)) == k and (np.abs(code.sum(0)) < k).all():
            return code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of features the language's number and the score."""
        out = np.clip(x @ self.weights + self.bias, -3, 3)
        loss = (np.exp(-out[:, None, :] * self.code[None]) * self.trust).sum(2)
        best = loss.argmin(1)
        if loss.shape[1] < 2:
            return best, np.ones(len(loss))
        least = np.partition(loss, 1, axis=1)
        return best, 1 - np.exp(-SHARPNESS * (least[:, 1] - least[:, 0]))


def fit(labels: list[str], x: np.ndarray) -> Model:
    languages = sorted(set(labels))
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((DIMENSIONS, 1)), np.ones(1), np.ones(1))
    at = {lang: i for i, lang in enumerate(languages)}
    row = np.array([at[lang] for lang in labels])
    y = code[row]
    # Each language weighs the same, however many documents the sample has of it.
    w = (1 / np.bincount(row))[row][:, None] / len(languages)
    mean, target = (w * x).sum(0), (w * y).sum(0)
    xc, yc = x - mean, y - target
    weights = np.linalg.solve((xc * w).T @ xc + RIDGE * np.eye(x.shape[1]), (xc * w).T @ yc)
    bias = target - mean @ weights
    right = (w * ((x @ weights + bias) * y > 0)).sum(0)
    trust = np.log((right + 1e-3) / (1 - right + 1e-3)).clip(1e-3)
    return Model(languages, code, weights.astype(np.float32), bias.astype(np.float32), trust / trust.sum())


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """A model of the labelled documents that aren't held out; None if there are none."""
    learned = docs.filter(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = dict(learned.groupBy(lang).count().collect())
    if not counts:
        return None
    each = max(1, min(sample, MOST_SAMPLED // len(counts)))
    bar = F.lit(0)
    for name, n in counts.items():
        bar = F.when(F.col(lang) == name, min(1 << 30, -(-(each << 30) // n))).otherwise(bar)
    place = F.pmod(F.xxhash64(F.col(doc_id), F.xxhash64(F.col(text))), F.lit(1 << 30))
    labelled = learned.select(F.col(lang).alias("lang"), place.alias("h"), F.col(text).alias("text"), bar.alias("bar"))
    rows = sampled(labelled.filter("h < bar"), 2 * each * len(counts))
    if missing := counts.keys() - {r.lang for r in rows}:
        # Copies of few documents can all miss the sample; then the first by the hash are taken.
        rows += sampled(labelled.filter(F.col("lang").isin(sorted(missing))), each * len(missing))
    rows.sort(key=lambda r: (r.lang, bytes(r.x)))
    return fit([r.lang for r in rows], np.stack([np.frombuffer(r.x, np.float16).astype(np.float32) for r in rows]))


def sampled(labelled: DataFrame, most: int) -> list:
    """(lang, h, x) of the distinct documents among (lang, h, text), the ``most`` first by h; x are the features in half precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = pa.array([features(t).astype(np.float16).tobytes() for t in part.column(2).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), x], names=["lang", "h", "x"])

    distinct = labelled.groupBy("lang", "h").agg(F.min("text").alias("text"))
    return distinct.mapInArrow(run, "lang string, h long, x binary").orderBy("h", "lang").limit(most).collect()


def identify(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    rows = [i for i, t in enumerate(texts) if model is not None and t and any(map(str.isalpha, t))]
    for at in range(0, len(rows), 512):
        some = rows[at : at + 512]
        best, score = model.decide(np.stack([features(texts[i]) for i in some]))
        for i, b, s in zip(some, best, score):
            langs[i], scores[i] = model.languages[b], float(s)
    return langs, scores


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score, ambiguous."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                langs, scores = identify(model, part.column(2).to_pylist())
                flags = pa.array([s < AMBIGUOUS for s in scores], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), flags], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose language is found without ambiguity, columns as they are."""
    model, at = train(docs, doc_id, text, lang), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, scores = identify(model, part.column(at).to_pylist())
                yield part.filter(pa.array([s >= AMBIGUOUS for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
