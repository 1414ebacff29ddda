"""Language identification: sparse multinomial logistic regression over TF-IDF character n-grams.

Features are the runs of one to three characters of the lower-cased text, where anything but a letter
counts as a space and runs of spaces as one, hashed to 2 ** 15 slots; their weight is (1 + log count) * idf, scaled to
length one. Document frequencies cover every training row. The weights come from follow-the-regularised-
leader with an L1 and an L2 penalty over a bounded sample: ``PER_LANGUAGE`` rows of each language (of the
``sampling.MOST_LABELS`` most frequent, ``sampling.MOST_ROWS`` in all), a fifth of which is kept back to calibrate the
temperature of the softmax.

A null text, and one without letters, is ``und`` with score 0; so is everything if there is nothing to learn
from. Rows are independent, other columns are ignored, a null doc_id is in no fold but the training one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import frugal, rows
from scorelake.llm.sampling import bounded_sample, document_frequencies, held_out
from scorelake.llm.words import mix, stream

SLOTS = 1 << 15
PER_LANGUAGE = 800
UNKNOWN = "und"
_KEYS = stream(201, 3) | np.uint64(1)
_STEP = 1 << 18  # characters handled at a time


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _letters() -> np.ndarray:
    """Code point -> itself for letters, a space for the rest; beyond the table a sign stays as it is."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x3000)], np.uint32)


_TABLE = _letters()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of a text's n-grams."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(codes < len(_TABLE), _TABLE[np.minimum(codes, len(_TABLE) - 1)], codes)
    codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))] if len(codes) else codes
    total = np.zeros(SLOTS, np.int64)
    for at in range(0, len(codes), _STEP):
        part = codes[at:at + _STEP + 2].astype(np.uint64)
        for n in (1, 2, 3):
            last = min(_STEP, len(part) - n + 1)
            if last > 0:
                grams = part[:last] * _KEYS[0] + np.uint64(n)
                for k in range(1, n):
                    grams = grams + part[k:k + last] * _KEYS[k]
                total += np.bincount((mix(grams) >> np.uint64(49)).astype(np.int64), minlength=SLOTS)
    slots = np.flatnonzero(total)
    return slots, total[slots]


def all_features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [features(t) for t in texts]


def weigh(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[slots]
    return (x / max(float(np.sqrt(x @ x)), 1e-12)).astype(np.float32)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """FTRL-proximal: per-coordinate sums z and n; a weight is zero while |z| stays within the L1 penalty."""
    z, n = np.zeros((SLOTS, classes)), np.zeros((SLOTS, classes))

    def weights(slots) -> np.ndarray:
        lead = z[slots]
        return np.where(np.abs(lead) <= l1, 0.0, -(lead - np.sign(lead) * l1) / ((beta + np.sqrt(n[slots])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(samples)):
            slots, x, label = samples[i]
            w = weights(slots)
            error = softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / alpha
            z[slots] += g - sigma * w
            n[slots] += g * g
    return weights(slice(None)).astype(np.float32)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least negative log-likelihood, by golden section over its log."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    lo, hi, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.languages, self.idf, self.weights, self.heat = languages, idf.astype(np.float32), weights, heat

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        slots, counts = features(text)
        chances = softmax(weigh(slots, counts, self.idf) @ self.weights[slots] / self.heat)
        best = int(chances.argmax())
        return self.languages[best], float(chances[best])


_SAMPLE = pa.schema([("lang", pa.string()), ("slots", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = all_features(batch.column(1).to_pylist())
        yield rows(_SAMPLE, batch.column(0), [f[0] for f in found], [f[1] for f in found])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) with a text and a language outside the
    held-out fold."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    frequency, n = document_frequencies(known.select("text"), all_features, SLOTS)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    sample = bounded_sample(known, "lang", per_language).orderBy(F.xxhash64("doc_id", "text", F.lit("order")), "doc_id", "text").select("lang", "text")
    table = sample.mapInArrow(frugal(_sampled), "lang string, slots array<int>, counts array<int>").toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    number = {x: i for i, x in enumerate(languages)}
    ready = [(np.array(s), weigh(np.array(s), np.array(c), idf), number[x]) for x, s, c in zip(*(table.column(k).to_pylist() for k in range(3)), strict=True) if s]
    back = [r for i, r in enumerate(ready) if i % 5 == 4]
    weights = follow_the_leader([r for i, r in enumerate(ready) if i % 5 != 4], len(languages))
    logits = np.array([x @ weights[s] for s, x, _ in back]).reshape(len(back), len(languages))
    return Model(languages, idf, weights, temperature(logits, np.array([y for *_, y in back], np.int64)))


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predicts(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            yield rows(_PREDICTED, batch.column(0), [f[0] for f in found], [f[1] for f in found])

    return predict


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row, from its text alone."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(frugal(_predicts(model)), "doc_id long, lang_pred string, score double")


def confident(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is known with a score of ``least``;
    all rows when the model had nothing to learn from, as it can tell none apart."""
    if not model.languages:
        return docs
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(frugal(keep), docs.schema)
