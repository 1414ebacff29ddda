"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are the shapes of its words and pairs of shapes (runs of capitals, small letters, digits and
each punctuation sign), how often a word or a run of three words comes again, and pairs of characters,
hashed to ``TERMS`` slots. Term counts are damped by a logarithm and weighted by the inverse document
frequency over all documents, and projected to ``DIMS`` latent axes: the leading right singular vectors of
the labelled sample. The sample's vectors and labels, at most 2 * ``PER_LABEL`` rows, are broadcast; every
document meets all of them in blocked exact cosine products, and its ``NEIGHBOURS`` nearest vote with
their label weighted by a power of the similarity.

Null and empty texts have no terms; they get the vote of the prior, like texts without any similar labelled row.
A doc_id that several rows of documents share gives the
sample one text, the one with the least hash; each of its rows gets a score. Rows are independent, labels of one document that contradict each other count as the lower one, other
columns are ignored. Without labelled rows every score is 0.5."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import frugal, rows
from scorelake.llm.sampling import bounded_sample, document_frequencies, held_out
from scorelake.llm.words import mix, stream, windows, word_hashes

HALF = 1 << 12
TERMS = 2 * HALF
DIMS, NEIGHBOURS, PER_LABEL = 64, 25, 1500
SHARP = 8  # power of the similarity
BLOCK = 256  # documents in one product
_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 65, 97, 97, 48
_PAIR = stream(301, 1)[0] | np.uint64(1)
_MARK = (mix(stream(302, 64)) >> np.uint64(52)).astype(np.int64)
_STEP = 1 << 20


def features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots and counts of each text's terms: word shapes and repeats in the first half, characters in the second."""
    data = [(t or "").encode() for t in texts]
    kinds = [_KIND[np.frombuffer(d, np.uint8)] for d in data]
    shapes = word_hashes([k[np.append(True, k[1:] != k[:-1])[:len(k)]].tobytes() for k in kinds])
    words = word_hashes([d.lower() for d in data])
    return [_counted(*one) for one in zip(data, shapes, words, strict=True)]


def _counted(data: bytes, shapes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(TERMS, np.int64)
    both = np.concatenate([shapes, windows(shapes, 2)])
    total[:HALF] = np.bincount((mix(both) >> np.uint64(52)).astype(np.int64), minlength=HALF)
    n, runs = max(1, len(words)), windows(words, 3)
    again = [int((words[1:] == words[:-1]).sum()) / n]
    for hashes in (words, runs):
        order = np.sort(hashes)
        again.append(int((order[1:] == order[:-1]).sum()) / max(1, len(hashes)))
    for k, share in enumerate(again):  # one term for each tenth that the share reaches
        total[_MARK[16 * k:16 * k + int(10 * share + 0.5)]] += n
    for at in range(0, len(data) - 1, _STEP):
        part = np.frombuffer(data[at:at + _STEP + 1], np.uint8).astype(np.uint64)
        pairs = (part[:-1] << np.uint64(8) | part[1:]) * _PAIR
        total[HALF:] += np.bincount((pairs >> np.uint64(52)).astype(np.int64), minlength=HALF)
    slots = np.flatnonzero(total)
    return slots, total[slots]


def weigh(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped, weighted, and each half scaled to its share of length one."""
    x = (1 + np.log(counts)) * idf[slots]
    for half, share in ((slots < HALF, 0.8), (slots >= HALF, 0.6)):
        x[half] *= share / max(float(np.sqrt(x[half] @ x[half])), 1e-12)
    return x.astype(np.float32)


class Model:
    def __init__(self, idf: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.idf, self.axes, self.vectors, self.labels = idf.astype(np.float32), axes, vectors, labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def latent(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.axes.shape[1]), np.float32)
        for i, (slots, counts) in enumerate(features(texts)):
            if len(slots):
                out[i] = weigh(slots, counts, self.idf) @ self.axes[slots]
        return unit(out)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        near = self.latent(texts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** SHARP
        votes = (weight * self.labels[top]).sum(axis=1)
        return (votes + 1e-3 * self.prior) / (weight.sum(axis=1) + 1e-3)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def principal_axes(table: np.ndarray, dims: int, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors, a column each, by subspace iteration from a fixed start."""
    width = min(dims + 16, *table.shape)
    basis = np.random.default_rng(11).standard_normal((table.shape[1], width)).astype(np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(table.T @ (table @ basis))[0]
    _, _, turn = np.linalg.svd(table @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ turn.T)[:, :dims])


_SAMPLE = pa.schema([("label", pa.int32()), ("slots", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = features(batch.column(1).to_pylist())
        yield rows(_SAMPLE, batch.column(0), [f[0] for f in found], [f[1] for f in found])


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Learn from the labelled rows outside the held-out fold; document frequencies cover all of ``docs``."""
    frequency, n = document_frequencies(docs.select(F.col("text").cast("string")), features, TERMS)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    chosen = bounded_sample(known, "label", per_label).select("doc_id", "label")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most per_label ids of each label
    least = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    texts = texts.groupBy("doc_id", "label").agg(least)  # one text an id, so at most per_label rows of each label
    ordered = texts.orderBy(F.xxhash64("doc_id", F.lit("order")), "doc_id", "text").select("label", "text")
    table = ordered.mapInArrow(frugal(_sampled), "label int, slots array<int>, counts array<int>").toArrow()
    dense = np.zeros((len(table), TERMS), np.float32)
    for i, (slots, counts) in enumerate(zip(table.column("slots").to_pylist(), table.column("counts").to_pylist(), strict=True)):
        if slots:
            dense[i, slots] = weigh(np.array(slots), np.array(counts), idf)
    if not len(dense):
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    axes = principal_axes(dense, DIMS)
    return Model(idf, axes, unit(dense @ axes), table.column("label").to_numpy())


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _scores(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                yield rows(_SCORED, part.column(0), model.scores(part.column(1).to_pylist()))

    return score


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row, from its text alone."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(frugal(_scores(model)), "doc_id long, score double")
