"""What the two classifiers share: the fold of a document, bounded training samples, and feature counts
over whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import frugal, materialise, rows


PART = 256  # texts handled at a time
MOST_LABELS = 256  # labels that a classifier learns
MOST_ROWS = 100_000  # rows of a training sample


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id, as text, leaves 2 on division by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def bounded_sample(labelled: DataFrame, label: str, per_label: int, most_labels: int = MOST_LABELS, most_rows: int = MOST_ROWS) -> DataFrame:
    """At most ``per_label`` rows of each of the ``most_labels`` most frequent labels (ties: the smaller label), and
    at most ``most_rows`` in all, shared out evenly. Rows of a label are taken by the least hash of their other
    columns. A first cut by the hash, where the rows lie, leaves about twice as many of a frequent label as are
    wanted, so only these are shuffled and no window sees more. The counts of the labels taken are broadcast."""
    tally = labelled.groupBy(label).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), label).limit(most_labels)
    tally = materialise(tally)
    some = min(per_label, max(1, most_rows // max(1, tally.count())))
    others = [F.col(f"`{c}`") for c in labelled.columns if c != label]
    place = F.shiftrightunsigned(F.xxhash64(*others, F.lit("sample")), 11) / F.lit(float(1 << 53))
    near = labelled.join(F.broadcast(tally), label).withColumn("__place", place).where(F.col("__place") * F.col("__n") <= 2.0 * some + 64)
    order = Window.partitionBy(label).orderBy("__place", *others)
    return near.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= some).drop("__rank", "__place", "__n")


_COUNTS = pa.schema([("feature", pa.int32()), ("n", pa.int64())])


def document_frequencies(texts: DataFrame, features, size: int) -> tuple[np.ndarray, int]:
    """For each of ``size`` features (``features`` gives slots and counts of each text of a list) how many rows of ``texts`` (one column) have it, and the number of
    rows. Each task sums its rows; at most ``size`` + 1 sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for at in range(0, len(batch), PART):
                for slots, _ in features(batch.column(0).slice(at, PART).to_pylist()):
                    total[slots] += 1
            n += len(batch)
        seen = np.flatnonzero(total)
        yield rows(_COUNTS, np.append(seen, size), np.append(total[seen], n))

    sums = texts.mapInArrow(frugal(count), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size + 1, np.int64)
    for r in sums:
        out[r["feature"]] = r["n"]
    return out[:size], int(out[size])
