"""Exact top-k inner products with MaxScore.

Every vector component is a term with an integer weight. Vectors are cut into shards; a shard keeps one
posting column a term, in vec_id order, with its largest and smallest weight. A query's terms are taken
by falling upper bound of their contribution (weight times the better extreme, 0 at least). The lowest
ones whose bounds together stay under the current k-th score are non-essential: no vector can enter the
result through them alone. Essential columns are traversed whole; the others are probed one at a time,
and only for vectors whose score so far plus the bounds still to come can reach the k-th score. The
threshold comes first from a full score of the vectors that head the strongest term's column, then from
the survivors. Ties at the threshold survive, so equal scores go to the smaller vec_id.

Queries are cut into blocks, and each block meets each shard in one task: a stated query set against all
rows, in blocks of bounded size. Each task returns k rows a query; a grouped merge keeps the best k.
Shard and block sizes are fixed, so their numbers grow with the data.

Vectors that are null or hold a null or non-finite component take no part, as do rows without an id;
components beyond ``MOST`` end the job, as scores would outgrow 64 bits; shorter vectors count as ended with zeros. A repeated id is a candidate as often as it occurs, never for
a query of the same id; repeated queries of one id share one result. Extra columns are ignored, and
no queries or no candidates give no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import rows

SHARD_ROWS = 8192
BLOCK_QUERIES = 8192
MOST = float(1 << 24)  # scores of up to 2 ** 14 components stay exact in 64 bits


class Shard:
    """The posting columns of some vectors."""

    def __init__(self, ids: np.ndarray, table: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.columns = np.ascontiguousarray(table[order].T)  # term, vector
        self.high = self.columns.max(axis=1, initial=0)
        self.low = self.columns.min(axis=1, initial=0)

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and scores of the best ``k`` vectors, best first."""
        n = min(len(query), len(self.columns))
        query, others = query[:n], self.ids != query_id
        if not n:
            some = np.flatnonzero(others)[:k]
            return self.ids[some], np.zeros(len(some), np.int64)
        bound = np.maximum(query * self.high[:n], query * self.low[:n])
        terms = np.argsort(-bound, kind="stable")
        left = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # bounds of the terms from each place on

        def kth(scores: np.ndarray) -> int | None:
            return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else None

        strong = self.columns[terms[0]] * np.sign(query[terms[0]])
        head = np.argpartition(-strong, min(8 * k, len(strong) - 1))[:8 * k + 1]
        head = head[others[head]]
        least = kth(query @ self.columns[:n, head])
        essential = n if least is None else max(1, int((left >= least).sum()) if least > 0 else n)
        essential = min(essential, n)
        score = query[terms[:essential]] @ self.columns[terms[:essential]]
        alive = np.flatnonzero(others if least is None else others & (score + left[essential] >= least))
        score = score[alive]
        for j in range(essential, n):
            score = score + query[terms[j]] * self.columns[terms[j], alive]
            if least is not None:
                keep = score + left[j + 1] >= least
                alive, score = alive[keep], score[keep]
        best = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive[best]], score[best]


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _table(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and a dense table of the vectors, ended with zeros where they are shorter."""
    terms = part.column("terms").combine_chunks()
    length = pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    table = np.zeros((len(length), int(length.max(initial=0))), np.int64)
    table[np.arange(table.shape[1]) < length[:, None]] = terms.flatten().to_numpy(zero_copy_only=False)
    return part.column("id").to_numpy(), table


def _search(k: int):
    def search(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(group))
        probe = whole.column("probe").to_numpy()
        ids, table = _table(whole.filter(pa.array(~probe)))
        if not len(ids):
            return
        shard = Shard(ids, table)
        query_ids, queries = _table(whole.filter(pa.array(probe)))
        out = ([], [], [])
        for query_id, query in zip(query_ids.tolist(), queries, strict=True):
            found, scores = shard.top(query_id, query, k)
            for column, values in zip(out, ([query_id] * len(found), found.tolist(), scores.tolist()), strict=True):
                column += values
        yield rows(_FOUND, *out)

    return search


def weighted(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(id, terms): floor(scale * x) of every component, for the vectors that take part. A component beyond
    ``MOST`` is an error."""
    term = lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")
    terms = F.transform("embedding", lambda x: F.when(F.abs(F.lit(float(scale)) * x.cast("double")) <= MOST, term(x)).otherwise(F.raise_error(F.lit("a component is out of range"))))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).select(F.col("vec_id").cast("long").alias("id"), terms.alias("terms"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries and candidates of (id, terms)."""
    shards = max(1, -(-candidates.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    number = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = candidates.withColumn("shard", number(shards)).withColumn("block", every(blocks)).withColumn("probe", F.lit(False))
    probes = queries.withColumn("block", number(blocks)).withColumn("shard", every(shards)).withColumn("probe", F.lit(True))
    met = held.unionByName(probes).select("id", "terms", "shard", "block", "probe")
    found = met.groupBy("shard", "block").applyInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
