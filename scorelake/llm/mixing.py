"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks of about ``block`` units of size. A mixture is a sequence of
slots, one block each. With target weight w, the source's block i (from 0) is released at slot floor(i / w) and
due by slot ceil((i + 1) / w); every slot goes to the released block with the earliest deadline (ties: the
source whose name comes first). As the weights add up to one this meets all deadlines.

The mixture is cut into periods of ``PERIOD`` slots. After each period a source has had floor(w * t) or
ceil(w * t) blocks, and never fewer than before: which, is again decided by earliest deadline, with periods as
the unit of time, and the rounding is carried on. One task steps through the periods with a few numbers for each
source; each period is then scheduled by itself in Spark tasks, to its own whole shares, zero allowed. So
the deviation from w * t is below one block where a period ends and below two inside, however long the mixture
and however many sources. The mixture runs until every document has come once; sources that are done
earlier start again (epochs), so nothing is dropped and every stretch keeps the weights.

The order inside a source is a hash order of its rows; ranks are sums over hash bins of bounded size, so
a source with a third of all rows is no single group. A null source is a source of its own. Null and empty
texts have size 0 and share a block with their neighbours; a document longer than a block takes as many slots
as it fills and stands in the first. Repeated rows are separate documents. Existing columns keep their names; the operator adds its own as one
struct. An empty table gives an empty mixture; sources without a weight are an error."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import frugal, materialise, rows

PERIOD = 4096
BIN_ROWS = 20_000
BLOCK = 1 << 16
ONE = 1 << 50


def stepped(whole: np.ndarray, period: int) -> Iterator[np.ndarray]:
    """Each source's blocks (running totals) after one period, two, and so on, for whole weights that add up
    to about 2 ** 50. All in whole numbers, so nothing drifts."""
    total = int(whole.sum())
    assert total * period < 1 << 63
    each, rest = np.divmod(whole * period, total)
    least, part = np.zeros_like(whole), np.zeros_like(whole)  # w * t = least + part / total
    had = np.zeros_like(whole)
    slots = 0
    while True:
        slots += period
        part = part + rest
        over = part >= total
        least, part = least + each + over, part - total * over
        had = np.maximum(had, least)
        free = np.flatnonzero((had == least) & (part > 0))  # may have their next block now
        need = slots - int(had.sum())
        assert 0 <= need <= len(free), "a deadline was missed"
        due = (total - part[free]) / whole[free]
        had[free[np.argsort(due, kind="stable")[:need]]] += 1
        yield had.copy()


def whole_weights(weights: np.ndarray) -> np.ndarray:
    """Weights as whole numbers that add up to about 2 ** 50, one at least."""
    return np.maximum(1, np.rint(weights / weights.sum() * ONE)).astype(np.int64)


def parts(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Each source's blocks in the first period."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    names = sorted(weights)
    return dict(zip(names, next(stepped(whole_weights(np.array([weights[s] for s in names], float)), period)).tolist(), strict=True))


def schedule(shares: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block in the period, slot): earliest deadline first over one period."""
    period = sum(shares.values())
    waiting = [(0, s, 0) for s in shares if shares[s]]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []  # deadline, source, block
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * period // shares[s]), s, i))
        due, s, i = heapq.heappop(ready)
        assert slot < due, "a deadline was missed"
        out.append((s, i, slot))
        if i + 1 < shares[s]:
            heapq.heappush(waiting, ((i + 1) * period // shares[s], s, i + 1))
    return out


_SHARES = pa.schema([("period", pa.int64()), ("source", pa.string()), ("first", pa.int64()), ("share", pa.int64())])
_PLAN = pa.schema([("source", pa.string()), ("number", pa.int64()), ("slot", pa.int64())])


def _shares(period: int):
    """Every source's blocks in each period, until the period in which the last source is done once."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = list(batches)
        if not sum(map(len, table)):
            return
        table = pa.Table.from_batches(table).sort_by("source")
        names, blocks = table.column("source").combine_chunks(), table.column("blocks").to_numpy()
        before = np.zeros_like(blocks)
        for k, had in enumerate(stepped(whole_weights(table.column("weight").to_numpy()), period)):
            some = np.flatnonzero(had > before)
            yield rows(_SHARES, np.full(len(some), k), names.take(pa.array(some)), before[some], (had - before)[some])
            if (had >= blocks).all():
                return
            before = had

    return share


def _plans(period: int):
    """Rows come by period; each is scheduled by itself."""

    def one(k: int, held: dict[str, tuple[int, int]]) -> pa.RecordBatch:
        made = schedule({s: n for s, (_, n) in held.items()})
        return rows(_PLAN, [s for s, _, _ in made], [held[s][0] + i for s, i, _ in made], [k * period + slot for _, _, slot in made])

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for k, source, first, share in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    if held:
                        yield one(now, held)
                    now, held = k, {}
                held[source] = (first, share)
        if held:
            yield one(now, held)

    return plan


def planned(sources: DataFrame) -> DataFrame:
    """(source, block, epoch, slot) of the whole mixture, for sources (source, weight, blocks)."""
    shares = sources.select("source", "weight", "blocks").coalesce(1).mapInArrow(frugal(_shares(PERIOD)), "period long, source string, first long, share long")
    dealt = materialise(shares).repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "period").sortWithinPartitions("period")
    plan = materialise(dealt.mapInArrow(frugal(_plans(PERIOD)), "source string, number long, slot long"))
    plan = plan.join(sources.select("source", "blocks"), "source")
    end = plan.where(F.col("number") == F.col("blocks") - 1).agg(F.max("slot")).first()[0]
    plan = plan.where(F.col("slot") <= F.lit(-1 if end is None else end))
    return plan.select("source", F.pmod("number", "blocks").alias("block"), F.floor(F.col("number") / F.col("blocks")).alias("epoch"), "slot")


def mixed(docs: DataFrame, weights: dict[str, float] | float = 0.7, block: int = BLOCK, size: Column | None = None, place: Column | None = None, name: str = "mix") -> DataFrame:
    """All columns of ``docs`` and a struct ``name`` of source, block, epoch and slot (slots are shared by
    a block's documents, ``place`` orders them). Weights: by source, or a power of the
    sizes, between proportional (1) and equal (0). ``size`` and ``place`` default to the text's bytes and a
    hash of doc_id and text."""
    if name in docs.columns:
        raise ValueError(f"choose another name than {name!r} for the mixture's column")
    amount = F.coalesce((F.octet_length("text") if size is None else size).cast("long"), F.lit(0))
    whole = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("source").cast("string"), F.lit("(none)")).alias("source"), amount.alias("size"), (F.xxhash64("doc_id", "text") if place is None else place).alias("place"), F.col("doc_id").alias("key"))
    slim = whole.select("source", "size", "place")
    totals = slim.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    if isinstance(weights, dict):
        if any(not w > 0 for w in weights.values()):
            raise ValueError("weights must be positive")
        targets = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "source string, weight double")
        totals = totals.join(targets, "source", "left")
    else:
        totals = totals.withColumn("weight", F.pow(F.greatest("size", F.lit(1)).cast("double"), F.lit(float(weights))))
    facts = materialise(totals.select("source", "weight", F.ceil(F.col("n") / BIN_ROWS).alias("bins"), F.greatest(F.ceil(F.col("size") / block), F.lit(1)).alias("blocks")))
    missing = [r["source"] for r in facts.where("weight is null").select("source").limit(5).collect()]
    if missing:
        raise ValueError(f"no weight for {sorted(missing)}")
    plan = materialise(planned(facts))
    placed = whole.join(facts.select("source", "bins", "blocks"), "source").withColumn("bin", F.pmod("place", "bins"))
    sums = placed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("earlier", F.coalesce(F.sum("bin_size").over(before), F.lit(0))).select("source", "bin", "earlier")
    inside = Window.partitionBy("source", "bin").orderBy("place", "key").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["source", "bin"])
    ranked = ranked.withColumn("block", F.least(F.floor((F.col("earlier") + F.col("within")) / block), F.col("blocks") - 1))
    each = ranked.withColumn("block", F.col("block").cast("long")).join(plan, ["source", "block"])
    made = F.struct("source", "block", "epoch", "slot", "place", "size")
    return each.select("row.*", made.alias(name))


def in_order(docs: DataFrame, mixture: DataFrame, name: str = "mix") -> DataFrame:
    """The mixture's rows, in slot order over the files they are written to, with the columns of ``docs``."""
    order = [F.col(f"{name}.slot"), F.col(f"{name}.place")]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixture.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*(F.col(f"`{c}`") for c in docs.columns))



