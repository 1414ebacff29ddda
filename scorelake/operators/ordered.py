"""Running sums, running maxima, order statistics and inversion counts per group, without
ever putting a whole group into one task.

A window ``partitionBy(group).orderBy(x)`` sorts a group in a single task, so one hot group
stalls the job. Here rows are first reduced to distinct ``x`` (map-side partial
aggregation), each group is cut into bins at its own approximate quantiles, the window runs
inside a bin, and the bins' totals are carried over. Bins only steer the work: the result
is exact whatever the cut points are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.session import by_shuffle, materialise

BINS = 64
INDEX_BIN = 4096


def _with_bins(df: DataFrame, group: Sequence[str], x: str, bin_: Column | None) -> DataFrame:
    if bin_ is not None:
        return df.withColumn("_bin", bin_)
    cuts = [i / BINS for i in range(1, BINS)]
    # Cut points must compare exactly with x, so both are doubles. A sketch depends on the order in which its parts arrive:
    # the cuts are written, so that bins and their totals are made from the same ones.
    edges = materialise(df.groupBy(*group).agg(F.percentile_approx(F.col(x).cast("double"), cuts, 2000).alias("_edges")))
    joined = df.join(edges, list(group)) if group else df.join(edges)
    below = F.filter("_edges", lambda e: e < F.col(x).cast("double"))
    return joined.withColumn("_bin", F.size(below)).drop("_edges")


def scan(
    df: DataFrame,
    group: Sequence[str],
    x: str,
    value: str,
    how: str = "sum",
    bin_: Column | None = None,
) -> DataFrame:
    """For rows distinct on ``(group, x)``: add ``upto`` (over rows with x' <= x) and
    ``before`` (x' < x; 0 for a sum, NULL for a maximum when there is none)."""
    agg = F.sum if how == "sum" else F.max
    keys = [*group, "_bin"]
    # Read for the cut points, the bins' totals and the rows: written once, not made thrice.
    binned = _with_bins(materialise(df), group, x, bin_)
    inner = Window.partitionBy(*keys).orderBy(x)
    over_bins = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        binned.groupBy(*keys).agg(agg(value).alias("_total"))
        .withColumn("_carry", agg("_total").over(over_bins)).drop("_total")
    )
    upto = agg(value).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    before = agg(value).over(inner.rowsBetween(Window.unboundedPreceding, -1))
    if bin_ is not None:  # as many groups as the caller has, not the few bins of a board
        carried = by_shuffle(carried)
    out = binned.join(carried, keys).withColumns({"upto": upto, "before": before})
    if how == "sum":
        carry = F.coalesce("_carry", F.lit(0))
        out = out.withColumns({"upto": carry + F.col("upto"), "before": carry + F.coalesce("before", F.lit(0))})
    else:
        out = out.withColumns({"upto": F.greatest("_carry", "upto"), "before": F.greatest("_carry", "before")})
    return out.drop("_bin", "_carry")


def nearest_ranks(
    df: DataFrame, group: Sequence[str], value: str, points: dict[str, float]
) -> DataFrame:
    """Per group, the value at 0-based sorted position ``min(n-1, int(p*n))`` for each named
    ``p``, with ``n``. NULL values are left out."""
    counts = materialise(df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c")))
    totals = counts.groupBy(*group).agg(F.sum("_c").alias("n"))
    ranked = scan(counts, group, value, "_c")
    ranked = ranked.join(totals, list(group)) if group else ranked.join(totals)
    picks = [
        F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n"))), F.col(value))).alias(name)
        for name, p in points.items()
    ]
    return ranked.groupBy(*group).agg(F.max("n").alias("n"), *picks)


def count_inversions(df: DataFrame, group: Sequence[str], index: str, position: str) -> DataFrame:
    """Per group, pairs ``i < j`` with ``position_i > position_j`` (both distinct integers).

    A pair is inverted at exactly one bit: the highest bit in which the two positions
    differ, where the earlier row has 1 and the later has 0. So every row goes once to each
    bit level, and within (level, shared higher bits) each 0 counts the 1s before it:
    n log n rows and running sums, never a pair of rows."""
    top = df.groupBy(*group).agg(F.max(position).alias("_top"))
    levels = (
        df.join(top, list(group))
        .withColumn("_level", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("_top") + 1)).cast("int"))))
        .withColumn("_prefix", F.expr(f"shiftright({position}, _level + 1)"))
        .withColumn("_one", F.expr(f"cast(shiftright({position}, _level) & 1 as bigint)"))
    )
    keys = [*group, "_level", "_prefix"]
    ones = scan(levels.select(*keys, index, "_one"), keys, index, "_one", bin_=F.floor(F.col(index) / INDEX_BIN))
    return ones.groupBy(*group).agg(F.sum(F.when(F.col("_one") == 0, F.col("before")).otherwise(0)).alias("inversions"))


def row_numbers(df: DataFrame, group: Sequence[str], x: str, ties: Sequence[Column], name: str) -> DataFrame:
    """Row number per group by ``x`` ascending; rows equal on ``x`` go by ``ties``."""
    counts = df.groupBy(*group, x).agg(F.count("*").cast("bigint").alias("_c"))
    ranked = scan(counts, group, x, "_c").select(*group, x, "before")
    inside = F.row_number().over(Window.partitionBy(*group, x).orderBy(*ties))
    return df.join(ranked, [*group, x]).withColumn(name, F.col("before") + inside).drop("before")
