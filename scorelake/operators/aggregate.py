"""Aggregations over scores and prediction records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.names import error_kind
from scorelake.operators.ordered import nearest_ranks


def metric_means(scores: DataFrame, run: Sequence[str] = ("run_key",)) -> DataFrame:
    """Mean per metric over the rows it applies to; a metric with no value is left out."""
    return (
        scores.filter(F.col("value").isNotNull())
        .groupBy(*run, "metric")
        .agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    )


def group_values(meta: Column, is_array: bool) -> Column:
    """The group labels of one meta value: many for a list, "none" for an empty one,
    "unknown" for a missing or blank scalar."""
    if is_array:
        listed = F.transform(meta, lambda v: v.cast("string"))
        return F.when(meta.isNull(), F.array(F.lit("unknown"))).when(
            F.size(meta) == 0, F.array(F.lit("none"))
        ).otherwise(listed)
    text = meta.cast("string")
    return F.array(F.when(text.isNull() | (text == ""), "unknown").otherwise(text))


def breakdowns(
    scored: DataFrame,
    run: Sequence[str],
    keys: dict[str, bool],
    metrics: Sequence[str],
) -> DataFrame:
    """``scored`` is wide (one row per sample). ``keys`` maps a meta column to whether it
    holds a list. One row per (run, key, group, metric) with the group's size and mean."""
    def labelled(key: str, is_array: bool) -> Column:
        return F.transform(group_values(F.col(key), is_array), lambda v: F.struct(F.lit(key).alias("key"), v.alias("group")))

    labels = F.flatten(F.array(*[labelled(k, is_array) for k, is_array in keys.items()]))
    tall = scored.select(*run, F.explode(labels).alias("_g"), *metrics)
    wide = tall.groupBy(*run, F.col("_g.key").alias("group_key"), F.col("_g.group").alias("group_value")).agg(
        F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics]
    )
    ids = [*run, "group_key", "group_value", "n"]
    return wide.unpivot(ids, list(metrics), "metric", "value").filter(F.col("value").isNotNull())


def latency_stats(records: DataFrame, run: Sequence[str] = ("run_key",)) -> DataFrame:
    """Mean, p50 and p95 of latency over successful rows, nearest rank, 3 decimals."""
    good = records.filter(F.col("ok") & F.col("latency_s").isNotNull())
    mean = good.groupBy(*run).agg(F.round(F.avg("latency_s"), 3).alias("latency_mean"))
    ranks = nearest_ranks(good, run, "latency_s", {"p50": 0.5, "p95": 0.95})
    return mean.join(ranks, list(run)).select(
        *run, "latency_mean", F.round("p50", 3).alias("latency_p50"), F.round("p95", 3).alias("latency_p95")
    )


SKETCH_SIZE = 800  # rank error about 0.4 percent


def latency_sketches(records: DataFrame, run: Sequence[str] = ("run_key",)) -> DataFrame:
    """(run, n, total, sketch): latencies of successful rows as mergeable quantile sketches of fixed size, to be kept with each
    run or each part of a growing log."""
    good = records.filter(F.col("ok") & F.col("latency_s").isNotNull())
    value = F.col("latency_s").cast("double")
    return good.groupBy(*run).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.kll_sketch_agg_double(value, F.lit(SKETCH_SIZE)).alias("sketch"))


def latency_of_sketches(sketches: DataFrame, run: Sequence[str] = ("run_key",), points: dict[str, float] | None = None) -> DataFrame:
    """Count, mean and approximate percentiles per ``run`` of any number of sketches: of parts, runs or whole groups of
    runs, without another pass over their rows."""
    merged = sketches.groupBy(*run).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_SIZE)).alias("_s"))
    at = {f"latency_{k}": F.kll_sketch_get_quantile_double("_s", F.lit(p)) for k, p in (points or {"p50": 0.5, "p95": 0.95}).items()}
    return merged.select(*run, "n", (F.col("total") / F.col("n")).alias("latency_mean"), *[c.alias(k) for k, c in at.items()])


def token_totals(records: DataFrame, run: Sequence[str] = ("run_key",)) -> DataFrame:
    """Sum of every usage counter whose name ends in "tokens", successful rows only."""
    return (
        records.filter("ok").select(*run, F.explode("usage").alias("counter", "amount"))
        .filter(F.col("counter").endswith("tokens") & F.col("amount").isNotNull())
        .groupBy(*run, "counter").agg(F.sum("amount").alias("total"))
    )


def finish_reasons(records: DataFrame, run: Sequence[str] = ("run_key",)) -> DataFrame:
    good = records.filter(F.col("ok") & (F.coalesce(F.col("finish_reason"), F.lit("")) != ""))
    return good.groupBy(*run, "finish_reason").agg(F.count("*").alias("n"))


def truncated(records: DataFrame, run: Sequence[str] = ("run_key",)) -> DataFrame:
    """Replies cut off at the token limit."""
    return records.groupBy(*run).agg(
        F.count_if(F.col("ok") & (F.coalesce(F.col("finish_reason"), F.lit("")) == "length")).alias("truncated")
    )


def _top(counts: DataFrame, run: Sequence[str], by: str, k: int) -> DataFrame:
    # Spark limits each partition to k rows before this window's shuffle.
    order = Window.partitionBy(*run).orderBy(F.desc("n"), F.asc(by))
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def top_errors(records: DataFrame, run: Sequence[str] = ("run_key",), k: int = 5) -> DataFrame:
    message = F.left(F.coalesce(F.col("error"), F.lit("")), F.lit(200))
    counts = records.filter(~F.coalesce(F.col("ok"), F.lit(False))).groupBy(*run, message.alias("error")).agg(F.count("*").alias("n"))
    return _top(counts, run, "error", k)


def error_kinds(records: DataFrame, run: Sequence[str] = ("run_key",), k: int = 5) -> DataFrame:
    failed = records.filter(~F.coalesce(F.col("ok"), F.lit(False)))
    counts = failed.groupBy(*run, error_kind(F.col("error")).alias("kind")).agg(F.count("*").alias("n"))
    return _top(counts, run, "kind", k)


def pool_counts(records: DataFrame, run: Sequence[str] = ("run_key",)) -> DataFrame:
    """Completed, failed and retried rows (more than one attempt)."""
    return records.groupBy(*run).agg(
        F.count("*").alias("completed"),
        F.count_if(~F.coalesce(F.col("ok"), F.lit(False))).alias("errors"),
        F.count_if(F.coalesce(F.col("attempts"), F.lit(1)) > 1).alias("retried"),
    )


def _node(hashes: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(hashes), lambda h: F.concat(h["k"], F.lit(":"), h["h"])), ","), 256)


def content_digest(
    records: DataFrame, run: Sequence[str], sample: str, body: Column, length: int = 10
) -> DataFrame:
    """A digest of every record of a run, independent of row order and partitioning.

    A hash tree: records go by the hash of their id to one of 16^6 leaves, leaves to 16^3
    branches, branches to the root, so no list holds more than 4,096 children or one
    leaf's share of the run."""
    key = F.md5(F.col(sample).cast("string"))
    rows = records.select(*run, F.left(key, F.lit(6)).alias("_leaf"), key.alias("k"), F.sha2(body, 256).alias("h"))
    leaves = rows.groupBy(*run, "_leaf").agg(_node(F.collect_list(F.struct("k", "h"))).alias("h"), F.count("*").alias("_n"))
    branches = leaves.groupBy(*run, F.left("_leaf", F.lit(3)).alias("_branch")).agg(
        _node(F.collect_list(F.struct(F.col("_leaf").alias("k"), "h"))).alias("h"), F.sum("_n").alias("_n"))
    return branches.groupBy(*run).agg(
        F.left(_node(F.collect_list(F.struct(F.col("_branch").alias("k"), "h"))), F.lit(length)).alias("digest"),
        F.sum("_n").alias("records"))


def ordered(value: Column, kind: T.DataType) -> Column:
    """The value with struct fields in name order and maps as entries in key order, at every depth."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*(ordered(value[f.name], f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: ordered(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), F.to_json(F.struct(ordered(e["value"], kind.valueType).alias("v"))).alias("value")))
        return F.array_sort(entries)
    return value


def config_hash(rows: DataFrame, column: str, length: int = 10) -> Column:
    """Short hash of a configuration struct or map; the order of its fields does not matter."""
    return F.left(F.sha2(F.to_json(ordered(F.col(column), rows.schema[column].dataType)), 256), F.lit(length))
