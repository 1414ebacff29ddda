"""The append-only prediction log: latest record, resume, gates, failure streaks."""

from __future__ import annotations

from collections.abc import Iterator, Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.operators.ordered import INDEX_BIN, scan
from scorelake.session import materialise

RUN_SAMPLE = ("run_key", "sample_id")


def latest_records(log: DataFrame, keys: Sequence[str] = RUN_SAMPLE, seq: str = "seq") -> DataFrame:
    """The record with the highest ``seq`` per key. An aggregate, not a window: partial
    maxima are taken before the shuffle, however often one sample was retried."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def latest_of_few(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """``latest_records`` where few keys come twice: keys are counted by their hash, and only the rows of those that may
    be repeated move."""
    mark = F.xxhash64(key)
    # A key without any order is left to ``latest_records`` as well.
    again = materialise(rows.groupBy(mark.alias("_mark")).agg(F.count("*").alias("_n"), F.count(order).alias("_known")).filter("_n > 1 OR _known = 0").select("_mark"))
    marked = rows.withColumn("_mark", mark)
    repeated = marked.join(again, "_mark", "left_semi").drop("_mark").withColumn("_order", order)
    return marked.join(again, "_mark", "left_anti").drop("_mark").unionByName(latest_records(repeated, [key], "_order").drop("_order"))


def remaining_samples(
    samples: DataFrame, latest: DataFrame, keys: Sequence[str] = RUN_SAMPLE, retry_errors: bool = True
) -> DataFrame:
    """Samples still to run, with ``retry`` marking those that failed before."""
    done = latest.filter("ok") if retry_errors else latest
    failed = latest.filter("NOT coalesce(ok, false)").select(*keys, F.lit(True).alias("_failed"))
    todo = samples.join(done.select(*keys), list(keys), "left_anti")
    return todo.join(failed, list(keys), "left").withColumn("retry", F.coalesce("_failed", F.lit(False))).drop("_failed")


def duplicate_ids(samples: DataFrame, keys: Sequence[str] = RUN_SAMPLE) -> DataFrame:
    return samples.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def completeness(latest: DataFrame, expected: DataFrame) -> DataFrame:
    """Per expected run: how many samples are there, and may it be evaluated."""
    have = latest.groupBy("run_key").agg(F.count("*").alias("records"))
    state = F.when(F.col("records") == 0, "no predictions").when(
        F.col("records") < F.col("expected"), "incomplete").otherwise("complete")
    return (
        expected.join(have, "run_key", "left")
        .withColumn("records", F.coalesce("records", F.lit(0)))
        .withColumn("state", state)
    )


def failure_streaks(
    log: DataFrame, run: Sequence[str] = ("run_key",), seq: str = "seq", carried: DataFrame | None = None
) -> DataFrame:
    """Every row with ``streak``: failures in a row up to and including it, 0 on success.
    ``carried`` (run columns, carried) continues streaks from rows before these.

    The streak is the failures so far minus the failures there were at the last success;
    both are running aggregates over bins of ``seq``, so a run of any length spreads out."""
    bin_ = F.floor(F.col(seq) / INDEX_BIN)
    rows = log.withColumn("_fail", F.when(F.col("ok"), 0).otherwise(1).cast("bigint"))
    fails = scan(rows, run, seq, "_fail", bin_=bin_).drop("before").withColumnRenamed("upto", "_fails")
    fails = fails.withColumn("_at_ok", F.when(F.col("ok"), F.col("_fails")))
    last = scan(fails, run, seq, "_at_ok", "max", bin_=bin_)
    if carried is None:
        last = last.withColumn("carried", F.lit(0).cast("bigint"))
    else:
        last = last.join(carried, list(run), "left")
    since = F.coalesce(-F.col("upto"), F.col("carried"), F.lit(0))
    return last.withColumn("streak", F.col("_fails") + since).drop("_fail", "_fails", "_at_ok", "upto", "before", "carried")


def tripped_runs(
    log: DataFrame, limit: int = 25, run: Sequence[str] = ("run_key",), seq: str = "seq"
) -> DataFrame:
    """Longest streak per run and where ``limit`` consecutive failures were first reached."""
    return failure_streaks(log, run, seq).groupBy(*run).agg(
        F.max("streak").alias("longest"), F.min(F.when(F.col("streak") >= limit, F.col(seq))).alias("aborted_at"))


PREDICTION = "ok boolean, output string, error string, latency_s double, finish_reason string, usage map<string,double>"


class FatalPredictionError(RuntimeError):
    """Raised by a prediction function to stop the job: nothing later can succeed."""


def predict(samples: DataFrame, fn: Callable[[dict], dict]) -> DataFrame:
    """Run ``fn(sample) -> {output, finish_reason?, usage?}`` over every sample where it is.
    An exception becomes an error record; ``FatalPredictionError`` fails the job."""
    import time

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for row in frame.to_dict("records"):
                started = time.perf_counter()
                record = dict.fromkeys(("output", "error", "finish_reason", "usage"))
                try:
                    record.update(fn(row), ok=True)
                except FatalPredictionError:
                    raise
                except Exception as exc:
                    record.update(ok=False, error=f"{type(exc).__name__}: {exc}"[:1000])
                made.append({**row, "latency_s": round(time.perf_counter() - started, 4), **record})
            yield pd.DataFrame(made, columns=names)

    given = T.StructType.fromDDL(PREDICTION)
    schema = T.StructType([f for f in samples.schema if f.name not in given.names] + given.fields)
    names = schema.fieldNames()
    return samples.mapInPandas(batches, schema)


def seeded_subset(samples: DataFrame, limit: int | None, seed: int = 0, key: str = "sample_id") -> DataFrame:
    """Exactly ``limit`` samples drawn by the hash of seed and id. Only ids and hashes are
    sorted (a take-ordered), then the wide rows are fetched by a semi join."""
    if not limit:
        return samples
    drawn = samples.select(key).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(limit)
    return samples.join(drawn, key, "left_semi")
