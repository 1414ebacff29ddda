"""Headline scores and prediction counts out of a suite's score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.names import run_id, slug

FAILED_PREFIX = "Failed to obtain answer"
OVERALL = ("none", "Overall", "overall")


def newest_matching(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """``files``: run, file, modified. ``patterns``: run, bench, pos, pattern (a LIKE pattern
    of the file name). Per (run, bench) the newest file of the first pattern that has one."""
    name = F.substring_index("file", "/", -1)
    hits = files.withColumn("_name", name).join(patterns, "run").filter(F.like("_name", "pattern"))
    order = F.struct("pos", (-F.unix_micros("modified")).alias("age"), "file")
    return hits.groupBy("run", "bench").agg(F.min_by(F.struct("file", "modified"), order).alias("f")).select("run", "bench", "f.*")


def number(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "%+$", "").try_cast("double")


def headline_scores(cells: DataFrame, specs: DataFrame) -> DataFrame:
    """(file, bench, score, reason) for every spec: a score, or why there is none. ``cells``: file, row,
    column, value. ``specs``: file, bench, columns (summed), multiply ("auto" or a number), and an optional row
    filter, either the map ``want`` of columns to values that must all match or one want_column and want_value.

    The row: the first that matches the filter; without a filter the only one, else the
    first whose ``split`` is none or overall, else the first."""
    if "want" not in specs.columns:
        specs = specs.withColumn("want", F.when(F.col("want_column").isNotNull(), F.create_map("want_column", "want_value")))
    specs = specs.withColumn("_asked", F.coalesce(F.size(F.map_keys("want")), F.lit(0)))
    tall = cells.withColumn("key", F.lower(F.trim("column")))
    asked = specs.filter("_asked > 0").select("file", "bench", "_asked", F.explode("want").alias("key", "_value")).withColumn("key", F.lower("key"))
    hits = asked.join(tall, ["file", "key"]).filter(F.trim("value") == F.col("_value")).groupBy("file", "bench", "row", "_asked").agg(
        F.count_distinct("key").alias("_met")).filter("_met = _asked")
    matching = hits.groupBy("file", "bench").agg(F.min("row").alias("_wanted"))
    split = tall.filter((F.col("key") == "split") & F.trim("value").isin(*OVERALL)).groupBy("file").agg(F.min("row").alias("_overall"))
    shape = tall.groupBy("file").agg(F.count_distinct("row").alias("_rows"), F.min("row").alias("_first"))
    picked = specs.join(shape, "file", "left").join(split, "file", "left").join(matching, ["file", "bench"], "left").withColumn(
        "row", F.when(F.col("_asked") > 0, F.col("_wanted")).when(F.col("_rows") == 1, F.col("_first")).otherwise(
            F.coalesce("_overall", "_first")))
    wanted = picked.select("file", "bench", "row", "_rows", "multiply", F.size("columns").alias("_n"), F.explode("columns").alias("name"))
    # An exact column name wins over one equal without case.
    found = wanted.withColumn("key", F.lower("name")).join(tall.select("file", "row", "key", "column", "value"), ["file", "row", "key"], "left")
    by = ["file", "bench", "row", "_rows", "multiply", "_n"]
    one = found.groupBy(*by, "name").agg(F.count("column").alias("_there"), F.min_by(number(F.col("value")), (F.col("column") != F.col("name")).cast("int")).alias("v"))
    summed = one.groupBy(*by).agg(F.sum("v").alias("raw"), F.count("v").alias("_have"), F.count_if(F.col("_there") > 0).alias("_there"))
    factor = F.when(F.col("multiply") == "auto", F.when(F.col("raw") <= 1.0, 100.0).otherwise(1.0)).otherwise(
        F.coalesce(F.col("multiply").try_cast("double"), F.lit(1.0)))
    reason = F.when(F.col("_rows").isNull(), "empty table").when(F.col("row").isNull(), "no matching row").when(
        F.col("_there") < F.col("_n"), "missing column").when(F.col("_have") < F.col("_n"), "not a number")
    return summed.select("file", "bench", F.when(reason.isNull(), F.col("raw") * factor).alias("score"), reason.alias("reason"))


def prediction_counts(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Cases, and predictions that failed to be made."""
    failed = F.coalesce(F.col("prediction").startswith(FAILED_PREFIX), F.lit(False))
    return predictions.groupBy(*by).agg(F.count("*").alias("cases"), F.count_if(failed).alias("failed"))


def build_results(scores: DataFrame, catalog: DataFrame) -> DataFrame:
    """Suite headline scores as flat measured results with a reason where one cannot be published.
    ``scores``: model_id, bench, score, cases, failed, created_at. ``catalog``: benchmark_id, category,
    primary_metric, scale_max, full_cases."""
    known = scores.join(catalog.withColumnRenamed("benchmark_id", "bench"), "bench", "left")
    reason = F.when(F.col("primary_metric").isNull(), "unknown benchmark").when(F.col("score").isNull(), "no score").when(
        ~suite_range_ok(F.col("score"), F.col("scale_max")), "score outside scale")
    return known.select(
        run_id(slug(F.lit("suite")), slug(F.col("model_id")), slug(F.col("bench")), F.date_format("created_at", "yyyyMMdd")).alias("run_id"), "created_at", "model_id",
        F.col("bench").alias("benchmark_id"), "category", F.lit("measured").alias("source_kind"), "cases", F.col("failed").alias("errors"),
        F.create_map(F.coalesce("primary_metric", F.lit("score")), F.col("score")).alias("metrics"), "primary_metric", "scale_max", "full_cases", reason.alias("reason"))


def suite_range_ok(score: Column, scale_max: Column) -> Column:
    """Suite scores may overshoot the scale by rounding."""
    return scale_max.isNull() | score.between(F.lit(0.0), scale_max * 1.0001)
