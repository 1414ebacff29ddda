"""Prices and context lengths: reading a price list, matching model names to it, and the
order in which sources win."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.names import candidates

FIELDS = ("input_price", "output_price", "context_length")
ENDPOINT = "openrouter:"


def per_million(c: Column) -> Column:
    """$ per token (text) as $ per million; negative or unreadable is unknown."""
    v = c.try_cast("double")
    return F.when(v >= 0, F.round(v * 1_000_000, 6))


def listed(price_list: DataFrame) -> DataFrame:
    """``price_list``: pos, id, context_length, pricing, top_provider. Serving variants
    (``:``) and aliases (``~``) are dropped; the last entry of an id wins."""
    kept = price_list.filter((F.coalesce("id", F.lit("")) != "") & ~F.contains("id", F.lit(":")) & ~F.col("id").startswith("~"))
    rows = kept.select("pos", "id", per_million(F.col("pricing.prompt")).alias("input_price"), per_million(F.col("pricing.completion")).alias("output_price"),
                       F.coalesce(F.nullif("context_length", F.lit(0)), "top_provider.context_length").alias("context_length"))
    best = rows.groupBy("id").agg(F.max_by(F.struct("pos", *FIELDS), "pos").alias("r"))
    return best.select("id", "r.*")


def name_index(entries: DataFrame) -> DataFrame:
    """Comparable name to id: the shortest id per name, the first in the list among equals."""
    keys = entries.select("id", "pos", F.explode(candidates(F.col("id"))).alias("key"))
    return keys.groupBy("key").agg(F.min_by("id", F.struct(F.length("id"), "pos")).alias("id"))


def match_names(names: DataFrame, index: DataFrame, key: str, name: str) -> DataFrame:
    """``names`` with a matched ``id``: the first of the name's candidates that is listed."""
    tried = names.select(key, F.posexplode(candidates(F.col(name))).alias("_pos", "key"))
    return tried.join(index, "key").groupBy(key).agg(F.min_by("id", "_pos").alias("id"))


def resolve(models: DataFrame, price_list: DataFrame, overrides: DataFrame) -> DataFrame:
    """``models``: model_id, display_name, endpoint. ``overrides``: model_id, pricing,
    openrouter, input_price, output_price, context_length. Per priced model its values and
    source. In order: an explicit list id, the endpoint's, a match of the display name, a
    match of the id (neither when a price is given); explicit values overlay the listed."""
    entries = listed(price_list)
    index = name_index(entries)
    o = overrides.select("model_id", "pricing", "openrouter", *[F.col(f).alias(f"_{f}") for f in FIELDS])
    rows = models.select("model_id", "display_name", "endpoint").join(o, "model_id", "left").filter(
        ~F.coalesce(F.col("pricing") == "none", F.lit(False)))
    by_name = match_names(rows, index, "model_id", "display_name").withColumnRenamed("id", "_by_name")
    by_id = match_names(rows.withColumn("_n", F.col("model_id")), index, "model_id", "_n").withColumnRenamed("id", "_by_id")
    rows = rows.join(by_name, "model_id", "left").join(by_id, "model_id", "left")
    from_endpoint = F.when(F.col("endpoint").startswith(ENDPOINT), F.substr("endpoint", F.lit(len(ENDPOINT) + 1)))
    given = F.col("_input_price").isNotNull() | F.col("_output_price").isNotNull()
    rows = rows.withColumn("id", F.coalesce("openrouter", from_endpoint, F.when(~given, F.coalesce("_by_name", "_by_id"))))
    rows = rows.join(entries.drop("pos").withColumn("_listed", F.lit(True)), "id", "left")
    explicit = given | F.col("_context_length").isNotNull()
    out = rows.filter(F.col("_listed") | explicit)
    source = F.when(F.col("_listed"), F.concat(F.lit(ENDPOINT), "id")).otherwise("catalog")
    return out.select("model_id", *[F.coalesce(f"_{f}", f).alias(f) for f in FIELDS], source.alias("source"))


def last_given(models: DataFrame, order: str) -> DataFrame:
    """One row a model id: the last by ``order`` wins."""
    columns = [c for c in models.columns if c not in ("model_id", order)]
    return models.groupBy("model_id").agg(F.max_by(F.struct(*columns), order).alias("row")).select("model_id", "row.*")


def coverage(models: DataFrame, priced: DataFrame) -> DataFrame:
    """How many models there are, are priced, and are missing."""
    flags = models.select("model_id").distinct().join(priced.select("model_id", F.lit(1).alias("_p")), "model_id", "left")
    return flags.agg(F.count("*").alias("models"), F.count("_p").alias("priced"), (F.count("*") - F.count("_p")).alias("missing"))


def missing(models: DataFrame, priced: DataFrame) -> DataFrame:
    return models.select("model_id").distinct().join(priced, "model_id", "left_anti").orderBy("model_id")
