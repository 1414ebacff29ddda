"""Imported rating leaderboards: board expansion, model rows, retired categories, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.names import run_id, slug

RATING_METRIC = "arena_score"
PROPRIETARY = "Proprietary"
# Organisation keys as they are displayed.
ORG_NAMES = {
    "openai": "OpenAI", "anthropic": "Anthropic", "google": "Google", "alibaba": "Alibaba", "meta": "Meta", "xai": "xAI",
    "mistral": "Mistral", "zai": "Z.ai", "moonshot": "Moonshot", "stepfun": "StepFun", "xiaomi": "Xiaomi", "tencent": "Tencent",
    "allenai": "Ai2", "minimax": "MiniMax", "amazon": "Amazon", "microsoft": "Microsoft", "bytedance": "ByteDance",
    "baidu": "Baidu", "cohere": "Cohere", "nvidia": "NVIDIA", "deepseek": "DeepSeek", "thinky": "Thinking Machines",
}


def expand_boards(arenas: DataFrame) -> DataFrame:
    """``arenas``: arena, type, display_name, subset_styled, subset_raw, categories (array of
    key, board, label, category, language). Two boards per category, with and without style
    control."""
    rows = arenas.select("*", F.explode("categories").alias("c")).select(
        "*", F.explode(F.array(F.lit(True), F.lit(False))).alias("style_control"))
    tail = F.when(F.col("style_control"), "").otherwise("-no-style-control")
    note = F.when(F.col("style_control"), "").otherwise(" (no style control)")
    return rows.select(
        F.concat(F.lit("arena-"), "arena", F.lit("-"), "c.board", tail).alias("benchmark_id"),
        F.concat("display_name", F.lit(" · "), "c.label", note).alias("display_name"), F.col("c.category").alias("category"),
        F.coalesce("c.language", F.lit("multi")).alias("language"), F.concat_ws("/", "type", "c.board").alias("board"), "style_control",
        F.when(F.col("style_control"), F.col("subset_styled")).otherwise(F.col("subset_raw")).alias("subset"),
        F.col("c.key").alias("category_key"), F.lit("arena").alias("engine"), F.lit(RATING_METRIC).alias("primary_metric"),
        F.lit(True).alias("higher_is_better"), F.lit(None).cast("double").alias("scale_max"), F.lit("votes").alias("cases_unit"))


def org_name(key: Column) -> Column:
    folded = F.lower(F.trim(F.coalesce(key.cast("string"), F.lit(""))))
    names = F.create_map(*[F.lit(x) for kv in ORG_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, folded), F.when(folded == "", "Unknown").otherwise(F.initcap(folded)))


def with_model(rows: DataFrame) -> DataFrame:
    """Adds model_id, display name, org, license and open_weights (unknown without a license)."""
    license_ = F.trim(F.coalesce(F.col("license").cast("string"), F.lit("")))
    known = ~license_.isin("", "-")
    name = F.trim("model_name")
    return rows.withColumns({
        "model_id": slug(name), "display_name": name, "org": org_name(F.col("organization")),
        "open_weights": F.when(known, license_ != PROPRIETARY), "license": F.when(known, license_)})


def board_states(rows: DataFrame, boards: DataFrame) -> DataFrame:
    """Per board: live, retired (its newest rows are older than its subset's newest) or
    empty."""
    day = F.col("leaderboard_publish_date").cast("string")
    newest = rows.groupBy("subset").agg(F.max(day).alias("_newest"))
    mine = rows.groupBy("subset", F.col("category").alias("category_key")).agg(F.max(day).alias("_mine"))
    joined = boards.join(newest, "subset", "left").join(mine, ["subset", "category_key"], "left")
    state = F.when(F.col("_mine").isNull(), "empty").when(F.col("_mine") < F.col("_newest"), "retired").otherwise("live")
    return joined.withColumn("state", state).drop("_newest", "_mine")


def build_results(rows: DataFrame, boards: DataFrame, revision: str = "") -> DataFrame:
    """Rows of live boards as imported results: the rating with its interval (both ends or
    neither), votes as cases, the publish date as creation time."""
    live = board_states(rows, boards).filter("state = 'live'").select("benchmark_id", "subset", "category_key", F.col("category").alias("benchmark_category"))
    named = with_model(rows.withColumnRenamed("category", "category_key"))
    both = F.col("rating_lower").isNotNull() & F.col("rating_upper").isNotNull()
    day = F.to_date(F.left(F.col("leaderboard_publish_date").cast("string"), F.lit(10)))
    return named.join(live, ["subset", "category_key"]).select(
        run_id(F.lit("arena"), F.col("benchmark_id"), F.col("model_id"), F.date_format(day, "yyyyMMdd")).alias("run_id"),
        day.cast("timestamp").alias("created_at"), "model_id", "display_name", "org", "open_weights", "license", "benchmark_id",
        F.col("benchmark_category").alias("category"), F.lit("imported").alias("source_kind"),
        F.coalesce("vote_count", F.lit(0)).cast("bigint").alias("cases"), F.lit(0).cast("bigint").alias("errors"),
        F.create_map(F.lit(RATING_METRIC), F.struct(
            F.col("rating").cast("double").alias("value"), F.when(both, F.col("rating_lower").cast("double")).alias("ci_low"),
            F.when(both, F.col("rating_upper").cast("double")).alias("ci_high"))).alias("metrics"),
        F.lit(RATING_METRIC).alias("primary_metric"), F.lit(True).alias("higher_is_better"), F.lit(None).cast("double").alias("scale_max"),
        F.lit(None).cast("bigint").alias("full_cases"), F.lit("1").alias("version"), F.lit(revision).alias("revision"))
