"""Catalog dimensions: layered definitions, board checks and benchmark selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNNABLE = ("native", "vlmevalkit")


def layered(rows: DataFrame, key: str = "benchmark_id", layer: str = "layer") -> DataFrame:
    """Definitions from several directories: the latest layer of an id wins."""
    rest = [c for c in rows.columns if c not in (key, layer)]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), layer).alias("r"))
    return best.select(key, "r.*")


def with_boards(catalog: DataFrame, defaults: DataFrame, layout: DataFrame) -> DataFrame:
    """A benchmark without a board goes on its category's; an unknown board is an error."""
    placed = catalog.join(defaults.select("category", F.col("board").alias("_default")), "category", "left").withColumn(
        "board", F.coalesce("board", "_default")).drop("_default")
    known = layout.select(F.concat_ws("/", "type_id", "category_id").alias("board")).distinct()
    unknown = placed.join(known, "board", "left_anti").select("benchmark_id", "board").head(1)
    if unknown:
        raise ValueError(f"benchmark {unknown[0].benchmark_id!r}: board {unknown[0].board!r} is not in the layout")
    return placed


def select_benchmarks(catalog: DataFrame, spec: str) -> DataFrame:
    """Comma-separated ids (any case), ``category:x``, ``engine:x`` or ``all``, in the order
    asked for. ``all`` and ``category:`` leave out boards that are only imported. A token
    that selects nothing is an error."""
    tokens = [t.strip() for t in spec.split(",") if t.strip()]
    if not tokens:
        return catalog.limit(0)
    runnable = F.col("engine").isin(*RUNNABLE)

    def hit(token: str) -> Column:
        if token == "all":
            return runnable
        kind, _, value = token.partition(":")
        if kind == "category" and value:
            return runnable & (F.col("category") == value)
        if kind == "engine" and value:
            return F.col("engine") == value
        return F.lower("benchmark_id") == token.lower()

    hits = catalog.select(*[F.max(F.coalesce(hit(t), F.lit(False))).alias(f"h{i}") for i, t in enumerate(tokens)]).head()
    missed = [t for t, h in zip(tokens, hits) if not h and t != "all" and not t.startswith("engine:")]
    if missed:
        raise KeyError(f"no benchmarks for {missed}")
    first = F.array_min(F.array(*[F.when(hit(t), i) for i, t in enumerate(tokens)]))
    return catalog.withColumn("_pos", first).filter("_pos IS NOT NULL").orderBy("_pos", "benchmark_id").drop("_pos")
