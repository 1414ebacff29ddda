"""Leaderboard queries over results derived from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.operators import board as B
from scorelake.plans.workload import query
from scorelake.session import materialise


def results(t):
    """The flat results with their metric maps: the headline with its interval, and one more
    metric on a third of the rows, so definitions can change."""
    value = F.struct("score", (F.col("score") - F.col("half_width")).alias("lo"), (F.col("score") + F.col("half_width")).alias("hi"))
    value = F.struct(value["score"].alias("value"), value["lo"].alias("ci_low"), value["hi"].alias("ci_high"))
    none = F.lit(None).cast("double")
    extra = F.struct(F.col("cer").alias("value"), none.alias("ci_low"), none.alias("ci_high"))
    head = F.when(F.col("primary_metric") == "score", value).otherwise(extra)
    other = F.when(F.col("other_metric") == "score", value).otherwise(extra)
    metrics = F.when(F.col("primary_metric") == F.col("other_metric"), F.create_map("primary_metric", head)).otherwise(
        F.create_map(F.col("primary_metric"), head, F.col("other_metric"), other))
    return t.results.withColumn("metrics", metrics).drop("score", "half_width", "cer", "other_metric").join(t.models, "model_id")


# The same steps in SQL: newest definition, re-expression, representative, headline.
def comparable(where="true", keep="true"):
    return f"""WITH defs AS (SELECT benchmark_id, primary_metric AS pm, version AS v FROM (SELECT *, row_number() OVER (
            PARTITION BY benchmark_id ORDER BY created_at DESC, run_id) AS rn FROM {{results}}) x WHERE rn = 1),
    expressed AS (SELECT r.*, pm, m.display_name, m.org, m.model_kind, m.open_weights, input_price, output_price, context_length
        FROM {{results}} r JOIN defs d ON r.benchmark_id = d.benchmark_id AND r.version = d.v
        JOIN {{models}} m ON r.model_id = m.model_id LEFT JOIN {{prices}} p ON r.model_id = p.model_id
        WHERE r.primary_metric = pm OR r.other_metric = pm),
    picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY benchmark_id, model_id ORDER BY source_kind = 'measured' DESC,
            cases < full_cases, created_at DESC, run_id) AS rn FROM expressed WHERE {where}) x WHERE rn = 1),
    reps AS (SELECT * FROM (SELECT benchmark_id, model_id, run_id, cases, created_at, source_kind, higher_is_better, scale_max, category,
            input_price, output_price, context_length,
            CASE WHEN pm = 'score' THEN score ELSE cer END AS sc,
            CASE WHEN pm = 'score' AND half_width IS NOT NULL THEN score - half_width WHEN pm = 'score' THEN score ELSE cer END AS lo,
            CASE WHEN pm = 'score' AND half_width IS NOT NULL THEN score + half_width WHEN pm = 'score' THEN score ELSE cer END AS hi
        FROM picked) y WHERE {keep})"""


RANKED = """, ranked AS (SELECT a.benchmark_id, a.model_id, a.sc, a.higher_is_better, a.scale_max, a.input_price, a.output_price,
        1 + count(*) FILTER (b.model_id <> a.model_id AND CASE WHEN a.higher_is_better THEN b.lo > a.hi ELSE b.hi < a.lo END) AS rank,
        1 + count(*) FILTER (b.model_id <> a.model_id AND CASE WHEN a.higher_is_better THEN b.hi > a.lo ELSE b.lo < a.hi END) AS could,
        1 + count(*) FILTER (CASE WHEN a.higher_is_better THEN b.sc > a.sc ELSE b.sc < a.sc END) AS position
    FROM reps a JOIN reps b ON a.benchmark_id = b.benchmark_id
    GROUP BY a.benchmark_id, a.model_id, a.sc, a.higher_is_better, a.scale_max, a.input_price, a.output_price)"""
S100 = """CASE WHEN scale_max IS NOT NULL THEN 100 * CASE WHEN higher_is_better
    THEN least(1, greatest(0, sc / scale_max)) ELSE 1 - least(1, greatest(0, sc / scale_max)) END END"""


def _candidates(t, filters=B.Filters()):
    return B.candidates(results(t), t.prices, None, filters)


@query("w_representatives", comparable() + " SELECT benchmark_id, model_id, run_id, round(sc, 6) AS score, cases FROM reps")
def w_representatives(t):
    return _candidates(t).select("benchmark_id", "model_id", "run_id", F.round("score", 6).alias("score"), "cases")


@query("w_rank_spread", comparable() + RANKED + " SELECT benchmark_id, model_id, rank, greatest(rank, could) AS rank_worst, position FROM ranked")
def w_rank_spread(t):
    return B.rank(materialise(_candidates(t))).select("benchmark_id", "model_id", "rank", "rank_worst", "position")


@query("w_pareto", comparable() + """, priced AS (SELECT *, (3 * input_price + output_price) / 4 AS price,
        CASE WHEN higher_is_better THEN sc ELSE -sc END AS s FROM reps)
    SELECT benchmark_id, model_id, round(price, 6) AS blended, coalesce(price IS NOT NULL AND s > coalesce(max(s) OVER (
        PARTITION BY benchmark_id, price IS NULL ORDER BY price, s DESC, model_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300), false) AS pareto
    FROM priced""")
def w_pareto(t):
    rows = materialise(_candidates(t))
    out = B.mark_frontier(rows, B.frontier(rows))
    return out.select("benchmark_id", "model_id", F.round(B.blended_price(F.col("input_price"), F.col("output_price")), 6).alias("blended"), "pareto")


@query("p_score_100", comparable() + f" SELECT benchmark_id, model_id, round({S100}, 4) AS score_100 FROM reps")
def p_score_100(t):
    value = B.score_100(F.col("score"), F.col("scale_max"), F.col("higher_is_better"))
    return _candidates(t).select("benchmark_id", "model_id", F.round(value, 4).alias("score_100"))


PRICED = B.Filters(kind="vlm", open_weights=True, include_imported=False, include_subsets=False,
                   input_price=(0.5, None), context_length=(4096, 20000), score=(20.0, 90.0))


@query("f_board_filters", comparable("""model_kind = 'vlm' AND open_weights AND source_kind <> 'imported' AND NOT cases < full_cases
        AND input_price >= 0.5 AND context_length BETWEEN 4096 AND 20000""", "sc BETWEEN 20 AND 90") + RANKED + """
    SELECT benchmark_id, model_id, round(sc, 6) AS score, rank, position FROM ranked""")
def f_board_filters(t):
    board = B.rank(materialise(_candidates(t, PRICED)))
    return board.select("benchmark_id", "model_id", F.round("score", 6).alias("score"), "rank", "position")


@query("f_org_filter", comparable("lower(org) IN ('france', 'nation_3', 'nation_7', 'china')") + """
    SELECT benchmark_id, model_id, run_id FROM reps""")
def f_org_filter(t):
    return _candidates(t, B.Filters(orgs=("FRANCE", "Nation_3", "NATION_7", "China"))).select("benchmark_id", "model_id", "run_id")


@query("a_slider_bounds", comparable() + """ SELECT benchmark_id, round(min(sc), 6) AS score_min, round(max(sc), 6) AS score_max,
        min(CASE WHEN output_price IS NOT NULL THEN input_price END) AS input_price_min, max(CASE WHEN output_price IS NOT NULL THEN input_price END) AS input_price_max,
        min(CASE WHEN input_price IS NOT NULL THEN output_price END) AS output_price_min, max(CASE WHEN input_price IS NOT NULL THEN output_price END) AS output_price_max,
        min(context_length) AS context_length_min, max(context_length) AS context_length_max FROM reps GROUP BY benchmark_id""")
def a_slider_bounds(t):
    out = B.bounds(_candidates(t, B.Filters(score=(20.0, 90.0)).without_ranges()))
    return out.withColumns({c: F.round(c, 6) for c in ("score_min", "score_max")})


@query("w_overview", comparable() + RANKED + f""", cells AS (SELECT *, {S100} AS s100 FROM ranked WHERE scale_max IS NOT NULL),
    per AS (SELECT model_id, avg(s100) AS a, avg(position) AS p, count(*) AS covered FROM cells GROUP BY model_id)
    SELECT model_id, row_number() OVER (ORDER BY covered DESC, round(a, 9) DESC, model_id) AS rank, round(a, 4) AS avg_score_100,
        round(p, 3) AS avg_position, covered, (SELECT count(DISTINCT benchmark_id) FROM cells) AS total,
        covered = (SELECT count(DISTINCT benchmark_id) FROM cells) AS complete FROM per""")
def w_overview(t):
    out = B.overview(B.boards(results(t), t.prices))
    return out.select("model_id", "rank", F.round("avg_score_100", 4).alias("avg_score_100"),
                      F.round("avg_position", 3).alias("avg_position"), "covered", "total", "complete")


@query("f_overview_category", comparable() + RANKED + f""", cells AS (SELECT *, {S100} AS s100 FROM ranked WHERE scale_max IS NOT NULL AND benchmark_id IN ('brand-12', 'brand-21', 'brand-22', 'brand-33')
        AND cast(substr(benchmark_id, 7) AS int) % 3 = 0),
    per AS (SELECT model_id, avg(s100) AS a, count(*) AS covered FROM cells GROUP BY model_id)
    SELECT model_id, row_number() OVER (ORDER BY covered DESC, round(a, 9) DESC, model_id) AS rank, round(a, 4) AS avg_score_100, covered, (SELECT count(DISTINCT benchmark_id) FROM cells) AS total FROM per""")
def f_overview_category(t):
    """Boards asked for, cut to a category; a category without any of them adds nothing."""
    board = B.boards(results(t), t.prices)
    asked = ["brand-12", "brand-21", "brand-22", "brand-33"]
    out = B.overview(board, asked, "ocr").unionByName(B.overview(board, ["brand-11"], "ocr"))
    return out.select("model_id", "rank", F.round("avg_score_100", 4).alias("avg_score_100"), "covered", "total")


@query("a_benchmark_listing", """WITH reps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY benchmark_id, model_id
        ORDER BY source_kind = 'measured' DESC, cases < full_cases, created_at DESC, run_id) AS rn FROM {results}) x WHERE rn = 1),
    cat AS (SELECT DISTINCT lower(replace(p_brand, '#', '_x_')) AS benchmark_id FROM {part} WHERE p_size > 48
            UNION SELECT DISTINCT lower(replace(p_brand, '#', '-')) FROM {part} WHERE p_size < 3)
    SELECT coalesce(c.benchmark_id, s.benchmark_id) AS benchmark_id, coalesce(models, 0) AS models, cast(updated_at AS string) AS updated_at, c.benchmark_id IS NOT NULL AS in_catalog
    FROM cat c FULL JOIN (SELECT benchmark_id, count(*) AS models, max(created_at) AS updated_at FROM reps GROUP BY 1) s ON c.benchmark_id = s.benchmark_id""")
def a_benchmark_listing(t):
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("_x_")))
    plain = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    catalog = t.part.filter("p_size > 48").select(brand.alias("benchmark_id")).union(
        t.part.filter("p_size < 3").select(plain.alias("benchmark_id"))).distinct()
    catalog = catalog.withColumns({"category": F.lit(None).cast("string"), "in_catalog": F.lit(True)})
    out = B.benchmark_listing(results(t), catalog)
    return out.select("benchmark_id", "models", F.col("updated_at").cast("string").alias("updated_at"), F.coalesce("in_catalog", F.lit(False)).alias("in_catalog"))


@query("a_model_listing", """SELECT r.model_id, list_aggregate(list_sort(list(DISTINCT benchmark_id)), 'string_agg', ',') AS benchmarks,
    any_value(input_price) AS input_price FROM {results} r LEFT JOIN {prices} p ON r.model_id = p.model_id GROUP BY r.model_id""")
def a_model_listing(t):
    out = B.model_listing(results(t), t.prices)
    return out.select("model_id", F.array_join("benchmarks", ",").alias("benchmarks"), "input_price")


@query("f_run_listing", """SELECT run_id, model_id, benchmark_id, round(CASE WHEN primary_metric = 'score' THEN score ELSE cer END, 6) AS score
    FROM {results} WHERE source_kind = 'measured' ORDER BY created_at DESC, run_id LIMIT 200 OFFSET 50""")
def f_run_listing(t):
    listing = B.run_listing(results(t), source="measured")
    shown = B.page(listing, [F.desc("created_at"), F.asc("run_id")], 200, 50, 1000)
    return shown.select("run_id", "model_id", "benchmark_id", F.round("score", 6).alias("score"))


@query("snk_board_payload", comparable() + RANKED + """
    SELECT benchmark_id, model_id, rank, position, round(sc, 6) AS score FROM ranked""")
def snk_board_payload(t):
    out = B.board_payload(B.boards(results(t), t.prices))
    doc = F.from_json("payload", "rank bigint, position bigint, score double")
    return out.select("benchmark_id", "model_id", doc["rank"].alias("rank"), doc["position"].alias("position"), F.round(doc["score"], 6).alias("score"))
