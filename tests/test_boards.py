"""Leaderboard semantics on hand-made boards, and the scans behind them against plain Python."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorelake.operators import board as B
from scorelake.operators import ordered as O

BASE = dt.datetime(2026, 10, 1)
COLUMNS = ("run_id string, created_at timestamp, model_id string, benchmark_id string, source_kind string, cases bigint, errors bigint, "
           "metrics map<string,struct<value:double,ci_low:double,ci_high:double>>, primary_metric string, higher_is_better boolean, "
           "scale_max double, full_cases bigint, version string, category string, model_kind string, open_weights boolean, org string")


def result(model, value, ci=None, bench="b", higher=True, kind="measured", cases=100, days_ago=0, scale=100.0, version="1", primary="acc",
           extra=None, org="X", open_weights=None, model_kind="vlm"):
    lo, hi = ci or (None, None)
    metrics = {primary: (float(value), lo, hi), **{k: (float(v), None, None) for k, v in (extra or {}).items()}}
    return (f"{model}-{bench}-{kind}-{cases}-{days_ago}", BASE - dt.timedelta(days=days_ago), model, bench, kind, cases, 0, metrics, primary, higher,
            scale, 100, version, "ocr", model_kind, open_weights, org)


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def ranks(df):
    return {r.model_id: (r.rank, r.rank_worst, r.position) for r in df.collect()}


def test_ranks_of_several_boards_at_once(spark):
    rows = [
        result("a", 71, (69.5, 72.5)), result("b", 70.5, (69.0, 72.0)), result("c", 44, (42.0, 46.0)),
        result("a", 33, bench="ties"), result("b", 33, bench="ties"), result("c", 12, bench="ties"),
        result("a", 0.05, (0.04, 0.06), bench="low", higher=False, scale=1.0), result("b", 0.42, (0.4, 0.44), bench="low", higher=False, scale=1.0),
        result("x", 1208, (1201.0, 1215.0), bench="elo", scale=None), result("y", 1203, (1196.0, 1210.0), bench="elo", scale=None),
        result("z", 1150, (1140.0, 1160.0), bench="elo", scale=None)]
    board = B.boards(frame(spark, rows)).cache()
    by = lambda b: ranks(board.filter(F.col("benchmark_id") == b))
    assert by("b") == {"a": (1, 2, 1), "b": (1, 2, 2), "c": (3, 3, 3)}
    assert by("ties") == {"a": (1, 1, 1), "b": (1, 1, 1), "c": (3, 3, 3)}
    assert by("low") == {"a": (1, 1, 1), "b": (2, 2, 2)}
    assert by("elo") == {"x": (1, 2, 1), "y": (1, 2, 2), "z": (3, 3, 3)}
    scores = {(r.benchmark_id, r.model_id): r.score_100 for r in board.collect()}
    assert scores["low", "a"] == pytest.approx(95) and scores["elo", "x"] is None
    assert [r.model_id for r in B.board_order(board.filter("benchmark_id = 'low'")).collect()] == ["a", "b"]


def test_representative_and_definitions(spark):
    rows = [result("m", 95, kind="imported"), result("m", 81, cases=30), result("m", 52, days_ago=6), result("m", 57, days_ago=2),
            result("old", 49, version="0", days_ago=50), result("re", 0.3, primary="cer", higher=False, extra={"acc": 83}, days_ago=40),
            result("gone", 0.2, primary="cer", higher=False, days_ago=40)]
    got = {r.model_id: r.score for r in B.candidates(frame(spark, rows)).collect()}
    assert got == {"m": 57, "re": 83}
    # Filters come before the pick: without full runs' models, the subset run surfaces.
    only = B.candidates(frame(spark, rows[:2]), filters=B.Filters(include_imported=False)).collect()
    assert [(r.model_id, r.score) for r in only] == [("m", 81)]
    assert B.candidates(frame(spark, rows), filters=B.Filters(score=(80.0, None))).count() == 1


def test_picking_carries_no_definition(spark):
    """What follows from the benchmark does not travel with every result."""
    plan = B.candidates(frame(spark, [result("m", 90), result("n", 80)]))._jdf.queryExecution().optimizedPlan().toString()
    picking = [line for line in plan.splitlines() if "min_by" in line]
    assert len(picking) == 1 and "category" not in picking[0] and "scale_max" not in picking[0]


def test_filters(spark):
    rows = [result("a", 1, org="Org", open_weights=True), result("b", 2, org="org"), result("c", 3, model_kind="ocr_engine", open_weights=False)]
    prices = spark.createDataFrame([("a", 1.0, 3.0, 100), ("b", None, 1.0, 200)], "model_id string, input_price double, output_price double, context_length bigint")
    ids = lambda f: {r.model_id for r in B.candidates(frame(spark, rows), prices, filters=f).collect()}
    assert ids(B.Filters(orgs=("ORG",))) == {"a", "b"} and ids(B.Filters(open_weights=False)) == {"c"}
    assert ids(B.Filters(kind="vlm", models=("b", "c"))) == {"b"}
    assert ids(B.Filters(input_price=(None, 5.0))) == {"a"} and ids(B.Filters(input_price=(None, None))) == {"a", "b", "c"}
    assert ids(B.Filters(context_length=(150, None))) == {"b"}


def test_frontier_and_payload(spark):
    rows = [result("a", 910, scale=None), result("b", 880, scale=None), result("c", 850, scale=None), result("d", 850, scale=None), result("free", 700, scale=None), result("dear", 900, scale=None)]
    prices = [("a", 12.0, 12.0, 1), ("b", 4.0, 4.0, 1), ("c", 0.5, 0.5, 1), ("d", 0.5, 0.5, 1), ("dear", 40.0, 40.0, 0)]
    board = B.boards(frame(spark, rows), spark.createDataFrame(prices, "model_id string, input_price double, output_price double, context_length bigint"))
    assert {r.model_id for r in board.filter("pareto").collect()} == {"a", "b", "c"}
    assert '"pricing":null' in B.board_payload(board).filter("model_id = 'free'").head().payload
    b = B.bounds(board).head()
    assert (b.input_price_min, b.input_price_max, b.context_length_min, b.score_max) == (0.5, 40.0, 1, 910.0)


def test_overview(spark):
    rows = [result("full", 50, bench="x"), result("full", 40, bench="y"), result("full", 0.3, bench="cer", higher=False, scale=1.0),
            result("partial", 97, bench="x"), result("lower", 0.4, bench="cer", higher=False, scale=1.0), result("full", 1500, bench="elo", scale=None)]
    board = B.boards(frame(spark, rows))
    got = sorted(B.overview(board).collect(), key=lambda r: r.rank)
    assert [(r.model_id, r.rank, r.covered, r.total, r.complete) for r in got] == [("full", 1, 3, 3, True), ("partial", 2, 1, 3, False), ("lower", 3, 1, 3, False)]
    assert got[0].avg_score_100 == pytest.approx((50 + 40 + 70) / 3)
    assert {r.model_id for r in B.overview(board, ["x", "x", "elo", "none"]).collect()} == {"full", "partial"}


@pytest.mark.parametrize("higher", [True, False])
def test_rank_equals_pairwise_comparison(spark, higher):
    rng = random.Random(8)
    rows = []
    for bench in ("p", "q"):
        for i in range(90):
            v = rng.randint(0, 30) / 2
            w = rng.choice([0, 1, 2.5])
            rows.append(result(f"m{i}", v, None if rng.random() < 0.2 else (v - w, v + w), bench=bench, higher=higher))
    got = {(r.benchmark_id, r.model_id): (r.rank, r.rank_worst, r.position) for r in B.rank(B.candidates(frame(spark, rows))).collect()}
    for r in rows:
        v, lo, hi = r[7]["acc"]
        lo, hi = (v, v) if lo is None else (lo, hi)
        better = could = above = 0
        for o in rows:
            if o is r or o[3] != r[3]:
                continue
            ov, olo, ohi = o[7]["acc"]
            olo, ohi = (ov, ov) if olo is None else (olo, ohi)
            better += olo > hi if higher else ohi < lo
            could += ohi > lo if higher else olo < hi
            above += ov > v if higher else ov < v
        assert got[r[3], r[2]] == (1 + better, max(1 + better, 1 + could), 1 + above)


def test_no_pairwise_join_in_the_rank_plan(spark):
    plan = B.rank(frame(spark, [result("a", 1), result("b", 2)]).transform(B.with_headline))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scan_over_many_bins(spark):
    rng = random.Random(6)
    values = {g: {rng.randint(0, 5000): rng.randint(0, 9) for _ in range(n)} for g, n in (("a", 3000), ("b", 1), ("c", 70))}
    rows = [(g, x, w) for g, vs in values.items() for x, w in vs.items()]
    df = spark.createDataFrame(rows, "g string, x int, w int")
    sums = {(r.g, r.x): (r.upto, r.before) for r in O.scan(df, ["g"], "x", "w").collect()}
    tops = {(r.g, r.x): r.upto for r in O.scan(df, ["g"], "x", "w", "max").collect()}
    for g, vs in values.items():
        total, top = 0, 0
        for x in sorted(vs):
            top = max(top, vs[x])
            assert sums[g, x] == (total + vs[x], total) and tops[g, x] == top
            total += vs[x]


def test_scan_with_cuts_that_come_out_anew(spark, monkeypatch):
    """Cut points of a sketch need not be the same when they are made twice."""
    @F.pandas_udf("array<double>")
    def cuts(x: pd.Series) -> list:
        return sorted(random.SystemRandom().uniform(x.min(), x.max()) for _ in range(20))

    monkeypatch.setattr(O.F, "percentile_approx", lambda x, *_: cuts(x))
    df = spark.range(2000).select((F.col("id") % 2).alias("g"), F.col("id").alias("x"), F.lit(1).alias("v"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = O.scan(df, ["g"], "x", "v").select("x", "upto").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert all(r.upto == r.x // 2 + 1 for r in got) and len(got) == 2000


def test_nearest_ranks(spark):
    data = {"two": [1.0, 2.0], "one": [5.0], "many": [float(i % 37) for i in range(500)]}
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("two", None)]
    got = {r.g: (r.n, r.p50, r.p95) for r in O.nearest_ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for g, vs in data.items():
        at = lambda p: sorted(vs)[min(len(vs) - 1, int(p * len(vs)))]
        assert got[g] == (len(vs), at(0.5), at(0.95))


def test_paging_and_drill_down(spark):
    df = spark.createDataFrame([("s1", True, None, ["a"]), ("s2", True, 0.5, []), ("s3", False, 0.9, None)], "sample_id string, ok boolean, cer double, tags array<string>")
    rows, order = B.drill_down(df, ["cer"], sort="cer")
    assert [r.sample_id for r in B.page(rows, order, 2, 1, 200).collect()] == ["s2", "s1"]
    assert [r.sample_id for r in B.drill_down(df, ["cer"], group=("tags", "none", True))[0].collect()] == ["s2"]
    with pytest.raises(ValueError):
        B.drill_down(df, ["cer"], sort="wer")
    with pytest.raises(ValueError):
        B.page(df, order, 0, 0, 200)
