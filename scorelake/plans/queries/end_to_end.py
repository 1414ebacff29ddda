"""Whole jobs: a prediction log to a ranked board, and predictions made by a function."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.operators import board as B
from scorelake.operators.predictions import predict
from scorelake.plans.evaluation import BenchmarkSpec, evaluate
from scorelake.plans.queries.texts import CANON, _bootstrap_sql
from scorelake.plans.workload import query

SPEC = BenchmarkSpec("transcription", "char_accuracy", ("char_accuracy", "cer", "exact_match"), postprocess=False)

_VALUES = f"""{CANON}, scored AS (SELECT run_key, sample_id, CASE WHEN NOT ok THEN 0 WHEN length(r) = 0 THEN 1 ELSE greatest(0, 1 - d / length(r)) END AS value,
    CASE WHEN NOT ok THEN 1 WHEN length(r) = 0 THEN 0 ELSE d / length(r) END AS cer FROM costs)"""
_CI = _bootstrap_sql("cast(sample_id AS string)")
_CI = "WITH " + _VALUES + ", units" + _CI.split(", units", 1)[1]
_CI = _CI.replace("SELECT u.run_key, round(sum(s) / sum(n), 6) AS mean", "board AS (SELECT u.run_key, sum(s) / sum(n) AS mean").replace(
    "+ 1]), 6)", "+ 1]))").replace("round(any_value", "(any_value").replace(
    "FROM units u JOIN sorted USING (run_key) GROUP BY u.run_key", "FROM units u JOIN sorted USING (run_key) GROUP BY u.run_key)")
_CI = _CI.replace("sorted AS (SELECT run_key, list_sort(list(m)) AS m FROM means GROUP BY ALL)\n", "sorted AS (SELECT run_key, list_sort(list(m)) AS m FROM means GROUP BY ALL),\n")


@query("q_transcription_board", _CI + """
    SELECT a.run_key AS model_id, round(a.mean, 6) AS score, round(a.ci_low, 6) AS ci_low, round(a.ci_high, 6) AS ci_high, round(100 * least(1, greatest(0, a.mean)), 4) AS score_100,
        (SELECT round(avg(cer), 6) FROM scored s WHERE s.run_key = a.run_key) AS cer, 1 + (SELECT count(*) FROM board b WHERE b.ci_low > a.ci_high) AS rank,
        1 + (SELECT count(*) FROM board b WHERE b.mean > a.mean) AS position, (SELECT count(*) FROM scored s WHERE s.run_key = a.run_key) AS cases FROM board a""")
def q_transcription_board(t):
    """Documents scored under four models: character accuracy, its interval, the board."""
    log = t.answers.withColumns({"references": F.array("reference"), "seq": F.lit(0)}).select(
        "run_key", "sample_id", "seq", "ok", "output", "references")
    results, _ = evaluate(SPEC, log)
    board = B.boards(results)
    return board.select("model_id", F.round("score", 6).alias("score"), F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"),
                        F.round("score_100", 4).alias("score_100"), F.round(F.element_at("metrics", "cer")["value"], 6).alias("cer"), "rank", "position", "cases")


@query("x_predict", """SELECT 'c' || cast(conv_id AS string) || '-' || cast(turn AS string) AS sample_id, role <> 'system' AS ok,
    CASE WHEN role <> 'system' THEN upper(role) || ':' || cast(length(text) AS string) END AS output, CASE WHEN role = 'system' THEN 'ValueError: no reply to a system turn' END AS error FROM {conversations}""")
def x_predict(t):
    def reply(sample):
        if sample["role"] == "system":
            raise ValueError("no reply to a system turn")
        return {"output": f"{sample['role'].upper()}:{len(sample['question'])}", "finish_reason": "stop", "usage": {"total_tokens": 1.0}}

    samples = t.conversations.select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("sample_id"), F.col("text").alias("question"), "role")
    return predict(samples, reply).select("sample_id", "ok", "output", "error")
