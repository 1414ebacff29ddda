"""Counts and listings that must not sort, shuffle or read more than they need."""

from pyspark.sql import functions as F

from scorelake.functions import names
from scorelake.operators import board, publish


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_import_counts_equal_the_status_of_every_entry_in_one_pass(spark):
    rows = [("a", 1.0, None)] * 3 + [("b", 1.0, None), ("b", 2.0, None), ("b", 2.0, None), ("c", 1.0, None), ("d", 5.0, None), ("d", 5.0, None), ("d", 5.0, None)]
    rows += [("e", 1.0, "no score"), ("a", 1.0, "no score"), (None, None, "no harness"), (None, 1.0, None), (None, 1.0, None), (None, 2.0, None), ("f", 1.0, None)]
    new = spark.createDataFrame(rows, "run_id string, score double, reason string")
    there = spark.createDataFrame([("c", 1.0), ("d", 4.0), ("x", 1.0)], "run_id string, score double")
    each = publish.publish_status(new.filter("reason IS NULL"), there, ["run_id", "score"]).select("status").collect()
    want = {"failed": 3}
    for r in each:
        status = "failed" if r.status == "conflict" else r.status
        want[status] = want.get(status, 0) + 1
    out = publish.import_counts(new, there, ["run_id", "score"])
    assert {r.status: r.n for r in out.collect()} == want
    assert _plan(out).count("reason#") and "Window" not in _plan(out) and "Union" not in _plan(out)


def test_dates_are_read_as_by_trying_every_format(spark):
    texts = ["2026-01-02", " 2026/03/04 ", "20260506", "20260506112233", "someday", "", None, "2026-1-2", "2026/1/2", "+12026-01-02", "-0044-03-15", "2026-02-30", "2026-01-02T03:04:05Z",
             "2026-01-02 03:04:05+02:00", "1/2", "12/31/2026", "2026011", "\u0662\u0660\u0662\u0666-01-02", "2026-01-02/"]
    text = F.trim("t")
    tried = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in names.DATE_FORMATS], F.when(text.rlike(names.FULL_DATE), text.try_cast("timestamp")))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(~names.parse_date(F.col("t")).eqNullSafe(tried)).collect() == []


def test_listings_pick_representatives_without_their_metrics(spark):
    results = spark.range(20).select(
        (F.col("id") % 3).cast("string").alias("benchmark_id"), (F.col("id") % 4).cast("string").alias("model_id"), F.col("id").cast("string").alias("run_id"),
        F.lit("measured").alias("source_kind"), F.lit(1).alias("cases"), F.lit(2).alias("full_cases"), F.date_add(F.lit("2026-01-01"), F.col("id").cast("int")).alias("created_at"),
        F.lit("ocr").alias("category"), F.create_map(F.lit("score"), F.col("id").cast("double")).alias("metrics"))
    catalog = spark.createDataFrame([("0", "t/c", "native", 0), ("9", "t/c", "arena", 0)], "benchmark_id string, board string, engine string, pos int")
    layout = spark.createDataFrame([("t", 0, "c", 0, "x")], "type_id string, type_pos int, category_id string, cat_pos int, label string")
    listed = board.benchmark_listing(results, catalog.select("benchmark_id", F.lit(None).cast("string").alias("category")))
    laid = board.board_layout(layout, catalog, results)
    assert {r.benchmark_id: r.models for r in listed.collect()} == {"0": 4, "1": 4, "2": 4, "9": 0}
    assert [(b.benchmark_id, b.models) for b in laid.head().categories[0].boards] == [("9", 0), ("0", 4)]
    assert "map(" not in _plan(listed) and "map(" not in _plan(laid)
