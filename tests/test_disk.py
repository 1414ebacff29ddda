"""What jobs leave on disk while they run and when they are done."""

import os
import time

from pyspark.sql import functions as F

from scorelake import schemas, session
from scorelake.operators import board, kv, publish
from scorelake.operators import predictions as P
from scorelake.sources import readers
from scorelake.streaming import jobs
from tests.test_boards import frame, result
from tests.test_ingest import result_line


def _shuffles(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {name for d in dirs for _, _, names in os.walk(d.getPath()) for name in names if name.startswith("shuffle_") and name.endswith(".data")}


def _scratch(spark):
    return {name for name in os.listdir(session.shared_folder(spark).removeprefix("file:")) if name.startswith("scorelake-")}


def test_written_rows_free_their_shuffles(spark):
    before = _shuffles(spark)
    rows = session.materialise(spark.range(20000).repartition(8, "id"))
    until = time.time() + 20
    while _shuffles(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffles(spark) - before and rows.count() == 20000
    assert spark.conf.get(session.CLEANUP) == "false"


def test_refreshed_and_polled_boards_leave_no_scratch(spark, tmp_path):
    stream, store, source = str(tmp_path / "stream"), str(tmp_path / "store"), tmp_path / "in"
    rows = frame(spark, [result("m1", 50), result("m2", 60), result("m2", 60), result("m3", 70, bench="c")])
    rows.coalesce(1).write.parquet(stream)
    before = _scratch(spark)
    query = jobs.refresh_boards(jobs.file_stream(spark, stream, rows.schema), store, str(tmp_path / "cp"), every=None)
    query.awaitTermination()
    assert query.exception() is None
    assert {(r.benchmark_id, r.model_id, r.position) for r in spark.read.parquet(f"{store}/boards").collect()} == {("b", "m1", 2), ("b", "m2", 1), ("c", "m3", 1)}
    source.mkdir()
    (source / "a.json").write_text(result_line("r1", "m1", 50.0) + "\n" + result_line("r1", "m1", 60.0))
    assert jobs.poll_store(spark, str(source), f"{store}2") == 1 and jobs.live(spark, f"{store}2", "boards").count() == 1
    assert _scratch(spark) == before


def test_latest_of_few_equals_the_aggregate(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 3, "n"), (None, 1, "o"), ("c", None, "lost"), ("d", None, "p"), ("d", 5, "q"), ("e", 4, "r")]
    df = spark.createDataFrame(rows, "id string, at int, what string")
    want = P.latest_records(df.withColumn("_order", F.col("at")), ["id"], "_order").select("id", "at", "what").collect()
    assert sorted(P.latest_of_few(df, "id", F.col("at")).collect(), key=str) == sorted(want, key=str)


def test_prices_meet_all_results_only_where_they_filter(spark):
    results = frame(spark, [result("m1", 50), result("m2", 60)])
    prices = spark.createDataFrame([("m1", 1.0, 4.0, 10), ("m2", 3.0, 4.0, 10)], "model_id string, input_price double, output_price double, context_length int")
    joins = {}
    for name, filters in (("all", board.Filters()), ("cheap", board.Filters(input_price=(None, 2.0)))):
        picked = board.candidates(results, prices, None, filters)
        joins[name] = picked._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        assert {r.model_id for r in picked.collect()} == ({"m1", "m2"} if name == "all" else {"m1"})
    assert joins["all"] == joins["cheap"] - 1


def test_parts_hold_every_row_once(spark):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(["a", "b", None, "a", None, "c", "d", "e"])], "k string, i int")
    found = [[r.i for r in part.collect()] for part in session.parts(df, "k")]
    assert sorted(i for p in found for i in p) == list(range(8)) and len([p for p in found if p]) > 1
    assert any({0, 3} <= set(p) for p in found) and any({2, 4} <= set(p) for p in found)


def test_publishing_leaves_the_store_and_the_statuses(spark, tmp_path):
    lines = [result_line("r1", "m1", 1.0), result_line("r2", "m1", 2.0), result_line("r2", "m1", 2.0), result_line("r3", "m1", 3.0), result_line("r3", "m1", 4.0), result_line("r4", "m1", 1.0, cases=-1)]
    (tmp_path / "in.json").write_text("\n".join(lines))
    rows = spark.read.schema(schemas.RESULT).json(str(tmp_path / "in.json"))
    want = [("r1", "published"), ("r2", "published"), ("r2", "unchanged"), ("r3", "conflict"), ("r3", "conflict"), ("r4", "invalid")]
    again = [(i, "unchanged" if s == "published" else s) for i, s in want]
    for expected in (want, again):
        before = _scratch(spark)
        out = publish.publish(rows, str(tmp_path / "store"))
        assert len(_scratch(spark) - before) == 1
        assert sorted((r.run_id, r.status) for r in out.collect()) == expected
    assert sorted(r.run_id for r in readers.result_store(spark, str(tmp_path / "store"))[0].collect()) == ["r1", "r2"]


def test_key_value_scores_are_made_by_parts_of_the_samples(spark):
    samples = spark.createDataFrame([(str(i), i != 5, f'{{"a": "{i}", "b": "x"}}') for i in range(12)] + [(None, True, "{}")], "sample_id string, ok boolean, output string")
    fields = spark.createDataFrame([(str(i), "a", str(i)) for i in range(12)], "sample_id string, key string, value string")
    out = kv.score_kv(samples, fields)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.sample_id: (r.kv_recall, r.kv_precision) for r in out.collect()} == {**{str(i): (1.0, 0.5) if i != 5 else (0.0, 0.0) for i in range(12)}, None: (1.0, 0.0)}
