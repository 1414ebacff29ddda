"""Readers, validation, publishing, imports, and streams against small files."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from scorelake.functions.names import parse_date
from scorelake.operators import bootstrap, prices, publish, ratings, suites
from scorelake.operators import docviews as D
from scorelake.operators import predictions as P
from scorelake.sources import readers, writers
from scorelake.streaming import jobs


def stored(run_id, **changes):
    doc = {"schema_version": 1, "run_id": run_id, "created_at": "2026-10-01T00:00:00Z", "model": {"id": "m", "display_name": "M"},
           "benchmark": {"id": "b", "display_name": "B", "category": "ocr", "primary_metric": "acc", "scale_max": 1.0},
           "source": {"kind": "measured", "harness": "h"}, "cases": 10, "errors": 1, "metrics": {"acc": {"value": 0.5, "ci_low": 0.4, "ci_high": 0.6}}}
    return {**doc, **changes}


STORED = {
    "good": {}, "offset": {"created_at": "2026-10-01T02:00:00+02:00"}, "naive": {"created_at": "2026-10-01T00:00:00"}, "version": {"schema_version": 2},
    "errors": {"errors": 11}, "interval": {"metrics": {"acc": {"value": 1, "ci_low": 2, "ci_high": 1}}}, "half": {"metrics": {"acc": {"value": 1, "ci_low": 2}}},
    "primary": {"metrics": {"cer": {"value": 1}}}, "moved": {"run_id": "elsewhere"}, "Upper": {}, "nocases": {"cases": None}}


def test_result_store(spark, tmp_path):
    for name, change in STORED.items():
        folder = tmp_path / "runs" / name
        folder.mkdir(parents=True)
        (folder / "result.json").write_text(json.dumps(stored(**{"run_id": name, **change}), indent=1))
    (tmp_path / "runs" / "torn").mkdir()
    (tmp_path / "runs" / "torn" / "result.json").write_text('{"schema_version": 1, ')
    good, bad = readers.result_store(spark, str(tmp_path))
    assert {r.run_id for r in good.collect()} == {"good", "offset"}
    why = {r.file.split("/")[-2]: set(r.problems) for r in bad.collect()}
    assert why == {"naive": {"created_at"}, "version": {"schema_version"}, "errors": {"errors_exceed_cases"}, "interval": {"interval"}, "half": {"interval"},
                   "primary": {"primary_missing"}, "moved": {"path"}, "Upper": {"run_id"}, "nocases": {"cases", "errors_exceed_cases"}, "torn": {"unreadable"}}


def test_json_lines_keep_torn_lines_apart(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"sample_id": "a", "ok": true}\n\n{"sample_id": "b", "ok": false}\n{"sample_id": "c", "o')
    good, torn = readers.json_lines(spark, str(tmp_path), "sample_id string, ok boolean")
    assert [r.sample_id for r in good.collect()] == ["a", "b"] and torn.count() == 1


def test_manifest_ids_default_to_the_row(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"text": "x"}\n{"id": "k", "text": "y"}\n{"text": null}\n')
    got = {r.sample_id: r.references for r in readers.manifest(spark, str(tmp_path / "m.jsonl"), "id string, text string").collect()}
    assert got == {"0": ["x"], "k": ["y"], "2": []}
    assert len(readers.provenance(spark, str(tmp_path / "m.jsonl")).head().sha256) == 16


def test_columnar_samples(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([("a", 1, "big"), ("b", 2, "big")], "text string, level int, image string").coalesce(1).write.parquet(path)
    df = readers.columnar_samples(spark, path, "text", meta=["level"])
    assert [(r.sample_id, r.meta.level) for r in df.collect()] == [("test-0", 1), ("test-1", 2)]
    assert "image" not in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="nope"):
        readers.columnar_samples(spark, path, "nope")


def test_documents_and_side_files(spark, tmp_path):
    leaf = tmp_path / "cat" / "cert"
    (leaf / "ground_truth").mkdir(parents=True)
    docs = [{"id": "d1", "split": "test", "page_count": 1, "pages": [{"page_number": 1, "text": "[LOGO]\nनेपाल", "image_path": "images/d1.png"}]},
            {"id": "d2", "split": "train", "pages": [{"page_number": 1}]}, {"id": "line", "split": "test"}]
    (leaf / "metadata.jsonl").write_text("\n".join(map(json.dumps, docs)))
    (leaf / "ground_truth" / "d1.gt.json").write_text(json.dumps({"id": "d1", "fields": [{"name": "n", "value": "v"}, {"name": "e", "value": " "}]}, indent=1))
    rows = D.select_documents(readers.document_metadata(spark, str(tmp_path)), ["test"])
    assert [r.id for r in rows.collect()] == ["d1"] and rows.head().leaf_path.endswith("/cat/cert")
    gold = readers.side_files(spark, str(tmp_path), ".gt.json", "fields array<struct<name:string,value:string>>")
    fields = gold.select(F.col("file_id").alias("id"), F.posexplode("fields").alias("pos", "f")).select("id", "pos", "f.*")
    assert [(r.question, r.n_fields) for r in D.kv_view(rows, fields).collect()] == [("n", 1)]
    assert D.page_view(rows).head().blocks == ["नेपाल"]
    assert readers.file_listing(spark, str(tmp_path), "*.gt.json").count() == 1
    with pytest.raises(ValueError):
        D.select_documents(rows, ["other"])


SUITE = {
    "z_score.json": ('{"grand total": 640, "grand share": 64.0}', dict(columns=["grand total"]), 640),
    "r_acc.csv": ('"part","Mean","wide, y"\n"all","0.275","0.3"\n', dict(columns=["mean"], multiply="auto"), 27.5),
    "t_score.csv": ('"Skill & level","n","hit"\n"Maps","8","50"\n"Total","40","51.5"\n', dict(columns=["hit"], want_column="Skill & level", want_value="Total"), 51.5),
    "p_score.csv": ('"near","far"\n"210.25","90.5"\n', dict(columns=["near", "far"]), 300.75),
    "q_score.csv": ('"Pass (all)","Pass (any)"\n"12.5%","70%"\n', dict(columns=["Pass (all)"]), 12.5),
    "e_acc.tsv": ("fold\tMean\ntrain\t0.1\nheld, out\t0.305\n", dict(columns=["Mean"], want_column="fold", want_value="held, out", multiply="100"), 30.5),
    "g_acc.csv": ('a,b\n"x\ny ""quoted"", z",6\n3,4\n', dict(columns=["b"]), 6),
    "long_acc.csv": ('note,b\n"' + "w" * 60_000 + '",7\n', dict(columns=["b"]), 7),
}


def test_suite_scores(spark, tmp_path):
    for name, (body, *_rest) in SUITE.items():
        (tmp_path / name).write_text(body)
    cells = readers.score_tables(spark, str(tmp_path)).withColumn("file", F.substring_index("file", "/", -1))
    specs = [(n, n, s["columns"], s.get("want_column"), s.get("want_value"), s.get("multiply", "1")) for n, (_b, s, _v) in SUITE.items()]
    specs = spark.createDataFrame(specs, "file string, bench string, columns array<string>, want_column string, want_value string, multiply string")
    got = {r.bench: r.score for r in suites.headline_scores(cells, specs).collect()}
    assert got == {n: pytest.approx(v) for n, (_b, _s, v) in SUITE.items()}


def test_newest_matching_and_counts(spark):
    at = lambda m: dt.datetime(2026, 1, 1, 0, m)
    files = spark.createDataFrame([("r", "x/a_acc.csv", at(1)), ("r", "x/b_acc.csv", at(5)), ("r", "x/z_score.csv", at(9))], "run string, file string, modified timestamp")
    patterns = spark.createDataFrame([("r", "k", 0, "%nothing"), ("r", "k", 1, "%_acc.csv"), ("r", "k", 2, "%_score.csv")], "run string, bench string, pos int, pattern string")
    assert suites.newest_matching(files, patterns).head().file == "x/b_acc.csv"
    made = spark.createDataFrame([("A",), ("Failed to obtain answer via API.",), (None,)], "prediction string").withColumn("run", F.lit(1))
    assert tuple(suites.prediction_counts(made, ["run"]).head()) == (1, 3, 1)


def test_publish_is_immutable(spark):
    new = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "run_id string, score double")
    old = spark.createDataFrame([("b", 2.0), ("c", 9.0)], "run_id string, score double")
    status = lambda force: {r.run_id: r.status for r in publish.publish_status(new, old, ["run_id", "score"], force).collect()}
    assert status(False) == {"a": "published", "b": "unchanged", "c": "conflict"} and status(True)["c"] == "published"
    gated = publish.gate(spark.createDataFrame([(100, 5), (100, 6), (0, 0)], "cases int, errors int"))
    assert [r.refused for r in gated.collect()] == [False, True, True]


def rating(name, org, value, license_="Proprietary", category="plans", subset="maps_styled", date="2026-03-14"):
    return (subset, name, org, license_, value, value - 5, value + 5, 1.0, 70, 1, category, date)


def test_rating_import(spark):
    rows = [rating("orbit-large-high", "harbor works", 1210.0), rating("tern", "quay lab", 1190.0, "MIT"), rating("plain", "", 1002.0, "-"), rating("late", "quay lab", 1100.0, category="ships", date="2025-05-05"),
            rating("orbit-large-high", "harbor works", 1222.0, subset="maps_raw")]
    rows = spark.createDataFrame(rows, "subset string, model_name string, organization string, license string, rating double, rating_lower double, rating_upper double, variance double, "
                                       "vote_count int, rank int, category string, leaderboard_publish_date string")
    cats = [("plans", "plans", "Plans", "ocr", None), ("ships", "ships", "Ships", "chat", "en")]
    boards = ratings.expand_boards(spark.createDataFrame([("maps", "maps", "Maps", "maps_styled", "maps_raw", cats)],
        "arena string, type string, display_name string, subset_styled string, subset_raw string, categories array<struct<key:string,board:string,label:string,category:string,language:string>>"))
    assert {r.benchmark_id: r.state for r in ratings.board_states(rows, boards).collect()} == {
        "arena-maps-plans": "live", "arena-maps-plans-no-style-control": "live", "arena-maps-ships": "retired", "arena-maps-ships-no-style-control": "empty"}
    got = {r.run_id: r for r in ratings.build_results(rows, boards, "abc").collect()}
    r = got["arena__arena-maps-plans__orbit-large-high__20260314"]
    assert (r.org, r.open_weights, r.cases, tuple(r.metrics["arena_score"])) == ("Harbor Works", False, 70, (1210, 1205, 1215))
    plain = got["arena__arena-maps-plans__plain__20260314"]
    assert plain.open_weights is None and plain.org == "Unknown" and got["arena__arena-maps-plans__tern__20260314"].open_weights
    assert len(got) == 4


def test_prices(spark, tmp_path):
    listing = [{"id": "acme/quill-2", "context_length": 640, "pricing": {"prompt": "0.000004", "completion": "0.00002"}}, {"id": "acme/quill-2:batch", "pricing": {"prompt": "0"}},
               {"id": "b/tern", "pricing": {"prompt": "-1", "completion": "y"}, "top_provider": {"context_length": 9}}, {"id": "~alias/tern"}, {"id": "acme/quill-2-20240202", "pricing": {"prompt": "1"}}]
    (tmp_path / "list.json").write_text(json.dumps({"data": listing}, indent=1))
    models = spark.createDataFrame([("quill", "Quill 2 (high)", None), ("tern", "unheard of", None), ("p", "P", "openrouter:b/tern"), ("gratis", "tern", None), ("given", "qqq", None), ("none", "rrr", None)],
                                   "model_id string, display_name string, endpoint string")
    over = spark.createDataFrame([("gratis", "none", None, None, None, None), ("given", None, None, 3.5, None, 11)],
                                 "model_id string, pricing string, openrouter string, input_price double, output_price double, context_length bigint")
    got = {r.model_id: tuple(r)[1:] for r in prices.resolve(models, readers.price_list(spark, str(tmp_path / "list.json")), over).collect()}
    assert got == {"quill": (4.0, 20.0, 640, "openrouter:acme/quill-2"), "tern": (None, None, 9, "openrouter:b/tern"), "p": (None, None, 9, "openrouter:b/tern"), "given": (3.5, None, 11, "catalog")}


def test_ids_do_not_depend_on_splits(spark, tmp_path):
    for name, n in (("a", 1), ("b", 900), ("c", 3)):  # files of unequal size: scans take the largest first
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"text": f"{name}{i} " + "x" * 40}) + "\n" for i in range(n)))
    seen = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("2000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            seen.append({r.sample_id: r.references[0].split()[0] for r in readers.manifest(spark, str(tmp_path), "text string").collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {str(i): x for i, x in enumerate(["a0", *(f"b{i}" for i in range(900)), "c0", "c1", "c2"])}
    assert seen == [want, want]


def test_dates(spark):
    given = {"2026": None, "2026-10": None, "12:30": None, "2026-10-02": "2026-10-02 00:00:00", "2026-10-02T01:00:00+01:00": "2026-10-02 00:00:00", "soon": None}
    rows = spark.createDataFrame([(k,) for k in given], "d string").select("d", parse_date(F.col("d")).cast("string").alias("t"))
    assert {r.d: r.t for r in rows.collect()} == given


def test_a_batch_may_contradict_itself(spark):
    rows = [("a", {"x": 1.0, "y": 2.0}), ("a", {"y": 2.0, "x": 1.0}), ("b", {"x": 1.0}), ("b", {"x": 2.0}), ("c", {"x": 1.0})]
    new = spark.createDataFrame(rows, "run_id string, metrics map<string,double>")
    old = spark.createDataFrame([("c", {"x": 1.0})], new.schema)
    got = sorted((r.run_id, r.status) for r in publish.publish_status(new, old, ["run_id", "metrics"], force=True).collect())
    assert got == [("a", "published"), ("a", "unchanged"), ("b", "conflict"), ("b", "conflict"), ("c", "unchanged")]


def test_current_skips_gaps(spark, tmp_path):
    for version in (0, 1, 3, 10):
        spark.range(version).write.parquet(f"{tmp_path}/batch={version:09d}")
    assert jobs.current(spark, str(tmp_path)).count() == 10


def test_run_keys_come_from_folders(spark, tmp_path):
    rows = spark.createDataFrame([("a b:c+d%", "s", True)], "run_key string, sample_id string, ok boolean")
    writers.append_predictions(rows, str(tmp_path))
    assert [(r.run_key, r.sample_id) for r in readers.prediction_log(spark, str(tmp_path)).collect()] == [("a b:c+d%", "s")]


def test_bootstrap_tracks_the_normal_interval(spark):
    rng = random.Random(1)
    values = [rng.random() for _ in range(400)]
    rows = [("r", str(i), v, f"d{i // 4}") for i, v in enumerate(values)] + [("one", "x", 0.25, None)]
    df = spark.createDataFrame(rows, "run string, sample_id string, value double, doc string")
    got = {r.run: r for r in bootstrap.bootstrap_ci(df, ["run"]).collect()}
    mean = sum(values) / len(values)
    error = (sum((v - mean) ** 2 for v in values) / len(values) / len(values)) ** 0.5
    assert got["r"].mean == pytest.approx(mean) and got["r"].ci_low == pytest.approx(mean - 1.96 * error, abs=error * 0.3)
    assert got["r"].ci_high == pytest.approx(mean + 1.96 * error, abs=error * 0.3) and (got["one"].ci_low, got["one"].ci_high) == (0.25, 0.25)
    # Identical values within a document: clusters give a wider interval than samples.
    same = df.filter("run = 'r'").withColumn("value", F.conv(F.substr(F.md5("doc"), F.lit(1), F.lit(4)), 16, 10).cast("double"))
    wide, thin = (bootstrap.bootstrap_ci(same, ["run"], cluster=c).head() for c in ("doc", None))
    assert wide.ci_high - wide.ci_low > 1.5 * (thin.ci_high - thin.ci_low)


def test_predict_records_errors_and_stops_on_fatal(spark):
    samples = spark.createDataFrame([("a", "q"), ("b", "")], "sample_id string, question string")

    def fn(s):
        if not s["question"]:
            raise ValueError("empty")
        return {"output": s["question"].upper()}

    got = {r.sample_id: (r.ok, r.output, r.error) for r in P.predict(samples, fn).collect()}
    assert got == {"a": (True, "Q", None), "b": (False, None, "ValueError: empty")}

    def fatal(_):
        raise P.FatalPredictionError("bad key")

    with pytest.raises(Exception, match="bad key"):
        P.predict(samples, fatal).collect()


def test_streams_equal_their_batch_jobs(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"r{i % 2}", f"s{rng.randint(0, 9)}", i, rng.random() < 0.4) for i in range(120)]
    df = spark.createDataFrame(rows, "run_key string, sample_id string, seq bigint, ok boolean")
    src = str(tmp_path / "src")
    for i in range(4):
        df.filter(F.floor(F.col("seq") / 30) == i).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):  # a second start has nothing new to do
        for q in (jobs.watch_failures(jobs.file_stream(spark, src, df.schema), str(tmp_path / "w"), str(tmp_path / "c1"), limit=4),
                  jobs.keep_latest(jobs.file_stream(spark, src, df.schema), str(tmp_path / "l"), str(tmp_path / "c2"), buckets=2)):
            q.awaitTermination()
            assert q.exception() is None
    want = {r.run_key: (r.longest, r.aborted_at) for r in P.tripped_runs(df, 4).collect()}
    assert {r.run_key: (r.longest, r.aborted_at) for r in jobs.current(spark, str(tmp_path / "w")).collect()} == want
    latest = {(r.run_key, r.sample_id): r.seq for r in P.latest_records(df).collect()}
    assert {(r.run_key, r.sample_id): r.seq for r in spark.read.parquet(str(tmp_path / "l")).collect()} == latest


def test_drill_down_export(spark, tmp_path):
    latest = spark.createDataFrame([("r", "a", True, "x", 0.5)], "run_key string, sample_id string, ok boolean, output string, latency_s double")
    scores = spark.createDataFrame([("r", "a", True, {"cer": 0.0}), ("r", "b", False, {"cer": 1.0})], "run_key string, sample_id string, ok boolean, scores map<string,double>")
    rows = writers.drill_down_rows(scores, latest)
    assert rows.columns[1:] == list(writers.SAMPLE_COLUMNS) and rows.count() == 2
    writers.write_drill_down(rows, str(tmp_path))
    assert list((tmp_path / "samples" / "run_key=r").glob("*.json.gz"))


def result_line(run, model, score, bench="b1", **more):
    doc = {"schema_version": 1, "run_id": run, "created_at": "2026-01-02T00:00:00Z", "model": {"id": model, "display_name": model, "kind": "vlm"},
           "benchmark": {"id": bench, "display_name": bench, "category": "ocr", "primary_metric": "acc", "higher_is_better": True, "scale_max": 100.0, "full_cases": 10, "version": "1", "cases_unit": "cases"},
           "source": {"kind": "measured", "harness": "h"}, "cases": 10, "errors": 0, "metrics": {"acc": {"value": score}}}
    return json.dumps(doc | more)


def test_polling_applies_what_went_away(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    shown = lambda: {(r.benchmark_id, r.model_id): (r.score, r.position) for r in jobs.live(spark, store, "boards").collect()}
    bad = lambda: [r.run_id for r in jobs.current(spark, f"{store}/quarantine").collect()]
    (source / "a.json").write_text(result_line("r1", "m1", 50.0) + "\n" + result_line("r2", "m2", 60.0))
    (source / "b.json").write_text(result_line("r3", "m3", 70.0) + "\n" + result_line("r4", "m4", 10.0, "b2") + "\n" + result_line("r9", "m9", 1.0, cases=-1) + "\n{torn")
    assert jobs.poll_store(spark, str(source), store) == 1
    assert shown() == {("b1", "m1"): (50.0, 3), ("b1", "m2"): (60.0, 2), ("b1", "m3"): (70.0, 1), ("b2", "m4"): (10.0, 1)}
    assert sorted(bad(), key=str) == [None, "r9"]
    assert jobs.poll_store(spark, str(source), store) is None
    (source / "b.json").unlink()  # b2 loses its only row, the quarantine its file
    (source / "a.json").write_text(result_line("r1", "m1", 55.5))
    (source / "c.json").write_text(result_line("r5", "m5", 99.0))
    # A look that died before its last write left data behind; it is repeated under the same number.
    spark.range(1).write.parquet(f"{store}/results/batch=2/benchmark_id=b1")
    assert jobs.poll_store(spark, str(source), store) == 2
    assert shown() == {("b1", "m1"): (55.5, 2), ("b1", "m5"): (99.0, 1)} and bad() == []
    (source / "a.json").unlink()
    (source / "c.json").unlink()
    (source / "d.json").write_text("")
    assert jobs.poll_store(spark, str(source), store) == 3 and shown() == {}


def test_written_files_are_whole(spark, tmp_path):
    rows = spark.createDataFrame([("x y/a.json", "é{}"), ("x y/z/b.txt", ""), ("c", "1\n2")], "path string, text string")
    done = writers.write_files(rows, f"file:{tmp_path}").collect()
    assert {(r.path, r.bytes) for r in done} == {("x y/a.json", 4), ("x y/z/b.txt", 0), ("c", 3)}
    assert (tmp_path / "x y/a.json").read_text() == "é{}" and not list(tmp_path.rglob("_*"))
    writers.write_files(rows, str(tmp_path)).collect()
    assert sum(p.is_file() for p in tmp_path.rglob("*")) == 3


def test_published_results_are_stored_compressed(spark, tmp_path):
    """A JSON line repeats every field name, so a store of plain lines is many times its content."""
    rows = spark.range(50).selectExpr("cast(id as string) AS run_id", "cast(null as string) AS note")
    writers.write_results(rows, str(tmp_path))
    files = list((tmp_path / "runs").glob("part-*"))
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert spark.read.json(f"{tmp_path}/runs").count() == 50


def test_a_benchmark_is_stored_by_several_tasks(spark):
    rows = spark.range(2000).selectExpr("'one' AS benchmark_id", "cast(id as string) AS run_id")
    sizes = [r["n"] for r in rows.repartition(8, "benchmark_id", jobs._share("run_id")).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 2000 and max(sizes) < 1500
