"""Prediction logs, validation, publishing, imports, prices, catalog and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from scorelake import schemas as S
from scorelake.operators import board as B
from scorelake.operators import catalog as C
from scorelake.operators import docviews as D
from scorelake.operators import predictions as P
from scorelake.operators import prices as R
from scorelake.operators import publish as U
from scorelake.operators import ratings as G
from scorelake.operators import suites as Z
from scorelake.plans.evaluation import BenchmarkSpec, evaluate
from scorelake.plans.queries.boards import RANKED, comparable
from scorelake.plans.queries.boards import results as flat_results
from scorelake.plans.workload import query
from scorelake.session import freed, materialise, parts, remove, scratch, shared_folder, spread
from scorelake.sources import readers, writers
from scorelake.streaming import jobs


def _folder(t, name):
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_key, sample_id ORDER BY seq DESC) AS rn FROM {prediction_log}) x WHERE rn = 1)"""


@query("w_latest_record", f"WITH {LATEST} SELECT run_key, sample_id, seq, ok, latency_s FROM latest")
def w_latest_record(t):
    return P.latest_records(t.prediction_log).select("run_key", "sample_id", "seq", "ok", "latency_s")


@query("src_prediction_log", f"WITH {LATEST} SELECT run_key, sample_id, seq, ok FROM latest")
def src_prediction_log(t):
    """The log written as JSON lines with a torn line after it, read back and folded."""
    path = _folder(t, "log")
    log = t.prediction_log.select("run_key", "sample_id", "seq", "ok", "output", "latency_s")
    writers.append_predictions(log, path)
    t.prediction_log.groupBy("run_key").agg(F.lit('{"sample_id": "torn", "se').alias("value")).select("value").coalesce(1).write.mode("append").text(f"{path}/run_key=torn")
    return P.latest_records(readers.prediction_log(t.spark, path)).select("run_key", "sample_id", "seq", "ok")


@query("j_resume", f"""WITH {LATEST} SELECT s.run_key, s.sample_id, l.ok IS NOT NULL AS retry FROM {{log_samples}} s LEFT JOIN latest l
    ON s.run_key = l.run_key AND s.sample_id = l.sample_id WHERE l.ok IS NULL OR NOT l.ok""")
def j_resume(t):
    return P.remaining_samples(t.log_samples, P.latest_records(t.prediction_log)).select("run_key", "sample_id", "retry")


@query("v_duplicate_ids", "SELECT run_key, sample_id, count(*) AS n FROM {prediction_log} GROUP BY ALL HAVING count(*) > 1")
def v_duplicate_ids(t):
    return P.duplicate_ids(t.prediction_log)


@query("v_completeness", f"""WITH {LATEST}, e AS (SELECT run_key, count(*) AS expected FROM {{log_samples}} GROUP BY ALL), h AS (SELECT run_key, count(*) AS records FROM latest GROUP BY ALL)
    SELECT run_key, expected, coalesce(records, 0) AS records, CASE WHEN coalesce(records, 0) = 0 THEN 'no predictions' WHEN records < expected THEN 'incomplete' ELSE 'complete' END AS state FROM e LEFT JOIN h USING (run_key)""")
def v_completeness(t):
    expected = t.log_samples.groupBy("run_key").agg(F.count("*").alias("expected"))
    return P.completeness(P.latest_records(t.prediction_log), expected).select("run_key", "expected", "records", "state")


_STREAKS = """runs AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY run_key ORDER BY seq) AS island FROM {prediction_log}),
    streaks AS (SELECT run_key, seq, CASE WHEN ok THEN 0 ELSE count(*) FILTER (NOT ok) OVER (PARTITION BY run_key, island ORDER BY seq) END AS streak FROM runs)"""


@query("w_failure_streaks", f"WITH {_STREAKS} SELECT run_key, seq, streak FROM streaks")
def w_failure_streaks(t):
    return P.failure_streaks(t.prediction_log).select("run_key", "seq", "streak")


@query("w_tripped_runs", f"WITH {_STREAKS} SELECT run_key, max(streak) AS longest, min(CASE WHEN streak >= 3 THEN seq END) AS aborted_at FROM streaks GROUP BY ALL")
def w_tripped_runs(t):
    return P.tripped_runs(t.prediction_log, limit=3)


@query("l_seeded_subset", "SELECT doc_id, source FROM {documents} ORDER BY md5('7:' || cast(doc_id AS string)), doc_id LIMIT 100")
def l_seeded_subset(t):
    return P.seeded_subset(t.documents.select("doc_id", "source"), 100, 7, "doc_id")


@query("src_columnar", "SELECT 'doc-' || cast(doc_id AS string) AS sample_id, md5(text) AS reference, lang FROM {documents}")
def src_columnar(t):
    df = readers.columnar_samples(t.spark, f"{t.folder}/documents.parquet", "text", "doc_id", meta=["lang"])
    return df.select(F.concat(F.lit("doc-"), "sample_id").alias("sample_id"), F.md5(F.element_at("references", 1)).alias("reference"), F.col("meta.lang").alias("lang"))


@query("src_manifest", "SELECT cast(conv_id AS string) || '-' || cast(turn AS string) AS sample_id, md5(text) AS reference, role FROM {conversations}")
def src_manifest(t):
    path = _folder(t, "manifest")
    t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", "role").write.json(path)
    df = readers.manifest(t.spark, path, "id string, text string, role string", meta=["role"])
    return df.select("sample_id", F.md5(F.element_at("references", 1)).alias("reference"), F.col("meta.role").alias("role"))


@query("src_assets", """SELECT 'd' || cast(doc_id AS string) AS id, CASE doc_id % 3 WHEN 0 THEN 'leaf/a' || cast(doc_id AS string) || '.png' WHEN 1 THEN 'root/a' || cast(doc_id AS string) || '.png' END AS path FROM {documents}""")
def src_assets(t):
    name = F.concat(F.lit("a"), F.col("doc_id"), F.lit(".png"))
    wanted = t.documents.select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), D.asset_candidates(name, F.lit("leaf"), F.lit("root")).alias("candidates"))
    kind = F.col("doc_id") % 3
    files = t.documents.select(F.when(kind == 0, F.concat(F.lit("leaf/"), name)).when(kind == 1, F.concat(F.lit("root/"), name)).alias("path")).union(
        t.documents.filter(kind == 0).select(F.concat(F.lit("root/"), name))).filter("path IS NOT NULL")
    return D.resolve_assets(wanted, files)


@query("snk_drill_down", """SELECT run_key, sample_id, ok, CASE WHEN ok THEN length(output) END AS chars, finish_reason FROM {answers}""")
def snk_drill_down(t):
    """Scores joined with predictions, written as gzip JSON lines and read back."""
    path = _folder(t, "store")
    latest = t.answers.withColumns({"sample_id": F.col("sample_id").cast("string"), "references": F.array("reference"), "seq": F.lit(0)})
    scores = latest.select("run_key", "sample_id", "ok", F.create_map(F.lit("ok"), F.col("ok").cast("double")).alias("scores"))
    rows = writers.drill_down_rows(scores, latest)
    first = F.col("run_key") == "model-0"
    for part in (rows.filter(first), rows.filter(~first), rows.filter(first)):  # later writes leave other runs alone
        writers.write_drill_down(part, path)
    schema = "sample_id string, ok boolean, output string, finish_reason string"
    runs = [readers.drill_down(t.spark, path, f"model-{k}", schema) for k in range(4)]
    back = runs[0].unionByName(runs[1]).unionByName(runs[2]).unionByName(runs[3])
    return back.select("run_key", F.col("sample_id").cast("bigint").alias("sample_id"), "ok", F.length("output").alias("chars"), "finish_reason")


@query("f_drill_down", """SELECT sample_id, run_key FROM {answers} WHERE NOT ok AND lang = 'en' ORDER BY latency_s DESC, sample_id, run_key LIMIT 50 OFFSET 5""")
def f_drill_down(t):
    rows, order = B.drill_down(t.answers, ["latency_s"], ok=False, group=("lang", "en", False), sort="latency_s")
    return B.page(rows, [*order, F.col("run_key").asc()], 50, 5, 200).select("sample_id", "run_key")


# --- validation and publishing ------------------------------------------------------------


def _stored(t):
    """Nested results, a share of them broken in one way each."""
    r, k = flat_results(t), F.col("cases") + F.col("errors") * 7
    none = F.lit(None)
    model = F.struct(F.when(k % 17 == 3, F.upper("model_id")).otherwise(F.col("model_id")).alias("id"), F.col("display_name"), F.col("org"), F.col("model_kind").alias("kind"),
                     F.col("open_weights"), none.cast("double").alias("params_b"), *[none.cast("string").alias(c) for c in ("license", "url", "endpoint")])
    bench = F.struct(F.col("benchmark_id").alias("id"), F.col("benchmark_id").alias("display_name"), "category", *[none.cast("string").alias(c) for c in ("description", "url", "language")],
                     F.when(k % 17 == 5, "gone").otherwise(F.col("primary_metric")).alias("primary_metric"), "higher_is_better", F.when(k % 17 == 7, -1.0).otherwise(F.col("scale_max")).alias("scale_max"),
                     "full_cases", "version", none.cast("string").alias("board"), none.cast("boolean").alias("style_control"), F.lit("cases").alias("cases_unit"))
    source = F.struct(F.col("source_kind").alias("kind"), F.lit("h").alias("harness"), *[none.cast("string").alias(c) for c in ("harness_version", "url", "judge", "notes", "data_license", "attribution")])
    day = F.date_format("created_at", "yyyy-MM-dd'T'00:00:00")
    return r.select(F.lit(1).alias("schema_version"), "run_id", F.when(k % 17 == 9, day).otherwise(F.concat(day, F.lit("Z"))).alias("created_at"), model.alias("model"), bench.alias("benchmark"),
                    source.alias("source"), "cases", "errors", "metrics")


_PROBLEMS = """WITH p AS (SELECT run_id, CASE (cases + errors * 7) % 17 WHEN 3 THEN 'model_id' WHEN 5 THEN 'primary_missing' WHEN 7 THEN 'scale_max' WHEN 9 THEN 'created_at' END AS a,
        CASE WHEN errors > cases THEN 'errors_exceed_cases' END AS b FROM {results})
    SELECT run_id, CASE WHEN a IN ('primary_missing', 'created_at') THEN concat_ws(',', b, a) ELSE concat_ws(',', a, b) END AS problems FROM p WHERE a IS NOT NULL OR b IS NOT NULL"""


@query("v_results", _PROBLEMS)
def v_results(t):
    checked = _stored(t).select("run_id", S.result_problems().alias("p")).filter(F.size("p") > 0)
    return checked.select("run_id", F.array_join("p", ",").alias("problems"))


@query("v_publish_gate", "SELECT run_id, CASE WHEN cases > 0 THEN errors / cases ELSE 1 END > 0.05 AS refused FROM {results}")
def v_publish_gate(t):
    return U.gate(t.results).select("run_id", "refused")


@query("snk_publish", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id, model_id, score, cases) AS copy FROM {results}),
    torn AS (SELECT run_id FROM r WHERE copy = 1 GROUP BY run_id HAVING count(*) > 1)
    SELECT CASE WHEN run_id IN (FROM torn) THEN 'conflict' WHEN copy > 1 THEN 'unchanged'
        ELSE CASE cast(substr(model_id, 3) AS int) % 3 WHEN 0 THEN 'published' WHEN 1 THEN 'unchanged' ELSE 'conflict' END END AS status, count(*) AS n FROM r GROUP BY 1""")
def snk_publish(t):
    new = t.results.select("run_id", "model_id", "score", "cases")
    kind = F.regexp_extract("model_id", "\\d+", 0).cast("int") % 3
    old = new.filter(kind > 0).withColumn("score", F.when(kind == 1, F.col("score")).otherwise(F.col("score") + 1)).dropDuplicates(["run_id"])
    return U.status_counts(U.publish_status(new, old, ["run_id", "model_id", "score", "cases"]))


@query("snk_publish_roundtrip", """WITH r AS (SELECT run_id, (cases + errors * 7) % 17 AS k, CASE WHEN cases > 0 THEN errors / cases ELSE 1 END > 0.05 AS refused, errors > cases AS torn FROM {results})
    SELECT run_id FROM r WHERE k NOT IN (3, 5, 7, 9) AND NOT torn AND NOT refused GROUP BY run_id HAVING count(*) = 1 AND max(k) <> 1""")
def snk_publish_roundtrip(t):
    """Three batches into a store. The first holds some runs with two contents (conflict); the second
    repeats all with their maps in another order (unchanged) beside a contradiction (conflict); the third
    repeats them alone. What is read back is what the first published."""
    path, k = _folder(t, "store"), (F.col("cases") + F.col("errors") * 7) % 17
    with scratch(t.spark):
        batch = materialise(_stored(t).withColumn("_k", k))
        other = batch.withColumn("created_at", F.lit("2020-02-02T00:00:00Z"))
        U.publish(batch.unionByName(other.filter("_k = 1")).drop("_k"), path)
        turned = batch.filter("_k <> 1").withColumn("metrics", F.map_from_entries(F.reverse(F.map_entries("metrics")))).drop("_k")
        U.publish(turned.unionByName(other.filter("_k NOT IN (1, 9)").drop("_k")), path)
        U.publish(turned, path)
    return readers.result_store(t.spark, path)[0].select("run_id")


def _in_order(t):
    """Documents in ranges of their order: file names follow it, with several files a source."""
    rows = t.documents.select("source", "doc_id", "text")
    return rows.repartitionByRange(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "source", "doc_id").sortWithinPartitions("source", "doc_id")


@query("src_manifest_ids", "SELECT cast(row_number() OVER (ORDER BY source, doc_id) - 1 AS string) AS sample_id, md5(text) AS reference FROM {documents}")
def src_manifest_ids(t):
    """Default ids over files of unequal size: the row's place in path order, whatever the splits."""
    path = _folder(t, "manifest")
    _in_order(t).write.partitionBy("source").json(path)
    df = readers.manifest(t.spark, path, "text string")
    return df.select("sample_id", F.md5(F.element_at("references", 1)).alias("reference"))


@query("src_columnar_ids", "SELECT 'test-' || cast(row_number() OVER (ORDER BY source, doc_id) - 1 AS string) AS sample_id, md5(text) AS reference FROM {documents}")
def src_columnar_ids(t):
    path = _folder(t, "columnar")
    _in_order(t).write.partitionBy("source").parquet(path)
    return readers.columnar_samples(t.spark, path, "text").select("sample_id", F.md5(F.element_at("references", 1)).alias("reference"))


@query("v_import", """SELECT coalesce(reason, 'ok') AS reason, count(*) AS n, cast(sum(cases) AS bigint) AS cases, count(DISTINCT run_id) AS runs FROM (
    SELECT CASE WHEN p_size % 10 = 0 THEN 'unknown benchmark' WHEN l_linenumber = 1 AND l_quantity < 20 THEN 'no score' WHEN l_quantity > 40 THEN 'score outside scale'
                WHEN l_linenumber = 2 THEN 'unreadable date' END AS reason, CASE WHEN p_size % 10 = 0 AND l_linenumber = 3 THEN 0 WHEN l_linenumber = 3 THEN 40 ELSE l_linenumber END AS cases,
           CASE WHEN p_size % 10 <> 0 AND NOT (l_linenumber = 1 AND l_quantity < 20) AND l_quantity <= 40 AND l_linenumber <> 2 THEN cast(l_suppkey AS string) || p_brand || cast(l_shipdate AS string) END AS run_id
    FROM {lineitem} JOIN {part} ON l_partkey = p_partkey) x GROUP BY 1""")
def v_import(t):
    return _imported(t).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(
        F.count("*").alias("n"), F.sum("cases").alias("cases"), F.count_distinct(F.when(F.col("reason").isNull(), F.col("run_id"))).alias("runs"))


def _imported(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    bench = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    entries = rows.select(
        F.concat(F.lit("m-"), F.col("l_suppkey")).alias("model_id"), F.when(F.col("p_size") % 10 == 0, "nowhere").otherwise(F.upper(bench)).alias("benchmark"),
        F.when((F.col("l_linenumber") == 1) & (F.col("l_quantity") < 20), "n/a").otherwise(F.col("l_quantity").cast("string")).alias("score"),
        F.create_map(F.lit("x"), F.col("l_tax"), F.lit("y"), F.lit(None).cast("double")).alias("metrics"), F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")).otherwise(0).cast("bigint").alias("cases"),
        F.when(F.col("l_linenumber") == 2, "someday").otherwise(F.date_format("l_shipdate", "yyyy/MM/dd")).alias("date"), F.lit("board x").alias("harness"))
    catalog = t.part.select(bench.alias("benchmark_id")).distinct().withColumns(
        {"primary_metric": F.lit("score"), "scale_max": F.lit(40.0), "full_cases": F.lit(40).cast("bigint")})
    return U.build_imported(entries, catalog)


@query("a_import_counts", """WITH r AS (SELECT CASE WHEN p_size % 10 = 0 OR (l_linenumber = 1 AND l_quantity < 20) OR l_quantity > 40 OR l_linenumber = 2 THEN 'failed' END AS bad,
        cast(l_suppkey AS string) || p_brand || cast(l_shipdate AS string) AS id, l_quantity AS q FROM {lineitem} JOIN {part} ON l_partkey = p_partkey),
    good AS (SELECT id, q, count(*) AS n FROM r WHERE bad IS NULL GROUP BY ALL), torn AS (SELECT id FROM good GROUP BY id HAVING count(*) > 1)
    SELECT status, cast(sum(n) AS bigint) AS n FROM (
        SELECT 'failed' AS status, count(*) AS n FROM r WHERE bad IS NOT NULL UNION ALL SELECT 'failed', sum(n) FROM good WHERE id IN (FROM torn)
        UNION ALL SELECT 'published', count(*) FROM good WHERE id NOT IN (FROM torn) UNION ALL SELECT 'unchanged', sum(n - 1) FROM good WHERE id NOT IN (FROM torn)) x GROUP BY 1 HAVING sum(n) > 0""")
def a_import_counts(t):
    """A whole import into an empty store: entries that contradict each other fail."""
    imported = _imported(t)
    return U.import_counts(imported, imported.limit(0), ["run_id", "score"])


@query("u_last_models", """SELECT 'm-' || cast(l_suppkey AS string) AS model_id, arg_max(l_partkey, cast(l_orderkey AS bigint) * 10 + l_linenumber) AS endpoint FROM {lineitem} GROUP BY l_suppkey""")
def u_last_models(t):
    seen = t.lineitem.select(F.concat(F.lit("m-"), F.col("l_suppkey")).alias("model_id"), F.col("l_partkey").alias("endpoint"), (F.col("l_orderkey").cast("bigint") * 10 + F.col("l_linenumber")).alias("at"))
    return R.last_given(seen, "at")


@query("j_store_diff", """WITH o AS (SELECT doc_id, n_chars % 5 AS v FROM {documents} WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, n_chars % 5 + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS v FROM {documents} WHERE doc_id % 5 <> 0)
    SELECT coalesce(o.doc_id, n.doc_id) AS key, CASE WHEN n.doc_id IS NULL THEN 'removed' WHEN o.doc_id IS NULL THEN 'added' ELSE 'changed' END AS change
    FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE n.doc_id IS NULL OR o.doc_id IS NULL OR o.v <> n.v""")
def j_store_diff(t):
    d, v = t.documents.withColumnRenamed("doc_id", "key"), F.col("n_chars") % 5
    old = d.filter("key % 7 <> 0").select("key", v.alias("version"))
    new = d.filter("key % 5 <> 0").select("key", (v + F.when(F.col("key") % 4 == 0, 1).otherwise(0)).alias("version"))
    return U.store_diff(old, new)


# --- ratings ------------------------------------------------------------------------------

_ARENA_SQL = """snaps AS (SELECT o_orderkey, o_orderstatus AS subset, lower(substr(o_orderpriority, 3)) AS category, o_totalprice / 1000 AS rating, o_custkey,
        strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS day FROM {orders} WHERE NOT (o_orderpriority = '5-LOW' AND o_orderdate >= TIMESTAMP '2001-01-01'))"""


def _snapshots(t):
    keep = ~((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")))
    key, rating = F.col("o_orderkey"), F.col("o_totalprice") / 1000
    return t.orders.filter(keep).select(
        F.col("o_orderstatus").alias("subset"), F.concat(F.lit(" Model_"), key, F.lit(" ")).alias("model_name"), F.when(key % 3 == 0, "ZAI").when(key % 3 == 1, "new lab").alias("organization"),
        F.when(key % 4 == 0, "-").when(key % 4 == 1, "Proprietary").otherwise("MIT").alias("license"), rating.alias("rating"), (rating - 5).alias("rating_lower"),
        F.when(key % 5 != 0, rating + 5).alias("rating_upper"), F.lower(F.substr("o_orderpriority", F.lit(3))).alias("category"), F.col("o_custkey").alias("vote_count"),
        F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd").alias("leaderboard_publish_date"))


def _boards(t):
    arenas = t.orders.select(F.col("o_orderstatus").alias("s")).distinct()
    keys = ["urgent", "high", "low", "nothing"]
    cats = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(k).alias("board"), F.lit(k).alias("label"), F.lit("general").alias("category"), F.lit(None).cast("string").alias("language")) for k in keys])
    return G.expand_boards(arenas.select(F.lower("s").alias("arena"), F.lit("vision").alias("type"), F.col("s").alias("display_name"), F.col("s").alias("subset_styled"),
                                         F.concat("s", F.lit("-raw")).alias("subset_raw"), cats.alias("categories")))


@query("a_board_states", f"""WITH {_ARENA_SQL}, b AS (SELECT DISTINCT o_orderstatus AS s, unnest(['urgent', 'high', 'low', 'nothing']) AS c FROM {{orders}}),
    styles AS (SELECT s, c, unnest([true, false]) AS styled FROM b)
    SELECT 'arena-' || lower(s) || '-' || c || CASE WHEN styled THEN '' ELSE '-no-style-control' END AS benchmark_id,
        CASE WHEN NOT styled OR m.mine IS NULL THEN 'empty' WHEN m.mine < n.newest THEN 'retired' ELSE 'live' END AS state
    FROM styles LEFT JOIN (SELECT subset, max(day) AS newest FROM snaps GROUP BY 1) n ON s = n.subset LEFT JOIN (SELECT subset, category, max(day) AS mine FROM snaps GROUP BY 1, 2) m ON s = m.subset AND c = m.category""")
def a_board_states(t):
    return G.board_states(_snapshots(t), _boards(t)).select("benchmark_id", "state")


@query("p_rating_results", f"""WITH {_ARENA_SQL} SELECT 'arena__arena-' || lower(s.subset) || '-' || category || '__model-' || cast(o_orderkey AS string) || '__' || replace(day, '-', '') AS run_id,
        CASE o_orderkey % 3 WHEN 0 THEN 'Z.ai' WHEN 1 THEN 'New Lab' ELSE 'Unknown' END AS org, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS open_weights,
        round(rating, 6) AS rating, CASE WHEN o_orderkey % 5 <> 0 THEN round(rating - 5, 6) END AS ci_low, o_custkey AS cases FROM snaps s JOIN
        (SELECT subset, category, max(day) AS mine FROM snaps GROUP BY 1, 2) m USING (subset, category) JOIN (SELECT subset, max(day) AS newest FROM snaps GROUP BY 1) n USING (subset)
        WHERE category IN ('urgent', 'high', 'low') AND mine = newest""")
def p_rating_results(t):
    out = G.build_results(_snapshots(t), _boards(t))
    value = F.element_at("metrics", G.RATING_METRIC)
    return out.select("run_id", "org", "open_weights", F.round(value["value"], 6).alias("rating"), F.round(value["ci_low"], 6).alias("ci_low"), "cases")


@query("u_results_union", f"""WITH s AS (SELECT s_suppkey AS k FROM {{supplier}}), {_ARENA_SQL}, live AS (SELECT s.* FROM snaps s JOIN (SELECT subset, category, max(day) AS mine FROM snaps GROUP BY 1, 2) m USING (subset, category)
        JOIN (SELECT subset, max(day) AS newest FROM snaps GROUP BY 1) n USING (subset) WHERE category IN ('urgent', 'high', 'low') AND mine = newest AND o_custkey > 0)
    SELECT 'plain' AS benchmark_id, 'measured' AS source_kind, count(DISTINCT run_key) AS n FROM {{answers}}
    UNION ALL SELECT 'brand-import', 'imported', count(*) FROM s WHERE k % 50 <= 40
    UNION ALL SELECT 'suite-a', 'measured', count(*) FROM s WHERE k % 20 < 19
    UNION ALL SELECT 'rated', 'imported', count(*) FROM live""")
def u_results_union(t):
    """Measured runs, imports, suites and ratings in one stored shape, published and read back as boards' rows."""
    path, at = _folder(t, "store"), F.lit("2026-01-02").cast("timestamp")
    k = F.col("s_suppkey")
    log = t.answers.withColumns({"references": F.array("reference"), "seq": F.lit(0)}).select("run_key", "sample_id", "seq", "ok", "output", "references")
    measured, _ = evaluate(BenchmarkSpec("plain", "exact_match", ("exact_match",), postprocess=False), log)
    catalog = t.spark.createDataFrame([("brand-import", "score", 40.0, 10, "ocr"), ("suite-a", "acc", 100.0, 20, "math")], "benchmark_id string, primary_metric string, scale_max double, full_cases bigint, category string")
    entries = t.supplier.select(F.concat(F.lit("m-"), k).alias("model_id"), F.lit("Brand-Import").alias("benchmark"), (k % 50).cast("string").alias("score"), F.create_map(F.lit("x"), F.lit(1.0)).alias("metrics"),
                                F.lit(10).cast("bigint").alias("cases"), F.lit("2026-01-02").alias("date"), F.lit("h").alias("harness"))
    suite = t.supplier.select(F.concat(F.lit("m-"), k).alias("model_id"), F.lit("suite-a").alias("bench"), F.when(k % 20 == 19, 101.0).otherwise(100.005).alias("score"), F.lit(20).cast("bigint").alias("cases"), F.lit(1).cast("bigint").alias("failed"), at.alias("created_at"))
    flat = [measured, U.build_imported(entries, catalog), Z.build_results(suite, catalog), G.build_results(_snapshots(t), _boards(t)).withColumn("category", F.lit("ocr"))]
    rows = [S.nest_results(f.filter("reason IS NULL") if "reason" in f.columns else f) for f in flat]
    U.publish(rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]), path)
    back = S.flatten_results(readers.result_store(t.spark, path)[0])
    bench = F.when(F.col("benchmark_id").startswith("arena-"), "rated").otherwise(F.col("benchmark_id"))
    return back.groupBy(bench.alias("benchmark_id"), "source_kind").agg(F.count("*").alias("n"))


# --- suites -------------------------------------------------------------------------------


@query("a_suite_headline", """SELECT 'b' || cast(l_orderkey AS string) AS bench, round(CASE l_orderkey % 3 WHEN 0 THEN sum(l_quantity) FILTER (l_linenumber = 1)
    WHEN 1 THEN sum(l_discount) FILTER (rn = 1) * CASE WHEN sum(l_discount) FILTER (rn = 1) <= 1 THEN 100 ELSE 1 END ELSE sum(l_quantity + l_tax) FILTER (rn = 1) END, 6) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM {lineitem}) x GROUP BY l_orderkey, l_orderkey % 3
    HAVING l_orderkey % 3 <> 0 OR (count(*) FILTER (l_linenumber = 1) = 1)""")
def a_suite_headline(t):
    """One score table per order. Kind 0 picks a row by filter, 1 scales a share, 2 sums columns."""
    kind = F.col("l_orderkey") % 3
    ones = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_linenumber") == 1).alias("ones"))
    single = ones.filter((kind != 0) | (F.col("ones") == 1)).select("l_orderkey")
    return Z.headline_scores(*_suite(t, single)).select("bench", F.round("score", 6).alias("score"))


def _suite(t, orders):
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    lines = t.lineitem.withColumn("row", order - 1).join(orders, "l_orderkey")
    kind = F.col("l_orderkey") % 3
    pair = lambda c, v: F.struct(F.lit(c).alias("column"), v.cast("string").alias("value"))
    cells = lines.select(F.col("l_orderkey").alias("file"), "row", F.explode(F.array(
        pair("Line ", F.col("l_linenumber")), pair("Qty", F.col("l_quantity")), pair("share", F.col("l_discount")), pair("tax", F.concat(F.col("l_tax").cast("string"), F.lit("%"))))).alias("c")).select("file", "row", "c.*")
    specs = orders.select(
        F.col("l_orderkey").alias("file"), F.concat(F.lit("b"), F.col("l_orderkey")).alias("bench"),
        F.when(kind == 0, F.array(F.lit("qty"))).when(kind == 1, F.array(F.lit("share"))).otherwise(F.array(F.lit("Qty"), F.lit("tax"))).alias("columns"),
        F.when(kind == 0, F.create_map(F.lit("line"), F.lit("1"))).alias("want"), F.when(kind == 1, "auto").otherwise("1").alias("multiply"))
    return cells, specs


@query("a_suite_failures", """SELECT 'b' || cast(l_orderkey AS string) AS bench, CASE WHEN l_orderkey % 5 = 0 THEN 'missing column'
        WHEN l_orderkey % 3 = 0 AND count(*) FILTER (l_linenumber = 1 AND l_quantity > 10) = 0 THEN 'no matching row' ELSE 'ok' END AS reason FROM {lineitem} GROUP BY l_orderkey""")
def a_suite_failures(t):
    """A filter over two columns, and specs that ask for a column no table has; nothing is dropped."""
    orders = t.lineitem.select("l_orderkey").distinct()
    cells, specs = _suite(t, orders)
    big = cells.filter("column = 'Qty'").select("file", "row", F.lit("Big").alias("column"), (F.col("value").cast("double") > 10).cast("string").alias("value"))
    both = F.map_concat("want", F.create_map(F.lit("big"), F.lit("true")))
    columns = F.when(F.col("file") % 5 == 0, F.array(F.lit("gone"))).otherwise(F.col("columns"))
    failed = Z.headline_scores(cells.unionByName(big), specs.withColumns({"want": F.when(F.col("file") % 5 != 0, both), "columns": columns}))
    return failed.select("bench", F.coalesce("reason", F.lit("ok")).alias("reason"))


@query("a_failed_predictions", "SELECT run_key, count(*) AS cases, count(*) FILTER (NOT ok) AS failed FROM {answers} GROUP BY ALL")
def a_failed_predictions(t):
    said = F.when(F.col("ok"), F.col("output")).otherwise(F.concat(F.lit("Failed to obtain answer via API: "), "error"))
    return Z.prediction_counts(t.answers.withColumn("prediction", said), ["run_key"])


@query("src_newest_file", """SELECT 'u' || cast(user_id AS string) AS run, 'b' AS bench, CASE WHEN count(*) FILTER (event_type = 'view') > 0
    THEN 'f' || cast(max_by(event_id, ts) FILTER (event_type = 'view') AS string) || '.view' ELSE 'f' || cast(max_by(event_id, ts) FILTER (event_type = 'click') AS string) || '.click' END AS file
    FROM {events} GROUP BY user_id HAVING count(*) FILTER (event_type IN ('view', 'click')) > 0""")
def src_newest_file(t):
    run = F.concat(F.lit("u"), F.col("user_id"))
    files = t.events.select(run.alias("run"), F.concat(F.lit("f"), F.col("event_id"), F.lit("."), "event_type").alias("file"), F.col("ts").cast("timestamp").alias("modified"))
    order = F.array(F.struct(F.lit(0).alias("pos"), F.lit("%.view").alias("pattern")), F.struct(F.lit(1).alias("pos"), F.lit("%.click").alias("pattern")))
    patterns = t.events.select(run.alias("run")).distinct().select("run", F.lit("b").alias("bench"), F.explode(order).alias("p")).select("run", "bench", "p.*")
    return Z.newest_matching(files, patterns).select("run", "bench", "file")


# --- prices and catalog -------------------------------------------------------------------


def _price_inputs(t):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("vendor/sup-"), k)
    struct = lambda p, c: F.struct(p.alias("prompt"), c.alias("completion"))
    listing = t.supplier.filter(k % 6 != 5).select(
        k.alias("pos"), F.when(k % 6 == 4, F.concat(name, F.lit(":free"))).when(k % 6 == 3, F.concat(name, F.lit("-2025-04-16"))).otherwise(name).alias("id"),
        F.when(k % 4 != 0, F.lit(1000)).cast("bigint").alias("context_length"), struct(F.when(k % 9 == 0, "-1").otherwise(F.concat((k % 50).cast("string"), F.lit("e-7"))), F.lit("0.000002")).alias("pricing"),
        F.struct(F.lit(77).cast("bigint").alias("context_length")).alias("top_provider"))
    models = t.supplier.select(F.concat(F.lit("m-"), k).alias("model_id"), F.concat(F.lit("Sup "), k, F.when(k % 2 == 0, " (high)").otherwise("")).alias("display_name"),
                               F.when(k % 10 == 1, F.concat(F.lit("openrouter:"), name)).alias("endpoint"))
    over = t.supplier.filter(k % 8 == 0).select(F.concat(F.lit("m-"), k).alias("model_id"), F.when(k % 24 == 0, "none").alias("pricing"), F.lit(None).cast("string").alias("openrouter"),
                                                F.when(k % 16 == 8, F.lit(3.5)).alias("input_price"), F.lit(None).cast("double").alias("output_price"), F.when(k % 16 == 0, F.lit(55)).cast("bigint").alias("context_length"))
    return models, listing, over


@query("j_price_resolution", """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 6 AS six FROM {supplier}),
    listed AS (SELECT k, CASE WHEN six = 3 THEN 'vendor/sup-' || cast(k AS string) || '-2025-04-16' ELSE 'vendor/sup-' || cast(k AS string) END AS id,
        CASE WHEN k % 9 = 0 THEN NULL ELSE round((k % 50) / 10, 6) END AS ip, CASE WHEN k % 4 = 0 THEN 77 ELSE 1000 END AS cl FROM s WHERE six < 4),
    m AS (SELECT s.k, CASE WHEN s.k % 16 = 8 THEN NULL WHEN s.k % 10 = 1 AND six = 3 THEN NULL ELSE l.id END AS id, ip, cl FROM s LEFT JOIN listed l ON s.k = l.k WHERE s.k % 24 <> 0)
    SELECT 'm-' || cast(k AS string) AS model_id, CASE WHEN k % 16 = 8 THEN 3.5::DOUBLE WHEN id IS NOT NULL THEN ip END AS input_price, CASE WHEN id IS NOT NULL THEN 2::DOUBLE END AS output_price,
        CASE WHEN k % 16 = 0 THEN 55 WHEN id IS NOT NULL THEN cl END AS context_length, CASE WHEN id IS NOT NULL THEN 'openrouter:' || id ELSE 'catalog' END AS source
    FROM m WHERE id IS NOT NULL OR k % 16 = 8 OR k % 16 = 0""")
def j_price_resolution(t):
    return R.resolve(*_price_inputs(t))


@query("a_price_coverage", """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 6 AS six FROM {supplier}),
    p AS (SELECT count(*) AS priced FROM s WHERE k % 24 <> 0 AND (k % 8 = 0 OR (six < 4 AND NOT (k % 10 = 1 AND six = 3))))
    SELECT count(*) AS models, any_value(priced) AS priced, count(*) - any_value(priced) AS missing FROM s, p""")
def a_price_coverage(t):
    models, listing, over = _price_inputs(t)
    return R.coverage(models, R.resolve(models, listing, over))


@query("f_benchmark_selection", """WITH c AS (SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS b, cast(substr(p_brand, 7) AS int) AS n FROM {part}), k AS (SELECT b, CASE n % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'math' ELSE 'chat' END AS cat, n % 4 = 0 AS arena FROM c)
    SELECT b AS benchmark_id, row_number() OVER (ORDER BY CASE WHEN b = 'brand-7' THEN 0 WHEN cat = 'ocr' AND NOT arena THEN 1 ELSE 2 END, b) AS place FROM k WHERE b = 'brand-7' OR (cat = 'ocr' AND NOT arena) OR arena""")
def f_benchmark_selection(t):
    n = F.substr("p_brand", F.lit(7)).cast("int")
    catalog = t.part.select(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("benchmark_id"), F.when(n % 3 == 0, "ocr").when(n % 3 == 1, "math").otherwise("chat").alias("category"),
                            F.when(n % 4 == 0, "arena").otherwise("native").alias("engine")).distinct()
    # Two layers; the later one is what is selected from.
    layers = catalog.withColumns({"layer": F.lit(1)}).unionByName(catalog.withColumns({"category": F.lit("old"), "layer": F.lit(0)}))
    chosen = C.select_benchmarks(C.layered(layers), "BRAND-7, category:ocr, engine:arena")
    numbered = chosen.select("benchmark_id", F.monotonically_increasing_id().alias("at"))
    return numbered.select("benchmark_id", F.row_number().over(Window.orderBy("at")).alias("place"))


@query("j_board_layout", """WITH b AS (SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS b, cast(substr(p_brand, 7) AS int) AS n FROM {part})
    SELECT 't' || cast(n % 3 AS string) AS type_id, string_agg(b, ',' ORDER BY n % 4, n % 8 <> 0, b) AS boards FROM b GROUP BY 1""")
def j_board_layout(t):
    n = F.substr("p_brand", F.lit(7)).cast("int")
    base = t.part.select(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("benchmark_id"), n.alias("n")).distinct()
    catalog = base.select("benchmark_id", F.concat(F.lit("t"), F.col("n") % 3, F.lit("/c"), F.col("n") % 4).alias("board"), F.when(F.col("n") % 8 == 0, "arena").otherwise("native").alias("engine"), F.lit(0).alias("pos"))
    layout = base.select((F.col("n") % 3).alias("type_pos"), (F.col("n") % 4).alias("cat_pos")).distinct().select(
        F.concat(F.lit("t"), "type_pos").alias("type_id"), "type_pos", F.concat(F.lit("c"), "cat_pos").alias("category_id"), "cat_pos", F.lit("x").alias("label"))
    out = B.board_layout(layout, catalog, flat_results(t))
    ids = F.flatten(F.transform("categories", lambda c: F.transform(c["boards"], lambda b: b["benchmark_id"])))
    return out.select("type_id", F.array_join(ids, ",").alias("boards"))


# --- streams ------------------------------------------------------------------------------


def _stream(t, df, parts=3):
    """``df`` as a stream of several files that arrive in sequence order."""
    path, n = _folder(t, "stream"), int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    low, high = df.agg(F.min("seq"), F.max("seq")).head()
    part = F.floor((F.col("seq") - low) * parts / (high - low + 1))
    for i in range(parts):
        df.filter(part == i).repartition(n, "run_key", "sample_id").write.mode("append").parquet(path)
    return jobs.file_stream(t.spark, path, df.schema, files_per_batch=n)


def _finish(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()


@query("st_latest", f"WITH {LATEST} SELECT run_key, sample_id, seq, ok FROM latest")
def st_latest(t):
    path = _folder(t, "latest")
    _finish(jobs.keep_latest(_stream(t, t.prediction_log), path, _folder(t, "cp"), buckets=2))
    return t.spark.read.parquet(path).select("run_key", "sample_id", "seq", "ok")


_TICKS = """SELECT run_key, cast(floor(epoch(ts) / 15) * 15 AS bigint) AS tick, count(*) AS completed, count(*) FILTER (NOT ok) AS errors, count(*) FILTER (attempts > 1) AS retried
    FROM {prediction_log} GROUP BY ALL"""


def _ticks(t):
    """Fifteen-second ticks appended to files. Behind the log comes a row of the next day, which closes the
    last ticks and stays open itself, and then one that is too late, which the watermark drops."""
    path, out = _folder(t, "log"), _folder(t, "ticks")
    log = t.prediction_log
    first, last = log.agg(F.min("ts"), F.max("ts")).head()
    log.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "run_key", "sample_id").write.parquet(path)
    one = log.orderBy("seq").limit(1)
    late = one.withColumns({"ts": F.lit(first).cast(log.schema["ts"].dataType), "run_key": F.lit("too late")})
    clock = one.withColumns({"ts": (F.lit(last) + F.expr("INTERVAL 1 DAY")).cast(log.schema["ts"].dataType), "run_key": F.lit("clock")})
    checkpoint = _folder(t, "cp")
    for row in (None, clock, late):  # the same job, started again as rows arrive
        if row is not None:
            row.write.mode("append").parquet(path)
        ticks = jobs.progress(jobs.file_stream(t.spark, path, log.schema))
        _finish(ticks.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return t.spark.read.schema(ticks.schema).parquet(out)


@query("st_progress", _TICKS)
def st_progress(t):
    return _ticks(t).select("run_key", F.unix_timestamp("tick").alias("tick"), "completed", "errors", "retried")


@query("w_progress_estimate", f"""WITH ticks AS ({_TICKS}), d AS (SELECT run_key, cast(sum(completed) AS bigint) AS done, cast(sum(errors) AS bigint) AS errors, avg(completed / 15.0) AS rate FROM ticks GROUP BY 1),
    e AS (SELECT run_key, count(*) * 40 AS expected FROM {{log_samples}} GROUP BY 1)
    SELECT e.run_key, coalesce(done, 0) AS done, errors, expected, round(greatest(0, (expected - coalesce(done, 0)) / rate), 3) AS eta_s FROM e LEFT JOIN d USING (run_key)""")
def w_progress_estimate(t):
    expected = t.log_samples.groupBy("run_key").agg((F.count("*") * 40).alias("expected"))
    return jobs.estimate(_ticks(t), expected).select("run_key", "done", "errors", "expected", F.round("eta_s", 3).alias("eta_s"))


@query("st_failure_watch", f"WITH {_STREAKS} SELECT run_key, max(streak) AS longest, min(CASE WHEN streak >= 3 THEN seq END) AS aborted_at FROM streaks GROUP BY ALL")
def st_failure_watch(t):
    path = _folder(t, "watch")
    _finish(jobs.watch_failures(_stream(t, t.prediction_log), path, _folder(t, "cp"), limit=3))
    return jobs.current(t.spark, path).select("run_key", "longest", "aborted_at")


def _arrive(t, rows, n, path, fmt, compression):
    """``rows`` written in two times ``n`` ranges of run ids. They are made before the ranges are sampled and moved by halves,
    so that little of them is in shuffles at a time."""
    with scratch(t.spark), freed(t.spark):
        for half in parts(materialise(rows), "run_id", n=2):
            half.repartitionByRange(n, "run_id").write.mode("append").option("compression", compression).format(fmt).save(path)


@query("st_boards", comparable() + RANKED + """
    SELECT benchmark_id, model_id, rank, greatest(rank, could) AS rank_worst, position FROM ranked""")
def st_boards(t):
    """Results arriving in two batches of files; the boards after both equal the batch boards."""
    store, stream, n = _folder(t, "store"), _folder(t, "stream"), int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    arrived = flat_results(t)
    _arrive(t, arrived, n, stream, "parquet", "zstd")
    _finish(jobs.refresh_boards(jobs.file_stream(t.spark, stream, arrived.schema, files_per_batch=n), store, _folder(t, "cp"), prices=t.prices, every=None))
    return t.spark.read.parquet(f"{store}/boards").select("benchmark_id", "model_id", "rank", "rank_worst", "position")


def _polled(t):
    """Stored results, some broken, arriving in two batches of files and split into boards and quarantine."""
    store, stream, n = _folder(t, "store"), _folder(t, "stream"), int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    arrived = _stored(t)
    _arrive(t, arrived, n, stream, "json", "gzip")

    def split(batch):
        checked = batch.withColumn("problems", S.result_problems())
        return S.flatten_results(checked.filter(F.size("problems") == 0)), checked.filter(F.size("problems") > 0).select("run_id", "problems")

    _finish(jobs.refresh_boards(jobs.file_stream(t.spark, stream, arrived.schema, "json", n), store, _folder(t, "cp"), split, every=None))
    return store


@query("st_retraction", (comparable() + RANKED).replace("WITH defs", """WITH kept AS (SELECT * FROM {results} WHERE errors <= cases AND (cast(split_part(run_id, '-', 3) AS int) % 4 < 2
        OR cast(split_part(run_id, '-', 3) AS int) % 4 = 2 AND cast(split_part(run_id, '-', 2) AS bigint) % 2 = 0)), defs""", 1).replace("{results}", "kept").replace("FROM kept WHERE errors", "FROM {results} WHERE errors", 1) + """
    SELECT benchmark_id, model_id, rank, greatest(rank, could) AS rank_worst, position FROM ranked""")
def st_retraction(t):
    """Results in files by a part of their id. After a first look the files of one part are deleted, those of another
    replaced by half of their rows; the boards after the second look are those of what is left, and a third look
    finds nothing to do."""
    source, store = _folder(t, "source"), _folder(t, "store")
    with scratch(t.spark), freed(t.spark):
        rows = S.nest_results(materialise(flat_results(t))).withColumn("part", F.split_part("run_id", F.lit("-"), F.lit(3)).cast("int") % 4)
        # A gzipped file is read by one task.
        for part in parts(rows, "run_id"):
            spread(part, "run_id").write.mode("append").partitionBy("part").option("compression", "gzip").json(source)
        jobs.poll_store(t.spark, source, store, t.prices)
        remove(t.spark, f"{source}/part=3")
        half = rows.filter("part = 2").filter(F.split_part("run_id", F.lit("-"), F.lit(2)).cast("bigint") % 2 == 0)
        spread(half, "run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").option("compression", "gzip").json(source)
    jobs.poll_store(t.spark, source, store, t.prices)
    if jobs.poll_store(t.spark, source, store, t.prices) is not None:
        raise AssertionError("nothing changed")
    return jobs.live(t.spark, store, "boards").select("benchmark_id", "model_id", "rank", "rank_worst", "position")


_BURSTS = """SELECT user_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS n FROM (
        SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island
        FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {events} WHERE event_type = 'error') x) y GROUP BY user_id, island"""


@query("st_error_bursts", _BURSTS)
def st_error_bursts(t):
    """Error bursts of each user from a stream that is started three times: the events, a row of a week later, which closes
    all bursts, and one that is too late."""
    path, out, checkpoint = _folder(t, "events"), _folder(t, "bursts"), _folder(t, "cp")
    errors = t.events.filter("event_type = 'error'").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    first, last = errors.agg(F.min("ts"), F.max("ts")).head()
    errors.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "user_id").write.parquet(path)
    one = errors.limit(1).withColumn("user_id", F.lit(None).cast(errors.schema["user_id"].dataType))
    for at in (None, F.lit(last) + F.expr("INTERVAL 7 DAY"), F.lit(first)):
        if at is not None:
            one.withColumn("ts", at).write.mode("append").parquet(path)
        bursts = jobs.error_bursts(jobs.file_stream(t.spark, path, errors.schema), ["user_id"], "ts", "2 hours", "1 hour")
        _finish(bursts.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    done = t.spark.read.schema(bursts.schema).parquet(out)
    return done.select("user_id", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n")


@query("st_quarantine", _PROBLEMS)
def st_quarantine(t):
    return t.spark.read.parquet(f"{_polled(t)}/quarantine").select("run_id", F.array_join("problems", ",").alias("problems"))


@query("st_generations", f"WITH bad AS ({_PROBLEMS}) SELECT 2 AS generations, count(*) - (SELECT count(*) FROM bad) AS results FROM {{results}}")
def st_generations(t):
    return t.spark.read.parquet(f"{_polled(t)}/generations").agg(F.count_distinct("generation").alias("generations"), F.sum("results").alias("results"))
