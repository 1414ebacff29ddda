"""Text metrics, score aggregation and run statistics over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions import names as N
from scorelake.functions import text as X
from scorelake.functions.distance import similarity
from scorelake.functions.metrics import melt_scores, score_texts
from scorelake.operators import aggregate as A
from scorelake.operators.bootstrap import POISSON, bootstrap_ci, register_sql, sql_interval
from scorelake.plans.workload import query
from scorelake.session import materialise

WS = "'\\s+', ' ', 'g'"
# Canonical reference and prediction, and what the edits cost (see the workload's note).
CANON = f"""canon AS (SELECT *, trim(regexp_replace(nfc_normalize(reference), {WS})) AS r,
                trim(regexp_replace(nfc_normalize(coalesce(output, '')), {WS})) AS p FROM {{answers}}),
    costs AS (SELECT *, CASE WHEN k = 2 THEN length(r) - length(replace(r, 'e', '')) ELSE length(r) - length(p) END AS d,
                len(string_split(r, ' ')) - len(string_split(p, ' ')) AS dw FROM canon)"""


def _scored(t, *metrics):
    answers = t.answers.withColumn("references", F.array("reference"))
    return score_texts(answers, list(metrics), spread_by=["run_key", "sample_id"])


def _text_query(metric, good, worst):
    sql = f"""WITH {CANON} SELECT run_key, sample_id,
        round(CASE WHEN NOT ok THEN {worst} ELSE {good} END, 6) AS {metric} FROM costs"""

    @query(f"m_{metric}", sql)
    def run(t):
        return _scored(t, metric).select("run_key", "sample_id", F.round(F.col(metric).cast("double"), 6).alias(metric))


_CER = "CASE WHEN length(r) = 0 THEN 0 ELSE d / length(r) END"
_text_query("cer", _CER, 1)
_text_query("ned", "CASE WHEN length(r) = 0 THEN 0 ELSE d / length(r) END", 1)
_text_query("char_accuracy", f"greatest(0, 1 - ({_CER}))", 0)
_text_query("exact_match", "cast(p = r AS double)", 0)
_text_query("length_ratio", "length(p) / length(r)", 0)


@query("m_cer_scores", f"""WITH {CANON} SELECT run_key, metric, round(avg(value), 6) AS value, count(*) AS n FROM (
    SELECT run_key, unnest(['cer', 'char_accuracy', 'exact_match']) AS metric,
           unnest([CASE WHEN NOT ok THEN 1 ELSE {_CER} END, CASE WHEN NOT ok THEN 0 ELSE greatest(0, 1 - ({_CER})) END,
                   CASE WHEN ok AND p = r THEN 1 ELSE 0 END]) AS value FROM costs) x GROUP BY ALL""")
def m_cer_scores(t):
    names = ["cer", "char_accuracy", "exact_match"]
    tall = melt_scores(_scored(t, *names), ["run_key", "sample_id"], names)
    return A.metric_means(tall).select("run_key", "metric", F.round("value", 6).alias("value"), "n")


# --- words, syllables, answers ------------------------------------------------------------

LOOSE = "trim(regexp_replace(regexp_replace(nfc_normalize({0}), '\\p{{P}}', ' ', 'g'), '\\s+', ' ', 'g'))"


def _words(frame, metric):
    made = frame.withColumn("references", F.array("reference"))
    out = score_texts(made, [metric], ok=None, spread_by=["k", "sample_id"])
    return out.select("k", "sample_id", F.round(F.col(metric).cast("double"), 6).alias(metric))


def _changed(r, letter):
    return f"len(list_filter({r}, lambda x: contains(x, '{letter}')))"


@query("m_wer", f"""WITH w AS (SELECT k, sample_id, string_split(trim(regexp_replace(reference, {WS})), ' ') AS r,
        string_split(trim(regexp_replace(output, {WS})), ' ') AS p FROM {{word_answers}})
    SELECT k, sample_id, round(CASE k WHEN 2 THEN {_changed('r', 'e')} ELSE len(r) - len(p) END / len(r), 6) AS wer FROM w""")
def m_wer(t):
    return _words(t.word_answers, "wer")


@query("m_wer_loose", f"""WITH w AS (SELECT k, sample_id, list_filter(string_split({LOOSE.format('reference')}, ' '), lambda x: x <> '') AS r,
        list_filter(string_split({LOOSE.format('output')}, ' '), lambda x: x <> '') AS p FROM {{word_answers}})
    SELECT k, sample_id, round(CASE WHEN len(r) = 0 THEN 0 WHEN k = 2 THEN {_changed('r', 'e')} / len(r) ELSE (len(r) - len(p)) / len(r) END, 6) AS wer_loose FROM w""")
def m_wer_loose(t):
    return _words(t.word_answers, "wer_loose")


def _chars(*spans):
    return "[" + "".join(chr(a) + "-" + chr(b) if b > a else chr(a) for a, b in spans) + "]"


_C = _chars((0x915, 0x939), (0x958, 0x95F))
_M = _chars((0x900, 0x903), (0x93A, 0x93B), (0x93E, 0x94C), (0x94E, 0x94F), (0x951, 0x957), (0x962, 0x963))
_V = _chars((0x904, 0x914), (0x960, 0x961), (0x972, 0x97F))
_NUKTA, _VIRAMA = chr(0x93C), chr(0x94D)
_UNIT = f"(?s)(?:{_C}{_NUKTA}?{_VIRAMA})*{_C}{_NUKTA}?{_M}*{_VIRAMA}?|{_V}{_M}*|."


def _units(c):
    return f"regexp_extract_all(trim(regexp_replace(nfc_normalize({c}), {WS})), '{_UNIT}')"


_UNITS_SQL = f"""WITH w AS (SELECT k, sample_id, {_units('reference')} AS r, {_units('output')} AS p FROM {{devanagari}}),
    d AS (SELECT *, CASE k WHEN 0 THEN len(list_filter(r, lambda x: regexp_matches(x, '[०-९]'))) WHEN 1 THEN len(r) - len(p)
          ELSE {_changed('r', 'े')} END AS d FROM w)"""


@query("m_acer", _UNITS_SQL + " SELECT k, sample_id, round(d / len(r), 6) AS acer FROM d")
def m_acer(t):
    return _words(t.devanagari, "acer")


@query("m_akshara_accuracy", _UNITS_SQL + " SELECT k, sample_id, round(greatest(0, 1 - d / len(r)), 6) AS akshara_accuracy FROM d")
def m_akshara_accuracy(t):
    return _words(t.devanagari, "akshara_accuracy")


@query("m_akshara_accuracy_digitfold", _UNITS_SQL + """
    SELECT k, sample_id, round(greatest(0, 1 - CASE k WHEN 0 THEN 0 ELSE d / len(r) END), 6) AS akshara_accuracy_digitfold FROM d""")
def m_akshara_accuracy_digitfold(t):
    return _words(t.devanagari, "akshara_accuracy_digitfold")


_FOLD = "replace(lower({0}), 'ß', 'ss')"
_LA, _LP = _FOLD.format(LOOSE.format("answer")), _FOLD.format(LOOSE.format("output"))
ANLS_SQL = f"""(CASE WHEN k = 0 THEN 1.0 WHEN k = 2 THEN
    1 - (length(answer) - length(replace(answer, 'e', ''))) / length(trim(regexp_replace(answer, {WS})))
    WHEN k = 1 THEN length(trim(regexp_replace(answer, {WS}))) / length(trim(regexp_replace(output, {WS}))) END)"""


@query("m_anls", f"""SELECT sample_id, k, round(CASE WHEN {ANLS_SQL} >= 0.5 THEN {ANLS_SQL} ELSE 0 END, 6) AS anls
    FROM {{qa_pairs}}""")
def m_anls(t):
    pairs = t.qa_pairs.withColumn("references", F.array("answer"))
    out = score_texts(pairs, ["anls"], ok=None, spread_by=["sample_id", "k"])
    return out.select("sample_id", "k", F.round("anls", 6).alias("anls"))


@query("m_loose_and_contains", f"""SELECT sample_id, k, cast({_LA} = {_LP} AS double) AS loose_match,
    cast({_LA} <> '' AND contains({_LP}, {_LA}) AS double) AS contains_match FROM {{qa_pairs}}""")
def m_loose_and_contains(t):
    pairs = t.qa_pairs.withColumn("references", F.array("answer"))
    return score_texts(pairs, ["loose_match", "contains_match"], ok=None).select("sample_id", "k", "loose_match", "contains_match")


@query("m_relaxed_accuracy", """WITH q AS (SELECT o_orderkey, cast(floor(o_totalprice) AS bigint) AS v, 90 + o_orderkey % 21 AS f FROM {orders})
    SELECT o_orderkey, cast(CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN v = 0 OR f = 100 ELSE abs(v * f - v * 100) / (v * 100) <= 0.05 END AS double) AS relaxed_accuracy FROM q""")
def m_relaxed_accuracy(t):
    q = t.orders.select("o_orderkey", F.floor("o_totalprice").alias("v"), (90 + F.col("o_orderkey") % 21).alias("f"))
    kind = F.col("o_orderkey") % 5
    exact, ref = (F.col("v") * F.col("f")).cast("string"), (F.col("v") * 100).cast("string")
    grouped = F.format_number(F.col("v") * F.col("f"), 0)
    q = q.withColumns({
        "output": F.when(kind == 0, " YES ").when(kind == 1, F.concat(exact, F.lit(" units"))).when(kind == 2, F.concat(grouped, F.lit("%"))).otherwise(exact),
        "references": F.array(F.when(kind == 0, "yes").when(kind == 1, F.concat(ref, F.lit(" UNITS"))).otherwise(ref))})
    return score_texts(q, ["relaxed_accuracy"], ok=None).select("o_orderkey", "relaxed_accuracy")


@query("t_edit_distance", """SELECT a.p_partkey, levenshtein(a.p_name, b.p_name) AS distance,
    round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 6) AS similarity
    FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1""")
def t_edit_distance(t):
    nxt = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return t.part.join(nxt, "p_partkey").select(
        "p_partkey", F.levenshtein("p_name", "other").alias("distance"), F.round(similarity(F.col("p_name"), F.col("other")), 6).alias("similarity"))


@query("t_names", """SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9.]+', '-', 'g'), '-{2,}', '-', 'g'), '-.') AS slug,
    'acme-' || replace(lower(p_name), ' ', '-') || CASE p_partkey % 3 WHEN 0 THEN '|acme-' || replace(lower(p_name), ' ', '-') || '-x' ELSE '' END AS probe FROM {part}""".replace(
    "'acme-' || replace(lower(p_name), ' ', '-') || CASE p_partkey % 3 WHEN 0 THEN '|acme-' || replace(lower(p_name), ' ', '-') || '-x' ELSE '' END AS probe",
    "replace(lower(p_name), ' ', '-') || CASE p_partkey % 3 WHEN 0 THEN '-high|' || replace(lower(p_name), ' ', '-') WHEN 1 THEN '-2025-04-16-thinking|' || replace(lower(p_name), ' ', '-') || '-2025-04-16|' || replace(lower(p_name), ' ', '-') ELSE '' END AS candidates"))
def t_names(t):
    kind = F.col("p_partkey") % 3
    tail = F.when(kind == 0, "-HIGH").when(kind == 1, "-2025-04-16_thinking").otherwise(":free")
    name = F.concat(F.lit("acme/"), F.col("p_name"), tail)
    return t.part.select("p_partkey", N.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), F.array_join(N.candidates(name), "|").alias("candidates"))


@query("t_clean_output", """SELECT doc_id, md5(trim(text)) AS digest FROM {documents}""")
def t_clean_output(t):
    wrapped = F.concat(F.lit("<think>so\nfar</think>\n```text\n"), F.trim("text"), F.lit("\n```<|endoftext|>"))
    return t.documents.select("doc_id", F.md5(X.clean_model_output(wrapped)).alias("digest"))


@query("t_parse_date", """SELECT o_orderkey, cast(cast(o_orderdate AS date) AS string) AS day FROM {orders}""")
def t_parse_date(t):
    kind = F.col("o_orderkey") % 5
    fmt = lambda f: F.date_format("o_orderdate", f)
    text = F.when(kind == 0, fmt("yyyy-MM-dd")).when(kind == 1, fmt("yyyy/MM/dd")).when(kind == 2, fmt("yyyyMMdd")).when(
        kind == 3, fmt("yyyyMMddHHmmss")).otherwise(F.concat(fmt("yyyy-MM-dd"), F.lit("T23:30:00+00:00")))
    return t.orders.select("o_orderkey", F.date_format(N.parse_date(text), "yyyy-MM-dd").alias("day"))


@query("t_prompt", """SELECT conv_id, turn, left(sha256('be brief' || chr(0) || 'Answer in one line: ' || text), 12) AS prompt_hash
    FROM {conversations} WHERE role = 'user'""")
def t_prompt(t):
    users = t.conversations.filter("role = 'user'")
    prompt = X.render_prompt("Answer in one line: {question}", F.col("text"))
    return users.select("conv_id", "turn", X.prompt_hash(F.lit("be brief"), prompt).alias("prompt_hash"))


# --- aggregation --------------------------------------------------------------------------

# A per-sample score that needs no distance: the share of the reference's length.
SCORED = """scored AS (SELECT run_key, sample_id, source, lang, ok, CASE WHEN NOT ok THEN 0 WHEN sample_id % 23 = 0 THEN NULL
        ELSE length(output) / length(reference) END AS value FROM {answers})"""


def _simple_scores(t):
    value = F.when(~F.col("ok"), 0.0).when(F.col("sample_id") % 23 == 0, None).otherwise(F.length("output") / F.length("reference"))
    return t.answers.select("run_key", "sample_id", "source", "lang", "ok", value.alias("value"))


def _bootstrap_sql(unit):
    steps = " ".join(f"WHEN u < {int(p * 2147483647)} THEN {i}" for i, p in enumerate(POISSON))
    return f"""WITH {SCORED}, units AS (SELECT run_key, {unit} AS unit, sum(value) AS s, count(value) AS n FROM scored WHERE value IS NOT NULL GROUP BY ALL),
    seeds AS (SELECT *, cast('0x' || left(md5('0:' || unit), 8) AS bigint) % 2147483647 AS seed FROM units),
    drawn AS (SELECT run_key, s, n, b, (seed * ((b * b * b * 926533) % 2147483647) + b * 15485863) % 2147483647 AS u
              FROM seeds, (SELECT range + 1 AS b FROM range(1000)) r),
    weighted AS (SELECT *, CASE {steps} ELSE {len(POISSON)} END AS w FROM drawn),
    means AS (SELECT run_key, b, sum(s * w) / sum(n * w) AS m FROM weighted GROUP BY ALL HAVING sum(n * w) > 0),
    sorted AS (SELECT run_key, list_sort(list(m)) AS m FROM means GROUP BY ALL)
    SELECT u.run_key, round(sum(s) / sum(n), 6) AS mean, round(any_value(m[least(len(m) - 1, cast(floor(0.025 * len(m)) AS bigint)) + 1]), 6) AS ci_low,
           round(any_value(m[least(len(m) - 1, cast(floor(0.975 * len(m)) AS bigint)) + 1]), 6) AS ci_high
    FROM units u JOIN sorted USING (run_key) GROUP BY u.run_key"""


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("a_bootstrap_ci", _bootstrap_sql("cast(sample_id AS string)"))
def a_bootstrap_ci(t):
    return _rounded(bootstrap_ci(_simple_scores(t), ["run_key"]), "mean", "ci_low", "ci_high")


@query("x_sql_bootstrap", _bootstrap_sql("cast(sample_id AS string)"))
def x_sql_bootstrap(t):
    """The interval through the SQL table function."""
    register_sql(t.spark)
    _simple_scores(t).select("run_key", "sample_id", "value").createOrReplaceTempView("bootstrap_scores")
    return _rounded(t.spark.sql(sql_interval("bootstrap_scores")), "mean", "ci_low", "ci_high")


@query("a_cluster_ci", _bootstrap_sql("source"))
def a_cluster_ci(t):
    return _rounded(bootstrap_ci(_simple_scores(t), ["run_key"], cluster="source"), "mean", "ci_low", "ci_high")


@query("a_metric_means", f"WITH {SCORED} SELECT run_key, round(avg(value), 6) AS value, count(value) AS n FROM scored GROUP BY run_key")
def a_metric_means(t):
    tall = _simple_scores(t).withColumn("metric", F.lit("share"))
    return A.metric_means(tall).select("run_key", F.round("value", 6).alias("value"), "n")


@query("a_breakdowns", f"""WITH {SCORED}, tall AS (
      SELECT run_key, 'source' AS group_key, CASE WHEN source = 'src3' THEN 'unknown' ELSE source END AS group_value, value FROM scored
      UNION ALL SELECT run_key, 'lang', lang, value FROM scored
      UNION ALL SELECT run_key, 'tags', CASE WHEN sample_id % 4 = 0 THEN 'none' ELSE unnest([lang, CASE WHEN ok THEN 'ok' ELSE 'bad' END]) END, value
                FROM (SELECT * FROM scored WHERE sample_id % 4 <> 0) x
      UNION ALL SELECT run_key, 'tags', 'none', value FROM scored WHERE sample_id % 4 = 0)
    SELECT run_key, group_key, group_value, count(*) AS n, round(avg(value), 6) AS value FROM tall GROUP BY ALL HAVING count(value) > 0""")
def a_breakdowns(t):
    scored = _simple_scores(t).withColumns({
        "source": F.when(F.col("source") == "src3", "").otherwise(F.col("source")),
        "tags": F.when(F.col("sample_id") % 4 == 0, F.array().cast("array<string>")).otherwise(
            F.array("lang", F.when(F.col("ok"), "ok").otherwise("bad")))})
    out = A.breakdowns(scored.withColumnRenamed("value", "share"), ["run_key"], {"source": False, "lang": False, "tags": True}, ["share"])
    return out.select("run_key", "group_key", "group_value", "n", F.round("value", 6).alias("value"))


@query("a_latency_stats", """WITH r AS (SELECT run_key, latency_s, row_number() OVER (PARTITION BY run_key ORDER BY latency_s) - 1 AS i,
        count(*) OVER (PARTITION BY run_key) AS n FROM {prediction_log} WHERE ok)
    SELECT run_key, round(avg(latency_s), 3) AS latency_mean,
        round(max(CASE WHEN i = least(n - 1, cast(floor(0.5 * n) AS bigint)) THEN latency_s END), 3) AS latency_p50,
        round(max(CASE WHEN i = least(n - 1, cast(floor(0.95 * n) AS bigint)) THEN latency_s END), 3) AS latency_p95 FROM r GROUP BY run_key""")
def a_latency_stats(t):
    return A.latency_stats(t.prediction_log)


@query("a_latency_sketches", """SELECT run_key, count(*) AS n, round(avg(latency_s), 6) AS latency_mean, true AS p50_close, true AS p95_close FROM {prediction_log} WHERE ok AND latency_s IS NOT NULL GROUP BY 1
    UNION ALL SELECT 'all', count(*), round(avg(latency_s), 6), true, true FROM {prediction_log} WHERE ok AND latency_s IS NOT NULL""")
def a_latency_sketches(t):
    """Sketches of the parts of a log, merged into runs and into all runs; their percentiles lie within one percent of the
    rank asked for."""
    log = t.prediction_log
    parts = materialise(A.latency_sketches(log.withColumn("part", F.col("seq") % 7), ["run_key", "part"]))
    runs = A.latency_of_sketches(parts).unionByName(A.latency_of_sketches(parts.withColumn("run_key", F.lit("all"))))
    rows = log.filter("ok AND latency_s IS NOT NULL").select("run_key", F.col("latency_s").cast("double").alias("v"))
    rows = rows.unionByName(rows.withColumn("run_key", F.lit("all"))).join(runs, "run_key")

    def close(name, p):
        below, upto = F.count_if(F.col("v") < F.col(name)) / F.count("*"), F.count_if(F.col("v") <= F.col(name)) / F.count("*")
        return ((below <= p + 0.01) & (upto >= p - 0.01)).alias(f"{name[8:]}_close")

    return rows.groupBy("run_key", "n", F.round("latency_mean", 6).alias("latency_mean")).agg(close("latency_p50", 0.5), close("latency_p95", 0.95))


@query("a_token_totals", """SELECT run_key, counter, cast(sum(amount) AS double) AS total FROM (SELECT run_key, unnest(['prompt_tokens', 'completion_tokens']) AS counter,
    unnest([prompt_tokens, completion_tokens]) AS amount FROM {answers} WHERE ok) x GROUP BY ALL""")
def a_token_totals(t):
    usage = F.create_map(F.lit("prompt_tokens"), F.col("prompt_tokens").cast("double"), F.lit("completion_tokens"),
                         F.col("completion_tokens").cast("double"), F.lit("cost"), F.lit(1.0))
    return A.token_totals(t.answers.withColumn("usage", usage))


@query("a_finish_reasons", "SELECT run_key, finish_reason, count(*) AS n FROM {answers} WHERE ok AND finish_reason IS NOT NULL GROUP BY ALL")
def a_finish_reasons(t):
    return A.finish_reasons(t.answers)


@query("a_truncated", "SELECT run_key, count(*) FILTER (ok AND finish_reason = 'length') AS truncated FROM {answers} GROUP BY ALL")
def a_truncated(t):
    return A.truncated(t.answers)


@query("a_top_errors", """WITH c AS (SELECT run_key, left(error, 200) AS error, count(*) AS n FROM {answers} WHERE NOT ok GROUP BY 1, 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_key ORDER BY n DESC, error) AS place FROM c) x WHERE place <= 5""")
def a_top_errors(t):
    return A.top_errors(t.answers)


@query("a_error_kinds", """WITH k AS (SELECT run_key, regexp_replace(CASE WHEN error LIKE 'HTTP%' OR error LIKE 'gave up%'
        THEN split_part(error, ':', 1) || ':' || split_part(error, ':', 2) ELSE split_part(error, ':', 1) END, '[0-9]+([.][0-9]+)?', 'N', 'g') AS kind FROM {answers} WHERE NOT ok)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_key ORDER BY n DESC, kind) AS place
        FROM (SELECT run_key, kind, count(*) AS n FROM k GROUP BY 1, 2) c) x WHERE place <= 5""")
def a_error_kinds(t):
    return A.error_kinds(t.answers)


@query("a_pool_counts", """SELECT run_key, count(*) AS completed, count(*) FILTER (NOT ok) AS errors, count(*) FILTER (attempts > 1) AS retried
    FROM {prediction_log} GROUP BY ALL""")
def a_pool_counts(t):
    return A.pool_counts(t.prediction_log)


@query("a_content_digest", """WITH rec AS (SELECT run_key, md5(cast(sample_id AS string)) AS k, sha256(cast(ok AS string) || ':' || coalesce(output, '')) AS h FROM {answers}),
    leaf AS (SELECT run_key, left(k, 6) AS leaf, sha256(string_agg(k || ':' || h, ',' ORDER BY k, h)) AS h, count(*) AS n FROM rec GROUP BY ALL),
    branch AS (SELECT run_key, left(leaf, 3) AS branch, sha256(string_agg(leaf || ':' || h, ',' ORDER BY leaf)) AS h, sum(n) AS n FROM leaf GROUP BY ALL)
    SELECT run_key, left(sha256(string_agg(branch || ':' || h, ',' ORDER BY branch)), 10) AS digest, cast(sum(n) AS bigint) AS records FROM branch GROUP BY ALL""")
def a_content_digest(t):
    body = F.concat_ws(":", F.col("ok").cast("string"), F.coalesce("output", F.lit("")))
    return A.content_digest(t.answers, ["run_key"], "sample_id", body)


@query("a_config_hash", """SELECT s_suppkey, left(sha256('{"limit":' || cast(s_nationkey AS string) || ',"model":"' || s_name || '"}'), 10) AS config_hash FROM {supplier}""")
def a_config_hash(t):
    either = [F.struct(F.col("s_nationkey").alias("limit"), F.col("s_name").alias("model")), F.struct(F.col("s_name").alias("model"), F.col("s_nationkey").alias("limit"))]
    halves = [t.supplier.filter(F.col("s_suppkey") % 2 == k).withColumn("config", config) for k, config in enumerate(either)]
    parts = [h.select("s_suppkey", A.config_hash(h, "config").alias("config_hash")) for h in halves]
    return parts[0].unionByName(parts[1])
