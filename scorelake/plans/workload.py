"""The evaluation tables derived from the star-schema test tables.

Every derivation is one SQL text that Spark and DuckDB both run, so a query and its oracle
start from the same rows. ``{name}`` is a base or derived table; ``{EACH:a,b}`` is a list
expanded to rows, written per engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE = ("region nation customer supplier part orders lineitem events documents embeddings "
        "pages benchmark labels conversations").split()

# Predictions are made from the reference by edits whose exact distance is known: model 1
# drops whole words, model 2 replaces a letter by a sign no reference contains, model 3
# drops a letter, model 0 copies. So SQL can state every distance without computing it.
DERIVED: dict[str, str] = {
    "answers": """
        SELECT doc_id AS sample_id, 'model-' || cast(k AS string) AS run_key, k, text AS reference,
               lang, source, n_chars, (doc_id * 31 + k * 17) % 50 <> 7 AS ok,
               CASE WHEN (doc_id * 31 + k * 17) % 50 = 7 THEN NULL
                    WHEN k = 1 THEN replace(replace(replace(text, ' the ', ' '), ' la ', ' '), ' die ', ' ')
                    WHEN k = 2 THEN replace(text, 'e', '¤')
                    WHEN k = 3 THEN replace(text, 'n', '')
                    ELSE text END AS output,
               CASE WHEN (doc_id * 31 + k * 17) % 50 = 7
                    THEN CASE doc_id % 3 WHEN 0 THEN 'HTTP 503: upstream ' || cast(doc_id % 7 AS string) || ' busy: retry'
                                         WHEN 1 THEN 'Timeout: ' || cast(doc_id AS string) || ' s'
                                         ELSE 'gave up after 5: HTTP 429: slow down' END END AS error,
               cast((doc_id * 37 + k * 101) % 1000 AS double) / 100 AS latency_s,
               CASE WHEN doc_id % 13 = 0 THEN 'length' WHEN doc_id % 17 = 0 THEN NULL ELSE 'stop' END AS finish_reason,
               n_chars % 900 AS prompt_tokens, n_chars % 700 AS completion_tokens, doc_id % 3 + 1 AS attempts
        FROM (SELECT *, {EACH:0,1,2,3} AS k FROM {documents}) x""",
    "word_answers": """
        SELECT doc_id AS sample_id, k, text AS reference,
               CASE k WHEN 1 THEN replace(replace(replace(text, ' the ', ' '), ' la ', ' '), ' die ', ' ')
                      WHEN 2 THEN replace(text, 'e', '¤') ELSE text END AS output
        FROM (SELECT *, {EACH:0,1,2} AS k FROM {documents}) x""",
    # Latin letters written as Devanagari ones, so syllable units are many characters. Model 0
    # writes digits the Latin way, model 1 drops words, model 2 writes one vowel sign as
    # another that no reference has.
    "devanagari": """
        SELECT sample_id, k, translate(lower(reference), 'bcdfghjklmnpqrstvwxyzaeiou0123456789',
                   'बचदफगहजकलमनपटरसतवयझधखाेिोु०१२३४५६७८९') AS reference,
               CASE k WHEN 0 THEN translate(lower(reference), 'bcdfghjklmnpqrstvwxyzaeiou', 'बचदफगहजकलमनपटरसतवयझधखाेिोु')
                      WHEN 1 THEN translate(lower(output), 'bcdfghjklmnpqrstvwxyzaeiou0123456789', 'बचदफगहजकलमनपटरसतवयझधखाेिोु०१२३४५६७८९')
                      ELSE translate(lower(reference), 'bcdfghjklmnpqrstvwxyzaeiou0123456789', 'बचदफगहजकलमनपटरसतवयझधखाॆिोु०१२३४५६७८९') END AS output
        FROM {word_answers}""",
    # A user turn followed by the assistant's is a question and its answer. Reply 0 repeats
    # the answer, 1 wraps it in prose, 2 has a letter replaced, 3 refuses.
    "qa_pairs": """
        SELECT cast(conv_id AS string) || '#q' || cast(turn AS string) AS sample_id, text AS question, answer,
               (conv_id * 7 + turn) % 3 <> 0 AS answerable, k,
               CASE k WHEN 0 THEN answer WHEN 1 THEN 'The answer is: ' || answer || ' (see page 1)'
                      WHEN 2 THEN replace(answer, 'e', '¤')
                      ELSE CASE conv_id % 3 WHEN 0 THEN 'ANSWER NOT PRESENT' WHEN 1 THEN 'Sorry, not found.' ELSE '"Answer, not present!"' END END AS output
        FROM (SELECT *, {EACH:0,1,2,3} AS k FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer,
                     lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM {conversations}) c
              WHERE role = 'user' AND next_role = 'assistant') x""",
    "prediction_log": """
        SELECT event_id AS seq, 'run-' || cast(user_id % 8 AS string) AS run_key,
               's-' || cast(event_id % 500 AS string) AS sample_id, event_type <> 'error' AS ok,
               CASE WHEN event_type <> 'error' THEN event_type END AS output,
               value AS latency_s, ts, event_id % 4 + 1 AS attempts
        FROM {events}""",
    "log_samples": """
        SELECT DISTINCT 'run-' || cast(user_id % 8 AS string) AS run_key, 's-' || cast(event_id % 520 AS string) AS sample_id
        FROM {events}""",
    "results": """
        SELECT 'r-' || cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) || '-' ||
                   cast(l_partkey AS string) || '-' || cast(l_suppkey AS string) AS run_id,
               'm-' || cast(l_suppkey AS string) AS model_id, lower(replace(p_brand, '#', '-')) AS benchmark_id,
               cast(l_shipdate AS date) AS created_at,
               CASE WHEN l_returnflag = 'R' THEN 'imported' ELSE 'measured' END AS source_kind,
               cast(l_quantity AS bigint) AS cases, cast(40 AS bigint) AS full_cases, l_partkey % 4 AS errors,
               CASE WHEN l_partkey % 11 = 0 THEN 'cer' ELSE 'score' END AS primary_metric,
               cast(substr(p_brand, 7) AS int) % 2 = 0 AS higher_is_better,
               CASE WHEN cast(substr(p_brand, 7) AS int) % 5 = 0 THEN NULL ELSE cast(100 AS double) END AS scale_max,
               CASE WHEN l_orderkey % 29 = 0 THEN '0' ELSE '1' END AS version,
               CASE cast(substr(p_brand, 7) AS int) % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'document' ELSE 'math' END AS category,
               round(100 * (1 - l_discount) - l_tax * 50 + cast((l_partkey * 7 + l_suppkey * 3) % 100 AS double) / 100, 4) AS score,
               CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE cast((l_orderkey * 7 + l_partkey * 13) % 40 AS double) / 10 END AS half_width,
               cast((l_partkey * 17) % 1000 AS double) / 10 AS cer,
               CASE l_linenumber % 3 WHEN 0 THEN 'cer' ELSE 'score' END AS other_metric
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "models": """
        SELECT 'm-' || cast(s_suppkey AS string) AS model_id, s_name AS display_name, n_name AS org,
               CASE WHEN s_suppkey % 9 = 0 THEN 'ocr_engine' ELSE 'vlm' END AS model_kind,
               CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey % 2 = 0 END AS open_weights
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "prices": """
        SELECT 'm-' || cast(s_suppkey AS string) AS model_id,
               CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE round(abs(s_acctbal) / 1000, 3) END AS input_price,
               CASE WHEN s_suppkey % 7 = 1 THEN NULL ELSE round(abs(s_acctbal) / 250, 3) END AS output_price,
               CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 4096 * (1 + s_suppkey % 8) END AS context_length
        FROM {supplier} WHERE s_suppkey % 10 <> 3""",
}

Engine = Callable[[str], str]


def _each(engine: str) -> Engine:
    if engine == "spark":
        return lambda items: f"explode(array({items}))"
    return lambda items: f"unnest([{items}])"


def _text(sql: str, engine: str) -> str:
    return re.sub(r"\{EACH:([^}]*)\}", lambda m: _each(engine)(m.group(1)), sql)


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Tables:
    """Base and derived tables of one scale-factor folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in DERIVED:
                self._made[name] = self.sql(DERIVED[name])
            else:
                raise AttributeError(name)
        return self._made[name]

    def sql(self, sql: str) -> DataFrame:
        text = _text(sql, "spark")
        return self.spark.sql(text, **{n: self.get(n) for n in names_in(text)})


def oracle(sql: str) -> str:
    """The DuckDB text of a query over base and derived tables: a WITH chain."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in names_in(_text(text, "duckdb")):
            if name in DERIVED and name not in order:
                visit(DERIVED[name])
                order.append(name)

    visit(sql)

    def plain(text: str) -> str:
        return re.sub(r"\{(\w+)\}", r"\1", _text(text, "duckdb"))

    body = plain(sql).strip()
    ctes = ",\n".join(f"{n} AS ({plain(DERIVED[n])})" for n in order)
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Registry:
    """Queries by name with their oracle SQL."""

    def __init__(self) -> None:
        self.run: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def wrap(fn: Callable[[Tables], DataFrame]):
            self.run[name] = lambda spark, folder: fn(Tables(spark, folder))
            if sql is not None:
                self.sql[name] = oracle(sql)
            return fn
        return wrap


registry = Registry()
query = registry.add
