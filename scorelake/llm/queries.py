"""The registered queries of this package: whole tables in, whole results out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import langid, licenses, merkle, minhash, mixing, neighbours, phrases, pieces, quality, tokens, topk, warc, whitening
from scorelake.llm.common import materialise, shared_folder
from scorelake.llm.sampling import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def folder_for(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_simple8b")
def op1_simple8b(spark: SparkSession, folder: str) -> DataFrame:
    out = folder_for(spark, "token-ids")
    materialise(tokens.write_token_files(table(spark, folder, "documents"), out, vocabulary("byte_bpe_50k.json")))
    return tokens.read_token_digests(spark, out)


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    done = pieces.encoded(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"), ids=False, spans=False)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "aligned")


@query("op3_maxscore", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5""")
def op3_maxscore(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.weighted(table(spark, folder, "embeddings"))
    return topk.top_k(vectors.where("id % 50 = 0"), vectors, 5)


@query("op4_superminhash", f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
    x AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
          FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    e AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
    r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
    SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON doc_id = a""")
def op4_superminhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query("op6_signature_rules")
def op6_signature_rules(spark: SparkSession, folder: str) -> DataFrame:
    seen = licenses.license_spans(table(spark, folder, "documents"))
    base = F.transform("base", lambda x: x["label"])
    every = F.concat(base, F.transform("found", lambda x: x["label"]))
    surest = F.array_max(F.concat(F.transform("found", lambda x: x["confidence"]), F.transform("base", lambda x: F.lit(0.8))))
    return seen.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.transform("base", lambda x: x["word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["word"])).alias("last_word"), F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("labels"), F.coalesce(surest, F.lit(0.0)).alias("score"))


@query("op7_weak_supervision")
def op7_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    return quality.rated(table(spark, folder, "documents")).select("doc_id", *quality.FEATURES, "base_failed", "kept", "posterior")


@query("op10_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
    g AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p),
    d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
              (((('0x' || substr(hex, (k // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1)::BIGINT, 1)), '') AS b32 FROM g)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes, b32 AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, TRUE AS intact FROM d""")
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    out = folder_for(spark, "archives")
    materialise(warc.write_warc(table(spark, folder, "pages"), out))
    read = warc.read_warc(spark, out, payload=False)
    return read.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"), "intact")


@query("op5_pfair_mix")
def op5_pfair_mix(spark: SparkSession, folder: str) -> DataFrame:
    slim = table(spark, folder, "documents").select("doc_id", "source", F.octet_length("text").alias("bytes"), F.xxhash64("doc_id", "text").alias("order"))
    made = mixing.mixed(slim, 0.7, size=F.col("bytes"), place=F.col("order"))
    return made.select("doc_id", "mix.source", "mix.block", "mix.epoch", "mix.slot", "mix.size")


@query("op8_ftrl_langid")
def op8_ftrl_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.identified(docs, langid.train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op9_lsa_neighbours")
def op9_lsa_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = neighbours.scored(docs, neighbours.train(docs, table(spark, folder, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def _leaf_sql(text: str) -> str:
    cell = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    return "sha256(" + " || ".join(cell(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_FOLD = """sha256(array_to_string(n.nodes[f.pos // 8 * 8 + 1:f.pos], '') || f.node || array_to_string(n.nodes[f.pos + 2:f.pos // 8 * 8 + 8], '')),
           f.proof || array_to_string(n.nodes[f.pos // 8 * 8 + 1:f.pos], '') || array_to_string(n.nodes[f.pos + 2:f.pos // 8 * 8 + 8], '')"""
_ABOVE = "list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[i * 8 + 1:i * 8 + 8], '')))"
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, len(doc_id::VARCHAR) + 1),
          lambda i: [ord(substr(doc_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
          lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"""


def checked_manifest(docs: DataFrame, levels: int = merkle.LEVELS) -> DataFrame:
    """Each document's leaf and proof, folded again after the text of every third document was lower-cased."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), lower]))
    made = merkle.manifest(docs, also={"altered": altered}, levels=levels)
    made = made.withColumn("folded_root", merkle.folded(F.coalesce("altered", "leaf"), F.col("proof")))
    return made.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op13_merkle_butterfly", f"""
    WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf_sql("text")} AS leaf, {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered,
                                doc_id IS NOT NULL AND {_CRC} % 3 = 0 AS tampered FROM documents),
    p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
    t(lang, level, nodes) AS (SELECT lang, 0, list(leaf ORDER BY pos) FROM p GROUP BY lang UNION ALL SELECT lang, level + 1, {_ABOVE} FROM t WHERE len(nodes) > 1),
    s AS (SELECT lang, level AS depth, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM t WHERE len(nodes) = 1),
    u(level, nodes) AS (SELECT 0, list(subroot ORDER BY tree) FROM s UNION ALL SELECT level + 1, {_ABOVE} FROM u WHERE len(nodes) > 1),
    f(doc_id, lang, leaf, level, pos, node, proof) AS (
        SELECT doc_id, lang, leaf, 0, pos, CASE WHEN tampered THEN lowered ELSE leaf END, '' FROM p
        UNION ALL SELECT f.doc_id, f.lang, f.leaf, f.level + 1, f.pos // 8, {_FOLD} FROM f JOIN t AS n ON f.lang IS NOT DISTINCT FROM n.lang AND f.level = n.level AND len(n.nodes) > 1),
    g(doc_id, leaf, subroot, level, pos, node, proof) AS (
        SELECT doc_id, leaf, subroot, 0, tree, node, proof FROM f JOIN s ON f.lang IS NOT DISTINCT FROM s.lang AND f.level = s.depth
        UNION ALL SELECT f.doc_id, f.leaf, f.subroot, f.level + 1, f.pos // 8, {_FOLD} FROM g AS f JOIN u AS n ON f.level = n.level AND len(n.nodes) > 1)
    SELECT doc_id, leaf, subroot, nodes[1] AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = nodes[1] AS verified
    FROM g JOIN u ON g.level = u.level AND len(u.nodes) = 1""")
def op13_merkle_butterfly(spark: SparkSession, folder: str) -> DataFrame:
    return checked_manifest(table(spark, folder, "documents"))


def whitened_rows(vectors: DataFrame) -> DataFrame:
    done = whitening.whitened(vectors)
    return done.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


@query("op11_cholesky_whitening")
def op11_cholesky_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitened_rows(table(spark, folder, "embeddings"))


def contaminated_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    made = phrases.contamination(docs, items).withColumn("n_hit", phrases.covered(F.col("hits")))
    return made.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op12_positional_index", f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    i AS (SELECT item_id, w, least(len(w), 10) AS size FROM b WHERE len(w) > 0),
    q AS (SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda k: array_to_string(w[k:k + size - 1], ' '))) AS phrase FROM i),
    s AS (SELECT r, pos, array_to_string(w[pos:pos + size - 1], ' ') AS phrase, size
          FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d, (SELECT DISTINCT size FROM i) WHERE len(w) >= size)),
    m AS (SELECT r, pos, size, item_id FROM s JOIN q USING (size, phrase)),
    h AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(pos, pos + size)) AS place FROM (SELECT DISTINCT r, pos, size FROM m)) GROUP BY r),
    t AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)""")
def op12_positional_index(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
