"""Structured scoring and document views over documents, orders, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scorelake.operators import docviews as D
from scorelake.operators import kv, layout, qa, reading_order, tables
from scorelake.plans.workload import query


# --- key-value ----------------------------------------------------------------------------

_KV = {"status": "o_orderstatus", "priority": "o_orderpriority", "total": "cast(cast(floor(o_totalprice) as bigint) as string)",
       "day": "cast(cast(o_orderdate as date) as string)", "customer": "'cust ' || cast(o_custkey as string)"}


def _order_fields(t):
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.expr(v).alias("value")) for k, v in _KV.items()])
    return t.orders.select("o_orderkey", pairs.alias("pairs"))


def _kv_samples(t):
    """Replies drop the status of every 7th order, alter the priority of every 5th and add a
    field to every 11th; every 13th order has no reply."""
    def altered(p):
        return F.struct(p["key"].alias("key"), F.when((p["key"] == "priority") & (F.col("o_orderkey") % 5 == 0), F.concat(p["value"], F.lit("x"))).otherwise(p["value"]).alias("value"))

    kept = F.filter(F.transform("pairs", altered), lambda p: ~((p["key"] == "status") & (F.col("o_orderkey") % 7 == 0)))
    extra = F.when(F.col("o_orderkey") % 11 == 0, F.array(F.struct(F.lit("note").alias("key"), F.lit("none").alias("value")))).otherwise(
        F.array().cast("array<struct<key:string,value:string>>"))
    doc = F.to_json(F.map_from_entries(F.concat(kept, extra)))
    ok = F.col("o_orderkey") % 13 != 0
    return _order_fields(t).select(F.col("o_orderkey").alias("sample_id"), ok.alias("ok"), F.when(ok, F.concat(F.lit("```json\n"), doc, F.lit("\n```"))).alias("output"))


@query("g_kv", """WITH n AS (SELECT o_orderkey AS k, length(o_orderpriority) AS len, 5 - cast(o_orderkey % 7 = 0 AS int) + cast(o_orderkey % 11 = 0 AS int) AS np,
        5 - cast(o_orderkey % 7 = 0 AS int) - cast(o_orderkey % 5 = 0 AS int) AS tp FROM {orders})
    SELECT k AS sample_id, round(CASE WHEN k % 13 = 0 THEN 0 ELSE 2 * (tp / np) * (tp / 5) / (tp / np + tp / 5) END, 6) AS kv_f1,
        round(CASE WHEN k % 13 = 0 THEN 0 ELSE tp / np END, 6) AS kv_precision, round(CASE WHEN k % 13 = 0 THEN 0 ELSE tp / 5 END, 6) AS kv_recall,
        round(CASE WHEN k % 13 = 0 THEN 0 ELSE (tp + CASE WHEN k % 5 = 0 THEN 1 - 1 / (len + 1) ELSE 0 END) / 5 END, 6) AS kv_value_sim,
        cast(k % 13 <> 0 AND tp = 5 AND np = 5 AS double) AS kv_doc_exact, cast(k % 13 <> 0 AS double) AS kv_parse_ok FROM n""")
def g_kv(t):
    fields = _order_fields(t).select(F.col("o_orderkey").alias("sample_id"), F.explode("pairs").alias("p")).select("sample_id", "p.key", "p.value")
    out = kv.score_kv(_kv_samples(t), fields)
    rounded = [F.round(m, 6).alias(m) for m in ("kv_f1", "kv_precision", "kv_recall", "kv_value_sim")]
    return out.select("sample_id", *rounded, "kv_doc_exact", "kv_parse_ok")


@query("j_multiset_intersection", """SELECT g.run_key, cast(sum(least(g.n, p.n)) AS bigint) AS shared FROM
    (SELECT run_key, sample_id, output, count(*) AS n FROM {prediction_log} WHERE output IS NOT NULL AND seq % 2 = 0 GROUP BY ALL) g JOIN
    (SELECT run_key, sample_id, output, count(*) AS n FROM {prediction_log} WHERE output IS NOT NULL AND seq % 3 = 0 GROUP BY ALL) p
    ON g.run_key = p.run_key AND g.sample_id = p.sample_id AND g.output = p.output GROUP BY g.run_key""")
def j_multiset_intersection(t):
    rows = t.prediction_log.filter("output IS NOT NULL").select(F.col("run_key"), F.col("sample_id").alias("key"), F.col("output").alias("value"), "seq")
    rows = rows.withColumnRenamed("run_key", "sample_id")
    shared = kv.shared_pairs(rows.filter("seq % 2 = 0"), rows.filter("seq % 3 = 0"), "shared")
    return shared.withColumnRenamed("sample_id", "run_key")


# --- questions ----------------------------------------------------------------------------

_WS = "'\\s+', ' ', 'g'"
_LEN = f"length(trim(regexp_replace(answer, {_WS})))"
_ANLS = f"""(CASE k WHEN 0 THEN 1.0 WHEN 2 THEN 1 - (length(answer) - length(replace(answer, 'e', ''))) / {_LEN}
    WHEN 1 THEN {_LEN} / length(trim(regexp_replace(output, {_WS}))) ELSE CASE WHEN conv_id % 3 <> 1 OR {_LEN} > 34 THEN 0
    ELSE 1 - levenshtein(lower(answer), lower(output)) / greatest(length(answer), length(output)) END END)"""


@query("g_qa", f"""WITH s AS (SELECT *, k = 3 AND conv_id % 3 <> 1 AS strict, CASE WHEN {_ANLS} >= 0.5 THEN {_ANLS} ELSE 0 END AS a
        FROM (SELECT *, cast(split_part(sample_id, '#', 1) AS bigint) AS conv_id FROM {{qa_pairs}}) x)
    SELECT sample_id, k, round(CASE WHEN answerable THEN CASE WHEN strict THEN 0 ELSE a END ELSE cast(strict AS double) END, 6) AS qa_score,
        round(CASE WHEN answerable THEN CASE WHEN strict THEN 0 ELSE a END END, 6) AS anls_answerable,
        CASE WHEN answerable THEN cast(strict AS double) END AS false_abstention, CASE WHEN NOT answerable THEN cast(strict AS double) END AS abstention_accuracy,
        CASE WHEN NOT answerable THEN cast(k = 3 AS double) END AS abstained_loose FROM s""")
def g_qa(t):
    pairs = t.qa_pairs.select("sample_id", "k", F.lit(True).alias("ok"), "output", F.when(F.col("answerable"), F.array("answer")).otherwise(
        F.array().cast("array<string>")).alias("references"), "answerable")
    out = qa.score_qa(pairs)
    return out.select("sample_id", "k", F.round("qa_score", 6).alias("qa_score"), F.round("anls_answerable", 6).alias("anls_answerable"),
                      "false_abstention", "abstention_accuracy", "abstained_loose")


# --- reading order ------------------------------------------------------------------------


@query("g_reading_order", f"""WITH lines AS (SELECT doc_id, i, trim(regexp_replace(line, {_WS})) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {{documents}}) x),
    blocks AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS up, row_number() OVER (PARTITION BY doc_id, line ORDER BY i DESC) AS down,
        doc_id % 3 = 2 AND contains(line, 'th') AS gone FROM lines WHERE line <> ''),
    matched AS (SELECT g.doc_id, g.i AS gi, CASE WHEN g.doc_id % 3 = 1 THEN -p.i ELSE g.i END AS li FROM blocks g JOIN blocks p
        ON g.doc_id = p.doc_id AND g.line = p.line AND g.down = p.up WHERE NOT g.gone),
    pairs AS (SELECT a.doc_id, count(*) FILTER (a.li < b.li) / count(*) AS o FROM matched a JOIN matched b ON a.doc_id = b.doc_id AND a.gi < b.gi GROUP BY a.doc_id)
    SELECT n.doc_id AS sample_id, round(o, 6) AS reading_order, round(found / n, 6) AS block_recall
    FROM (SELECT doc_id, count(*) AS n, count(*) FILTER (NOT gone) AS found FROM blocks GROUP BY doc_id) n LEFT JOIN pairs p ON n.doc_id = p.doc_id""")
def g_reading_order(t):
    """Every third reply has its lines reversed, every third lacks those with "th"."""
    lines = F.split("text", "\n")
    kind = F.col("doc_id") % 3
    reply = F.when(kind == 1, F.reverse(lines)).when(kind == 2, F.filter(lines, lambda x: ~F.contains(x, F.lit("th")))).otherwise(lines)
    samples = t.documents.select(F.col("doc_id").alias("sample_id"), F.lit(True).alias("ok"), F.array_join(reply, "\n").alias("output"), lines.alias("blocks"))
    out = reading_order.score_reading_order(samples)
    return out.select("sample_id", F.round("reading_order", 6).alias("reading_order"), F.round("block_recall", 6).alias("block_recall"))


# --- layout -------------------------------------------------------------------------------


def _regions(t):
    """Six stacked regions per page; replies move them sideways and change some roles."""
    page = F.col("page_id")
    r = t.pages.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("r"))
    shift = (page * 7 + F.col("r") * 3) % 5 * 100
    top = F.col("r") * 160 + 10
    return r.select("page_id", "r", F.concat(F.lit("role"), (page + F.col("r")) % 3).alias("role"),
                    F.array(F.lit(100), top, F.lit(720), top + 120).alias("box"),
                    F.when((page + F.col("r")) % 4 == 0, "other").otherwise(F.concat(F.lit("role"), (page + F.col("r")) % 3)).alias("said"),
                    F.array(F.lit(100) + shift, top, F.lit(720) + shift, top + 120).alias("moved"))


@query("g_layout", """WITH r AS (SELECT page_id, (page_id * 7 + r * 3) % 5 <= 2 AS hit, (page_id + r) % 4 <> 0 AS same FROM (SELECT page_id, unnest([0,1,2,3,4,5]) AS r FROM {pages}) x),
    n AS (SELECT page_id, count(*) FILTER (hit) / 6 AS d, count(*) FILTER (hit AND same) / 6 AS f FROM r GROUP BY ALL)
    SELECT page_id AS sample_id, round(f, 6) AS layout_f1, round(f, 6) AS layout_precision, round(f, 6) AS layout_recall, round(d, 6) AS detection_f1, cast(1 AS double) AS layout_parse_ok FROM n""")
def g_layout(t):
    regions = _regions(t)
    item = F.struct("r", F.struct(F.col("said").alias("role"), F.col("moved").alias("bbox")).alias("i"))
    samples = regions.groupBy("page_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["i"])).alias("output")).select(
        F.col("page_id").alias("sample_id"), F.lit(True).alias("ok"), "output", F.lit(None).cast("array<double>").alias("size"))
    gold = regions.select(F.col("page_id").alias("sample_id"), F.col("r").alias("gi"), "role", F.transform("box", lambda v: v / 1000.0).alias("box"))
    out = layout.score_layout(samples, gold)
    return out.select("sample_id", *[F.round(m, 6).alias(m) for m in layout.METRICS])


# --- tables -------------------------------------------------------------------------------

_CELLS_SQL = """cells AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS row, *
    FROM {lineitem})"""


def _cells(t):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = t.lineitem.withColumn("row", F.row_number().over(order) - 1)
    text = F.array(F.concat(F.lit("no "), F.col("l_linenumber")), F.col("l_quantity").cast("int").cast("string"), F.concat("l_returnflag", F.lit(" & "), "l_linestatus"))
    cells = rows.select(F.col("l_orderkey").alias("sample_id"), "row", F.posexplode(text).alias("col", "text"))
    return cells.withColumns({"row_span": F.lit(1), "col_span": F.lit(1)})


@query("g_table_render", f"""WITH {_CELLS_SQL}, rows AS (SELECT l_orderkey, row, '<tr><td>no ' || cast(l_linenumber AS string) || '</td><td>' || cast(cast(l_quantity AS int) AS string) ||
        '</td><td>' || l_returnflag || ' &amp; ' || l_linestatus || '</td></tr>' AS tr FROM cells)
    SELECT l_orderkey AS sample_id, md5('<table>' || string_agg(tr, '' ORDER BY row) || '</table>') AS html FROM rows GROUP BY ALL""")
def g_table_render(t):
    return tables.render_tables(_cells(t)).select("sample_id", F.md5("html").alias("html"))


@query("g_table_similarity", """SELECT l_orderkey AS sample_id, round(CASE l_orderkey % 3 WHEN 0 THEN CASE WHEN count(*) = 1 THEN 0.2 ELSE 1 - 4 / (1 + 4 * count(*)) END ELSE 1 END, 6) AS teds,
    cast(1 AS double) AS table_parse_ok FROM {lineitem} GROUP BY l_orderkey""")
def g_table_similarity(t):
    """Every third reply lacks the first row, every third is written as markdown."""
    cells = _cells(t)
    kind = F.col("sample_id") % 3
    html = tables.render_tables(cells.filter((kind != 0) | (F.col("row") > 0)))
    bars = cells.filter(kind == 1).groupBy("sample_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("c"))
    bars = bars.select("sample_id", "row", F.concat(F.lit("| "), F.array_join(F.transform("c", lambda x: x["text"]), " | "), F.lit(" |")).alias("line"))
    bars = bars.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("md"))
    keys = cells.select("sample_id").distinct()
    samples = keys.join(html, "sample_id", "left").join(bars, "sample_id", "left").select(
        "sample_id", F.lit(True).alias("ok"), F.coalesce("md", "html", F.lit("<table></table>")).alias("output"))
    out = tables.score_tables(samples, cells)
    return out.select("sample_id", F.round("teds", 6).alias("teds"), "table_parse_ok")


@query("g_table_extract", f"""WITH {_CELLS_SQL} SELECT l_orderkey AS sample_id, 0 AS table_no, row, col, text FROM (SELECT l_orderkey, row, unnest([0, 1, 2]) AS col,
    unnest(['no ' || cast(l_linenumber AS string), cast(cast(l_quantity AS int) AS string), l_returnflag || ' & ' || l_linestatus]) AS text FROM cells) x""")
def g_table_extract(t):
    rendered = tables.render_tables(_cells(t)).withColumn("html", F.concat(F.lit("Here it is:\n"), F.col("html")))
    return tables.extract_tables(rendered, "sample_id", "html").select("sample_id", "table_no", "row", "col", "text")


# --- document views -----------------------------------------------------------------------


def _documents(t, pages):
    split = F.when(F.col("doc_id") % 9 == 0, "train").otherwise("test")
    docs = t.documents.select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.col("lang").alias("doc_type"), split.alias("split"), pages.alias("pages"))
    return D.select_documents(docs.withColumn("page_count", F.size("pages")), ["test"])


@query("g_page_view", f"""WITH lines AS (SELECT doc_id, i, trim(regexp_replace(replace(line, '[LOGO]', ' '), {_WS})) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM {{documents}} WHERE doc_id % 9 <> 0) x)
    SELECT 'd' || cast(doc_id AS string) || '#p1' AS sample_id, count(*) AS blocks, md5(string_agg(line, ' ' ORDER BY i)) AS reference FROM lines WHERE line <> '' GROUP BY doc_id""")
def g_page_view(t):
    page = F.struct(F.lit(1).alias("page_number"), F.concat(F.lit("[LOGO]\n"), F.replace("text", F.lit("\n"), F.lit("\n[LOGO] "))).alias("text"))
    blank = F.struct(F.lit(2).alias("page_number"), F.lit(" [LOGO]\n ").alias("text"))
    out = D.page_view(_documents(t, F.array(page, blank)))
    return out.select("sample_id", F.size("blocks").alias("blocks"), F.md5(F.element_at("references", 1)).alias("reference"))


@query("g_kv_view", """SELECT 'o' || cast(o_orderkey AS string) AS sample_id, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 3 END AS n_fields,
    CASE WHEN o_orderkey % 4 = 0 THEN 'status' ELSE 'status, priority' END AS question FROM {orders} WHERE o_orderkey % 5 <> 0""")
def g_kv_view(t):
    key = F.concat(F.lit("o"), F.col("o_orderkey"))
    docs = t.orders.select(key.alias("id"), F.array(F.lit(1)).alias("pages"), F.when(F.col("o_orderkey") % 5 == 0, 2).otherwise(1).alias("page_count"))
    value = F.array(F.struct(F.lit("status").alias("name"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("status").alias("name"), F.lit("x").alias("value")),
                    F.struct(F.lit("priority").alias("name"), F.when(F.col("o_orderkey") % 4 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("value")))
    fields = t.orders.select(key.alias("id"), F.posexplode(value).alias("pos", "f")).select("id", "pos", "f.name", "f.value")
    return D.kv_view(docs, fields).select("sample_id", "n_fields", "question")


@query("g_qa_view", """WITH turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM {conversations} WHERE role <> 'system'),
    pairs AS (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS next FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY i))
    SELECT 'c' || cast(conv_id AS string) || CASE WHEN conv_id % 4 = 0 THEN '_eb07' ELSE '' END || '#q' || cast(cast(floor(i / 2) AS bigint) AS string) AS sample_id,
        md5(trim(text)) AS question, conv_id % 6 <> 0 AS answerable FROM pairs WHERE i % 2 = 0 AND role = 'user' AND next = 'assistant' AND conv_id % 10 <> 3""")
def g_qa_view(t):
    turns = t.conversations.filter("role <> 'system'").withColumn("from", F.when(F.col("role") == "user", "human").otherwise("gpt"))
    said = F.when(F.col("from") == "human", F.concat(F.lit("<image>\n"), F.col("text"))).when(F.col("conv_id") % 6 == 0, " ANSWER NOT PRESENT").otherwise(F.col("text"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.struct("from", said.alias("value")).alias("m")))).alias("c"))
    chats = chats.select(F.concat(F.lit("c"), F.col("conv_id"), F.when(F.col("conv_id") % 4 == 0, "_eb07").otherwise("")).alias("rec_id"),
                         F.when(F.col("conv_id") % 10 == 3, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("images"),
                         F.transform("c", lambda x: x["m"]).alias("conversations"), F.lit(None).cast("string").alias("field"))
    docs = t.conversations.select(F.concat(F.lit("c"), F.col("conv_id")).alias("id")).distinct()
    return D.qa_view(docs, chats).select("sample_id", F.md5("question").alias("question"), "answerable")


def _region(**values):
    out = {"region_id": F.lit("t1"), "id": None, "role": None, "status": "rendered", "render_mode": None, "order_rank": None, "box_2d": None,
           "parent": None, "row": None, "col": None, "row_span": None, "col_span": None, "fields": None} | values
    parts = dict(p.split(":", 1) for p in D.REGION.split(",") if ":" in p)
    return F.struct(*[(v if hasattr(v, "alias") and not isinstance(v, str) else F.lit(v)).cast(parts[k]).alias(k) for k, v in out.items()])


def _box(x0, y0, x1, y1):
    return F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))


def _order_docs(t):
    """One page per order: a title, a structured table with two cells whose words come from
    the order, and for every sixth order a table without cells."""
    lit = lambda v: F.lit(float(v))
    right = lit(300) + F.col("o_orderkey") % 50
    cell = lambda c, f: _region(role="table_cell", region_id=F.lit(f"c{c}"), parent="t1", row=0, col=c, fields=F.array(F.lit(f)), box_2d=_box(lit(0), lit(0), lit(1), lit(1)))
    table = _region(role="table", render_mode="structured_table", id="tab", box_2d=_box(lit(4), lit(40), right, lit(790)))
    bare = _region(role="table", render_mode="structured_table", region_id=F.lit("t2"), box_2d=_box(lit(0), lit(0), lit(9), lit(9)))
    title = _region(role="title", region_id=F.lit("h"), box_2d=_box(lit(100), lit(20), lit(500), lit(80)))
    hidden = _region(role="stamp", region_id=F.lit("s"), status="dropped", box_2d=_box(lit(1), lit(1), lit(2), lit(2)))
    regions = F.array(title, hidden, table, cell(0, "prio"), cell(1, "when"))
    regions = F.when(F.col("o_orderkey") % 6 == 0, F.array_append(regions, bare)).otherwise(regions)
    word = lambda text, field: F.struct(text.cast("string").alias("text"), F.lit(None).cast(D.POINTS).alias("box_2d"), F.lit("t1").alias("region_id"), F.lit(field).alias("field"))
    words = F.array(word(F.col("o_orderpriority"), "prio"), word(F.lit("[LOGO]"), "prio"), word(F.col("o_orderstatus"), "prio"), word(F.col("o_custkey"), "when"), word(F.lit("zzz"), "else"))
    norm = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.struct(F.lit("h").alias("region_id"), _box(lit(0.125), lit(0.025), lit(0.5), lit(0.1)).alias("box_2d"))))
    page = F.struct(F.lit(1).alias("page_number"), lit(1000).alias("image_w"), lit(800).alias("image_h"), regions.alias("regions"), norm.alias("regions_norm"), words.alias("bboxes"))
    return t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"), F.array(page).alias("pages"), F.lit(1).alias("page_count"))


@query("g_table_view", """SELECT 'o' || cast(o_orderkey AS string) || '#p1#tab' AS sample_id, md5('<table><tr><td>' || o_orderpriority || ' ' || o_orderstatus || '</td><td>' ||
    cast(o_custkey AS string) || '</td></tr></table>') AS html, '0,32,' || cast(308 + o_orderkey % 50 AS string) || ',798' AS crop FROM {orders}""")
def g_table_view(t):
    out = D.table_view(_order_docs(t))
    return out.select("sample_id", F.md5(F.element_at("references", 1)).alias("html"), F.array_join("crop", ",").alias("crop"))


@query("g_layout_view", """SELECT 'o' || cast(o_orderkey AS string) || '#p1' AS sample_id, CASE WHEN o_orderkey % 6 = 0 THEN 3 ELSE 2 END AS regions,
    cast(CASE WHEN o_orderkey % 2 = 0 THEN 0.125 ELSE 0.1 END AS double) AS title_left FROM {orders}""")
def g_layout_view(t):
    out = D.layout_view(_order_docs(t))
    title = F.element_at(F.filter("regions", lambda r: r["role"] == "title"), 1)
    return out.select("sample_id", F.size("regions").alias("regions"), title["box"][0].alias("title_left"))


@query("a_skip_counts", """SELECT 'table' AS view, 'table_without_cells' AS reason, count(*) AS n FROM {orders} WHERE o_orderkey % 6 = 0
    UNION ALL SELECT 'page', 'empty_page', count(*) FROM {orders} UNION ALL SELECT 'kv', 'no_fields', count(*) FROM {orders} WHERE o_orderkey % 4 = 0
    UNION ALL SELECT 'qa', 'multi_image', count(*) FROM {orders} WHERE o_orderkey % 10 = 3""")
def a_skip_counts(t):
    docs = _order_docs(t).withColumn("pages", F.transform("pages", lambda p: p.withField("text", F.lit(" [LOGO] "))))
    key = F.concat(F.lit("o"), F.col("o_orderkey"))
    fields = t.orders.select(key.alias("id"), F.lit(0).alias("pos"), F.lit("x").alias("name"), F.when(F.col("o_orderkey") % 4 != 0, "y").alias("value"))
    chats = t.orders.select(key.alias("rec_id"), F.when(F.col("o_orderkey") % 10 == 3, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("images"))
    return D.skip_counts(docs, fields, chats)
