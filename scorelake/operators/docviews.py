"""Benchmark samples out of nested document annotations: one reader, five views.

A document's pages, regions and words are arrays of one row, so every view is an explode
and array functions on that row; nothing is shuffled to put a page together again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions import text as X
from scorelake.operators.layout import rect
from scorelake.operators.qa import ANSWER_NOT_PRESENT
from scorelake.operators.tables import cell_html

POINTS = "array<array<double>>"
REGION = (f"region_id:string,id:string,role:string,status:string,render_mode:string,order_rank:int,box_2d:{POINTS},"
          "parent:string,row:int,col:int,row_span:int,col_span:int,fields:array<string>")
WORD = f"text:string,box_2d:{POINTS},region_id:string,field:string"
PAGE = (f"page_number:int,image_path:string,image_w:double,image_h:double,text:string,regions:array<struct<{REGION}>>,"
        f"regions_norm:array<struct<region_id:string,box_2d:{POINTS}>>,bboxes:array<struct<{WORD}>>")
META = ("doc_type", "domain", "leaf", "format_id", "intensity", "layout_profile", "font_name", "split")
DOCUMENT = ("id string, " + ", ".join(f"{m} string" for m in META) + f", page_count int, gt_path string, pages array<struct<{PAGE}>>")

# Fixed values.
LAYOUT_STATUSES = ("rendered", "non_text", "clipped")
LAYOUT_EXCLUDED = ("table_cell", "table_row")
CROP_PAD = 8


def select_documents(rows: DataFrame, splits: Sequence[str] = ()) -> DataFrame:
    """Document rows of the wanted splits; rows without pages are line-level, not documents."""
    docs = rows.filter(F.col("pages").isNotNull())
    docs = docs.filter(F.col("split").isin(list(splits))) if splits else docs
    if docs.isEmpty():
        raise ValueError("no document rows" + (f" with split in {sorted(splits)}" if splits else ""))
    return docs


def _meta(docs: DataFrame) -> list[Column]:
    return [F.col("id").alias("doc_id"), *[F.col(m) for m in META if m in docs.columns]]


def _is_single_page() -> Column:
    return F.coalesce(F.nullif("page_count", F.lit(0)), F.size("pages")) == 1


def kv_view(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Single-page documents with at least one non-blank field. ``fields``: id, pos, name,
    value. The question lists the distinct keys in order."""
    kept = fields.filter(X.strip(F.coalesce(F.col("value").cast("string"), F.lit(""))) != "")
    per_doc = kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "value"))).alias("_f"))
    pairs = F.transform("_f", lambda f: F.struct(f["name"].alias("key"), f["value"].alias("value")))
    keys = F.array_distinct(F.transform("_f", lambda f: f["name"]))
    return docs.filter(_is_single_page()).join(per_doc, "id").select(
        F.col("id").alias("sample_id"), F.array_join(keys, ", ").alias("question"), pairs.alias("fields"),
        F.size("_f").alias("n_fields"), *_meta(docs))


def qa_view(docs: DataFrame, chats: DataFrame) -> DataFrame:
    """One sample per human/model turn pair. ``chats``: rec_id, images, conversations
    (from, value), field. A record belongs to the document of the same id or of its blocked
    copies (``_eb`` and a number)."""
    single = chats.filter(F.size("images") == 1).withColumn("id", F.regexp_replace("rec_id", "_eb\\d+$", ""))
    pairs = single.select("id", "rec_id", "field", "conversations", F.posexplode("conversations").alias("k", "human"))
    pairs = pairs.filter((F.col("k") % 2 == 0) & (F.col("k") + 1 < F.size("conversations"))).withColumn(
        "gpt", F.element_at("conversations", F.col("k") + 2))
    pairs = pairs.filter("human.from = 'human' AND gpt.from = 'gpt'")
    answer = F.col("gpt.value")
    answerable = X.strip(answer) != ANSWER_NOT_PRESENT
    return pairs.join(docs.select("id", *[m for m in META if m in docs.columns]), "id").select(
        F.concat("rec_id", F.lit("#q"), F.expr("k div 2").cast("string")).alias("sample_id"),
        X.strip(F.replace(F.col("human.value"), F.lit("<image>"), F.lit(""))).alias("question"),
        F.when(answerable, F.array(answer)).otherwise(F.array().cast("array<string>")).alias("references"),
        answerable.alias("answerable"), "field", *_meta(docs))


def _pages(docs: DataFrame) -> DataFrame:
    paged = docs.select("*", F.explode("pages").alias("page"))
    return paged.withColumn("page_number", F.coalesce("page.page_number", F.lit(1)))


def _page_id() -> Column:
    return F.concat("id", F.lit("#p"), F.col("page_number").cast("string"))


def page_view(docs: DataFrame) -> DataFrame:
    """Pages with text, without the logo token: blocks in reading order."""
    blocks = X.strip_logo(F.coalesce("page.text", F.lit("")))
    pages = _pages(docs).withColumn("blocks", blocks).filter(F.size("blocks") > 0)
    return pages.select(_page_id().alias("sample_id"), F.array(F.array_join("blocks", " ")).alias("references"), "blocks",
                        "page_number", *_meta(docs))


def _structured_tables(docs: DataFrame) -> DataFrame:
    tables = _pages(docs).select("*", F.explode("page.regions").alias("table")).filter(
        "table.role = 'table' AND table.render_mode = 'structured_table' AND coalesce(table.status, 'rendered') = 'rendered'")
    cells = F.filter("page.regions", lambda r: (r["role"] == "table_cell") & (r["parent"] == F.col("table.region_id")))
    return tables.withColumn("_cells", F.coalesce(cells, F.array().cast(f"array<struct<{REGION}>>")))


def _cell_text(cell: Column) -> Column:
    words = F.filter(F.coalesce("page.bboxes", F.array().cast(f"array<struct<{WORD}>>")), lambda w: (
        (w["region_id"] == F.col("table.region_id")) & F.array_contains(cell["fields"], w["field"])
        & (F.coalesce(w["text"], F.lit("")) != X.LOGO_TOKEN)))
    return F.coalesce(F.array_join(F.transform(words, lambda w: w["text"]), " "), F.lit(""))


def table_html(cells: Column) -> Column:
    """Cells of one table as canonical HTML, origin cells in row and column order."""
    td = lambda c: cell_html(c["col_span"], c["row_span"], c["text"])
    ordered = F.array_sort(F.transform(cells, lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), td(c).alias("td"))))
    rows = F.array_distinct(F.transform(ordered, lambda c: c["row"]))
    tr = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.filter(ordered, lambda c: c["row"] == r), lambda c: c["td"]), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, tr), ""), F.lit("</table>"))


def table_view(docs: DataFrame) -> DataFrame:
    """Structured tables with their cells' words, a crop box, and the table as HTML."""
    tables = _structured_tables(docs).filter(F.size("_cells") > 0)
    cells = F.transform("_cells", lambda c: F.struct(
        c["row"].alias("row"), c["col"].alias("col"), F.coalesce(c["row_span"], F.lit(1)).alias("row_span"),
        F.coalesce(c["col_span"], F.lit(1)).alias("col_span"), _cell_text(c).alias("text")))
    tables = tables.withColumns({"cells": cells, "_rect": rect(F.col("table.box_2d"))})
    low = lambda i: F.greatest(F.lit(0), F.floor(F.abs(F.col("_rect")[i])) * F.signum(F.col("_rect")[i]) - CROP_PAD).cast("int")
    high = lambda i, most: F.least(F.coalesce(F.nullif(F.col(f"page.{most}"), F.lit(0)), F.col("_rect")[i] + CROP_PAD), F.col("_rect")[i] + CROP_PAD).cast("int")
    crop = F.array(low(0), low(1), high(2, "image_w"), high(3, "image_h"))
    name = F.coalesce("table.id", "table.region_id")
    return tables.withColumn("html", table_html(F.col("cells"))).select(
        F.concat(_page_id(), F.lit("#"), name).alias("sample_id"), F.array("html").alias("references"), "cells", crop.alias("crop"),
        (F.array_max(F.transform("cells", lambda c: c["row"])) + 1).alias("rows"), *_meta(docs))


def layout_view(docs: DataFrame) -> DataFrame:
    """Pages with their visible regions as 0-1 boxes, from the normalised region where there
    is one, else from pixels and the page size."""
    w, h = F.col("page.image_w"), F.col("page.image_h")

    def gold(r: Column) -> Column:
        given = F.filter("page.regions_norm", lambda n: n["region_id"] == r["region_id"])
        unit = rect(F.element_at(given, -1)["box_2d"])
        px = rect(r["box_2d"])
        scaled = F.when((w > 0) & (h > 0), F.array(px[0] / w, px[1] / h, px[2] / w, px[3] / h))
        box = F.when(F.coalesce(F.size(given), F.lit(0)) > 0, unit).otherwise(scaled)
        return F.struct(r["role"].alias("role"), F.transform(box, lambda v: F.round(v, 6)).alias("box"))

    shown = F.filter("page.regions", lambda r: ~r["role"].isin(*LAYOUT_EXCLUDED) & r["status"].isin(*LAYOUT_STATUSES))
    regions = F.filter(F.transform(shown, gold), lambda g: g["box"].isNotNull())
    pages = _pages(docs).withColumn("regions", regions).filter(F.size("regions") > 0)
    size = F.when((w > 0) & (h > 0), F.array(w, h))
    return pages.select(_page_id().alias("sample_id"), "regions", size.alias("size"), *_meta(docs))


def skip_counts(docs: DataFrame, fields: DataFrame, chats: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """Why documents, records, pages and tables are not samples: (view, reason, n).
    ``missing``: documents whose assets do not exist."""
    def count(view: str, reason: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("n")).select(F.lit(view).alias("view"), F.lit(reason).alias("reason"), "n")

    filled = fields.filter(X.strip(F.coalesce(F.col("value").cast("string"), F.lit(""))) != "").select("id").distinct()
    owned = chats.withColumn("id", F.regexp_replace("rec_id", "_eb\\d+$", "")).join(docs.select("id"), "id", "left_semi")
    paged = _pages(docs)
    parts = [
        count("kv", "multi_page", docs.filter(~_is_single_page())),
        count("kv", "no_fields", docs.filter(_is_single_page()).join(filled, "id", "left_anti")),
        count("qa", "multi_image", owned.filter(F.size("images") != 1)),
        count("page", "empty_page", paged.withColumn("_b", X.strip_logo(F.coalesce("page.text", F.lit("")))).filter(F.size("_b") == 0)),
        count("table", "table_without_cells", _structured_tables(docs).filter(F.size("_cells") == 0)),
        count("layout", "no_regions", paged.filter(F.coalesce(F.size("page.regions"), F.lit(0)) <= 0)),
    ]
    if missing is not None:
        parts.append(count("any", "missing_file", docs.join(missing.select("id"), "id", "left_semi")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter("n > 0")


def resolve_assets(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """``wanted``: id, candidates (paths, best first). ``files``: path. The first candidate
    that exists, NULL when none does."""
    tried = wanted.select("id", F.posexplode("candidates").alias("pos", "path")).join(files.select("path").distinct(), "path")
    found = tried.groupBy("id").agg(F.min_by("path", "pos").alias("path"))
    return wanted.select("id").join(found, "id", "left")


def asset_candidates(ref: Column, leaf: Column, root: Column) -> Column:
    name = F.substring_index(ref, "/", -1)
    return F.array(ref, F.concat_ws("/", leaf, ref), F.concat(leaf, F.lit("/images/"), name), F.concat_ws("/", root, ref))
