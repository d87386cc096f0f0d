"""A document as one JSON line: its pages with their regions, and its fonts; or its text alone; or its vector kinds.

Lengths are rounded to tenths. Flags that don't hold and nulls are left out. A document without pages is a line with its
status. A page's regions are collected into that page's row: a page is the largest unit that one row holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.geometry import r1
from pagewright.operators.document import KEYS, Regions
from pagewright.operators.layout import page_text, unmapped_by_font, word_lines

_BOX = ("x0", "y0", "x1", "y1")


def _box() -> list[Column]:
    return [r1(F.col(c)).alias(c) for c in _BOX]


def _held(*names: str) -> list[Column]:
    """Flags as true or left out."""
    return [F.when(F.col(c), F.lit(True)).alias(c) for c in names]


def _by_page(df: DataFrame, order: str, name: str, *cols: Column | str) -> DataFrame:
    s = df.select(*KEYS, F.col(order).cast("long").alias("_o"), F.struct(*cols).alias("_s"))
    return s.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_s"))), lambda x: x["_s"]).alias(name))


def pages_json(r: Regions, glyphs: bool = False) -> DataFrame:
    """(doc_id, page_n, page: JSON of one page)."""
    w = word_lines(r.words)
    parts = [
        _by_page(r.map, "id", "map", "id", "what", F.col("idx").alias("index"), *_box(), "flags"),
        _by_page(w, "first_ord", "words", "text", *_box(), "line", "font", r1(F.col("size")).alias("size"), F.when(F.col("n_unmapped") > 0, F.col("n_unmapped")).alias("unmapped"), *_held("invisible", "white", "annot", "offpage", "hidden")),
        _by_page(r.images, "image_idx", "images", *_box(), "px_w", "px_h", r1(F.col("dpi_x")).alias("dpi_x"), r1(F.col("dpi_y")).alias("dpi_y"), "obj", F.when(F.col("parts") > 1, F.col("parts")).alias("parts"), *_held("mask", "inline", "annot", "clipped", "offpage", "hidden")),
        _by_page(r.vectors, "ord", "paths", *_box(), "n_paths", *_held("fill", "stroke", "shading", "white", "empty", "annot", "clipped", "offpage", "hidden")),
        _by_page(r.annots, "ord", "annots", *_box(), "subtype", "field", *_held("hidden", "appearance", "offpage")),
        _by_page(r.rules, "ord", "rules", *_BOX),
        _by_page(r.ocr_regions, "image_idx", "regions", *_box(), "image_idx", F.floor(F.col("confidence") * 1000 + 0.5).alias("confidence_e3"), "reasons", "text_words", "layer_words", *_held("mask", "annot", "small")),
    ]
    n = r.glyphs.groupBy(*KEYS).agg(F.count("*").alias("glyph_count"), F.count_if(~F.col("mapped")).alias("unmapped"))
    out = r.pages.join(r.verdicts.select(*KEYS, "verdict"), KEYS).join(n, KEYS, "left")
    if glyphs:
        parts.append(_by_page(r.glyphs, "ord", "glyphs", F.col("text").alias("c"), *_box(), r1(F.col("ux")).alias("ox"), r1(F.col("uy")).alias("oy"), r1(F.col("size")).alias("size"), F.coalesce("font", F.lit(-1)).alias("f"), *_held("invisible", "white", "annot", "offpage", "clipped", "hidden"), F.when(~F.col("mapped"), F.lit(True)).alias("unmapped")))
    for p in parts:
        out = out.join(p, KEYS, "left")
    names = ["verdict", "glyph_count", "unmapped", "images", "paths", "annots", "map", "rules", "regions", "words", *(["glyphs"] if glyphs else [])]
    page = F.struct(F.col("page_n").alias("n"), *(r1(F.col(c)).alias(c) for c in ("width", "height")), "rotate", *names)
    return out.select(*KEYS, F.to_json(page).alias("page"))


def _documents(r: Regions, pages: DataFrame) -> DataFrame:
    status = r.primitives.groupBy("doc_id").agg(F.first("status").alias("status"))
    by = pages.groupBy("doc_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("page_n", "page"))), lambda x: x["page"])).alias("pages"))
    return status.join(by, "doc_id", "left")


def documents_json(r: Regions, glyphs: bool = False) -> DataFrame:
    """(doc_id, line): one JSON line a document (S8; with glyphs S9)."""
    info = F.struct("base", "kind", "encoding", "to_unicode", "embedded", "widths")
    fonts = r.fonts.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("font", info.alias("i")))), lambda x: x["i"])).alias("fonts"))
    out = _documents(r, pages_json(r, glyphs)).join(fonts, "doc_id", "left")
    line = F.concat(F.lit('{"doc_id":'), "doc_id", F.lit(',"status":'), F.to_json(F.struct("status")).substr(F.lit(11), F.length("status") + 2), F.lit(',"pages":['), F.coalesce("pages", F.lit("")), F.lit('],"fonts":'), F.coalesce("fonts", F.lit("[]")), F.lit("}"))
    return out.select("doc_id", line.alias("line"))


def text_json(r: Regions) -> DataFrame:
    """(doc_id, line): the text of each page with counts of what has none."""
    fonts = _by_page(unmapped_by_font(r.glyphs), "first_seen", "unmapped_by_font", F.coalesce("font", F.lit(-1)).alias("font"), "n")
    t = r.pages.select(*KEYS).join(page_text(r.glyphs), KEYS, "left").join(fonts, KEYS, "left")
    page = F.struct(F.col("page_n").alias("n"), F.coalesce("glyphs", F.lit(0)).alias("glyphs"), F.coalesce("unmapped", F.lit(0)).alias("unmapped"), "unmapped_by_font", F.coalesce("invisible", F.lit(0)).alias("invisible"), F.coalesce("text", F.lit("")).alias("text"))
    out = _documents(r, t.select(*KEYS, F.to_json(page).alias("page")))
    return out.select("doc_id", F.concat(F.lit('{"doc_id":'), "doc_id", F.lit(',"pages":['), F.coalesce("pages", F.lit("")), F.lit("]}")).alias("line"))


def vector_kinds_json(r: Regions) -> DataFrame:
    """(line): one JSON line a cluster; page counts from 0."""
    k = r.vector_kinds
    box = F.array(*(r1(F.col(c)) for c in ("cx0", "cy0", "cx1", "cy1"))).alias("box")
    feats = F.struct("n", "hlines", "vlines", "rows", "cols", "rows_in", "cols_in", "rects", "open_rects", "curved", "glyphs", "filled", "framed").alias("features")
    return k.select(F.to_json(F.struct("doc_id", (F.col("page_n") - 1).alias("page"), "index", box, "kind", "confidence", "has_text", feats)).alias("line"))


def write(lines: DataFrame, path: str) -> None:
    """Lines as text files."""
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)
