"""Queries from PDF bytes to words, lines, OCR regions, the map and JSON, with SQL that computes the truth from the numbers.

The documents are one page each, made from the part table: two strings in 10-point Courier (advance 6, ascent 6.29, descent
1.57), a filled rectangle, an 8 x 4 pixel image and a link without appearance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import images
from pagewright.operators.document import Regions
from pagewright.plans import page_sql
from pagewright.plans.grouped import _NUMBERS, documents_of
from pagewright.sinks import json_lines
from pagewright.sources import pdf, pixels

_TEXT = "concat('BT /F1 10 Tf 100 ', 100+h, ' Td (alpha beta) Tj 200 0 Td (gamma) Tj ET ', x, ' ', y, ' ', w, ' ', h, ' re f q ', w, ' 0 0 ', h, ' 10 20 cm /A Do Q')"
_LINK = "concat('/Annots [<< /Subtype /Link /Rect [', 10+lw, ' 20 ', 20+w, ' ', 30+h, '] /F ', CASE WHEN lw%2=0 THEN 2 ELSE 0 END, ' >>]')"
_OCR = "concat('q ', 3*w, ' 0 0 ', 3*h, ' 90 90 cm /A Do Q BT /F1 10 Tf ', lw%2*3, ' Tr 100 100 Td (alpha beta) Tj ET')"


def _regions(spark: SparkSession, sf_dir: str, content: str, extra: str = "") -> Regions:
    return Regions(pdf.paged(documents_of(spark, sf_dir, content, extra, rotated=False)))


def _e2(*cols: str) -> list[F.Column]:
    return [F.round(F.col(c) * 100).cast("long").alias(c) for c in cols]


def pdf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _regions(spark, sf_dir, _TEXT).words
    return w.select("doc_id", "page_n", "word", "text", *_e2("x0", "y0", "x1", "y1", "size"), "first_ord", "n_glyphs", "n_unmapped", "invisible", "white", "offpage")


_W = "(SELECT unnest(['alpha','beta','gamma']) AS t, unnest([1,2,3]) AS k, unnest([100,136,300]) AS a, unnest([130,160,330]) AS b, unnest([0,6,10]) AS o)"
PDF_WORDS_SQL = f"""SELECT doc_id, 1 AS page_n, k AS word, t AS text, 100*a AS x0, 100*(700-h)-629 AS y0, 100*b AS x1, 100*(700-h)+157 AS y1, 1000 AS size, o AS first_ord, length(t) AS n_glyphs, 0 AS n_unmapped, false AS invisible, false AS white, false AS offpage
FROM ({_NUMBERS}part) n CROSS JOIN {_W} g"""


def pdf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _regions(spark, sf_dir, _TEXT).lines
    return r.select("doc_id", "page_n", "region", "text", *_e2("x0", "y0", "x1", "y1"), "ord", "n_words", "n_glyphs")


_L = "(SELECT unnest(['alpha beta','gamma']) AS t, unnest([1,2]) AS k, unnest([100,300]) AS a, unnest([160,330]) AS b, unnest([0,10]) AS o, unnest([2,1]) AS w2)"
PDF_LINES_SQL = f"SELECT doc_id, 1 AS page_n, k AS region, t AS text, 100*a AS x0, 100*(700-h)-629 AS y0, 100*b AS x1, 100*(700-h)+157 AS y1, o AS ord, w2 AS n_words, length(replace(t,' ','')) AS n_glyphs FROM ({_NUMBERS}part) n CROSS JOIN {_L} g"


def pdf_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _regions(spark, sf_dir, _TEXT, _LINK).map
    return m.select("doc_id", "page_n", "id", "what", "idx", *_e2("x0", "y0", "x1", "y1"), F.array_join("flags", " ").alias("flags"))


PDF_MAP_SQL = f"""WITH n AS ({_NUMBERS}part)
SELECT doc_id, 1 AS page_n, k-1 AS id, 'text' AS what, k AS idx, 100*a AS x0, 100*(700-h)-629 AS y0, 100*b AS x1, 100*(700-h)+157 AS y1, '' AS flags FROM n CROSS JOIN {_L} g
UNION ALL SELECT doc_id, 1, 2, 'vector', 15, 100*x, 100*CASE WHEN off THEN 800-y-h ELSE greatest(0,800-y-h) END, 100*CASE WHEN off THEN x+w ELSE least(600,x+w) END, 100*(800-y), CASE WHEN off THEN 'fill offpage' WHEN x+w>600 OR y+h>800 THEN 'fill clipped' ELSE 'fill' END FROM (SELECT *, x>=600 OR y>=800 AS off FROM n) v
UNION ALL SELECT doc_id, 1, 3, 'image', 0, 1000, 100*(780-h), 100*(10+w), 78000, '' FROM n
UNION ALL SELECT doc_id, 1, 4, 'annot', 0, 100*(10+lw), 100*(770-h), 100*(20+w), 78000, CASE WHEN lw%2=0 THEN 'hidden no_appearance' ELSE 'no_appearance' END FROM n"""


def pdf_ocr_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _regions(spark, sf_dir, _OCR).ocr_regions
    return r.select(F.col("doc_id").alias("page_n"), "image_idx", "text_words", "layer_words", "small", F.floor(1e6 * F.col("confidence") + 0.3).alias("confidence_e6"))  # 0.3: few values lie at a tie


_OCR_WORDS = "(SELECT unnest([1000,1360]) AS a, unnest([1300,1600]) AS b)"
_OCR_FEATURES = f"""(SELECT doc_id AS page_n, 0 AS image_idx, 900 AS x0, 7100-30*h AS y0, least(6000,900+30*w) AS x1, 7100 AS y1, 8 AS px_w, 4 AS px_h, false AS mask, false AS offpage, CASE WHEN lw%2=0 THEN area ELSE 0 END AS vis_area, CASE WHEN lw%2=1 THEN area ELSE 0 END AS inv_area,
 CASE WHEN lw%2=0 THEN inside ELSE 0 END AS text_words, CASE WHEN lw%2=1 THEN inside ELSE 0 END AS layer_words, CASE WHEN lw%2=0 THEN 2 ELSE 0 END AS visible FROM (
 SELECT doc_id, w, h, lw, sum(greatest(0, least(900+30*w,b)-a)*greatest(0e0, least(900+30*h,1062.9e0)-984.3e0)) AS area, count(CASE WHEN (a+b)/2.0<=900+30*w AND 1023.6<=900+30*h THEN 1 END) AS inside FROM ({_NUMBERS}part) n CROSS JOIN {_OCR_WORDS} g GROUP BY doc_id, w, h, lw) t)"""
PDF_OCR_SQL = page_sql.OCR_REGIONS.replace("{features}", _OCR_FEATURES).replace("+0.5) AS confidence_e6", "+0.3) AS confidence_e6")


def pdf_text_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_lines.text_json(_regions(spark, sf_dir, _TEXT))


PDF_TEXT_JSON_SQL = """SELECT p_partkey AS doc_id, concat('{"doc_id":', p_partkey, ',"pages":[{"n":1,"glyphs":15,"unmapped":0,"invisible":0,"text":"alpha betagamma"}]}') AS line FROM part"""

ALL = {
    "pdf_words": (pdf_words, PDF_WORDS_SQL), "pdf_lines": (pdf_lines, PDF_LINES_SQL), "pdf_map": (pdf_map, PDF_MAP_SQL), "pdf_ocr_regions": (pdf_ocr_regions, PDF_OCR_SQL), "pdf_text_json": (pdf_text_json, PDF_TEXT_JSON_SQL),
}


def _scan(spark: SparkSession, sf_dir: str, content: str, extra: str = "", kind: str = "path") -> DataFrame:
    return pdf.scan(documents_of(spark, sf_dir, content, extra, rotated=False), kind)


def pdf_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I8: paths that are points, by cap and paint: dots, empty, or neither."""
    content = "concat(lw%2, ' J ', 100+w, ' ', 100+h, ' m h ', CASE lw%3 WHEN 0 THEN 'S' WHEN 1 THEN 'B' ELSE 'f' END)"
    return _scan(spark, sf_dir, content).select("doc_id", "dot", "empty")


PDF_POINTS_SQL = f"SELECT doc_id, lw%2=1 AND lw%3<>2 AS dot, lw%2=0 AND lw%3=0 AS empty FROM ({_NUMBERS}part) n"


def pdf_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thin bar, a slanted and a level line, and a stroked rectangle that repeats one of its sides."""
    content = "concat('50 ', 300+h, ' ', w, ' 2 re f 50 50 m ', 60+w, ' ', 51+lw, ' l S 100 100 m ', 100+w, ' 100 l S 100 100 ', w, ' ', h, ' re S')"
    return _scan(spark, sf_dir, content, kind="rule").select("doc_id", *(F.round(F.col(c) * 10).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")))


PDF_RULES_SQL = f"""SELECT DISTINCT doc_id, 10*x0 AS x0, 10*y0 AS y0, 10*x1 AS x1, 10*y1 AS y1 FROM (SELECT doc_id, unnest([50,100,100,100,100+w]) AS x0, unnest([499-h,700,700-h,700-h,700-h]) AS y0, unnest([50+w,100+w,100+w,100,100+w]) AS x1, unnest([499-h,700,700-h,700,700]) AS y1 FROM ({_NUMBERS}part) n) r
WHERE greatest(x1-x0,y1-y0)>=4"""


def pdf_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of one path's segments on pages of all rotations; every third line is short."""
    content = "concat('100 100 m 300 100 l 100 ', 101+h, ' m 300 ', 101+h, ' l 100 ', 300, ' m 300 300 l 100 100 m 100 300 l ', 110+w%90, ' 100 m ', 110+w%90, ' ', CASE WHEN lw%3=0 THEN 150 ELSE 300 END, ' l S')"
    r = pdf.scan(documents_of(spark, sf_dir, content), "path")
    return r.select("doc_id", "seg_rows", "seg_cols")


PDF_GRIDS_SQL = f"SELECT doc_id, CASE WHEN rot IN (90,270) THEN c ELSE r END AS seg_rows, CASE WHEN rot IN (90,270) THEN r ELSE c END AS seg_cols FROM (SELECT *, 3 AS r, CASE WHEN lw%3=0 THEN 1 ELSE 2 END AS c FROM ({_NUMBERS}part) n) a"


def pdf_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three strips under each other, the last one apart on some pages."""
    one = "' q {w} 0 0 10 20 {y} cm /A Do Q'".replace("{w}", "', w, '")
    content = "concat(" + ", ".join(one.replace("{y}", y) for y in ("400", "390")) + ", ' q ', w, ' 0 0 10 20 ', CASE WHEN lw%2=0 THEN 380 ELSE 370 END, ' cm /A Do Q')"
    r = _regions(spark, sf_dir, content).images
    return r.select("doc_id", "image_idx", "parts", "px_w", "px_h", *(F.round(F.col(c) * 10).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")), F.size("pieces").alias("n_pieces"))


PDF_STRIPS_SQL = f"""SELECT doc_id, k AS image_idx, p AS parts, 8 AS px_w, 4*p AS px_h, 200 AS x0, 10*a AS y0, 10*(20+w) AS x1, 10*b AS y1, p AS n_pieces FROM (SELECT *, unnest(CASE WHEN lw%2=0 THEN [0] ELSE [0,1] END) AS k, unnest(CASE WHEN lw%2=0 THEN [3] ELSE [2,1] END) AS p,
 unnest(CASE WHEN lw%2=0 THEN [390] ELSE [390,420] END) AS a, unnest(CASE WHEN lw%2=0 THEN [420] ELSE [410,430] END) AS b FROM ({_NUMBERS}part) n) r"""


def pdf_vector_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 from bytes: by lw a rule, a frame, a filled box, a lattice, letters, or crossing curves."""
    content = """CASE lw-1 WHEN 0 THEN concat('100 100 m ', 150+w, ' 100 l S') WHEN 1 THEN concat('100 100 ', 20+w, ' ', 20+h, ' re S') WHEN 2 THEN concat('100 100 ', 20+w, ' ', 20+h, ' re f')
 WHEN 3 THEN '100 100 m 400 100 l S 100 200 m 400 200 l S 100 300 m 400 300 l S 100 400 m 400 400 l S 100 100 m 100 400 l S 200 100 m 200 400 l S 300 100 m 300 400 l S 400 100 m 400 400 l S'
 WHEN 4 THEN '100 100 m 105 103 105 107 100 110 c f 106.1 100 m 111 103 111 107 106.1 110 c f 112 100 m 117 103 117 107 112 110 c f 117 100 m 122 103 122 107 117 110 c f'
 ELSE '100 100 m 200 150 250 250 300 300 c S 100 300 m 200 250 250 150 300 100 c S 90 200 m 310 210 l S' END"""
    k = _regions(spark, sf_dir, content).vector_kinds
    return k.groupBy("doc_id").agg(F.min("kind").alias("kind"), F.max("kind").alias("other"), F.sum("n").alias("n"))


PDF_VECTOR_KINDS_SQL = f"SELECT doc_id, k AS kind, k AS other, CASE lw-1 WHEN 3 THEN 8 WHEN 4 THEN 4 WHEN 5 THEN 3 ELSE 1 END AS n FROM (SELECT *, CASE lw-1 WHEN 0 THEN 'rule' WHEN 1 THEN 'border' WHEN 2 THEN 'fill' WHEN 3 THEN 'table_grid' WHEN 4 THEN 'outlined_text' ELSE 'chart_or_diagram' END AS k FROM ({_NUMBERS}part) n) a"


def pdf_inline_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline grey, RGB and one-bit images with their pixels, some turned round by /Decode."""
    px = "concat(lpad(hex(w%256), 2, '0'), lpad(hex(h%256), 2, '0'), '00')"
    content = f"""concat('q 90 0 0 30 10 10 cm BI /F /AHx /H 1 ', CASE lw%3 WHEN 0 THEN concat('/W 3 /BPC 8 /CS /G ID ', {px}) WHEN 1 THEN concat('/W 1 /BPC 8 /CS /RGB ID ', {px}) ELSE concat('/W 8 /IM true ', CASE WHEN w%2=0 THEN '/D [1 0] ' ELSE '' END, 'ID ', lpad(hex(w%256), 2, '0')) END, '> EI Q')"""
    t = pixels.thumbs(documents_of(spark, sf_dir, content, rotated=False))
    return t.select("doc_id", "obj", "w", "h", F.lower(F.hex("grey")).alias("grey"), "error")


_HEX = "lpad(to_hex({}), 2, '0')"
PDF_PIXELS_SQL = f"""SELECT doc_id, -1 AS obj, CASE lw%3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 8 END AS w, 1 AS h, lower(CASE lw%3 WHEN 0 THEN concat({_HEX.format("v")}, {_HEX.format("u")}, '00') WHEN 1 THEN {_HEX.format("(299*v+587*u+500)//1000")}
 ELSE array_to_string(list_transform(range(8), lambda k: CASE WHEN ((v>>(7-CAST(k AS INT)))&1)=(CASE WHEN w%2=0 THEN 0 ELSE 1 END) THEN 'ff' ELSE '00' END), '') END) AS grey, CAST(NULL AS VARCHAR) AS error FROM (SELECT *, CAST(w%256 AS INT) AS v, CAST(h%256 AS INT) AS u FROM ({_NUMBERS}part) n) a"""


def pdf_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widgets whose field type stands on a parent, drawn by their appearance where they have one."""
    extra = "concat('/Annots [<< /Subtype /Widget /Rect [10 10 ', 20+w, ' ', 20+h, '] /Parent << /Parent << /FT /', CASE WHEN lw%2=0 THEN 'Tx' ELSE 'Btn' END, ' >> >> ', CASE WHEN lw%3=0 THEN '/AP << /N 5 0 R >>' ELSE '' END, ' >>]')"
    r = _scan(spark, sf_dir, "'1 0 0 1 0 0 cm'", extra, "annot")
    return r.select("doc_id", F.col("text").alias("subtype"), F.col("detail").alias("field"), "appearance", *(F.round(F.col(c) * 10).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")))


PDF_FIELDS_SQL = f"SELECT doc_id, 'Widget' AS subtype, CASE WHEN lw%2=0 THEN 'Tx' ELSE 'Btn' END AS field, false AS appearance, 100 AS x0, 10*(780-h) AS y0, 10*(20+w) AS x1, 7900 AS y1 FROM ({_NUMBERS}part) n"


def pdf_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image and vector kinds of a page side by side; a drawn image of 8 x 4 equal pixels that can't be decoded has none."""
    data = documents_of(spark, sf_dir, "concat('q ', 50+w, ' 0 0 40 10 10 cm BI /W 4 /H 2 /BPC 8 /CS /G /F /AHx ID ', CASE WHEN lw%2=0 THEN '0000000000000000' ELSE '00ff00ff00ff00ff' END, '> EI Q 100 300 ', 20+w, ' ', 20+h, ' re S')", rotated=False)
    k = images.image_kinds(images.with_features(pixels.thumbs(data, pixels.KIND_THUMB).where("error IS NULL"), "doc_id")).select("doc_id", F.col("kind").alias("image_kind"))
    v = Regions(pdf.paged(data)).vector_kinds.select(F.col("doc_id").alias("d"), F.col("kind").alias("vector_kind"))
    return k.join(v, F.col("doc_id") == F.col("d"), "full_outer").select(F.coalesce("doc_id", "d").alias("doc_id"), "image_kind", "vector_kind")


PDF_KINDS_SQL = f"SELECT doc_id, CASE WHEN lw%2=0 THEN 'blank' ELSE 'graphic' END AS image_kind, 'border' AS vector_kind FROM ({_NUMBERS}part) n"

ALL |= {
    "pdf_points": (pdf_points, PDF_POINTS_SQL), "pdf_rules": (pdf_rules, PDF_RULES_SQL), "pdf_grids": (pdf_grids, PDF_GRIDS_SQL), "pdf_strips": (pdf_strips, PDF_STRIPS_SQL), "pdf_vector_kinds": (pdf_vector_kinds, PDF_VECTOR_KINDS_SQL),
    "pdf_inline_pixels": (pdf_inline_pixels, PDF_PIXELS_SQL), "pdf_fields": (pdf_fields, PDF_FIELDS_SQL), "pdf_kinds": (pdf_kinds, PDF_KINDS_SQL),
}
