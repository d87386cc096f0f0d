"""Page primitives derived from the test tables, as SQL of either engine; lengths are tenths of a point.

A page is 6,000 x 8,000 tenths. `primitives` gives a view the columns that the page operators take. `of(name, engine)` is a subquery over the base tables; base tables appear as {table}
for Spark (DataFrames by name) and by their names for DuckDB.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

BASE = ("lineitem", "part", "customer", "documents", "embeddings", "labels", "events", "pages", "orders", "supplier", "nation", "region", "benchmark", "conversations")

_PATHS = """SELECT page_n, ord, x0, y0, x0+w AS x1, y0+h AS y1, k%4<>1 AS fill, k%4=1 AS stroke, k%9=4 AS white, k%31=7 AS is_empty, k%3<>2 AS is_rect,
 CASE WHEN k%3<>2 THEN 4 ELSE 6 END AS n_lines, CASE WHEN k%3=2 THEN k%5 ELSE 0 END AS n_curves FROM (
 SELECT CAST(floor(l_orderkey/16.0) AS BIGINT) AS page_n,
  row_number() OVER (PARTITION BY CAST(floor(l_orderkey/16.0) AS BIGINT) ORDER BY l_orderkey,l_linenumber,l_partkey,l_suppkey,l_quantity)-1 AS ord,
  (l_partkey*37+l_linenumber*911)%5400 AS x0, (l_suppkey*53+l_partkey*29+l_linenumber*307)%7400 AS y0,
  5+CAST(l_quantity AS BIGINT)*12 AS w, CASE WHEN l_linenumber%3=0 THEN 5 ELSE 20+l_linenumber*30 END AS h,
  l_partkey+l_suppkey*3+l_linenumber AS k FROM <lineitem>) t"""

_GLYPHS = """SELECT doc_id AS page_n, i-1 AS ord, c, c IN (' ',chr(10),chr(9),chr(13)) AND NOT(doc_id%13=5 AND i%3<>0) AS is_space,
 360+((i-1)%80)*62+CASE WHEN (doc_id*7+i*13)%17=0 THEN 18 ELSE 0 END AS ux,
 360+CAST(floor((i-1)/80.0) AS BIGINT)*140+CASE WHEN (doc_id+i)%29=0 THEN 60 ELSE 0 END AS uy, 60 AS adv, 100 AS size,
 doc_id%10=3 AS invisible, (i%50<3 AND doc_id%7=0) AS white, NOT(doc_id%13=5 AND i%3<>0) AS mapped, doc_id%3 AS font FROM """
_GLYPHS_SPARK = _GLYPHS + "(SELECT doc_id, p+1 AS i, c FROM (SELECT /*+ REPARTITION(64, doc_id) */ doc_id, text FROM <documents> WHERE length(text) > 0) d LATERAL VIEW posexplode(split(text,'')) e AS p, c) t"
_GLYPHS_DUCK = _GLYPHS + "(SELECT doc_id, i, substr(text,i,1) AS c FROM (SELECT doc_id,text,unnest(range(1,length(text)+1)) AS i FROM <documents>) d) t"



def glyph_arrays(page_n: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """The view of glyphs, as arrays over some pages: their numbers, characters and how many each has."""
    page = np.repeat(np.arange(len(page_n)), sizes)
    doc, i = page_n[page], np.arange(1, len(page) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    mapped = ~((np.fmod(doc, 13) == 5) & (i % 3 != 0))
    ux = 360 + (i - 1) % 80 * 62 + np.where(np.fmod(doc * 7 + i * 13, 17) == 0, 18, 0)
    uy = 360 + (i - 1) // 80 * 140 + np.where(np.fmod(doc + i, 29) == 0, 60, 0)
    space = np.isin(codes, (32, 10, 9, 13)) & mapped
    same = {"size": np.int64(100), "dx": np.float64(1), "dy": np.float64(0), "annot": np.bool_(False)}
    return same | {
        "page": page, "ord": i - 1, "codes": codes, "is_space": space, "mapped": mapped, "invisible": np.fmod(doc, 10) == 3, "white": (i % 50 < 3) & (np.fmod(doc, 7) == 0),
        "ux": ux, "uy": uy, "ex": ux + 60, "ey": uy, "x0": ux, "y0": uy - 80, "x1": ux + 60, "y1": uy + 20,
    }


def pages_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_n, text): pages of the view of glyphs, dealt to all cores whatever the files."""
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return table(spark, sf_dir, "documents").selectExpr("CAST(doc_id AS BIGINT) AS page_n", "text").where("length(text) > 0").repartition(n, "page_n")


_IMAGES = """SELECT p_partkey AS page_n, 0 AS image_idx, 300+(p_size*97)%2000 AS x0, 300+(p_partkey*61)%3000 AS y0, 300+(p_size*97)%2000+10+(p_partkey*89)%3500 AS x1, 300+(p_partkey*61)%3000+10+(p_size*131)%3000 AS y1,
 2+(p_partkey*17)%900 AS px_w, 2+(p_size*23)%900 AS px_h, p_size%5=0 AS mask, p_partkey%23=0 AS offpage FROM <part>"""
_STRIPS = """SELECT page_n, image_idx, x0, y0+image_idx*h+CASE WHEN (page_n+image_idx)%7=0 THEN 15 ELSE 0 END AS y0, x0+w AS x1, y0+(image_idx+1)*h+CASE WHEN (page_n+image_idx)%7=0 THEN 15 ELSE 0 END AS y1, 100 AS px_w, 10 AS px_h, mask
 FROM (SELECT p_partkey AS page_n, CAST(l AS BIGINT) AS image_idx, 100+(p_partkey*41)%3000 AS x0, 200+(p_size*13)%900 AS y0, 200+p_size*20 AS w, 40+p_size AS h, (p_partkey+l)%11=0 AS mask
 FROM <part> CROSS JOIN (SELECT 0 AS l UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) s) t"""
_ANNOTS = """SELECT c_custkey AS page_n, c_custkey%7 AS subtype_id, 100+(c_custkey*43)%5000 AS x0, 100+(c_custkey*71)%7000 AS y0, c_nationkey%4=0 AS hidden, c_nationkey%3=0 AS appearance FROM <customer>"""
_BITMAPS = """SELECT vec_id AS bmp_id, CAST(floor(p/8.0) AS INT) AS y, CAST(p%8 AS INT) AS x, CAST(least(255,greatest(0,floor((CAST(e AS DOUBLE)+0.5)*255))) AS INT) AS grey FROM """
_BITMAPS_SPARK = _BITMAPS + "(SELECT vec_id, p, e FROM <embeddings> LATERAL VIEW posexplode(embedding) q AS p,e) t"
_BITMAPS_DUCK = _BITMAPS + "(SELECT vec_id, unnest(range(0,64)) AS p, unnest(embedding) AS e FROM <embeddings>) t"
_LETTERS = """SELECT CAST(floor(l_orderkey/16.0) AS BIGINT) AS page_n, row_number() OVER (PARTITION BY CAST(floor(l_orderkey/16.0) AS BIGINT) ORDER BY l_orderkey,l_linenumber,l_partkey,l_suppkey,l_quantity)-1 AS ord,
 (l_partkey*37+l_linenumber*911)%1200 AS x0, 100*((l_suppkey*53)%4)+l_linenumber*3 AS y0, (l_partkey*37+l_linenumber*911)%1200+20+CAST(l_quantity AS BIGINT)%40 AS x1, 100*((l_suppkey*53)%4)+l_linenumber*3+40+CAST(l_quantity AS BIGINT)%30 AS y1 FROM <lineitem>"""
_PREDICTED = """SELECT l.doc_id, d.source, l.quality AS truth, CASE WHEN d.n_chars%5=0 THEN 1-l.quality ELSE l.quality END AS predicted, (d.n_chars%100)/100.0 AS confidence FROM <labels> l JOIN <documents> d ON l.doc_id=d.doc_id"""

VIEWS = {
    "paths": (_PATHS, _PATHS), "glyphs": (_GLYPHS_SPARK, _GLYPHS_DUCK), "images": (_IMAGES, _IMAGES), "strips": (_STRIPS, _STRIPS), "annots": (_ANNOTS, _ANNOTS),
    "bitmaps": (_BITMAPS_SPARK, _BITMAPS_DUCK), "letters": (_LETTERS, _LETTERS), "predicted": (_PREDICTED, _PREDICTED),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or base table as a DataFrame."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    text = VIEWS[name][0]
    used = [b for b in BASE if f"<{b}>" in text]
    for b in used:
        text = text.replace(f"<{b}>", f"{{{b}}}")
    return spark.sql(text, **{b: table(spark, sf_dir, b) for b in used})


def duck(name: str) -> str:
    """A view as a DuckDB subquery; a base table by its name."""
    if name not in VIEWS:
        return name
    text = VIEWS[name][1]
    for b in BASE:
        text = text.replace(f"<{b}>", b)
    return f"({text})"


_SHAPES = {
    "glyphs": "c AS text, ux AS x0, uy-80 AS y0, ux+adv AS x1, uy+20 AS y1, ux+adv AS ex, uy AS ey, 1.0D AS dx, 0.0D AS dy, false AS annot, false AS offpage, false AS hidden",
    "images": "10000000+image_idx AS ord, false AS inline, false AS annot, false AS hidden, false AS clipped, true AS upright, 1 AS parts",
    "paths": "20000000+ord AS map_ord, ord AS cluster, is_empty AS empty, is_rect AS rect, is_rect AS closed, 0 AS seg_rows, 0 AS seg_cols, false AS shading, false AS annot, false AS offpage, false AS hidden, false AS clipped",
    "annots": "30000000+subtype_id AS ord, subtype_id AS annot_idx, x0+900 AS x1, y0+140 AS y1, false AS offpage",
}
WIDTH, HEIGHT, UNIT = 6000, 8000, 10


def primitives(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view keyed by (doc_id, page_n) with the columns of the page operators; the document is always 0."""
    more = f", {_SHAPES[name]}" if name in _SHAPES else ""
    return frame(spark, sf_dir, name).selectExpr("CAST(0 AS BIGINT) AS doc_id", "*", *(x.strip() for x in more.split(",") if x.strip()))
