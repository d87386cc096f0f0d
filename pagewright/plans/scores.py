"""Queries of the scorers and of small column rules over the fixture views, with SQL written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import geometry
from pagewright.operators import images, layout, scoring, vectors
from pagewright.sources import fixtures
from pagewright.sources.fixtures import UNIT, primitives, table

_IMAGES, _PATHS, _ANNOTS, _PREDICTED, _LETTERS = (fixtures.duck(x) for x in ("images", "paths", "annots", "predicted", "letters"))
_KEY = ["page_n"]


def _moved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(marks, regions): each image as a mark; as a region moved by 0 to 4, and again by 20."""
    i = fixtures.frame(spark, sf_dir, "images").select("page_n", "x0", "y0", "x1", "y1")
    marks = i.select("page_n", F.lit(0).alias("mark"), F.lit("image").alias("what"), "x0", "y0", "x1", "y1")
    by = lambda d, n: i.select("page_n", F.lit(n).alias("region"), F.lit("image").alias("what"), (F.col("x0") + d).alias("x0"), "y0", (F.col("x1") + d).alias("x1"), "y1")
    return marks, by(F.col("page_n") % 5, 1).union(by(F.lit(20), 0))


def mark_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mark with the nearest region within three tenths."""
    marks, regions = _moved(spark, sf_dir)
    return scoring.one_to_one(marks, regions, _KEY, 3.0).select("page_n", "mark", "region", F.col("error").cast("long").alias("error"))


MARK_PAIRS_SQL = f"SELECT page_n, 0 AS mark, 1 AS region, page_n%5 AS error FROM {_IMAGES} i WHERE page_n%5<=3"


def mark_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst and median edge error by class of page."""
    marks, regions = _moved(spark, sf_dir)
    pairs = scoring.one_to_one(marks, regions, _KEY, 10.0).withColumn("flags", F.col("page_n") % 2)
    e = scoring.edge_errors(pairs, ["flags"])
    return e.select("flags", "n", F.col("median").cast("long").alias("median"), F.col("worst").cast("long").alias("worst"))


MARK_ERRORS_SQL = f"SELECT page_n%2 AS flags, count(*) AS n, list_sort(list(page_n%5))[count(*)//2+1] AS median, max(page_n%5) AS worst FROM {_IMAGES} i GROUP BY 1"


def paths_in_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that lie in an image of their page, give or take 3 points."""
    pairs = scoring.contained(primitives(spark, sf_dir, "paths"), fixtures.frame(spark, sf_dir, "images").select("page_n", "image_idx", "x0", "y0", "x1", "y1"), _KEY, 30)
    return pairs.select("page_n", "ord", F.col("o_image_idx").alias("image_idx"))


PATHS_IN_IMAGES_SQL = f"SELECT p.page_n, p.ord, i.image_idx FROM {_PATHS} p JOIN {_IMAGES} i ON p.page_n=i.page_n AND p.x0-i.x0>=-30 AND p.y0-i.y0>=-30 AND i.x1-p.x1>=-30 AND i.y1-p.y1>=-30"


def images_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images over which an annotation lies."""
    a = primitives(spark, sf_dir, "annots").select("page_n", "x0", "y0", "x1", "y1")
    return scoring.touched(fixtures.frame(spark, sf_dir, "images"), a, _KEY).select("page_n", "image_idx")


IMAGES_TOUCHED_SQL = f"SELECT page_n, image_idx FROM {_IMAGES} i WHERE EXISTS (SELECT 1 FROM {_ANNOTS} a WHERE a.page_n=i.page_n AND greatest(a.x0,i.x0)<least(a.x0+900,i.x1) AND greatest(a.y0,i.y0)<least(a.y0+140,i.y1))"


def frozen_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of parts' names, before and after a change of some."""
    p = table(spark, sf_dir, "part")
    side = lambda keep, text: p.where(keep).select(F.col("p_partkey").cast("string").alias("name"), F.sha2(F.expr(text), 256).alias("digest"))
    return scoring.frozen_diff(side("p_partkey % 7 <> 0", "p_name"), side("p_partkey % 5 <> 0", "CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE p_name END"))


FROZEN_CHECK_SQL = "SELECT CAST(p_partkey AS VARCHAR) AS name, CASE WHEN p_partkey%5=0 THEN 'MISSING' WHEN p_partkey%7=0 THEN 'NEW' ELSE 'CHANGED' END AS state FROM part WHERE (p_partkey%7=0)<>(p_partkey%5=0) OR (p_partkey%7<>0 AND p_partkey%5<>0 AND p_size%3=0 AND upper(p_name)<>p_name)"


def majority_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common part type of each supplier's lines, the one seen first of equals."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.min("l_returnflag").alias("kind"), F.max("l_quantity").alias("confidence"))
    return scoring.majority(li, ["l_suppkey"], "kind", "l_orderkey", "confidence")


MAJORITY_SQL = """SELECT l_suppkey, kind, confidence FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, first) AS r FROM (
 SELECT l_suppkey, kind, count(*) AS n, min(l_orderkey) AS first, max(confidence) AS confidence FROM (SELECT l_suppkey, l_orderkey, min(l_returnflag) AS kind, max(l_quantity) AS confidence FROM lineitem GROUP BY 1, 2) a GROUP BY 1, 2) b) c WHERE r=1"""


def largest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest path of each page, the first of equals."""
    return scoring.largest(fixtures.frame(spark, sf_dir, "paths").select("page_n", "ord", "x0", "y0", "x1", "y1"), _KEY, "ord")


LARGEST_SQL = f"SELECT page_n, ord, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY page_n ORDER BY (x1-x0)*(y1-y0) DESC, ord) AS r FROM {_PATHS} p) a WHERE r=1"


def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's best image score beside its label; 0 without an image."""
    i = fixtures.frame(spark, sf_dir, "images").select(F.col("page_n").alias("doc_id"), F.col("px_w").cast("double").alias("score"))
    return scoring.page_max(i, table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"], "score")


PAGE_SCORES_SQL = f"SELECT l.doc_id, l.quality, coalesce(max(i.px_w), 0)*1.0e0 AS score FROM (SELECT *, row_number() OVER () AS k FROM labels) l LEFT JOIN {_IMAGES} i ON i.page_n=l.doc_id GROUP BY l.k, l.doc_id, l.quality"


def merged_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merged image is text if a strip is text or unsure."""
    s = fixtures.frame(spark, sf_dir, "strips").select("page_n", F.expr("CASE WHEN (page_n*7+image_idx) % 9 = 0 THEN 'unsure' WHEN (page_n+image_idx*5) % 13 = 0 THEN 'text' ELSE 'none' END").alias("label"))
    return scoring.merged_truth(s, _KEY)


MERGED_TRUTH_SQL = f"SELECT page_n, CASE WHEN count(CASE WHEN (page_n*7+image_idx)%9=0 OR (page_n+image_idx*5)%13=0 THEN 1 END)>0 THEN 'text' ELSE 'none' END AS label FROM {fixtures.duck('strips')} s GROUP BY page_n"


def missed_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missed ink by the first kind of region near it."""
    m = table(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey % 50 AS BIGINT) AS n", "o_custkey % 3 = 0 AS near_text", "o_custkey % 4 = 0 AS near_image", "o_custkey % 5 = 0 AS near_vector", "o_custkey % 7 = 0 AS near_annot")
    return scoring.missed_by_kind(m)


MISSED_SQL = "SELECT CASE WHEN o_custkey%3=0 THEN 'text' WHEN o_custkey%4=0 THEN 'image' WHEN o_custkey%5=0 THEN 'vector' WHEN o_custkey%7=0 THEN 'annot' ELSE 'other' END AS kind, sum(CAST(o_orderkey%50 AS BIGINT)) AS n FROM orders GROUP BY 1"


def phantom_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and annotations without a path in them, by kind."""
    box = ["page_n", "x0", "y0", "x1", "y1"]
    regions = primitives(spark, sf_dir, "images").select(*box, F.lit("image").alias("what")).union(primitives(spark, sf_dir, "annots").select(*box, F.lit("annot")))
    return scoring.phantoms(regions, primitives(spark, sf_dir, "paths").select(*box), _KEY)


PHANTOM_SQL = f"SELECT what, count(*) AS n FROM (SELECT page_n, x0, y0, x1, y1, 'image' AS what FROM {_IMAGES} i UNION ALL SELECT page_n, x0, y0, x0+900, y0+140, 'annot' FROM {_ANNOTS} a) r WHERE NOT EXISTS (SELECT 1 FROM {_PATHS} p WHERE p.page_n=r.page_n AND p.x0<r.x1 AND p.x1>r.x0 AND p.y0<r.y1 AND p.y1>r.y0) GROUP BY what"


def flags_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations whose expected flags aren't all found."""
    a = fixtures.frame(spark, sf_dir, "annots")
    some = lambda **kw: F.array_compact(F.array(*(F.when(F.expr(c), F.lit(k)) for k, c in kw.items())))
    pairs = a.select("page_n", some(hidden="page_n % 3 = 0", no_appearance="page_n % 4 = 0").alias("expected"), some(hidden="hidden", no_appearance="NOT appearance").alias("flags"))
    return scoring.flags_missing(pairs).select("page_n")


FLAGS_MISSING_SQL = f"SELECT page_n FROM {_ANNOTS} a WHERE (page_n%3=0 AND NOT hidden) OR (page_n%4=0 AND appearance)"


def cut_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents flagged at each cut."""
    r = fixtures.frame(spark, sf_dir, "predicted").select(F.col("confidence").cast("double").alias("confidence"), (F.col("truth") == 1).alias("expected"))
    s = scoring.cut_sweep(r, [0.2, 0.4, 0.6, 0.8])
    return s.select(F.round(F.col("cut") * 10).cast("long").alias("cut_e1"), "flagged", "hits", "misses")


CUT_SWEEP_SQL = f"SELECT c AS cut_e1, count(CASE WHEN confidence*10>=c THEN 1 END) AS flagged, count(CASE WHEN confidence*10>=c AND truth=1 THEN 1 END) AS hits, count(CASE WHEN confidence*10<c AND truth=1 THEN 1 END) AS misses FROM {_PREDICTED} p CROSS JOIN (SELECT unnest([2,4,6,8]) AS c) k GROUP BY c"


def counting_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 over words of part names and sizes."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat(substr(p_name, 1, 1 + p_size % 5), CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS STRING) ELSE '' END) AS word", "CAST(p_partkey % 100 AS DOUBLE) AS conf")
    return p.select("p_partkey", scoring.counting_word(F.col("word"), F.col("conf")).alias("counts"))


COUNTING_SQL = """SELECT p_partkey, conf>=60 AND (length(regexp_replace(word,'[^A-Za-z]','','g'))>=3 OR length(regexp_replace(word,'[^0-9]','','g'))>=2) AS counts FROM (
 SELECT p_partkey, concat(substr(p_name,1,CAST(1+p_size%5 AS BIGINT)), CASE WHEN p_size%2=0 THEN CAST(p_size AS VARCHAR) ELSE '' END) AS word, p_partkey%100 AS conf FROM part) a"""


def objects_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object of a file where it is drawn first."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey", "l_orderkey").agg(F.min("l_linenumber").alias("line"))
    return scoring.first_of_each(li, ["l_suppkey", "l_partkey"], ["l_orderkey", "line"])


OBJECTS_ONCE_SQL = "SELECT l_suppkey, l_partkey, min(l_orderkey) AS l_orderkey, arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS line FROM lineitem GROUP BY 1, 2"


def placed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images within a tenth of where they should be, exactly one."""
    marks, regions = _moved(spark, sf_dir)
    return scoring.placed_once(regions, marks.select("page_n", "x0", "y0", "x1", "y1"), _KEY, 1.0)


PLACED_ONCE_SQL = f'SELECT page_n, CASE WHEN page_n%5<=1 THEN 1 ELSE 0 END AS n, page_n%5<=1 AS "right" FROM {_IMAGES} i'


def has_text_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15 for has_text."""
    p = fixtures.frame(spark, sf_dir, "predicted").select(F.col("truth"), F.col("confidence").cast("double").alias("has_text"))
    return scoring.has_text_calibration(p)


HAS_TEXT_SQL = f"""SELECT CASE WHEN greatest(c,100-c)>=90 THEN '0.9' WHEN greatest(c,100-c)>=70 THEN '0.7' ELSE '0.5' END AS band, count(*) AS n, count(CASE WHEN (c>=50)=(truth=1) THEN 1 END) AS n_right
FROM (SELECT truth, CAST(round(confidence*100) AS BIGINT) AS c FROM {_PREDICTED} p) a GROUP BY 1"""


def path_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thin, rectangular and letter-like paths."""
    th, tv = vectors.thin(UNIT)
    p = primitives(spark, sf_dir, "paths")
    return p.select("page_n", "ord", th.alias("thin_h"), tv.alias("thin_v"), vectors.rectish().alias("rectish"), vectors.glyph_like(UNIT).alias("glyph_like"))


PATH_SHAPES_SQL = f"""SELECT page_n, ord, h<=40 AND w>=4*h AND w>=10 AS thin_h, w<=40 AND h>=4*w AND h>=10 AS thin_v, is_rect AS rectish, NOT is_empty AND fill AND NOT stroke AND NOT is_rect AND h>=20 AND h<=800 AND w<=3*h AND (n_curves>0 OR n_lines>=3) AS glyph_like
FROM (SELECT *, x1-x0 AS w, y1-y0 AS h FROM {_PATHS} p) a"""


def pixel_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances, thumbnail sizes, greys, packed samples and turns from the numbers of parts."""
    c = F.col
    p = table(spark, sf_dir, "part").select("p_partkey", c("p_size").cast("int").alias("s"), (c("p_partkey") % 256).cast("int").alias("v"))
    turn = images.turn_of(*(c(k) - 25 for k in ("s", "s2", "s3", "s4")))
    p = p.withColumn("s2", c("s") * 7 % 50).withColumn("s3", c("s") * 11 % 50).withColumn("s4", c("s") * 13 % 50)
    return p.select(
        "p_partkey", F.floor(1000 * geometry.dist(c("s"), F.lit(0), F.lit(0), c("v")) + 0.5).alias("dist_e3"), images.long_side(c("v") + 1, c("s"), 256).alias("long_side"), images.rgb_grey(c("v"), c("s"), 255 - c("v")).alias("rgb"),
        images.cmyk_grey(c("v"), c("s"), F.lit(0), c("s2")).alias("cmyk"), images.unpacked(c("v"), F.lit(1), 2).alias("two_bits"), images.unpacked(c("v"), F.lit(0), 4).alias("four_bits"), turn["transpose"].alias("transpose"), turn["flip_x"].alias("flip_x"), turn["flip_y"].alias("flip_y"),
    )


PIXEL_RULES_SQL = """SELECT p_partkey, CAST(floor(1000*sqrt(s*s+v*v)+0.5) AS BIGINT) AS dist_e3, CAST(floor(256*least(8, greatest(1, greatest(v+1,s)/2.0/least(v+1,s)))+0.5) AS BIGINT) AS long_side, (299*v+587*s+114*(255-v)+500)//1000 AS rgb,
 (299*(255-least(255,v+s2))+587*(255-least(255,s+s2))+114*(255-least(255,s2))+500)//1000 AS cmyk, 85*(v//16%4) AS two_bits, 17*(v//16) AS four_bits, abs(s2-25)>abs(s-25) AS transpose,
 CASE WHEN abs(s2-25)>abs(s-25) THEN s3<25 ELSE s<25 END AS flip_x, CASE WHEN abs(s2-25)>abs(s-25) THEN s2<25 ELSE s4<25 END AS flip_y
FROM (SELECT p_partkey, CAST(p_size AS INT) AS s, CAST(p_partkey%256 AS INT) AS v, CAST(p_size AS INT)*7%50 AS s2, CAST(p_size AS INT)*11%50 AS s3, CAST(p_size AS INT)*13%50 AS s4 FROM part) a"""


def undecodable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a character that says nothing."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.substring("text", 1, 50), F.expr("CASE doc_id % 4 WHEN 0 THEN char(1) WHEN 1 THEN decode(unhex('EFBFBD'), 'UTF-8') WHEN 2 THEN char(9) ELSE '' END")).alias("t"))
    return d.select("doc_id", F.coalesce(F.col("t").rlike(layout.UNDECODABLE), F.lit(False)).alias("bad"))


UNDECODABLE_SQL = "SELECT doc_id, doc_id%4 IN (0,1) OR regexp_matches(coalesce(left(text,50),''), '[\\x{FFFD}\\x{E000}-\\x{F8FF}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]') AS bad FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, false FROM documents WHERE text IS NULL"

ALL = {
    "mark_pairs": (mark_pairs, MARK_PAIRS_SQL), "mark_errors": (mark_errors, MARK_ERRORS_SQL), "paths_in_images": (paths_in_images, PATHS_IN_IMAGES_SQL), "images_touched": (images_touched, IMAGES_TOUCHED_SQL),
    "frozen_check": (frozen_check, FROZEN_CHECK_SQL), "majority_kinds": (majority_kinds, MAJORITY_SQL), "largest_paths": (largest_paths, LARGEST_SQL), "page_scores": (page_scores, PAGE_SCORES_SQL), "merged_truth": (merged_truth, MERGED_TRUTH_SQL),
    "missed_ink": (missed_ink, MISSED_SQL), "phantom_regions": (phantom_regions, PHANTOM_SQL), "flags_missing": (flags_missing, FLAGS_MISSING_SQL), "cut_sweep": (cut_sweep, CUT_SWEEP_SQL), "counting_words": (counting_words, COUNTING_SQL),
    "objects_once": (objects_once, OBJECTS_ONCE_SQL), "placed_once": (placed_once, PLACED_ONCE_SQL), "has_text_bands": (has_text_bands, HAS_TEXT_SQL), "path_shapes": (path_shapes, PATH_SHAPES_SQL), "pixel_rules": (pixel_rules, PIXEL_RULES_SQL),
    "undecodable_text": (undecodable_text, UNDECODABLE_SQL),
}
