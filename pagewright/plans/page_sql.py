"""DuckDB SQL of the page queries, written apart from the DataFrame operators that it checks.

Texts are over the fixture views ({name}), in tenths of a point; a text may use another one. The fixtures' constants
(glyph boxes, annotation boxes, order offsets, one horizontal direction) stand here, not in the operators.
"""

from __future__ import annotations

import re

#: G1: glyphs to words. A space closes a word; else a word ends where flags, baseline or gap break.
WORDS = """
SELECT page_n, word, LISTAGG_ORD(CASE WHEN mapped THEN c ELSE '�' END) AS text, min(ux) AS x0, min(uy)-80 AS y0, max(ux+adv) AS x1, max(uy)+20 AS y1,
 min(ord) AS first_ord, count(*) AS n_glyphs, count(CASE WHEN NOT mapped THEN 1 END) AS n_unmapped, min(ux) AS start_x,
 max(CASE WHEN ord=f THEN uy END) AS first_y, max(CASE WHEN ord=l THEN ux+adv END) AS end_x, bool_and(invisible) AS invisible, bool_and(white) AS white
FROM (SELECT *, min(ord) OVER (PARTITION BY page_n, word) AS f, max(ord) OVER (PARTITION BY page_n, word) AS l FROM (
 SELECT *, sum(brk) OVER (PARTITION BY page_n ORDER BY ord ROWS UNBOUNDED PRECEDING) AS word FROM (
  SELECT *, CASE WHEN NOT is_space AND (coalesce(p_space, true) OR p_inv<>invisible OR p_white<>white OR abs(uy-p_y)*2>size OR (ux-p_end)*20>3*size OR (ux-p_end)*2<-size) THEN 1 ELSE 0 END AS brk FROM (
   SELECT *, lag(is_space) OVER w AS p_space, lag(invisible) OVER w AS p_inv, lag(white) OVER w AS p_white, lag(uy) OVER w AS p_y, lag(ux+adv) OVER w AS p_end
   FROM {glyphs} g WINDOW w AS (PARTITION BY page_n ORDER BY ord)) a) b) c WHERE NOT is_space) d
GROUP BY page_n, word"""

#: Words to word lines: a new line where the baseline shifts or the pen goes back.
WORD_LINES = """
SELECT page_n, word, sum(CASE WHEN p_y IS NULL OR abs(first_y-p_y)*2>100 OR (start_x-p_end)*2<-100 THEN 1 ELSE 0 END) OVER (PARTITION BY page_n ORDER BY first_ord ROWS UNBOUNDED PRECEDING) AS line
FROM (SELECT *, lag(first_y) OVER w AS p_y, lag(end_x) OVER w AS p_end FROM {words} q WINDOW w AS (PARTITION BY page_n ORDER BY first_ord)) a"""

#: Lines as regions: consecutive words of a word line with the same flags and a gap of 1.5 em at most.
TEXT_LINES = """
SELECT page_n, region, LISTAGG_WORD(text) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(first_ord) AS ord, count(*) AS n_words, sum(n_glyphs) AS n_glyphs, sum(n_unmapped) AS n_unmapped, bool_and(invisible) AS invisible, bool_and(white) AS white
FROM (SELECT *, sum(CASE WHEN coalesce(p_line<>line OR p_inv<>invisible OR p_white<>white OR greatest(x0-p_x1, p_x0-x1, y0-p_y1, p_y0-y1)>150, true) THEN 1 ELSE 0 END) OVER (PARTITION BY page_n ORDER BY first_ord ROWS UNBOUNDED PRECEDING) AS region
 FROM (SELECT *, lag(line) OVER w AS p_line, lag(invisible) OVER w AS p_inv, lag(white) OVER w AS p_white, lag(x0) OVER w AS p_x0, lag(x1) OVER w AS p_x1, lag(y0) OVER w AS p_y0, lag(y1) OVER w AS p_y1
  FROM (SELECT q.*, n.line FROM {words} q JOIN {word_lines} n ON q.page_n=n.page_n AND q.word=n.word) j WINDOW w AS (PARTITION BY page_n ORDER BY first_ord)) a) b
GROUP BY page_n, region"""

#: Can the text of a page be read?
PAGE_VERDICT = """
SELECT page_n, CASE WHEN count(*)=0 THEN 'none' WHEN 2*count(CASE WHEN invisible THEN 1 END)>=count(*) THEN 'invisible' WHEN count(CASE WHEN NOT is_space THEN 1 END)=0 THEN 'none'
 WHEN 2*count(CASE WHEN NOT is_space AND (NOT mapped OR unicode(c)=65533 OR unicode(c) BETWEEN 57344 AND 63743 OR unicode(c)>=983040 OR (unicode(c)<32 AND unicode(c) NOT IN (9,10,13)) OR unicode(c) BETWEEN 127 AND 159) THEN 1 END)>=count(CASE WHEN NOT is_space THEN 1 END) THEN 'garbled' ELSE 'text' END AS verdict, count(*) AS n_glyphs FROM {glyphs} g GROUP BY page_n"""

#: S10 and A11
PAGE_TEXT = """SELECT page_n, LISTAGG_ORD(CASE WHEN mapped THEN c ELSE '�' END) AS text, count(*) AS glyphs, count(CASE WHEN NOT mapped THEN 1 END) AS unmapped, count(CASE WHEN invisible THEN 1 END) AS invisible FROM {glyphs} g GROUP BY page_n"""
UNMAPPED_BY_FONT = """SELECT page_n, font, count(*) AS n, min(ord) AS first_seen FROM {glyphs} g WHERE NOT mapped GROUP BY page_n, font"""

#: Thin filled bars become their centre line; ends rounded to a tenth; repeats dropped in order.
RULES_PLACED = """
SELECT page_n, x0, y0, x1, y1, min(ord) AS ord FROM (
 SELECT page_n, ord, greatest(0,least(6000,x0)) AS x0, floor((y0+y1)/2.0) AS y0, greatest(0,least(6000,x1)) AS x1, floor((y0+y1)/2.0) AS y1 FROM {paths} p WHERE fill AND NOT stroke AND NOT white AND y1-y0<=25 AND x1-x0>=40 AND x1-x0>25
 UNION ALL SELECT page_n, ord, floor((x0+x1)/2.0), greatest(0,least(8000,y0)), floor((x0+x1)/2.0), greatest(0,least(8000,y1)) FROM {paths} p WHERE fill AND NOT stroke AND NOT white AND x1-x0<=25 AND y1-y0>=40
 UNION ALL SELECT page_n, ord, x0, y0, x1, y0 FROM {paths} p WHERE stroke AND NOT white AND is_rect AND x1-x0>=40
 UNION ALL SELECT page_n, ord, x0, y1, x1, y1 FROM {paths} p WHERE stroke AND NOT white AND is_rect AND x1-x0>=40
 UNION ALL SELECT page_n, ord, x0, y0, x0, y1 FROM {paths} p WHERE stroke AND NOT white AND is_rect AND y1-y0>=40
 UNION ALL SELECT page_n, ord, x1, y0, x1, y1 FROM {paths} p WHERE stroke AND NOT white AND is_rect AND y1-y0>=40) r
WHERE greatest(x1-x0, y1-y0)>=40 GROUP BY page_n, x0, y0, x1, y1"""

#: Every image against the words shown on its page. Covers are cut at 1; factors multiply 0.8.
OCR_FEATURES = """
SELECT i.page_n, i.image_idx, i.x0, i.y0, i.x1, i.y1, i.px_w, i.px_h, i.mask, i.offpage, coalesce(s.vis_area,0) AS vis_area, coalesce(s.inv_area,0) AS inv_area, coalesce(s.text_words,0) AS text_words, coalesce(s.layer_words,0) AS layer_words, coalesce(v.visible,0) AS visible
FROM {images} i LEFT JOIN (
 SELECT m.page_n, m.image_idx, sum(CASE WHEN NOT w.invisible THEN a ELSE 0 END) AS vis_area, sum(CASE WHEN w.invisible THEN a ELSE 0 END) AS inv_area,
  count(CASE WHEN NOT w.invisible AND inside THEN 1 END) AS text_words, count(CASE WHEN w.invisible AND inside THEN 1 END) AS layer_words
 FROM {images} m JOIN (SELECT page_n AS wp, x0 AS wx0, y0 AS wy0, x1 AS wx1, y1 AS wy1, invisible FROM {words} q) w ON m.page_n=w.wp AND w.wx0<=m.x1 AND w.wx1>=m.x0 AND w.wy0<=m.y1 AND w.wy1>=m.y0
  CROSS JOIN LATERAL (SELECT (least(m.x1,w.wx1)-greatest(m.x0,w.wx0))*(least(m.y1,w.wy1)-greatest(m.y0,w.wy0)) AS a, w.wx0+w.wx1 BETWEEN 2*m.x0 AND 2*m.x1 AND w.wy0+w.wy1 BETWEEN 2*m.y0 AND 2*m.y1 AS inside) l
 GROUP BY m.page_n, m.image_idx) s ON i.page_n=s.page_n AND i.image_idx=s.image_idx
LEFT JOIN (SELECT page_n, count(CASE WHEN NOT invisible THEN 1 END) AS visible FROM {words} q GROUP BY page_n) v ON i.page_n=v.page_n"""


def ramp(x: str, lo: float, hi: float) -> str:
    return f"greatest(0.0e0, least(1.0e0, (({x})-{lo}e0)/({hi}e0-{lo}e0)))"


def factor(s: str, floor: float) -> str:
    return f"({floor}e0+{1 - floor}e0*({s}))"


_AREA = "(CAST(x1-x0 AS DOUBLE)*(y1-y0))"
_FACTORS = {
    "narrow_px": factor(ramp("least(px_w,px_h)", 4, 12), 0.05),
    "narrow": factor(ramp("least(x1-x0,y1-y0)/10.0e0", 3, 9), 0.05),
    "long": factor(ramp("greatest(x1-x0,y1-y0)/CAST(least(x1-x0,y1-y0) AS DOUBLE)", 80, 40), 0.05),
    "tiny": factor(ramp(f"{_AREA}/100.0e0", 50, 250), 0.05),
    "low_dpi": factor(ramp("least(px_w*720.0e0/(x1-x0), px_h*720.0e0/(y1-y0))", 30, 70), 0.05),
    "text_layer": factor(f"1.0e0-greatest({ramp(f'least(1.0e0,inv_area/{_AREA})', 0.02, 0.10)},{ramp('layer_words', 1, 5)})", 0.05),
    "under_text": factor(f"1.0e0-greatest({ramp(f'least(1.0e0,vis_area/{_AREA})', 0.03, 0.10)},{ramp('text_words', 5, 20)}*{ramp('CASE WHEN visible>0 THEN text_words/CAST(visible AS DOUBLE) ELSE 0.0e0 END', 0.25, 0.5)})", 0.25),
}
OCR_REGIONS = (
    "SELECT page_n, image_idx, text_words, layer_words, least(x1-x0,y1-y0)<360 AS small, floor(1e6*(CASE WHEN offpage THEN 0.8e0*0.02e0 ELSE 0.8e0*"
    + "*".join(f"least(1.0e0,{f})" for f in _FACTORS.values())
    + " END)+0.5) AS confidence_e6 FROM {features} f"
)
OCR_REASONS = " UNION ALL ".join(
    [
        f"SELECT page_n, image_idx, {k} AS place, '{why}' AS why, floor(1e6*f+0.5) AS factor_e6 FROM (SELECT page_n, image_idx, {f} AS f FROM {{features}} q WHERE NOT offpage) a WHERE f<1.0e0"
        for k, (why, f) in enumerate(_FACTORS.items())
    ]
    + ["SELECT page_n, image_idx, 0 AS place, 'offpage' AS why, floor(1e6*0.02e0+0.5) AS factor_e6 FROM {features} q WHERE offpage"]
)

#: The map of a page: all entities by drawing order with their flags
PAGE_MAP = """
SELECT page_n, row_number() OVER (PARTITION BY page_n ORDER BY ord, kind, idx)-1 AS id, what, idx, x0, y0, x1, y1, flags FROM (
 SELECT page_n, 0 AS kind, 'text' AS what, region AS idx, ord, x0, y0, x1, y1, concat(CASE WHEN invisible THEN 'invisible ' ELSE '' END, CASE WHEN white THEN 'white ' ELSE '' END, CASE WHEN n_unmapped*2>=n_glyphs AND n_unmapped>0 THEN 'undecodable ' ELSE '' END) AS flags FROM {text_lines} t
 UNION ALL SELECT page_n, 1, 'image', image_idx, 10000000+image_idx, x0, y0, x1, y1, concat(CASE WHEN mask THEN 'mask ' ELSE '' END, CASE WHEN offpage THEN 'offpage ' ELSE '' END) FROM {images} i
 UNION ALL SELECT page_n, 2, 'vector', ord, 20000000+ord, x0, y0, x1, y1, concat(CASE WHEN fill THEN 'fill ' ELSE '' END, CASE WHEN stroke THEN 'stroke ' ELSE '' END, CASE WHEN white THEN 'white ' ELSE '' END, CASE WHEN is_empty THEN 'empty ' ELSE '' END) FROM {paths} p
 UNION ALL SELECT page_n, 3, 'annot', subtype_id, 30000000+subtype_id, x0, y0, x0+900, y0+140, concat(CASE WHEN hidden THEN 'hidden ' ELSE '' END, CASE WHEN NOT appearance THEN 'no_appearance ' ELSE '' END) FROM {annots} a) u"""
MAP_FLAG_COUNTS = "SELECT what, flags, count(*) AS n FROM {page_map} m GROUP BY what, flags"
UNSEEN_COUNTS = """SELECT page_n, what, count(*) AS n, count(CASE WHEN flags LIKE '%offpage%' OR flags LIKE '%hidden%' OR flags LIKE '%invisible%' OR flags LIKE '%white%' OR flags LIKE '%empty%' OR flags LIKE '%no_appearance%' THEN 1 END) AS unseen FROM {page_map} m GROUP BY page_n, what"""

#: The vertical extent of a cubic through its real extrema; control values from the path's numbers
CURVE_BBOX = """
SELECT page_n, ord, floor(1000*least(a,d,v1,v2)+0.5) AS lo_e3, floor(1000*greatest(a,d,v1,v2)+0.5) AS hi_e3 FROM (
 SELECT *, CASE WHEN t1>0 AND t1<1 THEN (1-t1)*(1-t1)*(1-t1)*a+3*(1-t1)*(1-t1)*t1*b+3*(1-t1)*t1*t1*c+t1*t1*t1*d ELSE a END AS v1, CASE WHEN t2>0 AND t2<1 THEN (1-t2)*(1-t2)*(1-t2)*a+3*(1-t2)*(1-t2)*t2*b+3*(1-t2)*t2*t2*c+t2*t2*t2*d ELSE a END AS v2 FROM (
  SELECT *, CASE WHEN abs(qa)<1e-9 THEN CASE WHEN abs(qb)<1e-9 THEN -1.0e0 ELSE -qc/(2*qb) END WHEN qb*qb-qa*qc<0 THEN -1.0e0 ELSE (-qb+sqrt(greatest(0.0e0,qb*qb-qa*qc)))/qa END AS t1,
   CASE WHEN abs(qa)<1e-9 OR qb*qb-qa*qc<0 THEN -1.0e0 ELSE (-qb-sqrt(greatest(0.0e0,qb*qb-qa*qc)))/qa END AS t2 FROM (
   SELECT page_n, ord, a, b, c, d, (d-3*c+3*b-a) AS qa, (c-2*b+a) AS qb, (b-a) AS qc FROM (SELECT page_n, ord, CAST(y0 AS DOUBLE) AS a, CAST((y0*7+x0*3)%8000 AS DOUBLE) AS b, CAST((y1*5+x1*11)%8000 AS DOUBLE) AS c, CAST(y1 AS DOUBLE) AS d FROM {paths} p WHERE n_curves>0) k) q) r) s"""

#: A4: histogram features of an image; A5: quartiles by index
IMAGE_HIST_FEATURES = """
SELECT bmp_id, sum(n) AS px, sum(grey*n) AS total, sum(CAST(grey AS BIGINT)*grey*n) AS squares, count(CASE WHEN n*1000>=64 THEN 1 END) AS levels, sum(CASE WHEN grey<64 OR grey>192 THEN n ELSE 0 END) AS extremes, sum(CASE WHEN grey<128 THEN n ELSE 0 END) AS dark
FROM (SELECT bmp_id, grey, count(*) AS n FROM {bitmaps} b GROUP BY bmp_id, grey) h GROUP BY bmp_id"""
IMAGE_QUARTILES = """
SELECT bmp_id, max(CASE WHEN rn=16 THEN grey END) AS q1, max(CASE WHEN rn=32 THEN grey END) AS q2, max(CASE WHEN rn=48 THEN grey END) AS q3 FROM (SELECT bmp_id, grey, row_number() OVER (PARTITION BY bmp_id ORDER BY grey) AS rn FROM {bitmaps} b) r GROUP BY bmp_id"""

#: K1: kind of an image from its features. On 8 x 8 pixels no eight letter-sized marks fit, so the text score and all evidence of words are 0.
IMAGE_KINDS = """
SELECT bmp_id, kind, CASE WHEN kind='blank' THEN 900 ELSE floor(1000*greatest(0.05e0, least(0.95e0, best*(0.5e0+0.5e0*(best-second))))+0.5) END AS confidence_e3, CASE WHEN kind='blank' THEN 0 ELSE 50 END AS has_text_e3 FROM (
 SELECT *, CASE WHEN spread<4 OR ink<0.0005e0 THEN 'blank' WHEN text_s>=photo_s AND text_s>=graphic_s THEN 'text' WHEN photo_s>=graphic_s THEN 'photo' ELSE 'graphic' END AS kind, greatest(text_s,photo_s,graphic_s) AS best,
  greatest(CASE WHEN text_s<greatest(text_s,photo_s,graphic_s) THEN text_s ELSE 0.0e0 END, CASE WHEN photo_s<greatest(text_s,photo_s,graphic_s) THEN photo_s ELSE 0.0e0 END, CASE WHEN graphic_s<greatest(text_s,photo_s,graphic_s) THEN graphic_s ELSE 0.0e0 END) AS second FROM (
  SELECT bmp_id, spread, ink, 0.0e0 AS text_s, RAMP(levels,32,96)*RAMP(ext,0.8,0.5) AS photo_s, greatest(RAMP(levels,96,24), RAMP(ext,0.5,0.8)) AS graphic_s FROM (
   SELECT bmp_id, levels*1.0e0 AS levels, extremes/CAST(px AS DOUBLE) AS ext, sqrt(greatest(0.0e0, squares/CAST(px AS DOUBLE)-(total/CAST(px AS DOUBLE))*(total/CAST(px AS DOUBLE)))) AS spread, least(dark,px-dark)/CAST(px AS DOUBLE) AS ink FROM {hist} h) f) s) k"""
IMAGE_KINDS = re.sub(r"RAMP\((\w+),([\d.]+),([\d.]+)\)", lambda m: ramp(m[1], float(m[2]), float(m[3])), IMAGE_KINDS)

#: PNG predictor Up undone (bytes mod 256 by column); X4: block averages; P22: /Decode flip
PNG_PREDICTOR_UP = "SELECT bmp_id, y, x, sum(grey) OVER (PARTITION BY bmp_id, x ORDER BY y ROWS UNBOUNDED PRECEDING)%256 AS byte FROM {bitmaps} b"
BLOCK_AVERAGE = "SELECT bmp_id, yb, xb, CAST(floor((sum(grey)+2)/4.0) AS BIGINT) AS grey FROM (SELECT bmp_id, CAST(floor(y/2.0) AS BIGINT) AS yb, CAST(floor(x/2.0) AS BIGINT) AS xb, grey FROM {bitmaps} b) a GROUP BY bmp_id, yb, xb"
DECODE_FLIP = "SELECT bmp_id, y, x, 255-grey AS grey FROM {bitmaps} b"

#: evaluation
CALIBRATION_BANDS = """SELECT CASE WHEN confidence>=0.9 THEN '0.9' WHEN confidence>=0.7 THEN '0.7' WHEN confidence>=0.5 THEN '0.5' ELSE '0.0' END AS band, count(*) AS n, count(CASE WHEN truth=predicted THEN 1 END) AS n_right FROM {predicted} p GROUP BY 1"""
CONFUSION = "SELECT truth, predicted, count(*) AS n FROM {predicted} p GROUP BY truth, predicted"
COVERAGE_ROLLUP = """SELECT source, count(*) AS n, count(CASE WHEN confidence>=1 THEN 1 END) AS whole, count(CASE WHEN confidence>=0.999 THEN 1 END) AS over_999, count(CASE WHEN confidence>=0.995 THEN 1 END) AS over_995, CAST(floor(1000*median(confidence)+0.5) AS BIGINT) AS median_e3, min(confidence) AS worst FROM {predicted} p GROUP BY GROUPING SETS ((source),())"""
HASH_SPLIT = "SELECT p_partkey, CASE WHEN strpos('13579bdf', substr(SHA256(CAST(p_partkey AS VARCHAR)),2,1))>0 THEN 'heldout' ELSE 'tune' END AS split FROM {part} p"
SPEED_PERCENTILES = """SELECT event_type, max(CASE WHEN rn=floor(n*0.5)+1 THEN value END) AS median, max(CASE WHEN rn=least(n,floor(n*0.9)+1) THEN value END) AS p90, max(value) AS worst FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM {events} e) r GROUP BY event_type"""
DIFF_OUTPUTS = """SELECT 'missing' AS side, l_orderkey, l_linenumber, l_quantity FROM (SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} a WHERE l_partkey%97<>0 EXCEPT ALL SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} b WHERE l_suppkey%89<>0) m
UNION ALL SELECT 'new', l_orderkey, l_linenumber, l_quantity FROM (SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} a WHERE l_suppkey%89<>0 EXCEPT ALL SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} b WHERE l_partkey%97<>0) n"""
MARK_EXTRA = """SELECT i.page_n, i.image_idx, i.x0, i.y0 FROM {images} i WHERE NOT EXISTS (SELECT 1 FROM {annots} a WHERE a.page_n=i.page_n AND a.x0<i.x1 AND a.x0+900>i.x0 AND a.y0<i.y1 AND a.y0+140>i.y0)"""
REGION_COVERS = """SELECT i.page_n, i.image_idx, bool_or((least(i.x1,p.x1)-greatest(i.x0,p.x0))*(least(i.y1,p.y1)-greatest(i.y0,p.y0))*10>=9*(p.x1-p.x0)*(p.y1-p.y0)) AS covered, count(*) AS touching
FROM {images} i JOIN {paths} p ON i.page_n=p.page_n AND p.x0<i.x1 AND p.x1>i.x0 AND p.y0<i.y1 AND p.y1>i.y0 GROUP BY i.page_n, i.image_idx"""
WORST_PAGES = "SELECT doc_id, confidence FROM {predicted} p ORDER BY confidence, doc_id LIMIT 20"

#: name: (text, inputs that are other texts or views)
TEXTS = {
    "words": WORDS, "word_lines": WORD_LINES, "text_lines": TEXT_LINES, "page_verdict": PAGE_VERDICT, "page_text": PAGE_TEXT, "unmapped_by_font": UNMAPPED_BY_FONT, "rules_placed": RULES_PLACED,
    "features": OCR_FEATURES, "ocr_regions": OCR_REGIONS, "ocr_reasons": OCR_REASONS, "page_map": PAGE_MAP, "map_flag_counts": MAP_FLAG_COUNTS, "unseen_counts": UNSEEN_COUNTS, "curve_bbox": CURVE_BBOX,
    "hist": IMAGE_HIST_FEATURES, "image_quartiles": IMAGE_QUARTILES, "image_kinds": IMAGE_KINDS, "png_predictor_up": PNG_PREDICTOR_UP, "block_average": BLOCK_AVERAGE, "decode_flip": DECODE_FLIP,
    "calibration_bands": CALIBRATION_BANDS, "confusion": CONFUSION, "coverage_rollup": COVERAGE_ROLLUP, "hash_split": HASH_SPLIT, "speed_percentiles": SPEED_PERCENTILES, "diff_outputs": DIFF_OUTPUTS,
    "mark_extra": MARK_EXTRA, "region_covers": REGION_COVERS, "worst_pages": WORST_PAGES,
}



def inputs(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", TEXTS[name])))


def _listed(text: str) -> str:
    """LISTAGG_ORD(x) and LISTAGG_WORD(x) as ordered string aggregates."""
    for mark, order, sep in (("LISTAGG_ORD(", "ord", ""), ("LISTAGG_WORD(", "first_ord", " ")):
        while (at := text.find(mark)) >= 0:
            end, depth = at + len(mark), 1
            while depth:
                depth += {"(": 1, ")": -1}.get(text[end], 0)
                end += 1
            text = f"{text[:at]}string_agg({text[at + len(mark) : end - 1]}, '{sep}' ORDER BY {order}){text[end:]}"
    return text


def query(name: str, source) -> str:
    """One DuckDB query; source(view) is a fixture view's subquery."""
    text = _listed(TEXTS[name]).replace("SHA256(", "sha256(")
    for x in inputs(name):
        text = text.replace(f"{{{x}}}", f"({query(x, source)})" if x in TEXTS else source(x))
    return text
