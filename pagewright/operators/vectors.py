"""Vector clusters, their attributes and their kinds (G7, G10, K2), keyed by (doc_id, page_n).

Clusters and letter runs are graph rules of a page and run in one pass over whole pages (module boxes). All evidence of a
cluster comes from the same pass; rules on sorted positions step through the clusters together. Lengths are points
times `unit`. Paths that paint nothing (`empty`) have no say in a kind.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators import boxes
from pagewright.operators.grouped import LARGE_SHARE, chains, touching_roots

KEYS = ["doc_id", "page_n"]
THIN = 4.0


_BOX = ("x0", "y0", "x1", "y1")


def _roots(t: pa.Table, page: np.ndarray, page_area: float, unit: float) -> np.ndarray:
    """G7 over pages: the place of the first path of each path's cluster."""
    x0, y0, x1, y1 = (np.asarray(t[c], np.float64) * (10 / unit) for c in _BOX)
    alone = t["alone"].combine_chunks().to_numpy(zero_copy_only=False) | ((x1 - x0) * (y1 - y0) > LARGE_SHARE * page_area * 100 / unit / unit)
    return touching_roots(x0, y0, x1, y1, alone, page)


def _alone() -> Column:
    return (F.coalesce(F.col("offpage"), F.lit(False)) | F.coalesce(F.col("hidden"), F.lit(False))).alias("alone")


def _keyed() -> list[Column]:
    return [*(F.col(k).cast("long").alias(k) for k in [*KEYS, "ord"]), *(F.col(c).cast("double").alias(c) for c in _BOX)]


def clusters(paths: DataFrame, page_area: float, unit: float = 1.0) -> DataFrame:
    """(doc_id, page_n, ord, cluster): cluster is the ord of its first path. Paths that are hidden, off the page or
    over a quarter of it stand alone; others are joined where their boxes come within a point."""

    def run(t: pa.Table) -> pa.Table:
        t, page = boxes.in_order(t, *KEYS, "ord")
        return t.select([*KEYS, "ord"]).append_column("cluster", t["ord"].take(pa.array(_roots(t, page, page_area, unit))))

    return boxes.by_page(paths.select(*_keyed(), _alone()), KEYS, run, "doc_id long, page_n long, ord long, cluster long")


def attributes(paths: DataFrame, of: DataFrame) -> DataFrame:
    """Regions of clusters: union of boxes and OR (fill, stroke, shading, clipped) or AND (white, annot, empty) of flags;
    offpage and hidden are the first path's."""
    p = paths.join(of, [*KEYS, "ord"])
    first = lambda c: F.min_by(c, "ord").alias(c)
    return p.groupBy(*KEYS, "cluster").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_paths"), F.min("ord").alias("ord"),
        *(F.bool_or(c).alias(c) for c in ("fill", "stroke", "shading", "clipped")), *(F.bool_and(c).alias(c) for c in ("white", "annot", "empty")), first("offpage"), first("hidden"),
    )


def _size() -> tuple[Column, Column]:
    return F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")


def rectish() -> Column:
    """drawn as a rectangle, or closed with four or five straight segments."""
    return F.col("rect") | (F.col("closed") & (F.col("n_curves") == 0) & F.col("n_lines").between(4, 5))


def thin(unit: float = 1.0) -> tuple[Column, Column]:
    """(thin and level, thin and upright)."""
    w, h = _size()
    least = F.lit(0.25 * unit)
    return (h <= THIN * unit) & (w >= 4 * F.greatest(h, least)), (w <= THIN * unit) & (h >= 4 * F.greatest(w, least))


def glyph_like(unit: float = 1.0) -> Column:
    """a filled path shaped like a letter."""
    w, h = _size()
    return ~F.col("empty") & F.col("fill") & ~F.col("stroke") & ~rectish() & h.between(2 * unit, 80 * unit) & (w <= 3 * h) & ((F.col("n_curves") > 0) | (F.col("n_lines") >= 3))


def letter_runs(paths: DataFrame, unit: float = 1.0) -> DataFrame:
    """(doc_id, page_n, ord, run_length) of the paths shaped like letters."""

    def run(t: pa.Table) -> pa.Table:
        t, page = boxes.in_order(t, *KEYS, "ord")
        n = chains(*(np.asarray(t[c]) for c in _BOX), page)
        return t.select([*KEYS, "ord"]).append_column("run_length", pa.array(n, pa.int64()))

    return boxes.by_page(paths.where(glyph_like(unit)).select(*_keyed()), KEYS, run, "doc_id long, page_n long, ord long, run_length long")


_SHAPE = {"fill": "boolean", "stroke": "boolean", "rectish": "boolean", "empty": "boolean", "th": "boolean", "tv": "boolean", "n_curves": "long", "seg_rows": "long", "seg_cols": "long"}
_COUNTS = ("hlines", "vlines", "rects", "open_rects", "curved", "glyphs")
_PLACES = ("rows", "cols", "rect_cols", "rect_rows", "rows_in", "cols_in", "cell_rows", "cell_cols")
_SHARES = ("cell_cover", "filled", "rect_cover")
_EVIDENCE = ", ".join(["doc_id long", "page_n long", "cluster long", *(f"{c} double" for c in ("cx0", "cy0", "cx1", "cy1")), "n long", *(f"{c} long" for c in _COUNTS), *(f"{c} int" for c in _PLACES), *(f"{c} double" for c in _SHARES), "framed boolean", "w double", "h double"])


def _fold(k: np.ndarray, m: int, x: np.ndarray, more: np.ndarray, step: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> None:
    """Calls step(groups, their next x, its more) until each of m groups k has seen its values by x, then more."""
    order = np.lexsort((more, x, k))
    x, more, n = x[order], more[order], np.bincount(k, minlength=m)
    start, by = np.cumsum(n) - n, np.argsort(-n, kind="stable")
    sizes = -n[by]
    for r in range(int(n.max(initial=0))):
        some = by[: np.searchsorted(sizes, -r, "left")]
        step(some, x[start[some] + r], more[start[some] + r])


def _distinct(k: np.ndarray, m: int, x: np.ndarray, unit: float) -> np.ndarray:
    """Positions more than a point after the last one counted."""
    n, last = np.zeros(m, np.int32), np.full(m, -np.inf)

    def step(g: np.ndarray, v: np.ndarray, _: np.ndarray) -> None:
        g, v = g[new := v - last[g] > unit], v[new]
        n[g] += 1
        last[g] = v

    _fold(k, m, x, x, step)
    return n


def _covered(k: np.ndarray, m: int, x: np.ndarray, length: np.ndarray, span: np.ndarray, unit: float) -> np.ndarray:
    """Groups of positions (gaps of a point at most) whose lines together cover half of the span."""
    n, last, total = np.zeros(m, np.int32), np.full(m, -np.inf), np.zeros(m)

    def step(g: np.ndarray, v: np.ndarray, size: np.ndarray) -> None:
        new = v - last[g] > unit
        n[g] += new & (total[g] >= 0.5 * span[g])
        last[g], total[g] = v, np.where(new, 0.0, total[g]) + size

    _fold(k, m, x, length, step)
    return n + (total >= 0.5 * span)


def _shared(k: np.ndarray, m: int, x: np.ndarray, unit: float) -> np.ndarray:
    """Groups of two or more positions with gaps of a point at most."""
    n, run, last = np.zeros(m, np.int32), np.zeros(m, np.int32), np.full(m, -np.inf)

    def step(g: np.ndarray, v: np.ndarray, _: np.ndarray) -> None:
        on = v - last[g] <= unit
        n[g] += ~on & (run[g] >= 2)
        run[g], last[g] = np.where(on, run[g] + 1, 1), v

    _fold(k, m, x, x, step)
    return n + (run >= 2)


def _evidence(t: pa.Table, firsts: np.ndarray, k: np.ndarray, run: np.ndarray, unit: float) -> pa.Table:
    """K2's evidence of clusters k, of which the first paths stand at firsts; run: the paths' runs of letters."""
    m = len(firsts)
    flag = {c: t[c].combine_chunks().to_numpy(zero_copy_only=False).astype(bool) for c in ("fill", "stroke", "rectish", "empty", "th", "tv")}
    box = [np.asarray(t[c], np.float64) for c in _BOX]
    edges = [np.full(m, np.inf), np.full(m, np.inf), np.full(m, -np.inf), np.full(m, -np.inf)]
    for e, v, f in zip(edges, box, (np.minimum, np.minimum, np.maximum, np.maximum)):
        f.at(e, k, v)
    s = np.flatnonzero(~flag["empty"])
    of = k[s]
    x0, y0, x1, y1 = (v[s] for v in box)
    cx0, cy0, cx1, cy1 = (e[of] for e in edges)
    fill, stroke, rect, th, tv = (flag[c][s] for c in ("fill", "stroke", "rectish", "th", "tv"))
    cw, ch, w, h = cx1 - cx0, cy1 - cy0, x1 - x0, y1 - y0
    area, mx, my, edge = w * h, (x0 + x1) / 2, (y0 + y1) / 2, np.maximum(0.03 * np.maximum(cw, ch), 6.0 * unit)
    cell, open_rect = rect & ~th & ~tv & (area < 0.5 * cw * ch), rect & stroke & ~fill
    wide, high = edges[2] - edges[0], edges[3] - edges[1]
    count = lambda c: np.bincount(of[c], minlength=m)
    some = lambda c: count(c) > 0
    near = lambda a, b: np.abs(a - b) <= 2 * unit
    places = lambda f, c, x: f(of[c], m, x[c], unit)
    lines = lambda c, x, length, span: _covered(of[c], m, x[c], length[c], span, unit)

    def most(name: str) -> np.ndarray:
        out = np.zeros(m, np.int64)
        np.maximum.at(out, of, np.nan_to_num(np.asarray(t[name], np.float64)[s]).astype(np.int64))
        return np.maximum(0, out - 2)

    def share(c: np.ndarray) -> np.ndarray:
        total, whole = np.bincount(of[c], area[c], m), wide * high
        return np.where(whole > 0, np.minimum(1.0, total / np.where(whole > 0, whole, 1.0)), 0.0)

    n, large = np.bincount(of, minlength=m), (wide >= 10 * unit) & (high >= 10 * unit)
    level, upright = th & (w >= 0.9 * cw), tv & (h >= 0.9 * ch)
    sides = some(level & near(y0, cy0)) & some(level & near(y1, cy1)) & some(upright & near(x0, cx0)) & some(upright & near(x1, cx1))
    found = {
        "hlines": count(th), "vlines": count(~th & tv), "rects": count(rect & stroke), "open_rects": count(open_rect), "curved": count(np.asarray(t["n_curves"])[s] > 0), "glyphs": count(run[s] >= 3),
        "rows": places(_distinct, th & (w >= 0.5 * cw), my), "cols": places(_distinct, ~th & tv & (h >= 0.5 * ch), mx), "rect_cols": places(_distinct, open_rect, x0), "rect_rows": places(_distinct, open_rect, y0),
        "rows_in": np.maximum(lines(th & (my > cy0 + edge) & (my < cy1 - edge), my, w, wide), most("seg_rows")), "cols_in": np.maximum(lines(tv & (mx > cx0 + edge) & (mx < cx1 - edge), mx, h, high), most("seg_cols")),
        "cell_rows": places(_shared, cell, y0), "cell_cols": places(_shared, cell, x0), "cell_cover": share(cell), "filled": share(fill & ~th & ~tv), "rect_cover": share(open_rect),
        "framed": (some(rect & stroke & (area >= 0.85 * cw * ch)) | sides) & large,
    }
    kinds = dict.fromkeys(_COUNTS, pa.int64()) | dict.fromkeys(_PLACES, pa.int32()) | dict.fromkeys(_SHARES, pa.float64()) | {"framed": pa.bool_()}
    first = t.select([*KEYS, "ord"]).take(pa.array(firsts)).rename_columns([*KEYS, "cluster"])
    cols = dict(zip(("cx0", "cy0", "cx1", "cy1"), edges)) | {"n": n} | {c: pa.array(v, kinds[c], mask=n == 0) for c, v in found.items()} | {"w": wide, "h": high}
    return pa.table({c: first[c] for c in first.column_names} | cols)


def _shapes(unit: float) -> list[Column]:
    th, tv = thin(unit)
    named = {"rectish": rectish(), "th": th, "tv": tv}
    return [*_keyed(), *(F.coalesce(named.get(c, F.col(c)).cast(k), F.lit(False if k == "boolean" else 0).cast(k)).alias(c) for c, k in _SHAPE.items())]


def features(paths: DataFrame, of: DataFrame, runs: DataFrame, unit: float = 1.0) -> DataFrame:
    """K2's evidence of each cluster; the cluster's box is that of all of its paths."""

    def run(t: pa.Table) -> pa.Table:
        t, page = boxes.in_order(t, *KEYS, "cluster", "ord")
        _, firsts, k = np.unique(page, return_index=True, return_inverse=True)
        return _evidence(t, firsts, k, np.asarray(t["run"]), unit)

    given = paths.join(of, [*KEYS, "ord"]).join(runs, [*KEYS, "ord"], "left")
    return boxes.by_page(given.select(*_shapes(unit), F.col("cluster").cast("long").alias("cluster"), F.coalesce("run_length", F.lit(1)).cast("long").alias("run")), KEYS, run, _EVIDENCE)


def cluster_features(paths: DataFrame, page_area: float, unit: float = 1.0, dealt: bool = False) -> DataFrame:
    """G7, G10 and K2's evidence in one pass over each page."""

    def run(t: pa.Table) -> pa.Table:
        t, page = boxes.in_order(t, *KEYS, "ord")
        box, letters, runs = [np.asarray(t[c]) for c in _BOX], np.flatnonzero(t["letter"].combine_chunks().to_numpy(zero_copy_only=False)), np.ones(len(t), np.int64)
        runs[letters] = chains(*(v[letters] for v in box), page[letters])
        firsts, k = np.unique(_roots(t, page, page_area, unit), return_inverse=True)
        return _evidence(t, firsts, k, runs, unit)

    return boxes.by_page(paths.select(*_shapes(unit), _alone(), F.coalesce(glyph_like(unit), F.lit(False)).alias("letter")), KEYS, run, _EVIDENCE, dealt)


def kinds(f: DataFrame, unit: float = 1.0) -> DataFrame:
    """K2: kind, confidence and has_text of each cluster; the first rule that holds."""
    c = F.col
    glyphs = c("glyphs") / c("n")
    grid = ((c("rows_in") >= 2) & (c("cols_in") >= 1)) | ((c("cell_rows") >= 2) & (c("cell_cols") >= 2) & (c("cell_cover") >= 0.6))
    rule = (c("hlines") + c("vlines") == c("n")) & (((c("vlines") == 0) & (c("rows") <= 1)) | ((c("hlines") == 0) & (c("cols") <= 1)))
    border = c("framed") | ((c("w") >= 10 * unit) & (c("h") >= 10 * unit) & (c("open_rects") >= 1) & (c("n") <= 2) & (c("filled") < 0.2))
    rules = [
        (c("n") == 0, "fill", F.lit(0.5), F.lit(0.02)), (glyphs >= 0.5, "outlined_text", F.lit(0.9), F.lit(0.9)), (grid, "table_grid", F.lit(0.9), F.lit(0.02)), (rule, "rule", F.lit(0.9), F.lit(0.02)),
        (border, "border", F.lit(0.9), F.lit(0.02)), ((c("filled") >= 0.6) & (c("n") <= 3), "fill", F.lit(0.85), F.lit(0.02)),
        (F.lit(True), "chart_or_diagram", F.when(c("n") >= 5, 0.7).otherwise(0.5), 0.05 + 0.5 * glyphs),
    ]
    out = {}
    for k, at in (("kind", 1), ("confidence", 2), ("has_text", 3)):
        col = None
        for r in rules:
            v = F.lit(r[at]) if at == 1 else r[at]
            col = F.when(r[0], v) if col is None else col.when(r[0], v)
        out[k] = col
    return f.select("*", *(v.alias(k) for k, v in out.items()))
