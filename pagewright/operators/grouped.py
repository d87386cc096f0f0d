"""Page operators whose rules are sequential or graph-shaped: a page in one task, many pages in one pass over Arrow.

A page is the unit of work (tens of thousands of boxes at most), so what is held is bounded by a page, never by the data.
Neighbour searches go through a sorted array (module boxes) or a grid.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.operators import boxes

TOUCH, LARGE_SHARE, PAGE_AREA = 10, 0.25, 6000 * 8000
STRIP_EDGE, STRIP_GAP = 5, 10


def _cols(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(n).to_numpy() for n in names]


def touching_roots(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, alone: np.ndarray, page: np.ndarray | None = None) -> np.ndarray:
    """The smallest index of each box's component in its page; boxes touch when they overlap with TOUCH of slack in all."""
    return boxes.touching(np.zeros(len(x0), np.int64) if page is None else page, x0, y0, x1, y1, alone, TOUCH)


def _clustered(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(the rows by page and ord, places of the clusters' first members, the cluster's number of each row)."""
    t, page = boxes.in_order(t, "page_n", "ord")
    x0, y0, x1, y1 = _cols(t, "x0", "y0", "x1", "y1")
    alone = (x1 - x0) * (y1 - y0) > LARGE_SHARE * PAGE_AREA
    firsts, k = np.unique(touching_roots(x0, y0, x1, y1, alone, page), return_inverse=True)
    return t, firsts, k


_BOXED = ["page_n", "ord", "x0", "y0", "x1", "y1"]


def _longs(df: DataFrame, *more: str) -> DataFrame:
    return df.selectExpr(*(f"CAST({c} AS BIGINT) {c}" for c in _BOXED), *more)


def vector_clusters(paths: DataFrame, dealt: bool = False) -> DataFrame:
    """Paths (page_n, ord, x0, y0, x1, y1) -> (page_n, ord, cluster): cluster is its first member's ord."""

    def run(t: pa.Table) -> pa.Table:
        t, firsts, k = _clustered(t)
        return t.select(["page_n", "ord"]).append_column("cluster", t["ord"].take(pa.array(firsts[k])))

    return boxes.by_page(_longs(paths), ["page_n"], run, "page_n long, ord long, cluster long", dealt)


def _extent(t: pa.Table, firsts: np.ndarray, k: np.ndarray, names: tuple[str, ...]) -> dict:
    """Page, cluster and box of each cluster."""
    out = {"page_n": t["page_n"].take(pa.array(firsts)), "cluster": t["ord"].take(pa.array(firsts))}
    for name, v, f in zip(names, _cols(t, "x0", "y0", "x1", "y1"), (np.minimum, np.minimum, np.maximum, np.maximum)):
        edge = v[firsts]
        f.at(edge, k, v)
        out[name] = pa.array(edge)
    return out


def _flags(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t[n].combine_chunks().to_numpy(zero_copy_only=False).astype(bool) for n in names]


def cluster_flags(paths: DataFrame, dealt: bool = False) -> DataFrame:
    """Each cluster's box, number of paths and flags: painted by any, white or empty by all."""

    def run(t: pa.Table) -> pa.Table:
        t, firsts, k = _clustered(t)
        n = np.bincount(k, minlength=len(firsts))
        fill, stroke, white, is_empty = (np.bincount(k[c], minlength=len(firsts)) for c in _flags(t, "fill", "stroke", "white", "is_empty"))
        return pa.table(_extent(t, firsts, k, ("x0", "y0", "x1", "y1")) | {"n_paths": n, "fill": fill > 0, "stroke": stroke > 0, "white": white == n, "is_empty": is_empty == n})

    cols = _longs(paths, "fill", "stroke", "white", "is_empty")
    return boxes.by_page(cols, ["page_n"], run, "page_n long, cluster long, x0 long, y0 long, x1 long, y1 long, n_paths long, fill boolean, stroke boolean, white boolean, is_empty boolean", dealt)


def chains(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, page: np.ndarray | None = None) -> np.ndarray:
    """The length of each letter's run."""
    return boxes.run_lengths(np.zeros(len(x0), np.int64) if page is None else page, x0, y0, x1, y1)


def letter_runs(letters: DataFrame, dealt: bool = False) -> DataFrame:
    """letters (page_n, ord, box) -> (page_n, ord, run_length)."""

    def run(t: pa.Table) -> pa.Table:
        t, page = boxes.in_order(t, "page_n", "ord")
        return t.select(["page_n", "ord"]).append_column("run_length", pa.array(chains(*_cols(t, "x0", "y0", "x1", "y1"), page), pa.int64()))

    return boxes.by_page(_longs(letters), ["page_n"], run, "page_n long, ord long, run_length long", dealt)


def merged_strips(rows: list[dict]) -> list[dict]:
    """The first pair in list order whose edges agree and touch is merged into the first, until none is left.

    Partners are looked up by their rounded left and top edges. Only the merged image changes, so only it and the
    images before it that could now reach it are looked at again.
    """
    rows = [dict(r) for r in rows]
    live, cells = [True] * len(rows), {}
    step = STRIP_EDGE + STRIP_GAP

    def cell(v: float) -> int:
        return int(v // step)

    for k, r in enumerate(rows):
        cells.setdefault((cell(r["x0"]), cell(r["y0"])), set()).add(k)

    def around(x: float, y: float) -> set[int]:
        return set().union(*(cells.get((cell(x) + a, cell(y) + b), ()) for a in (-1, 0, 1) for b in (-1, 0, 1)))

    def partner(a: int) -> tuple[int, bool] | None:
        p = rows[a]
        for b in sorted(around(p["x0"], p["y1"]) | around(p["x1"], p["y0"])):
            q = rows[b]
            if a == b or p["mask"] != q["mask"]:
                continue
            down = abs(p["x0"] - q["x0"]) <= STRIP_EDGE and abs(p["x1"] - q["x1"]) <= STRIP_EDGE and q["y0"] >= p["y0"] and abs(q["y0"] - p["y1"]) <= STRIP_GAP
            side = abs(p["y0"] - q["y0"]) <= STRIP_EDGE and abs(p["y1"] - q["y1"]) <= STRIP_EDGE and q["x0"] >= p["x0"] and abs(q["x0"] - p["x1"]) <= STRIP_GAP
            if down or side:
                return b, down
        return None

    todo = list(range(len(rows)))
    heapq.heapify(todo)
    waiting = set(todo)
    while todo:
        a = heapq.heappop(todo)
        waiting.discard(a)
        if not live[a] or not (hit := partner(a)):
            continue
        b, down = hit
        p, q = rows[a], rows[b]
        for k in (a, b):
            cells[cell(rows[k]["x0"]), cell(rows[k]["y0"])].discard(k)
        p["px_w"], p["px_h"] = (max(p["px_w"], q["px_w"]), p["px_h"] + q["px_h"]) if down else (p["px_w"] + q["px_w"], max(p["px_h"], q["px_h"]))
        p["x0"], p["y0"], p["x1"], p["y1"] = min(p["x0"], q["x0"]), min(p["y0"], q["y0"]), max(p["x1"], q["x1"]), max(p["y1"], q["y1"])
        p["parts"], p["image_idx"] = p["parts"] + q["parts"], min(p["image_idx"], q["image_idx"])
        if "members" in p:
            p["members"] = p["members"] + q["members"]
        live[b] = False
        cells.setdefault((cell(p["x0"]), cell(p["y0"])), set()).add(a)
        for k in [a, *(k for k in range(len(rows)) if live[k] and k != a and (abs(rows[k]["y1"] - p["y0"]) <= step or abs(rows[k]["x1"] - p["x0"]) <= step))]:
            if k not in waiting:
                heapq.heappush(todo, k)
                waiting.add(k)
    return [r for r, x in zip(rows, live) if x]


_STRIP = ["page_n", "image_idx", "x0", "y0", "x1", "y1", "px_w", "px_h", "mask"]


def strip_merge(images: DataFrame) -> DataFrame:
    """images -> merged images with the number of their parts."""

    def run(t: pa.Table) -> pa.Table:
        t, page = boxes.in_order(t, "page_n", "image_idx")
        given, ends = [r | {"parts": 1} for r in t.to_pylist()], np.searchsorted(page, np.arange(page[-1] + 2))
        rows = [r for a, b in zip(ends, ends[1:]) for r in merged_strips(given[a:b])]
        return pa.table({n: pa.array([r[n] for r in rows], pa.bool_() if n == "mask" else pa.int64()) for n in [*_STRIP, "parts"]})

    cols = images.selectExpr(*(f"CAST({c} AS {'BOOLEAN' if c == 'mask' else 'BIGINT'}) {c}" for c in _STRIP))
    return boxes.by_page(cols, ["page_n"], run, ", ".join(f"{c} {'boolean' if c == 'mask' else 'long'}" for c in _STRIP) + ", parts long")


def ink_boxes(ink: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Boxes (x0, y0, x1, y1, pixels) of 8-connected parts, in order of their first pixel by row.

    Runs of each row are joined with the runs of the row above that touch them: one pass, whatever the parts' shapes.
    """
    edge = np.diff(np.pad(ink, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    ys, starts = np.nonzero(edge == 1)
    ends = np.nonzero(edge == -1)[1]
    root = list(range(len(ys)))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    row = np.searchsorted(ys, np.arange(ink.shape[0] + 1)).tolist()
    s, e = starts.tolist(), ends.tolist()
    for y in range(1, ink.shape[0]):
        k, last = row[y - 1], row[y]
        for j in range(row[y], row[y + 1]):
            while k < last and e[k] < s[j]:
                k += 1
            i = k
            while i < last and s[i] <= e[j]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
                i += 1
    if not root:
        return []
    of = np.array([find(k) for k in range(len(root))])
    parts, at = np.unique(of, return_inverse=True)
    low, high = np.iinfo(np.int64).max, -1
    x0, y0, x1, y1, n = (np.full(len(parts), v, np.int64) for v in (low, low, high, high, 0))
    np.minimum.at(x0, at, starts)
    np.minimum.at(y0, at, ys)
    np.maximum.at(x1, at, ends)
    np.maximum.at(y1, at, ys + 1)
    np.add.at(n, at, ends - starts)
    return list(zip(*(v.tolist() for v in (x0, y0, x1, y1, n))))


def ink_components(bitmaps: DataFrame, below: int = 128) -> DataFrame:
    """bitmaps (bmp_id, y, x, grey) -> (bmp_id, x0, y0, x1, y1, pixels) of dark parts."""

    def run(t: pa.Table) -> pa.Table:
        y, x, grey = _cols(t, "y", "x", "grey")
        ink = np.zeros((y.max() + 1, x.max() + 1), bool)
        ink[y, x] = grey < below
        rows = ink_boxes(ink)
        ids = pa.array([t.column("bmp_id")[0].as_py()] * len(rows), pa.int64())
        return pa.table({"bmp_id": ids} | {n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(("x0", "y0", "x1", "y1", "pixels"))})

    return bitmaps.groupBy("bmp_id").applyInArrow(run, "bmp_id long, x0 long, y0 long, x1 long, y1 long, pixels long")


def vector_features(paths: DataFrame, dealt: bool = False) -> DataFrame:
    """K2's evidence of each cluster, from its paths that aren't empty."""
    counts = ("n", "hlines", "vlines", "rects", "open_rects", "curved")

    def run(t: pa.Table) -> pa.Table:
        t, firsts, k = _clustered(t)
        x0, y0, x1, y1, n_curves = _cols(t, "x0", "y0", "x1", "y1", "n_curves")
        fill, stroke, is_rect, is_empty = _flags(t, "fill", "stroke", "is_rect", "is_empty")
        w, h, shows = x1 - x0, y1 - y0, ~is_empty
        thin_h, thin_v = (h <= 40) & (w >= 4 * np.maximum(h, 2.5)), (w <= 40) & (h >= 4 * np.maximum(w, 2.5))
        held = (shows, shows & thin_h, shows & ~thin_h & thin_v, shows & is_rect & stroke, shows & is_rect & stroke & ~fill, shows & (n_curves > 0))
        area, frame = np.zeros(len(firsts), np.int64), np.zeros(len(firsts), np.int64)
        np.add.at(area, k, np.where(shows & fill & ~thin_h & ~thin_v, w * h, 0))
        np.maximum.at(frame, k, np.where(shows & is_rect & stroke, w * h, 0))
        out = _extent(t, firsts, k, ("cx0", "cy0", "cx1", "cy1")) | {c: np.bincount(k[v], minlength=len(firsts)) for c, v in zip(counts, held)}
        return pa.table(out | {"fill_area": area, "frame_area": frame})

    cols = _longs(paths, "CAST(n_curves AS BIGINT) n_curves", "fill", "stroke", "is_rect", "is_empty")
    names = ["page_n", "cluster", "cx0", "cy0", "cx1", "cy1", *counts, "fill_area", "frame_area"]
    return boxes.by_page(cols, ["page_n"], run, ", ".join(f"{c} long" for c in names), dealt)
