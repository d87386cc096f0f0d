"""Image kinds (K1, K3, G11, G12) and the pixel rules that are relational.

Pixels come as (key, w, h, grey binary, row by row, 0 black). Features are numpy over one image at a time in Arrow
batches; classes are column expressions over the features.

Cases. A null or short grey, or a size of 0, gives zero features and the kind blank. An image of one colour has no ink.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.geometry import ramp
from pagewright.operators.grouped import ink_boxes

POLARITY = (0.4, 0.6)
WHOLE = ("levels", "dark", "n_px", "components", "glyphs", "runs", "word_marks", "turned_marks")
PARTS = ("spread", "extremes", "ink", "glyph_height", "height_spread", "aligned")
FEATURES = ", ".join([*(f"{c} long" for c in WHOLE), *(f"{c} double" for c in PARTS), "inverted boolean"])


def run_lengths(b: np.ndarray) -> np.ndarray:
    """Boxes (x0, y0, x1, y1, inclusive) -> the length of each mark's word-like run.

    A mark names the nearest mark to its right with nearly its bottom and height; of those that name one, the first has it.
    """
    n = len(b)
    rows: dict[int, list[int]] = {}
    for i in np.lexsort((np.arange(n), b[:, 0])).tolist():
        rows.setdefault(int(b[i, 3]), []).append(i)
    starts = {y: [int(b[i, 0]) for i in v] for y, v in rows.items()}
    box, nxt, taken = b.tolist(), [-1] * n, [False] * n
    for i, (x0, y0, x1, y1) in enumerate(box):
        h = y1 - y0 + 1
        tol, best = max(1, h // 6), None
        for y in range(max(0, y1 - tol), y1 + tol + 1):
            v = rows.get(y)
            if v is None:
                continue
            k = int(np.searchsorted(starts[y], x0, "right"))
            for j in v[k : k + 4]:
                c = box[j]
                if c[0] > x1 + h + 1:
                    break
                hj = c[3] - c[1] + 1
                if 2 * hj < h or hj > 2 * h or c[0] + 1 < x1:
                    continue
                if best is None or c[0] < best[0]:
                    best = (c[0], j)
        if best and not taken[best[1]]:
            nxt[i], taken[best[1]] = best[1], True
    out = np.ones(n, np.int64)
    for s in range(n):
        if not taken[s]:
            run = [s]
            while nxt[run[-1]] >= 0:
                run.append(nxt[run[-1]])
            out[run] = len(run)
    return out


def word_runs(b: np.ndarray) -> tuple[int, int]:
    """(runs of three marks or more, marks in them)."""
    n = run_lengths(b) if len(b) else np.zeros(0, np.int64)
    long = n[n >= 3]
    size, count = np.unique(long, return_counts=True)
    return int((count // size).sum()), len(long)


def image_features(grey: np.ndarray) -> dict:
    """grey: h x w of bytes -> K3's features."""
    h, w = grey.shape
    hist = np.bincount(grey.ravel(), minlength=256)
    n, dark = grey.size, int(hist[:128].sum())
    out = {c: 0 for c in WHOLE} | {c: 0.0 for c in PARTS} | {"inverted": False, "n_px": n, "dark": dark}
    if not n:
        return out
    mean = (hist * np.arange(256)).sum() / n
    out |= {"spread": float(np.sqrt((hist * (np.arange(256) - mean) ** 2).sum() / n)), "levels": int((hist * 1000 >= n).sum()), "extremes": float((hist[:64].sum() + hist[193:].sum()) / n)}

    def parts(inverted: bool) -> tuple[np.ndarray, np.ndarray]:
        b = np.array([(x0, y0, x1 - 1, y1 - 1) for x0, y0, x1, y1, _ in ink_boxes((grey >= 128) if inverted else (grey < 128))], np.int64).reshape(-1, 4)
        tall, wide = b[:, 3] - b[:, 1] + 1, b[:, 2] - b[:, 0] + 1
        return b, b[(tall >= 2) & (tall <= 60) & (wide <= 3 * tall)]

    inverted = 2 * dark > n
    every, g = parts(inverted)
    if POLARITY[0] <= dark / n <= POLARITY[1]:
        other = parts(not inverted)
        if len(other[1]) > len(g):
            inverted, (every, g) = not inverted, other
    out |= {"inverted": inverted, "ink": (n - dark if inverted else dark) / n, "components": len(every), "glyphs": len(g)}
    if len(g):
        hs = np.sort(g[:, 3] - g[:, 1] + 1)
        q1, q2, q3 = (int(hs[(len(hs) - 1) * p // 4]) for p in (1, 2, 3))
        bottoms = np.bincount(g[:, 3] + 1, minlength=h + 2)
        at = g[:, 3]
        runs, marks = word_runs(g)
        up = np.stack([h - 1 - g[:, 3], g[:, 0], h - 1 - g[:, 1], g[:, 2]], 1)
        down = np.stack([g[:, 1], w - 1 - g[:, 2], g[:, 3], w - 1 - g[:, 0]], 1)
        out |= {
            "glyph_height": float(q2), "height_spread": (q3 - q1) / q2, "aligned": float((bottoms[at] + bottoms[at + 1] + bottoms[at + 2] >= 4).mean()),
            "runs": runs, "word_marks": marks, "turned_marks": max(word_runs(up)[1], word_runs(down)[1]),
        }
    return out


def with_features(images: DataFrame, key: str) -> DataFrame:
    """images (key long, w, h, grey) -> (key, w, h, K3's features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*WHOLE, *PARTS, "inverted"]
        for b in batches:
            rows = []
            for w, h, g in zip(b.column("w").to_pylist(), b.column("h").to_pylist(), b.column("grey").to_pylist()):
                fits = g is not None and w and h and len(g) >= w * h
                rows.append(image_features(np.frombuffer(g, np.uint8)[: w * h].reshape(h, w) if fits else np.zeros((0, 0), np.uint8)))
            kinds = [pa.int64()] * len(WHOLE) + [pa.float64()] * len(PARTS) + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (key, "w", "h")), *(pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds))], [key, "w", "h", *names])

    cols = images.select(F.col(key).cast("long"), F.col("w").cast("long"), F.col("h").cast("long"), "grey")
    return cols.mapInArrow(run, f"{key} long, w long, h long, {FEATURES}")


def _r3(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def image_kinds(f: DataFrame) -> DataFrame:
    """K1: kind, confidence and has_text from the features; of equal scores the first of text, photo, graphic wins."""
    c = F.col
    lined = c("aligned") * c("glyphs")
    sparse = ramp(c("aligned"), 0.35, 0.5) * ramp(lined, 5, 10) * ramp(c("ink"), 0.03, 0.015) * ramp(F.greatest("w", "h"), 400, 600)
    two = ramp(c("extremes"), 0.5, 0.8)
    text = two * ramp(c("ink"), 0.002, 0.006) * ramp(c("ink"), 0.5, 0.3) * ramp(c("glyphs"), 8, 30) * ramp(c("height_spread"), 4, 2.5) * ramp(c("aligned"), 0.5, 0.75)
    out = f.withColumn("sparse", sparse).withColumn("text_score", text).withColumn("photo_score", ramp(c("levels"), 32, 96) * ramp(c("extremes"), 0.8, 0.5))
    out = out.withColumn("graphic_score", F.greatest(ramp(c("levels"), 96, 24), two) * (1 - c("text_score")))
    scores = [c("text_score"), c("photo_score"), c("graphic_score")]
    best, blank = F.greatest(*scores), (c("spread") < 4) | (c("ink") < 0.0005)
    second = F.greatest(*(F.when(s < best, s).otherwise(0.0) for s in scores))
    kind = F.when(blank, "blank").when(scores[0] == best, "text").when(scores[1] == best, "photo").otherwise("graphic")
    out = out.withColumn("kind", kind).withColumn("confidence", F.when(blank, 0.9).otherwise(_r3(F.least(F.lit(0.95), F.greatest(F.lit(0.05), best * (0.5 + 0.5 * (best - second)))))))
    marks, turned = c("word_marks"), ramp(c("turned_marks"), 40, 120)
    words = F.when(c("kind") == "photo", ramp(F.greatest(marks, "turned_marks"), 40, 120)).when(c("kind") == "text", F.greatest(ramp(marks, 4, 30), turned, c("sparse"))).otherwise(F.greatest(ramp(marks, 8, 40), turned, c("sparse")))
    none = F.when(c("sparse") > 0, _r3(0.05 + 0.9 * c("sparse"))).otherwise(0.0)
    return out.withColumn("has_text", F.when(c("kind") == "blank", none).otherwise(_r3(0.05 + 0.9 * words)))


def pixels_to_images(pixels: DataFrame, key: str) -> DataFrame:
    """pixels (key, y, x, grey 0 .. 255), all of an image -> (key, w, h, grey binary)."""
    hexes = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "grey"))), lambda s: F.lpad(F.hex(s["grey"].cast("long")), 2, "0"))
    return pixels.groupBy(key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.unhex(F.array_join(hexes, "")).alias("grey"))


def histogram_features(pixels: DataFrame, key: str) -> DataFrame:
    """A4: sums over the histogram of each image."""
    n = F.col("n")
    h = pixels.groupBy(key, "grey").agg(F.count("*").alias("n"))
    h = h.withColumn("px", F.sum("n").over(Window.partitionBy(key)))
    g = F.col("grey").cast("long")
    return h.groupBy(key).agg(
        F.sum("n").alias("px"), F.sum(g * n).alias("total"), F.sum(g * g * n).alias("squares"), F.count_if(n * 1000 >= F.col("px")).alias("levels"),
        F.sum(F.when((g < 64) | (g > 192), n).otherwise(0)).alias("extremes"), F.sum(F.when(g < 128, n).otherwise(0)).alias("dark"),
    )


def quartiles(values: DataFrame, key: str, value: str) -> DataFrame:
    """A5: the values at places (n - 1) p / 4, rounded down, of each group's sorted values."""
    s = values.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("v"))
    at = lambda p: F.element_at("v", (F.floor((F.size("v") - 1) * p / 4) + 1).cast("int")).alias(f"q{p}")
    return s.select(key, *map(at, (1, 2, 3)))


def block_average(pixels: DataFrame, key: str, side: int) -> DataFrame:
    """Means of side x side blocks, rounded to the nearest; blocks at the edges are smaller."""
    yb, xb = (F.floor(F.col(c) / side).alias(f"{c}b") for c in ("y", "x"))
    n = F.count("*")
    return pixels.groupBy(key, yb, xb).agg(F.floor((F.sum("grey") + F.floor(n / 2)) / n).alias("grey"))


def predictor_up(pixels: DataFrame, key: str) -> DataFrame:
    """X7, PNG's Up: a byte is the sum of its column so far."""
    w = Window.partitionBy(key, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return pixels.select(key, "y", "x", F.pmod(F.sum("grey").over(w), F.lit(256)).alias("byte"))


def decoded(sample: Column, low: Column, high: Column) -> Column:
    """A sample under /Decode [low high]: turned round where low is above high."""
    return F.when(low > high, 255 - sample).otherwise(sample)


def unpacked(byte: Column, k: Column, bits: int) -> Column:
    """Sample k of a byte (of two bytes' first for 16 bits), scaled to 0 .. 255."""
    if bits >= 8:
        return byte
    top = (1 << bits) - 1
    return F.floor((F.floor(byte / F.pow(F.lit(2), 8 - bits * (k + 1))) % (top + 1)) * 255 / top)


def long_side(w: Column, h: Column, limit: int) -> Column:
    """Pixels of a thumbnail's long side: more for long images, up to 8 times."""
    aspect = F.greatest(w, h) / F.greatest(F.lit(1), F.least(w, h))
    return F.floor(limit * F.least(F.lit(8.0), F.greatest(F.lit(1.0), aspect / 2)) + 0.5)


def rgb_grey(r: Column, g: Column, b: Column) -> Column:
    """P19 for three components."""
    return F.floor((299 * r + 587 * g + 114 * b + 500) / 1000)


def cmyk_grey(c: Column, m: Column, y: Column, k: Column) -> Column:
    """P19 for four: each ink with black, then as red, green and blue."""
    return rgb_grey(*(255 - F.least(F.lit(255), x + k) for x in (c, m, y)))


def turn_of(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """(transpose, flip_x, flip_y) from the page directions of an image's own right (u) and down (v) sides."""
    transpose = F.abs(uy) > F.abs(ux)
    return F.struct(transpose.alias("transpose"), F.when(transpose, vx < 0).otherwise(ux < 0).alias("flip_x"), F.when(transpose, uy < 0).otherwise(vy < 0).alias("flip_y"))
