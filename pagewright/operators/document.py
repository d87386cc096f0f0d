"""From placed primitives to words, lines, images, vector clusters, verdicts, OCR regions and the map of every page.

`primitives` is what `pdf.scan` gives, best written as a table first: it is read once for each kind of region. All
frames that come out are keyed by (doc_id, page_n). Only strips and clusters run page by page in Python; all else is
DataFrame code, and pages of all documents spread over all tasks by that key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.geometry import r1
from pagewright.operators import boxes, layout, vectors
from pagewright.operators.grouped import merged_strips

KEYS = layout.KEYS
_IMAGE = ["ord", "x0", "y0", "x1", "y1", "px_w", "px_h", "dpi_x", "dpi_y", "mask", "inline", "annot", "clipped", "upright", "offpage", "hidden", "obj"]
_TYPES = {"ord": "long", "px_w": "long", "px_h": "long", "obj": "long", "parts": "long", "image_idx": "long"} | dict.fromkeys(("x0", "y0", "x1", "y1", "dpi_x", "dpi_y"), "double")


def merge_images(images: DataFrame) -> DataFrame:
    """Images of a page, strips of one picture merged: (keys, image_idx, attributes, parts, pieces: objects drawn)."""

    def merged(rows: list[dict]) -> Iterator[dict]:
        given = []
        for k, r in enumerate(rows):
            free = r["upright"] and not r["offpage"] and not r["hidden"]
            given.append({"image_idx": k, "px_w": r["px_w"], "px_h": r["px_h"], "mask": (r["mask"], r["annot"]) if free else k, "parts": 1, "members": [k]} | {c: r[c] * 10 for c in ("x0", "y0", "x1", "y1")})
        for k, g in enumerate(merged_strips(given)):
            first, of = rows[g["members"][0]], [rows[m] for m in g["members"]]
            objs = [x["obj"] for x in of if x["obj"]]
            yield (
                first | {c: g[c] / 10 for c in ("x0", "y0", "x1", "y1")} | {"image_idx": k, "px_w": g["px_w"], "px_h": g["px_h"], "parts": g["parts"], "pieces": [x["obj"] for x in of]}
                | {c: min(x[c] for x in of) for c in ("dpi_x", "dpi_y", "ord")} | {c: any(x[c] for x in of) for c in ("inline", "clipped")} | {"obj": min(objs, default=0)}
            )

    def run(t: pa.Table) -> pa.Table:
        t, page = boxes.in_order(t, *KEYS, "ord")
        rows, ends = t.to_pylist(), np.searchsorted(page, np.arange(page[-1] + 2))
        out = [r for a, b in zip(ends, ends[1:]) for r in merged(rows[a:b])]
        kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        cols = {c: pa.array([r[c] for r in out], kinds[_TYPES.get(c, "boolean")]) for c in [*_IMAGE, "image_idx", "parts"]}
        return pa.table({k: pa.array([r[k] for r in out], pa.int64()) for k in KEYS} | cols | {"pieces": pa.array([r["pieces"] for r in out], pa.list_(pa.int64()))})

    schema = ", ".join(["doc_id long", "page_n long", *(f"{c} {_TYPES.get(c, 'boolean')}" for c in [*_IMAGE, "image_idx", "parts"]), "pieces array<long>"])
    cols = [*(F.col(k).cast("long").alias(k) for k in KEYS), *(F.coalesce(F.col(c).cast(_TYPES.get(c, "boolean")), F.lit(0 if c in _TYPES else False).cast(_TYPES.get(c, "boolean"))).alias(c) for c in _IMAGE)]
    return boxes.by_page(images.select(*cols), KEYS, run, schema)


@dataclass
class Regions:
    """Lazy frames over one frame of primitives. tight: split tightly set words."""

    primitives: DataFrame
    tight: bool = True

    def _kind(self, kind: str) -> DataFrame:
        return self.primitives.where(F.col("kind") == kind).withColumn("page_n", F.col("page_n").cast("long"))

    @cached_property
    def pages(self) -> DataFrame:
        return self._kind("page").select(*KEYS, F.col("x1").alias("width"), F.col("y1").alias("height"), F.col("detail").cast("int").alias("rotate"))

    @cached_property
    def glyphs(self) -> DataFrame:
        cols = ["ord", "text", "mapped", "is_space", "font", "invisible", "white", "annot", "offpage", "hidden", "clipped", "x0", "y0", "x1", "y1", "ux", "uy", "ex", "ey", "dx", "dy", "size"]
        return self._kind("glyph").select(*KEYS, *cols)

    @cached_property
    def paths(self) -> DataFrame:
        cols = ["ord", "x0", "y0", "x1", "y1", "fill", "stroke", "shading", "white", "annot", "empty", "dot", "offpage", "hidden", "clipped", "n_lines", "n_curves", "rect", "closed", "seg_rows", "seg_cols"]
        return self._kind("path").select(*KEYS, *cols)

    @cached_property
    def annots(self) -> DataFrame:
        idx = (F.row_number().over(layout.page_window("ord")) - 1).alias("annot_idx")
        return self._kind("annot").select(*KEYS, "ord", "x0", "y0", "x1", "y1", "hidden", "offpage", "appearance", F.col("text").alias("subtype"), F.col("detail").alias("field"), idx)

    @cached_property
    def rules(self) -> DataFrame:
        return self._kind("rule").select(*KEYS, "ord", "x0", "y0", "x1", "y1")

    @cached_property
    def fonts(self) -> DataFrame:
        """Fonts by their number in a document."""
        schema = "base string, kind string, encoding string, to_unicode boolean, embedded boolean, widths string"
        return self.primitives.where("kind = 'font'").select("doc_id", "font", F.from_json("detail", schema).alias("f")).select("doc_id", "font", "f.*")

    @cached_property
    def words(self) -> DataFrame:
        return layout.words(self.glyphs, self.tight)

    @cached_property
    def lines(self) -> DataFrame:
        return layout.text_lines(self.words)

    @cached_property
    def verdicts(self) -> DataFrame:
        return layout.page_verdict(self.glyphs, self.pages)

    @cached_property
    def images(self) -> DataFrame:
        return merge_images(self._kind("image"))

    @cached_property
    def _sized(self) -> DataFrame:
        """Paths, those over a quarter of their page as hidden: they stand alone."""
        large = self.paths.join(self.pages, KEYS).withColumn("large", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) > vectors.LARGE_SHARE * F.col("width") * F.col("height"))
        return large.withColumn("hidden", F.col("hidden") | F.col("large"))

    @cached_property
    def clusters(self) -> DataFrame:
        """(keys, ord, cluster) of every path; a cluster over a quarter of its page stands alone."""
        return vectors.clusters(self._sized, float("inf"))

    @cached_property
    def vectors(self) -> DataFrame:
        return vectors.attributes(self.paths, self.clusters)

    @cached_property
    def vector_kinds(self) -> DataFrame:
        """K2 of every cluster, numbered by drawing order within its page (index)."""
        k = vectors.kinds(vectors.cluster_features(self._sized, float("inf")))
        return k.withColumn("index", F.row_number().over(layout.page_window("cluster")) - 1)

    @cached_property
    def ocr_regions(self) -> DataFrame:
        r = layout.ocr_regions(layout.ocr_features(self.images, self.words)).join(self.pages, KEYS)
        return r.withColumn("share", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("width") * F.col("height")))

    @cached_property
    def map(self) -> DataFrame:
        return layout.page_map(layout.map_entries(self.lines, self.images, self.vectors, self.annots))


def word_ink(glyphs: DataFrame, numbers: DataFrame) -> DataFrame:
    """P10: the union of the boxes that a word's glyphs paint in, where it differs from the word's box by a tenth or more.

    glyphs (keys, ord, box, ink struct or null), numbers (keys, ord, word)."""
    g = glyphs.join(numbers.select(*KEYS, "ord", "word"), [*KEYS, "ord"])
    edge = lambda c, f: f(F.coalesce(F.col(f"ink.{c}"), F.col(c)))
    w = g.groupBy(*KEYS, "word").agg(*(f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))), *(edge(c, f).alias(f"i{c}") for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))))
    differs = F.lit(False)
    for c in ("x0", "y0", "x1", "y1"):
        differs |= r1(F.col(c)) != r1(F.col(f"i{c}"))
    return w.where(differs).select(*KEYS, "word", F.struct(*(F.col(f"i{c}").alias(c) for c in ("x0", "y0", "x1", "y1"))).alias("ink"))
