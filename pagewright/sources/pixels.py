"""Images of PDF files as small grey pictures: filters, codecs, colour spaces, block averages, turns, strips.

An image that can't be decoded is a row with an error: no_size, jpeg (other than baseline), jpx, jbig2, undecoded, bits,
short, colour_space, no_colour_space, lookup, ccitt_columns, no_object. Sums are of integers, so results
are the same everywhere. 0 is black.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.sources import fax, jpeg
from pagewright.sources.pdf import FILTERS, Document, Interpreter, OverBudget, Stream, predicted

THUMB, KIND_THUMB, ASPECT, LONG = 256, 1024, 2.0, 8.0
FULL = {
    "BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "DP": "DecodeParms", "F": "Filter", "H": "Height", "IM": "ImageMask", "I": "Interpolate", "W": "Width",
    "G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK",
}
CODECS = {"JPXDecode": "jpx", "JBIG2Decode": "jbig2"}


class Failed(Exception):
    pass


def full_keys(info: dict) -> dict:
    """An inline image's dictionary without abbreviations."""
    return {FULL.get(k, k): FULL.get(v, v) if isinstance(v, str) and k in ("CS", "ColorSpace") else v for k, v in info.items()}


def long_side(w: int, h: int, limit: int) -> int:
    """P18"""
    aspect = max(w, h) / max(1, min(w, h))
    return int(limit * min(LONG, max(1.0, aspect / ASPECT)) + 0.5)


class Space:
    """A colour space as a number of components and a rule to grey."""

    def __init__(self, doc: Document, v, res: dict | None = None, depth: int = 0):
        v = doc.get(v)
        named = doc.get(res.get("ColorSpace")) if isinstance(res, dict) else None
        if isinstance(v, str) and isinstance(named, dict) and v in named:
            v = doc.get(named[v])
        parts = [doc.get(x) for x in v] if isinstance(v, list) else [v]
        name = parts[0] if parts else None
        self.table: np.ndarray | None = None
        if name in ("DeviceGray", "CalGray", "G"):
            self.n = 1
        elif name in ("DeviceRGB", "CalRGB", "RGB"):
            self.n = 3
        elif name in ("DeviceCMYK", "CMYK"):
            self.n = 4
        elif name == "ICCBased" and len(parts) > 1 and isinstance(parts[1], Stream) and parts[1].info.get("N") in (1, 3, 4):
            self.n = parts[1].info["N"]
        elif name == "Separation":
            self.n = -1  # a tint: 0 is paper
        elif name in ("Indexed", "I") and len(parts) > 3 and not depth:
            base = Space(doc, parts[1], res, 1)
            raw = doc.decode(parts[3]) if isinstance(parts[3], Stream) else parts[3]
            if not isinstance(raw, bytes):
                raise Failed("lookup")
            n = abs(base.n)
            rows = np.frombuffer(raw[: len(raw) // n * n], np.uint8).reshape(-1, n)
            self.n, self.table = 1, np.full(256, 255, np.uint8)
            self.table[: min(256, len(rows))] = base.grey(rows)[:256]
        elif name is None:
            raise Failed("no_colour_space")
        else:
            raise Failed("colour_space")

    def grey(self, s: np.ndarray) -> np.ndarray:
        """Samples (.., components) of 0 .. 255 -> grey; an indexed space takes plain indices."""
        s = s.astype(np.int64)
        if self.table is not None:
            return self.table[np.minimum(s[..., 0], 255)]
        if self.n == -1:
            return (255 - s[..., 0]).astype(np.uint8)
        if self.n == 1:
            return s[..., 0].astype(np.uint8)
        if self.n == 4:
            s = 255 - np.minimum(255, s[..., :3] + s[..., 3:4])
        return ((299 * s[..., 0] + 587 * s[..., 1] + 114 * s[..., 2] + 500) // 1000).astype(np.uint8)


def unpacked(row: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Rows of packed bytes -> n samples each, as they are (the upper byte of 16 bits)."""
    if bits == 16:
        return row[:, ::2][:, :n]
    if bits == 8:
        return row[:, :n]
    each = np.unpackbits(row, axis=1)[:, : n * bits].reshape(len(row), n, bits)
    return (each << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)


def averaged(grey: np.ndarray, limit: int) -> np.ndarray:
    """Block averages, rounded, so that the long side is at most long_side(..)."""
    h, w = grey.shape
    most = long_side(w, h, limit)
    if max(w, h) <= most:
        return grey
    tw, th = (max(1, x * most // max(w, h)) for x in (w, h))
    xs, ys = np.arange(tw + 1) * w // tw, np.arange(th + 1) * h // th
    sums = np.add.reduceat(np.add.reduceat(grey.astype(np.int64), ys[:-1], axis=0), xs[:-1], axis=1)
    n = np.diff(ys)[:, None] * np.diff(xs)[None]
    return ((sums + n // 2) // n).astype(np.uint8)


def samples(doc: Document, info: dict, raw: bytes, res: dict | None = None) -> np.ndarray:
    """An image's grey pixels at full size."""
    get = doc.get
    w, h = get(info.get("Width")), get(info.get("Height"))
    if not (isinstance(w, int) and isinstance(h, int) and w > 0 and h > 0):
        raise Failed("no_size")
    names, parms = get(info.get("Filter", [])), get(info.get("DecodeParms", []))
    names, parms = names if isinstance(names, list) else [names], parms if isinstance(parms, list) else [parms]
    bits, mask = get(info.get("BitsPerComponent")), get(info.get("ImageMask")) is True
    bits = 1 if mask else bits
    for k, name in enumerate(names):
        name, p = get(name), get(parms[k]) if k < len(parms) else None
        p = {a: get(b) for a, b in p.items()} if isinstance(p, dict) else {}
        if name in CODECS:
            raise Failed(CODECS[name])
        if name in ("DCTDecode", "DCT"):
            try:
                return jpeg_grey(jpeg.decode(raw), [get(x) for x in get(info.get("Decode")) or []])
            except Exception as e:
                raise Failed("jpeg") from e
        if name in ("CCITTFaxDecode", "CCF"):
            columns = p.get("Columns", 1728)
            if not isinstance(columns, int) or columns < 1:
                raise Failed("ccitt_columns")
            raw, _ = fax.decode(raw, columns, p.get("Rows", 0) or h, p.get("K", 0), p.get("BlackIs1") is True, p.get("EncodedByteAlign") is True)
            bits = 1
        elif name in FILTERS:
            raw = predicted(FILTERS[name](raw), p)
        else:
            raise Failed("undecoded")
    if bits not in (1, 2, 4, 8, 16):
        raise Failed("bits")
    space = None if mask else Space(doc, info.get("ColorSpace"), res)
    n = 1 if mask else abs(space.n)
    width = -(-w * n * bits // 8)
    if len(raw) < width * h:
        raise Failed("short")
    s = unpacked(np.frombuffer(raw[: width * h], np.uint8).reshape(h, width), w * n, bits).reshape(h, w, n)
    top = (1 << min(bits, 8)) - 1
    order = get(info.get("Decode"))
    order = [get(x) for x in order] if isinstance(order, list) else []
    for k in range(min(n, len(order) // 2)):  # P22
        if isinstance(order[2 * k], (int, float)) and isinstance(order[2 * k + 1], (int, float)) and order[2 * k] > order[2 * k + 1]:
            s = s.copy()
            s[..., k] = top - s[..., k]
    if mask:
        return (s[..., 0] * 255).astype(np.uint8)
    if space.table is not None:
        return space.grey(s)
    return space.grey(s.astype(np.int64) * 255 // top)


def jpeg_grey(s: np.ndarray, order: list) -> np.ndarray:
    """Decoded samples by their number of components, turned round by /Decode, as grey."""
    for k in range(min(s.shape[2], len(order) // 2)):
        if order[2 * k] > order[2 * k + 1]:
            s[..., k] = 255 - s[..., k]
    return Space(Document(b""), {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}[s.shape[2]]).grey(s)


def turn_of(corners: list[tuple[float, float]]) -> tuple[bool, bool, bool]:
    """(transpose, flip_x, flip_y) from an image's page corners: upper left, upper right, lower left."""
    (ax, ay), (bx, by), (cx, cy) = corners
    ux, uy, vx, vy = bx - ax, by - ay, cx - ax, cy - ay
    if abs(uy) > abs(ux):
        return True, vx < 0, uy < 0
    return False, ux < 0, vy < 0


def turned(grey: np.ndarray, turn: tuple[bool, bool, bool]) -> np.ndarray:
    """X10"""
    g = grey.T if turn[0] else grey
    return np.ascontiguousarray(g[:: -1 if turn[2] else 1, :: -1 if turn[1] else 1])


def merged(box: tuple, pieces: list[tuple[tuple, np.ndarray | None]], limit: int) -> np.ndarray:
    """Pieces (box, pixels or None) pasted by nearest pixel onto a white canvas of the coarsest piece's scale."""
    there = [(b, g) for b, g in pieces if g is not None]
    if not there:
        raise Failed("undecoded")
    scale = max(max((b[2] - b[0]) / g.shape[1], (b[3] - b[1]) / g.shape[0]) for b, g in there)
    w, h = max(1, round((box[2] - box[0]) / scale)), max(1, round((box[3] - box[1]) / scale))
    most = long_side(w, h, limit)
    if max(w, h) > most:
        w, h = max(1, w * most // max(w, h)), max(1, h * most // max(w, h))
    canvas = np.full((h, w), 255, np.uint8)
    xs, ys = box[0] + (np.arange(w) + 0.5) * (box[2] - box[0]) / w, box[1] + (np.arange(h) + 0.5) * (box[3] - box[1]) / h
    for b, g in there:
        x, y = np.flatnonzero((xs >= b[0]) & (xs < b[2])), np.flatnonzero((ys >= b[1]) & (ys < b[3]))
        if len(x) and len(y):
            u = np.minimum(g.shape[1] - 1, ((xs[x] - b[0]) / (b[2] - b[0]) * g.shape[1]).astype(int))
            v = np.minimum(g.shape[0] - 1, ((ys[y] - b[1]) / (b[3] - b[1]) * g.shape[0]).astype(int))
            canvas[np.ix_(y, x)] = g[np.ix_(v, u)]
    return canvas


def thumbs_of(content: bytes, limit: int = THUMB) -> list[dict]:
    """One row an image object of a file, where it is drawn first; inline images are keyed -1, -2 .. in drawing order."""
    out, seen, inline = [], set(), 0
    doc = Document(content)
    for n, page in enumerate(doc.pages()):
        run = Interpreter(doc, page)
        try:
            run.run()
        except OverBudget:
            pass
        res = doc.get(page.get("Resources"))
        for r in run.rows:
            if r["kind"] != "image":
                continue
            key = r["obj"]
            if not key:
                inline -= 1
                key = inline
            elif key in seen:
                continue
            seen.add(key)
            row = {"page_n": n + 1, "obj": key, "width": r["px_w"], "height": r["px_h"], "w": None, "h": None, "grey": None, "error": None}
            try:
                if key < 0:
                    info, raw = r["source"]
                    g = samples(doc, full_keys(info), raw, res)
                else:
                    s = doc.get(doc.ref(key))
                    if not isinstance(s, Stream):
                        raise Failed("no_object")
                    g = samples(doc, s.info, s.raw, res)
                g = turned(averaged(g, limit), turn_of(r["corners"]))
                row |= {"w": g.shape[1], "h": g.shape[0], "grey": g.tobytes()}
            except Failed as e:
                row["error"] = str(e)
            except Exception as e:
                row["error"] = f"damaged: {type(e).__name__}"
            out.append(row)
    return out


def thumbs(files: DataFrame, limit: int = THUMB) -> DataFrame:
    """Files (doc_id, content) -> a row for each image object; files that can't be read have none."""
    schema = "doc_id long, page_n int, obj long, width int, height int, w int, h int, grey binary, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        names = ["doc_id", "page_n", "obj", "width", "height", "w", "h", "grey", "error"]
        for b in batches:
            for d, c in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist()):
                try:
                    rows = thumbs_of(c, limit) if c and b"%PDF" in c[:1024] and b"/Encrypt" not in c else []
                except Exception:
                    rows = []
                yield pa.RecordBatch.from_arrays([pa.array([d if k == "doc_id" else r[k] for r in rows], t) for k, t in zip(names, kinds)], names)

    return files.select("doc_id", "content").mapInArrow(run, schema)


def pgm(w: int, h: int, grey: bytes) -> bytes:
    """A grey picture as a file."""
    return b"P5\n%d %d\n255\n" % (w, h) + grey
