"""Column expressions of page geometry: rounding, ramps, boxes, matrices. ANSI mode: callers guard empty boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def r1(v: Column) -> Column:
    """Rounded to a tenth, half away from zero."""
    return F.signum(v) * F.floor(F.abs(v) * 10 + 0.5) / 10


def ramp(x: Column, lo: float, hi: float) -> Column:
    """0 at lo, 1 at hi, straight between; falls if hi < lo."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - float(lo)) / F.lit(float(hi - lo))))


def factor(s: Column, floor: float) -> Column:
    return floor + (1 - floor) * s


def overlap(a: Box, b: Box) -> Column:
    """Shared area of two boxes."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def dist(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(x1 - x0, y1 - y0)


def applied(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a matrix (array of six)."""
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def on_page(x0: Column, y0: Column, x1: Column, y1: Column, rotate: Column, width: float, height: float) -> Column:
    """A user-space box (y up) as a struct on the displayed page, for an unrotated page of width x height."""
    cases = {0: (x0, height - y1, x1, height - y0), 90: (y0, x0, y1, x1), 180: (width - x1, y0, width - x0, y1), 270: (height - y1, width - x1, height - y0, width - x0)}
    out = None
    for angle, box in cases.items():
        s = F.struct(*(c.cast("double").alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"))))
        out = F.when(rotate == angle, s) if out is None else out.when(rotate == angle, s)
    return out


def cubic_range(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """The extent of a cubic in one direction, through its real extrema."""
    qa, qb, qc = d - 3 * c + 3 * b - a, c - 2 * b + a, b - a
    root = F.sqrt(F.greatest(F.lit(0.0), qb * qb - qa * qc))
    none, flat = qb * qb - qa * qc < 0, F.abs(qa) < 1e-9
    line = F.when(F.abs(qb) < 1e-9, -1.0).otherwise(F.try_divide(-qc, 2 * qb))
    t1 = F.when(flat, line).when(none, -1.0).otherwise(F.try_divide(-qb + root, qa))
    t2 = F.when(flat | none, -1.0).otherwise(F.try_divide(-qb - root, qa))
    at = lambda t: F.when((t > 0) & (t < 1), (1 - t) * (1 - t) * (1 - t) * a + 3 * (1 - t) * (1 - t) * t * b + 3 * (1 - t) * t * t * c + t * t * t * d).otherwise(a)
    return F.least(a, d, at(t1), at(t2)), F.greatest(a, d, at(t1), at(t2))
