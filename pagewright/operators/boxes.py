"""Boxes of many pages at once: touching boxes and runs of letters over whole arrays, and the pass that feeds them.

`by_page` deals rows by page and hands a function the whole pages of one Arrow batch after the other, so a page costs
its rows and not a call of its own. Neighbours come from a sort; every pair that the sort can't rule out is tested.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PAIRS = 1 << 21  # tested at once


def whole_pages(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables of whole pages, from batches in which the rows of a page follow each other."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = [np.asarray(b.column(c)) for c in keys]
        new = np.zeros(max(0, b.num_rows - 1), bool)
        for v in k:
            new |= v[1:] != v[:-1]
        at = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
        first, end = tuple(v[0] for v in k), tuple(v[-1] for v in k)
        if at or (held and first != last):
            if at or held:
                yield pa.Table.from_batches([*held, b.slice(0, at)], b.schema).combine_chunks()
            held = []
        held.append(b.slice(at))
        last = end
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def by_page(df: DataFrame, keys: list[str], run: Callable[[pa.Table], pa.Table], schema: str, dealt: bool = False) -> DataFrame:
    """df's pages, whole, through run: several pages a call, rows of a page in any order. dealt: the rows of a page follow
    each other already, as they do after a window by page."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_pages(batches, *keys):
            yield from run(t).combine_chunks().to_batches()

    return (df if dealt else df.repartition(*keys).sortWithinPartitions(*keys)).mapInArrow(each, schema)


def in_order(t: pa.Table, *keys: str) -> tuple[pa.Table, np.ndarray]:
    """(the rows by keys, of which the last is a row's place in its page; the page's number of each row)."""
    cols = [np.asarray(t[k]) for k in keys]
    order = np.lexsort(cols[::-1])
    new = np.zeros(len(order), np.int64)
    for c in cols[:-1]:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return t.take(pa.array(order)), np.cumsum(new)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number of each one's component over the links a - b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


def _keys(page: np.ndarray, low: float, high: float) -> tuple[Callable[[np.ndarray, np.ndarray], np.ndarray], float]:
    """(a number that rises with page and value, its slack): a search by it with the slack misses nothing."""
    span = high - low + 2.0
    return (lambda p, v: p * span + (v - low)), 16 * np.spacing(float(page.max(initial=0) + 2) * span)


def _ahead(page: np.ndarray, lo: np.ndarray, hi: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(boxes by page and lower edge, how many after each begin before its upper edge)."""
    order = np.lexsort((lo, page))
    key, eps = _keys(page, float(lo.min()), float(max(hi.max(), lo.max())) + slack)
    p, end = page[order], key(page[order], hi[order] + slack) + eps
    return order, np.maximum(np.searchsorted(key(p, lo[order]), end, "right") - np.arange(1, len(order) + 1), 0)


def touching(page: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, alone: np.ndarray, slack: float) -> np.ndarray:
    """The smallest place of each box's component; boxes of a page touch when they overlap with slack in all."""
    live = np.flatnonzero(~alone)
    if len(live) < 2:
        return np.arange(len(x0))
    p, a0, b0, a1, b1 = (v[live] for v in (page, x0, y0, x1, y1))
    ways = [_ahead(p, a0, a1, slack), _ahead(p, b0, b1, slack)]
    each = [np.bincount(p[o], n, int(p.max()) + 1) for o, n in ways]
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for k, (order, n) in enumerate(ways):  # each page by the direction in which fewer boxes lie side by side
        n = np.where((each[k] < each[1 - k])[p[order]] if k else (each[0] <= each[1])[p[order]], n, 0)
        ends = np.cumsum(n)
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            some = n[at:to]
            if total := int(some.sum()):
                i = np.repeat(np.arange(at, to), some)
                j = order[i + 1 + np.arange(total) - np.repeat(np.cumsum(some) - some, some)]
                i = order[i]
                met = (p[i] == p[j]) & (a0[j] <= a1[i] + slack) & (a0[i] <= a1[j] + slack) & (b0[j] <= b1[i] + slack) & (b0[i] <= b1[j] + slack)
                links.append((live[i[met]], live[j[met]]))
            at = to
    return components(len(x0), *(np.concatenate([x[k] for x in links]) if links else np.zeros(0, np.int64) for k in (0, 1)))


def run_lengths(page: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """G10 over pages: the length of each letter's run. A letter names the nearest fit letter to its right, of all that
    begin within its reach; the first to name one has it."""
    n, h = len(x0), y1 - y0
    if not n:
        return np.zeros(0, np.int64)
    order = np.lexsort((np.arange(n), x0, page))
    start, end = x1 - 0.25 * h, x1 + h
    key, eps = _keys(page, float(min(x0.min(), start.min())), float(max(x0.max(), end.max())))
    ks = key(page[order], x0[order])
    at = np.searchsorted(ks, key(page, np.maximum(start, x0)) - eps, "left")
    to = np.searchsorted(ks, key(page, end) + eps, "right")
    best, left, wide = np.full(n, -1), np.flatnonzero(at < to), 4
    while len(left):
        seen = at[left, None] + np.arange(wide)
        j, i = order[np.minimum(seen, n - 1)], left[:, None]
        over = np.minimum(y1[i], y1[j]) - np.maximum(y0[i], y0[j])
        fit = (seen < to[i]) & (page[j] == page[i]) & (x0[j] > x0[i]) & (x0[j] >= start[i]) & (x0[j] <= end[i])
        fit &= (0.4 * h[i] <= h[j]) & (h[j] <= 2.5 * h[i]) & (over >= 0.5 * np.minimum(h[i], h[j]))
        found = fit.any(1)
        best[left[found]] = j[found, fit[found].argmax(1)]
        at[left] += wide
        left = left[~found & (at[left] < to[left])]
        wide = max(4, min(4096, PAIRS // 16 // max(1, len(left))))
    named = np.flatnonzero(best >= 0)
    nexts, first = np.unique(best[named], return_index=True)
    head = np.arange(n)
    head[nexts] = named[first]
    while (up := head[head]).tobytes() != head.tobytes():
        head = up
    return np.bincount(head, minlength=n)[head]
