"""Fuzzy line deduplication by MinHash (operator 9).

Every line that isn't blank is stripped and named by 128 bits of hash. Distinct lines get 32 minima over their
9-character shingles in 8 bands of 4: lines of Jaccard likeness 0.8 share a band with a chance of 0.985. Candidate
pairs are verified on the exact shingle sets; verified links are closed by distributed union-find; the first line of
each component, by document and place, stays.

Full bands. The lines of a bucket are not paired out. Its leader, the line of smallest hash, is verified against its
other lines (lines of one passage mostly have one leader in all of their buckets), and links are closed. Where lines
of a leader are still in several components, those outside the largest are compared with the lines of other
components by matrix products over the shingles that two of the lines or more have: no pair is a row, and every
candidate pair that could still join two components is compared exactly. A task returns a spanning forest of the links
that it finds, by its own union-find, so fewer than the components it meets. The lines of a leader are one row each, up to
BLOCK lines and CHARS characters. More than these are dealt into blocks of that size, by their likeness to the leader
first; Jaccard distance is a metric, so blocks of lines whose distances to the leader differ by more than 1 - LIKENESS
hold no link and are left out. A line goes once to each block that it meets, with all others of its block.

Cases. A null text is empty. Blank lines stay. A line shorter than a shingle is one shingle, so it matches itself
alone. Rows of the same id and text are one document: they keep the same lines. Null ids come first. Other columns
are carried through unchanged; n_chars, where `deduplicated` is asked for it, is counted anew. A document that
loses all lines stays, with an empty text. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pagewright.llm.common import Scratch, drop_caches, read, slices, texts_of
from pagewright.llm.components import components, find

SHINGLE, BANDS, ROWS, LIKENESS = 9, 8, 4, 0.8
STEP, BLOCK, CHARS, BINS = 1 << 16, 1024, 1 << 20, 20
#: bits of the fixed-size filter by which a task leaves out lines whose text nobody asks for; a full one lets all through
FILTER = 1 << 22
_RNG = np.random.default_rng(20)
#: h -> a h + b modulo 2^32, a odd: one permutation of the upper half of shingle values for each minimum
_A = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_POWERS = [np.uint64(pow(0x100000001B3, k, 1 << 64)) for k in range(SHINGLE)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_values(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit values of all lines' shingles one after another, where each line's start); no line is empty."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    padded = np.concatenate([codes, np.zeros(SHINGLE, np.uint64)])
    rolled, width = padded, 1
    while 2 * width <= SHINGLE:  # of 1, 2, 4 .. codes
        rolled = rolled[: len(rolled) - width] + rolled[width:] * _POWERS[width]
        width *= 2
    rolled = rolled[: len(codes)].copy()
    for k in range(width, SHINGLE):
        rolled += padded[k : k + len(codes)] * _POWERS[k]
    begin, n = np.cumsum(size) - size, np.maximum(1, size - SHINGLE + 1)
    starts = np.cumsum(n) - n
    values = rolled[np.repeat(begin - starts, n) + np.arange(int(n.sum()))]
    for k in np.flatnonzero(size < SHINGLE).tolist():
        values[starts[k]] = xxhash.xxh3_64_intdigest(lines[k].encode("utf-8", "surrogatepass"))
    return _mix(values), starts


def band_keys(lines: list[str]) -> np.ndarray:
    """lines x BANDS keys (signed 64-bit)."""
    least = np.empty((BANDS * ROWS, len(lines)), np.uint64)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    cut = np.flatnonzero(np.diff(np.concatenate([[-1], np.cumsum(size) // STEP])))  # lines in runs of about STEP characters
    for lo, hi in zip(cut, [*cut[1:], len(lines)]):
        values, starts = shingle_values(lines[lo:hi])
        upper = (values >> np.uint64(32)).astype(np.uint32)
        h = np.empty_like(upper)
        for k in range(BANDS * ROWS):
            np.multiply(upper, _A[k], out=h)
            np.add(h, _B[k], out=h)
            least[k, lo:hi] = np.minimum.reduceat(h, starts)
    out = np.empty((len(lines), BANDS), np.int64)
    for band in range(BANDS):
        key = np.full(len(lines), (band + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = _mix(key ^ least[k])
        out[:, band] = key.view(np.int64)
    return out


def likenesses(xs: list[str], ys: list[str]) -> np.ndarray:
    """Jaccard likeness of the shingle sets of each pair of lines, of STEP characters and a line at a time."""
    out, lo, held = np.empty(len(xs)), 0, 0
    for hi, (x, y) in enumerate(zip(xs, ys), 1):
        held += len(x) + len(y)
        if held >= 4 * STEP or hi - lo == 4096 or hi == len(xs):
            a, b = _distinct(xs[lo:hi]), _distinct(ys[lo:hi])
            both = np.concatenate([a, b])
            both.sort()
            n, m, common = (np.bincount((k >> np.uint64(52)).astype(np.int64), minlength=hi - lo) for k in (a, b, both[1:][both[1:] == both[:-1]]))
            out[lo:hi] = common / (n + m - common)
            lo, held = hi, 0
    return out


def _distinct(lines: list[str]) -> np.ndarray:
    """The distinct shingles of up to 4096 lines: a line's place in 12 bits above 52 bits of hash, ascending."""
    values, starts = shingle_values(lines)
    owner = np.repeat(np.arange(len(lines), dtype=np.uint64), np.diff(np.append(starts, len(values))))
    key = owner << np.uint64(52) | values >> np.uint64(12)
    key.sort()
    return key[np.concatenate([[True], key[1:] != key[:-1]])]


def jaccard(a: str, b: str) -> float:
    return float(likenesses([a], [b])[0])


def _name(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def _identity(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, key, place, line binary, bands): bands where the task meets the line for the first time, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        seen: set[bytes] = set()
        for b in slices(batches):
            place, name, new, at, count = [], [], [], [], []
            for t in texts_of(b):
                before = len(name)
                for p, line in enumerate(t.split("\n")):
                    line = line.strip()
                    if line:
                        h = _name(line)
                        place.append(p)
                        if h not in seen:
                            if len(seen) > 100_000:
                                seen.clear()
                            seen.add(h)
                            at.append(len(name))
                            new.append(line)
                        name.append(h)
                count.append(len(name) - before)
            has = np.zeros(len(name), bool)
            has[at] = True
            ends = np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)
            keys = pa.array(band_keys(new).ravel() if new else np.zeros(0, np.int64))
            bands = pa.ListArray.from_arrays(pa.array(ends), keys, mask=pa.array(~has))
            own = pa.array(np.repeat(np.arange(b.num_rows), count))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(own), b.column("key").take(own), pa.array(place, pa.int32()), pa.array(name, pa.binary()), bands], ["doc_id", "key", "place", "line", "bands"]
            )

    return _identity(docs).mapInArrow(run, "doc_id long, key long, place int, line binary, bands array<long>")


def name_filter(wanted: DataFrame) -> np.ndarray:
    """FILTER bits, those set whose number starts the name of a wanted line; FILTER / 64 rows at most reach the driver."""
    place = F.shiftright(F.conv(F.hex(F.substring("line", 1, 3)), 16, 10).cast("long"), 2)
    words = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    out = np.zeros(FILTER // 64, np.int64)
    for r in words.collect():
        out[r["w"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def texts_of_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (line) -> (line, body), a row each."""
    asked = docs.sparkSession.sparkContext.broadcast(np.packbits(name_filter(wanted)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        bits = asked.value
        for b in slices(batches):
            name, body = [], []
            for t in texts_of(b):
                for line in t.split("\n"):
                    line = line.strip()
                    if line:
                        h = _name(line)
                        at = (h[0] << 16 | h[1] << 8 | h[2]) >> 2
                        if bits[at >> 3] >> (7 - (at & 7)) & 1 and h not in seen:
                            if len(seen) > 100_000:
                                seen.clear()
                            seen.add(h)
                            name.append(h)
                            body.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.binary()), pa.array(body, pa.string())], ["line", "body"])

    found = docs.select("text").mapInArrow(run, "line binary, body string").join(wanted, "line", "left_semi")
    return found.groupBy("line").agg(F.first("body").alias("body"))


def compared(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """pairs (l, line) of lines -> (l, line, j, lm, m): their likeness and their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            xs, ys = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            cols = [pa.array(likenesses(xs, ys), pa.float64()), pa.array(map(len, xs), pa.int64()), pa.array(map(len, ys), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("l"), batch.column("line"), *cols], ["l", "line", "j", "lm", "m"])

    x, y = (bodies.select(F.col("line").alias(p), F.col("body").alias(q)) for p, q in (("l", "x"), ("line", "y")))
    return pairs.join(x, "l").join(y, "line").select("l", "line", "x", "y").mapInArrow(run, "l binary, line binary, j double, lm long, m long")


def _common(values: list[np.ndarray], outside: np.ndarray) -> np.ndarray:
    """Shingles that each line outside shares with each line; values: the distinct shingles of each line."""
    size = np.array([len(v) for v in values])
    _, ids, times = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    ids, owner = ids.reshape(-1), np.repeat(np.arange(len(values)), size)
    out = np.zeros((int(outside.sum()), len(values)), np.float32)
    both = times[ids] > 1  # what a line has alone, it shares with itself only
    if not both.all():
        alone = np.bincount(owner[~both], minlength=len(values))
        out[np.arange(len(out)), np.flatnonzero(outside)] = alone[outside]
        ids, owner = (np.cumsum(times > 1) - 1)[ids[both]], owner[both]
    order, step = np.argsort(ids, kind="stable"), 1 << 11
    ids, owner = ids[order], owner[order]
    for lo in range(0, int(ids[-1]) + 1 if len(ids) else 0, step):  # a matrix of a block's lines x step shingles at a time
        a, b = np.searchsorted(ids, (lo, lo + step))
        m = np.zeros((len(values), step), np.float32)
        m[owner[a:b], ids[a:b] - lo] = 1
        out += m[outside] @ m.T
    return out


def block_links(rows: list[tuple], values: list[np.ndarray], root: dict | None = None) -> list[tuple]:
    """rows (line, component, outside) of one block pair, their distinct shingles -> links of lines outside that join their components.

    root: the union-find of the components that links found before have joined; a link that joins nothing new isn't made.
    """
    root = {} if root is None else root
    size, outside = np.array([len(v) for v in values], np.float64), np.array([r[2] for r in rows])
    common = _common(values, outside)
    least = (LIKENESS - 1e-7) / (1 + LIKENESS - 1e-7)  # of the sum of both sizes
    alike = common >= least * (size[outside][:, None] + size[None])
    number: dict = {}
    own, out = np.array([number.setdefault(r[1], len(number)) for r in rows]), []
    for x, near in zip(np.flatnonzero(outside).tolist(), alike):
        there = np.flatnonzero(near & (own != own[x]))
        for y in there[np.unique(own[there], return_index=True)[1]].tolist():  # one of each component
            p, q = find(root, rows[x][1]), find(root, rows[y][1])
            if p != q:
                root[p] = q
                out.append((rows[x][0], rows[y][0]))
    return out


def values_of(lines: list[str]) -> list[np.ndarray]:
    """The distinct shingles of each of up to 4096 lines."""
    keys = _distinct(lines)
    return np.split(keys & np.uint64((1 << 52) - 1), np.searchsorted(keys, np.arange(1, len(lines), dtype=np.uint64) << np.uint64(52)))


def _block_pairs(held: list[tuple], shingles: Callable[[list], list[np.ndarray]], root: dict | None = None) -> list[tuple]:
    """held (t, line, component, outside, body), rows of a block pair t one after another -> its links, as of `block_links`."""
    root = {} if root is None else root
    out, values = [], []
    for lo in range(0, len(held), 4096):
        values += shingles([r[4] for r in held[lo : lo + 4096]])
    lo = 0
    for hi in range(1, len(held) + 1):
        if hi == len(held) or held[hi][0] != held[lo][0]:
            out += block_links([r[1:4] for r in held[lo:hi]], values[lo:hi], root)
            lo = hi
    return out


def unsettled(state: DataFrame) -> DataFrame:
    """state (l, line, m: length, component c, ..) -> the rows of leaders with several components, and n, w (lines of l and
    their length) and outside (of the largest component)."""
    sizes = state.groupBy("l", "c").agg(F.count("*").alias("n"), F.sum("m").alias("w"))
    top = F.max_by("c", F.struct("n", "c")).alias("top")
    several = sizes.groupBy(F.col("l").alias("k")).agg(top, F.count("*").alias("cs"), F.sum("n").alias("n"), F.sum("w").alias("w")).where("cs > 1").select("k", "top", "n", "w")
    return state.join(several, F.col("l") == F.col("k")).select(*state.columns, "n", "w", (F.col("c") != F.col("top")).alias("outside"))


def blocks(groups: DataFrame, bodies: DataFrame, bins: Column | None = None, reach: int = round((1 - LIKENESS) * BINS) + 1, shingles: Callable = values_of, scratch: Scratch | None = None) -> DataFrame:
    """groups, as from `unsettled`, bodies (line, body) -> links (a, b) of lines outside; those of a task make no cycle of components.

    The lines of a leader that has more than a block of them are dealt into bins, by their likeness j to it if nothing else
    is given, and these into blocks; lines of bins further apart than reach can't be alike. scratch: where the parts that
    several joins read are written, else each join plans them again.
    """
    keep = scratch.table if scratch else lambda df: df
    full = (F.col("n") > BLOCK) | (F.col("w") > CHARS)
    bins = F.floor(F.col("j") * BINS) if bins is None else bins
    g = groups.withColumn("bin", F.when(full, bins.cast("int")).otherwise(0)).withColumn("h", F.xxhash64("line"))
    k = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / CHARS))
    size = keep(g.groupBy("l", "bin").agg(k(F.count_if("outside"), F.sum(F.expr("if(outside, m, 0)"))).alias("kx"), k(F.count("*"), F.sum("m")).alias("ky")))
    at = g.join(size.withColumnsRenamed({"l": "l2", "bin": "bin2"}), (F.col("l") == F.col("l2")) & (F.col("bin") == F.col("bin2")))
    at = keep(at.select("l", "bin", "line", "c", "outside", F.expr("if(outside, pmod(h, kx), null)").alias("bx"), F.pmod("h", "ky").alias("by")))
    x, y = size.where("kx > 0").select("l", F.col("bin").alias("xb"), "kx"), size.select(F.col("l").alias("l2"), F.col("bin").alias("yb"), "ky")
    near = F.abs(F.col("xb") - F.col("yb")) <= reach
    grid = x.join(y, (F.col("l") == F.col("l2")) & near).withColumn("xk", F.explode(F.sequence(F.lit(0), F.col("kx") - 1))).withColumn("yk", F.explode(F.sequence(F.lit(0), F.col("ky") - 1)))
    grid = keep(grid.select(F.col("l").alias("gl"), "xb", "yb", "xk", "yk", F.xxhash64("l", "xb", "yb", "xk", "yk").alias("t")))
    left = at.where("outside").join(grid, (F.col("l") == F.col("gl")) & (F.col("bin") == F.col("xb")) & (F.col("bx") == F.col("xk")))
    right = at.join(grid, (F.col("l") == F.col("gl")) & (F.col("bin") == F.col("yb")) & (F.col("by") == F.col("yk")))
    both = left.select("t", "line", "c", F.lit(True).alias("outside")).union(right.select("t", "line", "c", F.lit(False).alias("outside")))
    both = both.groupBy("t", "line", "c").agg(F.bool_or("outside").alias("outside"))

    name = groups.schema["line"].dataType.simpleString()
    kind = pa.int64() if name == "bigint" else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        root: dict = {}
        chars = 0
        for b in slices(batches, 1024):
            for row in zip(*(b.column(k).to_pylist() for k in ("t", "line", "c", "outside", "body"))):
                if (len(held) >= 2048 or chars >= 16 * STEP) and row[0] != held[-1][0]:
                    yield _pairs(_block_pairs(held, shingles, root), kind)
                    held.clear()
                    chars = 0
                    if len(root) > 100_000:
                        root.clear()
                held.append(row)
                chars += len(row[4])
        yield _pairs(_block_pairs(held, shingles, root), kind)

    rows = both.join(bodies, "line").repartition("t").sortWithinPartitions("t").select("t", "line", "c", "outside", "body")
    return rows.mapInArrow(run, f"a {name}, b {name}")


def _pairs(pairs: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kind) for k in (0, 1)], ["a", "b"])


def links(scratch: Scratch, docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """distinct (line, bands) -> (node, component) over the lines that are linked to another line."""
    # buckets hold 64-bit hashes of the lines' names; two names of one hash only give a pair more to compare
    keyed = distinct.select(F.xxhash64("line").alias("h"), F.explode("bands").alias("bucket"))
    leaders = keyed.groupBy("bucket").agg(F.min("h").alias("lead"), F.count("*").alias("n")).where("n > 1").select(F.col("bucket").alias("k"), "lead")
    star = scratch.table(keyed.join(leaders, F.col("bucket") == F.col("k")).where("h <> lead").select("lead", "h").distinct())
    pairs = star
    named = distinct.select("line", F.xxhash64("line").alias("h")).join(star.select("h").union(star.select("lead")).distinct(), "h", "left_semi")
    named = scratch.table(named)
    bodies = scratch.table(texts_of_lines(docs, named.select("line")))
    star = star.join(named, "h").select("lead", "line").join(named.select(F.col("h").alias("lead"), F.col("line").alias("l")), "lead").select("l", "line")
    star = scratch.table(compared(star, bodies))
    scratch.drop(pairs, named)
    alike = star.where(F.col("j") >= LIKENESS - 1e-12).select(F.col("l").alias("a"), F.col("line").alias("b"))
    comp = components(scratch, alike)
    all_of = star.select("l", "line", "j", "m").union(star.select("l", F.col("l").alias("line"), F.lit(1.0).alias("j"), F.col("lm").alias("m")).distinct())
    state = scratch.table(all_of.join(comp, F.col("line") == F.col("node"), "left").select("l", "line", "j", "m", F.coalesce("component", "line").alias("c")))
    groups = scratch.table(unsettled(state))
    if groups.isEmpty():
        scratch.drop(star, bodies, state, groups)
        return comp
    more = scratch.table(blocks(groups, bodies, scratch=scratch))
    out = components(scratch, comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    scratch.drop(star, bodies, state, groups, more)
    return out


def kept_lines(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(doc_id, key, places array<int>): the places of the lines that stay, in documents that keep one."""
    at = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("o"), "doc_id", "key", "place")
    seen = occurrences(docs).groupBy("line").agg(F.min(at).alias("at"), F.max("bands").alias("bands"))
    distinct = scratch.table(seen)
    comp = links(scratch, docs, distinct.select("line", "bands"))
    rows = distinct.join(comp, F.col("line") == F.col("node"), "left").select(F.coalesce("component", "line").alias("c"), "at")
    first = rows.groupBy("c").agg(F.min("at").alias("at")).select("at.doc_id", "at.key", "at.place")
    out = scratch.table(first.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("place")).alias("places")))
    scratch.drop(distinct)
    return out


def deduplicated(docs: DataFrame, recount: str | None = None) -> DataFrame:
    """docs with the lines that stay in column text, and _n_lines and _n_dropped (of lines that aren't blank) added."""
    scratch = Scratch(docs.sparkSession)
    kept = kept_lines(scratch, docs).select(F.col("doc_id").alias("_k_doc"), F.col("key").alias("_k_key"), F.col("places").alias("_k_places"))
    schema = StructType([*docs.schema.fields, StructField("_n_lines", LongType()), StructField("_n_dropped", LongType())])
    names = docs.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, n, dropped, chars = [], [], [], []
            for t, places in zip(b.column("text").to_numpy(zero_copy_only=False).tolist(), b.column("_k_places").to_pylist()):
                stay, lines = set(places or ()), (t or "").split("\n")
                full = [bool(x.strip()) for x in lines]
                texts.append(None if t is None else "\n".join(x for p, x in enumerate(lines) if p in stay or not full[p]) if len(stay) else "")
                n.append(sum(full))
                dropped.append(sum(full) - len(stay))
                chars.append(len(texts[-1] or ""))
            cols = [pa.array(texts, pa.string()) if k == "text" else pa.array(chars, pa.int64()).cast(b.column(k).type) if k == recount else b.column(k) for k in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], [*names, "_n_lines", "_n_dropped"])

    own = docs.withColumn("_k_own", F.xxhash64("text"))
    on = (F.col("_k_own") == F.col("_k_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_k_doc"))
    return own.join(kept, on, "left").select(*names, "_k_places").mapInArrow(run, schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))
