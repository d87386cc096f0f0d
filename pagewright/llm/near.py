"""Near copies of documents at a likeness of LIKENESS or more (near-dedup stage of the pipeline).

Likeness is the Jaccard likeness of the sets of five-word shingles. Documents of equal sets are one node.

SimHash. A node's fingerprint holds the majority bits of its shingles. Fingerprints that differ at two bits or fewer are
found by the covering tables and meeting points of `simhash`; their nodes are verified and linked by union-find.

Beyond two bits. Pairs of likeness 0.8 differ at 10 of 64 bits on average, up to 20, where no table's key is long enough
to select. So the components that SimHash leaves go on: a node has 125 minima over its shingles in 25 bands of 5; sets of
likeness 0.8 share no band with a chance of (1 - 0.8^5)^25, 5 in 100,000, and closer ones with less. Every pair of two
components that shares a band is a candidate, whatever its fingerprints' distance. All links are verified on the shingle
sets (64-bit hashes), so texts that are less alike are not linked by one.

Full buckets. As with lines, a bucket is not paired out at first. In LEADERS turns its leader, the node of smallest
hash in that turn, is verified against the nodes of other components, and links are closed by union-find; a group
mostly has the same leaders in all of its buckets. Where a bucket still has several components, the nodes of all buckets
of one leader are compared in the blocks of `lines`: those outside the largest component with all others, by matrix
products, so every candidate pair that could still join two components has been compared, and no pair is a row. Pairs
whose sizes alone rule out the likeness are not compared by leaders, nor by blocks of more than one.

Cases. Words are lower-cased runs of non-white-space. A null or blank text has no shingle; all of these are one
group. Fewer than five words are one shingle. Of each group the first row by doc_id (null ids last) and text hash
stays, with all its columns. An empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import lines, simhash
from pagewright.llm.common import Scratch, drop_caches, slices, texts_of
from pagewright.llm.components import components

WORDS, BANDS, ROWS, LIKENESS, LEADERS = 5, 25, 5, 0.8, 3
_RNG = np.random.default_rng(21)
_A = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(WORDS)]


def _mix(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = max(1, len(w) - WORDS + 1)
    out = np.full(n, min(len(w), WORDS), np.uint64)
    for k in range(min(len(w), WORDS)):
        out += h[k : k + n] * _POWERS[k]
    return np.unique(_mix(out))


def node(s: np.ndarray) -> int:
    x = xxhash.xxh3_64_intdigest(s.tobytes())
    return x - (1 << 64) if x >> 63 else x


def fingerprint(s: np.ndarray) -> int:
    """The bits that are set in over half of a set of shingles; signed."""
    total = np.zeros(simhash.BITS, np.int64)
    for k in range(0, len(s), 8192):
        total += np.unpackbits(s[k : k + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return simhash.signed(int.from_bytes(np.packbits(2 * total > len(s), bitorder="little").tobytes(), "little"))


def band_keys(s: np.ndarray) -> np.ndarray:
    """BANDS keys (signed 64-bit) of a set of shingles; none of an empty one."""
    if not len(s):
        return np.zeros(0, np.int64)
    upper = (s >> np.uint64(32)).astype(np.uint32)
    h, least = np.empty_like(upper), np.empty(BANDS * ROWS, np.uint64)
    for k in range(BANDS * ROWS):
        np.multiply(upper, _A[k], out=h)
        np.add(h, _B[k], out=h)
        least[k] = h.min()
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = _mix(key ^ least[k::ROWS])
    return key.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two ascending sets of distinct hashes; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(a) + len(b) - common)


def rows_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, key, node, n, fp, bands), a row for each row; key: a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for b in slices(batches):
            sets = [shingles(t) for t in texts_of(b)]
            cols = [pa.array([f(s) for s in sets], pa.int64()) for f in (node, len, fingerprint)] + [pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), *cols], ["doc_id", "key", "node", "n", "fp", "bands"])

    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text")
    return docs.mapInArrow(run, "doc_id long, key long, node long, n long, fp long, bands array<long>")


def sets_of(docs: DataFrame, carriers: DataFrame) -> DataFrame:
    """carriers (c_doc, c_key, node), a row for each node -> (node, body): the shingles of the row of that id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingles(t).tobytes() for t in texts_of(b)], pa.binary())], ["node", "body"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    on = (F.col("key") == F.col("c_key")) & F.col("doc_id").eqNullSafe(F.col("c_doc"))
    return own.join(carriers, on).dropDuplicates(["doc_id", "key"]).select("node", "text").mapInArrow(run, "node long, body binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) of nodes -> those of likeness LIKENESS or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, y = b.column("x").to_pylist(), b.column("y").to_pylist()
            kept = [jaccard(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) >= LIKENESS - 1e-12 for p, q in zip(x, y)]
            yield b.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    x, y = (sets.select(F.col("node").alias(p), F.col("body").alias(q)) for p, q in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def simhash_pairs(scratch: Scratch, distinct: DataFrame) -> DataFrame:
    """distinct (node, fp) -> (a, b): nodes of near fingerprints; their closure is that of all that differ at two bits or fewer."""
    first = scratch.table(distinct.groupBy("fp").agg(F.min("node").alias("node")))
    same = distinct.join(first.select(F.col("fp").alias("f"), F.col("node").alias("b")), F.col("fp") == F.col("f")).where("node <> b")
    return scratch.table(same.select(F.col("node").alias("a"), "b").union(simhash.links(scratch, first).select("a", "b")))


def shingles_of(bodies: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in bodies]


def block_links(scratch: Scratch, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """groups (l, node, n, c) -> links (a, b) between the components of each leader's nodes; bins are of equal size but for 0.8."""
    groups = scratch.table(lines.unsettled(groups.select("l", F.col("node").alias("line"), F.col("n").alias("m"), "c")))
    by_size = F.floor(F.log("m") / -math.log(LIKENESS))
    return lines.blocks(groups, sets.withColumnRenamed("node", "line"), by_size, 1, shingles_of, scratch)


def links(scratch: Scratch, docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """distinct (node, n, fp, bands, o: its first row) -> (node, component) over the nodes that are linked to another one."""
    close = simhash_pairs(scratch, distinct.select("node", "fp"))
    keyed = distinct.select("node", "n", F.explode("bands").alias("bucket"))
    shared = scratch.table(keyed.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select(F.col("bucket").alias("k")))
    members = scratch.table(keyed.join(shared, F.col("bucket") == F.col("k")).select("bucket", "node", "n"))
    wanted = members.select(F.col("node").alias("w")).union(close.select("a")).union(close.select("b")).distinct()
    carriers = distinct.join(wanted, F.col("node") == F.col("w")).select(F.col("o.doc_id").alias("c_doc"), F.col("o.key").alias("c_key"), "node")
    sets = scratch.table(sets_of(docs, carriers))
    found = scratch.table(verified(close, sets))
    comp = components(scratch, found)
    for turn in range(LEADERS + 1):
        state = members.join(comp.withColumnRenamed("node", "d"), F.col("node") == F.col("d"), "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("c"))
        state = table = scratch.table(state)
        # one row a bucket and component, then those of buckets with several
        several = state.select("bucket", "c").distinct().groupBy(F.col("bucket").alias("k")).agg(F.count("*").alias("m")).where("m > 1")
        several = scratch.table(several.select("k"))
        if several.limit(1).count() == 0:
            break
        state = state.join(several, F.col("bucket") == F.col("k")).select("bucket", "node", "n", "c")
        order = F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), "node", "n", "c")
        one = state.groupBy("bucket").agg(F.min(order).alias("o")).select(F.col("bucket").alias("k"), F.col("o.node").alias("l"), F.col("o.n").alias("ln"), F.col("o.c").alias("lc"))
        if turn < LEADERS:
            fits = F.least("n", "ln") >= (LIKENESS - 1e-9) * F.greatest("n", "ln")
            pairs = state.join(one, (F.col("bucket") == F.col("k")) & (F.col("c") != F.col("lc")) & fits)
            new = verified(pairs.select(F.least("node", "l").alias("a"), F.greatest("node", "l").alias("b")).distinct(), sets)
        else:
            groups = state.join(one.select("k", "l"), F.col("bucket") == F.col("k")).select("l", "node", "n", "c").distinct()
            new = block_links(scratch, scratch.table(groups), sets)
        new = scratch.table(new)
        found = scratch.table(found.union(new))
        comp = components(scratch, found)
        scratch.drop(table, several)
    scratch.drop(close, shared, members, sets)
    return comp


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with all columns: of each group the first row by doc_id (null ids last) and text hash."""
    scratch = Scratch(docs.sparkSession)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    distinct = scratch.table(rows_of(docs).groupBy("node").agg(F.max("n").alias("n"), F.max("fp").alias("fp"), F.max("bands").alias("bands"), F.min(order).alias("o")))
    comp = links(scratch, docs, distinct).withColumnRenamed("node", "d")
    first = distinct.join(comp, F.col("node") == F.col("d"), "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("o").alias("o"))
    first = scratch.table(first.select(F.col("o.doc_id").alias("_f_doc"), F.col("o.key").alias("_f_key")))
    scratch.drop(distinct)
    own = docs.withColumn("_f_own", F.xxhash64("text"))
    on = (F.col("_f_own") == F.col("_f_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_f_doc"))
    return own.join(first, on).dropDuplicates(["_f_doc", "_f_key"]).select(*docs.columns)
