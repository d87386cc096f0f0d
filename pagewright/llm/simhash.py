"""SimHash near-duplicates by covering locality-sensitive hashing (operator 1).

Tables. The 64 bit positions are dealt to the nonzero vectors of GF(2)^(r+1). Table v (another nonzero vector)
keeps the positions whose vector has inner product 1 with v. Two fingerprints that differ at no more than r
positions differ in at most r vectors; these do not span the space, so some v is orthogonal to all of them, and
in that table the pair has the same key. With r = 2 there are 7 tables of 36 or 37 bits each.

Linking inside a bucket. Fingerprints x and y differ at 2 or fewer bits exactly if some z differs from each at
1 or none. So each member of a shared bucket names itself and its one-bit changes at the positions that the
table leaves out, and those that name the same z are linked to the smallest of them: at most 65 distinct
fingerprints can, hence no bucket, however full, is paired out and no link is lost or made up.

Cases. A null or blank text has fingerprint zero and is linked like any other; one or two words are one shingle;
repeated documents share a fingerprint; repeated doc_ids each keep their row; rows with a null doc_id keep their
fingerprint and get their group's component, and do not name it (component_id is null if no row of it has an id).
`one_of_each` carries all other columns, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import Scratch, read, slices, texts_of
from pagewright.llm.components import components

BITS, SEED = 64, 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority bits of the XXH64 of every `words`-word shingle, repeats included; unsigned."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    line, n = b" ".join(w), max(1, len(w) - words + 1)
    size = np.fromiter(map(len, w), np.int64, len(w)) + 1
    ends = np.cumsum(size) - 1
    starts = (ends - size + 1)[:n].tolist()
    stops = ends[min(words, len(w)) - 1 :].tolist()
    total, one = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, 8192):  # a long text never holds more than this many rows of bits
        h = np.array([one(line[a:b], SEED) for a, b in zip(starts[k : k + 8192], stops[k : k + 8192])], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int) -> list[int]:
    """One mask of kept positions for each table."""
    m = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if bin((i % m + 1) & v).count("1") % 2) for v in range(1, m + 1)]


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id long, key long, fp long), a row for each row of docs; key: a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = [signed(fingerprint(t, words)) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(fp, pa.int64())], ["doc_id", "key", "fp"])

    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text")
    return docs.mapInArrow(run, "doc_id long, key long, fp long")


def links(scratch: Scratch, distinct: DataFrame, radius: int = 2) -> DataFrame:
    """distinct (fp, node), one row a fingerprint -> links (a, b) of nodes; their closure is that of all pairs within the radius."""
    if radius != 2:
        raise ValueError("the one-bit meeting points prove links for radius 2")
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(signed(m)).alias("mask")) for t, m in enumerate(masks(radius))]))
    keyed = distinct.select("fp", "node", table.alias("x")).select("fp", "node", "x.t", F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"))
    shared = scratch.table(
        keyed.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select(F.col("t").alias("t2"), F.col("key").alias("k2"))
    )
    free = F.element_at(
        F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks(radius)]), F.col("t") + 1
    )
    near = keyed.join(shared, (F.col("t") == F.col("t2")) & (F.col("key") == F.col("k2"))).select("fp", "node", F.explode(free).alias("bit"))
    meet = near.select(F.col("fp").bitwiseXOR(F.col("bit")).alias("z"), "node").distinct()
    met = meet.groupBy("z").agg(F.collect_set("node").alias("nodes")).where(F.size("nodes") > 1)  # 65 at most
    return met.select(F.array_min("nodes").alias("b"), F.explode("nodes").alias("a")).where("a <> b").distinct()


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, key, fp, fingerprint, component, component_id), a row for each row.

    key: a hash of the text; component: the smallest fingerprint reachable; component_id: the smallest doc_id.
    """
    scratch = Scratch(docs.sparkSession)
    fps = scratch.table(fingerprints(docs, words))
    distinct = scratch.table(fps.groupBy("fp").agg(F.min("doc_id").alias("d")))
    comp = components(scratch, links(scratch, distinct.select("fp", F.col("fp").alias("node")), radius))
    named = distinct.join(comp, distinct.fp == comp.node, "left").select(F.col("fp").alias("f"), F.coalesce("component", "fp").alias("component"), "d")
    named = scratch.table(named)
    least = scratch.table(named.groupBy(F.col("component").alias("c")).agg(F.min("d").alias("component_id")))
    named = scratch.table(named.join(least, F.col("component") == F.col("c")).select("f", "component", "component_id"))
    out = fps.join(named, fps.fp == named.f)
    return out.select("doc_id", "key", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component", "component_id")


def one_of_each(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """docs with all columns: of each component the first row by doc_id (null ids last) and text hash."""
    scratch = Scratch(docs.sparkSession)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")
    first = simhash_components(docs, words, radius).groupBy("component").agg(F.min(order).alias("o"))
    first = scratch.table(first.select(F.col("o.doc_id").alias("_f_doc"), F.col("o.key").alias("_f_key")))
    own = docs.withColumn("_f_own", F.xxhash64("text"))
    on = (F.col("_f_own") == F.col("_f_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_f_doc"))
    return own.join(first, on).dropDuplicates(["_f_doc", "_f_key"]).select(*docs.columns)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
