"""Vector best-fit packing of token pieces into sequences (operator 4).

A piece is a vector: its tokens, one document, and its attention cost (tokens squared). A sequence has a capacity in
each. Pieces are placed longest first. Among the open sequences with room under every constraint, the one is taken
that scores best: for "norm" the smallest weighted squared norm of what would remain, for "dot" the largest weighted
dot product of piece and residual; ties go to the fuller one, then the older one.

At scale. Vectors depend on the length alone, so the rule is run on the histogram of lengths, at most `capacity`
rows whatever the corpus: sequences of the same content form one group with a multiplicity, and a step places a
whole run of equal pieces in a whole group. Only this histogram reaches the driver and only the plan, bounded in the
same way, goes back. A piece's rank among those of its length, counted in salted parts, says which of the plan's
places is its own. No task holds all pieces of a length and no document text is shuffled.

Cases. A null text is empty; an empty text is its end id alone. Repeated rows and doc_ids are packed once each.
Rows with a null doc_id are packed too. Extra columns are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.atoms import tokenizers_encoder
from pagewright.llm.common import Scratch, read, slices, texts_of


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds. max_docs and max_attention default to no further limit than that of its tokens."""

    tokens: int = 1024
    max_docs: int | None = None
    max_attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"

    @property
    def limits(self) -> tuple[int, int, int]:
        return self.tokens, self.max_docs or self.tokens, self.max_attention or self.tokens**2


def plan(histogram: dict[int, int], cap: Capacity) -> dict[int, list[tuple[int, int, int, int]]]:
    """histogram: pieces by length -> by length, (first rank, copies, first sequence, offset) runs.

    A run says that the pieces of ranks first rank .. + copies - 1 lie in the sequences first sequence .., each at
    the offset. Runs of a length are in order of rank and cover all of its pieces.
    """
    tokens, docs, attention = cap.limits
    wt = [w / (limit * limit) for w, limit in zip(cap.weights, (tokens, docs, attention))]
    groups: list[list[int]] = []  # open: [residual tokens, documents, attention, copies, first sequence]
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    opened = 0
    for size in sorted(histogram, reverse=True):
        left, rank, out = histogram[size], 0, []
        if size > tokens or size * size > attention:
            raise ValueError(f"a piece of {size} tokens fits no sequence")
        while left:
            best, score = None, None
            for g in groups:
                a, d, q = g[0] - size, g[1] - 1, g[2] - size * size
                if a < 0 or d < 0 or q < 0:
                    continue
                if cap.rule == "norm":
                    s = wt[0] * a * a + wt[1] * d * d + wt[2] * q * q
                else:
                    s = -(wt[0] * size * g[0] + wt[1] * g[1] + wt[2] * size * size * g[2])
                if score is None or (s, a, g[4]) < score:
                    best, score = g, (s, a, g[4])
            if best is None:  # as many new sequences as are filled with this length alone
                fit = max(1, min(tokens // size, docs, attention // (size * size)))
                n = max(1, left // fit)
                best = [tokens, docs, attention, n, opened]
                opened += n
                groups.append(best)
            n = min(left, best[3])
            if n < best[3]:  # the rest of the group stays as it is
                groups.append([best[0], best[1], best[2], best[3] - n, best[4] + n])
                best[3] = n
            out.append((rank, n, best[4], tokens - best[0]))
            best[0], best[1], best[2] = best[0] - size, best[1] - 1, best[2] - size * size
            if not best[0] or not best[1]:
                groups = [g for g in groups if g is not best]
            rank, left = rank + n, left - n
        runs[size] = out
    return runs


def pieces(docs: DataFrame, tokenizer: str, end_id: int, tokens: int) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, piece, start, length, ids_crc32), a row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = tokenizers_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in slices(batches, 1000):
            ids, at = coder.encode_batch(texts_of(b))
            raw, rows = memoryview(ids.tobytes()), []
            for doc, lo, hi in zip(b.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                n = hi - lo + 1
                first = (n - 1) % tokens + 1
                for piece, start in enumerate([0, *range(first, n, tokens)]):
                    stop = start + tokens if piece else first
                    crc = zlib.crc32(raw[4 * (lo + start) : 4 * min(lo + stop, hi)])
                    rows.append((doc, piece, start, stop - start, zlib.crc32(end, crc) if stop == n else crc))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, cap: Capacity = Capacity(), rows_a_part: int = 50_000) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    scratch = Scratch(docs.sparkSession)
    cut = scratch.table(pieces(docs, tokenizer, end_id, cap.tokens))
    counts = cut.groupBy("length").count().collect()  # at most cap.tokens rows
    placed = plan({r[0]: r[1] for r in counts}, cap)
    firsts = {size: [r[0] for r in runs] for size, runs in placed.items()}
    parts = max(8, -(-sum(r[1] for r in counts) // rows_a_part))
    row = ["doc_id", "piece", "start", "ids_crc32"]
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sizes = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    sizes = scratch.table(sizes.select(F.col("length").alias("l"), F.col("part").alias("p"), before.alias("before")))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy(*row)) - 1
    ranked = cut.withColumn("within", within).join(F.broadcast(sizes) if parts <= 64 else sizes, (F.col("length") == F.col("l")) & (F.col("part") == F.col("p")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, off = [], []
            for size, rank in zip(b.column("length").to_pylist(), b.column("rank").to_pylist()):
                first, _, sequence, offset = placed[size][bisect_right(firsts[size], rank) - 1]
                seq.append(sequence + rank - first)
                off.append(offset)
            kept = [b.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(seq, pa.int64()), pa.array(off, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return pack(read(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))
