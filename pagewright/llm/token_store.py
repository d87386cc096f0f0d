"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding (operator 6).

An id is written as its rank in the corpus (0: the most frequent; ties by id) in 1 to 4 bytes. Lengths stand apart
from data: one control byte holds four 2-bit lengths less one. A reader looks each control byte up in a table of
256 rows of lengths, sums them to places, and gathers the bytes of all values at once.

File (little-endian): b"PWIDS1\\0\\0", uint32 documents, uint64 ids, uint32 vocabulary; the ids of the ranks (uint32
each, those that occur); doc ids (int64, with one presence byte each); ids in each document (uint32); control bytes;
data bytes. A file stands alone. A dataset is a table of files (file int, body binary) in doc_id order: file k's
documents precede those of file k+1, so a document's global place is the ids of earlier files plus its place there.
Files are written by Spark's writer, one row each, so they reach any store that Spark can write.

Cases. A null text is empty; an empty document holds its end id alone. Documents with a null doc_id come first.
Repeated doc_ids stand next to each other, in the order of their ids' bytes. Extra columns are ignored. An empty
table gives no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.atoms import tokenizers_encoder
from pagewright.llm.common import Scratch, read, slices, texts_of

MOST_PARTS = 16384
MAGIC, HEAD = b"PWIDS1\0\0", struct.Struct("<8sIQI")
#: by control byte: the lengths of its four values
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def write_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    kept = np.arange(4) < size[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def read_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at, raw = np.cumsum(size) - size, np.frombuffer(data, np.uint8)
    out = np.zeros(n, "<u4")
    for k in range(4):
        has = np.flatnonzero(size > k)
        out[has] |= raw[at[has] + k].astype("<u4") << np.uint32(8 * k)
    return out


def write_file(doc_ids: list, counts: np.ndarray, ids: np.ndarray, order: np.ndarray) -> bytes:
    """order: the ids by rank."""
    rank = np.zeros(int(order.max(initial=0)) + 1, "<u4")
    rank[order] = np.arange(len(order), dtype="<u4")
    control, data = write_values(rank[ids])
    names = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is not None for d in doc_ids)
    head = HEAD.pack(MAGIC, len(doc_ids), len(ids), len(order))
    return b"".join([head, order.astype("<u4").tobytes(), names, np.asarray(counts, "<u4").tobytes(), control, data])


def read_file(body: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, ids in each document, all ids)."""
    magic, docs, n, vocabulary = HEAD.unpack_from(body)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, kind, count, at)
        at += out.nbytes
        return out

    order, names, there, counts = take("<u4", vocabulary), take("<i8", docs), take("u1", docs), take("<u4", docs)
    control = take("u1", -(-n // 4)).tobytes()
    ids = order[read_values(control, body[at:], n)] if n else np.zeros(0, "<u4")
    return [d if p else None for d, p in zip(names.tolist(), there.tolist())], counts, ids


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_tokens, ids binary: two bytes an id if all fit, else four)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizers_encoder(tokenizer)
        for b in slices(batches, 1000):
            ids, at = coder.encode_batch(texts_of(b))
            bodies, sizes = [], []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                own = np.append(ids[lo:hi], np.uint32(end_id))
                bodies.append(own.astype("<u2" if own.max() < 65536 else "<u4").tobytes())
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def _ids(body: bytes, n: int) -> np.ndarray:
    return np.frombuffer(body, "<u2" if len(body) == 2 * n else "<u4").astype("<u4")


def frequency_order(held: DataFrame) -> np.ndarray:
    """The ids that occur, most frequent first; bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in slices(batches, 1000):
            ids = np.concatenate([_ids(x, n) for x, n in zip(b.column("ids").to_pylist(), b.column("n_tokens").to_pylist())])
            got = np.bincount(ids, minlength=len(total))
            got[: len(total)] += total
            total = got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    rows = held.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))], "<u4")


def write_dataset(scratch: Scratch, docs: DataFrame, tokenizer: str, end_id: int, ids_a_file: int = 1 << 22) -> DataFrame:
    """The dataset's table of files: (part int, piece int, body binary). Over MOST_PARTS parts, parts get more files."""
    held = scratch.table(tokenized(docs, tokenizer, end_id), "snappy")  # ids and coded bytes hardly get smaller
    order = frequency_order(held)
    total, rows = held.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes, bodies, first, piece, held_ids = [], [], [], 0, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal names, sizes, bodies, piece, held_ids
            if names:
                body = write_file(names, np.array(sizes, np.int64), np.concatenate(bodies), order)
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([piece], pa.int32()), pa.array([body], pa.large_binary())], ["part", "piece", "body"])
                names, sizes, bodies, piece, held_ids = [], [], [], piece + 1, 0

        for b in slices(batches):
            for part, doc, n, body in zip(*(b.column(k).to_pylist() for k in ("part", "doc_id", "n_tokens", "ids"))):
                first = part
                names.append(doc)
                sizes.append(n)
                bodies.append(_ids(body, n))
                held_ids += n
                if held_ids >= ids_a_file:
                    yield from flush()
        yield from flush()

    ranged = held.repartitionByRange(max(1, min(rows, MOST_PARTS, -(-total // ids_a_file))), "doc_id").sortWithinPartitions("doc_id", "ids")
    files = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "ids").mapInArrow(run, "part int, piece int, body binary")
    out = scratch.table(files, "snappy")
    scratch.drop(held)
    return out


def read_dataset(files: DataFrame) -> DataFrame:
    """files (part, piece, body) -> (part, piece, doc_id, at, n_tokens, ids_crc32): from the files alone; at: the place in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            names, counts, ids = read_file(b.column("body")[0].as_py())
            ends = np.cumsum(counts, dtype=np.int64)
            raw = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
            crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist())]
            n = len(names)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b.column("part")[0].as_py()] * n, pa.int32()), pa.array([b.column("piece")[0].as_py()] * n, pa.int32()), pa.array(names, pa.int64()),
                    pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64()),
                ],
                ["part", "piece", "doc_id", "at", "n_tokens", "ids_crc32"],
            )

    return files.mapInArrow(run, "part int, piece int, doc_id long, at long, n_tokens long, ids_crc32 long")


def document_places(scratch: Scratch, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; start counts over the whole dataset."""
    rows = scratch.table(read_dataset(files))
    sizes = scratch.table(rows.groupBy("part", "piece").agg(F.sum("n_tokens").alias("n")))  # a row for each file
    parts = sizes.groupBy(F.col("part").alias("k")).agg(F.sum("n").alias("all"))  # MOST_PARTS at most: one task adds them up
    parts = parts.select("k", (F.sum("all").over(Window.orderBy("k")) - F.col("all")).alias("base"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("piece")) - F.col("n")
    before = sizes.withColumn("within", within).join(F.broadcast(parts), F.col("part") == F.col("k"))
    before = before.select(F.col("part").alias("p"), F.col("piece").alias("q"), (F.col("base") + F.col("within")).alias("before"))
    out = rows.join(before, (F.col("part") == F.col("p")) & (F.col("piece") == F.col("q")))
    return out.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    scratch = Scratch(spark)
    return document_places(scratch, write_dataset(scratch, read(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), 0))
