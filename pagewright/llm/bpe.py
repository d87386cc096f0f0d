"""Byte-level BPE by monoid tree reduction, and decoding (operator 10).

Encoding a match of the split pattern. A byte string is halved down to leaves of LEAF bytes at most, which a plain loop
merges in rank order, and the halves' results are joined. A join re-encodes a window around the seam by rank order, one
token to either side at first, and doubles it on a side whose border isn't settled. A border is settled when the token
outside and the window's outermost token, put together and encoded, give these two tokens again. Rank-ordered merging has
one result whose neighbours all pass this test, so when both borders are settled the tokens outside can't change and the
joined list is that of the whole string. A join is associative; empty is its unit.

Whole texts. Matches are independent, so a text's ids are its matches' ids in order. `atoms` splits the text and keeps
the ids of parts seen before; the tree runs for matches not seen before. Short windows go through a plain merge loop.

Decoding halves the ids down to runs of 4096, whose bytes are looked up, and concatenates up the tree.

Cases. A null text is empty; an empty text has no ids. Any code points round-trip.
Repeated rows are each returned; a null doc_id stays null. Extra columns are ignored. An empty table stays empty.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.atoms import AtomEncoder
from pagewright.llm.common import cache, read, slices, texts_of

LEAF, RUN, PARTS = 24, 4096, 500_000


class MonoidBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.names: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for name, k in ranks.items():
            self.names[k] = name
        self.settled: dict[tuple[int, int], bool] = {}
        self.coder = AtomEncoder(pattern, lambda piece: np.array(self.encode(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes(), cache_size=PARTS)

    def merge(self, raw: bytes) -> list[int]:
        """Rank order merging of a short string: always the lowest rank, the leftmost of equals."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        parts, get, high = [raw[k : k + 1] for k in range(len(raw))], self.ranks.get, len(self.names)
        scores = [get(a + b, high) for a, b in zip(parts, parts[1:])]
        while scores and (low := min(scores)) < high:
            k = scores.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = get(parts[k - 1] + parts[k], high)
            if k < len(scores):
                scores[k] = get(parts[k] + parts[k + 1], high)
        return [self.ranks[p] for p in parts]

    def stands(self, a: int, b: int) -> bool:
        """Whether the two tokens, put together and encoded, are these two again."""
        got = self.settled.get((a, b))
        if got is None:
            if len(self.settled) > 500_000:
                self.settled.clear()
            got = self.settled[a, b] = self.merge(self.names[a] + self.names[b]) == [a, b]
        return got

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            raw = b"".join(self.names[k] for k in left[-i:] + right[:j])
            window = self.merge(raw) if len(raw) <= 4 * LEAF else self.window(raw)
            before = i == len(left) or self.stands(left[-i - 1], window[0])
            after = j == len(right) or self.stands(window[-1], right[j])
            if before and after:
                return left[:-i] + window + right[j:]
            i, j = i if before else 2 * i, j if after else 2 * j

    def window(self, raw: bytes) -> list[int]:
        """A wide window, by merging in rank order with a heap: a tree below could meet the same window again."""
        import heapq

        n, get = len(raw), self.ranks.get
        end, prev, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, k, k + 1, k + 2) for k in range(n - 1) if (r := get(raw[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, mid, stop = heapq.heappop(heap)
            if not live[a] or end[a] != mid or mid >= n or not live[mid] or end[mid] != stop:
                continue
            end[a], live[mid] = stop, False
            if stop < n:
                prev[stop] = a
                if (r := get(raw[a : end[stop]])) is not None:
                    heapq.heappush(heap, (r, a, stop, end[stop]))
            p = prev[a]
            if p >= 0 and (r := get(raw[p:stop])) is not None:
                heapq.heappush(heap, (r, p, a, stop))
        return [self.ranks[raw[k : end[k]]] for k in range(n) if live[k]]

    def encode(self, raw: bytes) -> list[int]:
        """The ids of one match."""
        if len(raw) <= LEAF:
            return self.merge(raw) if raw else []
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        half = len(raw) // 2
        return self.join(self.encode(raw[:half]), self.encode(raw[half:]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= RUN:
            return b"".join(map(self.names.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_CODERS: dict[str, MonoidBPE] = cache()


def coder_of(path: str) -> MonoidBPE:
    """Over a rank file; one for each worker process and path."""
    if path not in _CODERS:
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            _CODERS[path] = MonoidBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, PATTERN)
    return _CODERS[path]


def round_trip(docs: DataFrame, ranks: str) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, ids binary: little-endian unsigned 32-bit, decoded binary)."""
    return _coded(docs, ranks, lambda ids, decoded: (ids, decoded), [pa.binary(), pa.binary()], "doc_id long, ids binary, decoded binary")


def _coded(docs: DataFrame, ranks: str, of, kinds: list, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder_of(ranks)
        for b in slices(batches, 1000):
            ids, at = bpe.coder.encode_batch(texts_of(b))
            rows = [of(own.tobytes(), bpe.decode(own.tolist())) for own in (ids[p:q] for p, q in zip(at[:-1].tolist(), at[1:].tolist()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    def digest(ids: bytes, decoded: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _coded(read(spark, sf_dir, "documents"), path("byte_bpe_50k.tiktoken"), digest, [pa.int64(), pa.string(), pa.string()], schema)
