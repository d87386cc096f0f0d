"""Thumbnails as PGM files: <folder>/<doc_id>_<obj>.pgm, written by the tasks that hold the rows.

The folder has to be one that all executors see under the same local path (a mount); tables of thumbnails reach any store
through Spark's own writers.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.sources.pixels import pgm


def write_pgm(thumbs: DataFrame, folder: str) -> int:
    """Writes the thumbnails that could be decoded; returns how many. A task that runs again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            n = 0
            for doc, obj, w, h, grey in zip(*(b.column(c).to_pylist() for c in ("doc_id", "obj", "w", "h", "grey"))):
                if grey is not None:
                    at = f"{folder}/{doc}_{obj}.pgm"
                    with open(f"{at}.{os.getpid()}", "wb") as f:
                        f.write(pgm(w, h, grey))
                    os.replace(f.name, at)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return thumbs.select("doc_id", "obj", "w", "h", "grey").mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0
