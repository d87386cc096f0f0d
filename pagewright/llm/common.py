"""Shared helpers: scratch tables in the cluster's shared folder, table reading, Arrow batch slicing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and all runs in one process (tests) a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root


#: while a table is written: its shuffle files go when it is there, and Arrow batches hold whole texts, so they are short
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_CACHES: list[dict] = []


def cache() -> dict:
    """A dictionary of a worker process that lasts from task to task, until an operator that doesn't use it starts there."""
    _CACHES.append({})
    return _CACHES[-1]


def drop_caches() -> None:
    """What other operators' tasks have left in this worker process."""
    for c in _CACHES:
        c.clear()


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and survive a lost executor."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_root(spark)}/{uuid.uuid4().hex}", {}

    def table(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        path, was = f"{self.root}/{len(self.paths)}", {}
        for key, value in _WRITING.items():
            try:
                was[key] = self.spark.conf.get(key)
                self.spark.conf.set(key, value)
            except Exception:  # a Spark without this setting
                was.pop(key, None)
        try:
            df.write.option("compression", compression).parquet(path)
        finally:
            for key, value in was.items():
                self.spark.conf.set(key, value)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._keep = getattr(self, "_keep", []) + [out]  # ids stay unique while the frames live
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths[id(t)])
            path.getFileSystem(conf).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in short slices: bounds what one step holds as Python objects, however many rows Spark sends."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def texts_of(batch: pa.RecordBatch, *path: str) -> list[str]:
    """A text column, or a field of a struct column; nulls as empty texts."""
    first, *rest = path or ("text",)
    column = batch.column(first)
    for name in rest:
        column = pc.struct_field(column, name)
    return [x or "" for x in column.to_numpy(zero_copy_only=False).tolist()]


def packed(docs: DataFrame) -> DataFrame:
    """docs with all columns in one struct column `row`, so that own columns can't clash with theirs, whatever their names."""
    return docs.select(F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row"))
