"""PDF files as a table or a stream: each file is read once, its primitives appended. Files don't depend on each other, so no state.

A file that goes away or can't be read while the job runs is left out by Spark's reader; one that a list names and that
isn't there is a row with an error. Neither fails the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.sources import pdf

_TOLERANT = {"ignoreMissingFiles": "true", "ignoreCorruptFiles": "true"}


def _with_id(files: DataFrame) -> DataFrame:
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content", F.lit(None).cast("string").alias("error"))


def files(spark: SparkSession, folder: str, streaming: bool = False, glob: str = "*.pdf") -> DataFrame:
    """(doc_id long, path, content, error null) of the files of a folder; doc_id is a hash of the path."""
    if streaming:
        read = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    else:
        read = spark.read.format("binaryFile")
    return _with_id(read.options(**_TOLERANT).option("pathGlobFilter", glob).load(folder))


def listed(spark: SparkSession, list_file: str) -> DataFrame:
    """(doc_id, path, content, error) of the files that a text file names, one a line; blanks around names and empty lines
    don't count. The driver looks up each name, so a list is for thousands of files; use a folder for more."""
    names = [n for r in spark.read.text(list_file).select(F.btrim("value").alias("n")).distinct().collect() if (n := r["n"])]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there, gone = [], []
    for n in sorted(names):
        at = jvm.org.apache.hadoop.fs.Path(n)
        (there if at.getFileSystem(conf).exists(at) else gone).append(n)
    lost = spark.createDataFrame([(n,) for n in gone], "path string").select(F.xxhash64("path").alias("doc_id"), "path", F.lit(None).cast("binary").alias("content"), F.lit("missing").alias("error"))
    if not there:
        return lost
    return _with_id(spark.read.format("binaryFile").options(**_TOLERANT).load(there)).union(lost)


def primitives(spark: SparkSession, folder: str, streaming: bool = False) -> DataFrame:
    """Primitives of all pages of all files; in streaming mode an append-only stream without watermark."""
    return pdf.scan(files(spark, folder, streaming))


def append(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Reads what is there now into a Parquet table; a second call reads only new files."""
    query = primitives(spark, folder, True).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
