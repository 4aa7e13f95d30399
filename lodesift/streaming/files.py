"""The scan of files as they arrive.

report() remembers in its checkpoint folder which files it has seen and scans the others, hidden names among them.
arriving() is a source for streaming queries of one's own, which, like all of Spark's file sources, doesn't see
names that start with a dot or an underscore."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.functions.columns import binary
from lodesift.operators import paths
from lodesift.operators.scan import ScanOptions, scan
from lodesift.sinks.reports import json_rows
from lodesift.sources.files import LISTED, listed, opened

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, root: str, per_batch: int = 1000, largest: int = paths.LARGEST) -> DataFrame:
    """Chunks of the files that a folder gets; so many at most in a batch, the others in the next ones."""
    read = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(root)
    at = F.locate(root.rstrip("/") + "/", F.col("path"))
    own = read.where(F.col("length") <= largest).withColumn("file_path", F.when(at > 0, F.substring("path", at + len(root.rstrip("/")) + 1, F.length("path"))).otherwise(F.col("path")))
    kept = own.where(paths.scannable(F.col("file_path"), F.col("length"), F.col("content"), (), (), largest))
    return kept.select("file_path", F.col("content").alias("data"), F.lit("filesystem").alias("source_type"))


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that a folder holds whole."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        return []
    jvm = spark.sparkContext._jvm
    return sorted(int(x.getPath().getName().removeprefix("batch=")) for x in store.listStatus(at) if x.getPath().getName().startswith("batch=") and store.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")))


def report(spark: SparkSession, root: str, to: str, checkpoint: str, options: ScanOptions = ScanOptions(), largest: int = paths.LARGEST) -> int:
    """Scans what has arrived or changed since the last call and writes its findings as JSON lines below `to`, a folder
    for each batch. Returns the number of files in the batch. What is in a batch is written before it is
    scanned, and its findings replace those of a call that was broken off, so each file is reported once."""
    begun, done = _batches(spark, f"{checkpoint}/files"), _batches(spark, f"{to}")
    if begun and begun[-1] not in done:
        number = begun[-1]
    else:
        number = begun[-1] + 1 if begun else 0
        found = listed(spark, root)
        if begun:
            seen = spark.read.schema(LISTED).parquet(*[f"{checkpoint}/files/batch={k}" for k in begun])
            found = found.join(seen.select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")
        found.select("path", "file_path", "length", "modified").write.mode("overwrite").parquet(f"{checkpoint}/files/batch={number}")
    batch = spark.read.schema(LISTED).parquet(f"{checkpoint}/files/batch={number}")
    small = batch.where((F.col("length") <= largest) & (F.col("length") > 0) & ~paths.skipped(F.col("file_path")))
    chunks = opened(small).where(~binary(F.col("content"))).select("file_path", F.col("content").alias("data"), F.lit("filesystem").alias("source_type"))
    json_rows(scan(chunks, options)).write.mode("overwrite").text(f"{to}/batch={number}")
    return batch.count()
