"""What the corpus operators share: reading tables, cutting lineage, Arrow helpers."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where it is unset and
    driver and executors are one process, as in tests, a temporary folder is taken and set; on a cluster
    that is an error, as no folder of one machine is seen by the others."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodesift-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/lodesift/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later steps neither compute it again nor
    depend on any executor that has taken part in it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Deletes what materialize() has written, once nothing reads it any more."""
    for df in stored:
        at = (df.sparkSession, df.stored_at)
        if at in _written:
            _delete(*at)
            _written.remove(at)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns that are added for a while, none of them a column of df, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bits of a filter for each of its keys, at least, and in all, at most; functions of a key.
FILTER_BITS, MOST_FILTER_BITS, FILTER_HASHES = 16, 1 << 26, 4
_PAGE = 1 << 15  # bits of one bitmap of bitmap_construct_agg


def maybe_in(keys: DataFrame, key_col: str, most_bits: int = MOST_FILTER_BITS) -> Callable[[Column], Column]:
    """A test for columns of longs: false only for those that aren't among the keys. It is a Bloom filter of
    MOST_FILTER_BITS at most, built and asked by DataFrame functions, so that rows that a small decision doesn't
    concern needn't meet it in an exchange. With more keys than it holds more rows pass as possible, and the
    exact join that follows is as right as before, but has more to move."""
    n = keys.count()
    bits = _PAGE
    while bits < min(n * FILTER_BITS, most_bits):
        bits *= 2
    place = lambda key, k: F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits).cast("long")) + 1
    places = keys.select(F.explode(F.array(*[place(F.col(key_col), k) for k in range(FILTER_HASHES)])).alias("at"))
    pages = places.groupBy(F.bitmap_bucket_number("at").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    by_page = pages.agg(F.map_from_entries(F.collect_list(F.struct("page", "bitmap"))).alias("m"))
    held = by_page.select(F.transform(F.sequence(F.lit(1).cast("long"), F.lit(bits // _PAGE).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(bytes(_PAGE // 8)))).alias("pages")).scalar()

    def has(key: Column, k: int) -> Column:
        at = place(key, k)
        byte = F.substring(F.element_at(held, F.bitmap_bucket_number(at).cast("int")), (F.bitmap_bit_position(at) / 8).cast("int") + 1, F.lit(1))
        return F.call_function("getbit", F.conv(F.hex(byte), 16, 10).cast("long"), F.pmod(F.bitmap_bit_position(at), F.lit(8)).cast("int")) == 1

    def test(key: Column) -> Column:
        out = F.lit(True)
        for k in range(FILTER_HASHES):
            out = out & has(key, k)
        return out

    return test


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(column: pa.Array) -> pa.Array:
    """The UTF-8 bytes of a string column without a copy; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    out = column.view(kind) if column.offset == 0 and column.null_count == 0 else column.cast(kind)
    return out.fill_null(b"") if out.null_count else out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and the n + 1 offsets of its rows."""
    column = text_bytes(column)
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


#: Of a batch that a step sees at once.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about so many bytes each, one row at least."""
    if batch.nbytes <= most:
        yield batch
        return
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(lo, hi - lo)


def map_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: object) -> DataFrame:
    """mapInArrow by a function of one batch; batches come in parts of bounded size, empty ones are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                if batch.num_rows and (out := step(batch)) is not None:
                    yield out

    return df.mapInArrow(run, schema)
