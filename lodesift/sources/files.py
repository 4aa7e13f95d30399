"""Files, and tables of texts, as chunks: (file_path, data, source_type), a row for each whole file.

Spark's readers leave out names that start with a dot or an underscore, which are where credentials often are, so
folders are walked here: the driver looks at a few levels until there are folders enough to deal out, executors
walk the rest, and files are dealt anew before they are opened. Sizes and names are judged before content."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterable, Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.functions.columns import binary
from lodesift.functions.globs import covers
from lodesift.operators import paths

CHUNK = "file_path string, data binary, source_type string"
#: Folders that the driver looks into at most before it deals the rest out, and how many it deals out for each task.
LOOKED_INTO, FOLDERS_PER_TASK = 2000, 8
#: Bytes of files in a batch that leaves a reader, about.
BATCH_BYTES = 16 << 20
#: Not walked into, unless it is the root itself.
PRUNED = (".git",)


def _local(root: str) -> str | None:
    """The path on a file system that all machines mount, None for a store."""
    parts = urlsplit(root)
    if parts.scheme in ("", "file"):
        return os.path.abspath(unquote(parts.path) if parts.scheme else root)
    return None


def _entries(folder: str) -> tuple[list[tuple[str, int, int]], list[str]]:
    """(files as (path, size, modified in ns), folders) in a folder; links and what is neither are passed over. A folder
    that can't be read has nothing."""
    files, folders = [], []
    try:
        if (local := _local(folder)) is not None:
            with os.scandir(local) as found:
                for x in found:
                    if x.is_dir(follow_symlinks=False):
                        folders.append(x.path)
                    elif x.is_file(follow_symlinks=False):
                        known = x.stat(follow_symlinks=False)
                        files.append((x.path, known.st_size, known.st_mtime_ns))
        else:
            store, base = pafs.FileSystem.from_uri(folder)
            scheme = folder[: folder.index(base.split("/", 1)[0])] if base else folder
            for x in store.get_file_info(pafs.FileSelector(base)):
                if x.type == pafs.FileType.Directory:
                    folders.append(scheme + x.path)
                elif x.type == pafs.FileType.File:
                    files.append((scheme + x.path, x.size, x.mtime_ns or 0))
    except OSError:
        return [], []
    return files, [x for x in folders if x.rstrip("/").rpartition("/")[2] not in PRUNED]


def _below(folder: str) -> Iterator[tuple[str, int, int]]:
    left = [folder]
    while left:
        files, folders = _entries(left.pop())
        yield from files
        left += folders


def _root(root: str) -> tuple[str, int, int] | None:
    """The root itself if it is a file, None if it is a folder; an error if it is neither."""
    if (local := _local(root)) is not None:
        known = os.stat(local)
        if stat.S_ISDIR(known.st_mode):
            return None
        if not stat.S_ISREG(known.st_mode):
            raise ValueError(f"{root!r} is neither a file nor a folder")
        return local, known.st_size, known.st_mtime_ns
    store, base = pafs.FileSystem.from_uri(root)
    info = store.get_file_info(base)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(root)
    return (root, info.size, info.mtime_ns or 0) if info.type == pafs.FileType.File else None


LISTED = "path string, file_path string, length long, modified long"


def listed(spark: SparkSession, roots: str | Iterable[str]) -> DataFrame:
    """(path, file_path, length, modified in ns), a row for each regular file below the roots, whatever its name, and once
    where roots overlap. file_path is relative to the root, or to its folder if the root is a file. Links aren't
    followed, `.git` isn't walked into, a root that can't be read is an error and a folder below it isn't."""
    names = [roots] if isinstance(roots, str) else list(roots)
    wanted = FOLDERS_PER_TASK * spark.sparkContext.defaultParallelism
    rows, folders, looked = [], [], 0
    for name in names:
        own = _local(name) or name.rstrip("/")
        if found := _root(name):
            rows.append((found[0], found[0].rpartition("/")[2], *found[1:]))
            continue
        base, level = len(own.rstrip("/")) + 1, [own]
        while level and len(level) < wanted and looked < LOOKED_INTO:
            following = []
            for folder in level:
                looked += 1
                files, below = _entries(folder)
                rows += [(p, p[base:], n, t) for p, n, t in files]
                following += below
            level = following
        folders += [(folder, base) for folder in level]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, base in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = [(p, p[base:], n, t) for p, n, t in _below(folder)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "file_path", "length", "modified"])

    out = spark.createDataFrame(rows, LISTED)
    if folders:
        dealt = spark.createDataFrame(folders, "folder string, base int").repartition(min(len(folders), wanted))
        out = out.unionByName(dealt.mapInArrow(walk, LISTED))
    return out.dropDuplicates(["path"]) if len(names) > 1 else out


def opened(files: DataFrame) -> DataFrame:
    """files: rows as of listed(). With content binary: files are dealt out anew, and those that can't be read are left
    out."""
    columns = files.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, contents, held = [], [], 0

            def out(kept: list[int], contents: list[bytes], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*batch.take(pa.array(kept, pa.int64())).columns, pa.array(contents, pa.binary())], names=[*columns, "content"])

            for i, path in enumerate(batch.column(batch.schema.get_field_index("path")).to_pylist()):
                try:
                    if (local := _local(path)) is not None:
                        with open(local, "rb") as f:
                            content = f.read()
                    else:
                        store, base = pafs.FileSystem.from_uri(path)
                        with store.open_input_file(base) as f:
                            content = f.read()
                except OSError:
                    continue
                kept.append(i)
                contents.append(content)
                held += len(content)
                if held >= BATCH_BYTES:
                    yield out(kept, contents)
                    kept, contents, held = [], [], 0
            if kept:
                yield out(kept, contents)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.repartition("path").mapInArrow(read, f"{schema}, content binary")


def _text(read: DataFrame, kept: Column, extra: Iterable[str], globs: Iterable[str], largest: int) -> DataFrame:
    small = read.where((F.col("length") <= largest) & (F.col("length") > 0) & kept)
    return opened(small).where((F.length("content") <= largest) & ~binary(F.col("content")))


def files(spark: SparkSession, root: str | Iterable[str], extra: Iterable[str] = (), globs: Iterable[str] = (), largest: int = paths.LARGEST) -> DataFrame:
    """The text files below one or several folders, and single files. Lock files, excluded extensions and globs, empty
    and larger files aren't opened."""
    found = listed(spark, root)
    chosen = _text(found, ~paths.skipped(F.col("file_path"), extra, globs), extra, globs, largest)
    return chosen.select("file_path", F.col("content").alias("data"), F.lit("filesystem").alias("source_type"))


def texts(docs: DataFrame, path: Column, text_col: str = "text") -> DataFrame:
    """Rows of a table as chunks; all columns stay."""
    return docs.withColumn("file_path", path).withColumn("data", F.col(text_col).cast("binary")).withColumn("source_type", F.lit("table"))


def objects(spark: SparkSession, root: str, bucket: str, source_type: str = "s3", extra: Iterable[str] = (), globs: Iterable[str] = (), largest: int = paths.LARGEST) -> DataFrame:
    """The text objects below an address of a store, named bucket/key. Unlike files, lock files are scanned; empty
    objects aren't. An object that can't be read is left out."""
    found = listed(spark, root)
    key = F.col("file_path")
    chosen = _text(found, ~paths.excluded_extension(key, extra) & ~covers(key, globs), extra, globs, largest)
    return chosen.select(F.concat(F.lit(f"{bucket}/"), "file_path").alias("file_path"), F.col("content").alias("data"), F.lit(source_type).alias("source_type"))
