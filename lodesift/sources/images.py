"""Container images as chunks: their configuration and the files of their layers."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.functions.columns import binary
from lodesift.functions.globs import covers
from lodesift.operators import paths

#: Folders of an image that hold no secrets.
PASSED_OVER = ("usr/share/doc/", "usr/share/man/", "usr/share/locale/", "usr/lib/", "var/cache/")
#: Bytes of a layer, unpacked; a layer with more ends the scan with an error.
LAYER_BYTES = 2 << 30
#: Of the files that are passed on at once.
BATCH_BYTES = 16 << 20


def config_text(env: Column, labels: Column, entrypoint: Column, cmd: Column) -> Column:
    """The configuration as lines; labels by name; null if there is nothing in it."""
    none = F.array().cast("array<string>")
    each = lambda word, values: F.transform(F.coalesce(values, none), lambda v: F.concat(F.lit(word), v))
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    whole = lambda word, values: F.when(F.size(F.coalesce(values, none)) > 0, F.array(F.concat(F.lit(word), F.array_join(values, " ")))).otherwise(none)
    lines = F.concat(each("ENV ", env), each("LABEL ", pairs), whole("ENTRYPOINT ", entrypoint), whole("CMD ", cmd))
    return F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n")))


def safe_path(name: Column) -> Column:
    """A name in an archive without empty, `.` and `..` segments; null if it is absolute or leads out."""
    slashed = F.replace(name, F.lit("\\"), F.lit("/"))
    up, none = F.lit(".."), F.array().cast("array<string>")

    def step(stack: Column, part: Column) -> Column:
        last = F.try_element_at(stack, F.lit(-1))
        popped = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        back = F.when((F.size(stack) > 0) & (last != up), popped).otherwise(F.concat(stack, F.array(up)))
        return F.when(part.isin("", "."), stack).when(part == up, back).otherwise(F.concat(stack, F.array(part)))

    stack = F.aggregate(F.split(slashed, "/"), none, step)
    clean = F.when(F.size(stack) == 0, F.lit(".")).otherwise(F.array_join(stack, "/"))
    return F.when(~slashed.rlike("^(/|[A-Za-z]:)") & ~clean.rlike(r"^\.\.(/|$)"), clean)


def passed_over(name: Column) -> Column:
    bare = F.regexp_replace(name, "^/", "")
    out = F.lit(False)
    for folder in PASSED_OVER:
        out = out | bare.startswith(folder)
    return out


def entries(layers: DataFrame, largest: int = paths.LARGEST, layer_bytes: int = LAYER_BYTES) -> DataFrame:
    """(image, layer, layer_idx, name, content) of the regular files of layers (image, layer, layer_idx, data), data
    being an archive, compressed or not. Files that are empty or too large aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.binary())
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["image", "layer", "layer_idx", "name", "content"])
        for batch in batches:
            for image, layer, at, data in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                rows, held, seen = [], 0, 0
                with tarfile.open(fileobj=io.BytesIO(data), mode="r|*") as tar:
                    for entry in tar:
                        seen += entry.size
                        if seen > layer_bytes:
                            raise ValueError(f"layer {layer} of {image} unpacks to more than {layer_bytes} bytes")
                        if entry.type in (tarfile.REGTYPE, tarfile.AREGTYPE) and 0 < entry.size <= largest:
                            rows.append((image, layer, at, entry.name, tar.extractfile(entry).read()))
                            held += entry.size
                        if held >= BATCH_BYTES:
                            yield make(rows)
                            rows, held = [], 0
                if rows:
                    yield make(rows)

    kept = layers.where("data is not null").select("image", "layer", F.col("layer_idx").cast("int"), "data")
    return kept.mapInArrow(run, "image string, layer string, layer_idx int, name string, content binary")


def image_files(found: DataFrame, globs: Iterable[str] = ()) -> DataFrame:
    """Chunks of entries: lock files, extensions without text, folders without secrets, paths that lead out or that a
    glob covers, and binary contents are left out."""
    name = F.col("name")
    kept = found.where(~paths.lock_file(name) & ~paths.excluded_extension(name) & ~passed_over(name)).withColumn("file_path", safe_path(name))
    kept = kept.where(F.col("file_path").isNotNull() & ~covers(F.col("file_path"), globs) & ~binary(F.col("content")))
    return kept.select("file_path", F.col("content").alias("data"), F.lit("container").alias("source_type"), "image", "layer", "layer_idx")


def image_configs(images: DataFrame) -> DataFrame:
    """Chunks of configurations: images (image, env, labels, entrypoint, cmd). They stand as layer -1."""
    text = config_text(F.col("env"), F.col("labels"), F.col("entrypoint"), F.col("cmd"))
    kept = images.withColumn("text", text).where("text is not null")
    return kept.select(F.lit("").alias("file_path"), F.col("text").cast("binary").alias("data"), F.lit("container").alias("source_type"), "image", F.lit("config").alias("layer"), F.lit(-1).alias("layer_idx"))
