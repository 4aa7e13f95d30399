"""The scan: chunks in, findings out, in one pass over each chunk.

All that the reference semantics need is local to a chunk (keyword gate, matches, places, inline markers, the
entropy floor, overlaps), so the scan is one Arrow-batched map without any exchange. What crosses chunks
(verification of distinct values, filters, order, summaries) are DataFrame steps in
lodesift.operators.findings and lodesift.operators.verification.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.functions import values
from lodesift.operators.detectors import Detector
from lodesift.operators.registry import select

#: Of where a chunk comes from; all are optional.
SOURCE = (
    "struct<source_type:string,repository:string,commit:string,author:string,email:string,date:timestamp,branch:string,file_path:string,line:int,"
    "image:string,layer:string,layer_idx:int,channel:string,channel_name:string,message_user:string,message_ts:string,thread_ts:string>"
)
FOUND = "detector_id string, severity string, redacted string, line int, byte_start long, byte_end long, entropy double, id string, extra map<string,string>, raw binary, raw_v2 binary"
DEFAULT_THRESHOLD = 4.0
#: Findings that a task holds, but for those of one chunk, before it passes them on: however many a batch of chunks has.
HELD = 1024


@dataclass(frozen=True)
class ScanOptions:
    rules: tuple[Mapping[str, object], ...] = ()
    exclude: tuple[str, ...] = ()
    only: tuple[str, ...] | None = None
    entropy: bool = True
    threshold: float = DEFAULT_THRESHOLD  # 0 stands for the default
    tag: str = values.IGNORE_TAG


@dataclass(frozen=True)
class Prefilter:
    """Which detectors may find something in a chunk: those that have no keyword, or one that occurs in its
    lower-cased bytes. Keywords that several detectors share are looked up once."""

    detectors: tuple[Detector, ...]
    always: tuple[int, ...] = field(init=False)
    by_word: tuple[tuple[bytes, tuple[int, ...]], ...] = field(init=False)

    def __post_init__(self) -> None:
        words: dict[bytes, list[int]] = {}
        for i, d in enumerate(self.detectors):
            for word in d.lowered:
                words.setdefault(word, []).append(i)
        object.__setattr__(self, "always", tuple(i for i, d in enumerate(self.detectors) if not d.lowered))
        object.__setattr__(self, "by_word", tuple((w, tuple(of)) for w, of in words.items()))

    def admitted(self, data: bytes) -> list[Detector]:
        low = data.lower()
        found = set(self.always)
        for word, of in self.by_word:
            if not found.issuperset(of) and word in low:
                found.update(of)
        return [self.detectors[i] for i in sorted(found)]


def scan_chunk(data: bytes, path: str, line: int, prefilter: Prefilter, options: ScanOptions) -> list[tuple]:
    """The findings of one chunk, as rows of FOUND. line: 0, or the line that the source tells."""
    threshold = options.threshold or DEFAULT_THRESHOLD
    kept: list[tuple[Detector, tuple]] = []
    for detector in prefilter.admitted(data):
        after: dict[bytes, int] = {}
        for m in detector.find(data):
            if m.span and data[slice(*m.span)] == m.raw:
                start = m.span[0]
            else:  # the nth match of a value stands at its nth place
                start = data.find(m.raw, after.get(m.raw, 0)) if m.raw else -1
                after[m.raw] = start + 1 if start >= 0 else len(data) + 1
            entropy = values.entropy(m.raw) if options.entropy and m.raw else None
            if entropy is not None and detector.gated and detector.gated(m) and entropy < threshold:
                continue
            number = line or (values.line_at(data, start) if start >= 0 else 0)
            on = values.nth_line(data, line) if line else values.line_text(data, start) if start >= 0 else b""
            if number and values.ignored(on, detector.id, options.tag):
                continue
            end = start + len(m.raw) if start >= 0 and m.raw else -1
            id = values.finding_id(detector.id, m.redacted, path, number, start)
            kept.append((detector, (detector.id, detector.severity, m.redacted, number, start, end, entropy, id, list(m.extra.items()), m.raw, m.second or None)))
    rank = ("low", "medium", "high", "critical").index
    above = [row for d, row in kept if d.authority and 0 <= row[4] < row[5]]
    overlapped = lambda row: 0 <= row[4] < row[5] and any(a[4] < row[5] and row[4] < a[5] and rank(a[1]) >= rank(row[1]) for a in above)
    return [row for d, row in kept if not (d.fallback and overlapped(row))]


def scan_batch(batch: pa.RecordBatch, prefilter: Prefilter, options: ScanOptions, keep_raw: bool) -> Iterator[pa.RecordBatch]:
    """The findings of a batch, whose last three columns are path, line and data, in parts of about HELD."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "map": pa.map_(pa.string(), pa.string()), "binary": pa.binary()}
    found = [x.strip().split() for x in FOUND.replace("map<string,string>", "map").split(",")]
    n = batch.num_columns
    names = [*batch.schema.names[: n - 2], *[name for name, _ in found]]
    paths, lines, rows, of = batch.column(n - 3), batch.column(n - 2), [], []
    for i, data in enumerate(batch.column(n - 1)):
        if data.is_valid:
            own = scan_chunk(data.as_py(), paths[i].as_py() or "", lines[i].as_py() or 0, prefilter, options)
            rows += own if keep_raw else [(*r[:-2], None, None) for r in own]
            of += [i] * len(own)
        if rows and (len(rows) >= HELD or i == batch.num_rows - 1):
            kept = [c.take(pa.array(of, pa.int64())) for c in batch.columns[: n - 2]]
            made = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), found, strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=names)
            rows, of = [], []


def scan(chunks: DataFrame, options: ScanOptions = ScanOptions(), data_col: str = "data", path_col: str = "file_path", line_col: str | None = None, keep: Iterable[str] = (), keep_raw: bool = False) -> DataFrame:
    """The columns of keep, file_path, and those of FOUND, a row for each finding.

    data_col: string or binary; null chunks have no findings. raw and raw_v2 hold secrets: they are returned
    only with keep_raw, and are meant for verification, after which they are to be dropped."""
    prefilter = Prefilter(tuple(select(options.rules, options.exclude, options.only)))
    names = list(keep)
    chosen = chunks.select(*names, F.col(path_col).cast("string").alias("file_path"), (F.col(line_col).cast("int") if line_col else F.lit(0)).alias("__line"), F.col(data_col).cast("binary").alias("__data"))
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from scan_batch(batch, prefilter, options, keep_raw)

    out = chosen.mapInArrow(run, ", ".join([*columns, FOUND]))
    return out if keep_raw else out.drop("raw", "raw_v2")
