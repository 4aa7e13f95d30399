"""Exact substring dedup by a logarithmic family of suffix arrays.

Every string of LENGTH bytes has an anchor: of the hashes of its K-grams the smallest, the first if several
are. Equal strings have equal anchors at equal places, so they meet where rows are dealt out by the anchor's
hash. A text falls into runs of successive strings with one anchor, a run being a little longer than LENGTH.

1. Texts are dealt to groups by document. Each group tells which anchors it has; those that two groups have,
   or one has twice, are candidates. All else can't repeat and goes no further.
2. Runs at candidates, each distinct one of a group once, go to buckets by anchor. Runs at anchors that very
   many runs have are cut finer and dealt out by the bytes that all strings in the cut share, so that
   no bucket grows with the frequency of a line or passage. What counts is the runs, as they fill a bucket, and
   not the groups that have them, whose number grows with the input.
3. A bucket takes its runs in the order of documents, batch after batch. Strings whose hash no other string of the
   bucket has can't repeat and go no further. Of the others a batch gets a suffix array (the starts
   of its strings of LENGTH bytes, sorted by these), which is merge-scanned against the levels that exist; what
   matches is repeated. The rest becomes a level, and levels of a like size merge, so there is a logarithmic number.
4. Repeated spans go back to the groups, where bytes are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.llm.common import flat, partitions

LENGTH = 100
K = 48
#: An anchor that so many groups have, each counted as often as it has runs there (some 2 MB of text in all), is dealt
#: out by finer keys. A group tells its number of runs from TOLD_RUNS on; fewer count as one.
HOT_GROUPS, TOLD_RUNS = 1 << 14, 4
#: Strings in a cut of a run at such an anchor.
CUT = 8
#: Bytes that are hashed at once; their hashes fit in a core's cache.
CHUNK = 1 << 18
#: Runs that are compared at once within a group.
RUNS = 1 << 17
#: Strings in the first batch of a bucket, and in any.
BATCH, LARGEST_BATCH = 1 << 16, 1 << 22
#: Groups for each shuffle partition, at least; there is one bucket for each, at least. So many bytes of text in a
#: group, and of texts for each bucket, about; to be raised with the executors' memory.
PER_PARTITION, GROUP_BYTES, BUCKET_BYTES = 2, 8 << 20, 32 << 20


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-gram of bytes, the same wherever the gram stands."""
    out, width = data.astype(np.uint64) + np.uint64(1), 1
    power, acc, acc_width = np.array([0x9E3779B97F4A7C15], np.uint64), None, 0
    rest = k
    while rest:  # by the binary digits of k: hashes of widths 1, 2, 4, ... are put together
        if rest & 1:
            if acc is None:
                acc, acc_width = out, width
            else:
                n = len(data) - acc_width - width + 1
                acc = acc[:n] * power + out[acc_width : acc_width + n]
                acc_width += width
        rest >>= 1
        if rest:
            n = len(data) - 2 * width + 1
            out = out[:n] * power + out[width : width + n]
            power, width = power * power, 2 * width
    acc = acc ^ (acc >> np.uint64(32))
    acc *= np.uint64(0xD6E8FEB86659FD93)
    acc ^= acc >> np.uint64(29)
    return acc


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w successive values."""
    out, width = values, 1
    while 2 * width <= w:
        out, width = np.minimum(out[:-width], out[width:]), 2 * width
    return np.minimum(out[: len(values) - w + 1], out[w - width :][: len(values) - w + 1]) if width < w else out


def pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of parts of the rows, longer rows in parts that share length - 1 bytes."""
    for row in np.flatnonzero(np.diff(offsets) >= length).tolist():
        lo, hi = int(offsets[row]), int(offsets[row + 1])
        for start in range(lo, hi - length + 1, CHUNK):
            yield row, start, min(hi, start + CHUNK + length - 1)


def runs(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunk by chunk, of each run of strings with one anchor: row, start in data, number of strings, the
    anchor's place in data, its hash."""

    def out(parts: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
        joined = np.concatenate([data[a:b] for _, a, b in parts])
        sizes = np.array([b - a for _, a, b in parts])
        begins = np.cumsum(sizes) - sizes
        h = gram_hashes(joined, k)
        low = np.uint64((1 << 23) - 1)
        best = window_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - k + 1)
        at = (best & low).astype(np.int64)
        n = sizes - length + 1
        starts = np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(n.sum())
        of = np.repeat(np.arange(len(parts)), n)
        anchors = at[starts]
        first = np.flatnonzero(np.append(True, (anchors[1:] != anchors[:-1]) | (of[1:] != of[:-1])))
        count = np.diff(np.append(first, len(starts)))
        shift = np.array([a for _, a, _ in parts]) - begins
        rows = np.array([row for row, _, _ in parts])
        p = of[first]
        return rows[p], starts[first] + shift[p], count, anchors[first] + shift[p], h[anchors[first]]

    held, total = [], 0
    for part in pieces(offsets, length):
        held.append(part)
        total += part[2] - part[1]
        if total >= CHUNK:
            yield out(held)
            held, total = [], 0
    if held:
        yield out(held)


def strings(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Strings of one width as an array that sorts by bytes."""
    if not len(starts):
        return np.zeros(0, f"S{width}")
    view = np.lib.stride_tricks.sliding_window_view(data, width)
    return np.ascontiguousarray(view[starts]).view(f"S{width}").ravel()


class SuffixLevels:
    """A logarithmic family of suffix arrays over one text, of which the first `length` bytes of a suffix count. A level
    holds starts of distinct strings, sorted by their bytes, and nothing else. Batches come in the order in which a
    string counts as earlier. Bytes are compared eight at once, and only among strings that agree so far."""

    def __init__(self, text: np.ndarray, length: int = LENGTH):
        self.length = length
        padded = np.concatenate([np.asarray(text, np.uint8), np.zeros(8, np.uint8)])
        self.words = np.ndarray((len(padded) - 7,), ">u8", padded.data, strides=(1,))
        self.kind = np.int32 if len(padded) < 1 << 31 else np.int64
        self.levels: list[np.ndarray] = []  # distinct in all; the largest first

    def _word(self, starts: np.ndarray, k: int) -> np.ndarray:
        """The kth eight bytes; the last ones overlap those before, so that none lies outside of the string."""
        if self.length < 8:
            return self.words[starts].astype(np.uint64) >> np.uint64(8 * (8 - self.length))
        return self.words[starts + min(8 * k, self.length - 8)].astype(np.uint64)

    def sorted(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of strings by their bytes, equal ones as they came, and which equals the one before it. Where starts
        are sorted runs, they are merged: the sort is stable and finds them in order."""
        order = np.arange(len(starts))
        new = np.zeros(len(starts), bool)
        new[:1] = True
        slots, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
        for k in range(-(-self.length // 8)):
            if not len(slots):
                break
            word = self._word(starts[order[slots]], k)
            # a group of which all have this word is in order; only others are sorted
            part = np.arange(len(slots))
            if k:
                apart = (group[1:] == group[:-1]) & (word[1:] != word[:-1])
                mixed = np.zeros(int(group[-1]) + 1, bool)
                mixed[group[1:][apart]] = True
                part = np.flatnonzero(mixed[group])
            by = part[np.argsort(word[part], kind="stable")]
            if k:
                by = by[np.argsort(group[by], kind="stable")]
            order[slots[part]] = order[slots[by]]
            word[part] = word[by]  # groups stay where they are
            new[slots[1:]] |= (group[1:] != group[:-1]) | (word[1:] != word[:-1])
            # those that still agree with a neighbour go on, a run of them a group
            tied = np.zeros(len(slots), bool)
            again = ~new[slots]
            tied |= again
            tied[:-1] |= again[1:]
            slots = slots[tied]
            group = np.cumsum(new[slots])
        return order, ~new

    def _scan(self, level: np.ndarray, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges a sorted batch with a level: both in order, and which strings of the batch the level has."""
        both = np.concatenate([level, batch])
        order, same = self.sorted(both)
        met = np.zeros(len(both), bool)
        met[order[same]] = True  # of two equal ones the level's comes first
        return both[order], met[len(level) :]

    def add(self, starts: np.ndarray) -> np.ndarray:
        """Whether each string of a batch is in a level or earlier in the batch. The new ones become a level."""
        order, same = self.sorted(starts)
        fresh = starts[order[~same]].astype(self.kind)
        known = np.zeros(len(fresh), bool)
        for level in self.levels:
            known |= self._scan(level, fresh)[1]
        repeated = np.empty(len(starts), bool)
        repeated[order] = known[np.cumsum(~same) - 1] | same if len(starts) else same
        self._push(fresh[~known])
        return repeated

    def _push(self, level: np.ndarray) -> None:
        if not len(level):
            return
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-1]).bit_length() >= len(self.levels[-2]).bit_length():
            last, before = self.levels.pop(), self.levels.pop()
            self.levels.append(self._scan(before, last)[0])


def spans_of(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals of each row, sorted; those that touch become one."""
    if not len(rows):
        return rows, starts, ends
    order = np.lexsort((starts, rows))
    rows, starts, ends = rows[order], starts[order], ends[order]
    wide = np.int64(max(int(ends.max()), 1) + 1)
    reach = np.maximum.accumulate(rows.astype(np.int64) * wide + ends)
    first = np.append(True, rows[1:].astype(np.int64) * wide + starts[1:] > reach[:-1])
    at = np.flatnonzero(first)
    return rows[at], starts[at], reach[np.append(at[1:] - 1, len(rows) - 1)] - rows[at].astype(np.int64) * wide


class Group:
    """The documents of one group in their order: by id, null last, then by bytes."""

    def __init__(self, table: pa.Table, length: int, k: int):
        table = table.combine_chunks()
        ids = table["doc_id"].to_numpy(zero_copy_only=False) if not table["doc_id"].null_count else np.array([np.iinfo(np.int64).max if x is None else x for x in table["doc_id"].to_pylist()], np.int64)
        data, offsets = flat(table["text"])
        texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.texts = [texts[i] for i in order]
        self.ids = ids.astype(np.int64)[order]
        self.null = np.array([x is None for x in table["doc_id"].to_pylist()], bool)[order]
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.offsets = np.append(0, np.cumsum([len(x) for x in self.texts])).astype(np.int64)
        self.length, self.k = length, k

    def runs(self) -> Iterator[tuple[np.ndarray, ...]]:
        return runs(self.data, self.offsets, self.length, self.k)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(buckets[part[0]]), part


def distinct_runs(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """For each run, the first run that has the same bytes. Runs come in their order."""
    first = np.arange(len(starts))
    for count in np.unique(counts):
        of = np.flatnonzero(counts == count)
        keys = strings(data, starts[of], length + int(count) - 1)
        _, at, back = np.unique(keys, return_index=True, return_inverse=True)
        first[of] = of[at][back]
    return first


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K, with_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary), a row for each row of docs; kept is
    null unless with_bytes.

    A byte is removed if it is in a string of `length` bytes that also starts earlier: in a row with a smaller
    id, or further on the left in the same row. Strings don't cross rows and are judged on the input. Null
    texts are empty; rows with a null id count as last, rows with one id in the order of their bytes, and
    repeated rows stay repeated (all but the first lose what is long enough); an empty table gives no rows. Only
    the id and text columns are read, so others may have any name."""
    spark = docs.sparkSession
    n = partitions(spark)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = int(chosen.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    groups, buckets = max(PER_PARTITION * n, -(-total // GROUP_BYTES)), max(n, -(-total // BUCKET_BYTES))
    own = F.pmod(F.xxhash64(F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text"))), F.lit(groups))
    dealt = chosen.withColumn("g", own).repartition(n, "g")

    def anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = Group(table, length, k)
        found, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *[h for *_, h in group.runs()]]), return_counts=True)
        rows = [(b, found[at], count[at]) for b, at in by_bucket(bucket_of(found, buckets))]
        many = [np.stack([np.flatnonzero(n >= TOLD_RUNS), n[n >= TOLD_RUNS]]).astype(np.int32) for _, _, n in rows]
        return pa.table({"b": pa.array([b for b, _, _ in rows], pa.int64()), "g": pa.array([key[0].as_py()] * len(rows), pa.int64()), "hashes": pa.array([x.tobytes() for _, x, _ in rows], pa.binary()), "many": pa.array([x.tobytes() for x in many], pa.binary())})

    def candidates(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        each = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        many = [np.frombuffer(x, np.int32).reshape(2, -1) for x in table["many"].to_pylist()]
        rows = [(g, *x) for g, x in zip(table["g"].to_pylist(), shared_anchors(each, many, HOT_GROUPS), strict=True)]
        rows = [x for x in rows if len(x[1])]
        return pa.table({"g": pa.array([g for g, _, _ in rows], pa.int64()), "twice": pa.array([x.tobytes() for _, x, _ in rows], pa.binary()), "hot": pa.array([x.tobytes() for _, _, x in rows], pa.binary())})

    def cut_finer(data: np.ndarray, rows: np.ndarray, starts: np.ndarray, counts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs cut by where their strings have the anchor; each cut with a hash of what its strings share."""
        out = []
        for j in range((length - k) // CUT + 1):
            # strings that start CUT * j to CUT * j + CUT - 1 before the anchor
            lo = np.maximum(starts, places - CUT * j - CUT + 1)
            hi = np.minimum(starts + counts - 1, places - CUT * j)
            kept = np.flatnonzero(lo <= hi)
            if len(kept):
                core = hash_strings(data, places[kept] - CUT * j, length - CUT + 1)
                out.append((rows[kept], lo[kept], hi[kept] - lo[kept] + 1, core))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def candidate_runs(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        names = ("b", "g", "rows", "ids", "starts", "counts", "text", "done")
        if not table.num_rows:
            return pa.table({x: pa.array([], t) for x, t in zip(names, run_types, strict=True)})
        group, g = Group(table, length, k), key[0].as_py()
        join = lambda name: np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in told[name].to_pylist()]]))
        twice, hot = join("twice"), join("hot")
        every = [np.concatenate(x) for x in zip(*group.runs(), strict=True)] or [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
        found, count = np.unique(every[4], return_counts=True)
        kept = np.flatnonzero(np.isin(every[4], np.union1d(twice, found[count > 1])))
        rows, starts, counts, places, h = (x[kept] for x in every)
        finer = np.isin(h, hot)
        if finer.any():
            fine = cut_finer(group.data, *(x[finer] for x in (rows, starts, counts, places)))
            rows, starts, counts, h = (np.concatenate([a[~finer], b]) for a, b in zip((rows, starts, counts, h), fine, strict=True))
        order = np.argsort(starts, kind="stable")
        rows, starts, counts, h = (x[order] for x in (rows, starts, counts, h))
        first = np.arange(len(starts))
        for lo in range(0, len(starts), RUNS):
            first[lo : lo + RUNS] = lo + distinct_runs(group.data, starts[lo : lo + RUNS], counts[lo : lo + RUNS], length)
        still = np.flatnonzero(first == np.arange(len(first)))
        if len(starts) > RUNS:
            first[still] = still[distinct_runs(group.data, starts[still], counts[still], length)]
        again = first != np.arange(len(first))
        done = spans_of(rows[again], starts[again] - group.offsets[rows[again]], starts[again] - group.offsets[rows[again]] + counts[again] + length - 1)
        sent = np.flatnonzero(~again)
        out = [(int(bucket_of(np.array([g * 2654435761], np.uint64), buckets)[0]), b"", b"", b"", b"", b"", pack_spans(done))] if len(done[0]) else []
        for b, at in by_bucket(bucket_of(h[sent], buckets)):
            i = sent[at]
            text = b"".join([group.data[s : s + c + length - 1].tobytes() for s, c in zip(starts[i].tolist(), counts[i].tolist(), strict=True)])
            out.append((b, rows[i].astype(np.int32).tobytes(), group.ids[rows[i]].tobytes(), (starts[i] - group.offsets[rows[i]]).astype(np.int32).tobytes(), counts[i].astype(np.int32).tobytes(), text, b""))
        columns = list(zip(*out, strict=True)) if out else [[] for _ in range(7)]
        columns.insert(1, [g] * len(out))
        return pa.table({x: pa.array(v, t) for x, v, t in zip(names, columns, run_types, strict=True)})

    run_types = (pa.int64(), pa.int64(), *[pa.binary()] * 6)

    def pack_spans(spans: tuple[np.ndarray, ...]) -> bytes:
        return np.stack([x.astype(np.int32) for x in spans]).tobytes()

    def index(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        read = lambda name, kind: [np.frombuffer(x, kind) for x in table[name].to_pylist()]
        parts = list(zip(table["g"].to_pylist(), *[read(x, t) for x, t in (("rows", np.int32), ("ids", np.int64), ("starts", np.int32), ("counts", np.int32), ("text", np.uint8), ("done", np.int32))], strict=True))
        out = [(g, done.tobytes()) for g, *_, done in parts if len(done)]
        parts = [x for x in parts if len(x[1])]
        if parts:
            g = np.concatenate([np.full(len(x[1]), x[0], np.int64) for x in parts])
            rows, ids, starts, counts, text = (np.concatenate([x[i] for x in parts]) for i in range(1, 6))
            counts = counts.astype(np.int64)
            begins = np.cumsum(counts + length - 1) - (counts + length - 1)
            order = np.lexsort((starts, rows, g, ids))
            g, rows, starts, counts, begins = (x[order] for x in (g, rows, starts, counts, begins))
            spans = repeated_spans(text, begins, counts, length)
            for of, lo, hi in [spans] if len(spans[0]) else []:
                for group, at in by_bucket(g[of]):
                    out.append((group, pack_spans(spans_of(rows[of[at]], starts[of[at]] + lo[at], starts[of[at]] + hi[at]))))
        return pa.table({"g": pa.array([x for x, _ in out], pa.int64()), "spans": pa.array([x for _, x in out], pa.binary())})

    def remove(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        group = Group(table, length, k)
        spans = [np.frombuffer(x, np.int32).reshape(3, -1) for x in told["spans"].to_pylist()]
        rows, starts, ends = spans_of(*np.concatenate(spans, axis=1).astype(np.int64)) if spans else (np.zeros(0, np.int64),) * 3
        cuts = np.searchsorted(rows, np.arange(len(group.texts) + 1))
        out = []
        for i, text in enumerate(group.texts):
            own = list(zip(starts[cuts[i] : cuts[i + 1]].tolist(), ends[cuts[i] : cuts[i + 1]].tolist(), strict=True))
            past, kept = 0, []
            for a, b in own:
                kept.append(text[past:a])
                past = b
            kept = b"".join([*kept, text[past:]])
            out.append((None if group.null[i] else int(group.ids[i]), len(text), len(text) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        return pa.table({x: pa.array(v, t) for x, v, t in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"), columns, kinds, strict=True)})

    told = dealt.groupBy("g").applyInArrow(anchors, "b long, g long, hashes binary, many binary").groupBy("b").applyInArrow(candidates, "g long, twice binary, hot binary")
    sent = dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(candidate_runs, "b long, g long, rows binary, ids binary, starts binary, counts binary, text binary, done binary")
    spans = sent.groupBy("b").applyInArrow(index, "g long, spans binary")
    return dealt.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def shared_anchors(each: list[np.ndarray], many: list[np.ndarray], least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each group's distinct anchors: those that another group has, and the hot ones, at which all together have
    `least` runs. many: which of a group's anchors have several runs, and how many."""
    runs_of = [np.ones(len(x), np.int64) for x in each]
    for own, (at, n) in zip(runs_of, many, strict=True):
        own[at] = n
    every = np.concatenate(each)
    order = np.argsort(every)
    first = np.flatnonzero(np.append(True, every[order[1:]] != every[order[:-1]]))
    size = np.diff(np.append(first, len(every)))
    twice, hot = np.empty(len(every), bool), np.empty(len(every), bool)
    twice[order] = np.repeat(size > 1, size)
    hot[order] = np.repeat(np.add.reduceat(np.concatenate(runs_of)[order], first) >= least, size)
    ends = np.cumsum([len(x) for x in each]).tolist()
    return [(x[twice[e - len(x) : e]], x[hot[e - len(x) : e]]) for x, e in zip(each, ends, strict=True)]


def hash_strings(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each string of one width, the same wherever it stands."""
    out = np.zeros(len(starts), np.uint64)
    padded = -(-width // 8) * 8
    for lo in range(0, len(starts), RUNS):
        held = strings(data, starts[lo : lo + RUNS], width).astype(f"S{padded}")
        words = held.view(np.uint64).reshape(-1, padded // 8)
        for i in range(words.shape[1]):
            h = (out[lo : lo + RUNS] ^ words[:, i]) * np.uint64(0xD6E8FEB86659FD93)
            out[lo : lo + RUNS] = h ^ (h >> np.uint64(32))
    return out


def may_repeat(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which strings have a hash that another of them has; false only for strings that none equals. A table of a few
    slots a string holds who came last to a slot; who finds another there isn't alone."""
    low = np.uint64(64 - max(16, (4 * len(starts) - 1).bit_length()))
    slots = np.empty(len(starts), np.int64)
    begin = int(starts.min()) if len(starts) else 0
    end = int(starts.max()) + 1 if len(starts) else 0
    by = np.argsort(starts, kind="stable")
    cuts = np.searchsorted(starts[by], np.arange(begin, end + CHUNK, CHUNK))
    for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if a < b:
            lo = begin + i * CHUNK
            h = gram_hashes(text[lo : lo + CHUNK + length - 1], length)
            slots[by[a:b]] = (h[starts[by[a:b]] - lo] >> low).astype(np.int64)
    mine = np.arange(len(starts), dtype=np.int32 if len(starts) < 1 << 31 else np.int64)
    last = np.zeros(1 << int(np.uint64(64) - low), mine.dtype)
    last[slots] = mine
    shared = np.zeros(len(last), bool)
    shared[slots[last[slots] != mine]] = True
    return shared[slots]


def repeated_spans(text: np.ndarray, begins: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs in their order: (run, start, end) of what its strings cover that also are earlier, start and end
    relative to the run."""
    first = distinct_runs(text, begins, counts, length)
    again = np.flatnonzero(first != np.arange(len(first)))
    found = [(again, np.zeros(len(again), np.int64), counts[again] + length - 1)]
    fresh = np.flatnonzero(first == np.arange(len(first)))
    levels = SuffixLevels(text, length)
    n = counts[fresh]
    of = np.repeat(fresh.astype(levels.kind), n)
    starts = (np.arange(n.sum()) + np.repeat(begins[fresh] - (np.cumsum(n) - n), n)).astype(levels.kind)
    kept = np.flatnonzero(may_repeat(text, starts, length))
    of, starts = of[kept], starts[kept]
    # a batch is as large as all before it together, so that scans of the levels cost in proportion
    cuts, edge = [], BATCH
    while edge < len(starts):
        cuts.append(edge)
        edge += min(edge, LARGEST_BATCH)
    for lo, hi in zip([0, *cuts], [*cuts, len(starts)], strict=True):
        hit = levels.add(starts[lo:hi])
        row = of[lo:hi][hit].astype(np.int64)
        at = starts[lo:hi][hit] - begins[row]
        found.append(spans_of(row, at, at + length))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
