"""Exact substrings, near-duplicate passages and SimHash against brute force."""

import hashlib
import random
import sys

import numpy as np
import pytest
import xxhash

from lodesift.llm import simhash, substring, suffix_dedup
from lodesift.llm.components import connected_components

SCHEMA = "doc_id long, text string, source string, fp long, g long"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], SCHEMA)


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}é" if rng.random() < 0.1 else f"w{rng.randrange(size)}" for _ in range(n)]


def corpus(seed, n=60):
    rng = random.Random(seed)
    shared = " ".join(words(rng, 70, 10**6))
    line = " ".join(words(rng, 14, 10**6))
    out = []
    for i in range(n):
        text = " ".join(words(rng, rng.randrange(0, 120), 10**6))
        if i % 3 == 0:
            text = f"{text} {shared} {i}"
        if i % 4 == 0:
            text = f"{line} {text}"
        if i % 7 == 0 and out:
            text = out[-1][1]
        out.append((i, text))
    out += [(n, None), (n + 1, ""), (n + 2, "ab" * 300), (n + 3, "ab" * 160 + "c"), (n + 4, "x" * 99), (n + 5, "x" * 100), (n + 5, "x" * 100), (None, shared), (None, shared)]
    return out


def brute_removed(rows, length):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, (rows[i][1] or "").encode()))
    seen, out = set(), [None] * len(rows)
    for i in order:
        b = (rows[i][1] or "").encode()
        mark = np.zeros(len(b) + 1, np.int64)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                mark[s] += 1
                if s + length < len(mark):
                    mark[s + length] -= 1
            seen.add(w)
        gone = np.cumsum(mark)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (rows[i][0], len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


key = lambda x: tuple((v is None, v) for v in x)


@pytest.mark.parametrize("hot", [1, 64])
def test_suffix_dedup_is_exact(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_GROUPS", hot)
    rows = corpus(hot)
    got = suffix_dedup.remove_repeats(docs_frame(spark, rows)).drop("kept").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_removed(rows, 100), key=key)


def test_suffix_dedup_cuts_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    monkeypatch.setattr(suffix_dedup, "RUNS", 50)
    monkeypatch.setattr(suffix_dedup, "BATCH", 64)
    group = corpus(5, 30)
    import pyarrow as pa

    table = pa.table({"doc_id": pa.array([i for i, _ in group], pa.int64()), "text": pa.array([t for _, t in group])})
    parts = suffix_dedup.Group(table, 100, 48)
    data = parts.data
    runs = [np.concatenate(x) for x in zip(*parts.runs(), strict=True)]
    assert runs[2].sum() == sum(max(0, len(t) - 99) for t in parts.texts)
    of, lo, hi = suffix_dedup.repeated_spans(data, runs[1], runs[2], 100)
    gone = np.zeros(len(data), bool)
    for r, a, b in zip(of, lo, hi, strict=True):
        gone[runs[1][r] + a : runs[1][r] + b] = True
    assert int(gone.sum()) == sum(x[2] for x in brute_removed(group, 100))


@pytest.mark.parametrize("length", [4, 8, 13, 20])
def test_suffix_levels_grow_geometrically(length):
    rng = np.random.default_rng(length)
    text = rng.integers(97, 99 if length > 4 else 101, 4000).astype(np.uint8)
    text[2000:2100] = text[500:600]
    levels, seen = suffix_dedup.SuffixLevels(text, length), set()
    for batch in np.array_split(rng.permutation(len(text) - length + 1), 40):
        expected = []
        for at in batch.tolist():
            expected.append(text[at : at + length].tobytes() in seen)
            seen.add(text[at : at + length].tobytes())
        assert levels.add(batch).tolist() == expected
    sizes = [len(x) for x in levels.levels]
    assert sum(sizes) == len(seen) and len({s.bit_length() for s in sizes}) == len(sizes)
    assert all(x.dtype == np.int32 for x in levels.levels)
    for level in levels.levels:
        held = [text[at : at + length].tobytes() for at in level.tolist()]
        assert held == sorted(held)


def test_equal_strings_are_sorted_once(monkeypatch):
    text = np.random.default_rng(3).integers(97, 123, 5000).astype(np.uint8)
    text, asked, argsort = np.tile(text, 8), [], np.argsort
    levels = suffix_dedup.SuffixLevels(text, 100)
    starts = (np.arange(8)[:, None] * 5000 + np.arange(4900)).ravel()
    monkeypatch.setattr(suffix_dedup.np, "argsort", lambda x, **kw: asked.append(len(x)) or argsort(x, **kw))
    assert levels.add(starts).tolist() == (starts >= 5000).tolist()
    assert sum(asked) < 2 * len(starts)  # by each of 13 words before


def test_anchors_are_hot_by_their_runs_not_by_groups():
    few, hot, own = (np.array([x], np.uint64) for x in (5, 9, 7))
    each = [np.concatenate([few, hot])] * 200 + [own]
    many = [np.array([[1], [100]], np.int32)] * 200 + [np.zeros((2, 0), np.int32)]
    got = suffix_dedup.shared_anchors(each, many, suffix_dedup.HOT_GROUPS)
    assert all(twice.tolist() == [5, 9] and finer.tolist() == [9] for twice, finer in got[:-1])
    assert [x.tolist() for x in got[-1]] == [[], []]


def test_strings_that_may_repeat(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    rng = np.random.default_rng(4)
    text = rng.integers(97, 123, 6000).astype(np.uint8)
    text[4000:4300] = text[100:400]
    starts = rng.permutation(np.arange(0, 5900))
    may = suffix_dedup.may_repeat(text, starts, 100)
    assert may[((starts >= 100) & (starts <= 300)) | ((starts >= 4000) & (starts <= 4200))].all() and may.mean() < 0.5
    assert suffix_dedup.may_repeat(text, starts[:0], 100).tolist() == []


def test_empty_tables(spark):
    empty = docs_frame(spark, [])
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert substring.near_duplicate_passages(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def brute_windows(h, least):
    """(l, r) -> place of the minimum for each subsequence of at least `least`."""
    return {(i, j): i + int(np.argmin(h[i : j + 1])) for i in range(len(h)) for j in range(i + least - 1, len(h))}


def test_compact_windows_cover_each_subsequence_once():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 62, 90).astype(np.uint64) << np.uint64(1)
    offsets = np.array([0, 50, 54, 90])
    rows, lo, c, hi = substring.compact_windows(h, offsets, 6)
    for row in range(3):
        a, b = offsets[row], offsets[row + 1]
        want = {(i + a, j + a): k + a for (i, j), k in brute_windows(h[a:b], 6).items()}
        got = {}
        for x, y, z in zip(lo[rows == row], c[rows == row], hi[rows == row], strict=True):
            for i in range(x, y + 1):
                for j in range(max(y, i + 5), z + 1):
                    assert (i, j) not in got
                    got[i, j] = y
        assert got == want


def test_shingles_follow_words():
    text = "A b\tC d e\x0bf é G".encode()
    one, offsets = substring.shingles(np.frombuffer(text + b"a b c d e f", np.uint8), np.array([0, len(text), len(text) + 11]))
    assert offsets.tolist() == [0, 4, 6]
    assert one[0] == one[4] and one[1] == one[5] and len(set(one.tolist())) == 4


def test_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(9)
    passage, other = words(rng, 60, 10**6), words(rng, 120, 10**6)
    edited = other[:60] + ["changed"] + other[61:]
    rows = []
    for i in range(40):
        own = words(rng, 80, 10**6)
        if i in (3, 17, 29):
            own = own[:30] + passage + own[30:]
        if i == 5:
            own += other
        if i == 31:
            own = edited + own
        if i in (8, 9):
            own = own[:20] + passage[:40] + own[20:]
        rows.append((i, " ".join(own)))
    rows += [(40, None), (41, ""), (None, " ".join(passage))]
    every = substring.near_duplicate_passages(docs_frame(spark, rows)).collect()
    assert sorted(r.doc_id is None or r.doc_id for r in every) == sorted(i is None or i for i, _ in rows)
    assert all(r.class_id == r.doc_id and r.class_size == 1 and r.spans == [] for r in every if not r.n_passages)
    got = {r.doc_id: r for r in every if r.n_passages}
    assert sorted(got, key=str) == [17, 29, 3, 31, 5, None]
    assert {(got[i].class_id, got[i].class_size) for i in (3, 17, 29, None)} == {(3, 4)} and {got[i].class_id for i in (5, 31)} == {5}
    for i in (3, 17, 29):
        assert any(s.start <= 32 and s.end >= 88 for s in got[i].spans)


def test_variants_of_a_passage_are_joined_each(spark):
    rng = random.Random(12)
    one = words(rng, 60, 10**6)
    rows = []
    for i in range(60):
        variant = list(one)
        for k in (12, 24, 36, 48):
            variant[k] = f"x{i % 20}y{k}"
        rows.append((i, " ".join(words(rng, 30, 10**6) + variant + words(rng, 30, 10**6))))
    got = {r.doc_id: r.class_id for r in substring.near_duplicate_passages(docs_frame(spark, rows)).collect()}
    assert got == {i: i % 20 for i in range(60)}


def test_each_place_of_a_passage_is_a_span(spark):
    rng = random.Random(21)
    some = lambda n: words(rng, n, 10**6)
    twice, one, two = some(60), some(60), some(60)
    rows = [(0, some(30) + twice + some(90) + twice + some(30)), (1, some(80) + twice + some(20))]
    rows += [(2, some(10) + one + some(25) + two + some(10)), (3, some(10) + one + some(25) + two + some(10))]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in substring.near_duplicate_passages(docs_frame(spark, [(i, " ".join(t)) for i, t in rows])).collect()}
    holds = lambda i, lo, hi: any(a <= lo + 2 and b >= hi - 2 for a, b in got[i])
    assert holds(0, 30, 90) and holds(0, 180, 240) and holds(1, 80, 140)
    for i in (2, 3):
        assert holds(i, 10, 70) and holds(i, 95, 155)


def test_all_passages_of_two_sequences_are_verified():
    x, y = plain_hashes(60, 1), plain_hashes(60, 2)
    a, b = (np.concatenate([x, plain_hashes(30, k), y]) for k in (3, 4))
    got = sorted(t[:4] for t in substring.every_verified(a, b, 46, 0.8))
    assert got == [(0, 60, 0, 60), (90, 150, 90, 150)]
    got = sorted(t[:4] for t in substring.every_verified(np.concatenate([x, plain_hashes(30, 3), x]), x, 46, 0.8))
    assert got == [(0, 60, 0, 60), (90, 150, 0, 60)]


def _similar_passage(a, b, words=50):
    """Whether two word lists have runs of so many words with a Jaccard similarity of their shingles of 0.8, brute force
    over runs of some lengths."""
    grams = lambda x: [tuple(x[i : i + 5]) for i in range(len(x) - 4)]
    x, y = grams(a), grams(b)
    for n in (46, 52, 60):
        ours = [set(x[i : i + n]) for i in range(0, len(x) - n + 1, 2)]
        theirs = [set(y[i : i + n]) for i in range(0, len(y) - n + 1, 2)]
        if any(len(p & q) >= 0.8 * len(p | q) for p in ours for q in theirs):
            return True
    return False


def test_classes_of_passages_against_brute_force(spark):
    """Families of versions, exact and edited, long and short, shuffled among texts with a common line, two of them in
    one document: what brute force links is in one class, and no class holds texts of two families or of none."""
    rng = random.Random(31)
    some = lambda n: words(rng, n, 10**6)
    line, rows = some(14), []
    for family in range(12):
        base = some(rng.choice((60, 75, 120)))
        for _ in range(rng.randrange(2, 5)):
            version = list(base)
            if rng.random() < 0.5:
                version[rng.randrange(len(version))] = "edited"
            rows.append((family, some(rng.randrange(40)) + (line if rng.random() < 0.6 else []) + version + some(rng.randrange(40))))
    rows += [(None, some(60) + line + some(60)) for _ in range(25)] + [(None, some(20))] * 3
    rng.shuffle(rows)
    families, rows = zip(*rows, strict=True)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if _similar_passage(rows[i], rows[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    got = {r.doc_id: r for r in substring.near_duplicate_passages(docs_frame(spark, [(i, " ".join(t)) for i, t in enumerate(rows)])).collect()}
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if root(i) == root(j)]
    assert sum(got[i].class_id == got[j].class_id for i, j in pairs) >= 0.98 * len(pairs) and len(pairs) > 30
    for i, r in got.items():
        assert families[r.class_id] == families[i] and (families[i] is not None or (r.class_size, r.n_passages) == (1, 0))


@pytest.mark.parametrize("others", [3, 24])
def test_versions_less_like_the_first_are_linked(spark, others):
    """Two versions that differ in the word in the middle, and others of the same passage that are like none, each in
    its own surroundings: whichever comes first in a value's windows, the two are one class and the others none."""
    rng = random.Random(41)
    some = lambda n: words(rng, n, 10**6)
    rows, pairs = [], []
    for family in range(240 // (others + 2)):
        base = some(56)
        for i in range(others + 2):
            version = list(base)
            for k in (28,) if i == 0 else () if i == 1 else (9 + i % 4, 23 + i % 5, 38 + i % 6):
                version[k] = f"edit{family}_{i}_{k}"
            rows.append(some(30) + version + some(30))
        pairs.append((len(rows) - others - 2, len(rows) - others - 1))
    order = list(range(len(rows)))
    rng.shuffle(order)
    got = {r.doc_id: r for r in substring.near_duplicate_passages(docs_frame(spark, [(i, " ".join(rows[i])) for i in order])).collect()}
    linked = [got[i].class_id == got[j].class_id == i and got[i].class_size == 2 for i, j in pairs]
    assert sum(linked) >= 0.95 * len(pairs)  # agreement of enough functions has a probability
    assert all(got[i].class_id == i and got[i].class_size == 1 for i in set(order) - {i for pair in pairs for i in pair})


def test_places_of_a_value_are_compared_whole():
    """The second step against all pairs, among places of which most share a line and no more."""
    rng = np.random.default_rng(5)
    line = rng.integers(0, 1 << 32, 20).astype(np.uint32)
    around = rng.integers(0, 1 << 32, (300, 129)).astype(np.uint32)
    around[:, 55:75] = line
    for k in range(60, 100):  # versions that differ in few places from one a few rows before
        around[k] = around[k - rng.integers(1, 30)]
        for at in rng.choice(129, 3, replace=False):
            around[k, at : at + 5] = rng.integers(0, 1 << 32, len(around[k, at : at + 5]))
    around[:, 64] = line[9]
    size = np.full((300, 2), 64)
    size[150:] = 50, 30
    key, label = np.arange(300) // 2 * 2 + np.arange(300) % 2, np.arange(300) + 1000
    expected = list(range(300))

    def root(up, i):
        while up[i] != i:
            i = up[i]
        return i

    cut = lambda i: around[i, 64 - size[i, 0] : 65 + size[i, 1]]
    for i in range(300):
        for j in range(i):
            if np.isin(cut(i), cut(j)).sum() >= 30 and substring._like(cut(i), cut(j), 46, 0.8):
                expected[max(root(expected, i), root(expected, j))] = min(root(expected, i), root(expected, j))
    found, n = list(range(300)), 0
    for i, j, p, q, x, y in substring.unlinked(key, label, around, size, 46, 0.8):
        a, b = set(around[i, p:q].tolist()), set(around[j, x:y].tolist())
        assert len(a & b) >= 0.8 * len(a | b) and min(q - p, y - x) >= 46
        found[max(root(found, i), root(found, j))] = min(root(found, i), root(found, j))
        n += 1
    assert [root(found, i) for i in range(300)] == [root(expected, i) for i in range(300)]
    assert 10 < n == 300 - len({root(found, i) for i in range(300)})


def test_places_that_share_a_line_are_compared_many_at_once():
    """The second step against all pairs where places share a line just too short, or repeat a stretch with too little in
    common: what rules pairs out is computed for many of them at once, not place by place."""
    rng = np.random.default_rng(8)
    n = 200
    around = rng.integers(0, 1 << 32, (n, 129)).astype(np.uint32)
    around[:, 45:84] = rng.integers(0, 1 << 32, 39).astype(np.uint32)
    around[::2, :10] = around[0, :10]
    around[::2] = np.tile(around[::2, :12], 11)[:, :129]
    for k in range(100, 120):  # versions of a place before
        around[k] = around[k - 40]
        around[k, 126:] = rng.integers(0, 1 << 32, 3)
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if root(i) != root(j) and substring._like(around[i], around[j], 46, 0.8):
                up[max(root(i), root(j))] = min(root(i), root(j))
    expected, up, calls = [root(i) for i in range(n)], list(range(n)), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = list(substring.unlinked(np.arange(n), np.arange(n) + 1000, around, np.full((n, 2), 64), 46, 0.8))
    finally:
        sys.setprofile(None)
    for i, j, *_ in found:
        up[max(root(i), root(j))] = min(root(i), root(j))
    assert [root(i) for i in range(n)] == expected
    assert len(found) == n - len(set(expected)) >= 20
    assert calls < 40 * n


def plain_hashes(n, seed):
    return np.random.default_rng(seed).integers(0, 1 << 62, n).astype(np.uint64)


@pytest.mark.parametrize(("n", "more"), [(64, 4), (70, 5), (75, 6), (85, 8)])
def test_one_sided_insertions_are_near_duplicates(n, more):
    text = [f"a{k}" for k in range(n)]
    longer = text[: n // 2] + [f"b{k}" for k in range(more)] + text[n // 2 :]
    h, offsets = substring.shingles(np.frombuffer(" ".join(text).encode() + " ".join(longer).encode(), np.uint8), np.array([0, len(" ".join(text)), len(" ".join(text)) + len(" ".join(longer))]))
    a, b = h[: offsets[1]], h[offsets[1] :]
    want = (n - 8) / (n - 4 + more + 4)
    assert want >= 0.8
    for x, y in ((a, b), (b, a)):
        p, q, i, j, jaccard = substring.verified(x, y, 46, 0.8)
        assert (p, q, i, j) == (0, len(x), 0, len(y)) and jaccard == pytest.approx(want)


def test_dissimilar_passages_are_not_verified():
    a, b = plain_hashes(60, 1), plain_hashes(60, 1)
    b[::4] = plain_hashes(15, 2)
    assert substring.verified(a, b, 46, 0.8) is None


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found, word = [], ""
    for c in lowered + " ":
        if c == " " or 9 <= ord(c) <= 13:
            found += [word] if word else []
            word = ""
        else:
            word += c
    if not found:
        return 0
    grams = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 40), 30))) for i in range(120)]
    base = words(rng, 300)
    for i in range(120, 180):
        edited = list(base)
        for _ in range(rng.randrange(3)):
            edited[rng.randrange(300)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(edited)))
    rows += [(180, None), (181, " \t\x0b"), (182, "A B\x1cC Ä"), (5, rows[5][1])]
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), 10**9))
    want = sorted((doc_id, f"{p:016x}", least[find(i)]) for i, ((doc_id, _), p) in enumerate(zip(rows, prints, strict=True)))
    assert sorted(map(tuple, simhash.near_duplicates(docs_frame(spark, rows)).collect())) == want


def test_ring_links_with_large_groups(monkeypatch):
    monkeypatch.setattr(simhash, "LISTED", 8)
    rng = np.random.default_rng(2)
    near = np.unique(np.array([0xABCD123400000000], np.uint64) | rng.integers(0, 1 << 10, 300).astype(np.uint64))
    far = np.unique(rng.integers(0, 1 << 63, 100).astype(np.uint64))
    fps = np.unique(np.concatenate([near, far, near[:50] ^ np.uint64(1 << 33)]))
    got = simhash.ring_links(fps)
    forest = simhash.Forest(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3):
            forest.link(i, int(j))
    # all links of these lie in chains from the first segment, as only later segments differ
    assert np.array_equal(got, forest.roots())


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, j) for j in range(51, 90)] + [(7, 7), (100, 101), (101, 100), (None, 3)], "src long, dst long")
    got = dict(map(tuple, connected_components(links).collect()))
    assert got == {i: 1 for i in range(1, 31)} | {i: 50 for i in range(50, 90)} | {100: 100, 101: 100}
