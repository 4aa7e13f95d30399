"""ZIP64 archives, media formats, odd rows."""

import base64
import hashlib
import io
import random
import struct
import time
import zipfile
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodesift.llm import ann, langid, media, mixing, packing, secrets, simhash, substring, suffix_dedup, warc


@pytest.mark.parametrize("zip64", [False, True])
def test_archives_are_read_by_range(zip64):
    rng = random.Random(3)
    records = [(i, rng.randbytes(rng.randrange(3000))) for i in range(50)] + [(None, b"")]
    out = io.BytesIO()
    warc.write_archive(out, iter(records), zip64)
    data = out.getvalue()
    assert (b"PK\6\6" in data and b"PK\6\7" in data) == zip64
    assert list(warc.read_records(warc.BytesReader(data))) == [x for _, x in records]
    with zipfile.ZipFile(io.BytesIO(data)) as other:
        assert other.testzip() is None and other.namelist() == [warc.DATA, warc.INDEX]


def test_archives_that_others_have_made():
    made = io.BytesIO()
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    body = member.compress(b"record") + member.flush()
    with zipfile.ZipFile(made, "w") as z:
        z.comment = b"a comment with PK\5\6 in it"
        with z.open(zipfile.ZipInfo(warc.DATA), "w", force_zip64=True) as f:
            f.write(b"junk" + body)
        z.writestr(warc.INDEX, '1 {"offset": 4, "length": %d, "filename": "%s"}\n' % (len(body), warc.DATA))
    assert list(warc.read_records(warc.BytesReader(made.getvalue()))) == [b"record"]
    with pytest.raises(ValueError, match="central directory"):
        warc.zip_members(warc.BytesReader(b"no archive"))


def test_warc_of_odd_rows(spark):
    rows = [(1, "u", "a" * 3_000_000), (1, "u", "a" * 3_000_000), (None, "u", "same"), (7, None, "same"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("archive", F.lit("x")).withColumn("last", F.lit(2))
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert got == Counter({(1, 3_000_000, "response", None): 2, (None, 4, "revisit", 7): 1, (7, 4, "response", None): 1, (None, 0, "response", None): 1})
    assert warc.round_trip(pages.limit(0)).count() == 0


def _png():
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def _zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "text" * 9)
    return out.getvalue()


def _ogg():
    page = lambda flags: b"OggS\0" + bytes([flags]) + b"\0" * 20 + bytes([2, 3, 4]) + b"1234567"
    return page(2) + page(4)


SAMPLES = {
    "image/png": _png(),
    "image/gif": b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + b"\0" * 8 + b"\0" + b"\2\2\x44\1\0" + b"\x3b",
    "image/jpeg": b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\2entropy\xff\0more\xff\xd0x\xff\xd9",
    "image/bmp": b"BM" + struct.pack("<IIII", 60, 0, 54, 40) + b"\0" * 42,
    "image/webp": b"RIFF" + struct.pack("<I", 16) + b"WEBPVP8 " + struct.pack("<I", 4) + b"abcd",
    "audio/wav": media.to_wav(b"\x80" * 9),
    "audio/ogg": _ogg(),
    "application/pdf": b"%PDF-1.4\n1 0 obj\nstartxref\n0\n%%EOF",
    "application/zip": _zipped(),
    "application/gzip": __import__("gzip").compress(b"text" * 50, mtime=0),
}


@pytest.mark.parametrize("kind", SAMPLES)
def test_formats_are_confirmed_and_carved(kind):
    whole = SAMPLES[kind]
    assert media.sniff(whole, "text/plain")[:2] == (kind, len(whole))
    for cut in (whole[:-1], whole[: len(whole) // 2]):
        assert media.sniff(cut)[0] != kind
    around = b"before " + whole + b" after"
    assert media.confirmed(around) == [(7, len(whole), kind)]


def test_types_are_corrected_and_media_carved(spark):
    png, pdf = SAMPLES["image/png"], SAMPLES["application/pdf"]
    rows = [(1, "image/gif", png), (2, "text/plain", b"x" + png + b"y" + pdf), (3, "image/png", b"plain"), (4, "text/plain", None), (5, None, b""), (1, "image/png", png)]
    table = spark.createDataFrame(rows, "key long, kind string, body binary").withColumn("media", F.lit(1)).withColumn("id", F.lit("clash"))
    got = sorted(((r.id, r.media_type, r.corrected, r.length, [(c.media_type, c.start, bytes(c.content)) for c in r.carved]) for r in media.inspected(table, "key", "body", "kind").collect()), key=lambda r: (r[0], r[2]))
    want = [(1, "image/png", False, len(png), []), (1, "image/png", True, len(png), []), (2, "text/plain", False, len(png) + len(pdf) + 2, [("image/png", 1, png), ("application/pdf", len(png) + 2, pdf)])]
    want += [(3, media.UNKNOWN, True, 5, []), (4, "text/plain", False, 0, []), (5, media.UNKNOWN, True, 0, [])]
    assert got == want
    assert media.inspected(table.limit(0), "key", "body").count() == 0


@pytest.mark.parametrize("mark", [b"PK\3\4", b"%PDF-1", b"\xff\xd8\xff\xda\0\2", b"PK\5\6", b"%PDF-1startxref%%EOF"])
def test_marks_cost_in_proportion(mark):
    took = []
    for n in (20_000, 40_000):
        start = time.perf_counter()
        media.sniff(mark * n)
        took.append(time.perf_counter() - start)
    assert took[1] < 3.5 * took[0] + 0.3


CLASH = "doc_id long, text string, lang string, source string, n_chars long, target double, epochs long, source_size long, `range` long, extra long, live string, mark long, key long, found string, root long, fp long, shard int, spans string, g long, b long, label string"
LONG = "ein wort und noch eines " * 20_000
TEXTS = [(1, "the cat sat on the mat and the dog ate the hat", "en"), (2, "der hund und die katze und das haus sind hier", "de"), (3, None, "en"), (4, "", None), (None, "the cat sat", "en"), (5, LONG, "de"), (1, "the cat sat on the mat and the dog ate the hat", "en"), (1, "another text of that id, token=q7Wd93kLmZ0pXs82VbTn", "en")]


def _odd(spark):
    rest = (1, 1.0, 1, 1, 1, 1, "x", 1, 1, "x", 1, 1, 1, "x", 1, 1, "x")
    return spark.createDataFrame([(i, t, lang, "s" if k % 2 else None, *rest) for k, (i, t, lang) in enumerate(TEXTS)], CLASH)


def test_stages_take_odd_rows_and_clashing_names(spark):
    docs = _odd(spark)
    for stage in (langid.accept, simhash.keep_first, secrets.redact, mixing.mixed):
        out = stage(docs)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        out.collect()
        assert stage(docs.limit(0)).count() == 0
    kept = simhash.keep_first(docs).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter({(1, TEXTS[0][1]): 1, (2, TEXTS[1][1]): 1, (3, None): 1, (None, "the cat sat"): 1, (5, LONG): 1, (1, TEXTS[7][1]): 1})
    assert sorted(r.text for r in secrets.redact(docs).where("doc_id = 1").collect()) == sorted([TEXTS[0][1], TEXTS[0][1], "another text of that id, token=[secret]"])
    assert {(r.doc_id, r.text) for r in langid.accept(docs).collect()} == {(i, t) for i, t, _ in TEXTS if t}


def test_operators_take_odd_rows_and_clashing_names(spark):
    docs = _odd(spark)
    n = len(TEXTS)
    for step in (packing.pack, secrets.scan, media.digest, mixing.mix, langid.identify, simhash.near_duplicates, suffix_dedup.remove_repeats, substring.near_duplicate_passages):
        assert step(docs).count() >= n, step.__name__
    spans = {(r.doc_id, r.class_size, r.n_passages) for r in substring.near_duplicate_passages(docs.unionByName(docs.where("doc_id = 5"))).collect()}
    assert (5, 2, 1) in spans and (3, 1, 0) in spans
    few = spark.createDataFrame([(0, [1.0, 2.0], 1), (0, [1.0, 1.0], 2), (20, [3.0], 3), (1, [1.0, 0.0], 4), (2, [5.0], 5)], "vec_id long, embedding array<double>, dim int")
    got = sorted(tuple(r) for r in ann.search(few, "vec_id % 20 = 0").collect())
    assert got == [(0, 1, 1, 1.0), (20, 1, 2, 15.0)]


def test_mixing_of_clashing_names_is_the_mix(spark):
    docs = _odd(spark)
    want = {(r.doc_id, r.size): r.taken for r in mixing.mix(docs).where("doc_id in (2, 5)").collect()}
    got = defaultdict(int)
    for r in mixing.mixed(docs).where("doc_id in (2, 5)").collect():
        got[r.doc_id] += len(r.text.split())
    assert {i: t for (i, _), t in want.items()} == dict(got)


def test_packing_finds_the_tightest_bin_without_conflict():
    rng = random.Random(5)
    bins = packing.Bins(100)
    state: list[list] = []  # room, sources, clusters
    for _ in range(400):
        size, source, cluster = rng.randrange(1, 60), 1 << rng.randrange(6), (1 << 8 + rng.randrange(4)) if rng.random() < 0.3 else 0
        fits = [(room, k) for k, (room, s, c) in enumerate(state) if room >= size and not s & source and not c & cluster]
        number, at = bins.put(size, source, cluster)
        if fits:
            assert state[number][0] == min(fits)[0] and number in {k for _, k in fits}
        else:
            assert number == len(state) and at == 0
            state.append([100, 0, 0])
        assert at == 100 - state[number][0]
        state[number][0] -= size
        state[number][1] |= source
        state[number][2] |= cluster


def test_language_of_texts_against_brute_force(spark):
    rows = [(i, f"{'der hund und das haus' if i % 2 else 'the dog and the house'} {i % 7}", "de" if i % 2 else "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, ~langid.held_out())
    counts, prior = {"de": Counter(), "en": Counter()}, Counter()
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            counts[lang].update(langid.grams(langid.normal(langid.codes(t)), langid.BUCKETS).tolist())
            prior[lang] += 1
    import math

    for r in langid.identify(docs).collect():
        found = langid.grams(langid.normal(langid.codes(rows[r.doc_id][1])), langid.BUCKETS).tolist()
        logs = {}
        for lang, c in counts.items():
            whole = sum(c.values()) + langid.SMOOTHING * langid.BUCKETS
            logs[lang] = math.log((prior[lang] + 1) / (sum(prior.values()) + 2)) + sum(math.log((c[g] + langid.SMOOTHING) / whole) for g in found)
        best = max(sorted(logs), key=logs.get)
        assert r.lang_pred == best and abs(r.score - 1 / sum(math.exp(x - logs[best]) for x in logs.values())) < 1e-3
    assert model.languages == ["de", "en"]


def test_many_secrets_in_one_text_cost_in_proportion(spark):
    one = lambda k: f"token=a{hashlib.md5(str(k).encode()).hexdigest()} "
    took = []
    for n in (4000, 8000):
        docs = spark.createDataFrame([(1, "".join(map(one, range(n))), "s")], "doc_id long, text string, source string")
        start = time.perf_counter()
        row = secrets.scan(docs).first()
        took.append(time.perf_counter() - start)
        assert row.n_assign == n and row.n_live == n
        assert row.spans.startswith(f"assign:0:{len(one(0)) - 1},")
    assert took[1] < 3 * took[0] + 3


def test_digest_of_base32():
    assert warc.base32_sha1(b"") == base64.b32encode(hashlib.sha1(b"").digest()).decode()
