"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import itertools
import math
import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.llm import ann, licenses, lm, media, mixing, neardup, packing, quality, queries, tokens, warc
from locusflow.llm.common import scratch_path, shared_dir, table
from locusflow.llm.pretokens import chunk_ids

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, start long, fp string, size string, leaf int"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns named like results."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, None, None, None, None, 5, "x", "y", 1), (2, "", "en", "b", 0, None, None, None, None), (3, "A b  c\td\x0be\n", "en", "a", 9, 0, "", "", 0),
        (3, "A b  c\td\x0be\n", "en", "a", 9, 0, "", "", 0), (4, "one", "en", "a", 3, 0, "", "", 0), (None, "one", "de", None, 3, 0, "", "", 0),
        (5, long, "fr", "a", len(long), 0, "", "", 0), (6, long + " tail", "fr", "c", len(long), 0, "", "", 0), (7, "é Ünï ñ   x <|endoftext|> y's, \U0001f600.", "es", "b", 9, 0, "", "", 0),
        (8, "x" * 5_000, "en", "b", 5_000, 0, "", "", 0), (9, "   \n\t ", "en", "c", 6, 0, "", "", 0),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(df):
    return [(r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ---------------------------------------------------------------- 1


def payload(text):
    n = max(1, -(-len(text) // 192)) * 192
    return text + b" " * (n - len(text))


def check_media(found, source):
    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found.collect()), key=repr)
    want = sorted(((k, len(t), len(p := payload(t)), sha256(p).hexdigest(), zlib.crc32(p[-16:])) for k, t in texts_of(source)), key=repr)
    assert got == want


def test_media_of_documents(spark, docs):
    check_media(queries.op1_tiff_media(spark, SF), docs)


def test_media_of_odd_rows(odd, empty):
    for source in (odd, empty):
        check_media(media.page_digests(media.decode_pages(media.encode_texts(source), n_bytes_col="n_bytes")), source)


@pytest.mark.parametrize("layout", media.LAYOUTS)
@pytest.mark.parametrize("data", [b" " * 192, bytes(range(192)) * 40, random.Random(1).randbytes(192 * 300), b"ab" * 96 * 700])
def test_tiff_round_trip(layout, data):
    pages = list(media.read_pages(media.write_tiff(data, 100, (layout,))))
    assert b"".join(p.pixels for p in pages) == data and len(pages) == -(-len(data) // 19_200)


def test_full_pages_take_all_forms():
    data = bytes(range(192)) * 16 * 7
    pages = list(media.read_pages(media.write_tiff(data, 16)))
    assert {(p.compression, p.predictor, p.tiled) for p in pages} == {(x.codec, x.predictor, x.tiled) for x in media.LAYOUTS}
    assert b"".join(p.pixels for p in pages) == data


@pytest.mark.parametrize("codec", [media.LZW, media.PACKBITS, media.DEFLATE, media.NONE])
def test_codec_round_trip(codec):
    draw = random.Random(2)
    for n in (1, 2, 3, 127, 128, 129, 130, 5_000, 40_000):
        for data in (draw.randbytes(n), bytes([draw.randrange(4)]) * n, bytes(draw.choice(b"abc ") for _ in range(n))):
            assert media.decode(media.encode(data, codec), codec, n) == data


def test_lzw_widens_codes_where_the_format_does():
    """The 254th code behind a clear code is the last of 9 bits: 255 literals take 9 + 254 * 9 + 10 bits and an end."""
    data = bytes(i % 256 for i in range(255)) + b"\xff"
    bits = 9 + 254 * 9 + 2 * 10 + 10
    assert len(media.lzw(data)) == -(-bits // 8)


def test_big_endian_grey_tiff_without_compression():
    import struct

    fields = [(256, 4, 4), (257, 4, 2), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, 2), (279, 4, 8)]
    entries = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">I", v) if k == 4 else struct.pack(">HH", v, 0)) for t, k, v in fields)
    data = b"MM\0*" + struct.pack(">I", 16) + b"abcdefgh" + struct.pack(">H", len(fields)) + entries + struct.pack(">I", 0)
    (page,) = media.read_pages(data)
    assert page.pixels == b"abcdefgh" and (page.width, page.height, page.samples) == (4, 2, 1)


def tiff_of(order, samples, bits, blocks, codec=1, predictor=1, planar=1, tile=None, rows=None, form=1):
    """A file of one page from ready strips or tiles; ``samples`` is (height, width, samples per pixel)."""
    import struct

    height, width, n = samples
    body, offsets = b"", []
    for block in blocks:
        offsets.append(8 + len(body))
        body += block
    body += b"\0" * (len(body) % 2)
    places = [(324, offsets), (325, [len(b) for b in blocks])] if tile else [(273, offsets), (279, [len(b) for b in blocks])]
    fields = {256: (4, [width]), 257: (4, [height]), 258: (3, [bits] * n), 259: (3, [codec]), 277: (3, [n]), 284: (3, [planar]), 317: (3, [predictor]), 339: (3, [form] * n)}
    fields |= {tag: (4, values) for tag, values in places}
    fields |= {322: (4, [tile]), 323: (4, [tile])} if tile else {278: (4, [rows or height])}
    at = 8 + len(body)
    spill, entries, behind = b"", b"", at + 2 + 12 * len(fields) + 4
    for tag, (kind, values) in sorted(fields.items()):
        packed = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        entries += struct.pack(order + "HHI", tag, kind, len(values))
        entries += packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack(order + "I", behind + len(spill))
        spill += packed if len(packed) > 4 else b""
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at)
    return head + body + struct.pack(order + "H", len(fields)) + entries + struct.pack(order + "I", 0) + spill


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("bits", [8, 16, 32])
def test_wide_samples_with_the_integer_predictor(order, bits):
    values = np.random.default_rng(bits).integers(0, 1 << bits, (7, 5, 3), dtype=np.uint64).astype(f"<u{bits // 8}")
    stored = values.copy()
    stored[:, 1:] -= values[:, :-1]
    strips = [zlib.compress(stored[y : y + 3].astype(f"{order}u{bits // 8}").tobytes()) for y in (0, 3, 6)]
    (page,) = media.read_pages(tiff_of(order, values.shape, bits, strips, media.DEFLATE, 2, rows=3))
    assert page.bits == bits and page.pixels == values.tobytes()


@pytest.mark.parametrize("order", "<>")
def test_floating_point_predictor(order):
    values = np.random.default_rng(5).standard_normal((4, 6, 2)).astype("<f4")
    rows = []
    for line in values:
        big = line.reshape(-1).astype(">f4").tobytes()
        planes = b"".join(big[k::4] for k in range(4))
        spread = np.frombuffer(planes, np.uint8).reshape(-1, 2)
        rows.append(np.concatenate([spread[:1], spread[1:] - spread[:-1]]).tobytes())
    (page,) = media.read_pages(tiff_of(order, values.shape, 32, [media.lzw(b"".join(rows))], media.LZW, 3, form=3))
    assert page.pixels == values.tobytes()


def test_planes_tiles_and_single_bits():
    values = np.random.default_rng(6).integers(0, 256, (20, 18, 2)).astype(np.uint8)
    wide = np.zeros((32, 32, 2), np.uint8)
    wide[:20, :18] = values
    tiles = [media.packbits(wide[y : y + 16, x : x + 16, k].tobytes()) for k in (0, 1) for y in (0, 16) for x in (0, 16)]
    (page,) = media.read_pages(tiff_of("<", values.shape, 8, tiles, media.PACKBITS, planar=2, tile=16))
    assert page.pixels == values.tobytes() and page.tiled
    bits = np.random.default_rng(7).integers(0, 2, (9, 13, 1)).astype(np.uint8)
    strips = [media.packbits(np.packbits(bits[y : y + 4, :, 0], axis=1).tobytes()) for y in (0, 4, 8)]
    (page,) = media.read_pages(tiff_of(">", bits.shape, 1, strips, media.PACKBITS, rows=4))
    assert page.pixels == bits.tobytes()


@pytest.mark.parametrize("change", [{"tile": 0}, {"samples": (0, 4, 1)}, {"samples": (1 << 30, 1 << 30, 1)}, {"bits": 12}, {"predictor": 3}, {"predictor": 9}, {"codec": 7}])
def test_impossible_tiffs_are_refused(change):
    given = {"order": "<", "samples": (4, 4, 1), "bits": 8, "blocks": [b"a" * 16]} | change
    data = tiff_of(**given)
    if change == {"tile": 0}:
        data = tiff_of(**(given | {"tile": 16})).replace((16).to_bytes(4, "little"), bytes(4))
    with pytest.raises(media.BadTiff):
        list(media.read_pages(data))


def test_damaged_tiff_is_a_row_with_its_reason(spark):
    good = media.write_tiff(b"a" * 192)
    rows = spark.createDataFrame([(1, None), (2, b""), (3, good[:-30]), (4, b"II*\0\x08\0\0\0" + good[8:20]), (5, bytearray(good))], "doc_id long, media binary")
    found = {r.doc_id: (r.page, r.error) for r in media.decode_pages(rows).collect()}
    assert found[5] == (0, None) and all(found[i][0] is None and found[i][1] for i in (1, 2, 3, 4))


def test_digests_of_null_and_damaged_media(spark):
    good = media.write_tiff(media.padded(b"page one"))
    rows = [(1, bytearray(good)), (2, None), (3, bytearray(good)), (3, bytearray(good)), (4, None), (None, None), (5, bytearray(good[:-30]))]
    frame = spark.createDataFrame(rows, "doc_id long, media binary").coalesce(1)
    found = [(r.doc_id, r.payload_bytes, r.media_bytes, r.error) for r in media.page_digests(media.decode_pages(frame)).collect()]
    assert [f[0] for f in found] == [1, 2, 3, 3, 4, None, 5]
    assert all(f[1:] == (192, len(good), None) for f in found if f[0] in (1, 3))
    assert all(f[1:] == (0, None, "no media") for f in found if f[0] in (2, 4, None)) and found[-1][3]


# ---------------------------------------------------------------- 2


def brute_warc(rows):
    least = {}
    for i, t in rows:
        if len(t) >= 100 and i is not None:
            least[t] = min(i, least.get(t, i))
    out = []
    for i, t in rows:
        first = least.get(t)
        again = first is not None and i is not None and i > first
        out.append((i, len(t), sha256(t).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def test_warc_matches_brute_force(spark, tmp_path):
    rows = [(r.page_id, r.html) for r in table(spark, SF, "pages").collect()]
    rows += [(i + 10_000, t) for i, t in rows[:9]] * 2 + [(77, None), (78, ""), (79, "s" * 99), (80, "s" * 99), (None, "n" * 150), (None, "n" * 150), (90, "n" * 150), (91, "n" * 150), (92, "\r\n\r\n" * 50), (93, "WARC/1.1\r\n" * 20), (94, "é\x00" * 80)]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\nEvil: 1" if i and i % 2 else None, h, "c") for i, h in rows], "page_id long, url string, html string, digest string")
    path = f"{tmp_path}/p"
    pages.repartition(3).write.parquet(f"{path}/pages.parquet")
    found = queries.op2_warc_archive(spark, path)
    assert sorted((tuple(r) for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == brute_warc([(i, (h or "").encode()) for i, h in rows])


def test_warc_rebuilds_exact_records(spark):
    pages = table(spark, SF, "pages")
    pages = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 5_000))
    path = warc.write_archive(pages, scratch_path(spark, "t"))
    store = warc.build_store(spark, path)
    rebuilt = b"".join(bytes(r.record) for r in store.records().orderBy("position").collect())
    raw = b"".join(b"".join(warc._unzipped(bytes(r.content))) for r in spark.read.format("binaryFile").load(path).orderBy("path").collect())
    assert rebuilt == raw and store.payloads.count() == pages.select("html").distinct().count()
    assert store.headers.where("NOT verified").count() == 0


def test_warc_marks_a_wrong_digest_and_reads_members(spark, tmp_path):
    import gzip

    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Payload-Digest: sha256:00\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    store = warc.build_store(spark, str(tmp_path))
    assert [r.verified for r in store.headers.collect()] == [False, False]
    assert [bytes(r.payload) for r in store.payloads.collect()] == [b"hello"]


def test_warc_of_one_member_a_record(spark, tmp_path):
    """Many members cost no more than their bytes; large and padded ones are read whole."""
    import gzip
    import time

    def record(i, body):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (i, len(block)) + block + b"\r\n\r\n"

    draw = random.Random(3)
    large = draw.randbytes(3_000_000)
    records = [record(i, b"page %d " % i * (1 + i % 60)) for i in range(20_000)] + [record(20_000, large)]
    members = [gzip.compress(r, 1) for r in records]
    began = time.process_time()
    assert b"".join(warc._unzipped(b"".join(members))) == b"".join(records)
    assert time.process_time() - began < 10
    (tmp_path / "many.warc.gz").write_bytes(b"\0\0".join(members[-300:]))
    store = warc.build_store(spark, str(tmp_path))
    assert store.headers.count() == 300
    rebuilt = b"".join(bytes(r.record) for r in store.records().orderBy("position").collect())
    assert rebuilt == b"".join(records[-300:])
    with pytest.raises(ValueError):
        list(warc._unzipped(b"".join(members)[:-20]))


def test_warc_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BYTES_PER_FILE", 50_000)
    pages = spark.range(60).selectExpr("id AS page_id", "concat('http://x/', id) AS url", "concat(id, repeat('x', 9500)) AS html").coalesce(1)
    path = warc.write_archive(pages, str(tmp_path / "a"))
    sizes = [sum(len(c) for c in warc._unzipped(bytes(r.content))) for r in spark.read.format("binaryFile").load(path).collect()]
    assert len(sizes) >= 12 and max(sizes) < 60_000


def test_warc_of_an_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.build_store(spark, warc.write_archive(pages, scratch_path(spark, "t"))).records().count() == 0


# ---------------------------------------------------------------- 3


def brute_nearest(rows, n=5):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q in good:
        if i % 50 == 0:
            near = sorted((-(q @ v) / (np.linalg.norm(q) * np.linalg.norm(v)), j) for j, v in good if j != i)[:n]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return out


def test_search_is_exact_while_all_leaves_are_met(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    rows += [(100_000 + i, rows[3][1]) for i in range(60)] + [(200_001, None), (200_002, [0.0] * 64), (200_003, [float("nan")] + [1.0] * 63), (200_004, [None] + [1.0] * 63), (200_005, [float("inf")] * 64), (200_006, [1.0]), (200_050, []), (200_100, None)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, v int")
    found = sorted(tuple(r) for r in ann.search(frame, reach=1e9).collect())
    want = sorted(brute_nearest([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows if v is None or len(v) in (0, 64)]))
    assert [(a, b, c) for a, b, c, _ in found] == [(a, b, c) for a, b, c, _ in want]
    assert np.allclose([x[3] for x in found], [x[3] for x in want], atol=1e-12)


def test_search_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    want = {(q, v) for q, _, v, _ in brute_nearest(rows)}
    found = {(r.query_id, r.vec_id) for r in ann.search(table(spark, "/root/testdata/sf0.1", "embeddings"), block=100).collect()}
    assert len(found & want) / len(want) >= 0.9


def test_search_of_a_table_of_many_leaves_scores_a_part_of_it(spark):
    draw = np.random.default_rng(5)
    points = (draw.standard_normal((20_000, 6)) @ draw.standard_normal((6, 32))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(points)]
    units = ann._unit(points.astype(float))
    queries = np.arange(0, 20_000, 50)
    cosines = units[queries] @ units.T
    cosines[np.arange(len(queries)), queries] = -2
    want = {(int(q), int(v)) for q, near in zip(queries, np.argsort(-cosines, axis=1)[:, :5]) for v in near}
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len({(r.query_id, r.vec_id) for r in found} & want) / len(want) >= 0.9
    # The same walk outside Spark: the share of rows that lie in the leaves a query meets.
    forest = ann.fit_forest(units, ann.TREES, ann.LEAF, ann.SEED)
    placed = [forest.leaf_of(units, root) for root in forest.roots]
    limits = ann.REACH * forest.levels() / 32 * ann.squared_radius(units[queries], units[::3], 5)
    shares = []
    for q, limit in zip(queries, limits):
        met = forest.probe(units[q], np.ones(forest.leaves, bool), limit)
        shares.append(np.logical_or.reduce([np.isin(leaves, met) for leaves in placed]).mean())
    assert np.mean(shares) < 0.2


def test_search_of_repeated_rows(spark):
    hot, near = [1.0, 0.0], [(3, [1.0, 0.1]), (4, [1.0, 0.2])]
    schema = "vec_id long, embedding array<float>"
    rows = [(50, hot)] * 7 + [(60, hot), (70, hot)] + near
    found = [(r.query_id, r.rank, r.vec_id) for r in ann.search(spark.createDataFrame(rows, schema), reach=1e9).orderBy("rank").collect()]
    assert found == [(50, 1, 60), (50, 2, 70), (50, 3, 3), (50, 4, 4)]
    rows = [(50, [1.0, 0.05])] + [(1, hot)] * 7 + near
    found = [(r.rank, r.vec_id) for r in ann.search(spark.createDataFrame(rows, schema), reach=1e9).orderBy("rank").collect()]
    assert sorted(v for _, v in found) == [1, 3, 4] and [r for r, _ in found] == [1, 2, 3]


def test_search_of_doubles_and_clashing_columns(spark):
    rows = [(i, [math.cos(i / 7), math.sin(i / 7), 1e-30], i, "x") for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf int, v string")
    found = sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(frame, reach=1e9).collect())
    assert found == [x[:3] for x in sorted(brute_nearest([r[:2] for r in rows]))]


def test_search_of_few_rows(spark):
    for rows in ([], [(50, [1.0, 0.0])], [(50, [1.0, 0.0]), (1, [1.0, 1.0])], [(50, None)]):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(frame).collect()) == ([(50, 1, 1)] if len(rows) == 2 else [])


# ---------------------------------------------------------------- 4


def check_packing(rows, source):
    ids = chunk_ids("word_bpe_49k.json", 1_000)
    whole = Counter()
    for key, text in texts_of(source):
        packed = b"".join(i.to_bytes(4, "little") for i in ids.library.encode(text.decode(), add_special_tokens=False).ids) + (2).to_bytes(4, "little")
        for start in range(0, len(packed) // 4, 4096):
            piece = packed[4 * start : 4 * (start + 4096)]
            whole[key, start, len(piece) // 4, zlib.crc32(piece), len(packed) // 4] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == whole
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return sum(r.length for r in rows), 4096 * len(by_sequence)


def test_packing_of_documents(spark, docs):
    used, room = check_packing(queries.op4_pack_histogram(spark, SF).collect(), docs)
    assert used / room > 0.9


def test_packing_of_odd_rows(odd, empty):
    check_packing(packing.pack(odd).collect(), odd)
    assert packing.pack(empty).count() == 0


def test_packing_ranks_across_buckets(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 7)
    check_packing(packing.pack(docs).collect(), docs)


def test_placements_cover_each_rank_once_and_fill():
    draw = random.Random(5)
    for _ in range(30):
        cap = draw.choice([8, 64, 512])
        histogram = {draw.randint(1, cap): draw.randint(1, 50) for _ in range(draw.randint(0, 30))}
        got, fill = Counter(), Counter()
        spans = {}
        for length, rank, n, first, offset in packing.shortest_pack_first(histogram, cap):
            assert rank == spans.get(length, 0)
            spans[length] = rank + n
            got[length] += n
            for s in range(first, first + n):
                assert fill[s] == offset
                fill[s] += length
        assert dict(got) == histogram and all(x <= cap for x in fill.values())
        assert sorted(fill) == list(range(len(fill)))


def test_placements_are_shortest_pack_first():
    """Against one item at a time: the same offsets for the same lengths, whichever of equal packs is taken."""
    draw = random.Random(7)
    for _ in range(40):
        cap = draw.choice([8, 50, 300])
        histogram = {draw.randint(1, cap): draw.randint(1, 40) for _ in range(draw.randint(1, 25))}
        packs, want = [], Counter()
        for length in sorted(histogram, reverse=True):
            for _ in range(histogram[length]):
                room = [i for i, used in enumerate(packs) if used + length <= cap]
                if room:
                    i = min(room, key=lambda i: packs[i])
                else:
                    i = len(packs)
                    packs.append(0)
                want[length, packs[i]] += 1
                packs[i] += length
        got = Counter()
        for length, _, n, _, offset in packing.shortest_pack_first(histogram, cap):
            got[length, offset] += n
        assert got == want


def test_copies_of_a_row_are_ranked_together(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 50)
    monkeypatch.setattr(packing, "COPIES", 7)
    frame = docs.select("doc_id", "text").limit(20).unionByName(spark.range(900).selectExpr("1L AS doc_id", "'the same row again' AS text"))
    check_packing(packing.pack(frame).collect(), frame)


# ---------------------------------------------------------------- 5


def brute_base(rows):
    words = lambda t: [*t.lower().split(), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return Counter(
        (i, held(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), 5)) for i, t in rows
    )


def check_scores(found, source):
    rows = found.collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == brute_base(texts_of(source))
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_scores_of_documents(spark, docs):
    check_scores(queries.op5_lattice_likelihood(spark, SF), docs)


def test_scores_of_odd_rows(odd, empty):
    check_scores(lm.score(odd, frequent=3), odd)
    assert lm.score(empty).count() == 0


def test_rare_and_null_classes_share_a_model(spark):
    """Each of eleven classes, one null, has words of its own: no score may pay a back-off mass for every word."""
    langs = [f"l{i:02d}" for i in range(10)] + [None]
    rows = [(1_000 * i + j, " ".join(f"w{i}x{(j + k) % 30}" for k in range(30)), lang) for i, lang in enumerate(langs) for j in range(30 - 2 * i)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    plain = {r.doc_id: r.score for r in lm.score(frame, class_col=None).collect()}
    for frequent, most in ((lm.FREQUENT_WORDS, 8), (0, 8), (lm.FREQUENT_WORDS, lm.CLASSES)):
        found = {r.doc_id: r.score for r in lm.score(frame, frequent=frequent, most_classes=most).collect()}
        assert len(found) == len(rows) and all(found[k] > plain[k] for k in found)


def test_scores_do_not_depend_on_the_tiers(docs):
    a, b = ({r.doc_id: r.score for r in lm.score(docs, frequent=n).collect()} for n in (0, 10_000))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 * abs(a[k]) for k in a)


def test_scores_without_training_rows(spark):
    held = next(i for i in range(50) if lm.is_held_out(i))
    row = lm.score(spark.createDataFrame([(held, "some words")], "doc_id long, text string")).first()
    assert (row.held_out, row.n_known, row.train_tokens) == (True, 0, 0) and math.isfinite(row.score)


def lattice(pieces):
    return lm.Lattice.of([p.encode() for p in pieces], np.log(np.array(list(pieces.values()))))


def test_lattice_sums_all_segmentations():
    pieces = {"a": 0.3, "b": 0.2, "ab": 0.2, "ba": 0.1, "aba": 0.2}
    model = lattice(pieces)

    def total(word):
        return 1.0 if not word else sum(p * total(word[len(s) :]) for s, p in pieces.items() if word.startswith(s))

    words = ["".join(w) for n in range(1, 7) for w in itertools.product("ab", repeat=n)]
    assert np.allclose(np.exp(model.log_probability([w.encode() for w in words])), [total(w) for w in words])


def test_expected_counts_are_those_of_all_segmentations():
    pieces = {"a": 0.5, "b": 0.2, "ab": 0.3}
    counts = lattice(pieces).expected_counts([b"ab", b"aab"], np.array([2.0, 1.0]), 3)
    whole = 0.5 * 0.2 + 0.3
    split = 0.5 * 0.2 / whole
    assert np.allclose(counts, [2 * split + 1 + split, 3 * split, 3 * (1 - split)])


def test_long_words_follow_the_same_recursion(monkeypatch):
    model = lattice({"a": 0.3, "b": 0.2, "ab": 0.2, "ba": 0.1, "aba": 0.2})
    draw = random.Random(2)
    words = ["".join(draw.choice("ab") for _ in range(n)).encode() for n in (1, 2, 63, 64, 65, 200)] + [b"abx"]
    plain, counts = model.log_probability(words), model.expected_counts(words[:-1], np.arange(1.0, 7.0), 5)
    monkeypatch.setattr(lm, "LONG", 2)
    monkeypatch.setattr(lm, "STRETCH", 16)
    assert np.allclose(model.log_probability(words), plain) and plain[-1] == -np.inf
    assert np.allclose(model.expected_counts(words[:-1], np.arange(1.0, 7.0), 5), counts)


def test_a_word_of_a_megabyte_is_scored(spark):
    draw = random.Random(4)
    blob = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000))
    held = [i for i in range(100, 200) if lm.is_held_out(i)][:2]
    rows = [(i, f"some words {i}", "en") for i in range(20)] + [(100, blob[:900_000], "en"), (held[0], f"before {blob} behind", "en"), (held[1], blob, None)]
    found = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(math.isfinite(v) for v in found.values()) and all(found[i] < -500_000 for i in held)


@pytest.mark.parametrize("frequent", [0, 10_000])
def test_document_scores_against_brute_force(spark, frequent):
    draw = random.Random(6)
    words = ["".join(draw.choices("abetno", k=draw.randint(1, 4))) for _ in range(60)] + ["é", "Zz"]
    langs = ["en", "en", "de", None]
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(0, 12))) or None, draw.choice(langs)) for i in range(60)]
    rows += [(100 + i, "unseen abenot words qq", None) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pieces = lm.vocabulary_pieces(lm.VOCABULARY)[0]
    counts = lm.word_counts(frame)
    weight = dict(zip(pieces, lm.train_pieces(counts).log_weights))
    longest = max(map(len, pieces))

    def path(rest):
        if not rest:
            return 1.0
        return sum(math.exp(weight[rest[:n]]) * path(rest[n:]) for n in range(1, min(len(rest), longest) + 1) if rest[:n] in weight)

    def tokens(text):
        return [*(text or "").encode().lower().split(), b""]

    def model(texts):
        c = Counter(w for t in texts for w in tokens(t))
        n, once, twice = sum(c.values()), sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = once / (once + 2 * twice) if once and twice else 0.5
        return lambda w, back: max(c[w] - d, 0) / n + d * len(c) / n * back

    training = [(t, g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    overall = model([t for t, _ in training])
    own = [(sum(h == g for _, h in training) / len(training), model([t for t, h in training if h == g])) for g in ("en", "de", None)]

    def document(text):
        found = []
        for prior, part in own:
            logs = [math.log10(part(w, overall(w, path(lm.START + w) if w else 0.0))) for w in tokens(text)]
            found.append(math.log10(prior) + sum(logs))
        top = max(found)
        return top + math.log10(sum(10 ** (f - top) for f in found))

    got = {r.doc_id: r.score for r in lm.score(frame, frequent=frequent).collect()}
    assert all(math.isclose(got[i], document(t), rel_tol=1e-9) for i, t, _ in rows)


def test_pieces_form_a_distribution(docs):
    model = lm.train_pieces(lm.word_counts(docs).cache())
    assert abs(np.exp(model.log_weights).sum() - 1) < 1e-9


def test_likelihood_on_held_out_text_beats_an_untrained_model(spark, docs):
    """Held-out likelihood: better than even weights over the vocabulary's pieces."""
    trained = lm.score(docs).where("held_out").agg(F.sum("score").alias("s")).first().s
    surfaces, _ = lm.vocabulary_pieces(lm.VOCABULARY)
    flat = lm.Lattice.of(surfaces, np.full(len(surfaces), -np.log(len(surfaces))))
    untrained = sum(flat.log_probability([lm.START + w for w in t.lower().split()]).sum() / math.log(10) for i, t in texts_of(docs) if lm.is_held_out(i) and t.split())
    assert trained > untrained


# ---------------------------------------------------------------- 6


def brute_counts(source):
    library = chunk_ids("word_bpe_49k.json", 1_000).library
    return Counter((k, len(t), n := len(library.encode(t.decode(), add_special_tokens=False).ids), n > 2048) for k, t in texts_of(source))


def test_token_counts(spark, docs, odd, empty):
    assert Counter(tuple(r) for r in queries.op6_token_counts(spark, SF).collect()) == brute_counts(docs)
    assert Counter(tuple(r) for r in tokens.count_tokens(odd, cached=2, frequent=3).collect()) == brute_counts(odd)
    assert tokens.count_tokens(empty).count() == 0


def test_piece_counts(docs):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, "piece_bpe_32k.model").collect()}
    assert found == {k: len(model.encode(t.decode())) for k, t in texts_of(docs)}


def test_chunks_encode_like_the_library():
    ids = chunk_ids("word_bpe_49k.json", 50)
    draw = random.Random(7)
    letters = "abcXYZ'.,!<|>&*-_0123 \n\t\x0b\x1c\x85\xa0éÉßİıſǆΣσς́ͅ日本あ\U0001f600‍"
    for _ in range(3_000):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(25)))
        assert np.frombuffer(ids.text_ids(text.encode()), np.uint32).tolist() == ids.library.encode(text, add_special_tokens=False).ids, repr(text)


# ---------------------------------------------------------------- 7


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check_mix(found, source):
    rows = found.collect()
    given = [(r.doc_id, r.source, len((r.text or "").encode().split())) for r in source.select("doc_id", "source", "text").collect()]
    sizes = Counter()
    for _, s, n in given:
        sizes[s] += n
    target = brute_targets({s: sizes[s] for _, s, _ in given})
    assert Counter((r.doc_id, r.size, r.source_size) for r in rows) == Counter((i, n, sizes[s]) for i, s, n in given)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    taken, wanted = Counter(), {}
    for r in rows:
        taken[r.source_size, round(r.target, 6)] += r.taken
        wanted[r.source_size, round(r.target, 6)] = r.target
    assert {round(t, 4) for t in wanted.values()} == {round(t, 4) for t in target.values()}
    return taken, wanted


def test_mix_comes_near_its_targets(spark, docs):
    found = queries.op7_sainte_lague_mix(spark, SF)
    taken, wanted = check_mix(found, docs)
    assert all(abs(taken[k] - wanted[k]) <= 2.5 * mixing.BLOCK for k in wanted)
    assert sorted_rows(found, "doc_id", "taken") == sorted_rows(queries.op7_sainte_lague_mix(spark, SF), "doc_id", "taken")


def test_mix_over_many_shards(docs):
    taken, wanted = check_mix(mixing.mix(docs, shard_docs=20, block=8).select("doc_id", "size", "source_size", "target", "taken"), docs)
    assert all(abs(taken[k] - wanted[k]) <= 0.03 * wanted[k] for k in wanted)


def test_a_tiny_source_beside_a_hot_one_meets_its_target(spark):
    hot = spark.range(6_000).selectExpr("id AS doc_id", "concat_ws(' ', array_repeat(concat('w', id), 40)) AS text", "'hot' AS source")
    tiny = spark.range(6_000, 6_300).selectExpr("id AS doc_id", "concat_ws(' ', array_repeat('t', 10)) AS text", "'tiny' AS source")
    frame = hot.unionByName(tiny)
    taken, wanted = check_mix(mixing.mix(frame, shard_docs=20).select("doc_id", "size", "source_size", "target", "taken"), frame)
    assert all(abs(taken[k] - wanted[k]) <= 0.01 * wanted[k] for k in wanted)


def test_mix_of_odd_rows(odd, empty):
    check_mix(mixing.mix(odd), odd)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_mixed_rows_hold_the_words_taken(odd, docs):
    for source in (odd, docs):
        found = mixing.mixed(source)
        assert found.columns == source.columns
        words = lambda d, c: Counter({r.doc_id: r.n for r in d.groupBy("doc_id").agg(F.sum(c).alias("n")).collect() if r.n})
        assert words(found, mixing.word_count(F.col("text"))) == words(mixing.mix(source), F.col("taken"))


def test_many_sources_are_ordered_part_by_part(spark, docs, monkeypatch):
    frame = docs.withColumn("source", F.when(F.col("doc_id") % 9 == 0, None).otherwise(F.concat(F.lit("host"), F.col("doc_id") % 37)))
    columns = ("doc_id", "size", "source_size", "target", "taken")
    want = sorted_rows(mixing.mix(frame, shard_docs=30), *columns)
    monkeypatch.setattr("locusflow.llm.common.ORDERED_TOGETHER", 5)
    assert sorted_rows(mixing.mix(frame, shard_docs=30), *columns) == want
    check_mix(mixing.mix(frame, shard_docs=30).select(*columns), frame)


@pytest.mark.parametrize("together", [3, 100_000])
def test_apportionment_is_by_highest_quotients(spark, monkeypatch, together):
    monkeypatch.setattr("locusflow.llm.common.ORDERED_TOGETHER", together)
    draw = random.Random(9)
    for _ in range(6):
        claims = [(f"s{i}", draw.randrange(1, 1_000), draw.randrange(0, 60)) for i in range(draw.randrange(1, 12))]
        seats = draw.randrange(0, 80)
        frame = spark.createDataFrame([(n, float(c), lim, seats) for n, c, lim in claims], "name string, claim double, room long, seats long")
        found = {r.name: r.got for r in mixing.apportion(frame, [], "seats", "claim", "room", "got", ["name"]).collect()}
        quotients = sorted(((-c / (2 * k + 1), n) for n, c, lim in claims for k in range(1_000)))[:seats]
        free = Counter(n for _, n in quotients)
        if all(free[n] <= lim for n, _, lim in claims):
            assert found == {n: free[n] for n, _, _ in claims}
        assert all(found[n] <= lim for n, _, lim in claims)


# ---------------------------------------------------------------- 8


def test_quality_separates_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    taught = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0)
    rest = labels.join(taught.select("doc_id"), "doc_id", "left_anti")
    found = quality.classify(docs, taught).join(rest, "doc_id").collect()
    right = sum(r.keep == (r.quality > 0) for r in found) / len(found)
    assert len(found) > 80 and right > 0.97


def test_quality_of_odd_rows(spark, odd, empty, docs):
    labels = table(spark, SF, "labels")
    columns = ("doc_id", "text_score", "meta_score", "quality_score", "keep")
    assert quality.classify(empty, labels).count() == 0
    nothing = quality.classify(odd, labels.limit(0)).collect()
    assert len(nothing) == odd.count() and all(r.keep and r.quality_score is None for r in nothing)
    odd_labels = spark.createDataFrame([(None, 1), (3, None), (3, 1), (3, 0)], "doc_id long, quality int")
    both = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(docs)
    rows = quality.classify(both, labels.select("doc_id", "quality").unionByName(odd_labels)).select(*columns).collect()
    assert len(rows) == both.count() and all(0 <= r.quality_score <= 1 for r in rows)


def test_accepted_rows_are_those_kept(spark, docs):
    labels = table(spark, SF, "labels")
    kept = {r.doc_id for r in quality.classify(docs, labels).where("keep").collect()}
    found = quality.accepted(docs, labels)
    assert found.schema == docs.schema and {r.doc_id for r in found.collect()} == kept


def test_quality_of_repeated_ids_and_missing_columns(spark, docs):
    """Copies of one id, some of other text, neither crowd out other rows nor make reruns differ."""
    labels = table(spark, SF, "labels")
    first = labels.join(docs, "doc_id").orderBy("doc_id").first().doc_id
    copies = docs.where(F.col("doc_id") == first).crossJoin(spark.range(400)).withColumn("text", F.when(F.col("id") % 2 == 0, F.col("text")).otherwise("other words")).drop("id")
    both = docs.unionByName(copies)
    runs = [quality.fit(d, labels) for d in (both, both.repartition(7), both.orderBy(F.desc("doc_id")))]
    assert all(np.array_equal(runs[0].text, r.text) and np.array_equal(runs[0].combination, r.combination) for r in runs[1:])
    bare = docs.select("doc_id", "text")
    found = quality.classify(bare, labels).collect()
    assert len(found) == docs.count() and all(0 <= r.quality_score <= 1 for r in found)
    assert quality.accepted(bare, labels).columns == ["doc_id", "text"]


def test_quality_scores_are_those_of_the_model(spark, docs):
    """Scores of the query against the views worked out row by row from their definitions."""
    labels = table(spark, SF, "labels")
    model = quality.fit(docs, labels)

    def logit(x, beta):
        return sum(float(a) * b for a, b in zip(x, beta[:-1])) + beta[-1]

    def odds(z):
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))

    found = {r.doc_id: r for r in queries.op8_co_training(spark, SF).collect()}
    for r in docs.collect():
        t = logit([logit(quality.text_features((r.text or "").encode()), model.text)], model.text_calibration)
        m = logit([logit(quality.metadata_features(r.lang, r.source, r.n_chars), model.meta)], model.meta_calibration)
        want = (odds(t), odds(m), odds(logit([t, m], model.combination)))
        got = found[r.doc_id]
        assert np.allclose((got.text_score, got.meta_score, got.quality_score), want, atol=1e-6) and got.keep == (got.quality_score >= quality.KEEP)


def test_logistic_fit_is_the_penalised_optimum():
    draw = np.random.default_rng(8)
    x, weight = draw.normal(size=(200, 3)), draw.random(200) + 0.5
    y = (x @ [1.0, -2.0, 0.5] + draw.normal(size=200) > 0).astype(float)
    beta = quality.fit_logistic(x, y, weight, 1.0)
    p = 1 / (1 + np.exp(-(x @ beta[:-1] + beta[-1])))
    slope = np.append(x.T @ (weight * (y - p)) - beta[:-1], (weight * (y - p)).sum())
    assert np.abs(slope).max() < 1e-3


def test_the_unlabelled_pool_is_full_beside_many_labels(spark):
    rows = [(i, f"text number {i} " * (1 + i % 3), "en", "a", 20) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(380)], "doc_id long, quality int")
    taught, pool = quality.drawn_ids(frame, labels, quality.Columns(), "quality", 100, 20, 1)
    assert len(taught) == 100 and sorted(pool) == list(range(380, 400))


def test_views_teach_each_other():
    draw = np.random.default_rng(3)
    y = (draw.random(600) < 0.5).astype(float)
    views = [np.column_stack([y * 2 + draw.normal(0, 0.6, 600), draw.normal(0, 1, 600)]) for _ in range(2)]
    aside = np.arange(600) % 4 == 0
    known = np.arange(600) < 80
    use = known | aside
    model = quality.co_train(views[0][use], views[1][use], y[use], aside[use], views[0][~use], views[1][~use])
    _, _, both = model.scores(*views)
    assert ((both > 0.5) == (y > 0.5))[~use].mean() > 0.97


# ---------------------------------------------------------------- 9


def brute_fingerprint(text):
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, bits=4):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= bits:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [least.get(root(i)) for i in range(len(prints))]


def check_duplicates(found, source):
    rows = texts_of(source)
    prints = [brute_fingerprint(t) for _, t in rows]
    want = Counter((k, f"{p:016x}", c) for (k, _), p, c in zip(rows, prints, brute_components(prints, [k for k, _ in rows])))
    assert Counter(tuple(r) for r in found.collect()) == want


def test_near_duplicates_of_documents(spark, docs):
    check_duplicates(queries.op9_simhash_segments(spark, SF), docs)


def test_near_duplicates_of_odd_rows(odd, empty):
    check_duplicates(neardup.near_duplicates(odd), odd)
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def test_links_lose_no_component(spark):
    """Clusters of fingerprints, cells larger than a block: components equal brute force."""
    draw = random.Random(11)
    prints = set()
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(25):
            p = centre
            for b in draw.sample(range(64), draw.randrange(6)):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = brute_components(prints, list(range(len(prints))))
    for block in (4, 2_048):
        links = neardup.links_between(spark.createDataFrame([(s,) for s in signed], "fp long"), cell_block=block)
        stars = {r.node: r.root for r in neardup.components(links).collect()}
        group = {}
        for s, w in zip(signed, want):
            group.setdefault(w, set()).add(stars.get(s, s))
        assert all(len(g) == 1 for g in group.values()) and len({x for g in group.values() for x in g}) == len(group)


def test_the_embedding_bounds_the_distance():
    draw = np.random.default_rng(12)
    a = draw.integers(0, 1 << 63, 500).astype(np.uint64)
    b = a.copy()
    for i in range(500):
        for bit in draw.integers(0, 64, draw.integers(0, 9)):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    bound = np.abs(neardup.segment_counts(a).astype(int) - neardup.segment_counts(b)).sum(1)
    distance = np.bitwise_count(a ^ b)
    assert (bound <= distance).all()
    shared = (neardup.cell_keys(a, 4, 2, 8) == neardup.cell_keys(b, 4, 2, 8)).any(1)
    assert shared[distance <= 4].all()


def test_kept_rows_hold_all_columns(spark):
    names = ["_digest", "_kept_id", "_kept_digest", "doc_id", "text"]
    rows = [(i, f"d{i}", "k", i, "same words in each of these texts" if i < 3 else f"text {i}") for i in range(6)]
    found = neardup.keep_one(spark.createDataFrame(rows, ", ".join(n + (" long" if n in ("_digest", "doc_id") else " string") for n in names)))
    assert found.columns == names and sorted(tuple(r) for r in found.collect()) == [rows[0], *rows[3:]]


def test_one_row_of_each_component_is_kept(odd):
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    rows = texts_of(odd)
    groups = {}
    prints = [brute_fingerprint(t) for _, t in rows]
    anonymous = brute_components(prints, list(range(len(prints))))
    for (k, _), g in zip(rows, anonymous):
        groups.setdefault(g, []).append(k)
    want = Counter(min((k for k in ks if k is not None), default=None) for ks in groups.values())
    assert Counter(r.doc_id for r in kept.collect()) == want


# ---------------------------------------------------------------- 10


def test_license_scan_finds_notices(spark, docs):
    found = {(r.doc_id, r.license) for r in queries.op10_license_scan(spark, SF).collect()}
    want = {(k, name) for k, t in texts_of(docs) for name, notice in licenses.TEMPLATES.items() if notice.encode().lower() in t.lower()}
    assert found >= want
    assert all(any(w in dict(texts_of(docs))[k].lower() for w in (b"licen", b"released")) for k, _ in found)


def test_license_passages(spark):
    mit = licenses.TEMPLATES["MIT"]
    words = mit.split()
    noisy = " ".join(w for i, w in enumerate(words) if i % 10)
    filler = "lorem the of and software " * 50
    rows = [
        (1, f"{filler} {mit} {filler}"), (2, f"{filler} {noisy} {filler}"), (3, " ".join(words[:40])), (4, "Released under the MIT License. " * 3), (5, None), (6, ""),
        (None, "released UNDER the mit license"), (7, "the license is under release"), (8, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."),
    ]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    found = licenses.scan(frame).collect()
    names = Counter((r.doc_id, r.license) for r in found)
    assert names[1, "MIT"] == 1 and names[2, "MIT"] == 1 and not any(k in (3, 5, 6, 7) for k, _ in names)
    assert names[4, "MIT-notice"] == 3 and names[None, "MIT-notice"] == 1
    assert names[8, "MIT-notice"] == 1 and names[8, "CC-BY-NC-4.0-notice"] == 1
    assert all(r.coverage >= 0.8 for r in found) and all(r.coverage == 1.0 for r in found if r.license.endswith("notice"))
    assert licenses.scan(frame.limit(0)).count() == 0


def test_license_beside_mentions_of_its_words(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, f"{gpl} See the GNU General Public License for details"), (2, "Licensed under CC BY-NC 4.0. CC BY-NC forbids sale"),
        (3, f"The GNU General Public License: {gpl}"), (4, f"{gpl} See the GNU General Public License. {gpl}"), (5, "See the GNU General Public License. " * 4),
    ]
    found = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault((r.doc_id, r.license), []).append((r.start_word, r.end_word, r.matched))
    assert found[1, "GPL-3.0-notice"] == [(0, 12, 12)] and found[2, "CC-BY-NC-4.0-notice"] == [(0, 7, 7)]
    assert found[3, "GPL-3.0-notice"] == [(5, 17, 12)] and sorted(found[4, "GPL-3.0-notice"]) == [(0, 12, 12), (18, 30, 12)]
    assert not any(k == 5 for k, _ in found)


def brute_windows(words, name):
    """Every window of a text, of the lengths a passage may have, whose own alignment covers the template."""
    template = licenses.words_of(licenses.TEMPLATES[name].encode())
    n, uses = len(template), Counter(template)
    least, most = math.ceil(0.8 * n - 1e-9), n + int(0.25 * n) + 1
    inside = np.cumsum([0, *(w in uses for w in words)])
    out = []
    for a in range(len(words)):
        for b in range(a + least, min(len(words), a + most) + 1):
            if inside[b] - inside[a] >= least and words[a] in uses and words[b - 1] in uses:
                matched = len(licenses.patience(words[a:b], template))
                if matched >= least:
                    out.append((a, b, matched))
    return out


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
    return row[-1]


def test_license_scan_against_all_windows(spark, docs):
    """Short notices, whole and damaged, among text and beside each other: no covering window lies apart from
    what is found, and what is found is one."""
    draw = random.Random(21)
    names = [n for n in licenses.TEMPLATES if n.endswith("notice")]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.text and len(r.text) < 20_000]
    for i in range(300):
        parts = []
        for _ in range(draw.randint(1, 4)):
            words = licenses.TEMPLATES[draw.choice(names)].split()
            for _ in range(draw.choice([0, 0, 1, 2])):
                at = draw.randrange(len(words))
                words[at : at + draw.randint(0, 1)] = draw.choice([[], ["extra"], ["License"], ["the"]])
            parts += [*draw.choices(["lorem", "the", "license", "under", "public", "version"], k=draw.randint(0, 6)), *words]
        rows.append((10_000 + i, " ".join(parts)))
    found = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault((r.doc_id, r.license), []).append((r.start_word, r.end_word, r.matched))
    for key, text in rows:
        words = licenses.words_of(text.encode())
        for name in names:
            template = licenses.words_of(licenses.TEMPLATES[name].encode())
            got = sorted(found.get((key, name), []))
            assert all(e <= s for (_, e, _), (s, _, _) in zip(got, got[1:]))
            for start, end, matched in got:
                assert 0.8 * len(template) - 1e-9 <= matched <= longest_common(words[start:end], template)
            assert all(any(a < e and s < b for s, e, _ in got) for a, b, _ in brute_windows(words, name)), (key, name, text)


def test_patience_anchors_are_a_longest_run():
    draw = random.Random(14)
    for _ in range(100):
        pairs = list(enumerate(draw.sample(range(30), draw.randrange(25))))
        best = [1] * len(pairs)
        for i, (_, b) in enumerate(pairs):
            best[i] = 1 + max([best[j] for j in range(i) if pairs[j][1] < b], default=0)
        run = licenses._longest_increasing(pairs)
        assert len(run) == max(best, default=0) and all(x[1] < y[1] for x, y in zip(run, run[1:]))


def test_patience_keeps_order_and_equality():
    draw = random.Random(13)
    for _ in range(200):
        a, b = ([draw.choice("abcdefghij") for _ in range(draw.randrange(25))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    text = list("abcdefgh")
    assert licenses.patience(text, text) == [(i, i) for i in range(8)]


def test_a_scope_deletes_its_scratch_tables(spark):
    import os

    from locusflow.llm.common import materialize, scratch_scope

    outer = materialize(spark.range(3), "outer")
    with scratch_scope(spark):
        inner = materialize(spark.range(3), "inner")
        paths = [d._scratch_path.removeprefix("file://") for d in (outer, inner)]
        assert all(map(os.path.exists, paths))
    assert [os.path.exists(p) for p in paths] == [True, False]


def test_scratch_folder_is_the_sessions(spark):
    assert shared_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def test_fitting_holds_few_rows_in_double_precision():
    import tracemalloc

    draw = np.random.default_rng(5)
    x = draw.random((6_000, 400), np.float32)
    y = (x[:, 0] + 0.2 * draw.random(6_000) > 0.6).astype(float)
    weight = np.where(np.arange(6_000) % 3 == 0, 0.5, 1.0)
    tracemalloc.start()
    beta = quality.fit_logistic(x, y, weight, 1.0, steps=4)
    margin = quality._margin(x, beta)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes  # a copy in double precision alone is twice that
    design = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    assert np.allclose(margin, design @ beta)
    want = np.zeros(401)
    penalty = np.append(np.full(400, 1.0), 1e-6)
    for _ in range(4):
        p = 1 / (1 + np.exp(-np.clip(design @ want, -35, 35)))
        curve = (design * (weight * p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(curve, design.T @ (weight * (y - p)) - penalty * want)
        want += step * min(1.0, 8.0 / (np.abs(step).max() + 1e-12))
    assert np.allclose(beta, want, atol=1e-6)
