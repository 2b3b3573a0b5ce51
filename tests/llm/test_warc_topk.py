import base64
import hashlib
import io
import math
import random
import re
from fractions import Fraction
import struct
import zipfile
import zlib

import numpy as np
import pytest

from sitemigrate.llm import bitslice, warc_zip

PAGES = "page_id long, url string, html string, sha1 string, owner long, id long, error string"


def pages(spark, rows):
    return spark.createDataFrame([(i, f"https://x.org/{i}\r\nX: 1", h, "s", 1, 2, "e") for i, h in rows], PAGES).repartition(3)


def brute_pages(rows, min_bytes=0):
    owner = {}
    for i, h in rows:
        if i is not None:
            owner[h or ""] = max(owner.get(h or "", i), i)
    out = []
    for i, h in rows:
        data = (h or "").encode()
        best = owner.get(h or "")
        revisit = best is not None and i != best and len(data) >= min_bytes
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_bytes", [0, 3])
def test_archives_round_trip(spark, min_bytes):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "é\r\n\r\nWARC/1.1\r\n\r\n"), (6, "x" * 300_000), (7, "same"), (7, "same"), (8, "same"), (9, "same"), (None, "same"), (None, "alone"), (None, "alone"), (-3, "neg")]
    archives = warc_zip.write_archives(spark, pages(spark, rows), min_bytes=min_bytes, archive_bytes=2000)
    assert archives.count() > 1
    got = warc_zip.read_archives(archives, with_payload=True).collect()
    assert all(r["error"] is None for r in got)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == brute_pages(rows, min_bytes)
    payload = {r["page_id"]: r["payload"] for r in got if r["record_type"] == "response"}
    assert payload[5] == rows[4][1].encode() and payload[6] == b"x" * 300_000
    assert warc_zip.read_archives(warc_zip.write_archives(spark, pages(spark, []))).count() == 0


def zip64(members):
    """A ZIP whose sizes, offsets and directory all stand in ZIP64 fields."""
    out, directory = b"", b""
    for name, data in members:
        at, n = len(out), name.encode()
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        out += struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(n), len(extra)) + n + extra + data
        extra = struct.pack("<HHHHQQQ", 0x9999, 0, 1, 24, len(data), len(data), at)
        directory += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(n), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + n + extra
    start = len(out)
    end = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, len(members), len(members), len(directory), start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, start + len(directory), 1)
    return out + directory + end + locator + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


def test_zip64_directories_are_read():
    members = [("archive/data.warc", b"0123456789"), ("indexes/index.cdx", b"1 0 10\n"), ("empty", b"")]
    data = zip64(members)
    asked = []

    def read(at, n):
        asked.append((at, n))
        return data[at : at + n]

    found = warc_zip.zip_members(read, len(data))
    assert {n: data[m.start : m.start + m.size] for n, m in found.items()} == dict(members)
    assert zipfile.ZipFile(io.BytesIO(data)).read("archive/data.warc") == b"0123456789"


def test_only_ranges_are_read(spark):
    rows = [(i, f"page {i} " * 2000) for i in range(40)]
    data = bytes(warc_zip.write_archives(spark, pages(spark, rows).coalesce(1), archive_bytes=1 << 30).orderBy("archive").first()["content"])
    asked = []

    def read(at, n):
        asked.append(n)
        return data[at : at + n]

    for _ in zip(range(2), warc_zip.records(read, len(data))):
        pass
    assert max(asked) < 70_000 and sum(asked) < len(data) / 2


def test_members_that_are_packed_or_broken(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/data.warc", b"a" * 1000, zipfile.ZIP_DEFLATED)
        z.writestr("other", b"b", zipfile.ZIP_STORED)
        z.comment = b"PK\x05\x06 in a comment"
    data = out.getvalue()
    assert set(warc_zip.zip_members(lambda a, n: data[a : a + n], len(data))) == {"other"}
    good = warc_zip.zip_archive([("1", warc_zip.warc_record(1, "u", b"x", "WRONG", None))])
    df = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"no zip")), ("c", bytearray(b"")), ("d", None), ("e", bytearray(good)), ("f", bytearray(good[:-30]))], warc_zip.ARCHIVES)
    errors = [r["error"] for r in warc_zip.read_archives(df).collect()]
    assert len(errors) == 6 and all(errors)


def test_pages_with_ids_of_other_types(spark):
    pages = spark.createDataFrame([("a/1", "u", "same"), ("b 2>", "u", "same"), ("é", "u", "other"), (None, "u", "third")], "page_id string, url string, html string")
    got = warc_zip.read_archives(warc_zip.write_archives(spark, pages), id_type="string").collect()
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"], r["error"]) for r in got), key=repr) == sorted([("a/1", "revisit", "b 2>", None), ("b 2>", "response", None, None), ("é", "response", None, None), (None, "response", None, None)], key=repr)
    empty = spark.createDataFrame([("", "u", "<p>same</p>"), ("!", "u", "<p>same</p>"), ("", "u", "<p>own</p>")], "page_id string, url string, html string")
    got = warc_zip.read_archives(warc_zip.write_archives(spark, empty), id_type="string").collect()
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got), key=lambda x: x[:2]) == [("", "response", None), ("", "revisit", "!"), ("!", "response", None)]


VECTORS = "vec_id long, embedding array<double>, label int, id long, q string, score double"


def brute_top(rows, queries, k):
    def q(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v):
            return None
        return np.floor(256 * np.array(v, float)).astype(np.int64)

    good = [(i, q(v)) for i, v in rows if i is not None and q(v) is not None]
    out = []
    for i, v in good:
        if queries(i):
            scores = sorted(((-int(v @ w), j) for j, w in good if j != i and len(w) == len(v)))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("block_rows, query_rows", [(65536, 64), (40, 3)])
def test_top_k_against_brute_force(spark, block_rows, query_rows):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(200)]
    rows += [(1000 + i, rows[5][1]) for i in range(20)] + [(300, None), (350, [0.1, None] + [0.0] * 6), (400, [float("nan")] * 8), (450, [float("inf")] + [0.0] * 7), (500, [0.0] * 8), (550, [-100.5] * 8), (600, [90.25] * 8), (None, [0.1] * 8), (650, []), (700, [0.5, 0.5]), (701, [0.5, -0.5])]
    df = spark.createDataFrame([(i, v, 1, 2, "q", 0.0) for i, v in rows], VECTORS)
    got = bitslice.top_k(spark, df, df.filter("vec_id % 50 = 0"), block_rows=block_rows, query_rows=query_rows)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute_top(rows, lambda i: i % 50 == 0, 5)
    none = df.limit(0)
    assert bitslice.top_k(spark, none, none).count() == 0


def test_repeated_rows_and_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0], 1, 2, "q", 0.0), (0, [1.0], 1, 2, "q", 0.0), (7, [2.0], 1, 2, "q", 0.0), (7, [2.0], 1, 2, "q", 0.0)], VECTORS)
    got = bitslice.top_k(spark, df, df.filter("vec_id = 0").limit(1)).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 7, 131072), (2, 7, 131072)]


def test_large_components_and_scores(spark):
    rng = random.Random(4)
    rows = [(0, [1.0, 1.0]), (1, [1e7, 0.0]), (5, [1e15, 0.0]), (6, [-1.7e308, 1.7e308]), (150, [3e200, -2.0]), (7, [1e300, 1e-300]), (2, [-1e13, 3.0]), (50, [-3e12, 2.0]), (100, [2e14, -2e14]), (3, [2e14, -1e14]), (4, [2.0**40 + 0.25, 0.5])] + [(10 + i, [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(20)]
    df = spark.createDataFrame([(i, v, 1, 2, "q", 0.0) for i, v in rows], VECTORS)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in bitslice.top_k(spark, df, df.filter("vec_id % 50 = 0")).collect())
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    whole = {i: [math.floor(256 * Fraction(x)) for x in v] for i, v in rows}
    want = []
    for i in (0, 50, 100, 150):
        best = sorted((-sum(a * b for a, b in zip(whole[i], w)), j) for j, w in whole.items() if j != i)[:5]
        want += [(i, r + 1, j, clip(-s)) for r, (s, j) in enumerate(best)]
    assert got == want
    few = df.filter("vec_id IN (0, 4, 5)")
    assert [tuple(r) for r in bitslice.top_k(spark, few, df.filter("vec_id = 0"), k=1).collect()] == [(0, 1, 5, (1 << 63) - 1)]
    some = [0, 1, -1, 127, 128, -128, -256, 255, 256, 10**30, -(10**30), 2**63, -(2**63)]
    assert sorted(some, key=bitslice.rank_key) == sorted(some)


def test_ids_of_other_types(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(4)]) for i in range(60)]
    of = {i: f"v{i:03d}" for i, _ in rows}
    df = spark.createDataFrame([(of[i], v) for i, v in rows], "vec_id string, embedding array<double>")
    got = bitslice.top_k(spark, df, df.filter("vec_id <= 'v004'"), block_rows=20, query_rows=2, packs=1).collect()
    assert sorted(tuple(r) for r in got) == sorted((of[q], r, of[v], s) for q, r, v, s in brute_top(rows, lambda i: i <= 4, 5))


def test_bit_slices_give_the_scores():
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 300):
        values = rng.integers(-300, 300, (n, 5))
        index = bitslice.build_index(np.arange(n), values)
        query = rng.integers(-70, 70, 5)
        planes, base = bitslice.scores(index, query)
        bits = [np.unpackbits(p.view(np.uint8), bitorder="little")[:n].astype(np.int64) for p in planes]
        assert (sum(b << w for w, b in enumerate(bits)) + base == values @ query).all()


def test_a_block_meets_its_packs_once_whatever_their_number(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = bitslice.top_k(spark, df, df, block_rows=100, query_rows=1, packs=300)
    # No row holds a block beside a pack, and blocks' groups aren't put into one task by their size.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and not [x for x in plan.splitlines() if "Join" in x or "slices" in x and "asked" in x and "FlatMapCoGroupsInArrow" not in x]
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, lambda i: True, 5)


def test_blocks_and_packs_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(bitslice, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(bitslice, "PACK_BYTES", 100)
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(30)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = bitslice.top_k(spark, df, df.filter("vec_id % 4 = 0"))
    # 40 vectors of 240 bytes: ten blocks, though each could hold all by their number
    assert re.search(r"pmod\(xxhash64\(row#\d+L, 42\), 10\) AS block", got._jdf.queryExecution().optimizedPlan().toString())
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, lambda i: i % 4 == 0, 5)
