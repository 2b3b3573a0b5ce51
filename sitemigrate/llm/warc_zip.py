"""WARC archives packaged as ZIP: written from a table, and read back record by record without extraction.

An archive holds two stored members: ``archive/data.warc`` with the records and ``indexes/index.cdx`` with one line
(id, offset, length) for each. The reader asks a range function for bytes: the end of the file gives the central directory
(or, past the classic limits, the ZIP64 locator and directory), that gives each member's local header and so its first
byte, and the index gives the records' ranges. No member is unpacked or copied.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemigrate.llm.common import materialize

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc", "indexes/index.cdx"
RECORD = "urn:sitemigrate:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
Read = Callable[[int, int], bytes]


# --- writing ---------------------------------------------------------------------------------------------------------


def warc_record(page_id: str | int | None, url: str | None, payload: bytes, digest: str, refers_to: str | int | None) -> bytes:
    """One response record, or a revisit of the page ``refers_to`` with the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    name = "" if page_id is None else ":" + quote(str(page_id), safe="")  # an empty id isn't a missing one
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{RECORD}{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{RECORD}:{quote(str(refers_to), safe='')}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def zip_archive(records: list[tuple[str, bytes]]) -> bytes:
    """A ZIP of stored members: the records one after the other, and their index."""
    at, index = 0, []
    for name, data in records:
        index.append(f"{name} {at} {len(data)}\n")
        at += len(data)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=at >= 1 << 31) as member:
            for _, data in records:
                member.write(data)
        z.writestr(zipfile.ZipInfo(INDEX_MEMBER), "".join(index))
    return out.getvalue()


# --- reading ---------------------------------------------------------------------------------------------------------


@dataclass
class Member:
    """A stored member: its bytes lie at ``start`` for ``size`` bytes."""

    name: str
    start: int
    size: int


def zip_members(read: Read, size: int) -> dict[str, Member]:
    """The stored members of a ZIP of ``size`` bytes, found from its central directory (or ZIP64 directory)."""
    tail_at = max(0, size - 22 - 65535)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)  # its comment must end the file
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF:
        locator = read(tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, at = struct.unpack_from("<QQQ", record, 32)
    directory, p, out = read(at, length), 0, {}
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, p + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, p + 20)
        (header,) = struct.unpack_from("<I", directory, p + 42)
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        packed, full, header = _wide(directory[p + 46 + n_name : p + 46 + n_name + n_extra], packed, full, header)
        p += 46 + n_name + n_extra + n_comment
        if method == 0 and not flags & 1:
            local = read(header, 30)
            if local[:4] != b"PK\x03\x04":
                raise ValueError(f"no local header for {name}")
            skip = sum(struct.unpack_from("<HH", local, 26))
            if header + 30 + skip + packed > size or packed != full:
                raise ValueError(f"{name} is cut short")
            out[name] = Member(name, header + 30 + skip, full)
    return out


def _wide(extra: bytes, packed: int, full: int, header: int) -> tuple[int, int, int]:
    """64-bit values from the ZIP64 extra field in place of those that are all ones."""
    p = 0
    while p + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, p)
        if tag == 1:
            q = p + 4
            if full == 0xFFFFFFFF:
                (full,) = struct.unpack_from("<Q", extra, q)
                q += 8
            if packed == 0xFFFFFFFF:
                (packed,) = struct.unpack_from("<Q", extra, q)
                q += 8
            if header == 0xFFFFFFFF:
                (header,) = struct.unpack_from("<Q", extra, q)
        p += 4 + n
    return packed, full, header


def records(read: Read, size: int) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC headers, HTTP headers, payload) of every record that the index names, each read by its own range."""
    members = zip_members(read, size)
    if WARC_MEMBER not in members or INDEX_MEMBER not in members:
        raise ValueError("the archive lacks stored records or their index")
    data, index = members[WARC_MEMBER], members[INDEX_MEMBER]
    for line in read(index.start, index.size).decode().splitlines():
        _, at, length = line.rsplit(" ", 2)
        if int(at) + int(length) > data.size:
            raise ValueError("a record's range lies outside the archive")
        record = read(data.start + int(at), int(length))
        head, _, rest = record.partition(b"\r\n\r\n")
        warc = _headers(head)
        block = rest[: int(warc["content-length"])]
        http_head, _, payload = block.partition(b"\r\n\r\n")
        yield warc, _headers(http_head), payload


def _headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


# --- jobs ------------------------------------------------------------------------------------------------------------

ARCHIVES = "archive string, content binary"


def write_archives(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, archive_bytes: int = 4 << 20) -> DataFrame:
    """A table (archive, content) of ZIP archives that hold every row of ``pages``, in the shared folder.

    Of rows with equal payloads of at least ``min_bytes`` bytes, the one with the largest id is a response and the others
    revisit it; smaller payloads are all responses. A null payload is empty. Rows that repeat the largest id are all
    responses, a null id revisits if an equal payload has an id, and equal payloads without any id are all responses.
    An archive is closed at ``archive_bytes``, so a task holds one archive and one batch of rows.
    """
    kept = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    kept = kept.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    owners = kept.filter(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.max("id").alias("owner"), F.count("*").alias("n")).filter("n > 1").drop("n")
    owners = materialize(spark, owners, "owners")
    rows = kept.join(owners, "sha1", "left").withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("owner")) & (F.octet_length("html") >= min_bytes), F.col("owner")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, held, made = [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"{hashlib.sha1(open_[0][1][:4096] + open_[-1][1][:4096] + str((made, len(open_))).encode()).hexdigest()}.zip"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([zip_archive(open_)], pa.binary())], ["archive", "content"])

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, sha1, refers_to = (batch.column(k)[i].as_py() for k in range(5))
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                data = warc_record(page, url, html.encode("utf-8"), digest, refers_to)
                open_.append(("-" if page is None else quote(page, safe=""), data))
                held += len(data)
                if held >= archive_bytes:
                    yield close()
                    open_, held, made = [], 0, made + 1
        if open_:
            yield close()

    return materialize(spark, rows.select(F.col("id").cast("string"), "url", "html", "sha1", F.col("refers_to").cast("string")).mapInArrow(write, ARCHIVES), "archives")


def read_archives(archives: DataFrame, with_payload: bool = False, id_type: str = "long") -> DataFrame:
    """One row per record of a table (archive, content); also reads the rows of Spark's ``binaryFile`` source renamed so.

    Ids are given as ``id_type`` (null where they aren't of it). Columns: page_id, url, payload_bytes and payload_digest (both of the full payload, for revisits as their headers say),
    record_type, refers_to, payload (null for revisits and unless ``with_payload``), error. A response whose payload
    doesn't have the length and digest it claims has ``error`` set; an archive that can't be read gives one row with
    only ``error``.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "error"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def page(uri: str | None) -> str | None:
        name = (uri or "").strip("<>").removeprefix(RECORD)
        return unquote(name.removeprefix(":")) if name else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                rows = []
                try:
                    if data is None:
                        raise ValueError("no content")
                    for warc, http, payload in records(lambda at, n, data=data: data.slice(at, n).to_pybytes(), data.size):
                        kind, digest, size = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                        wrong = kind == "response" and (size != len(payload) or digest != base64.b32encode(hashlib.sha1(payload).digest()).decode())
                        rows.append((page(warc["warc-record-id"]), warc["warc-target-uri"], size, digest, kind, page(warc.get("warc-refers-to")), payload if with_payload and kind == "response" else None, "payload differs from its digest" if wrong else None))
                except (ValueError, KeyError, struct.error, IndexError) as e:
                    rows.append((*[None] * 7, f"unreadable archive: {e}"))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names)

    found = archives.select("content").mapInArrow(run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary, error string")
    return found.withColumns({c: F.col(c).try_cast(id_type) for c in ("page_id", "refers_to")})


#: DuckDB SQL for the query ``op10``; a base32 digest is four runs of eight digits, each of 40 bits.
_B32 = "translate(" + " || ".join(f"to_base(('0x' || substr(d, {1 + 10 * i}, 10))::BIGINT, 32, 8)" for i in range(4)) + ", '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
     w AS (SELECT d, max(page_id) AS owner FROM p GROUP BY d)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM p JOIN w USING (d)
"""
