"""WARC archives in Zstandard: writer, and a reader that trusts nothing.

An archive starts with a skippable frame that holds the dictionary its records were compressed
with (trained on its own first records); every record is one frame. The reader loads the
dictionary, decodes frame by frame in small steps, and checks version, mandatory headers,
lengths and digests; a record that fails is reported with its place and reason, and after a
frame that can't be decoded, or a dictionary that can't be loaded, nothing of that archive is
trusted. A frame may hold no more than its record's head declares, so a small frame can't fill
the memory of a task.

Archives are rows (archive, content) of a table in the shared folder, as Spark's binaryFile source
would deliver files, so executors need no folder of their own; each task fills its archives as it
reads, and a repeated task makes the same ones.

Equal payloads are stored once: the row of least page_id is the response, the others revisit
it. The first row per digest is a grouped minimum (combined before the shuffle). Only digests that
occur again are joined back: broadcast where they are few, so that no payload is shuffled, else by
a join whose crowded digests Spark can split.

Defined results: a null payload is empty; rows of equal page_id and payload are all responses if
theirs is the least id; a null page_id is kept and revisits when another row has its payload;
null urls have no target header; line breaks in urls are percent-encoded; other columns are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import cut, gathered, small_batches, table

DICT_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
STEP = 1 << 10  # a block of 128 KB takes 4 bytes at least, so a step decodes 32 MB at most
MOST_HEAD = 1 << 20
MOST_DICTIONARY = 64 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Params:
    """``archive_bytes`` of payload close an archive; ``sample_bytes`` of its first records train a
    dictionary of ``dict_bytes``; payloads below ``least_revisit`` bytes are never revisits."""

    archive_bytes: int = 8 << 20
    sample_bytes: int = 1 << 20
    dict_bytes: int = 64 << 10
    level: int = 3
    least_revisit: int = 0
    date: str = "2020-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, p: Params) -> bytes:
    """A WARC/1.1 response or revisit record."""
    return _record(page_id, url, payload, len(payload), digest32(payload), refers_to, revisit, p)


def _record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, revisit: bool, p: Params) -> bytes:
    """The same; a revisit needs no payload. Its HTTP head still tells the length of what it leaves out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{_id(page_id)}>", f"WARC-Date: {p.date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub("[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{_id(refers_to)}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _id(page_id: int | None) -> str:
    return "none" if page_id is None else str(page_id)


def pack(records: list[bytes], p: Params) -> bytes:
    """An archive: the dictionary's frame, if one can be trained, then a frame for each record."""
    samples, size = [], 0
    for r in records:
        if size >= p.sample_bytes:
            break
        samples.append(r[: p.sample_bytes - size])
        size += len(samples[-1])
    try:
        d = zstandard.train_dictionary(min(p.dict_bytes, max(1024, size // 8)), samples)
    except zstandard.ZstdError:
        d = None
    packer = zstandard.ZstdCompressor(level=p.level, dict_data=d, write_checksum=True)
    frames = [packer.compress(r) for r in records]
    if d is not None:
        content = zstandard.ZstdCompressor(level=p.level).compress(d.as_bytes())
        frames.insert(0, struct.pack("<II", DICT_MAGIC, len(content)) + content)
    return b"".join(frames)


class Broken(ValueError):
    """A frame or record that doesn't keep to the format."""


def _dictionary(raw: bytes) -> zstandard.ZstdDecompressor:
    """A reader with the dictionary of the leading frame, which may itself be compressed."""
    try:
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            size = zstandard.get_frame_parameters(raw).content_size
            if size > MOST_DICTIONARY:  # unknown sizes are the largest number
                raise Broken("the dictionary's size is unknown or too large")
            raw = zstandard.ZstdDecompressor().decompress(raw)
        # a trained dictionary begins with its magic number; others would pass as raw content
        if raw[:4] != struct.pack("<I", 0xEC30A437):
            raise Broken("the leading frame holds no dictionary")
        return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    except (zstandard.ZstdError, MemoryError) as e:
        raise Broken(f"dictionary: {e}") from e


def _declared(head: bytes) -> int | None:
    """Bytes of a record by its head, or None while the head isn't complete."""
    end = head.find(b"\r\n\r\n")
    if end < 0:
        return None
    length = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]{1,15})[ \t]*(?=\r\n)", head[: end + 2])
    return end + 8 + int(length[1]) if length else end + 8


def frames(content: bytes) -> Iterator[bytes]:
    """Decoded data frames of an archive in order."""
    view, at, opener = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        if len(view) - at < 8:
            raise Broken(f"{len(view) - at} bytes at {at} are no frame")
        magic, size = struct.unpack_from("<II", view, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(view):
                raise Broken(f"skippable frame at {at} is longer than the archive")
            if magic == DICT_MAGIC and at == 0:
                opener = _dictionary(bytes(view[8 : 8 + size]))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise Broken(f"no frame at {at}")
        d, out, most, fed = opener.decompressobj(), bytearray(), None, at
        while not d.eof:
            if fed >= len(view):
                raise Broken(f"frame at {at} is cut off")
            try:
                out += d.decompress(bytes(view[fed : fed + STEP]))
            except (zstandard.ZstdError, MemoryError) as e:
                raise Broken(f"frame at {at}: {e}") from e
            fed = min(fed + STEP, len(view))
            if most is None:
                most = _declared(bytes(out[:MOST_HEAD]))
            if len(out) > (MOST_HEAD if most is None else most):
                raise Broken(f"frame at {at} holds more than its head declares")
        at = fed - len(d.unused_data)
        yield bytes(out)


def parse(raw: bytes) -> dict:
    """Headers, type and payload of a record, after all checks."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.") or end < 0:
        raise Broken("no WARC head")
    headers: dict[str, str] = {}
    for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Broken(f"header without colon: {line[:40]}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise Broken(f"no {name}")
    if not headers["content-length"].isascii() or not headers["content-length"].isdigit():
        raise Broken("content-length is no number")
    block, tail = raw[end + 4 : end + 4 + int(headers["content-length"])], raw[end + 4 + int(headers["content-length"]) :]
    if len(block) != int(headers["content-length"]) or tail != b"\r\n\r\n":
        raise Broken("content-length doesn't fit the record")
    if headers.get("warc-block-digest", "sha1:" + digest32(block)) != "sha1:" + digest32(block):
        raise Broken("block digest differs")
    out = {"headers": headers, "type": headers["warc-type"], "payload": block, "bytes": len(block)}
    if headers.get("content-type", "").startswith("application/http"):
        head = block.find(b"\r\n\r\n")
        length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)\s*\r\n", block[: head + 2])
        if head < 0 or not length:
            raise Broken("no HTTP head")
        out |= {"payload": block[head + 4 :], "bytes": int(length[1])}
        if out["type"] == "response" and len(out["payload"]) != out["bytes"]:
            raise Broken("HTTP length doesn't fit the payload")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if out["type"] == "response" and digest != digest32(out["payload"]):
        raise Broken("payload digest differs")
    if out["type"] == "revisit" and not (digest and "warc-refers-to" in headers and "warc-profile" in headers):
        raise Broken("revisit without digest, profile or target")
    return out | {"digest": digest}


def plan(pages: DataFrame, p: Params) -> DataFrame:
    """page_id, url, payload (null of revisits), its size and SHA-1, revisit and refers_to of every row."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumns({"size": F.length("payload").cast("long"), "digest": F.sha1("payload")})
    firsts = rows.filter(F.col("size") >= p.least_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    again = ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull() & (F.col("size") >= p.least_revisit)
    joined = rows.join(gathered(firsts.select("digest", "first"), 200), "digest", "left")
    return joined.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "size", F.unhex("digest").alias("digest"), again.alias("revisit"), F.when(again, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """(archive, content): the archives of all rows of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size, records = TaskContext.get().partitionId(), 0, 0, []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"part-{part:06d}-{number:05d}.warc.zst"], "content": pa.array([pack(records, p)], pa.binary())})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, payload, length, digest, revisit, refers_to = row
                records.append(_record(page_id, url, payload, length, base64.b32encode(digest).decode(), refers_to, revisit, p))
                size += len(records[-1])
                if size >= p.archive_bytes:
                    yield close()
                    number, size, records = number + 1, 0, []
        if records:
            yield close()

    return plan(pages, p).mapInArrow(run, "archive string, content binary")


READ = "archive string, page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint, error string"


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of archives (archive, content), in order; ``error`` tells what is wrong."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(archives.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(READ))

    def number(urn: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(m[1]) if m else None

    def records(name: str, content: bytes) -> Iterator[tuple]:
        it = frames(content or b"")
        while True:
            try:
                raw = next(it)
                r = parse(raw)
                h = r["headers"]
                yield (name, number(h["warc-record-id"]), h.get("warc-target-uri"), r["type"], r["payload"], r["bytes"], r["digest"], number(h.get("warc-refers-to")), None)
            except StopIteration:
                return
            except Broken as e:
                yield (name, None, None, None, None, None, None, None, str(e))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                size = 0
                for r in records(name, content.as_py()):
                    rows.append(r)
                    size += len(r[4] or b"")
                    if size > 1 << 22:
                        yield _batch(rows, out)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, out)

    return archives.select("archive", "content").mapInArrow(run, READ)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def op9_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_archives(cut(write_archives(table(spark, sf_dir, "pages"))))
    sound = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("broken archive "), "archive", F.lit(": "), "error")))
    return read.select("page_id", "payload_bytes", "payload_digest", sound.alias("record_type"), "refers_to")


def warc_sql(p: Params = Params()) -> str:
    """The contract of op9 in SQL; base32 by five bits a character."""
    nibbles = ", ".join(f"'{i:04b}'" for i in range(16))
    bits = f"array_to_string(list_transform(string_split(h, ''), lambda c: [{nibbles}][strpos('0123456789abcdef', c)]), '')"
    value = " + ".join(f"{1 << (4 - j)} * substr(b, (5 * k + {j + 1})::BIGINT, 1)::INT" for j in range(5))
    return f"""
WITH r AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM r WHERE n >= {p.least_revisit} GROUP BY h),
b AS (SELECT page_id, n, h, {bits} AS b, CASE WHEN page_id <> first THEN first END AS refers_to FROM r LEFT JOIN f USING (h))
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {value}, 1)), '') AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM b"""
