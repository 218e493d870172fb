"""WARC (operator 13): writer and reader of Zstandard archives, one frame a record, the dictionary in front.

``write`` turns pages into archives of bounded size, rows of (path, content). An archive starts with a skippable
frame that holds the dictionary, itself compressed, and a warcinfo record; every record is a frame of its own with its length
and checksum. Of records with equal payloads of at least ``min_bytes`` the one of the smallest id is a response, the others are
revisits of it without a payload. ``read`` takes rows of (path, content), as ``write`` or Spark's ``binaryFile`` source give
them: it loads the dictionary from the leading frame, finds each frame's end from its block headers, decodes a frame at
a time, and checks versions, mandatory fields, lengths and digests. What fails is a row with its ``error``; a broken frame
ends its archive, as nothing behind it can be found.

A null payload is an empty one. Null ids come last among equal payloads and are not written, nor referred to; of repeated
rows one is the response. A null or empty URL is written as ``about:invalid``; control characters and spaces in URLs are percent-encoded. Texts
of any length are whole records; an archive ends with the record that fills it. An empty table gives no archive. Without enough
pages to train a dictionary there is none, and no leading frame. The dictionary is trained on at most ``SAMPLE`` payloads, cut to
``SAMPLE_BYTES`` for that purpose.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions.joins import lookup
from pluvio.llm.common import kept, ship

# Compressed bytes that fill an archive: one archive is one row, and a task holds a few rows.
ARCHIVE_BYTES = 1 << 20
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 1 << 14, 1 << 15
LEVEL = 3
# Fixed values of the formats: version line, profile, magic numbers of the dictionary frame, of a dictionary and of a frame.
VERSION = "WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_FRAME, DICTIONARY, FRAME = 0x184D2A5D, b"\x37\xa4\x30\xec", b"\x28\xb5\x2f\xfd"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
NO_URL = "about:invalid"
PAGE_ID, REFERS_TO = "Page-Id", "Refers-To-Page-Id"

FILES = "path string, content binary"
RECORDS = (
    "path string, offset long, length long, type string, record_id string, target_uri string, headers map<string,string>, "
    "http_headers map<string,string>, payload binary, error string"
)


def sha1_base32(payload: Column) -> Column:
    """SHA-1 of bytes in upper-case base 32."""
    hexed = F.sha1(payload)
    chunks = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*chunks), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# writing --------------------------------------------------------------------------------------


def stage(pages: DataFrame, id: str, url: str, html: str) -> DataFrame:
    """(row, id, url, payload, digest, size, mark), written once with a number, so that repeated rows can be told apart."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), payload.alias("payload")).select(
        "*",
        sha1_base32(F.col("payload")).alias("digest"),
        F.octet_length("payload").cast("long").alias("size"),
        F.xxhash64("payload").alias("mark"),  # beside the digest, for which collisions are known
        F.monotonically_increasing_id().alias("row"),
    )
    return kept(rows, "pages")


def classify(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to``, a struct of the response's row and id, null for responses; only payloads that occur again are looked up."""
    same = ["digest", "size", "mark"]
    rank = F.struct(F.col("id").isNull(), "id", "row")
    groups = rows.filter(F.col("size") >= min_bytes).groupBy(*same).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("row", "id"), rank).alias("response")
    )
    repeated = kept(groups.filter("n > 1").drop("n"), "repeated")
    found = lookup(rows, repeated, same, spread="row")
    other = F.col("response.row") != F.col("row")
    return found.select("row", "id", "url", "payload", "digest", F.when(other, F.col("response")).alias("refers_to"))


def train(rows: DataFrame) -> bytes:
    """A dictionary fitted to a bounded sample of payloads; empty if there are too few."""
    full = rows.filter("size > 0").withColumn("h", F.xxhash64("digest", "row"))
    last = full.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]  # tasks send hashes only
    picked = full.filter(F.col("h") <= F.lit(last)).orderBy("h").limit(SAMPLE)
    samples = [bytes(r[0]) for r in picked.select(F.substring("payload", 1, SAMPLE_BYTES)).collect()]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def leading_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed


def record_id(row: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{row}:{digest}')}>"


def safe_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else NO_URL


def record(fields: dict[str, object], block: bytes) -> bytes:
    """A record: version line, named fields without null ones, block."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page_record(row: dict, date: str) -> bytes:
    payload, refers_to = row["payload"], row["refers_to"]
    target = safe_url(row["url"])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    fields = {
        "WARC-Type": "revisit" if refers_to else "response",
        "WARC-Record-ID": record_id(row["row"], row["digest"]),
        "WARC-Date": date,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{row['digest']}",
        "WARC-Block-Digest": f"sha1:{_base32(block)}",
        "Content-Type": "application/http; msgtype=response",
        PAGE_ID: row["id"],
    }
    if refers_to:
        fields |= {
            "WARC-Profile": IDENTICAL,
            "WARC-Refers-To": record_id(refers_to["row"], row["digest"]),
            REFERS_TO: refers_to["id"],
        }
    return record(fields, block)


def _writer(dictionary: bytes, date: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True)
        front = leading_frame(dictionary) if dictionary else b""
        part, n, content = TaskContext.get().partitionId(), 0, bytearray()

        def done() -> pa.RecordBatch:
            nonlocal n
            name = f"pages-{part:05d}-{n:05d}.warc.zst"
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([bytes(content)], pa.binary())], names=["path", "content"])

        for batch in batches:
            for k in range(batch.num_rows):
                if not content:
                    info = {
                        "WARC-Type": "warcinfo",
                        "WARC-Record-ID": record_id(-1 - n, str(part)),
                        "WARC-Date": date,
                        "Content-Type": "application/warc-fields",
                    }
                    content += front + packer.compress(record(info, f"format: {VERSION}\r\n".encode()))
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                content += packer.compress(_page_record(row, date))
                if len(content) >= archive_bytes:
                    yield done()
                    content.clear()
        if content:
            yield done()

    return run


def write(
    pages: DataFrame,
    id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """(path, content): the archives of the pages, written to the shared folder."""
    ship(pages.sparkSession)
    rows = stage(pages, id, url, html)
    return kept(classify(rows, min_bytes).mapInArrow(_writer(train(rows), date, archive_bytes), FILES), "archives")


def save(archives: DataFrame, folder: str) -> DataFrame:
    """Archives as files of a folder that all executors mount; gives their paths and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                target = Path(folder) / path
                target.parent.mkdir(parents=True, exist_ok=True)
                partial = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
                partial.write_bytes(content)
                partial.replace(target)  # a task that runs again replaces the whole file
            sizes = [len(c) for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], names=["path", "size"])

    return archives.select("path", "content").mapInArrow(run, "path string, size long")


# reading --------------------------------------------------------------------------------------


def frame_end(data: bytes, start: int) -> int:
    """Where the frame ends that starts here, from its header and those of its blocks."""
    head = data[start : start + 18]
    at = start + zstandard.frame_header_size(head)
    last = False
    while not last:
        if at + 3 > len(data):
            raise ValueError("frame cut off")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        if kind == 3:
            raise ValueError("reserved block type")
        at += 3 + (1 if kind == 1 else size)
    at += 4 * zstandard.get_frame_parameters(head).has_checksum
    if at > len(data):
        raise ValueError("frame cut off")
    return at


def frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, decoded bytes) of each frame behind the dictionary; other skippable frames are passed over."""
    at, reader = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) < at + 8:
            raise ValueError("bytes behind the last frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic >> 4 == 0x184D2A5:
            if at + 8 + size > len(data):
                raise ValueError("skippable frame cut off")
            if at == 0 and magic == DICTIONARY_FRAME:
                raw = data[8 : 8 + size]
                if raw[:4] == FRAME:
                    raw = reader.decompressobj().decompress(raw)
                if raw[:4] != DICTIONARY:
                    raise ValueError("leading frame without a dictionary")
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
            continue
        end = frame_end(data, at)
        yield at, end - at, reader.decompressobj().decompress(data[at:end])
        at = end


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"not a field: {line[:40]!r}")
        out.setdefault(name.lower(), value.strip())
    return out


def _same_digest(stated: str | None, data: bytes, what: str) -> None:
    """SHA-1 digests are compared; other algorithms are left to those who know them."""
    if stated and stated.lower().startswith("sha1:") and stated[5:].upper() != _base32(data):
        raise ValueError(f"{what} digest differs")


def parse(data: bytes) -> dict[str, object]:
    """The parts of one record, after its checks."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not blank or not re.fullmatch(rb"WARC/1\.[01]", version):
        raise ValueError("no version line or no end of the header")
    fields = _fields(lines)
    if missing := [m for m in MANDATORY if not fields.get(m)]:
        raise ValueError(f"without {', '.join(missing)}")
    if not re.fullmatch(r"[0-9]+", fields["content-length"]):
        raise ValueError("Content-Length is no number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError(f"Content-Length {size}, but {len(rest) - 4} bytes")
    block, kind, http, payload = rest[:size], fields["warc-type"], None, None
    _same_digest(fields.get("warc-block-digest"), block, "block")
    if kind in ("response", "revisit") and "warc-target-uri" not in fields:
        raise ValueError("without warc-target-uri")
    if fields.get("content-type", "").startswith("application/http"):
        top, blank, payload = block.partition(b"\r\n\r\n")
        if not blank:
            raise ValueError("no end of the HTTP header")
        http = _fields(top.split(b"\r\n")[1:])
    if kind == "response" and payload is not None:
        if http.get("content-length", str(len(payload))) != str(len(payload)):
            raise ValueError("HTTP Content-Length differs")
        _same_digest(fields.get("warc-payload-digest"), payload, "payload")
    if kind == "revisit":
        if not fields.get("warc-profile") or not fields.get("warc-payload-digest"):
            raise ValueError("revisit without profile or digest")
        payload = None
    return {
        "type": kind,
        "record_id": fields["warc-record-id"],
        "target_uri": fields.get("warc-target-uri"),
        "headers": list(fields.items()),
        "http_headers": None if http is None else list(http.items()),
        "payload": payload,
    }


def records(path: str, data: bytes) -> Iterator[dict[str, object]]:
    """The rows of an archive."""
    found, at = frames(data), 0
    while True:
        try:
            at, length, decoded = next(found)
        except StopIteration:
            return
        except (zstandard.ZstdError, ValueError) as e:
            yield {"path": path, "offset": at, "error": f"{type(e).__name__}: {e}"}
            return
        row = {"path": path, "offset": at, "length": length}
        try:
            yield row | parse(decoded)
        except ValueError as e:  # undecodable fields among them
            yield row | {"error": str(e)}
        at += length


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives (path, content), a row each; payloads are checked also where they are not wanted."""
    ship(archives.sparkSession)
    names = [c.split()[0] for c in re.split(r", (?=\w+ )", RECORDS)]
    text = pa.map_(pa.string(), pa.string())
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), text, text, pa.binary(), pa.string()]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows, size = [], 0
                for row in records(path.as_py(), content.as_py()):
                    if payloads:
                        size += len(row.get("payload") or b"")
                    else:
                        row["payload"] = None
                    rows.append(row)
                    if size >= ARCHIVE_BYTES or len(rows) >= 4096:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return archives.select("path", "content").mapInArrow(run, RECORDS)
