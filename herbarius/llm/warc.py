"""WARC archives: a writer with revisit records, and a reader that splits compressed files.

Each record is a gzip member of its own.  The reader cuts files into byte ranges; a task looks
for gzip magic inside its range, takes a candidate for a member only if it decodes, its checksum
and length included, to records whose headers and lengths are sound, and owns the records that start inside its
range, reading past the range's end to finish the last.  What stands between members, padding or damage, is passed over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, slices

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 18
#: An empty gzip member; it ends in a zero byte and holds no record.
EMPTY_MEMBER = zlib.compressobj(1, zlib.DEFLATED, 31).flush()
RECORD = "urn:x-page:"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A value that fits a header line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """The gzip member of a response, or of a revisit if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD}{page}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{RECORD}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record per row of ``pages`` (``page_id, url, html``) to files under ``path``.

    Of equal payloads of at least ``min_revisit_bytes`` bytes the row with the smallest id is
    the response (all of them, if it is repeated) and the others revisit it; rows without an
    id are responses.  A null html is an empty payload, a null url is left out.

    The smallest ids meet in a partial aggregate by digest.  Spark's text sink writes the
    bytes, with its commit of whole tasks: each member's last byte, the high byte of a length
    under 16 MB and so zero, is the line separator (larger members get an empty one behind).
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    firsts = rows.filter(F.octet_length("html") >= min_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first"))
    rows = rows.join(firsts, "sha", "left")
    rows = rows.select("page_id", "url", "html", F.when((F.octet_length("html") >= min_revisit_bytes) & (F.col("first") < F.col("page_id")), F.col("first")).alias("refers_to"))

    def pack(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                out = []
                for x in part.to_pylist():
                    member = record("" if x["page_id"] is None else str(x["page_id"]), x["url"], x["html"].encode("utf-8", "surrogatepass"), None if x["refers_to"] is None else str(x["refers_to"]), date)
                    out.append((member if member[-1] == 0 else member + EMPTY_MEMBER)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["member"])

    rows.mapInArrow(pack, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def _opened(path: str):
    """A file of any store that pyarrow knows, and its size."""
    where = re.sub(r"^file:/+", "/", path)
    store, name = (fs.LocalFileSystem(), where) if where.startswith("/") else fs.FileSystem.from_uri(where)
    return store.open_input_file(name)


class _Bytes:
    """Random access to a file through one buffered block."""

    def __init__(self, file):
        self.file, self.size, self.at, self.block = file, file.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.block)):
            self.block = self.file.read_at(min(max(n, CHUNK), max(0, self.size - at)), at)
            self.at = at
        return self.block[at - self.at : at - self.at + n]


def member_at(data: _Bytes, at: int) -> tuple[bytes, int] | None:
    """The content and end of the WARC member that starts at a byte, or None if none does."""
    unpacker, out, pos = zlib.decompressobj(31), [], at
    while not unpacker.eof:
        chunk = data.get(pos, min(CHUNK, data.size - pos)) if pos < data.size else b""
        if not chunk:
            return None
        pos += len(chunk)
        try:
            out.append(unpacker.decompress(chunk))
        except zlib.error:
            return None
        if len(out) == 1 and len(out[0]) >= 5 and not out[0].startswith(b"WARC/"):
            return None
    content, end = b"".join(out), pos - len(unpacker.unused_data)
    return (content, end) if _sound(content) else None


def _sound(content: bytes) -> bool:
    """Whether a member is records from beginning to end: headers, and as many bytes as they say.

    A record without a length that can be read is the last one.
    """
    while content.startswith(b"WARC/") and b"\r\n\r\n" in content:
        head, _, rest = content.partition(b"\r\n\r\n")
        n = _number(_fields(head.decode("utf-8", "replace").split("\r\n")[1:]).get("content-length"))
        if n is None:
            return True
        if n > len(rest):
            return False
        content = rest[n:].lstrip(b"\r\n")
        if not content:
            return True
    return False


def members(data: _Bytes, start: int, stop: int) -> Iterator[bytes]:
    """Contents of the members that start in [start, stop)."""
    at = start
    while at < stop:
        window = data.get(at, min(CHUNK, min(stop + 2, data.size) - at))
        hit = window.find(MAGIC)
        if hit < 0 or at + hit >= stop:
            at += max(1, len(window) - 2)
            continue
        at += hit
        found = member_at(data, at)
        if found is None:
            at += 1
            continue
        content, at = found
        yield content


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch("[0-9]{1,18}", text) else None


def parse(content: bytes) -> dict:
    """Headers and payload of a record, and what follows it.

    The payload of an HTTP message is its body, as it was sent, and that of any other record its
    block.  Without a length that can be read the block goes on to the blank line at the end.
    """
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = _fields(head.decode("utf-8", "replace").split("\r\n")[1:])
    n = _number(headers.get("content-length"))
    block = rest.removesuffix(b"\r\n\r\n") if n is None else rest[:n]
    http, payload = {}, block
    if headers.get("content-type", "").lower().startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(top.decode("latin-1").split("\r\n")[1:])
    return {"headers": headers, "http": http, "payload": payload, "rest": b"" if n is None else rest[n:].lstrip(b"\r\n")}


def records(content: bytes) -> Iterator[dict]:
    """The records of a member, which mostly is one."""
    while content.startswith(b"WARC/"):
        r = parse(content)
        yield r
        content = r["rest"]


def _page(uri: str | None) -> int | None:
    """The page behind a record id of :func:`write_warc`; null for others."""
    name = (uri or "").strip("<>")
    digits = name.removeprefix(RECORD)
    return int(digits) if name != digits and re.fullmatch("-?[0-9]{1,19}", digits) else None


def _row(r: dict) -> dict:
    h, kind = r["headers"], r["headers"].get("warc-type")
    whole = None if kind == "revisit" else r["payload"]
    digest = h.get("warc-payload-digest", "").partition(":")
    return {
        "record_id": h.get("warc-record-id", "").strip("<>") or None,
        "page_id": _page(h.get("warc-record-id")),
        "url": h.get("warc-target-uri", "").strip("<>") or None,
        "record_type": kind,
        "payload": whole,
        "payload_bytes": _number(r["http"].get("content-length")) if whole is None else len(whole),
        "payload_digest": ((digest[2] if digest[0].lower() == "sha1" else None) or None) if whole is None else base32_sha1(whole),
        "refers_to": _page(h.get("warc-refers-to")),
        "refers_to_record": h.get("warc-refers-to", "").strip("<>") or None,
    }


def read_warc(spark: SparkSession, path: str, split_bytes: int = 16 << 20) -> DataFrame:
    """``record_id, page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to,
    refers_to_record`` of each record of any type under ``path``.

    ``payload`` is null for revisits, whose length and digest come from their headers (null
    if these lack them); those of others are computed from what was read.  ``page_id`` and
    ``refers_to`` are null unless :func:`write_warc` made the record.  Headers that are missing
    give nulls; bytes that don't decode to a record are passed over.  A member is held in
    memory, so an archive packed as one member can't be split.
    """
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "length")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    arrow = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("refers_to_record", pa.string())])

    def scan(batches):
        for batch in batches:
            for x in batch.to_pylist():
                with _opened(x["path"]) as file:
                    rows, held = [], 0
                    for content in members(data := _Bytes(file), x["start"], min(x["start"] + split_bytes, data.size)):
                        rows += map(_row, records(content))
                        held += len(content)
                        if held > 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    n = max(1, min(10_000, ranges.count()))
    return ranges.repartition(n).mapInArrow(scan, "record_id string, page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint, refers_to_record string")


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` into the shared folder and read the archives back, without payloads."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path, min_revisit_bytes)
    return read_warc(spark, path).drop("payload")
