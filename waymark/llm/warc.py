"""Legacy archives to WARC.

An ARC file opens with a version block, which names the fields of the record
header lines that follow (five in version 1, ten in version 2); each record is
such a line, as many bytes as it declares, and a line feed.  The converter
reads these by their declared lengths and synthesises WARC identifiers, dates,
types and digests.  Archives are gzip members, one for each record, written by
Spark's text sink with an empty member as its separator: any gzip reader skips
it, and Spark can split an archive at it, so no archive is ever read whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import fresh_path, materialize

# The field lists of the two versions of ARC header lines, and WARC names.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_VERSION = "WARC/1.1"
#: Payloads below this many bytes are never replaced by a revisit record.
REVISIT_BYTES = 1000
#: The capture date of pages that state none.
CAPTURE_DATE = "20240101000000"

#: A gzip member that holds nothing; in no member of a record but by a chance of 2^-160.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)

RECORDS = "record_id string, date string, type string, uri string, content_type string, page_id long, block binary, payload_bytes long, payload_digest string"
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, uri string, date string, refers_to_record string"


def _field(s: str | None) -> str:
    """A header field can't hold white space or control characters; an empty one is a hyphen."""
    return "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in (s or "").encode("utf-8", "surrogatepass")).encode("latin-1").decode("utf-8", "replace") or "-"


def arc_bytes(records: list[dict], version: int) -> bytes:
    """An ARC file of records (url, ip, date, content_type, block)."""
    intro = f"{version} 0 waymark\n{ARC_FIELDS[version]}\n".encode()
    first = {"URL": "filedesc://waymark.arc", "IP-address": "0.0.0.0", "Archive-date": CAPTURE_DATE, "Content-type": "text/plain"}
    out = []
    for r, body in [(first, intro), *(({"URL": _field(r["url"]), "IP-address": r["ip"], "Archive-date": r["date"], "Content-type": r["content_type"]}, r["block"]) for r in records)]:
        # the block that names the fields is itself always headed in version 1
        names = ARC_FIELDS[1 if body is intro else version].split(" ")
        line = " ".join({**r, "Archive-length": str(len(body)), "Result-code": "200", "Offset": "0", "Filename": "waymark.arc"}.get(n, "-") for n in names)
        out += [line.encode("utf-8"), b"\n", body, b"\n"]
    return b"".join(out)


def read_arc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an ARC file, the version block first: header fields by name, and the declared bytes.

    A header that fits neither field list, or a block that ends early, is a
    ValueError; blank lines between records are skipped.
    """
    names = ARC_FIELDS[1].split(" ")
    while line := stream.readline():
        if not line.strip():
            continue
        values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if len(values) != len(names):
            raise ValueError(f"ARC header of {len(values)} fields, not {len(names)}")
        header = dict(zip(names, values, strict=True))
        size = int(header["Archive-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"ARC block of {len(block)} bytes, not {size}")
        if header["URL"].startswith("filedesc:"):
            lines = block.decode("utf-8", "replace").splitlines()
            if lines[0].split(" ")[0] not in ("1", "2") or lines[1] not in ARC_FIELDS.values():
                raise ValueError("unknown version of ARC")
            yield header, block
            names = lines[1].split(" ")
        else:
            yield header, block


def _date(arc_date: str) -> str:
    """14 digits (shorter: zeros follow) as an ISO 8601 instant."""
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{max(d[4:6], '01')}-{max(d[6:8], '01')}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and payload of an HTTP message; no blank line: all head."""
    at = block.find(b"\r\n\r\n")
    return (block[: at + 4], block[at + 4 :]) if at >= 0 else (block, b"")


def convert(header: dict[str, str], block: bytes, place: str = "") -> dict:
    """One ARC record as the fields of a WARC record; ``place`` tells records apart that are equal."""
    url = header["URL"]
    if url.startswith("filedesc:"):
        kind, content_type, payload = "warcinfo", "application/warc-fields", block
    elif block.startswith(b"HTTP/"):
        kind, content_type, payload = "response", "application/http; msgtype=response", split_http(block)[1]
    else:
        kind, content_type, payload = "resource", header["Content-type"], block
    page = None
    if kind == "response":
        head = split_http(block)[0]
        at = head.find(b"\r\nX-Page-Id: ")
        page = int(head[at + 13 : head.index(b"\r\n", at + 2)]) if at >= 0 else None
    name = hashlib.sha1("\n".join([url, header["Archive-date"], place]).encode() + b"\n" + block).digest()
    return {
        "record_id": f"<urn:uuid:{uuid.UUID(bytes=name[:16], version=5)}>",
        "date": _date(header["Archive-date"]),
        "type": kind,
        "uri": url,
        "content_type": content_type,
        "page_id": page,
        "block": block,
        "payload_bytes": len(payload),
        "payload_digest": hashlib.sha1(payload).hexdigest(),
    }


def _base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def warc_record(r: dict, refers: dict | None = None) -> bytes:
    """Header, blank line, block and the two line ends after it; with ``refers`` (page_id, record_id, uri, date) a revisit of that record, without its payload."""
    block = r["block"]
    kind = r["type"]
    extra = []
    if refers is not None:
        kind, block = "revisit", split_http(block)[0]
        extra = [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {refers['record_id']}", f"WARC-Refers-To-Target-URI: {refers['uri']}", f"WARC-Refers-To-Date: {refers['date']}", f"X-Refers-To-Page-Id: {refers['page_id']}"]
    uri = [] if kind == "warcinfo" else [f"WARC-Target-URI: {r['uri']}"]
    payload = [] if kind == "warcinfo" else [f"WARC-Payload-Digest: {_base32(r['payload_digest'])}", f"X-Payload-Length: {r['payload_bytes']}"]
    lines = [
        WARC_VERSION,
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {r['record_id']}",
        f"WARC-Date: {r['date']}",
        *uri,
        f"WARC-Block-Digest: {_base32(hashlib.sha1(block).hexdigest())}",
        *payload,
        *extra,
        f"Content-Type: {r['content_type']}",
        f"Content-Length: {len(block)}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8") + block + b"\r\n\r\n"


def _info(place: str) -> dict:
    """The record that opens an archive."""
    block = b"software: waymark\r\nformat: WARC File Format 1.1\r\n"
    name = hashlib.sha1(f"warcinfo {place}".encode()).digest()
    return {"record_id": f"<urn:uuid:{uuid.UUID(bytes=name[:16], version=5)}>", "date": _date(CAPTURE_DATE), "type": "warcinfo", "content_type": "application/warc-fields", "block": block}


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def read_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a WARC file, by their declared lengths."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        header = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
            header[k] = v
        size = int(header["Content-Length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"WARC block of {len(block)} bytes, not {size}")
        yield header, block


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


_RECORD_SCHEMA = pa.schema([("record_id", pa.string()), ("date", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("content_type", pa.string()), ("page_id", pa.int64()), ("block", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
_PAGE_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("refers_to_record", pa.string())])
#: Bytes of blocks in one batch between the JVM and Python.
_BATCH = 8 << 20


def _batched(records, schema, size):
    rows, held = [], 0
    for r in records:
        rows.append(r)
        held += size(r)
        if held >= _BATCH or len(rows) >= 2000:
            yield _arrow(rows, schema)
            rows, held = [], 0
    if rows:
        yield _arrow(rows, schema)


def _pages_to_arc(batches):
    """Two archives for each batch of pages, one in each version of the format."""
    for b in batches:
        groups = {1: [], 2: []}
        for page, url, html in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
            payload = (html or "").encode("utf-8", "surrogatepass")
            tag = f"X-Page-Id: {page}\r\n" if page is not None else ""
            head = f"HTTP/1.1 200 OK\r\n{tag}Content-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
            groups[1 + (page or 0) % 2].append({"url": url, "ip": "0.0.0.0", "date": CAPTURE_DATE, "content_type": "text/html", "block": head.encode() + payload})
        for version, rows in groups.items():
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([arc_bytes(rows, version)], pa.large_binary())], names=["content"])


def _convert_arcs(batches):
    part = TaskContext.get().partitionId()

    def records():
        n = 0
        for b in batches:
            for content in b.column(0).to_pylist():
                for h, block in read_arc(io.BytesIO(content)) if content else ():
                    n += 1
                    yield convert(h, block, f"{part}/{n}")

    # the version block becomes the warcinfo record that opens each archive when it is written
    yield from _batched((r for r in records() if r["type"] != "warcinfo"), _RECORD_SCHEMA, lambda r: len(r["block"]))


def _arc_convert_pages(batches):
    return _convert_arcs(_pages_to_arc(batches))


def convert_arcs(arcs: DataFrame, *, content_col: str = "content") -> DataFrame:
    """The WARC records of ARC files, one file per row of ``content_col`` (null and empty files have none)."""
    return arcs.select(F.col(content_col).alias("content")).mapInArrow(_convert_arcs, RECORDS)


def mark_revisits(records: DataFrame, *, least: int = REVISIT_BYTES) -> DataFrame:
    """Records (a written table) with ``refers``: page_id, record_id, uri and date of the response that holds the payload, null for responses themselves."""
    holder = F.max(F.struct("page_id", "record_id", "uri", "date")).alias("holder")
    same = records.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).groupBy("payload_digest", "payload_bytes").agg(holder, F.count("*").alias("n")).where("n > 1")
    same = materialize(same.drop("n"), "payloads")
    out = records.join(same, ["payload_digest", "payload_bytes"], "left")
    return out.withColumn("refers", F.when(F.col("page_id") != F.col("holder.page_id"), F.col("holder"))).drop("holder")


def _to_warc(batches):
    part, opened = TaskContext.get().partitionId(), False
    for b in batches:
        members = [_member(warc_record(r, r["refers"])) for r in b.to_pylist()]
        if members and not opened:
            members.insert(0, _member(warc_record(_info(str(part)))))
            opened = True
        yield pa.RecordBatch.from_arrays([pa.array(members, pa.large_binary()).cast(pa.binary())], names=["value"])


def write_warc(records: DataFrame, path: str) -> None:
    """Archives under ``path``, one for each partition: a warcinfo record, then the records, each a gzip member of its own.

    The files are WARC as ``.warc.gz`` files are; Spark names them ``.txt``,
    and by that name reads them member by member instead of unpacking them.
    """
    out = records.mapInArrow(_to_warc, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def _fields(header: dict[str, str], block: bytes) -> dict:
    """What a record says of its page; lengths and digests of responses are taken anew from the bytes."""
    head, payload = split_http(block)
    at = head.find(b"\r\nX-Page-Id: ")
    revisit = header["WARC-Type"] == "revisit"
    return {
        "page_id": int(head[at + 13 : head.index(b"\r\n", at + 2)]) if at >= 0 else None,
        "payload_bytes": int(header["X-Payload-Length"]) if revisit else len(payload),
        "payload_digest": base64.b32decode(header["WARC-Payload-Digest"][5:]).hex() if revisit else hashlib.sha1(payload).hexdigest(),
        "record_type": header["WARC-Type"],
        "refers_to": int(header["X-Refers-To-Page-Id"]) if revisit else None,
        "record_id": header["WARC-Record-ID"],
        "uri": header["WARC-Target-URI"],
        "date": header["WARC-Date"],
        "refers_to_record": header.get("WARC-Refers-To"),
    }


def _from_warc(batches):
    """Rows of whole archives or of single members, packed or not."""

    def rows():
        for b in batches:
            for content in b.column(0).to_pylist():
                if content:
                    stream = io.BytesIO(content)
                    for h, block in read_warc(gzip.GzipFile(fileobj=stream) if content[:2] == b"\x1f\x8b" else stream):
                        if h["WARC-Type"] != "warcinfo":
                            yield _fields(h, block)

    yield from _batched(rows(), _PAGE_SCHEMA, lambda r: 400)


def read_warcs(spark: SparkSession, path: str, *, members: bool = False) -> DataFrame:
    """One row per record but warcinfo of the archives under ``path``.

    With ``members``, archives that ``write_warc`` wrote are split at their
    records, whatever their length; others are read a file at a time, of 2 GB
    at most.
    """
    if members:
        lines = spark.read.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
        return lines.select(F.col("value").cast("binary").alias("content")).mapInArrow(_from_warc, PAGES)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_from_warc, PAGES)


def archive_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None) -> DataFrame:
    """Pages through ARC and the converter into WARC archives, and what those hold, read back.

    One row per page row.  Null html is an empty payload; null urls are
    written as ``-``; of equal payloads of at least 1000 bytes the rows with
    the largest id are responses and the others revisit them (its record, by
    its identifier, date and address); rows with null ids are always
    responses; repeated rows with the largest id are all responses.  Every
    record has an identifier of its own.  A very long page is a record of its
    own length.  Other columns are not read.  An empty table has no records.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    # converted once: what is referred to is what is written
    records = materialize(rows.mapInArrow(_arc_convert_pages, RECORDS), "records")
    write_warc(mark_revisits(records), path)
    return read_warcs(spark, path, members=True)
