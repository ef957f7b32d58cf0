"""Web archives: legacy ARC files, their conversion to WARC records, and reading both back.

``write_arc`` lays pages down in ARC files of version 1 or 2. ``convert`` reads such files by their version's header lines and
declared lengths, and makes WARC records of them: identifiers from each record's archive and place, ISO dates from the
14-digit ones, types from the content (HTTP answers are responses, other content is a resource, the file's own first block is a
warcinfo) and SHA-1 digests in base32. Of HTTP answers with equal payloads of at least ``least_bytes``, the one with the
smallest page id stays a response; the others become revisits that keep their HTTP header and name that response.

Files are written by Spark's text writer, which adds but the line end behind a row, so its committer deals with lost and
repeated tasks; a row is a whole file of about ``SEGMENT`` bytes or one longer record, gzipped. They are read one file at a
time. What is a revisit is found on an index of (record, page, digest) without payloads: a minimum per digest, joined back.
Payloads move once, by record id, so a payload with many copies makes no task longer.

The page id travels in the HTTP header ``X-Page-Id``; without one it is null and sorts last, and pages of equal id are told
apart by record. Null html is an empty payload. White space and control characters in a url are percent-encoded, a null url
is ``-`` in ARC files and left out of WARC records. Payloads are bytes and need not be text. A header line that can't be read
ends its file with an error row (``read_arc(...).where("error IS NOT NULL")``), since without its length nothing after it can
be found; a date that can't be read gives the archive's own, else 1970-01-01. Other columns are ignored. No rows give archives
without records.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch_path
from .common import saved

SEGMENT = 32 << 20

#: Fields of a header line by version, the length last.
_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename",
        "Archive-length"],
}
_NO_ADDRESS = "0.0.0.0"
_EPOCH = "1970-01-01T00:00:00Z"
_ODD = re.compile(r"[\x00-\x20\x7f]")
_STATUS = re.compile(rb"HTTP/[0-9.]+ +([0-9]{3})")
_PAGE_ID = re.compile(rb"^X-Page-Id: *(-?[0-9]+) *\r?$", re.M | re.I)
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_TEXT, _LONG, _BYTES = T.StringType(), T.LongType(), T.BinaryType()
_LINE = _schema(value=_TEXT)
ARC = _schema(
    archive=_TEXT, at=_LONG, version=_LONG, record_id=_TEXT, url=_TEXT, ip=_TEXT, date=_TEXT, content_type=_TEXT,
    type=_TEXT, page_id=_LONG, payload_bytes=_LONG, digest=_TEXT, error=_TEXT, block=_BYTES,
)
WARC = _schema(
    record_id=_TEXT, type=_TEXT, url=_TEXT, date=_TEXT, page_id=_LONG, payload_bytes=_LONG, payload_digest=_TEXT,
    refers_to_id=_TEXT, error=_TEXT, payload=_BYTES,
)
_ARROW = {_TEXT: pa.string(), _LONG: pa.int64(), _BYTES: pa.binary()}


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    columns = [pa.array(c, _ARROW[f.dataType]) for c, f in zip(zip(*rows), schema.fields)]
    return pa.record_batch(columns, schema.names)


def _files(texts: list[bytes]) -> pa.RecordBatch:
    """Whole files as rows for the text writer; bytes that are no UTF-8 pass as they are."""
    return pa.record_batch([pa.array(texts, pa.binary()).view(pa.string())], _LINE.names)


def _write(files: DataFrame, path: str, line_end: str) -> str:
    out = files.write.option("maxRecordsPerFile", 1).option("compression", "gzip").option("lineSep", line_end)
    out.option("zlib.compress.level", "BEST_SPEED").text(path)
    return path


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _unzipped(data: bytes) -> bytes:
    """A file's bytes: any number of gzip members one behind the other, or plain."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts = []
    while data:
        member = zlib.decompressobj(31)
        parts += [member.decompress(data), member.flush()]
        data = member.unused_data.lstrip(b"\0")
    return b"".join(parts)


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _parted(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload; no header where the block does not begin with a status line."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [k + len(e) for e in (b"\r\n\r\n", b"\n\n") if (k := block.find(e)) >= 0]
    at = min(ends, default=len(block))
    return block[:at], block[at:]


# ARC


def arc_header(version: int, url: str | None, ip: str, date: str, kind: str, status: str, at: int, name: str, size: int) -> bytes:
    """The header line of one record."""
    url = _ODD.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "-"
    fields = [url, ip, date, kind]
    if version == 2:
        fields += [status, "-", "-", str(at), name]
    return " ".join([*fields, str(size)]).encode() + b"\n"


def write_arc(pages: DataFrame, path: str | None = None, captured: str = "20240101000000", versions: tuple = (1, 2)) -> str:
    """ARC files of ``pages`` (page_id, url, html), all captured at one time; files take turns in ``versions``."""
    path = path or scratch_path(pages.sparkSession, "arc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, []
        size = 0
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html"))):
                if not held:
                    version = versions[(part + number) % len(versions)]
                    name = f"pages-{part:06d}-{number:06d}.arc"
                    about = f"{version} 0 fleetroll\n{' '.join(_FIELDS[version])}\n\n".encode()
                    line = arc_header(version, f"filedesc://{name}", _NO_ADDRESS, captured, "text/plain", "200", 0, name, len(about))
                    held, size = [line, about], len(line) + len(about)
                data = (html.as_py() or "").encode()
                known = b"" if page_id.as_py() is None else b"X-Page-Id: %d\r\n" % page_id.as_py()
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n" % (known, len(data))
                line = arc_header(
                    version, url.as_py(), _NO_ADDRESS, captured, "text/html", "200", size + 1, name, len(head) + len(data)
                )
                held += [b"\n", line, head, data]
                size += 1 + len(line) + len(head) + len(data)
                if size >= SEGMENT:
                    yield _files([b"".join(held)])
                    held, number = [], number + 1
        if held:
            yield _files([b"".join(held)])

    kinds = {"page_id": "bigint", "url": "string", "html": "string"}
    given = pages.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    return _write(given.mapInArrow(write, _LINE), path, "\n")


def iso_date(digits: str) -> str | None:
    """``YYYYMMDDhhmmss`` in ISO form; missing trailing parts are the least possible. None where it is no date."""
    if not re.fullmatch(r"[0-9]{4,14}", digits) or len(digits) % 2:
        return None
    try:
        found = datetime.datetime.strptime(digits + "00000101000000"[len(digits) :], "%Y%m%d%H%M%S")
    except ValueError:
        return None
    return found.strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")


def parse_arc(archive: str, data: bytes) -> Iterator[tuple]:
    """Rows of ``ARC`` for one file's bytes."""
    at, version, own_date = 0, None, None
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("latin-1").rstrip("\r")
        fields = line.split(" ")
        begin = end + 1 if end >= 0 else len(data)
        size = int(fields[-1]) if re.fullmatch(r"[0-9]{1,18}", fields[-1]) else -1
        first = version is None
        error = None
        if first:
            found = re.match(rb"([12]) ", data[begin : begin + 2])
            if not line.startswith("filedesc://"):
                error = "no version block"
            elif not found:
                error = "unknown version"
            else:
                version = int(found[1])
        if not error:
            known = [len(_FIELDS[version]), *([len(_FIELDS[1])] if first else [])]  # some files begin with a short line
            if len(fields) not in known:
                error = f"{len(fields)} fields in a header of version {version}"
            elif size < 0:
                error = "no length"
            elif begin + size > len(data):
                error = "declared length beyond the end"
        if error:
            yield (archive, at, version, None, None, None, None, None, None, None, None, None, f"{error}: {line[:200]}", None)
            return
        date = iso_date(fields[2])
        own_date = date if first else own_date
        block = data[begin : begin + size]
        head, payload = _parted(block)
        kind = "warcinfo" if first else "response" if head else "resource"
        page = _PAGE_ID.search(head)
        record_id = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{at}')}"
        # A version 2 line has the same first four fields.
        yield (
            archive, at, version, record_id, None if fields[0] == "-" else fields[0].encode("latin-1").decode("utf-8", "replace"),
            fields[1], date or own_date or _EPOCH, fields[3], kind, int(page[1]) if page else None, len(payload),
            sha1(payload), None, block,
        )
        at = begin + size


def read_arc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """A row of ``ARC`` per record of the files in ``path``, unreadable rests with an ``error``; blocks only if asked for."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _parsed(batches, parse_arc, ARC, blocks)

    return _read(spark, path).mapInArrow(parse, ARC)


def _parsed(batches, parse, schema: T.StructType, content: bool) -> Iterator[pa.RecordBatch]:
    """Rows of whole files in batches of bounded size; the last column is the content."""
    rows, held = [], 0
    for batch in batches:
        for name, data in zip(batch.column("path"), batch.column("content")):
            for row in parse(name.as_py(), _unzipped(data.as_py())):
                rows.append(row if content else (*row[:-1], None))
                held += len(rows[-1][-1] or b"")
                if len(rows) >= 2000 or held >= 8 << 20:
                    yield _batch(rows, schema)
                    rows, held = [], 0
    if rows:
        yield _batch(rows, schema)


# WARC


def warc_record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the blank lines behind it; fields that are None are left out."""
    given = [*fields, ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Length", len(block))]
    return "".join(["WARC/1.0\r\n", *[f"{k}: {v}\r\n" for k, v in given if v is not None], "\r\n"]).encode() + block


def revisits(index: DataFrame, least_bytes: int = 0) -> DataFrame:
    """record_id, refers_to_id, refers_to_url of the responses in ``index`` whose payload another one has.

    ``index`` (record_id, type, page_id, payload_bytes, digest, url) has no payloads. The minimum per digest is summed before the
    shuffle; of the digests, only those with copies are joined back.
    """
    told = index.where((F.col("type") == "response") & (F.col("payload_bytes") >= least_bytes))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record_id", "url")
    first = told.groupBy("digest", "payload_bytes").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
    first = first.where("copies > 1").select("digest", "payload_bytes", "first")
    again = told.join(first, ["digest", "payload_bytes"]).where("record_id <> first.record_id")
    return again.select("record_id", F.col("first.record_id").alias("refers_to_id"), F.col("first.url").alias("refers_to_url"))


def convert(spark: SparkSession, arc: str, path: str | None = None, least_bytes: int = 0) -> str:
    """WARC files of all readable records of the ARC files in ``arc``; returns their folder."""
    path = path or scratch_path(spark, "warc")
    index = read_arc(spark, arc, blocks=False).where("error IS NULL")
    index = saved(index.select("record_id", "type", "page_id", "payload_bytes", "digest", "url"), "index")
    again = saved(revisits(index, least_bytes), "revisits")
    records = read_arc(spark, arc).where("error IS NULL").join(again, "record_id", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                held.append(_converted({name: batch.column(name)[k].as_py() for name in batch.schema.names}))
                size += len(held[-1])
                if size >= SEGMENT:
                    yield _files([b"\r\n\r\n".join(held)])
                    held, size = [], 0
        if held:
            yield _files([b"\r\n\r\n".join(held)])

    return _write(records.mapInArrow(write, _LINE), path, "\r\n\r\n")


def _converted(r: dict) -> bytes:
    head, _ = _parted(r["block"])
    again = r["refers_to_id"] is not None
    kinds = {"response": "application/http; msgtype=response", "warcinfo": "application/warc-fields"}
    about = r["type"] == "warcinfo"
    block = head if again else r["block"]
    if about:
        block = b"".join(b"description: %s\r\n" % line for line in block.splitlines() if line)
    fields = [
        ("WARC-Type", "revisit" if again else r["type"]),
        ("WARC-Record-ID", f"<{r['record_id']}>"),
        ("WARC-Date", r["date"]),
        ("WARC-Filename" if about else "WARC-Target-URI", r["url"].removeprefix("filedesc://") if about else r["url"]),
        ("WARC-IP-Address", None if r["ip"] in (_NO_ADDRESS, "-") else r["ip"]),
        ("WARC-Payload-Digest", None if about else f"sha1:{r['digest']}"),
        ("X-Payload-Length", None if about else r["payload_bytes"]),
        ("WARC-Profile", _PROFILE if again else None),
        ("WARC-Refers-To", f"<{r['refers_to_id']}>" if again else None),
        ("WARC-Refers-To-Target-URI", r["refers_to_url"] if again else None),
        ("Content-Type", kinds.get(r["type"], r["content_type"])),
    ]
    return warc_record(fields, block)


def parse_warc(archive: str, data: bytes) -> Iterator[tuple]:
    """Rows of ``WARC`` for one file's bytes; payloads are held against their digests."""
    at = 0
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        head = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace")
        version, *lines = head.split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = fields.get("content-length", "")
        if end < 0 or not version.startswith("WARC/") or not size.isdecimal() or end + 4 + int(size) > len(data):
            yield (None, None, None, None, None, None, None, None, f"{archive}: no record at byte {at}", None)
            return
        begin = end + 4
        at = begin + int(size)
        kind = fields.get("warc-type")
        http, payload = _parted(data[begin:at])
        page = _PAGE_ID.search(http)
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        whole = kind in ("response", "resource")
        wrong = whole and digest and digest != sha1(payload)
        length = fields.get("x-payload-length", "")
        yield (
            fields.get("warc-record-id", "").strip("<>"), kind, fields.get("warc-target-uri"), fields.get("warc-date"),
            int(page[1]) if page else None, len(payload) if whole else int(length) if length.isdecimal() else None, digest,
            fields.get("warc-refers-to", "").strip("<>") or None, "payload differs from its digest" if wrong else None,
            payload if whole else None,
        )


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row of ``WARC`` per record of the files in ``path``; what can't be read or differs from its digest has an ``error``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _parsed(batches, parse_warc, WARC, payloads)

    return _read(spark, path).mapInArrow(parse, WARC)


def with_referred(records: DataFrame) -> DataFrame:
    """Records of ``read_warc`` with ``refers_to``, the page id of the response that a revisit names."""
    told = records.where("type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    again = records.where("refers_to_id IS NOT NULL").join(told, "refers_to_id", "left")
    plain = records.where("refers_to_id IS NULL").withColumn("refers_to", F.lit(None).cast("bigint"))
    return plain.unionByName(again)
