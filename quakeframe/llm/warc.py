"""Legacy archives to WARC (operator 2).

ARC archives, of version 1 or 2, are parsed by their header lines and declared lengths, never by searching for
delimiters, and each record is turned into a WARC record: a deterministic identifier, an ISO timestamp from the 14-digit
one, the record type and media type, and SHA-1 digests in base 32. Records with equal payloads are written once;
the others become revisit records. Archives are written by Spark, so any store that it can write will do: files of about
FILE_BYTES, a warcinfo record first, and each record a gzip member of its own, so that readers can seek to it. They are
read back member by member, and in each by its content length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm.common import cut

#: Bytes after which the writer of ARC blobs begins another; one record may be larger.
BLOB_BYTES = 4 << 20
#: Compressed bytes after which the writer begins another WARC file, and plain ones after which a reader hands on rows;
#: one record may be larger. With BLOB_BYTES these bound what a task holds at once.
FILE_BYTES, BATCH_BYTES = 8 << 20, 8 << 20
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace of URLs


# --- ARC ---------------------------------------------------------------------------------------------------------


def arc_version_block(name: str, version: int, date: str) -> bytes:
    fields = b"URL IP-address Archive-date Content-type Archive-length" if version == 1 else b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    body = b"%d 0 quakeframe\n" % version + fields + b"\n\n"
    head = f"filedesc://{name} 0.0.0.0 {date} text/plain".encode()
    extra = b"" if version == 1 else b" 200 - - 0 " + name.encode()
    return head + extra + b" %d\n" % len(body) + body


def arc_record(version: int, url: str, ip: str, date: str, kind: str, content: bytes, offset: int, name: str) -> bytes:
    """A record whose URL can't break its header line: white space and controls are percent-encoded."""
    safe = "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url) or "-"
    middle = "" if version == 1 else f" 200 - - {offset} {name}"
    return f"{safe} {ip} {date} {kind}{middle} {len(content)}\n".encode() + content + b"\n"


#: What follows the URL, which may hold spaces, in a header line.
_HEADERS = {
    1: re.compile(r"(?P<url>.*) (?P<ip>\S+) (?P<date>[0-9]{4,14}) (?P<kind>.*) (?P<size>[0-9]+)", re.DOTALL),
    2: re.compile(r"(?P<url>.*) (?P<ip>\S+) (?P<date>[0-9]{4,14}) (?P<kind>.*) (?P<result_code>\S+) (?P<checksum>\S+) (?P<location>\S+) (?P<place>\S+) (?P<file>\S+) (?P<size>[0-9]+)", re.DOTALL),
}


def _arc_records(blob: bytes, version: int | None) -> Iterator[dict]:
    """Records of plain ARC bytes, a dict with `error` for those that can't be read; the version block gives its number only."""
    at = 0
    while at < len(blob):
        if blob[at] in b"\r\n":
            at += 1
            continue
        end = blob.find(b"\n", at)
        line = blob[at : end if end >= 0 else len(blob)].decode("utf-8", "replace").rstrip("\r")
        size = re.search(r" ([0-9]+)$", line) if end >= 0 else None
        if size is None:
            yield {"error": f"no header line with a length: {line[:100]}", "offset": at, "version": version}
            return
        content = blob[end + 1 : end + 1 + int(size[1])]
        found = _HEADERS[version].fullmatch(line) if version else None
        if line.startswith("filedesc:"):
            number = content.split(b" ", 1)[0]
            version = int(number) if number in (b"1", b"2") else None
            if version is None:
                yield {"error": f"no version of ARC: {number[:20]!r}", "offset": at, "version": None}
        elif len(content) < int(size[1]):
            yield {"error": "the record is shorter than it declares", "offset": at, "version": version}
        elif found is None:
            yield {"error": f"no header of ARC version {version}: {line[:100]}", "offset": at, "version": version}
        else:
            x = found.groupdict()
            yield {"version": version, "offset": at, "content": content, "error": None} | {k: x.get(k) for k in ("url", "ip", "date", "kind", "result_code", "checksum", "location")}
        at = end + 1 + int(size[1])


def parse_arc(blob: bytes) -> Iterator[dict]:
    """Records of an ARC archive, plain or of gzip members, after its version block, which tells what header lines hold.

    Lines are read from the right, as URLs may hold spaces. What can't be read is a record with `error`: those after it are
    found by its length where it declares one, or in the next member.
    """
    if blob[:2] != b"\x1f\x8b":
        yield from _arc_records(blob, None)
        return
    version, before = None, 0
    try:
        for part in members(blob):
            first = re.match(rb"filedesc:[^\n]*\n([12]) ", part)
            version = int(first[1]) if first else version
            for x in _arc_records(part, version):
                yield x | {"offset": x["offset"] + before}  # in the unpacked archive
            before += len(part)
    except (ValueError, zlib.error) as error:
        yield {"error": f"{type(error).__name__}: {error}", "offset": before, "version": version}


# --- WARC --------------------------------------------------------------------------------------------------------


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def iso_date(date: str) -> str:
    """ISO form of an archive's 14-digit (or, in old archives, shorter) date."""
    d = (date + "00000101000000"[len(date) :]) if len(date) < 14 else date
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def head_length(content: bytes) -> int:
    """Bytes of HTTP headers and the empty line after them, whether lines end in CR LF or in LF alone; 0 for anything else."""
    ends = [at + len(gap) for gap in (b"\r\n\r\n", b"\n\n") if (at := content.find(gap)) >= 0]
    return min(ends) if ends and content.startswith(b"HTTP/") else 0


def convert(record: dict, archive: str = "") -> dict:
    """The WARC equivalent of an ARC record: HTTP responses keep their headers, anything else is a resource.

    Its identifier is made from where it stands, so that repeated records have their own.
    """
    content, http = record["content"], record["content"].startswith(b"HTTP/")
    split = head_length(content)
    payload = content[split:]
    named = f"{archive} {record['offset']} {record['url']} {record['date']} {digest(content)}"
    return {
        "record_id": f"urn:uuid:{uuid.uuid5(_SPACE, named)}", "date": iso_date(record["date"]), "uri": record["url"], "ip": record["ip"],
        "record_type": "response" if http else "resource", "media_type": "application/http; msgtype=response" if http else record["kind"],
        "head": content[:split], "payload": payload, "payload_digest": digest(payload), "block_digest": digest(content),
        "result_code": record["result_code"], "checksum": record["checksum"], "location": record["location"], "error": None,
    }


def record_text(x: dict, refers_to: str | None) -> bytes:
    """A WARC record without its final blank lines; a revisit has the headers only and names the record it repeats."""
    block = x["head"] if refers_to is not None else x["head"] + x["payload"]
    fields = [
        ("WARC-Type", "revisit" if refers_to is not None else x["record_type"]), ("WARC-Record-ID", f"<{x['record_id']}>"), ("WARC-Date", x["date"]), ("WARC-Target-URI", x["uri"]), ("WARC-IP-Address", x["ip"]),
        ("WARC-Payload-Digest", f"sha1:{x['payload_digest']}"), ("WARC-Block-Digest", f"sha1:{digest(block) if refers_to is not None else x['block_digest']}"), ("Content-Type", x["media_type"]),
        ("X-Payload-Length", str(len(x["payload"]))),
        *((f"X-Arc-{name}", x[k]) for k, name in (("result_code", "Result-Code"), ("checksum", "Checksum"), ("location", "Location")) if x[k] not in (None, "-")),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>")]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def info_text(first: str, date: str) -> bytes:
    """The warcinfo record of a file, named by its first record."""
    block = b"software: quakeframe\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, f'info {first}')}>"), ("WARC-Date", date), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block


def member(record: bytes) -> bytes:
    """A record with its final blank lines as a gzip member without a time."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record + b"\r\n\r\n") + packer.flush()


def members(blob: bytes) -> Iterator[bytes]:
    """What the gzip members of a file hold, one after the other; zero bytes between and after them are padding."""
    view, at = memoryview(blob), 0
    while at < len(blob):
        if blob[at] == 0:
            at += 1
            continue
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if at >= len(blob):
                raise ValueError("a gzip member is cut off")
            some = view[at : at + 65536]
            parts.append(unpacker.decompress(some))
            at += len(some) - len(unpacker.unused_data)
        yield b"".join(parts)


def parse_warc(blob: bytes) -> Iterator[tuple[dict, bytes]]:
    """Fields and blocks of the records of plain WARC bytes."""
    at = 0
    while at < len(blob):
        if blob[at] in b"\r\n":
            at += 1
            continue
        end = blob.index(b"\r\n\r\n", at)
        lines = blob[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        if end + 4 + size > len(blob):
            raise ValueError(f"{fields.get('WARC-Record-ID')}: the block is shorter than it declares")
        yield fields, blob[end + 4 : end + 4 + size]
        at = end + 4 + size


# --- Spark jobs --------------------------------------------------------------------------------------------------


_ARC = pa.schema([("name", pa.string()), ("blob", pa.binary())])


def _packer(date: str, ip: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, name, parts, size = 1, None, [], 0
        task, made = TaskContext.get().partitionId(), 0  # equal rows in two archives don't give these one name
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html"))):
                page_id, url, html = page_id.as_py(), url.as_py(), html.as_py()
                if not parts:
                    name = f"{uuid.uuid5(_SPACE, f'{task} {made} {page_id} {url}').hex}.arc"
                    made += 1
                    parts = [arc_version_block(name, version, date)]
                    size = len(parts[0])
                payload = (html or "").encode("utf-8", "surrogatepass")
                content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n".encode() + payload
                parts.append(arc_record(version, url or "", ip, date, "text/html", content, size, name))
                size += len(parts[-1])
                if size >= BLOB_BYTES:
                    yield pa.RecordBatch.from_pydict({"name": [name], "blob": [b"".join(parts)]}, _ARC)
                    version, parts = 3 - version, []
        if parts:
            yield pa.RecordBatch.from_pydict({"name": [name], "blob": [b"".join(parts)]}, _ARC)

    return pack


def pages_to_arc(pages: DataFrame, date: str = "20240101000000", ip: str = "0.0.0.0") -> DataFrame:
    """ARC archives of pages, as rows (name, blob) of BLOB_BYTES or one record; versions 1 and 2 take turns.

    The page's id travels in its HTTP headers; a null URL is written as `-`, null html as an empty payload.
    """
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_packer(date, ip), "name string, blob binary")


_CONVERTED = "page_id long, record_id string, date string, uri string, ip string, record_type string, media_type string, head binary, payload binary, payload_digest string, block_digest string, result_code string, checksum string, location string, payload_bytes long, error string"
_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_RECORDS = pa.schema([(x.split(" ")[0], _TYPES[x.split(" ")[1]]) for x in _CONVERTED.split(", ")])


def _convert_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, blob in zip(batch.column("name"), batch.column("blob")):
            rows, size = [], 0
            for record in parse_arc(blob.as_py() or b""):
                if record["error"] is not None:
                    rows.append({"error": f"{name.as_py()}, byte {record['offset']}: {record['error']}"})
                    continue
                x = convert(record, name.as_py())
                page = re.search(rb"(?:^|\n)X-Page-Id: (-?[0-9]+)\r?\n", x["head"])
                rows.append(x | {"page_id": int(page[1]) if page else None, "payload_bytes": len(x["payload"])})
                size += len(x["payload"])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _RECORDS], schema=_RECORDS)
                    rows, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _RECORDS], schema=_RECORDS)


def arc_to_records(archives: DataFrame) -> DataFrame:
    """WARC records of ARC archives (name, blob), one row each; page_id is that of an X-Page-Id header, else null.

    What can't be read of an archive is a row with `error`, which says where, and nothing else; the other records stay.
    """
    return archives.select("name", "blob").mapInArrow(_convert_archives, _CONVERTED)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """`arc_to_records` of the `.arc` and `.arc.gz` files at a path."""
    return arc_to_records(spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), F.col("content").alias("blob")))


def pages_to_records(pages: DataFrame, date: str = "20240101000000", ip: str = "0.0.0.0") -> DataFrame:
    """`arc_to_records` of `pages_to_arc` in one pass: an archive is converted where it was packed, one at a time."""
    pack = _packer(date, ip)
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(lambda batches: _convert_archives(pack(batches)), _CONVERTED)


def write_warc(records: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes records as gzipped WARC archives; of equal payloads of least_bytes or more, that of the largest page_id stays whole.

    Which one that is comes from a maximum by digest, combined before the shuffle. Only digests with copies are joined, by
    whatever join Spark takes for their number; a digest with very many copies may be split. Rows with an error are left out.
    """
    records = records.filter("error IS NULL")
    big = records.filter(F.col("payload_bytes") >= least_bytes)
    first = big.groupBy(F.col("payload_digest").alias("of_digest")).agg(F.max(F.struct("page_id", "record_id")).alias("of"), F.count("*").alias("copies")).filter("copies > 1")
    first = cut(first.select("of_digest", F.col("of.page_id").alias("of_page"), F.col("of.record_id").alias("of_record")))
    same = (F.col("payload_digest") == F.col("of_digest")) & (F.col("payload_bytes") >= least_bytes)
    repeated = F.col("of_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("of_page"))
    marked = records.join(first, same, "left").withColumn("refers_to", F.when(repeated, F.col("of_record"))).drop("of_digest", "of_page", "of_record")

    def write(batches):
        parts, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                for x in batch.slice(lo, 100).to_pylist():
                    if not parts:
                        parts = [member(info_text(x["record_id"], x["date"]))]
                        size = len(parts[0])
                    parts.append(member(record_text(x, x["refers_to"])))
                    size += len(parts[-1])
                    if size >= FILE_BYTES:
                        yield pa.RecordBatch.from_pydict({"file": [b"".join(parts)]})
                        parts = []
        if parts:
            yield pa.RecordBatch.from_pydict({"file": [b"".join(parts)]})

    # One row is one file. The text writer ends it with a zero byte, which gzip readers pass over as padding.
    files = marked.mapInArrow(write, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC archives: page_id, record_id, record_type, refers_to_record, payload_bytes, payload_digest, payload.

    A revisit has no payload; its digest and length are the full payload's, from its headers. A whole record's digest is
    made anew from what was read, and has to agree with its header.
    """
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to_record", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def row(fields, block):
        split = head_length(block) if fields["Content-Type"].startswith("application/http") else 0
        page = re.search(rb"(?:^|\n)X-Page-Id: (-?[0-9]+)\r?\n", block[:split])
        whole, said = fields["WARC-Type"] != "revisit", fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if whole and digest(block[split:]) != said:
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload isn't what its digest says")
        return int(page[1]) if page else None, fields["WARC-Record-ID"][1:-1], fields["WARC-Type"], None if whole else fields["WARC-Refers-To"][1:-1], len(block) - split if whole else int(fields["X-Payload-Length"]), said, block[split:] if whole else None

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)

    def parse(batches):
        rows, size = [], 0
        for batch in batches:
            for file in batch.column("content"):
                raw = file.as_py()
                for part in members(raw) if raw[:2] == b"\x1f\x8b" else (raw,):
                    for fields, block in parse_warc(part):
                        if fields["WARC-Type"] != "warcinfo":
                            rows.append(row(fields, block))
                            size += len(block)
                        if size >= BATCH_BYTES:
                            yield made(rows)
                            rows, size = [], 0
        yield made(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, "page_id long, record_id string, record_type string, refers_to_record string, payload_bytes long, payload_digest string, payload binary")


def archive_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Takes pages through ARC archives and their conversion to WARC at `path`, and reports what the archives hold.

    One row per page: page_id, payload_bytes, payload_digest (bare base 32 SHA-1), record_type, refers_to (the page_id
    of the response that a revisit repeats, else null), record_id.
    Null html is an empty payload, equal to other empty ones; a null url is allowed. Of equal payloads, the rows that
    share the largest page_id are all responses (repeated rows), null page_ids counting as smallest. Very long pages are
    records, and files, of their own size. Columns other than page_id, url and html don't matter. An empty table gives an
    empty result.
    """
    write_warc(pages_to_records(pages), path, least_bytes)
    held = cut(read_warc(pages.sparkSession, path).drop("payload"))
    whole = held.filter("refers_to_record IS NULL").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to")).dropDuplicates(["refers_to_record"])
    return held.join(whole, "refers_to_record", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")
