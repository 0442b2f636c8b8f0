"""Legacy archive converter: ARC files to WARC files, and readers of both.

An ARC file starts with a version block that names the fields of its header
lines; each record is a header line, as many bytes as it declares, and a line
feed.  Version 1 lines have five fields, version 2 lines ten.  The converter
gives each record a WARC identifier, timestamp, type and digests.  Of records
with equal payloads the one with the smallest key is a response, and the others
become revisits that name it and hold no payload.

Archives are real files: gzip members, one for each record, that end with an
empty member.  Tasks make them whole and Spark's text sink writes the bytes, so
any store that Spark can write holds them.  A file is about ``archive_bytes`` of
records, so a task holds one file at a time.

Defined results: a null page has an empty payload; a null url is ``about:blank``
and white space in a url is percent-encoded; a record without a key is always a
response, and no other refers to it; rows with the same key and payload are all
responses and have one WARC identifier.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import discard, scratch, settle
from canopy.session import ship_code

#: Bytes of records after which an archive is closed.
ARCHIVE_BYTES = 8 << 20
LEVEL = 4
#: The page's id, and that of the page that a revisit refers to.
KEY_HEADER, TARGET_HEADER = "X-Page-Id", "X-Refers-To-Page-Id"
#: Revisits up to this number are broadcast to the archives, about 16 bytes each; more are joined to the archives by path.
MOST_REVISITS = 1_000_000
FIRST_CAPTURE = datetime(2005, 1, 1, tzinfo=timezone.utc)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Field names of the header lines, fixed by the ARC format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


#: An empty member, as at the end of every archive; its last byte is zero.
END = gzip_member(b"")


def gunzip_members(data: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """The content of each gzip member.  What follows the last one and is no member is left.

    The input goes in small steps, since what a member leaves over is copied.
    """
    view, at = memoryview(data), 0
    while bytes(view[at : at + 2]) == b"\x1f\x8b":
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            piece = view[at : at + step]
            if not piece:
                raise ValueError("an archive ends within a member")
            out.append(z.decompress(piece))
            at += len(piece)
        at -= len(z.unused_data)
        yield b"".join(out)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- ARC


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 canopy\n{ARC_FIELDS[version]}\n".encode()
    head = [f"filedesc://{name}", "0.0.0.0", f"{FIRST_CAPTURE:%Y%m%d%H%M%S}", "text/plain"]
    if version == 2:
        head += ["200", "-", "-", "0", name]
    return " ".join([*head, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, name: str, offset: int, url: str, ip: str, when: datetime, content: bytes) -> bytes:
    head = [url, ip, f"{when:%Y%m%d%H%M%S}", "text/html"]
    if version == 2:
        head += ["200", hashlib.md5(content).hexdigest(), "-", str(offset), name]
    return " ".join([*head, str(len(content))]).encode("utf-8", "surrogatepass") + b"\n" + content + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records after the version block: the fields of the header line by name, and ``content`` of the declared length."""
    fields: list[str] | None = None
    for member in gunzip_members(data):
        at = 0
        while at < len(member):
            end = member.index(b"\n", at)
            line = member[at:end]
            if not line.strip():  # blank lines may stand between records
                at = end + 1
                continue
            if fields is None:
                length = int(line.rsplit(b" ", 1)[1])
                block = member[end + 1 : end + 1 + length].split(b"\n")
                version = int(block[0].split(b" ")[0])
                if version not in ARC_FIELDS:
                    raise ValueError(f"ARC version {version} is not known")
                fields = block[1].decode().split(" ")
            else:
                record = dict(zip(fields, line.decode("utf-8", "surrogatepass").rsplit(" ", len(fields) - 1), strict=True))
                length = int(record["Archive-length"])
                record["content"] = member[end + 1 : end + 1 + length]
                if len(record["content"]) != length:
                    raise ValueError("an ARC record is shorter than its header line declares")
                yield record
            at = end + 1 + length + 1


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """The HTTP head with its blank line, and the payload.  Content without a head is all payload."""
    cut = content.find(b"\r\n\r\n") if content.startswith(b"HTTP/") else -4
    return content[: cut + 4], content[cut + 4 :]


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        if k.decode("latin-1").lower() == name.lower():
            return v.strip().decode("latin-1")
    return None


def http_key(head: bytes) -> int | None:
    key = http_field(head, KEY_HEADER)
    return int(key) if key is not None else None


# --- WARC


def record_id(*parts: object) -> str:
    """A name-based UUID of the parts.  A captured page's parts are its key and its payload's digest, so that a revisit can name its response."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(map(str, parts)).encode('utf-8', 'backslashreplace').decode())}>"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, by declared length."""
    for member in gunzip_members(data):
        at = 0
        while at < len(member):
            if not member.startswith(b"WARC/", at):
                raise ValueError("a WARC record must start with its version")
            end = member.index(b"\r\n\r\n", at)
            lines = member[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]
            fields = dict(x.split(": ", 1) for x in lines)
            length = int(fields["Content-Length"])
            yield fields, member[end + 4 : end + 4 + length]
            at = end + 4 + length + 4


def convert(record: dict, refers_to: int | None = None) -> bytes:
    """The WARC record for a parsed ARC record: a revisit of the record with the key ``refers_to``, or else a response."""
    head, payload = split_http(record["content"])
    url, date = record["URL"], datetime.strptime(record["Archive-date"], "%Y%m%d%H%M%S")
    digest, key = sha1_base32(payload), http_key(head)
    block = record["content"] if refers_to is None else head
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(url, record["Archive-date"], digest) if key is None else record_id(key, digest)),
        ("WARC-Date", f"{date:%Y-%m-%dT%H:%M:%SZ}"),
        ("WARC-Target-URI", url),
        ("WARC-IP-Address", record["IP-address"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response" if head else record["Content-type"]),
    ]
    if key is not None:
        fields.append((KEY_HEADER, str(key)))
    if refers_to is not None:
        fields[1:1] = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), (TARGET_HEADER, str(refers_to))]
    return warc_record(fields, block)


# --- on tables


def _sink(archives: DataFrame, path: str) -> None:
    """Write each archive (a binary column ``content`` that ends with a zero byte) as a file of its own."""
    bare = archives.select(F.expr("substring(content, 1, length(content) - 1)").cast("string").alias("value"))
    bare.write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_arcs(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write pages as ARC files under ``path``, versions 1 and 2 in turn."""
    ship_code(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        members: list[bytes] = []
        size, held, version, name = 0, 0, 1, ""

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join([*members, END])], pa.binary())], names=["content"])

        for b in batches:
            for key, where, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if not members:
                    version, name = 1 + (part + count) % 2, f"part-{part:05d}-{count:05d}.arc.gz"
                    members.append(gzip_member(arc_version_block(version, name)))
                    held = len(members[0])
                payload = (page.as_py() or "").encode("utf-8", "surrogatepass")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                head += f"{KEY_HEADER}: {key}\r\n" if key is not None else ""
                place = "".join(f"%{ord(c):02X}" if c.isspace() else c for c in where or "about:blank")
                when = FIRST_CAPTURE + timedelta(seconds=(key or 0) % 315_360_000)
                record = arc_record(version, name, held, place, "0.0.0.0", when, head.encode() + b"\r\n" + payload)
                members.append(gzip_member(record))
                held += len(members[-1])
                size += len(record)  # with its head, so that many empty pages fill an archive, too
                if size >= archive_bytes:
                    yield close()
                    members, size, count = [], 0, count + 1
        if members:
            yield close()

    rows = pages.select(F.col(page_id).cast("long"), F.col(url).cast("string"), F.col(html).cast("string"))
    _sink(rows.mapInArrow(run, "content binary"), path)


def index_arcs(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, key, digest, bytes) of each ARC record; n counts within its file."""
    ship_code(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for n, record in enumerate(parse_arc(content.as_py())):
                    head, payload = split_http(record["content"])
                    rows.append((where, n, http_key(head), sha1_base32(payload), len(payload)))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "n", "key", "digest", "bytes"])

    return _files(spark, path).mapInArrow(run, "path string, n long, key long, digest string, bytes long")


def convert_arcs(spark: SparkSession, source: str, target: str, least_bytes: int = 0) -> None:
    """Convert the ARC files under ``source`` to WARC files under ``target``.

    Payloads of at least ``least_bytes`` are compared across all files.  The
    files are read twice: for the digests, and for the conversion, to which each
    file's revisits come by its path.
    """
    index = settle(index_arcs(spark, source))
    first = index.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    revisits = settle(index.join(first, ["digest", "bytes"]).where("key <> first").select("path", "n", "first"))
    by_file = revisits.groupBy("path").agg(F.collect_list(F.struct("n", "first")).alias("revisits"))
    by_file = F.broadcast(by_file) if revisits.count() <= MOST_REVISITS else by_file
    files = _files(spark, source).join(by_file, "path", "left").select("path", "content", "revisits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, content, found in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                targets = {x["n"]: x["first"] for x in found or []}
                name = where.rsplit("/", 1)[-1]
                info = warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name)), ("WARC-Date", f"{FIRST_CAPTURE:%Y-%m-%dT%H:%M:%SZ}"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: canopy\r\nformat: WARC File Format 1.0\r\n")
                members = [gzip_member(info)]
                members += [gzip_member(convert(r, targets.get(n))) for n, r in enumerate(parse_arc(content.as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array([b"".join([*members, END])], pa.binary())], names=["content"])

    _sink(files.mapInArrow(run, "content binary"), target)


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to) of each response and revisit; digests of responses are verified."""
    ship_code(spark)
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for fields, block in parse_warc(content.as_py()):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, payload = split_http(block)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if sha1_base32(block) != fields["WARC-Block-Digest"].removeprefix("sha1:") or kind == "response" and sha1_base32(payload) != digest:
                        raise ValueError(f"a digest of {fields['WARC-Record-ID']} is wrong")
                    size = int(http_field(head, "Content-Length") or len(payload))
                    to = int(fields[TARGET_HEADER]) if kind == "revisit" else None
                    rows.append((int(fields[KEY_HEADER]) if KEY_HEADER in fields else None, fields["WARC-Target-URI"], kind, size, digest, to))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return _files(spark, path).select("content").mapInArrow(run, schema)


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, place: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` as ARC files, convert these to WARC files and read them back.  Without a ``place`` the ARC files go once they are converted."""
    spark = pages.sparkSession
    kept, place = place is not None, place or scratch(spark, "archives")
    write_arcs(pages, f"{place}/arc", page_id, url, html, archive_bytes)
    convert_arcs(spark, f"{place}/arc", f"{place}/warc", least_bytes)
    if not kept:
        discard(spark, f"{place}/arc")
    return read_warcs(spark, f"{place}/warc")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, unhex(sha1(h))::BIT::VARCHAR AS bits FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT
        + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first OR page_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
