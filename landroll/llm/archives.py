"""Legacy archive converter: ARC records, versions 1 and 2, to WARC, and WARC files written and read by Spark.

An ARC archive starts with a filedesc record whose version block names the version and the fields of the
header lines: `URL IP-address Archive-date Content-type Archive-length` in version 1, with `Result-code
Checksum Location Offset Filename` between type and length in version 2. Every record is a header line
of these fields, exactly the declared number of bytes, and a line end. A record becomes a WARC record with an
identifier derived from its address, time, content and place (archive and number in it), the time in WARC form, type and digest. A payload that
occurs again is stored once; the others revisit it.

Archives are rows of `content` bytes, as the binaryFile reader gives them, of bounded size unless one record
is larger. Defined results: a null payload is empty; null addresses are written as `-`; a null id is written as
none and read as null, and never the one revisited while an id is there; equal rows are records of their own;
no pages give no records; extra columns are not read; a damaged length or header stops the job with an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landroll.llm.common import new_folder, saved

ARCHIVE_BYTES = 8_000_000
LEAST_REVISIT_BYTES = 0
#: The field lines of the two versions.
ARC_FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
END = b"\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str | None) -> bytes:
    """A field of a header line: no white space, a dash for nothing."""
    return ("%20".join((value or "").split()) or "-").encode("utf-8", "replace")


def arc_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages as ARC archives, version 1 for even ids and 2 for odd ones: rows (content).

    The page's id travels in the fragment of the record's address, time and server are fixed by the id.
    """

    def record(page: int | None, url: str | None, payload: bytes, version: int) -> bytes:
        address = _clean(url) + b"#page=" + (b"" if page is None else str(page).encode())
        second = (page or 0) % 86400
        date = b"20240101%02d%02d%02d" % (second // 3600, second // 60 % 60, second % 60)
        fields = [address, b"0.0.0.0", date, b"text/html"]
        if version == 2:
            fields += [b"200", digest(payload).encode(), b"-", b"0", b"pages.arc"]
        return b" ".join([*fields, str(len(payload)).encode()]) + b"\n" + payload + b"\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {1: [_version_block(1)], 2: [_version_block(2)]}
        size = {1: 0, 2: 0}
        for batch in batches:
            for page, url, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                version = 1 + (page or 0) % 2
                held[version].append(record(page, url, payload or b"", version))
                size[version] += len(held[version][-1])
                if size[version] >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held[version])], pa.binary())], names=["content"])
                    held[version], size[version] = [_version_block(version)], 0
        for version in (1, 2):
            if size[version]:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held[version])], pa.binary())], names=["content"])

    plain = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).cast("binary").alias("payload"))
    return plain.mapInArrow(run, "content binary")


def _version_block(version: int) -> bytes:
    body = b"%d 0 landroll\n%s\n\n" % (version, ARC_FIELDS[version])
    middle = b" 200 - - 0 pages.arc" if version == 2 else b""
    return b"filedesc://pages.arc 0.0.0.0 20240101000000 text/plain" + middle + b" %d\n" % len(body) + body + b"\n"


def parse_arc(content: bytes) -> Iterator[dict[str, object]]:
    """Records of an ARC archive by its own version's field line and the declared lengths."""
    end = content.index(b"\n")
    first = content[:end].split(b" ")
    body = content[end + 1 : end + 1 + int(first[-1])]
    lines = body.split(b"\n")
    version, names = int(lines[0].split(b" ")[0]), lines[1].split(b" ")
    if not first[0].startswith(b"filedesc://") or ARC_FIELDS.get(version) != b" ".join(names):
        raise ValueError("no ARC version block that this reader knows")
    at = end + 1 + len(body) + 1
    while at < len(content):
        end = content.index(b"\n", at)
        fields = dict(zip(names, content[at:end].split(b" "), strict=True))
        length = int(fields[b"Archive-length"])
        payload = content[end + 1 : end + 1 + length]
        if len(payload) < length or content[end + 1 + length : end + 2 + length] != b"\n":
            raise ValueError("an ARC record is not as long as it declares")
        at = end + 2 + length
        yield {"url": fields[b"URL"].decode("utf-8", "replace"), "ip": fields[b"IP-address"].decode(), "date": fields[b"Archive-date"].decode(), "mime": fields[b"Content-type"].decode(), "payload": payload, "version": version}


def convert_arc(archives: DataFrame, name_col: str | None = None) -> DataFrame:
    """ARC archives to WARC fields: record_id, page_id, url, ip, date, mime, digest, bytes, payload.

    name_col names what tells archives apart, such as the path of their files; without it equal archives have equal identifiers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows = []
                content = content.as_py()
                name = digest(content) if name is None else name
                for place, r in enumerate(parse_arc(content)):
                    url, _, page = r["url"].rpartition("#page=")
                    d = r["date"]
                    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    sha = digest(r["payload"])
                    record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{r["url"]} {date} {sha} {name} {place}')}>"
                    rows.append({"record_id": record_id, "page_id": int(page) if page else None, "url": url, "ip": r["ip"], "date": date, "mime": r["mime"], "digest": sha, "bytes": len(r["payload"]), "payload": r["payload"]})
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    named = archives.select("content", (F.col(name_col).cast("string") if name_col else F.lit(None).cast("string")).alias("name"))
    return named.mapInArrow(run, "record_id string, page_id bigint, url string, ip string, date string, mime string, digest string, bytes bigint, payload binary")


_RECORD = pa.schema([(n, pa.string()) for n in ("record_id",)] + [("page_id", pa.int64())] + [(n, pa.string()) for n in ("url", "ip", "date", "mime", "digest")] + [("bytes", pa.int64()), ("payload", pa.binary())])


def revisits(records: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Rows (page_id, record_id, refers_to, refers_record) of the records that revisit the one with the largest id."""
    keys = records.where(F.col("bytes") >= least_bytes).select("digest", "bytes", "page_id", "record_id")
    keys = saved(keys, "digests")
    top = keys.groupBy("digest", "bytes").agg(F.max(F.struct("page_id", "record_id")).alias("top"), F.count("*").alias("n")).where("n > 1").select("digest", "bytes", "top")
    both = keys.join(saved(top, "payloads"), ["digest", "bytes"])
    other = ~F.col("page_id").eqNullSafe(F.col("top.page_id"))  # rows that repeat the page are responses as well
    return both.where(other).select("record_id", F.col("top.page_id").alias("refers_to"), F.col("top.record_id").alias("refers_record")).distinct()


def write_warc(records: DataFrame, revisit: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write gzip WARC files of bounded size, one per archive row, with a warcinfo record first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, first = [], 0, ""
        for batch in batches:
            for r in batch.to_pylist():
                first = first or r["record_id"]
                held.append(_warc_record(r))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([_warcinfo(first) + END + END.join(held)], pa.binary())], names=["value"])
                    held, size, first = [], 0, ""
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_warcinfo(first) + END + END.join(held)], pa.binary())], names=["value"])

    rows = records.join(revisit, "record_id", "left")
    archives = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    archives.write.option("maxRecordsPerFile", 1).option("lineSep", END.decode()).option("compression", "gzip").text(folder)


def _warcinfo(first: str) -> bytes:
    body = b"software: landroll\r\nformat: WARC File Format 1.1\r\n"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo {first}")
    return b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % (str(name).encode(), len(body)) + body


def _warc_record(r: dict) -> bytes:
    again = r["refers_record"] is not None
    payload = b"" if again else r["payload"]
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Date: {r['date']}",
        f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}", f"WARC-Payload-Digest: sha1:{r['digest']}", f"Content-Type: {r['mime']}",
        f"WARC-Payload-Length: {r['bytes']}", f"WARC-Page-ID: {'' if r['page_id'] is None else r['page_id']}",
    ]
    if again:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {r['refers_record']}"]
        lines += [f"WARC-Refers-To-Page-ID: {r['refers_to']}"] if r["refers_to"] is not None else []
    return "\r\n".join([*lines, f"Content-Length: {len(payload)}", "", ""]).encode("utf-8", "replace") + payload


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record, by declared lengths."""
    at = 0
    while at < len(content):
        end = content.index(END, at)
        version, *lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        length = int(headers["Content-Length"])
        start = end + len(END)
        if content[start + length : start + length + len(END)] != END:
            raise ValueError("a WARC record is not as long as it declares")
        yield headers, content[start : start + length]
        at = start + length + len(END)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (page_id, record_type, payload_bytes, payload_digest, refers_to, url, date) of all WARC files of a folder.

    The digest and length of a response are taken from its payload and must agree with its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, payload in parse_warc(_inflate(content.as_py())):
                    kind = h["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    sha = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (digest(payload) != sha or len(payload) != int(h["WARC-Payload-Length"])):
                        raise ValueError("a payload differs from its digest")
                    number = lambda name, h=h: int(h[name]) if h.get(name) else None
                    rows.append({"page_id": number("WARC-Page-ID"), "record_type": kind, "payload_bytes": int(h["WARC-Payload-Length"]), "payload_digest": sha, "refers_to": number("WARC-Refers-To-Page-ID"), "url": h["WARC-Target-URI"], "date": h["WARC-Date"]})
                yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(run, "page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, url string, date string")


_READ = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("date", pa.string())])


def _inflate(data: bytes) -> bytes:
    """All gzip members of a file."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Pages to ARC to WARC files in the folder (a new one in the shared folder when None), read back."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    archives = arc_archives(pages, id_col, url_col, payload_col).withColumn("archive", F.monotonically_increasing_id())
    records = convert_arc(saved(archives, "arc"), "archive")  # written once, so that identifiers stand
    write_warc(records, revisits(records, least_bytes), folder)
    return read_warc(spark, folder)
