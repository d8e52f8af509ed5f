"""Operator 1: converter from ARC to WARC, with archives written and read through Spark's file systems.

An ARC file is a sequence of records: a header line of blank-separated fields (five in version 1, ten in version 2;
the last is the block's declared length), the block, and a newline. The first record (``filedesc:``) states the version.
Each record becomes a WARC record: the identifier is a name-based UUID of the source's key, the 14-digit date
becomes ISO 8601, the type follows from the scheme and the block (``warcinfo``, ``response`` for an HTTP block,
else ``resource``), and SHA-1 digests of block and payload are in upper-case base 32. A record whose payload
equals an earlier one's becomes a ``revisit``: its HTTP header stays and its payload is left out.

Records are gathered into archives of about ``ARCHIVE`` bytes; one row is one archive, and Spark's text writer, which
writes the bytes as they are, puts each into a file of its own, so any file system that Spark knows will do and
retried tasks leave no part files. Reading goes by declared lengths. Equal payloads are found from digests by an
aggregation with partial sums, so a payload that a third of all pages share makes one row a task; pages meet the
list of revisits by page_id and digest, which are not skewed.

Null html is an empty payload; a null url is written as ``urn:absent``, blanks in it as ``%20``. Where rows with equal
payloads also tie at the smallest page_id, all of those are responses. A row with a null page_id is kept, and is a
revisit only if its payload occurs with an id. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.llm.common import shared_dir, table

ARCHIVE = 16 << 20
BATCH = 2000
#: The fields of an ARC header line by version.
ARC_FIELDS = {1: ("url", "ip", "date", "mime", "length"), 2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length")}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-record")
SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, warc_record_id string, warc_date string"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    block: bytes
    version: int = 1
    status: str = "-"


def format_arc(record: ArcRecord) -> bytes:
    """One ARC record with the header line of its version."""
    middle = {1: [], 2: [record.status, "-", "-", "0", "-"]}[record.version]
    line = " ".join([record.url, record.ip, record.date, record.mime, *middle, str(len(record.block))])
    return line.encode("utf-8", "surrogatepass") + b"\n" + record.block + b"\n"


def parse_arc(data: bytes, version: int | None = None) -> Iterator[ArcRecord]:
    """Records of an ARC file or part of one. The version is the given one, that of a ``filedesc:`` record, or told by the number of fields."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        parts = data[at:end].rstrip(b"\r").decode("utf-8", "surrogatepass").split(" ")
        kind = version or next((v for v, names in ARC_FIELDS.items() if len(names) == len(parts)), 1)
        names = ARC_FIELDS[kind]
        if len(parts) > len(names):  # blanks inside the address
            extra = len(parts) - len(names)
            parts = [" ".join(parts[: extra + 1]), *parts[extra + 1 :]]
        fields = dict(zip(names, parts, strict=True))
        length = int(fields["length"])
        if end + 1 + length > len(data):
            raise ValueError(f"the record at {at} is cut off")
        block = data[end + 1 : end + 1 + length]
        if fields["url"].startswith("filedesc:"):
            first = block.split(b"\n", 1)[0].split(b" ")
            version = int(first[0]) if first[0] in (b"1", b"2") else version
        yield ArcRecord(fields["url"], fields["ip"], fields["date"], fields["mime"], block, kind, fields.get("status", "-"))
        at = end + 1 + length


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(key))}>"


def iso_date(date: str) -> str:
    """ARC's digits, from the year to the second as far as they go, as ISO 8601."""
    digits = date + "00000101000000"[len(date) : 14]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def to_warc(record: ArcRecord, key: object, refers_to: object = None, extra: dict[str, object] | None = None) -> bytes:
    """The WARC record, without the blank lines that end it."""
    block, payload = record.block, record.block
    http = block.startswith(b"HTTP/")
    if http:
        head, found, payload = block.partition(b"\r\n\r\n")
    kind = "warcinfo" if record.url.startswith("filedesc:") else "response" if http else "resource"
    fields: dict[str, object] = {"WARC-Type": kind, "WARC-Record-ID": record_id(key), "WARC-Date": iso_date(record.date), "WARC-Target-URI": record.url.replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A")}
    if record.ip not in ("", "-", "0.0.0.0"):
        fields["WARC-IP-Address"] = record.ip
    fields["WARC-Payload-Digest"] = f"sha1:{base32_sha1(payload)}"
    if refers_to is not None:
        fields |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Payload-Length": len(payload)}
        block = head + found if http else b""
    fields |= {"WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Type": "application/http; msgtype=response" if http else record.mime, **(extra or {}), "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode("utf-8", "surrogatepass") + b"\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, by declared lengths; block digests are verified."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            if data[at : at + 2] == b"\r\n":
                at += 2
                continue
            raise ValueError(f"no record at {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        at = end + 4
        block = data[at : at + int(fields["content-length"])]
        if len(block) != int(fields["content-length"]):
            raise ValueError("a record is cut off")
        if (told := fields.get("warc-block-digest")) and told != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"digest mismatch in {fields.get('warc-record-id')}")
        yield fields, block
        at += len(block)


def page_to_arc(url: str | None, html: str | None, date: str, version: int = 1) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return format_arc(ArcRecord((url or "urn:absent").replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D"), "0.0.0.0", date, "text/html", head + payload, version, "200"))


def revisits_of(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id and refers_to of pages whose payload, of at least ``least`` bytes, also has a smaller page_id."""
    digests = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("html"), F.lit("")).alias("h"))
    digests = digests.filter(F.octet_length("h") >= least).select("page_id", F.sha1(F.col("h").cast("binary")).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").select("digest", "refers_to")
    return digests.join(firsts, "digest").filter("page_id is null or page_id > refers_to").select("page_id", "refers_to", "digest").distinct()


def write_archives(pages: DataFrame, path: str, date: str = "19700101000000", least: int = 0) -> None:
    """Write the pages (page_id, url, html) as gzipped WARC archives below ``path``, by way of ARC records of either version."""
    found = revisits_of(pages, least)
    digest = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", digest.alias("digest"))
    same = rows["page_id"].eqNullSafe(found["page_id"]) & (rows["digest"] == found["digest"])
    joined = rows.join(found, same, "left").select(rows["page_id"], "url", "html", "refers_to")

    def run(batches):
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for page_id, url, html, refers in zip(*batch.columns):
                page_id, refers = page_id.as_py(), refers.as_py()
                arc = page_to_arc(url.as_py(), html.as_py(), date, 1 + (page_id or 0) % 2)
                record = next(parse_arc(arc, 1 + (page_id or 0) % 2))
                held.append(to_warc(record, page_id, refers, {"X-Source-Key": "" if page_id is None else page_id} | ({} if refers is None else {"X-Refers-Key": refers})))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(held)], pa.binary())], ["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(held)], pa.binary())], ["archive"])

    archives = joined.mapInArrow(run, "archive binary")
    archives.selectExpr("cast(archive as string) value").write.option("maxRecordsPerFile", 1).option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC archives below ``path``, as ``SCHEMA`` says."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for content in batch.column(0):
                data = content.as_py()
                for fields, block in parse_warc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
                    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                    if kind != "revisit" and digest != base32_sha1(payload):
                        raise ValueError(f"payload digest mismatch in {fields['warc-record-id']}")
                    number = lambda name: int(v) if (v := fields.get(name)) else None
                    n = number("x-payload-length") if kind == "revisit" else len(payload)
                    rows.append((number("x-source-key"), n, digest, kind, number("x-refers-key"), fields["warc-record-id"], fields["warc-date"]))
                    if len(rows) >= BATCH:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in SCHEMA.split(", ")])


def op1_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)
