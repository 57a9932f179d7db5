"""Legacy archives: ARC records (versions 1 and 2) to WARC 1.0, and readers of both.

An ARC file names its version in its first record; a record's header line has the
URL, then 4 (version 1) or 9 (version 2) fields, the last of which declares the length
of what follows. Fields are taken from the right, so URLs may hold spaces. The
converter synthesises what WARC asks for: record ids (UUIDs of version 8 that carry a
page's number, or a digest of the record), ISO timestamps, record types and SHA-1 digests.

WARC files are written by Spark's text sink, whose line separator is the record's
end mark, and read by its text source: any file system that Spark knows will do,
Spark's commit protocol covers lost executors, and the reader streams, so that a task
holds one record at a time. Files are gzip-compressed, hence each is read by one task.

Records with equal payloads of at least MIN_PAYLOAD bytes: that with the largest page_id
is the response, the others revisit it (identical-payload-digest profile, HTTP head alone).

Defined cases: null html is an empty payload; a null URL becomes urn:none; rows that share
the largest page_id are all responses; rows without a page_id revisit the largest one
that exists, and are responses where there is none; an empty table gives no archive
and no row; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.common import new_folder, table, text_bytes, written

MIN_PAYLOAD, FILE_RECORDS = 1000, 20000
#: Crawl date, address and origin of archives made from the table pages, which has none.
DATE, ADDRESS, ORIGIN = "20240101000000", "0.0.0.0", "ledgerflow"
END = b"\r\n\r\n"
V1 = b"URL IP-address Archive-date Content-type Archive-length"
V2 = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_SPACE = int.from_bytes(hashlib.sha1(b"ledgerflow:page").digest()[:6])
_GAPS = re.compile(rb"[\x00-\x20\x7f]")


class ArcRecord(NamedTuple):
    version: int
    url: bytes
    address: bytes
    date: bytes
    kind: bytes
    status: bytes
    block: bytes


def arc_file(records: list[tuple[bytes, bytes, bytes, bytes]], version: int, name: str = "pages") -> bytes:
    """An ARC file of (url, date, content type, block) records."""
    fields = V2 if version == 2 else V1
    head = b"%d 0 %s\n%s\n\n" % (version, ORIGIN.encode(), fields)

    def line(url: bytes, date: bytes, kind: bytes, status: bytes, at: int, size: int) -> bytes:
        own = (url, ADDRESS.encode(), date, kind)
        return b" ".join((*own, status, b"-", b"-", b"%d" % at, name.encode(), b"%d" % size) if version == 2 else (*own, b"%d" % size)) + b"\n"

    out = [line(b"filedesc://%s.arc" % name.encode(), DATE.encode(), b"text/plain", b"200", 0, len(head)), head]
    at = sum(map(len, out))
    for url, date, kind, block in records:
        part = line(_GAPS.sub(lambda m: b"%%%02X" % m[0][0], url) or b"urn:none", date, kind, b"200", at, len(block)) + block + b"\n"
        out.append(part)
        at += len(part)
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file but its first. A header or length that doesn't fit the data is an error."""
    at, version, n_fields = 0, 0, 4
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header at byte {at} doesn't end")
        line = data[at:end].rstrip(b"\r")
        if not version:
            n_fields = 9 if line.count(b" ") >= 9 else 4
        parts = line.rsplit(b" ", n_fields)
        if len(parts) != n_fields + 1 or not parts[-1].isdigit():
            raise ValueError(f"ARC header at byte {at} isn't of version {version or 'one or two'}")
        size, start = int(parts[-1]), end + 1
        if start + size > len(data):
            raise ValueError(f"ARC record at byte {at} declares {size} bytes, {len(data) - start} are left")
        block = data[start : start + size]
        if not version:
            if not parts[0].startswith(b"filedesc://"):
                raise ValueError("an ARC file begins with a filedesc record")
            version = int(block.split(b" ", 1)[0])
            if version not in (1, 2):
                raise ValueError(f"ARC version {version}")
            n_fields = 9 if version == 2 else 4
        else:
            yield ArcRecord(version, parts[0], parts[1], parts[2], parts[3], parts[4] if version == 2 else b"", block)
        at = start + size


def page_urn(page_id: int) -> str:
    n = page_id % 2**64
    return f"<urn:uuid:{uuid.UUID(int=_SPACE << 80 | 8 << 76 | (n >> 62) << 64 | 2 << 62 | n & (2**62 - 1))}>"


def page_of(urn: str | None) -> int | None:
    """The page_id in a record id of page_urn(), else None."""
    if not urn:
        return None
    n = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    if n >> 80 != _SPACE or n >> 76 & 15 != 8:
        return None
    n = (n >> 64 & 3) << 62 | n & (2**62 - 1)
    return n - 2**64 if n >> 63 else n


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _iso(date: bytes) -> str:
    d = date.decode().ljust(14, "0")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_parts(block: bytes) -> tuple[bytes, bytes] | None:
    """The head, its empty line included, and the body of an HTTP response; else None."""
    if not block.startswith(b"HTTP/"):
        return None
    at = block.find(END)
    return (block[: at + 4], block[at + 4 :]) if at >= 0 else (block, b"")


def to_warc(r: ArcRecord, refers_to: str | None = None) -> bytes:
    """The WARC record, without the two line ends that follow it. refers_to: the id of the record that it revisits."""
    http = http_parts(r.block)
    payload = http[1] if http else r.block
    page = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", http[0]) if http else None
    own = page_urn(int(page[1])) if page else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha1(b' '.join(r[1:])).hexdigest())}>"
    block = http[0] if refers_to and http else r.block
    kind = "revisit" if refers_to else "response" if http else "resource"
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {_iso(r.date)}", f"WARC-Target-URI: {r.url.decode('utf-8', 'replace')}", f"WARC-IP-Address: {r.address.decode()}"]
    if refers_to:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"]
    lines += [f"WARC-Payload-Digest: {_digest(payload)}", f"WARC-Block-Digest: {_digest(block)}", f"Content-Type: {'application/http; msgtype=response' if http else r.kind.decode()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def read_warc(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of each record, from what lies between the end marks of WARC files."""
    buf, fields, start = bytearray(), None, 0
    for piece in pieces:
        buf += piece
        buf += END
        while True:
            if fields is None:
                skip = 0
                while skip < len(buf) and buf[skip] in b"\r\n":
                    skip += 1
                del buf[:skip]
                at = buf.find(END)
                if at < 0:
                    break
                head = bytes(buf[:at]).decode("utf-8", "replace").split("\r\n")
                if not head[0].startswith("WARC/"):
                    raise ValueError(f"no WARC record begins with {head[0][:40]!r}")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
                start = at + 4
            size = int(fields["content-length"])
            if len(buf) < start + size + 4:
                break
            yield fields, bytes(buf[start : start + size])
            del buf[: start + size]
            fields = None
    if fields is not None:
        raise ValueError("the last WARC record is shorter than it declares")


def _convert(batches):
    """(page_id, url, html, refers_to): each batch makes an ARC file, of either version by turns, which is converted."""
    for n, b in enumerate(batches):
        ids, urls, pages, refers = (c.to_pylist() for c in b.columns)
        records = []
        for i, u, p in zip(ids, urls, pages):
            mark = b"" if i is None else b"X-Page-Id: %d\r\n" % i
            records.append((u, DATE.encode(), b"text/html", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n%s" % (mark, len(p), p)))
        arc = arc_file(records, 1 + n % 2)
        yield pa.RecordBatch.from_arrays([pa.array([to_warc(r, page_urn(to) if to is not None else None) for r, to in zip(read_arc(arc), refers)], pa.large_binary())], names=["value"])


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url and html (bytes) with refers_to, the page_id of the response with the same payload, for revisits."""
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("binary"), F.lit(b"")).alias("url"), text_bytes("html").alias("html"))
    rows = rows.withColumn("_sha", F.sha1("html"))
    copies = rows.filter(F.length("html") >= MIN_PAYLOAD).groupBy("_sha").agg(F.max("page_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    # written first: then both sides of the join are exchanged, and Spark can split the pages of a payload that many share
    copies = written(copies.filter("_n > 1 and _keep is not null").select(F.col("_sha").alias("_of"), "_keep"), "warc-copies")
    rows = rows.join(copies, F.col("_sha") == F.col("_of"), "left")
    return rows.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("_keep")), F.col("_keep")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str) -> None:
    rows = marked(pages).mapInArrow(_convert, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _describe(batches):
    pieces = (p or b"" for b in batches for p in b.column(0).to_pylist())
    rows: list[tuple] = []

    def out():
        cols = list(zip(*rows)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri"])

    for fields, block in read_warc(pieces):
        head, body = http_parts(block) or (b"", block)
        said = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        if fields["warc-block-digest"] != _digest(block):
            raise ValueError(f"{fields['warc-record-id']}: the block isn't what its digest says")
        if fields["warc-type"] == "revisit":
            size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        else:
            size = len(body)
            if hashlib.sha1(body).hexdigest() != said:
                raise ValueError(f"{fields['warc-record-id']}: the payload isn't what its digest says")
        page = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
        rows.append((int(page[1]) if page else None, size, said, fields["warc-type"], page_of(fields.get("warc-refers-to")), fields["warc-record-id"], fields.get("warc-target-uri")))
        if len(rows) == 5000:
            yield out()
            rows.clear()
    if rows:
        yield out()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: page_id, payload_bytes, payload_digest (hex), record_type, refers_to, record_id, target_uri."""
    pieces = spark.read.option("lineSep", END.decode()).schema("value string").text(path)
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string"
    return pieces.select(F.col("value").cast("binary")).mapInArrow(_describe, kind)


def op1_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page to WARC archives, by way of ARC, and reads them back."""
    path = new_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).drop("record_id", "target_uri")


ORACLE = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b)::bigint as n, sha1(b) as sha from p),
k as (select sha, max(page_id) as keep from d where n >= 1000 group by sha)
select page_id, n as payload_bytes, d.sha as payload_digest,
       case when keep is null or page_id = keep then 'response' else 'revisit' end as record_type,
       case when page_id is distinct from keep then keep end as refers_to
from d left join k using (sha)
"""
