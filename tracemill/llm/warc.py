"""Legacy archive converter: ARC records to WARC records, and readers for both.

Pages become ARC archives (version 1 or 2), the converter parses their version-specific header lines and
declared lengths, and synthesises WARC identifiers, timestamps, types and digests. Archives travel as rows
(name, content), a few MB each, written and read by Spark, so that any store Spark knows will do; ``content``
is a complete ``.arc`` or ``.warc.gz`` file, a gzip member per WARC record.

Defined results: null html is an empty payload; a null url becomes ``urn:page:<page_id>``; blanks and control
characters in a url are percent-encoded, as they would break a header line; of equal payloads the record with
the smallest page_id is the response (rows that repeat that page_id with that payload are responses too), null
page_ids come last; one page_id with several payloads is judged by payload; a payload of any length travels whole, alone
in its archive; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut
from .text import text_slices

# Field lines of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
REFERS_TO_PAGE = "X-Refers-To-Page-Id"
RECORD = "page_id long, url string, date string, ip string, payload_bytes long, payload_digest string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_archive(rows: Iterator[tuple], version: int, name: str, date: str, ip: str = "0.0.0.0") -> bytes:
    """An ARC file of (page_id, url, html) rows."""
    about = f"{version} 0 tracemill\n{ARC_FIELDS[version]}\n".encode()
    middle = " 200 - - 0 " + name if version == 2 else ""
    out = [f"filedesc://{name} {ip} {date} text/plain{middle} {len(about)}\n".encode(), about, b"\n"]
    for page_id, url, html in rows:
        payload = (html or "").encode()
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}")
        extra = f" 200 {hashlib.md5(payload).hexdigest()} - {sum(map(len, out[-1:]))} {name}" if version == 2 else ""
        out += [f"{url} {ip} {date} text/html{extra} {len(head) + len(payload)}\n".encode(), head, payload, b"\n"]
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file: url, ip, date, type, status, block. The version line decides how header lines are cut."""
    at, version = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line has no end")
        line = data[at:end].decode("utf-8", "surrogateescape")
        if not line.strip():
            at = end + 1
            continue
        length = int(line.rpartition(" ")[2])
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError("an ARC record is shorter than it declares")
        at = end + 1 + length
        if version is None:
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            continue
        fields = line.rsplit(" ", len(ARC_FIELDS[version].split()) - 1)
        yield {"url": fields[0], "ip": fields[1], "date": fields[2], "type": fields[3], "status": fields[4] if version == 2 else "200", "block": block}


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Header bytes with the blank line, headers by lower-case name, and payload of an HTTP response."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    headers = dict(x.split(":", 1) for x in head.decode("utf-8", "surrogateescape").split("\r\n")[1:] if ":" in x)
    return head + mark, {k.strip().lower(): v.strip() for k, v in headers.items()}, payload


def warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def record_id(url: str, date: str, page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{url} {date} {page_id} {digest}')}>"


def warc_record(arc: dict, refers_to: tuple[int, str] | None = None) -> bytes:
    """The gzip member of the WARC record equivalent to an ARC record; a revisit if the page it refers to is given (page_id, url in the archive).

    That page has the same payload and date, so the identifier of its record is known here.
    """
    head, headers, payload = http_parts(arc["block"])
    page_id, digest = headers.get("x-page-id") or None, payload_digest(payload)
    block = arc["block"] if refers_to is None else head
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(arc["url"], arc["date"], page_id, digest)),
        ("WARC-Date", warc_date(arc["date"])),
        ("WARC-Target-URI", arc["url"]),
        ("WARC-IP-Address", arc["ip"]),
        ("WARC-Payload-Digest", "sha1:" + digest),
        ("WARC-Block-Digest", "sha1:" + payload_digest(block)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        page, url = refers_to
        fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", record_id(url, arc["date"], str(page), digest)), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", warc_date(arc["date"])), (REFERS_TO_PAGE, str(page))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(text.encode("utf-8", "surrogateescape") + block + b"\r\n\r\n") + packer.flush()


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields by lower-case name and block of each record of a ``.warc.gz`` file; block digests are checked."""
    while data:
        member = zlib.decompressobj(31)
        text = member.decompress(data) + member.flush()
        data = member.unused_data
        head, _, rest = text.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogateescape").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        block = rest[: int(fields["content-length"])]
        if "sha1:" + payload_digest(block) != fields["warc-block-digest"]:
            raise ValueError(f"record {fields['warc-record-id']} does not have its digest")
        yield fields, block


def _arc_of(part: pa.RecordBatch, date: str) -> bytes:
    """The rows of a slice as one ARC file, of a version that follows from the first page's id."""
    rows = list(zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html"))))
    return arc_archive(iter(rows), 1 + (rows[0][0] or 0) % 2, "pages.arc", date)


def payload_index(pages: DataFrame, date: str) -> DataFrame:
    """page_id, url, payload_bytes and payload_sha1 of every page, by way of its ARC record."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "html"):
                found = []
                for record in parse_arc(_arc_of(part, date)):
                    _, headers, payload = http_parts(record["block"])
                    found.append((int(headers["x-page-id"]) if headers["x-page-id"] else None, record["url"], len(payload), hashlib.sha1(payload).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.string(), pa.int64(), pa.string()))], ["page_id", "url", "payload_bytes", "payload_sha1"])

    return pages.select("page_id", "html", "url").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_sha1 string")


def revisits(index: DataFrame, smallest: int = 0, salts: int = 16) -> DataFrame:
    """page_id, payload_sha1, refers_to and refers_url of the pages whose payload of at least ``smallest`` bytes a page with a smaller id has.

    Counts are combined before the shuffle, and a payload that many pages share is looked up by salted keys, salts by row number.
    """
    firsts = index.filter(F.col("payload_bytes") >= smallest).groupBy("payload_sha1").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n"))
    firsts = firsts.filter("n > 1 and first is not null").select("payload_sha1", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = index.select("page_id", "payload_sha1", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("salt"))
    found = rows.join(firsts, ["payload_sha1", "salt"]).filter(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    return found.select("page_id", "payload_sha1", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")).distinct()


def write_archives(pages: DataFrame, date: str = "20240101000000", smallest: int = 0) -> DataFrame:
    """WARC archives of pages (page_id, url, html), converted from ARC: rows of name, records, content, written to the shared folder.

    A page finds what it refers to by its id and payload together, so a page_id may have several payloads.
    """
    again = revisits(cut(payload_index(pages, date), "payloads"), smallest).withColumnsRenamed({"page_id": "again_id", "payload_sha1": "again_sha1"})
    rows = pages.select("page_id", "url", "html")
    rows = rows.join(again, rows["page_id"].eqNullSafe(again["again_id"]) & (F.sha1(F.coalesce("html", F.lit("")).cast("binary")) == again["again_sha1"]), "left")

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "html"):
                refers = zip(part.column("refers_to").to_pylist(), part.column("refers_url").to_pylist())
                out = [warc_record(record, None if page is None else (page, url)) for record, (page, url) in zip(parse_arc(_arc_of(part, date)), refers)]
                content = b"".join(out)
                name = f"pages-{hashlib.sha1(content).hexdigest()[:16]}.warc.gz"
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(out)], pa.int64()), pa.array([content], pa.binary())], ["name", "records", "content"])

    return cut(rows.select("page_id", "url", "html", "refers_to", "refers_url").mapInArrow(run, "name string, records long, content binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record: page_id, url, warc_date, record_id, payload_bytes, payload_digest, record_type, refers_to, refers_to_record."""

    def run(batches):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        names = ["page_id", "url", "warc_date", "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_to_record"]
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in parse_warc(content.as_py()):
                    _, headers, payload = http_parts(block)
                    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                    if kind == "response" and payload_digest(payload) != digest:
                        raise ValueError(f"record {fields['warc-record-id']} does not have its payload digest")
                    page = fields.get(REFERS_TO_PAGE.lower())
                    size = len(payload) if kind == "response" else int(headers["content-length"])
                    rows.append((int(headers["x-page-id"]) if headers["x-page-id"] else None, fields["warc-target-uri"], fields["warc-date"], fields["warc-record-id"], size, digest, kind, int(page) if page else None, fields.get("warc-refers-to")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    return archives.select("content").mapInArrow(run, "page_id long, url string, warc_date string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_to_record string")


def convert_pages(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """Pages to ARC, ARC to WARC, and what is read back from the WARC archives."""
    return read_archives(write_archives(pages, smallest=smallest)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "warc_date", "refers_to_record")
