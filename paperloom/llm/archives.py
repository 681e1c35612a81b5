"""Legacy ARC archives turned into WARC archives, and WARC archives read back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import scratch, settle

#: Fixed values of the two ARC versions: the fields of a record's header line, in order.
ARC_FIELDS = {
    "1": ("url", "ip", "date", "type", "length"),
    "2": ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
#: Fixed values of the WARC standard.
WARC_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Records that one ARC segment holds.
SEGMENT_RECORDS = 256
#: Records that one WARC file holds at most, so that a file fits a task.
FILE_RECORDS = 10000
PAGE_HEADER = "X-Page-Id"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_header(version: str, name: str, date: str) -> bytes:
    """Version block of an ARC file."""
    body = f"{version} 0 paperloom\n{' '.join(ARC_FIELDS[version])}\n".encode()
    line = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "type": "text/plain", "length": str(len(body))}
    return " ".join(line.get(f, "200" if f == "status" else "-") for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: str, url: str, date: str, mime: str, block: bytes) -> bytes:
    line = {"url": re.sub(r"[\r\n]+", " ", url), "ip": "0.0.0.0", "date": date, "type": mime, "status": "200", "length": str(len(block))}
    return " ".join(line.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + block + b"\n"


def read_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file of either version, its version block first.

    The version block names the version; its field list says how a header line is split.
    Blocks are cut by declared length, never by content. A line that does not parse or
    a block cut short raises ValueError.
    """
    version, at = None, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # separator
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace")
        if version is None:
            version = data[end + 1 : end + 2].decode()
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version!r}")
        names = ARC_FIELDS[version]
        values = line.rsplit(" ", len(names) - 1)  # a url may hold blanks, the other fields don't
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"bad ARC header line {line[:200]!r}")
        record = dict(zip(names, values))
        size = int(record["length"])
        block = data[end + 1 : end + 1 + size]
        if len(block) != size:
            raise ValueError("ARC record cut short")
        yield record | {"block": block}
        at = end + 1 + size


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head with its blank line, and payload, of an HTTP message."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    return (head + mark, payload) if mark and head.startswith(b"HTTP/") else (b"", block)


def warc_date(arc_date: str) -> str:
    """14 digits (shorter ones are filled up) to the WARC form."""
    digits = (arc_date + "00000101000000"[len(arc_date) :])[:14]
    return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(url: str, date: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {key}')}>"


def warc_type(url: str, block: bytes) -> str:
    """WARC type of an ARC record: what was fetched by HTTP or DNS is a response."""
    scheme = url.partition(":")[0].lower()
    return "response" if block.startswith(b"HTTP/") or scheme == "dns" else "warcinfo" if scheme == "filedesc" else "resource"


def warc_record(kind: str, url: str, date: str, ident: str, block: bytes, payload_digest: str, refers: tuple[str, str] | None = None, mime: str = "application/octet-stream") -> bytes:
    """One WARC record without the two line ends that close it."""
    http = block.startswith(b"HTTP/")
    uri = re.sub(r"[\x00-\x20]+", "%20", url)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {ident}",
        f"WARC-Date: {date}",
        f"WARC-Filename: {uri.partition('//')[2]}" if kind == "warcinfo" else f"WARC-Target-URI: {uri}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
    ]
    if kind != "warcinfo":
        lines.append(f"WARC-Payload-Digest: sha1:{payload_digest}")
    if refers:
        lines += [f"WARC-Refers-To: {refers[0]}", f"WARC-Refers-To-Date: {refers[1]}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"Content-Type: {'application/http;msgtype=response' if http else mime}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def read_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(named fields, block) of every record; plain or gzip, cut by declared length."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:80]!r}")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("WARC record cut short")
        yield fields, block
        at = end + 8 + size


def pages_to_arc(pages: DataFrame, date: str = "20080101000000", records: int = SEGMENT_RECORDS) -> DataFrame:
    """(arc): legacy ARC segments that hold every row of ``pages(page_id, url, html)`` as an HTTP response.

    Segments alternate between the two header versions. The payload is the html in UTF-8
    (NULL: empty), the page_id a header of the response.
    """

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for frame in frames:
            for at in range(0, frame.num_rows, records):
                part, turn = frame.slice(at, records), turn + 1
                version = "12"[turn % 2]
                out = [arc_header(version, f"segment-{turn}.arc", date)]
                for page, url, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                    if page is not None:
                        head += f"{PAGE_HEADER}: {page}\r\n"
                    out.append(arc_record(version, url or "http://unknown.invalid/", date, "text/html", head.encode() + b"\r\n" + payload))
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["arc"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(batches, "arc binary")


def _page_of(head: bytes) -> int | None:
    found = re.search(rb"\r\n" + PAGE_HEADER.encode() + rb": (-?\d+)\r\n", head)
    return int(found[1]) if found else None


def _header_number(head: bytes, name: bytes) -> int:
    found = re.search(rb"\r\n" + name + rb": (\d+)\r\n", head)
    return int(found[1]) if found else 0


def arc_digests(arcs: DataFrame) -> DataFrame:
    """(page_id, payload_digest, payload_bytes, url, date) of the HTTP records of ``arcs(arc)``."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for arc in frame.column("arc"):
                pages, digests, sizes, urls, dates = [], [], [], [], []
                for record in read_arc(arc.as_py()):
                    if warc_type(record["url"], record["block"]) == "response":
                        head, payload = http_parts(record["block"])
                        pages.append(_page_of(head))
                        digests.append(sha1_base32(payload))
                        sizes.append(len(payload))
                        urls.append(record["url"])
                        dates.append(record["date"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pages, pa.int64()), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(urls, pa.string()), pa.array(dates, pa.string())],
                    ["page_id", "payload_digest", "payload_bytes", "url", "date"],
                )

    return arcs.mapInArrow(batches, "page_id long, payload_digest string, payload_bytes long, url string, date string")


def revisits(digests: DataFrame, at_least: int = 0) -> DataFrame:
    """(page_id, payload_digest, refers_to, refers_url, refers_date): the records that repeat the payload of the one with the largest page_id."""
    groups = settle(
        digests.where((F.col("payload_bytes") >= at_least) & F.col("page_id").isNotNull())
        .groupBy("payload_digest")
        .agg(F.max(F.struct("page_id", "url", "date")).alias("to"), F.count("*").alias("n"))
        .where("n > 1")
        .select("payload_digest", F.col("to.page_id").alias("refers_to"), F.col("to.url").alias("refers_url"), F.col("to.date").alias("refers_date")),
        "payloads",
    )
    found = digests.where(F.col("payload_bytes") >= at_least).join(groups, "payload_digest").where("page_id <> refers_to")
    return settle(found.select("page_id", "payload_digest", "refers_to", "refers_url", "refers_date").distinct(), "revisits")


def _page_record_id(url: str, date: str, page: int | None, digest: str) -> str:
    return record_id(url, date, f"{page} {digest}")


def arc_to_warc(arcs: DataFrame, references: DataFrame) -> DataFrame:
    """(record): a WARC record for every record of ``arcs(arc)``, its bytes as a string.

    Identifiers of HTTP records are derived from url, date, page and payload, those of others from
    the segment and the place in it; ARC dates become WARC dates; the type follows the block and scheme and
    ``references(page_id, payload_digest, refers_to, refers_url, refers_date)``: a page with a reference is
    a revisit, carries its head only and names the record it repeats. The other records stay whole.
    """

    def split(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for arc in frame.column("arc"):
                data = arc.as_py()
                segment = sha1_base32(data)
                rows = [r | {"key": f"{segment} {n}", "kind": warc_type(r["url"], r["block"])} for n, r in enumerate(read_arc(data))]
                parts = [http_parts(r["block"]) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([_page_of(head) for head, _ in parts], pa.int64()),
                        pa.array([sha1_base32(payload) for _, payload in parts], pa.string()),
                        *(pa.array([r[k] for r in rows], pa.string()) for k in ("url", "date", "type", "key", "kind")),
                        pa.array([r["block"] for r in rows], pa.binary()),
                    ],
                    ["page_id", "payload_digest", "url", "date", "type", "key", "kind", "block"],
                )

    def convert(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            out = []
            for row in frame.to_pylist():
                kind, url, block, digest, refers = row["kind"], row["url"], row["block"], row["payload_digest"], None
                date = warc_date(row["date"])
                head, _ = http_parts(block)
                ident = _page_record_id(url, date, row["page_id"], digest) if head else record_id(url, date, row["key"])
                if row["refers_to"] is not None:
                    kind, block, to = "revisit", head, warc_date(row["refers_date"])
                    refers = (_page_record_id(row["refers_url"], to, row["refers_to"], digest), to)
                out.append(warc_record(kind, url, date, ident, block, digest, refers, row["type"]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows = arcs.mapInArrow(split, "page_id long, payload_digest string, url string, date string, type string, key string, kind string, block binary")
    made = rows.join(references, ["page_id", "payload_digest"], "left").mapInArrow(convert, "record binary")
    return made.select(F.col("record").cast("string"))  # the bytes as they are, UTF-8 or not


def write_warc(records: DataFrame, path: str) -> None:
    """Gzip WARC files: Spark's text writer closes every record with the two line ends."""
    records.write.option("lineSep", WARC_END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the responses and revisits in the WARC files of a folder.

    A response is measured anew: its payload must have the digest that its header states.
    ``refers_to`` is the page of the response whose identifier a revisit names, NULL if the folder has none.
    """

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_id"]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
        for frame in frames:
            for content in frame.column("content"):
                rows = []
                for fields, block in read_warc(content.as_py()):
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    head, payload = http_parts(block)
                    digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), len(payload)
                    if fields["warc-type"] == "revisit":
                        size = _header_number(head, b"Content-Length")
                    elif sha1_base32(payload) != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
                    rows.append((_page_of(head), size, digest, fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to")))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    found = settle(files.mapInArrow(batches, "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_id string"), "warc_rows")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    named = found.where("record_type = 'response'").groupBy("record_id").agg(F.max("page_id").alias("refers_to")).withColumnRenamed("record_id", "refers_id")
    again = found.where("record_type = 'revisit'").join(named, "refers_id", "left").select(*columns, "refers_to")
    return found.where("record_type = 'response'").select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(again)


def convert_pages(pages: DataFrame) -> DataFrame:
    """Every page through an ARC segment, a WARC file and back: one row per row of ``pages``.

    Of pages with equal payloads the one with the largest page_id is the response, the others
    revisit it. NULL html is an empty payload, NULL url a fixed placeholder, and a row with NULL
    page_id is always a response. Rows that repeat a page_id share its type. An empty table
    gives an empty table; other columns are ignored.
    """
    spark = pages.sparkSession
    arcs = pages_to_arc(pages)
    references = revisits(settle(arc_digests(arcs), "arc_digests"))
    path = scratch(spark, "warc")
    write_warc(arc_to_warc(arcs, references), path)
    return read_archives(spark, path)
