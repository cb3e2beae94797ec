"""Legacy web archives to WARC: parse ARC files, synthesise WARC records, read them back."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut
from .skew import join_unique

END = "\r\n\r\n"
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Records of one archive file at most; a file is read by one task.
ARCHIVE_RECORDS = 10_000
FIELDS = {"1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"], "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"]}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    version: str
    fields: dict[str, str]
    content: bytes


class ArcError(ValueError):
    """The bytes are no ARC file, or a record is cut short."""


def write_arc(records, version: str = "1", name: str = "filedesc://pages.arc", date: str = "20000101000000") -> bytes:
    """An ARC file of (fields, content); version 1 has five header fields, version 2 ten."""
    names = FIELDS[version]
    block = f"{version} 0 engine\n{' '.join(names)}\n\n".encode()
    own = dict.fromkeys(names, "-") | {"URL": name, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Offset": "0", "Archive-length": str(len(block))}
    out = io.BytesIO()
    out.write(" ".join(own[x] for x in names).encode() + b"\n" + block)
    for fields, content in records:
        row = dict.fromkeys(names, "-") | {k: re.sub(r"\s", "%20", v) or "-" for k, v in fields.items()} | {"Archive-length": str(len(content))}
        if "Offset" in row:
            row["Offset"] = str(out.tell())
        out.write(b"\n" + " ".join(row[x] for x in names).encode() + b"\n" + content)
    return out.getvalue()


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file after its version block, by declared lengths.

    The first line of the version block tells the version, the second names the
    header fields; a header line may only differ from it by spaces in its URL.
    """
    at, names, version = 0, None, ""
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ArcError(f"header line without end at byte {at}")
        line = data[at:stop].decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        at = stop + 1
        try:
            size = int(line[-1])
        except ValueError as e:
            raise ArcError(f"no length in the header line before byte {at}") from e
        if size < 0 or at + size > len(data):
            raise ArcError(f"record of {size} bytes at byte {at} is cut short")
        content, at = data[at : at + size], at + size
        if names is None:
            head = content.decode("utf-8", "replace").splitlines()
            if not line[0].startswith("filedesc:") or len(head) < 2:
                raise ArcError("no version block")
            version, names = head[0].split(" ")[0], head[1].split(" ")
            if version not in FIELDS:
                raise ArcError(f"version {version}")
            continue
        if len(line) < len(names):
            raise ArcError(f"{len(line)} header fields before byte {at}")
        extra = len(line) - len(names)
        yield ArcRecord(version, dict(zip(names, [" ".join(line[: extra + 1]), *line[extra + 1 :]], strict=True)), content)
    if names is None:
        raise ArcError("empty file")


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Head (with the blank line) and payload; content without an HTTP head is all payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    found = re.search(rb"\r?\n\r?\n", content)
    return (content, b"") if found is None else (content[: found.end()], content[found.end() :])


def record_id(url: str, date: str, digest: str, page: str = "") -> str:
    """The same record of the same archive gets the same identifier in every run; page tells captures of one URL, date and payload apart."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {page}'.rstrip(' '))}>"


def timestamp(date: str) -> str:
    """ARC dates are yyyymmddhhmmss, of which older ones lack the end."""
    date = re.sub(r"\D", "", date)[:14]
    date += "00000101000000"[len(date) :] if len(date) >= 4 else "00010101000000"[len(date) :]
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def convert(arc: ArcRecord, refers: tuple[str, str, str] | None = None, extra: dict[str, str] | None = None, page: str = "") -> bytes:
    """The WARC record of an ARC record, without the two line ends that close it.

    HTTP captures become response records, or revisit records with the head
    only if `refers` names the record (identifier, URL, date) that has the
    same payload; anything else becomes a resource record. `page` goes into
    the record's identifier.
    """
    head, payload = split_http(arc.content)
    digest = hashlib.sha1(payload).digest()
    url, date = arc.fields["URL"], timestamp(arc.fields["Archive-date"])
    block = head if refers else arc.content
    fields = {
        "WARC-Type": "revisit" if refers else "response" if head else "resource",
        "WARC-Record-ID": record_id(url, date, digest.hex(), page),
        "WARC-Date": date,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(digest).decode(),
        "WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
        "Content-Type": "application/http; msgtype=response" if head else arc.fields["Content-type"],
    }
    if arc.fields["IP-address"] not in ("-", "0.0.0.0"):
        fields["WARC-IP-Address"] = arc.fields["IP-address"]
    if refers:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": refers[0], "WARC-Refers-To-Target-URI": refers[1], "WARC-Refers-To-Date": refers[2], "WARC-Truncated": "length"}
    fields |= (extra or {}) | {"Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode("utf-8", "surrogateescape") + b"\r\n" + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        stop = data.find(END.encode(), at)
        if not data.startswith(b"WARC/", at) or stop < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:stop].decode("utf-8", "surrogateescape").split("\r\n")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at, size = stop + 4, int(fields["content-length"])
        if at + size > len(data):
            raise ValueError(f"record of {size} bytes at byte {at} is cut short")
        yield fields, data[at : at + size]
        at += size
        while data.startswith(END.encode(), at):
            at += 4


def _arc_of(page_id, url: str, html: bytes) -> tuple[dict[str, str], bytes]:
    """A capture of a page: the page's number stands in the head, the date is the same for all."""
    return {"URL": url, "IP-address": "0.0.0.0", "Archive-date": "20000101000000", "Content-type": "text/html"}, b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page: " + str(page_id).encode() + b"\r\n\r\n" + html


def write_archives(pages: DataFrame, folder: str) -> None:
    """Write pages (page_id, url, html) as WARC files (gzip) to a folder that Spark's writers reach.

    Each batch of pages is laid out as an ARC file, version 1 or 2 by turns,
    parsed again and converted. Of pages with equal payloads of at least
    REVISIT_BYTES bytes the one with the largest page_id is stored; the others
    become revisits. Null html is an empty payload, a null url `-`. Each row
    makes one record, told by its own payload where page_ids repeat; equal
    payloads under the largest page_id are all stored. Identifiers of records
    differ unless page_id, url and payload are equal. A null page_id is never
    stored for others, nor a revisit. Empty and very long html are payloads
    like others; an empty table gives a folder without archives; other columns
    of pages, whatever their names, are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("-")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= REVISIT_BYTES, F.unhex(F.sha1(F.encode("html", "utf-8")))))
    keys = rows.where("digest is not null").select("page_id", "url", "digest")
    kept = cut(keys.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("kept"), F.count("*").alias("n")).where("n > 1"))
    total = kept.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # (page_id, digest) is unique among revisits, and spreads the pages of a payload that many have.
    revisits = join_unique(keys, kept, ["digest"], "n", total).where("page_id < kept.page_id").select("page_id", "digest", F.col("kept.page_id").alias("kept_id"), F.col("kept.url").alias("kept_url")).distinct()
    rows = rows.join(revisits, ["page_id", "digest"], "left").drop("digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches):
            out = []
            ids, urls, html, kept_ids, kept_urls = (batch.column(x) for x in ("page_id", "url", "html", "kept_id", "kept_url"))
            for lo in range(0, batch.num_rows, 256):
                part = range(lo, min(lo + 256, batch.num_rows))
                file = write_arc((_arc_of(ids[i].as_py(), urls[i].as_py(), html[i].as_buffer().to_pybytes()) for i in part), "12"[(k + lo // 256) % 2])
                for i, arc in zip(part, read_arc(file), strict=True):
                    page, size = ids[i].as_py(), html[i].as_buffer().size
                    extra = {"WARC-Page-ID": str(page), "WARC-Payload-Length": str(size)}
                    refers = None
                    if kept_ids[i].is_valid:
                        fields = _arc_of(kept_ids[i].as_py(), kept_urls[i].as_py(), b"")[0]
                        digest = hashlib.sha1(split_http(arc.content)[1]).hexdigest()
                        date = timestamp(fields["Archive-date"])
                        url = re.sub(r"\s", "%20", fields["URL"]) or "-"
                        refers = (record_id(url, date, digest, str(kept_ids[i].as_py())), url, date)
                        extra["WARC-Refers-To-Page-ID"] = str(kept_ids[i].as_py())
                    out.append(convert(arc, refers, extra, str(page)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string(), safe=False)], ["value"])

    # A line end of two CRLF makes the text writer's file the plain sequence of records.
    rows.mapInArrow(run, "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(folder)


def read_archives(spark, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url, digest_ok of each record.

    Files are read whole, by one task each; write_archives keeps them small.
    Digests of stored payloads are computed afresh and held against the header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for blob in batch.column("content"):
                rows = []
                for fields, block in read_warc(zlib.decompress(blob.as_buffer(), 31)):
                    _, payload = split_http(block)
                    told = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    kind = fields["warc-type"]
                    own = told if kind == "revisit" else hashlib.sha1(payload).hexdigest()
                    page, refers = fields["warc-page-id"], fields.get("warc-refers-to-page-id")
                    rows.append((None if page == "None" else int(page), int(fields["warc-payload-length"]) if kind == "revisit" else len(payload), own, kind, None if refers is None else int(refers), fields["warc-record-id"], fields["warc-target-uri"], own == told))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()))], names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "digest_ok"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, digest_ok boolean")
