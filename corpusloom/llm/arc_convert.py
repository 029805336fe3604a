"""Legacy ARC archives to WARC archives, and back to rows.

An ARC file opens with a ``filedesc`` record that names its version and field order. Version 1 header
lines hold URL, address, date, type and length; version 2 lines add result code, checksum, location,
offset and file name before the length. A record is its header line, as many bytes as declared, and a
line end. The converter reads lines from the right, as old URLs may hold spaces, checks declared
lengths, and writes for every record a WARC record with an identifier made from the archive's name
and the record's place, an ISO date, a type, and payload and block digests.

Records with equal payloads are told apart by one aggregate over digests: the one with the largest
page id is the response, the others become ``revisit`` records that refer to it.

One task holds one record and one file's decisions; files are closed at ``file_bytes``. Only digests
move between tasks. Names of files come from committed manifests, so a task that runs again leaves
an unused file at worst.

Defined results: a null page is an empty payload; a null URL becomes ``urn:page:<id>``; null and
repeated page ids are records of their own (among equal largest ids the last place in the archives
is the response); an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.files import new_name, open_folder, shared_folder
from corpusloom.session import materialize

# Field names of the two versions, and the profile of records that repeat a payload.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLANKS = re.compile(r"\s")


@dataclass(frozen=True)
class ArcRecord:
    url: str
    address: str
    date: str
    kind: str
    place: int
    head: bytes  # HTTP status line and headers with the blank line, empty if there are none
    payload: bytes


class Packer:
    """Records in, one gzip member each, in a file that knows its length."""

    def __init__(self, folder: str, suffix: str) -> None:
        fs, place = open_folder(folder)
        fs.create_dir(place, recursive=True)
        self.path = new_name(place, suffix)
        self.sink = fs.open_output_stream(self.path, compression=None)
        self.records, self.size = 0, 0

    def add(self, record: bytes) -> None:
        packed = gzip.compress(record, compresslevel=1, mtime=0)
        self.sink.write(packed)
        self.records += 1
        self.size += len(packed)

    def close(self) -> tuple[str, int]:
        self.sink.close()
        return self.path, self.records


def opened(folder: str, path: str) -> BinaryIO:
    fs, _ = open_folder(folder)
    return io.BufferedReader(gzip.GzipFile(fileobj=fs.open_input_file(path)), 1 << 20)


def arc_filedesc(name: str, version: int, date: str) -> bytes:
    about = f"{version} 0 corpusloom\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {len(about)}\n".encode() + about + b"\n"


def arc_record(url: str, page_id: int | None, html: str, version: int, date: str) -> bytes:
    payload = html.encode("utf-8")
    page = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    block = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}Content-Length: {len(payload)}\r\n\r\n".encode()
        + payload
    )
    middle = "" if version == 1 else " 200 - - 0 -"
    return f"{url} 0.0.0.0 {date} text/html{middle} {len(block)}\n".encode() + block + b"\n"


def write_arcs(pages: DataFrame, file_bytes: int = 64 << 20, date: str = "20000101000000") -> DataFrame:
    """Archives of ``pages`` (page_id, url, html), odd ids in version 2; the manifest (folder, path)."""
    folder = shared_folder(pages.sparkSession, "arc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_files: dict[int, Packer] = {}
        done = []
        for pdf in batches:
            for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                page_id = None if pd.isna(page_id) else int(page_id)
                version = 2 if page_id is not None and page_id % 2 else 1
                arc = open_files.get(version)
                if arc is None:
                    arc = open_files[version] = Packer(folder, ".arc.gz")
                    arc.add(arc_filedesc(arc.path.rpartition("/")[2], version, date))
                address = BLANKS.sub("%20", url) if url else f"urn:page:{page_id}"
                arc.add(arc_record(address, page_id, html or "", version, date))
                if arc.size >= file_bytes:
                    done.append(open_files.pop(version).close())
        done += [arc.close() for arc in open_files.values()]
        yield pd.DataFrame({"folder": folder, "path": [path for path, _ in done]}, dtype=object)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return materialize(rows.mapInPandas(run, "folder string, path string"))


def read_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """Records of an archive of either version, without its ``filedesc``."""
    version, place = 1, 0
    while line := stream.readline():
        if not line.strip():
            continue
        fields = ARC_FIELDS[version]
        values = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(fields) - 1)
        if line.startswith(b"filedesc:"):
            length = int(values[-1])
            about = stream.read(length)
            version = int(about.split(b" ", 1)[0])
            continue
        if len(values) != len(fields):
            raise ValueError(f"header line with {len(values)} of {len(fields)} fields")
        named = dict(zip(fields, values))
        length = int(named["Archive-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"record {place} ends after {len(block)} of {length} bytes")
        head, blank, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
        yield ArcRecord(named["URL"], named["IP-address"], named["Archive-date"], named["Content-type"], place, head + blank, payload)
        place += 1


def header_value(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^%b:[ \t]*([^\r\n]*)" % name.encode(), head)
    return found[1].decode("utf-8", "replace") if found else None


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_index(arcs: DataFrame) -> DataFrame:
    """(folder, path, place, page_id, payload_bytes, digest) of every record of ``arcs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for folder, path in zip(pdf["folder"], pdf["path"]):
                rows = []
                with opened(folder, path) as stream:
                    for r in read_arc(stream):
                        page = header_value(r.head, "X-Page-Id")
                        rows.append((folder, path, r.place, page, len(r.payload), base32_sha1(r.payload)))
                out = pd.DataFrame(rows, columns=["folder", "path", "place", "page_id", "payload_bytes", "digest"])
                out["page_id"] = [None if p is None else int(p) for p in out["page_id"]]
                yield out.astype({"page_id": "Int64"})

    schema = "folder string, path string, place long, page_id long, payload_bytes long, digest string"
    return materialize(spread_files(arcs).mapInPandas(run, schema))


def spread_files(manifest: DataFrame) -> DataFrame:
    """One row per file, dealt out so that tasks get few files each."""
    return manifest.repartition(max(1, manifest.count()))


def decide(index: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``index`` with the page id and place of the response that a record repeats, null for responses."""
    at = F.struct("page_id", "path", "place")
    shared = (
        index.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy("digest")
        .agg(F.max(at).alias("first"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .select("digest", "first")
    )
    found = index.join(shared, "digest", "left")
    revisit = F.col("first").isNotNull() & ~((F.col("first.path") == F.col("path")) & (F.col("first.place") == F.col("place")))
    return found.withColumn("first", F.when(revisit, F.col("first")))


def record_id(path: str, place: int) -> str:
    """An identifier that depends on the archive's name and the record's place only."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path.rpartition("/")[2]}#{place}')}>"


def iso_date(date: str) -> str:
    """YYYYMMDDhhmmss, or a leading part of it, as an ISO date."""
    full = date + "00000101000000"[len(date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def warc_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def warc_record(r: ArcRecord, path: str, first: tuple[int | None, str, int] | None) -> bytes:
    """The WARC record of an ARC record; ``first`` is what it repeats."""
    block = r.head + r.payload if first is None else r.head
    headers = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", record_id(path, r.place)),
        ("WARC-Date", iso_date(r.date)),
        ("WARC-Target-URI", r.url),
        ("WARC-IP-Address", r.address),
        ("Content-Type", "application/http;msgtype=response" if r.head else r.kind),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(r.payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
    ]
    if first is not None:
        headers += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", record_id(first[1], first[2])),
            ("WARC-Refers-To-Page", "" if first[0] is None else str(first[0])),
        ]
    return warc_bytes(headers, block)


def convert(decisions: DataFrame) -> DataFrame:
    """Write one WARC file per ARC file of ``decisions``; the manifest (folder, path)."""
    target = shared_folder(decisions.sparkSession, "warc")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        folder, path = pdf["folder"].iat[0], pdf["path"].iat[0]
        first = {int(p): f for p, f in zip(pdf["place"], pdf["first"]) if f is not None}
        warc = Packer(target, ".warc.gz")
        about = f"software: corpusloom\r\nformat: WARC File Format 1.1\r\nsource: {path.rpartition('/')[2]}\r\n".encode()
        warc.add(
            warc_bytes(
                [
                    ("WARC-Type", "warcinfo"),
                    ("WARC-Record-ID", record_id(path, -1)),
                    ("WARC-Date", iso_date("")),
                    ("Content-Type", "application/warc-fields"),
                ],
                about,
            )
        )
        with opened(folder, path) as stream:
            for r in read_arc(stream):
                f = first.get(r.place)
                if f is not None:
                    f = (f["page_id"], f["path"], f["place"])
                warc.add(warc_record(r, path, f))
        return pd.DataFrame({"folder": [target], "path": [warc.close()[0]]})

    rows = decisions.select("folder", "path", "place", "first")
    return materialize(rows.groupBy("path").applyInPandas(run, "folder string, path string"))


def read_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record; header names in lower case."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("record ends early")
        yield headers, block


def read_warcs(warcs: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page in ``warcs``."""

    def row(headers: dict[str, str], block: bytes) -> tuple:
        head, blank, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
        page = header_value(head, "X-Page-Id")
        if headers["warc-type"] == "response":
            size, digest, refers = len(payload), base32_sha1(payload), None
        else:
            size = int(header_value(head, "Content-Length") or 0)
            digest, refers = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-refers-to-page"] or None
        return page and int(page), size, digest, headers["warc-type"], refers and int(refers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for folder, path in zip(pdf["folder"], pdf["path"]):
                with opened(folder, path) as stream:
                    rows = [row(h, b) for h, b in read_warc(stream) if h["warc-type"] in ("response", "revisit")]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return spread_files(warcs).mapInPandas(run, schema)


def convert_arcs(arcs: DataFrame, least_bytes: int = 0) -> DataFrame:
    """WARC files of the ARC files in ``arcs`` (folder, path); the manifest."""
    return convert(decide(arc_index(arcs), least_bytes))
