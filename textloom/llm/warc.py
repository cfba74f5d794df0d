"""WARC archives: a writer of gzip-per-record archives with revisits, and a sequential reader.

Archives are rows (archive string, content binary), each a whole `.warc.gz` file of about ARCHIVE_BYTES, so that
any store that Spark writes to can hold them; `read_files` streams real `.warc.gz` files of any size, in the tasks, through the same
reader, which holds one record at a time. The reader inflates a record's gzip member piece by piece, frames the block by its
Content-Length, checks that the member ends with the record, and verifies the block and payload digests.

Records whose payloads are equal and have at least `min_revisit_bytes` bytes: the one with the largest page_id is
a response, the others are revisits that refer to it and store no payload. A null html is an empty payload, a null url an
empty target, a null page_id never a revisit. Rows that repeat a page_id and its payload are responses each if
that id is the largest; every row has its record. An empty table has no archive and no rows; extra columns don't reach the result. A payload has to fit
in an Arrow batch (2 GB) and in a task's memory. `round_trip` fails if a record is damaged, missing or refers to nothing.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

ARCHIVE_BYTES = 4 << 20
#: Digests of repeated payloads that are broadcast to the pages (about 60 bytes each); with more, a shuffle join brings them.
BROADCAST_DIGESTS = 300_000
READ_BYTES = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest(raw: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, headers: dict[str, str], block: bytes, level: int = 4) -> bytes:
    """One record as one gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    raw = f"WARC/1.1\r\nWARC-Type: {kind}\r\n{head}WARC-Block-Digest: sha1:{digest(block)}\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.compress(block) + deflate.compress(b"\r\n\r\n") + deflate.flush()


def page_record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    headers = {"WARC-Record-ID": f"<urn:x-page:{page_id}>", "WARC-Date": DATE, "WARC-Target-URI": _line(url or ""), "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest(payload)}"}
    if refers_to is None:
        return record("response", headers, _HTTP % len(payload) + payload)
    headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:x-page:{refers_to}>"}
    return record("revisit", headers, _HTTP % len(payload))


class BrokenArchive(ValueError):
    pass


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    block: bytes
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise BrokenArchive(f"no header: {line[:60]!r}")
        out[name.strip().decode().lower()] = value.strip().decode("utf-8", "replace")
    return out


def read_records(source: BinaryIO) -> Iterator[Record]:
    """Records of an archive in order; one gzip member each, inflated READ_BYTES at a time."""
    rest = b""
    while True:
        rest = rest or source.read(READ_BYTES)
        if not rest:
            return
        inflate, raw, head, need = zlib.decompressobj(31), bytearray(), -1, None
        fields: dict[str, str] = {}
        while not inflate.eof:
            if not rest and not (rest := source.read(READ_BYTES)):
                raise BrokenArchive("the archive ends inside a record")
            try:
                raw += inflate.decompress(rest, READ_BYTES)
            except zlib.error as e:
                raise BrokenArchive(str(e)) from e
            rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if need is None and (head := raw.find(b"\r\n\r\n")) >= 0:
                version, *lines = bytes(raw[:head]).split(b"\r\n")
                if not version.startswith(b"WARC/"):
                    raise BrokenArchive(f"no WARC version: {version[:20]!r}")
                fields = _headers(lines)
                if not fields.get("content-length", "").isdigit():
                    raise BrokenArchive("no Content-Length")
                need = head + 4 + int(fields["content-length"])
            if need is not None and len(raw) > need + 4:
                raise BrokenArchive("the block is longer than its Content-Length")
        if need is None or len(raw) != need + 4 or raw[need:] != b"\r\n\r\n":
            raise BrokenArchive("the block doesn't end at its Content-Length")
        out = Record(fields.get("warc-type", ""), fields, bytes(raw[head + 4 : need]))
        _check("block", fields.get("warc-block-digest"), out.block)
        if fields.get("content-type", "").startswith("application/http"):
            top, _, out.payload = out.block.partition(b"\r\n\r\n")
            out.http = _headers(top.split(b"\r\n")[1:])
            if out.kind != "revisit":
                if out.http.get("content-length", str(len(out.payload))) != str(len(out.payload)):
                    raise BrokenArchive("the payload doesn't have its Content-Length")
                _check("payload", fields.get("warc-payload-digest"), out.payload)
        yield out


def _check(what: str, stated: str | None, raw: bytes) -> None:
    if stated is not None and stated != f"sha1:{digest(raw)}":
        raise BrokenArchive(f"the {what} digest differs")


def mark_revisits(pages: DataFrame, min_revisit_bytes: int = 0, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """page_id, url, html (no nulls), refers_to. Digests and ids meet by hash, payloads stay where they are unless very many repeat."""
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("__digest", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    enough = F.octet_length("html") >= min_revisit_bytes
    heads = own.where(enough).groupBy("__digest").agg(F.max("page_id").alias("__head"), F.count(F.lit(1)).alias("__n"))
    heads = settle(heads.where("__n > 1 and __head is not null").select("__digest", "__head"), "repeated-payloads")
    joined = own.join(F.broadcast(heads) if heads.count() <= broadcast_digests else heads, "__digest", "left")
    return joined.select("page_id", "url", "html", F.when(enough & (F.col("__head") != F.col("page_id")), F.col("__head")).alias("refers_to"))


def write(marked: DataFrame) -> DataFrame:
    """Archives of the records: rows (archive, content)."""

    def run(batches):
        from pyspark import TaskContext

        task, number, parts, size = TaskContext.get().partitionId(), 0, [], 0
        start = lambda n: record("warcinfo", {"WARC-Record-ID": f"<urn:x-archive:{task}-{n}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")

        def full():
            return pa.RecordBatch.from_pydict({"archive": [f"pages-{task:05d}-{number:05d}.warc.gz"], "content": [start(number) + b"".join(parts)]})

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for i in range(batch.num_rows):
                page, url, html, refers = (c[i].as_py() for c in columns)
                parts.append(page_record(page, url, html.encode(), refers))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield full()
                    number, parts, size = number + 1, [], 0
        if parts:
            yield full()

    return marked.mapInArrow(run, "archive string, content binary")


_RECORD_SCHEMA = "archive string, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary, error string"


def _rows(name: str, source: BinaryIO, with_payload: bool) -> Iterator[pa.RecordBatch]:
    """The page records of one archive, and a row with an error where it is damaged."""
    rows, size = [], 0
    try:
        for r in read_records(source):
            if r.kind not in ("response", "revisit"):
                continue
            own = (r.headers.get("warc-payload-digest") or "").removeprefix("sha1:")
            full = len(r.payload) if r.kind == "response" else None
            rows.append((name, r.kind, r.headers.get("warc-record-id"), r.headers.get("warc-refers-to"), r.headers.get("warc-target-uri"), own, full, r.payload if with_payload and r.kind == "response" else None, None))
            size += len(r.payload) if with_payload else 0
            if size > 8 << 20 or len(rows) >= 5000:
                yield _batch(rows)
                rows, size = [], 0
    except BrokenArchive as e:
        rows.append((name, *[None] * 7, str(e)))
    if rows:
        yield _batch(rows)


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The page records of archives. A damaged archive gives its records up to the damage and a row with an error."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content")):
                yield from _rows(name, io.BytesIO(content.as_py() or b""), with_payload)

    return archives.mapInArrow(run, _RECORD_SCHEMA)


_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in _RECORD_SCHEMA.split(", ")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def open_stream(path: str) -> BinaryIO:
    """A file of any store that pyarrow knows, as a stream of bytes."""
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return store.open_input_stream(inside, compression=None)


def read_files(spark, path: str, with_payload: bool = True, open_file: Callable[[str], BinaryIO] = open_stream) -> DataFrame:
    """Records of `.warc.gz` files below a path. Spark lists the files; the tasks that open them read each from its beginning, a piece at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.warc.gz").load(path).select("path")
    dealt = files.repartition(max(1, min(files.count(), 10_000)), "path")

    def run(batches):
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with open_file(name) as source:
                    yield from _rows(name, source, with_payload)

    return dealt.mapInArrow(run, _RECORD_SCHEMA)


def resolve(records: DataFrame, strict: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records without an error.

    A revisit takes its length from the response it names, which must have its digest; strict: it is an error if there is none.
    """
    number = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1)
    as_long = lambda c: F.when(number(c) != "", number(c).cast("long"))
    rows = records.where("error is null").select(as_long("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_long("refers_to").alias("refers_to"))
    asked = rows.where("record_type = 'revisit'")
    whole = rows.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("__bytes")).where("refers_to is not null").dropDuplicates(["refers_to", "payload_digest"])
    found = asked.join(whole, ["refers_to", "payload_digest"], "left")
    length = F.coalesce("__bytes", F.raise_error(F.lit("a revisit refers to no response with its digest")).cast("long")) if strict else F.col("__bytes")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return rows.where("record_type = 'response'").select(*names).unionByName(found.withColumn("payload_bytes", length).select(*names))


def checked(records: DataFrame, expected: int) -> DataFrame:
    """The records, if none is damaged and there are as many as expected."""
    n, bad, why = records.agg(F.count_if(F.col("error").isNull()), F.count("error"), F.min("error")).first()
    if bad:
        raise BrokenArchive(f"{bad} archives are damaged: {why}")
    if n != expected:
        raise BrokenArchive(f"{n} records were read where {expected} were written")
    return records


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the pages as archives into the shared folder, reads these back, checks that all are there and whole, and resolves the revisits."""
    archives = settle(write(mark_revisits(pages, min_revisit_bytes)), "warc")
    records = settle(read(archives, with_payload=False).drop("payload", "target_uri", "archive"), "warc-records")
    return resolve(checked(records, pages.count()), strict=True)


def oracle_sql() -> str:
    """round_trip() over the view `pages` in DuckDB's SQL."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    chars = [f"substr('{alphabet}', ((('0x' || substr(x, {10 * i + 1}, 10))::bigint >> {shift}) & 31)::int + 1, 1)" for i in range(4) for shift in range(35, -1, -5)]
    return (
        "with p as (select page_id, coalesce(html, '') as h from pages), d as (select page_id, h, sha1(h) as x, max(page_id) over (partition by h) as head from p) "
        f"select page_id, octet_length(encode(h))::bigint as payload_bytes, concat({', '.join(chars)}) as payload_digest, "
        "case when page_id <> head then 'revisit' else 'response' end as record_type, case when page_id <> head then head end as refers_to from d"
    )
