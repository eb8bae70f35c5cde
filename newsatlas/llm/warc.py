"""Web archives: writing pages as WARC records and reading archives back, record by record.

An archive is a chain of gzip members, one per record. The reader takes the file in chunks, inflates each member
incrementally, frames the block by its Content-Length, and verifies block and payload digests while the bytes pass;
no record has to fit in memory unless its payload is asked for.

Equal payloads are stored once: the record with the largest page id is the response, the others revisit it. A revisit
holds the HTTP header of its own capture, whose Content-Length is the length of the full payload.

Files go to a folder that all executors reach (any address that ``pyarrow.fs`` opens). A task writes under names of
its own; only files reported by tasks that succeeded are read, so repeated or lost tasks do no harm.

Defined results: a null payload is empty; a null url is left out; line breaks in a url become spaces; a page with a
null id is a response; rows that repeat both the payload and the largest id are all responses; an empty table gives no
archive. A record whose framing or digest is wrong is a row with ``error``; what follows in that archive is not read
when the framing is lost.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from newsatlas.llm.frames import query, table
from newsatlas.operators.keys import lookup
from newsatlas.session import cut, scratch_dir

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
CAPTURED = "1970-01-01T00:00:00Z"

CHUNK = 1 << 16
ARCHIVE_BYTES = 1 << 30
LEVEL = 3
BATCH_RECORDS = 500
ARCHIVES = "path string, records long, bytes long"
RECORDS = "archive string, record_type string, record_id string, uri string, refers_to_id string, payload_bytes long, payload_digest string, payload binary, error string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    digest = base32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    block = http if refers_to is not None else http + payload
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {CAPTURED}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", " ").replace("\n", " "))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", f"Content-Type: {HTTP_TYPE}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    parts = [packer.compress("\r\n".join(head).encode("utf-8") + b"\r\n\r\n"), packer.compress(block), packer.compress(b"\r\n\r\n"), packer.flush()]
    return b"".join(parts)


def revisits(pages: DataFrame, text: str = "html", key: str = "page_id") -> DataFrame:
    """(key, sha, refers_to) of the pages whose payload another page with a larger id has."""
    narrow = cut(pages.select(key, F.sha1(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("sha")).where(F.col(key).isNotNull()))
    shared = cut(narrow.groupBy("sha").agg(F.max(key).alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return lookup(narrow, shared, "sha").where(F.col(key) < F.col("refers_to")).distinct()


def write(pages: DataFrame, text: str = "html", key: str = "page_id", url: str = "url", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page; returns one row per archive file."""
    folder = scratch_dir(pages.sparkSession, "warc")
    own = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    sha = F.sha1(F.col("body").cast("binary"))
    again = revisits(pages, text, key).withColumnRenamed(key, "__id").withColumnRenamed("sha", "__sha")
    rows = own.withColumn("sha", sha).join(again, (F.col("id") == F.col("__id")) & (F.col("sha") == F.col("__sha")), "left").select("id", "url", "body", "refers_to")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(folder)
        place.create_dir(root, recursive=True)
        out, name, records, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [records], "bytes": [size]})

        for batch in batches:
            for page_id, address, body, refers in zip(*[column.to_pylist() for column in batch.columns]):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = place.open_output_stream(f"{root}/{name}", compression=None)
                member = record(page_id, address, body.encode("utf-8", "surrogatepass"), refers)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return cut(rows.mapInArrow(run, ARCHIVES))


class Broken(Exception):
    """The framing of an archive is lost."""


class Member:
    """The inflated bytes of one gzip member, taken in order."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.rest = stream, rest  # rest: bytes of the file not yet inflated
        self.inflate, self.ready = zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Inflate at most a chunk; False at the end of the member."""
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.rest or self.stream.read(CHUNK)
            if not data:
                raise Broken("archive ends inside a record")
            if not self.inflate.unconsumed_tail:
                self.rest = b""
            try:
                got = self.inflate.decompress(data, CHUNK)
            except zlib.error as e:
                raise Broken(f"not a gzip member: {e}") from e
            if self.inflate.eof:
                self.rest = self.inflate.unused_data
            if got:
                self.ready += got
                return True
        return False

    def upto(self, mark: bytes) -> bytes:
        """The bytes before a mark, however many: writers put addresses of any length in a header."""
        whole, at = bytearray(self.ready), 0
        while (found := whole.find(mark, at)) < 0:
            at, self.ready = max(0, len(whole) - len(mark) + 1), b""
            if not self.more():
                raise Broken("a header does not end")
            whole += self.ready
        self.ready = bytes(whole[found + len(mark) :])
        return bytes(whole[:found])

    def take(self, count: int) -> Iterator[bytes]:
        """Exactly ``count`` bytes, in pieces."""
        while count:
            if not self.ready and not self.more():
                raise Broken("the block is shorter than its Content-Length")
            piece, self.ready = self.ready[:count], self.ready[count:]
            count -= len(piece)
            yield piece


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = (line.partition(":") for line in lines[1:])
    return {"": lines[0]} | {name.strip().lower(): value.strip() for name, _, value in pairs}


def read_record(member: Member, payload: bool) -> dict:
    head = fields(member.upto(b"\r\n\r\n"))
    if not head[""].startswith("WARC/") or not head.get("content-length", "").isdigit():
        raise Broken("no WARC header with a Content-Length")
    kind, length = head.get("warc-type", ""), int(head["content-length"])
    block, body = hashlib.sha1(), hashlib.sha1()
    size, kept, http, ended = 0, [], b"", False
    for piece in member.take(length):
        block.update(piece)
        if not ended and head.get("content-type", "").startswith("application/http"):
            http += piece
            before, mark, piece = http.partition(b"\r\n\r\n")
            if not mark:
                continue
            http = before
        ended = True
        body.update(piece)
        size += len(piece)
        if payload:
            kept.append(piece)
    if b"".join(member.take(4)) != b"\r\n\r\n" or member.ready or member.more():
        raise Broken("the record does not end where its Content-Length says")
    stated = head.get("warc-payload-digest", "").removeprefix("sha1:")
    error = None
    if "warc-block-digest" in head and head["warc-block-digest"].removeprefix("sha1:") != base32(block.digest()):
        error = "block digest differs"
    elif kind != "revisit" and stated and stated != base32(body.digest()):
        error = "payload digest differs"
    if kind == "revisit":
        told = fields(http).get("content-length", "")
        size = int(told) if told.isdigit() else None
    return {
        "record_type": kind, "record_id": head.get("warc-record-id"), "uri": head.get("warc-target-uri"), "refers_to_id": head.get("warc-refers-to"),
        "payload_bytes": size, "payload_digest": stated or base32(body.digest()), "payload": b"".join(kept) if payload and kind != "revisit" else None, "error": error,
    }


def records(path: str, payload: bool = True) -> Iterator[dict]:
    """Every record of an archive in order."""
    place, root = fs.FileSystem.from_uri(path)
    with place.open_input_stream(root, compression=None) as stream:
        rest = stream.read(CHUNK)
        while rest:
            member = Member(stream, rest)
            try:
                yield {"archive": path, **read_record(member, payload)}
            except Broken as e:
                yield {"archive": path, "error": str(e)}
                return
            rest = member.rest or stream.read(CHUNK)


def read(archives: DataFrame, payload: bool = True, path: str = "path") -> DataFrame:
    """The records of all archives; each archive is read by one task from front to back."""
    spread = archives.select(path).repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [part.split()[0] for part in RECORDS.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        for batch in batches:
            for one in batch.column(0).to_pylist():
                rows, size = [], 0
                for row in records(one, payload):
                    rows.append({n: row.get(n) for n in names})
                    size += len(row.get("payload") or b"")
                    if len(rows) >= BATCH_RECORDS or size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spread.mapInArrow(run, RECORDS)


def page_of(urn: str):
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1)


@query("op2_warc")
def op2(spark, sf_dir):
    found = read(write(table(spark, sf_dir, "pages")), payload=False)
    number = lambda c: F.when(page_of(c) != "", page_of(c).cast("long"))
    return found.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_id").alias("refers_to"), "error",
    )
