"""WARC archives: written one gzip member a record, and read back sequentially.

A writer task streams its rows into an archive file (and begins a new one at ``ROLL`` bytes) in a folder that all
executors share; a record whose payload equals that of an earlier one becomes a revisit. A reader task streams an archive:
members are inflated piece by piece, records are framed by their content length, and digests are verified.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import hot_lookup, materialize, shared_dir

ROLL = 256 << 20
READ = 1 << 16
#: Bytes that a record's head may have.
MOST_HEAD = 1 << 20
EPOCH = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    """A header's value: no line breaks."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, payload_digest: str | None = None, compress: int = 1) -> bytes:
    """One record as one gzip member. A revisit carries the HTTP head (with the full length) and no payload."""
    sha = payload_digest or digest(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (b"" if kind == "revisit" else payload)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}')}>", f"WARC-Date: {EPOCH}"]
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(compress, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class DamagedArchive(ValueError):
    """A record that is cut off, badly framed, or does not have its digest."""


class Frame:
    """One record as its bytes come: the head, the block of the length that the head states, and the record's end."""

    def __init__(self) -> None:
        self.headers: dict | None = None
        self.head, self.block, self.end = bytearray(), bytearray(), bytearray()
        self.size, self.sha = 0, hashlib.sha1()

    def feed(self, data: bytes) -> None:
        if self.headers is None:
            self.head += data
            at = self.head.find(b"\r\n\r\n")
            if (at if at >= 0 else len(self.head)) > MOST_HEAD:
                raise DamagedArchive("a record's head does not end")
            if at < 0:
                return
            data, self.headers = bytes(self.head[at + 4 :]), self.parsed(bytes(self.head[:at]))
        rest = self.size - len(self.block)
        self.block += data[:rest]
        self.sha.update(data[:rest])
        self.end += data[rest:]
        if len(self.end) > 4:
            raise DamagedArchive("a record's content length is not its block's")

    def parsed(self, head: bytes) -> dict:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise DamagedArchive("a member does not begin with a WARC head")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        if not headers.get("content-length", "").isdecimal():
            raise DamagedArchive("a record has no content length")
        self.size = int(headers["content-length"])
        return headers

    def close(self) -> dict:
        """The record's headers (lower case), its HTTP head and its payload; framing and digests are verified."""
        if self.headers is None:
            raise DamagedArchive("a member does not begin with a WARC head")
        if len(self.block) != self.size or self.end != b"\r\n\r\n":
            raise DamagedArchive("a record's content length is not its block's")
        if (want := self.headers.get("warc-block-digest")) and want != f"sha1:{base64.b32encode(self.sha.digest()).decode()}":
            raise DamagedArchive("a block does not have its digest")
        http, _, payload = bytes(self.block).partition(b"\r\n\r\n")
        if self.headers.get("warc-type") == "response" and (want := self.headers.get("warc-payload-digest")) and want != f"sha1:{digest(payload)}":
            raise DamagedArchive("a payload does not have its digest")
        return self.headers | {"http": http.decode("latin-1"), "payload": payload}


def records(stream) -> Iterator[dict]:
    """The records of a stream, one gzip member each, read and inflated ``READ`` bytes at a time and framed as they come."""
    data = stream.read(READ)
    while data:
        z, frame = zlib.decompressobj(31), Frame()
        while not z.eof:
            if not data:
                raise DamagedArchive("the archive ends within a member")
            try:
                frame.feed(z.decompress(data, READ))
            except zlib.error as e:
                raise DamagedArchive(f"a member can't be inflated: {e}") from e
            data = z.unused_data if z.eof else z.unconsumed_tail or stream.read(READ)
        yield frame.close()
        data = data or stream.read(READ)


def _filesystem(uri: str):
    """The file system of a folder's URI and the path in it. ``shared_dir`` gives every folder with its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def plan_records(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``payload`` and ``refers_to``: null for responses, else the page whose payload this one repeats.

    Of rows with equal payloads of ``least`` bytes or more, those with the smallest id are responses; null ids come after
    all others. Only digests and ids are aggregated; a payload that very many pages have is looked up by broadcast.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("__q_sha", F.sha2("payload", 256))
    first = rows.groupBy("__q_sha").agg(F.min("page_id").alias("__q_first"), F.count("*").alias("__q_n"))
    found = hot_lookup(rows, first, "__q_sha", "__q_n")
    again = (F.octet_length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("__q_first"))
    return found.select("page_id", "url", "payload", F.when(again, F.col("__q_first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Writes ``plan_records``' rows as ``*.warc.gz`` in ``folder``; returns the archives (``path``, ``records``, ``bytes``).

    A file gets its final name when it is complete. Each attempt of a task has names of its own and only the attempt that
    counts is listed, so a lost executor costs no more than its files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        context = TaskContext.get()
        stem = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}" if context else f"{base}/part"
        out, made, count, size = None, [], 0, 0

        def close() -> None:
            out.close()
            name = f"{stem}-{len(made):04d}.warc.gz"
            system.move(f"{stem}.open", name)
            made.append((name, count, size))

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for page, url, payload, refers in zip(*cols, strict=True):
                if out is None:
                    out, count, size = system.open_output_stream(f"{stem}.open", compression=None), 0, 0
                data = record("response" if refers is None else "revisit", page, url, payload, refers)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= roll:
                    close()
                    out = None
        if out is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=["path", "records", "bytes"])

    # The listing is a table: whatever reads it later does not write the archives again.
    return materialize(records.select("page_id", "url", "payload", "refers_to").mapInArrow(write, "path string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the listed archives: ``page_id``, ``url``, ``record_type``, ``payload_bytes``, ``payload_digest``,
    ``refers_to`` and ``payload`` (null for revisits). A damaged archive is an error, never a shorter result.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(folder)
        for batch in batches:
            for path, want in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, held, seen = [], 0, 0
                with system.open_input_stream(path, compression=None) as stream:
                    for record in records(stream):
                        rows.append(_row(record))
                        held, seen = held + len(record["payload"]), seen + 1
                        if held >= 4 << 20:
                            yield _records(rows)
                            rows, held = [], 0
                if seen != want:
                    raise DamagedArchive(f"{path} has {seen} records of {want}")
                if rows:
                    yield _records(rows)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    spread = archives.select("path", "records").repartition(max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")
    return spread.mapInArrow(read, schema)


def _row(r: dict) -> tuple:
    length = next(int(x.partition(":")[2]) for x in r["http"].split("\r\n") if x.lower().startswith("content-length:"))
    number = lambda k: int(r[k]) if k in r else None
    kind = r["warc-type"]
    return number("warc-page-id"), r.get("warc-target-uri"), kind, length, r["warc-payload-digest"].removeprefix("sha1:"), number("warc-refers-to-page-id"), r["payload"] if kind == "response" else None


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc"
    archives = write_archives(plan_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    return read_archives(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
