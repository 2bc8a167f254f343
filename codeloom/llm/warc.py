"""WARC files: a sequential reader and a writer, as a Spark data source.

The reader goes through a file once: each record is a gzip member of its own, decompressed and hashed bit by bit; its
header says how long its block is, and the digests in it are verified. One task reads a file; files are what is
read in parallel, so they should be of about the same size (the writer cuts them at ``records_per_file``).

    spark.dataSource.register(WarcDataSource)
    spark.read.format("warc").load("/shared/crawl")
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .shared import shared_dir

SCHEMA = "file string, offset long, record_id string, type string, uri string, date string, content_type string, headers map<string,string>, part int, payload binary, block_length long, digest string, digest_ok boolean, problem string"
_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("part", pa.int32()), ("payload", pa.binary()), ("block_length", pa.int64()), ("digest", pa.string()), ("digest_ok", pa.bool_()), ("problem", pa.string())])
CHUNK = 1 << 20
BATCH_BYTES = 16 << 20
BATCH_RECORDS = 500
#: Bytes of payload in a row: a longer one comes in parts, a row each.
PART_BYTES = 256 << 20
#: Compressed bytes of a member that are kept, to look for the next one in them if it turns out to be broken.
KEPT_BYTES = 64 << 20
_MAGIC = b"\x1f\x8b\x08"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _begins(data: bytes) -> bool | None:
    """Whether a gzip member of a WARC record begins here; None if the bytes are too few to tell."""
    try:
        text = zlib.decompressobj(31).decompress(data, 5)
    except zlib.error:
        return False
    return text == b"WARC/" if len(text) == 5 else None


def _next_member(data: bytes, stream) -> tuple[int, bytes]:
    """(bytes skipped, the rest) up to where the next record's member begins, or to the end of the stream."""
    skipped = 0
    while True:
        at = data.find(_MAGIC)
        if at >= 0:
            begins = _begins(data[at : at + 65_536])
            if begins is None and (more := stream.read(CHUNK)):
                data += more
                continue
            if begins:
                return skipped + at, data[at:]
            skipped, data = skipped + at + 1, data[at + 1 :]
            continue
        tail = len(data) - min(2, len(data))
        skipped, data = skipped + tail, data[tail:]
        more = stream.read(CHUNK)
        if not more:
            return skipped + len(data), b""
        data += more


def pieces_of_members(stream) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset of the member, a piece of its content, None) for the pieces of each gzip member of a stream, and
    (offset, None, problem) at its end.

    After a broken member, reading goes on where the next member inflates to a WARC record; so one that is damaged
    or cut off costs no other record.
    """
    data, offset = b"", 0
    while True:
        if not data:
            data = stream.read(CHUNK)
            if not data:
                return
        if data[:1] == b"\0":  # padding between members
            rest = data.lstrip(b"\0")
            offset += len(data) - len(rest)
            data = rest
            continue
        start, problem, seen, size = offset, None, [data], len(data)
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            if not data:
                data = stream.read(CHUNK)
                if not data:
                    problem = "truncated member"
                    break
                if size <= KEPT_BYTES:
                    seen.append(data)
                size += len(data)
            try:
                part = inflate.decompress(data, CHUNK)
            except zlib.error as e:
                problem = f"not a gzip member: {e}"
                break
            left = inflate.unconsumed_tail or inflate.unused_data
            offset += len(data) - len(left)
            data = left
            if part:
                yield start, part, None
        yield start, None, problem
        if problem:
            kept = b"".join(seen)
            # the member may have swallowed others: they are looked for from its second byte on
            offset, data = (start + 1, kept[1:]) if size == len(kept) else (offset, data)
            skipped, data = _next_member(data, stream)
            offset += skipped


def pieces_of_records(stream, data: bytes = b"") -> Iterator[tuple[int, bytes | None, str | None]]:
    """The same for a file without compression: records are framed by their content length. What isn't a record is
    skipped up to the next line that begins one."""
    offset = 0

    def more() -> bool:
        nonlocal data
        new = stream.read(CHUNK)
        data += new
        return bool(new)

    while data or more():
        start = offset
        while (end := data.find(b"\r\n\r\n")) < 0 and len(data) < 1 << 20 and more():
            pass
        found = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r$", data[: end + 2]) if end >= 0 and data[:5] == b"WARC/" else None
        if not found:
            at = data.find(b"\nWARC/", 1)
            while at < 0 and more():
                at = data.find(b"\nWARC/", 1)
            skip = at + 1 if at >= 0 else len(data)
            if data[:skip].strip(b"\r\n"):
                yield start, None, "no WARC header"
            offset, data = offset + skip, data[skip:]
            continue
        left = end + 4 + int(found[1])
        while left and (data or more()):
            yield start, data[:left], None
            n = min(left, len(data))
            offset, data, left = offset + n, data[n:], left - n
        while len(data) < 4 and more():
            pass
        if data[:4] == b"\r\n\r\n":
            yield start, data[:4], None
            offset, data = offset + 4, data[4:]
        yield start, None, None


def members(stream) -> Iterator[tuple[int, bytes, str | None]]:
    """(offset of the member, its content, problem) for each gzip member of a stream."""
    out = []
    for offset, piece, problem in pieces_of_members(stream):
        if piece is not None:
            out.append(piece)
        else:
            yield offset, b"".join(out), problem
            out = []


def digest_of(data: bytes, algorithm: str = "sha1") -> str | None:
    """``algorithm:base32``, or None for an algorithm that isn't known here."""
    if algorithm not in ("sha1", "md5", "sha256", "sha512"):
        return None
    return f"{algorithm}:{base64.b32encode(hashlib.new(algorithm, data).digest()).decode().rstrip('=')}"


class _Digest:
    """A digest that a header claims, and the bytes' own as they come. Base 32 or hexadecimal."""

    def __init__(self, claimed: str | None):
        algorithm, colon, self.value = (claimed or "").partition(":")
        algorithm = algorithm.strip().lower()
        self.own = hashlib.new(algorithm) if colon and algorithm in ("sha1", "md5", "sha256", "sha512") else None

    def update(self, data: bytes) -> None:
        if self.own:
            self.own.update(data)

    def agrees(self) -> bool | None:
        """None without a digest of a known algorithm."""
        if not self.own:
            return None
        value = self.value.strip()
        return value.rstrip("=").upper() == base64.b32encode(self.own.digest()).decode().rstrip("=") or value.lower() == self.own.hexdigest()


class Record:
    """One record, fed piece by piece: its header, then a block of the content length, whose payload comes in parts."""

    def __init__(self):
        self.headers: dict[str, str] = {}
        self.problem: str | None = None
        self.length: int | None = None  # of the block, by its header
        self.block_length = 0
        self._head: bytes | None = b""
        self._http: bytes | None = None  # the end of an HTTP header that hasn't ended
        self._after = b""
        self._payload: list[bytes] = []
        self._size = 0

    def feed(self, data: bytes) -> Iterator[bytes]:
        """Takes content; gives parts of the payload that are full."""
        if self._head is not None:
            self._head += data
            head, sep, data = self._head.partition(b"\r\n\r\n")
            if not sep:
                return
            self._head = None
            self._start(head)
        if self.length is None:
            return
        block = data[: self.length - self.block_length]
        self._after = (self._after + data[len(block) :])[:5]
        if block:
            first = not self.block_length
            self.block_length += len(block)
            self._block.update(block)
            if first and self.headers.get("warc-type") in ("response", "request") and block[:5] in (b"HTTP/", b"GET /", b"POST "):
                self._http = b""
            if self._http is not None:
                _, sep, rest = (self._http + block).partition(b"\r\n\r\n")
                self._http = None if sep else (self._http + block)[-3:]
                block = rest
            self._digest.update(block)
            self._payload.append(block)
            self._size += len(block)
            while self._size > PART_BYTES:
                whole = b"".join(self._payload)
                yield whole[:PART_BYTES]
                self._payload, self._size = [whole[PART_BYTES:]], len(whole) - PART_BYTES

    def _start(self, head: bytes) -> None:
        lines = head.split(b"\r\n")
        if not re.fullmatch(rb"WARC/\d+\.\d+", lines[0]):
            self.problem = "no WARC header"
            return
        last = None
        for line in lines[1:]:
            if line[:1] in b" \t" and last and line:  # a folded line
                self.headers[last] += " " + line.strip().decode("utf-8", "replace")
                continue
            name, colon, value = line.partition(b":")
            if colon:
                last = name.strip().decode("utf-8", "replace").lower()
                self.headers[last] = value.strip().decode("utf-8", "replace")
        length = self.headers.get("content-length", "")
        if not length.isascii() or not length.isdigit():
            self.problem = "no content length"
            return
        self.length = int(length)
        self._block, self._digest = _Digest(self.headers.get("warc-block-digest")), _Digest(self.headers.get("warc-payload-digest"))

    def end(self) -> dict:
        """The fields, with the last part of the payload; ``problem`` says what is wrong."""
        out = {"headers": self.headers, "payload": None, "block_length": None, "digest_ok": None, "problem": self.problem}
        if self.length is None:
            return out | {"problem": self.problem or "no WARC header"}
        if self.block_length < self.length:
            out["problem"] = "block shorter than its content length"
        elif self._after != b"\r\n\r\n":
            out["problem"] = "record doesn't end after its block"
        known = [c for c in (self._block.agrees(), self._digest.agrees()) if c is not None]
        if known and not all(known):
            out["problem"] = out["problem"] or "digest doesn't match"
        return out | {"payload": b"".join(self._payload), "block_length": self.block_length, "digest_ok": all(known) if known else None}


def parse_record(content: bytes) -> dict:
    """The fields of one record whose payload is one part."""
    r = Record()
    for _ in r.feed(content):
        raise ValueError("the payload has several parts")
    return r.end()


def records(path: str) -> Iterator[tuple]:
    """Rows of SCHEMA, in the file's order."""
    system, name = _open(path)
    with system.open_input_stream(name, compression=None) as stream:
        first = stream.read(CHUNK)
        joined = _Joined(first, stream)
        pieces = pieces_of_records(joined) if first[:5] == b"WARC/" else pieces_of_members(joined)
        r, part = Record(), 0

        def row(offset: int, x: dict) -> tuple:
            h = r.headers
            return (path, offset, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"), list(h.items()), part, x["payload"], x["block_length"], h.get("warc-block-digest") or h.get("warc-payload-digest"), x["digest_ok"], x["problem"])

        for offset, piece, problem in pieces:
            if piece is not None:
                for payload in r.feed(piece):
                    yield row(offset, {"payload": payload, "block_length": None, "digest_ok": None, "problem": None})
                    part += 1
                continue
            last = r.end()
            yield row(offset, last | {"problem": problem or last["problem"]})
            r, part = Record(), 0


class _Joined:
    """A stream with its beginning put back."""

    def __init__(self, first: bytes, stream):
        self.first, self.stream = first, stream

    def read(self, n: int) -> bytes:
        if self.first:
            out, self.first = self.first, b""
            return out
        return self.stream.read(n)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        system, name = _open(self.path)
        info = system.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.is_file:
            return [_File(self.path)]
        prefix = self.path.rstrip("/")
        found = system.get_file_info(fs.FileSelector(name, recursive=True))
        base = name.rstrip("/")
        return [_File(prefix + f.path[len(base) :]) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith((".warc.gz", ".warc")) and not re.search("/[._]", f.path[len(base) :])] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in records(partition.path) if partition.path else ():
            rows.append(row)
            size += len(row[9] or b"")
            if size >= BATCH_BYTES or len(rows) >= BATCH_RECORDS:
                yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r)) for r in rows], schema=_ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r)) for r in rows], schema=_ARROW)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)``: the records of a file, or of all .warc.gz and .warc files below a
    folder; names that begin with a dot or an underscore, a writer's waiting files among them, are left out.

    Records that can't be read whole have a ``problem``, and reading goes on with the next one. A payload of more than
    PART_BYTES comes in several rows, numbered by ``part``; the last one has the block's length and the digests' verdict.
    Files without records, and folders without files, give no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").load(path)


def _escape(value: str) -> str:
    """A header value: line breaks and per cents are written as per cent codes."""
    return "".join(f"%{ord(c):02X}" if c in "\r\n%" else c for c in value)


def unescape(column):
    """The header value that ``write_warc`` was given."""
    return F.replace(F.replace(F.replace(column, F.lit("%0D"), F.lit("\r")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def record(record_id: str, uri: str | None, payload: bytes, extra: dict[str, str] | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One response record as a gzip member."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    lines = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_escape(uri)}")
    lines += [f"{k}: {v}" for k, v in (extra or {}).items()]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: {digest_of(block)}", f"WARC-Payload-Digest: {digest_of(payload)}", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", records_per_file: int = 20_000) -> None:
    """Writes each row as a response record; the folder is filled when this returns.

    A task writes files of its own attempt and reports their names; those of the attempt that counts are then
    moved to where the reader looks, so a task that is lost or run twice leaves no record twice. Nulls are marked
    in extra headers.
    """
    waiting = f"{path.rstrip('/')}/_waiting"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        system, base = _open(waiting)
        system.create_dir(base, recursive=True)
        names, out, n = [], None, 0
        for batch in batches:
            for i, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or n >= records_per_file:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid4().hex}.warc.gz")
                    out, n = system.open_output_stream(f"{base}/{names[-1]}", compression=None), 0
                extra = ({"X-Null-Id": "1"} if i is None else {"X-Id": _escape(i)}) | ({"X-Null-Payload": "1"} if html is None else {})
                out.write(record(f"<urn:page:{'' if i is None else quote(i, safe='-')}>", url, (html or "").encode("utf-8", "surrogatepass"), extra))
                n += 1
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    rows = pages.select(F.col(id_col).cast("string"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    # names are as many as files, and files hold thousands of records
    done = [r["name"] for r in rows.mapInArrow(run, "name string").collect()]
    system, base = _open(path)
    system.create_dir(base, recursive=True)
    for name in done:
        system.move(f"{base.rstrip('/')}/_waiting/{name}", f"{base.rstrip('/')}/{name}")
    if system.get_file_info(f"{base.rstrip('/')}/_waiting").type == fs.FileType.Directory:
        system.delete_dir(f"{base.rstrip('/')}/_waiting")


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest_ok, problem): pages written as WARC files in the shared folder and read again.

    Null ids, urls and texts come back as nulls, empty ones as empty, repeated rows as often as they were there, ids in
    their type (any that a string can hold), texts of up to PART_BYTES as they were; other columns are not read; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_warc(pages, path)
    r = read_warc(spark, path)
    headers = F.col("headers")
    return r.select(
        F.when(headers["x-null-id"].isNull(), unescape(headers["x-id"])).cast(pages.schema["page_id"].dataType).alias("page_id"),
        unescape(F.col("uri")).alias("url"),
        F.when(headers["x-null-payload"].isNull(), F.decode("payload", "UTF-8")).alias("html"),
        "digest_ok",
        "problem",
    )
