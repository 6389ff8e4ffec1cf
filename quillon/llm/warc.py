"""WARC archives: a Python data source that writes records and reads them back.

Writing: each record is a gzip member of its own, whose extra field "sl" tells
the member's length, so that a reader can pass over it without inflating it.
Tasks write files of their own under a temporary folder; the commit moves
those of the tasks that succeeded, so lost executors and repeated attempts
leave nothing behind.

Reading: partitions are whole files balanced by size; record-type and header
predicates come from the plan; of each member only as much is inflated as its
headers take, and the payload only where the predicates let the record through
and a column asks for it.  Archives with foreign members (no "sl"), with one
member a file, or without compression are read as well.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .store import BROADCAST_IDS, cut, scratch

#: Columns of the data source and the header that each is read from (fixed values).
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_length": "X-Payload-Length",
}
READ_SCHEMA = ", ".join(f"{n} string" for n in HEADERS) + ", content_length bigint, payload binary"
PART_BYTES = 64 << 20
END = "\r\n\r\n"
#: Fixed value: how a record that repeats a payload says so.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """pages as one WARC record a row: (record), without the closing blank lines.

    Of records with equal payloads of at least `least` bytes, the one with the
    smallest id is a response and the others revisit it; smaller ones are all
    responses.  Only ids and digests are shuffled: the smallest id of each
    repeated digest is a grouped minimum, combined before the shuffle, and
    joined to the ids of that digest (a join whose large keys are split at run
    time).  The revisits found reach the pages by id: broadcast up to
    BROADCAST_IDS of them (counted), by a shuffle beyond.

    Null payloads and urls are empty; rows that repeat an id repeat its
    WARC-Record-ID; a null id is never the smallest and its record is a
    response; other columns are not read; an empty table gives no records.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    url = F.coalesce(F.col(url_col).cast("string"), F.lit("")) if url_col in pages.columns else F.lit("")
    named = pages.select(F.col(id_col).alias("id"), url.alias("url"), payload.alias("payload"))
    hashed = named.withColumn("digest", F.sha2("payload", 256))
    large = hashed.filter(F.octet_length("payload") >= least).select("id", "digest")
    firsts = large.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("digest", "first")
    later = cut(large.join(cut(firsts), "digest").filter("id > first").distinct())
    few = later.count() <= BROADCAST_IDS
    joined = hashed.join(F.broadcast(later) if few else later, ["id", "digest"], "left")
    revisit = F.col("first").isNotNull()
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END)
    )
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("payload")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    clean = F.regexp_replace("url", r"[\r\n]+", " ")
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("id")),
        F.lit("\r\nWARC-Target-URI: "), clean,
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), urn(F.col("first")))).otherwise(""),
        F.lit("\r\nX-Payload-Length: "), F.octet_length("payload").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"),
        F.lit(END), F.col("block"),
    )
    return joined.withColumn("block", block).select(record.alias("record"))


def write_warc(pages: DataFrame, to: str, compress: bool = True, **options) -> None:
    """Writes pages as WARC files under `to`, a path that every executor sees: .warc.gz, or .warc without compression."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcDataSource)
    with scratch(spark):
        records(pages, **options).write.format("warc").option("compress", str(compress).lower()).mode("append").save(to)


def open_fs(path: str):
    """(file system, path in it).  Spark's names for S3 are known as well; other schemes are those that Arrow knows."""
    from pyarrow import fs

    scheme, mark, rest = path.partition("://")
    if not mark:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


# --------------------------------------------------------------------------- members


def member(data: bytes, level: int = 6) -> bytes:
    """data as one gzip member that tells its own length in the extra field "sl" (compressed, or 0 from 4 GB on; uncompressed)."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(data) + deflate.flush()
    size = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size if size < 1 << 32 else 0, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def member_length(head: bytes) -> int | None:
    """The length that a member's first bytes tell, if they do."""
    if len(head) >= 24 and head[:3] == b"\x1f\x8b\x08" and head[3] & 4 and head[12:14] == b"sl":
        return struct.unpack("<I", head[16:20])[0] or None
    return None


class Inflated(io.RawIOBase):
    """What the gzip members of a file hold, one after the other, inflated as it is read.

    `skip` passes over the rest of the member at hand: by a seek where its
    length is known, else by inflating it.  `inflated` counts the bytes made.
    """

    def __init__(self, file, chunk: int = 1 << 16):
        self.file, self.chunk, self.inflated = file, chunk, 0
        self.begin, self.raw = 0, b""
        self._member()

    def _member(self) -> None:
        """Begins with the member at self.begin; self.raw holds what is read of it."""
        if len(self.raw) < 24:
            self.raw += self.file.read(self.chunk)
        self.length = member_length(self.raw)
        self.state = zlib.decompressobj(31) if self.raw else None

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        while self.state is not None:
            out = self.state.decompress(self.raw, len(b))
            self.raw = self.state.unconsumed_tail
            if self.state.eof:
                self.raw = self.state.unused_data
                self.begin = self.file.tell() - len(self.raw)
                self._member()
            elif not out and not self.raw:
                self.raw = self.file.read(self.chunk)
                if not self.raw:
                    raise EOFError("a member ends early")
            if out:
                self.inflated += len(out)
                b[: len(out)] = out
                return len(out)
        return 0

    def skip(self) -> bool:
        """To the next member, if this one's length is known."""
        if self.state is None or self.length is None:
            return False
        self.begin += self.length
        self.file.seek(self.begin)
        self.raw = b""
        self._member()
        return True


# --------------------------------------------------------------------------- reading


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def parse_headers(stream) -> dict[str, str] | None:
    """The next record's headers, by lower-case name; None at the end of the file."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    found: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _pass(stream, size: int) -> None:
    """Reads over size bytes; by a seek where the stream can."""
    if stream.seekable():
        stream.seek(size, io.SEEK_CUR)
    else:
        while size > 0:
            size -= len(stream.read(min(size, 1 << 20))) or size


def read_records(stream, wanted: dict[str, frozenset], with_payload: bool) -> Iterator[tuple]:
    """Rows of READ_SCHEMA for the records whose headers have wanted values."""
    while (h := parse_headers(stream)) is not None:
        size = int(h.get("content-length", 0))
        row = [h.get(name.lower()) for name in HEADERS.values()]
        take = all(row[list(HEADERS).index(c)] in values for c, values in wanted.items())
        payload = None
        if take and with_payload:
            block = stream.read(size)
            payload = block.partition(b"\r\n\r\n")[2] if h.get("content-type", "").startswith("application/http") else block
        if take:
            yield (*row, size, payload)
        if not (take and with_payload):
            _pass(stream, size)


def read_members(file, wanted: dict[str, frozenset], with_payload: bool, made: Inflated | None = None) -> Iterator[tuple]:
    """As read_records, of a file of gzip members; a record that begins a member of known length is passed over by that."""
    source = made or Inflated(file)
    while source.state is not None:
        if source.length is None:  # records may go on over members
            yield from read_records(io.BufferedReader(source, 1 << 16), wanted, with_payload)
            return
        at = source.begin
        lines = bytearray()
        while (end := lines.find(b"\r\n\r\n")) < 0 and source.begin == at and (part := source.read(1024)):
            lines += part
        stream = io.BytesIO(bytes(lines[: end + 4]))
        h = parse_headers(stream)
        if h is None:
            continue
        size, whole = int(h.get("content-length", 0)), source.begin != at
        row = [h.get(name.lower()) for name in HEADERS.values()]
        take = all(row[list(HEADERS).index(c)] in values for c, values in wanted.items())
        payload = None
        if take and with_payload:
            block = bytearray(lines[end + 4 :])
            while len(block) < size and source.begin == at and (part := source.read(max(1 << 16, size - len(block)))):
                block += part
            whole = source.begin != at
            block = bytes(block[:size])
            payload = block.partition(b"\r\n\r\n")[2] if h.get("content-type", "").startswith("application/http") else block
        if take:
            yield (*row, size, payload)
        if not whole:
            source.skip()


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.wanted: dict[str, frozenset] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and column in HEADERS:
                values = frozenset([f.value])
            elif isinstance(f, In) and column in HEADERS:
                values = frozenset(f.value)
            else:
                yield f
                continue
            self.wanted[column] = self.wanted.get(column, values) & values

    def partitions(self):
        from pyarrow import fs

        system, path = open_fs(self.path)
        infos = system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((x.path, x.size) for x in infos if x.is_file and x.size and not any(p.startswith(("_", ".")) for p in x.path[len(path) :].split("/")))
        groups, size = [], self.part_bytes
        for name, n in files:
            if size + n > self.part_bytes:
                groups.append([])
                size = 0
            groups[-1].append(name)
            size += n
        return [_Files(g) for g in groups] or [_Files([])]

    def read(self, partition):
        system, _ = open_fs(self.path)
        names = [*HEADERS, "content_length", "payload"]
        types = [pa.string()] * len(HEADERS) + [pa.int64(), pa.binary()]
        rows, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        for name in partition.paths:
            with system.open_input_file(name) as raw:
                packed = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                found = read_members(raw, self.wanted, self.with_payload) if packed else read_records(io.BufferedReader(_Raw(raw), 1 << 20), self.wanted, self.with_payload)
                for row in found:
                    rows.append(row)
                    size += len(row[-1] or b"") + 200
                    if size >= 4 << 20:
                        yield out()
                        rows, size = [], 0
        if rows:
            yield out()


class _Raw(io.RawIOBase):
    """A seekable stream over an Arrow file, so that skipping a payload is a seek."""

    def __init__(self, file):
        self.file = file

    def readable(self):
        return True

    def seekable(self):
        return True

    def readinto(self, b):
        data = self.file.read(len(b))
        b[: len(data)] = data
        return len(data)

    def seek(self, to, whence=io.SEEK_SET):
        self.file.seek(to if whence == io.SEEK_SET else self.file.tell() + to if whence == io.SEEK_CUR else self.file.size() + to)
        return self.file.tell()

    def tell(self):
        return self.file.tell()


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    """Writes a column `record`, one file a task."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.packed = options.get("compress", "true").lower() != "false"
        self.folder = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator):
        system, path = open_fs(self.path)
        name, out = f"part-{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}", None
        try:
            for batch in iterator:
                for record in batch.column("record"):
                    if out is None:
                        system.create_dir(f"{path}/{self.folder}", recursive=True)
                        out = system.open_output_stream(f"{path}/{self.folder}/{name}", compression=None)
                    data = record.as_py().encode() + END.encode()
                    out.write(member(data) if self.packed else data)
        finally:
            if out is not None:
                out.close()
        return _Written(name if out is not None else None)

    def commit(self, messages):
        system, path = open_fs(self.path)
        system.create_dir(path, recursive=True)
        for m in messages:
            if m is not None and m.name:
                system.move(f"{path}/{self.folder}/{m.name}", f"{path}/{m.name}")
        self.abort(messages)

    def abort(self, messages):
        from pyarrow import fs

        system, path = open_fs(self.path)
        if system.get_file_info(f"{path}/{self.folder}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.folder}")


class WarcDataSource(DataSource):
    """df.write.format("warc").save(path); spark.read.format("warc").load(path), where option payload=false leaves payloads unread."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive_index(archive: DataFrame, id_type: T.DataType = T.LongType()) -> DataFrame:
    """What archives hold, page by page: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    A response's length and digest are computed from the payload as read; if
    they are not its headers', the query fails.  A revisit has no payload, so
    its headers give them.
    """
    number = lambda c: F.regexp_extract(c, r"<urn:page:(.*)>", 1)
    kind = F.col("record_type")
    own = kind == "response"
    digest, told = F.sha2("payload", 256), F.substring_index("payload_digest", ":", -1)
    told_right = (digest == told) & (F.octet_length("payload") == F.col("payload_length").cast("long"))
    checked = F.when(told_right, digest).otherwise(F.raise_error(F.concat(F.lit("payload unlike its headers in "), F.col("record_id"))))
    return archive.select(
        F.when(number("record_id") != "null", number("record_id")).cast(id_type).alias("page_id"),
        F.when(own, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(own, checked).otherwise(told).alias("payload_digest"),
        kind.alias("record_type"),
        F.when(~own, number("refers_to")).cast(id_type).alias("refers_to"),
    )
