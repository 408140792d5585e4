"""WARC archives as a PySpark data source.

Writing: each task streams its rows into files of its own, one gzip member per record.
The members carry the compressed length in the ``SL`` extra field, so that a reader
finds the next record without inflating this one.  The driver's commit writes a list of
the finished files; files of lost or repeated attempts are in no list and are not read.

Reading: any folder of ``.warc`` and ``.warc.gz`` files, or one such file, with a partition per
file.  Filters on ``record_type`` and on other header columns are pushed down and the header is
parsed first.  A record that fails them, or whose payload is not asked for, is skipped: in
its compressed form where the member says how long it is, by its position in a plain
file, and else by inflating it piece by piece into nothing.  Files are streamed; what is held is
one record's payload.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual,
                                    StringStartsWith, WriterCommitMessage)

from .common import BROADCAST_BYTES, materialize, new_folder, open_fs, small_batches
from .exact_dedup import with_filter

SCHEMA = ("page_id long, url string, record_type string, record_id string, payload_bytes long, payload_digest string, "
          "refers_to long, payload binary")
#: A new file begins after as many compressed bytes.
FILE_BYTES = 64 << 20
#: Bytes of a row of the table of repeated digests.
FIRST_BYTES = 120
#: Payloads shorter than this are never revisits.
MIN_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Column -> header; the value is a number where the flag is set.
_HEADERS = {"page_id": ("X-Page-Id", True), "url": ("WARC-Target-URI", False), "record_type": ("WARC-Type", False),
            "record_id": ("WARC-Record-ID", False), "payload_bytes": ("X-Payload-Length", True),
            "payload_digest": ("WARC-Payload-Digest", False), "refers_to": ("X-Refers-To-Page", True)}


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(row: dict) -> bytes:
    """An uncompressed WARC/1.1 record; a revisit has the HTTP header but no payload."""
    payload = row["payload"] or b""
    digest = row["payload_digest"] or hashlib.sha256(payload).hexdigest()
    revisit = row["record_type"] == "revisit"
    block = _HTTP if revisit else _HTTP + payload
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", record_id(row["page_id"])), ("WARC-Date", DATE)]
    if row["page_id"] is not None:
        fields.append(("X-Page-Id", row["page_id"]))
    if row["url"] is not None:
        # a line end would break the header; percent-encoding keeps the rest as it is
        fields.append(("WARC-Target-URI", row["url"].replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", row["payload_bytes"])]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(row["refers_to"])), ("X-Refers-To-Page", row["refers_to"])]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose SL extra field holds the lengths of the whole member and of the data."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    total = 10 + 2 + 12 + len(body) + 8
    # 0 means unknown: the field has no room for more
    extra = b"SL" + struct.pack("<HII", 8, total if total < 1 << 32 else 0, len(data) if len(data) < 1 << 32 else 0)
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


def parse_head(head: bytes) -> tuple[dict, int, bool]:
    """Columns of a record header (without the payload), the length of its block, and whether this module wrote it."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("damaged WARC record: no header")
    values = {}
    for line in lines[1:]:
        k, sep, v = line.partition(":")
        if sep:
            values[k.strip().lower()] = v.strip(" \t")
    own = "x-payload-length" in values
    row = {}
    for column, (header, number) in _HEADERS.items():
        v = values.get(header.lower())
        row[column] = int(v) if number and v is not None else v
    if own and row["url"] is not None:
        row["url"] = row["url"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    elif row["url"] is not None:
        row["url"] = row["url"].strip("<>")  # as WARC/1.0 was understood by some
    digest = row["payload_digest"]
    row["payload_digest"] = digest.removeprefix("sha256:") if digest else "" if own else None
    try:
        return row, int(values["content-length"]), own
    except (KeyError, ValueError):
        raise ValueError("damaged WARC record: no length") from None


class _Window:
    """Bytes of a seekable file by position, read in blocks."""

    def __init__(self, raw, block: int = 1 << 20):
        self.raw, self.block, self.lo, self.data = raw, block, 0, b""

    def at(self, pos: int, n: int) -> bytes:
        """The ``n`` bytes from ``pos``; fewer at the end of the file only."""
        if pos < self.lo or pos + n > self.lo + len(self.data):
            self.raw.seek(pos)
            self.lo, self.data = pos, self.raw.read(max(n, self.block))
        return self.data[pos - self.lo:pos - self.lo + n]


class _Plain:
    """The records' bytes of a plain file: ``buf`` is what has been read and not used."""

    PIECE = 1 << 16

    def __init__(self, window: _Window):
        self.window, self.pos, self.buf = window, 0, bytearray()

    def fill(self) -> bool:
        """More bytes in ``buf``; false at the end."""
        piece = self.window.at(self.pos, self.PIECE)
        self.pos += len(piece)
        self.buf += piece
        return bool(piece)

    def more(self) -> bool:
        """Whether another record follows; the empty lines before it are dropped."""
        while True:
            kept = self.buf.lstrip(b"\r\n")
            self.buf = bytearray(kept)
            if kept:
                return True
            if not self.fill():
                return False

    def head(self) -> bytes:
        at = 0
        while (end := self.buf.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(self.buf) - 3)
            if at > 1 << 22 or not self.fill():
                raise ValueError("damaged WARC record: header without end")
        out = bytes(self.buf[:end])
        del self.buf[:end + 4]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.buf) < n:
            if not self.fill():
                raise ValueError("damaged WARC record: cut short")
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out

    def skip(self, n: int) -> None:
        """Leave a block unread."""
        gone = min(n, len(self.buf))
        del self.buf[:gone]
        self.pos += n - gone

    def finish(self) -> None:
        """Called behind a block that was read."""


class _Gzip(_Plain):
    """The records' bytes of a file of gzip members."""

    def __init__(self, window: _Window):
        super().__init__(window)
        self.z, self.start, self.total, self.single = None, 0, 0, False

    def _open_member(self) -> bool:
        head = self.window.at(self.pos, 12)
        if not head.strip(b"\0"):
            return False
        if head[:2] != b"\x1f\x8b" or len(head) < 12:
            raise ValueError("damaged WARC record: no gzip member")
        self.z, self.start, self.total = zlib.decompressobj(31), self.pos, 0
        if head[3] & 4:
            extra = self.window.at(self.pos + 12, struct.unpack_from("<H", head, 10)[0])
            at = 0
            while at + 4 <= len(extra):
                n, = struct.unpack_from("<H", extra, at + 2)
                if extra[at:at + 2] == b"SL" and n == 8 and at + 12 <= len(extra):
                    self.total, = struct.unpack_from("<I", extra, at + 4)
                at += 4 + n
        return True

    def _step(self) -> bytes:
        """The next piece of the open member; ``z`` is none behind its end."""
        piece = self.window.at(self.pos, self.PIECE)
        if not piece:
            raise ValueError("damaged WARC record: cut short")
        try:
            out = self.z.decompress(piece, self.PIECE)
        except zlib.error as e:
            raise ValueError(f"damaged WARC record: {e}") from None
        self.pos += len(piece) - len(self.z.unused_data if self.z.eof else self.z.unconsumed_tail)
        if self.z.eof:
            self.z = None
        return out

    def fill(self) -> bool:
        while True:
            if self.z is None and not self._open_member():
                return False
            out = self._step()
            if out:
                self.buf += out
                return True

    def more(self) -> bool:
        self.single = not self.buf.strip(b"\r\n") and self.z is None  # the record begins its member
        return super().more()

    def skip(self, n: int) -> None:
        if self.single and self.total:
            # a member of known length holds one record: go to its end
            self.z, self.pos, self.buf = None, self.start + self.total, bytearray()
            return
        while n > 0:
            if not self.buf and not self.fill():
                raise ValueError("damaged WARC record: cut short")
            gone = min(n, len(self.buf))
            del self.buf[:gone]
            n -= gone

    def finish(self) -> None:
        if self.single and self.total:  # up to the checksum
            while self.z is not None:
                self.buf += self._step()


def records(raw, wanted, with_payload: bool) -> Iterator[dict]:
    """Records of a seekable file whose header passes ``wanted``; other payloads are not decoded.

    The payload is the body behind the HTTP header of a response, none of a revisit, and the whole block of other types.
    """
    window = _Window(raw)
    source = _Gzip(window) if window.at(0, 2) == b"\x1f\x8b" else _Plain(window)
    while source.more():
        row, length, own = parse_head(source.head())
        if not wanted(row):
            source.skip(length)
            continue
        row["payload"] = None
        if not with_payload or row["record_type"] == "revisit":
            source.skip(length)
        else:
            block = source.exactly(length)
            source.finish()
            if row["record_type"] == "response" and block[:5] == b"HTTP/":
                end = block.find(b"\r\n\r\n")
                block = block[end + 4:] if end >= 0 else b""
            row["payload"] = block
            if row["payload_bytes"] is None:
                row["payload_bytes"] = len(block)
        yield row


class _Done(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> _Done:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            names = batch.schema.names
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                member = gzip_member(make_record(dict(zip(names, values))))
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
        return _Done(files)

    def commit(self, messages: list) -> None:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        names = [f for m in messages if m is not None for f in m.files]
        with fs.open_output_stream(f"{root}/_files-{uuid.uuid4().hex}") as out:
            out.write("\n".join(names).encode())

    def abort(self, messages: list) -> None:
        """Unlisted files are never read; nothing is undone."""


_TESTS = {EqualTo: lambda a, b: a is not None and a == b, GreaterThan: lambda a, b: a is not None and a > b,
          GreaterThanOrEqual: lambda a, b: a is not None and a >= b, LessThan: lambda a, b: a is not None and a < b,
          LessThanOrEqual: lambda a, b: a is not None and a <= b, In: lambda a, b: a is not None and a in b,
          StringStartsWith: lambda a, b: a is not None and a.startswith(b)}


class WarcFile(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class WarcReader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool):
        self.path, self.with_payload, self.tests = path, with_payload, []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            # the size of a foreign payload is known only once it is read
            if column in _HEADERS and column != "payload_bytes" and isinstance(f, (IsNull, IsNotNull)):
                self.tests.append((column, type(f), None))
            elif column in _HEADERS and column != "payload_bytes" and type(f) in _TESTS:
                self.tests.append((column, type(f), f.value))
            else:
                yield f

    def partitions(self) -> list:
        """A partition per file: those of the writer's lists if the folder has any, else all archives below it."""
        from pyarrow.fs import FileSelector, FileType

        fs, root = open_fs(self.path)
        if fs.get_file_info(root).type == FileType.File:
            return [WarcFile(root)]
        found = sorted(fs.get_file_info(FileSelector(root, allow_not_found=True, recursive=True)), key=lambda i: i.path)
        lists = [i.path for i in found if i.base_name.startswith("_files-")]
        names: list[str] = []
        for path in lists:
            with fs.open_input_stream(path) as src:
                names += [f"{path.rsplit('/', 1)[0]}/{n}" for n in src.read().decode().split()]
        if not lists:
            names = [i.path for i in found if i.type == FileType.File and i.base_name.endswith((".warc", ".warc.gz"))]
            if not names:
                raise FileNotFoundError(f"no WARC archives in {self.path}")
        return [WarcFile(n) for n in names] or [WarcFile("")]

    def _wanted(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            v = row[column]
            if not ((v is None) if kind is IsNull else (v is not None) if kind is IsNotNull else _TESTS[kind](v, value)):
                return False
        return True

    def read(self, partition: WarcFile) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
                            ("payload", pa.binary())])
        if not partition.name:
            return
        fs, _ = open_fs(self.path)
        held, size = [], 0
        with fs.open_input_file(partition.name) as src:
            for row in records(src, self._wanted, self.with_payload):
                held.append(row)
                size += len(row["payload"] or b"") + 200
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)


class WarcSource(DataSource):
    """``spark.read.format("warc")``; option ``payload=false`` leaves payloads undecoded (null)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("WARC folders are appended to")
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def plan_records(pages: DataFrame, *, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Rows to archive (columns of the source).

    Digests and ids alone are grouped.  The table of repeated digests is broadcast if its counted size is in bounds; beyond
    it a Bloom filter of a fixed size picks the rows whose digest may repeat, and only those are shuffled with their payload.
    """
    text = F.coalesce(F.col("`html`").cast("string"), F.lit(""))
    rows = pages.select(F.col("`page_id`").cast("long").alias("page_id"), F.col("`url`").cast("string").alias("url"),
                        F.encode(text, "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    first = materialize(rows.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest")
                        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "revisits")
    n_first = first.count()
    if n_first * FIRST_BYTES <= BROADCAST_BYTES:
        x = rows.join(F.broadcast(first), "payload_digest", "left")
    else:
        marked = with_filter(rows, F.col("payload_digest"), first.select(F.col("payload_digest").alias("digest")), n_first)
        again = marked.where("again").drop("again").join(first, "payload_digest", "left")
        x = again.unionByName(marked.where("not again").drop("again").withColumn("first", F.lit(None).cast("long")))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return x.select("page_id", "url", F.when(again, "revisit").otherwise("response").alias("record_type"),
                    F.lit(None).cast("string").alias("record_id"), "payload_bytes", "payload_digest",
                    F.when(again, F.col("first")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"))


def archive(pages: DataFrame, folder: str | None = None, *, min_revisit: int = MIN_REVISIT) -> str:
    """Write a record per row of ``pages`` and return the folder.

    Of rows with equal payloads of at least ``min_revisit`` bytes, the smallest ``page_id`` is the response
    and other ids are revisits of it.  Null html is an empty payload; a null id is never first unless all
    are null (they are then responses); repeated rows of the first id are all responses.  An empty table
    writes an archive without records.  Other columns are ignored.
    """
    spark = pages.sparkSession
    register(spark)
    small_batches(spark)
    target = folder or new_folder(spark, "warc")
    plan_records(pages, min_revisit=min_revisit).write.format("warc").mode("append").save(target)
    return target


def read_archive(spark: SparkSession, folder: str, *, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Archive ``pages`` and read the archive back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Size and digest of a response are those of the payload read; a revisit's are in its header.
    """
    spark = pages.sparkSession
    folder = archive(pages, **options)
    own = read_archive(spark, folder).where("record_type = 'response'").select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        "record_type", "refers_to")
    other = read_archive(spark, folder, payload=False).where("record_type = 'revisit'").select(own.columns)
    return own.unionByName(other)
