"""Web archives: a writer and a reader of WARC files as a Spark data source, and archives without repeated payloads.

``archive`` marks each page as ``response`` or, where an equal payload has a smaller page id, as ``revisit`` of that page,
and writes the records; ``read`` returns them. Files hold one gzip member per record. The extra field of its gzip header
(``sl``) carries the member's length, so a reader that has seen a record's headers steps over the rest without inflating
it. Members without that field and files without compression are read too.

The reader plans one partition for each group of files of up to ``split_bytes``; one file is never divided. Predicates on
the columns in ``HEADER`` are pushed down: they are decided on the headers alone, and the payload of a record that fails
them is neither inflated nor decoded. Only the columns of the requested schema are made, so a schema without ``payload``
leaves payloads packed as well, unless ``verify`` asks to compare each payload with its digest and length.

A task of the writer puts its records in files of its own; the commit names them in a manifest, and the reader reads only
named files. So a task that is run twice, or lost with its executor, leaves no records behind.

Results in edge cases: a null text is an empty payload; empty payloads are equal to each other. A null page id comes after
all others, and rows of one id with equal payloads are one response and revisits of that same id. Null and empty
addresses have no target header. Control characters and spaces of an address are written percent-encoded, so that no
address can end its header. An empty table makes an archive without records. Other columns of the table are left aside.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from chainspan.llm.common import with_python
from chainspan.session import new_folder, ship_package

FORMAT = "chainspan_warc"
#: Columns that the headers of a record decide.
HEADER = {
    "record_id": pa.string(), "record_type": pa.string(), "page_id": pa.int64(), "target_uri": pa.string(), "warc_date": pa.string(),
    "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "content_length": pa.int64(),
}
COLUMNS = {**HEADER, "payload": pa.binary(), "file": pa.string(), "position": pa.int64()}
SCHEMA = ", ".join(f"{c} {'binary' if t == pa.binary() else 'long' if t == pa.int64() else 'string'}" for c, t in COLUMNS.items())
WRITTEN = "record_type string, page_id long, target_uri string, payload binary, payload_bytes long, payload_sha1 string, refers_to long"

FILE_BYTES = SPLIT_BYTES = 128 << 20
#: Bytes asked for at once, and the rows and payload bytes of one batch.
READ_BYTES, BATCH_ROWS, BATCH_BYTES = 1 << 20, 2_048, 16 << 20
# Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP = b"\x1f\x8b\x08"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it. What Spark writes without a scheme lies in the local one."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def record_id(page_id: int | None) -> str:
    """The name of a page's record: the same in every archive."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'urn:page:{page_id}')}>"


def _safe(address: str) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in address)


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member that states its own length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    head = _GZIP + b"\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, whole & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row: dict, date: str) -> bytes:
    """One record, not compressed."""
    revisit = row["record_type"] == "revisit"
    payload = row["payload"] or b""
    size = row["payload_bytes"] if row["payload_bytes"] is not None else len(payload)
    sha1 = bytes.fromhex(row["payload_sha1"]) if row["payload_sha1"] else hashlib.sha1(payload).digest()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(row['page_id'])}", f"WARC-Date: {date}"]
    if row["target_uri"]:
        lines.append(f"WARC-Target-URI: {_safe(row['target_uri'])}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}")
    if row["page_id"] is not None:
        lines.append(f"X-Page-Id: {row['page_id']}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(row['refers_to'])}"]
        if row["refers_to"] is not None:
            lines.append(f"X-Refers-To-Page-Id: {row['refers_to']}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _warcinfo(name: str, date: str) -> bytes:
    block = b"software: chainspan\r\nformat: WARC File Format 1.1\r\n"
    ident = uuid.uuid5(uuid.NAMESPACE_URL, f"urn:file:{name}")
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{ident}>", f"WARC-Date: {date}", f"WARC-Filename: {name}",
             "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class _Bytes:
    """Random reads of one file. Whatever lies between two reads further apart than a read is never fetched."""

    def __init__(self, system: fs.FileSystem, path: str) -> None:
        self.file = system.open_input_file(path)
        self.size, self.start, self.held = self.file.size(), 0, b""

    def at(self, pos: int, n: int) -> bytes:
        n = max(0, min(n, self.size - pos))
        if pos < self.start or pos + n > self.start + len(self.held):
            self.start = pos
            self.held = self.file.read_at(min(max(n, READ_BYTES), self.size - pos), pos) if n else b""
        lo = pos - self.start
        return self.held[lo : lo + n]


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that begins with white space continues the one before it."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            out.setdefault(last, value.strip())
    return out


class _Gzip:
    """The record in the gzip member at ``pos``, inflated as far as asked for."""

    def __init__(self, data: _Bytes, pos: int) -> None:
        self.data, self.pos, self.out = data, pos, b""
        head = data.at(pos, 24)
        self.length = None
        if head[3] & 4 and head[12:14] == b"sl":
            self.length = struct.unpack("<I", head[16:20])[0]
        self.inflate, self.next = zlib.decompressobj(31), pos

    def _more(self, limit: int) -> bool:
        """Inflate up to ``limit`` more bytes; false at the member's end."""
        packed = self.inflate.unconsumed_tail
        if not packed:
            packed = self.data.at(self.next, 65_536)
            self.next += len(packed)
            if not packed and not self.inflate.eof:
                raise ValueError(f"the record at {self.pos} is cut off")
        self.out += self.inflate.decompress(packed, limit)
        return not self.inflate.eof

    def upto(self, n: int) -> bytes:
        while len(self.out) < n and not self.inflate.eof and self._more(n - len(self.out)):
            pass
        return self.out

    def find(self, mark: bytes, start: int) -> int:
        while (k := self.out.find(mark, start)) < 0:
            if self.inflate.eof or not self._more(2_048) and self.out.find(mark, start) < 0:
                return -1
        return k

    def end(self) -> int:
        if self.length:
            return self.pos + self.length
        while not self.inflate.eof:
            self._more(1 << 20)
            self.out = b""
        return self.next - len(self.inflate.unused_data)


class _Plain:
    """The record at ``pos`` of a file without compression."""

    def __init__(self, data: _Bytes, pos: int) -> None:
        self.data, self.pos, self.out, self.length = data, pos, b"", 0

    def upto(self, n: int) -> bytes:
        if len(self.out) < n:
            self.out += self.data.at(self.pos + len(self.out), n - len(self.out))
        return self.out

    def find(self, mark: bytes, start: int) -> int:
        while (k := self.out.find(mark, start)) < 0:
            before = len(self.out)
            if len(self.upto(before + 2_048)) == before:
                return -1
        return k

    def end(self) -> int:
        return self.pos + self.length


def _holds(value, op: str, wanted) -> bool:
    """A pushed predicate on a header value; comparisons with null are not true."""
    if op == "null":
        return value is None
    if op == "known":
        return value is not None
    if value is None:
        return False
    tests = {
        "=": lambda: value == wanted, "in": lambda: value in wanted, ">": lambda: value > wanted, ">=": lambda: value >= wanted,
        "<": lambda: value < wanted, "<=": lambda: value <= wanted, "starts": lambda: value.startswith(wanted),
        "ends": lambda: value.endswith(wanted), "contains": lambda: wanted in value,
    }
    return tests[op]()


_OPS = {
    EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", IsNull: "null",
    IsNotNull: "known", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "contains",
}


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and text.lstrip("-").isdigit() else None


def records_of(system: fs.FileSystem, path: str, wanted: list[str], tests: list[tuple], verify: bool, seen: dict | None = None) -> Iterator[dict]:
    """The records of one file that pass all tests, as dicts of the wanted columns. ``seen`` counts inflated payloads."""
    data, pos = _Bytes(system, path), 0
    while pos < data.size:
        packed = data.at(pos, 3) == _GZIP
        r = (_Gzip if packed else _Plain)(data, pos)
        top = r.find(b"\r\n\r\n", 0)
        if top < 0 or not r.out.startswith(b"WARC/"):
            raise ValueError(f"{path} holds no record at {pos}")
        named = _fields(r.out[:top])
        block, size = top + 4, int(named["content-length"])
        if not packed:
            r.length = block + size + 4
        kind = named.get("warc-type")
        row = {
            "record_id": named.get("warc-record-id"), "record_type": kind, "page_id": _number(named.get("x-page-id")),
            "target_uri": named.get("warc-target-uri"), "warc_date": named.get("warc-date"),
            "payload_digest": (named.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
            "refers_to": _number(named.get("x-refers-to-page-id")), "content_length": size, "payload_bytes": None,
            "file": path, "position": pos, "payload": None,
        }
        body = 0
        if named.get("content-type", "").startswith("application/http"):
            stop = r.find(b"\r\n\r\n", block)
            if 0 <= stop < block + size:
                body = stop + 4 - block
                row["payload_bytes"] = _number(_fields(r.out[block:stop]).get("content-length"))
        if row["payload_bytes"] is None and kind != "revisit":
            row["payload_bytes"] = size - body
        if all(_holds(row[c], op, v) for c, op, v in tests):
            if kind != "revisit" and (verify or "payload" in wanted):
                payload = r.upto(block + size)[block + body : block + size]
                if seen is not None:
                    seen["payloads"] = seen.get("payloads", 0) + 1
                if len(payload) != size - body:
                    raise ValueError(f"the record at {pos} of {path} is cut off")
                if verify and kind == "response":
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if (row["payload_digest"] or digest) != digest or row["payload_bytes"] != len(payload):
                        raise ValueError(f"the payload of the record at {pos} of {path} is not the one its headers describe")
                    row["payload_digest"] = digest
                row["payload"] = payload
            yield {c: row[c] for c in wanted}
        pos = r.end()


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class _Made(WriterCommitMessage):
    files: list[tuple[str, int, int]] = field(default_factory=list)


def _manifests(system: fs.FileSystem, root: str) -> list[str]:
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith("_manifest-"))


def _named(system: fs.FileSystem, manifest: str) -> list[tuple[str, int, int]]:
    with system.open_input_file(manifest) as f:
        return [tuple(x) for x in json.loads(f.read())]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options) -> None:
        self.columns = schema.fieldNames()
        unknown = set(self.columns) - set(COLUMNS)
        if unknown:
            raise ValueError(f"archives have no columns {sorted(unknown)}")
        self.path, self.verify = options["path"], options.get("verify", "false").lower() == "true"
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            op = _OPS.get(type(f))
            if op and len(f.attribute) == 1 and f.attribute[0] in HEADER:
                self.tests.append((f.attribute[0], op, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, root = _opened(self.path)
        made = _manifests(system, root)
        if made:
            files = [(f"{root}/{n}", size) for m in made for n, size, _ in _named(system, m)]
        else:
            info = system.get_file_info(root)
            found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
            files = sorted((f.path, f.size) for f in found if f.path.endswith((".warc", ".warc.gz")))
        out, held, size = [], [], 0
        for path, n in files:
            if held and size + n > self.split:
                out.append(Files(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, Files(held)] if held or not out else out

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        system = _opened(self.path)[0]
        schema = pa.schema([(c, COLUMNS[c]) for c in self.columns])
        rows: list[dict] = []
        size = 0
        for path in part.paths:
            for r in records_of(system, path, self.columns, self.tests, self.verify):
                rows.append(r)
                size += len(r.get("payload") or b"")
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.date = options.get("date", "2024-01-01T00:00:00Z")
        self.packed = options.get("compression", "gzip") == "gzip"
        self.level, self.most = int(options.get("level", 6)), int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Made:
        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        task, made, out, name, size, n = uuid.uuid4().hex, [], None, "", 0, 0
        squeeze = (lambda b: member(b, self.level)) if self.packed else (lambda b: b)

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                made.append((name, size, n))
                out = None

        for b in iterator:
            columns = {c: b.column(c).to_pylist() for c in b.schema.names}
            for i in range(b.num_rows):
                if out is None or size >= self.most:
                    close()
                    name, size, n = f"part-{task}-{len(made):05d}.warc" + (".gz" if self.packed else ""), 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    head = squeeze(_warcinfo(name, self.date))
                    out.write(head)
                    size += len(head)
                packed = squeeze(record({c: v[i] for c, v in columns.items()}, self.date))
                out.write(packed)
                size += len(packed)
                n += 1
        close()
        return _Made(made)

    def commit(self, messages: list[_Made | None]) -> None:
        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        earlier = _manifests(system, root) if self.overwrite else []
        with system.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())
        for m in earlier:
            gone = _named(system, m)
            system.delete_file(m)
            for n, _, _ in gone:
                system.delete_file(f"{root}/{n}")

    def abort(self, messages: list[_Made | None]) -> None:
        system, root = _opened(self.path)
        for m in messages:
            for n, _, _ in m.files if m else []:
                system.delete_file(f"{root}/{n}")


class WarcSource(DataSource):
    """``spark.read.format("chainspan_warc")``, and ``df.write`` of the columns in ``WRITTEN``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """Make the source known to the session and let Spark hand it predicates."""
    ship_package(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def marked(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The records to write, in the columns of ``WRITTEN``.

    Which page a payload first belongs to is found from ids and hashes. The texts are dealt out once, by id and hash,
    together with the few rows that name an earlier page, so a payload that many pages share is spread by their ids.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    digest = F.sha2("payload", 256)
    long_enough = F.octet_length("payload") >= min_bytes
    keys = rows.filter(long_enough).select("page_id", digest.alias("digest")).groupBy("digest", "page_id").agg(F.lit(1).alias("one"))
    owners = keys.groupBy("digest").agg(F.min("page_id").alias("owner"), F.count(F.lit(1)).alias("ids")).filter("ids > 1")
    later = keys.join(owners, "digest").filter(F.col("page_id").isNull() | (F.col("page_id") > F.col("owner")))
    nothing = F.lit(None)
    told = later.select("page_id", nothing.cast("string").alias("url"), nothing.cast("binary").alias("payload"), "digest", "owner", F.lit(0).alias("kind"))
    given = rows.select("page_id", "url", "payload", digest.alias("digest"), nothing.cast("long").alias("owner"), F.lit(1).alias("kind"))
    here = W.partitionBy("page_id", "digest").orderBy("kind", "url")
    seen = told.unionByName(given).withColumns({"place": F.row_number().over(here), "first": F.first("owner").over(here), "told": F.first("kind").over(here) == 0})
    revisit = long_enough & (F.col("place") > 1)
    return seen.filter("kind = 1").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "page_id",
        F.col("url").alias("target_uri"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_sha1"),
        F.when(revisit, F.when(F.col("told"), F.col("first")).otherwise(F.col("page_id"))).alias("refers_to"),
    )


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, **options: str) -> str:
    """Write one record for each row of (page_id, url, html) and return the folder of the files.

    Payloads of at least ``min_bytes`` bytes that are equal are kept once.
    """
    spark = registered(pages.sparkSession)
    folder = folder or new_folder(spark, "warc")
    marked(pages, min_bytes).write.format(FORMAT).options(**options).mode("append").save(folder)
    return folder


def read(spark: SparkSession, folder: str, columns: str = SCHEMA, verify: bool = False) -> DataFrame:
    """The records of the archives in a folder, in the named columns."""
    reader = registered(spark).read.format(FORMAT).schema(columns).option("verify", str(verify).lower())
    return with_python(reader.load(folder))


def catalogued(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page, read back from its archive.

    Payloads of responses are unpacked and compared with their headers; revisits have headers alone.
    """
    folder = archive(pages, min_bytes=min_bytes)
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return read(pages.sparkSession, folder, columns, verify=True).filter(F.col("record_type").isin("response", "revisit"))
