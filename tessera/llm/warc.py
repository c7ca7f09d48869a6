"""WARC archives as a PySpark data source (``spark.read.format("warc")``).

Reading.  The driver lists the files and plans partitions of about
``partitionBytes``: whole files, small ones together.  A task walks a file's
records and parses headers first.  The record type and the header predicates
(``types``, ``header.<name>``, ``prefix.<name>``, and Spark's own filters where
``spark.sql.python.filterPushdown.enabled`` is set) are judged on the headers,
and the payload of a record that is not wanted, or is not in the schema that
was asked for, is never inflated or copied: an uncompressed file is read past it,
and a compressed record tells its length in front (the "sl" extra field of a
gzip member), so that only its first bytes are inflated.  Foreign archives
without that field are inflated as a stream.

Writing.  A task writes files of about ``fileBytes`` with names of its own, one gzip
member per record; the driver then writes one manifest that names the files of
the tasks that ended well.  A folder with manifests is read by them, so that files of
lost, repeated or unfinished tasks are never seen; one without (a foreign folder)
is read whole.

Files are reached through ``pyarrow.fs`` by their URI, so any shared store that it
knows will do.

Defined cases: a null payload is an empty one, null columns give no header;
line ends in header values are written as ``%0D`` and ``%0A``; a record cut off in
the middle is an error that names file and offset.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import uuid
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition,
                                    IsNotNull, StringStartsWith, WriterCommitMessage)

from tessera.llm.shared import let

SCHEMA = ("record_id string, record_type string, target_uri string, record_date string, refers_to string, "
          "payload_digest string, payload_bytes long, headers map<string,string>, payload binary, file string, offset long")
#: Columns that are a header's value (fixed names of the format; the last is an extension field).
HEADER = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "record_date": "WARC-Date",
          "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
SKIP = b"sl"
FIRST = 4096             # bytes of a member that are inflated for its headers
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2048


def _open(uri: str):
    """``(file system, path)`` of a URI as Spark writes it."""
    from pyarrow import fs
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


# --- records ---------------------------------------------------------------
def _header_block(fields: dict) -> bytes:
    lines = ["WARC/1.1"]
    lines += [f"{k}: {str(v).replace(chr(13), '%0D').replace(chr(10), '%0A')}" for k, v in fields.items() if v is not None]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record_bytes(row: dict) -> bytes:
    """One record: headers, an HTTP head, the payload (none of a revisit)."""
    payload = row.get("payload") or b""
    kind = row.get("record_type") or "response"
    length = row.get("payload_bytes")
    length = len(payload) if length is None else length
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n").encode()
    block = head if kind == "revisit" else head + payload
    fields = {HEADER[c]: row.get(c) for c in ("record_id", "record_type", "target_uri", "record_date", "refers_to", "payload_digest")}
    fields["WARC-Type"] = kind
    fields["WARC-Record-ID"] = row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>"
    fields["WARC-Date"] = row.get("record_date") or EPOCH
    fields["WARC-Profile"] = PROFILE if kind == "revisit" else None
    fields["X-Payload-Length"] = length
    fields["Content-Type"] = "application/http; msgtype=response"
    fields["Content-Length"] = len(block)
    return _header_block(fields) + block + b"\r\n\r\n"


def member(record: bytes, level: int) -> bytes:
    """The record as one gzip member that tells its packed and unpacked length in front."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 12 + 12 + len(body) + 8
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + SKIP + struct.pack("<HII", 8, size, len(record) & 0xFFFFFFFF)
            + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF))


def _fields(head: bytes) -> dict:
    lines = head.decode("utf-8", "replace").split("\r\n")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _payload(block: bytes, fields: dict) -> bytes:
    if fields.get("content-type", "").startswith("application/http"):
        end = block.find(b"\r\n\r\n")
        return block[end + 4:] if end >= 0 else b""
    return block


class Damaged(ValueError):
    """A record that is cut off or has no valid headers."""


class _Stream:
    """Records of plain or inflated bytes: ``(offset, fields, block or None)``."""

    def __init__(self, file, seekable: bool, name: str):
        self.file, self.seekable, self.name, self.at = file, seekable, name, 0

    def _read(self, n: int) -> bytes:
        data = self.file.read(n)
        self.at += len(data)
        if len(data) < n:
            raise Damaged(f"{self.name}: a record ends early at {self.at}")
        return data

    def records(self, wanted):
        while True:
            start, line = self.at, self.file.readline()
            self.at += len(line)
            if not line:
                return
            if line in (b"\r\n", b"\n"):
                continue
            if not line.startswith(b"WARC/"):
                raise Damaged(f"{self.name}: no record at {start}")
            head = [line]
            while head[-1] not in (b"\r\n", b"\n"):
                head.append(self.file.readline())
                self.at += len(head[-1])
                if not head[-1]:
                    raise Damaged(f"{self.name}: headers end early at {self.at}")
            fields = _fields(b"".join(head).replace(b"\r\n", b"\n").replace(b"\n", b"\r\n"))
            try:
                n = int(fields["content-length"])
            except (KeyError, ValueError):
                raise Damaged(f"{self.name}: no length at {start}") from None
            keep, body = wanted(fields)
            block = None
            if keep and body:
                block = self._read(n)
            elif self.seekable:
                self.file.seek(n, 1)
                self.at += n
            else:
                left = n
                while left:
                    left -= len(self._read(min(left, 1 << 20)))
            if keep:
                yield start, fields, block


def _members(file, name: str, wanted):
    """Records of members that tell their length; other members as a stream."""
    at = 0
    while True:
        file.seek(at)
        start = file.read(24)
        if not start:
            return
        if start[:2] != b"\x1f\x8b":
            raise Damaged(f"{name}: no gzip member at {at}")
        if len(start) < 24 or not start[3] & 4 or start[12:14] != SKIP:
            file.seek(at)
            for offset, fields, block in _Stream(gzip.GzipFile(fileobj=file), False, name).records(wanted):
                yield at + offset, fields, block
            return
        size = struct.unpack("<I", start[16:20])[0]
        inflate, head, left = zlib.decompressobj(-15), b"", size - 24
        while b"\r\n\r\n" not in head:
            part = file.read(min(FIRST, left))
            left -= len(part)
            if not part:
                raise Damaged(f"{name}: headers end early at {at}")
            head += inflate.decompress(part, FIRST)
        cut = head.index(b"\r\n\r\n")
        fields = _fields(head[:cut])
        keep, body = wanted(fields)
        if keep:
            block = None
            if body:
                rest = file.read(left)
                if len(rest) < left:
                    raise Damaged(f"{name}: a record ends early at {at}")
                block = (head[cut + 4:] + inflate.decompress(inflate.unconsumed_tail + rest))[:int(fields["content-length"])]
            yield at, fields, block
        at += size


# --- reading ----------------------------------------------------------------
@dataclass
class Files(InputPartition):
    """One task's files with their sizes."""
    files: list


@dataclass
class Wanted:
    """What is judged on the headers alone."""
    equal: dict = field(default_factory=dict)       # header -> values
    starts: dict = field(default_factory=dict)      # header -> prefixes
    given: set = field(default_factory=set)         # headers that must be there
    body_types: set | None = None                   # types whose payload is read; None = all
    body: bool = True

    def __call__(self, fields: dict) -> tuple[bool, bool]:
        keep = (all(fields.get(k) in v for k, v in self.equal.items())
                and all((fields.get(k) or "").startswith(p) for k, some in self.starts.items() for p in some)
                and all(k in fields for k in self.given))
        return keep, self.body and (self.body_types is None or fields.get("warc-type") in self.body_types)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.options, self.schema = options, schema
        split = lambda v: {x.strip() for x in v.split(",") if x.strip()}
        self.wanted = Wanted(body="payload" in schema.fieldNames())
        if options.get("types"):
            self.wanted.equal["warc-type"] = split(options["types"])
        if options.get("payloadtypes") is not None:
            self.wanted.body_types = split(options["payloadtypes"])
        for key, value in options.items():
            kind, _, name = key.partition(".")
            if kind == "header":
                self.wanted.equal[name.lower()] = {value}
            elif kind == "prefix":
                self.wanted.starts.setdefault(name.lower(), []).append(value)

    def partitions(self) -> list:
        from pyarrow import fs as pfs
        system, path = _open(self.options["path"])
        info = system.get_file_info(path)
        if info.type == pfs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == pfs.FileType.File:
            found = [(path, info.size)]
        else:
            listed = {i.path: i.size for i in system.get_file_info(pfs.FileSelector(path, recursive=True)) if i.is_file}
            manifests = [p for p in listed if p.rsplit("/", 1)[-1].startswith("_manifest-")]
            if manifests:
                found = []
                for m in manifests:
                    with system.open_input_stream(m) as f:
                        found += [(f"{path.rstrip('/')}/{x['name']}", x["bytes"]) for x in json.loads(f.read())["files"]]
            else:
                found = [(p, n) for p, n in listed.items() if p.endswith((".warc", ".warc.gz"))]
        target, plan, room = int(self.options.get("partitionbytes", 64 << 20)), [], 0
        for path, n in sorted(found):
            if not plan or n > room:
                plan.append(Files([]))
                room = target
            plan[-1].files.append(path)
            room -= n
        return plan or [Files([])]

    def read(self, partition: Files):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        system, _ = _open(self.options["path"])
        names = self.schema.fieldNames()
        schema = to_arrow_schema(self.schema)
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for path in partition.files:
            with system.open_input_file(path) as raw:
                file = io.BufferedReader(raw, 1 << 18)
                name = path.rsplit("/", 1)[-1]
                if path.endswith(".gz"):
                    found = _members(file, name, self.wanted)
                else:
                    found = _Stream(file, True, name).records(self.wanted)
                for offset, fields, block in found:
                    rows.append(self._row(names, name, offset, fields, block))
                    held += len(block or b"") + 500
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    @staticmethod
    def _row(names, name, offset, fields, block):
        out = []
        for c in names:
            if c == "payload":
                out.append(None if block is None else _payload(block, fields))
            elif c == "headers":
                out.append(list(fields.items()))
            elif c == "file":
                out.append(name)
            elif c == "offset":
                out.append(offset)
            elif c == "payload_bytes":
                n = fields.get("x-payload-length")
                out.append(int(n) if n and n.isdigit() else None)
            elif c == "payload_digest":
                out.append((fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None)
            else:
                out.append(fields.get(HEADER[c].lower()))
        return out


class PushingReader(WarcReader):
    """Takes Spark's own filters over header columns; what it takes it settles itself."""

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in HEADER or column in ("payload_bytes", "payload_digest"):
                yield f
                continue
            header = HEADER[column].lower()
            if isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted.equal[header] = self.wanted.equal.get(header, values) & values
                self.wanted.given.add(header)
            elif isinstance(f, StringStartsWith):
                self.wanted.starts.setdefault(header, []).append(f.value)
                self.wanted.given.add(header)
            elif isinstance(f, IsNotNull):
                self.wanted.given.add(header)
            else:
                yield f


# --- writing ----------------------------------------------------------------
@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite, self.job = options, overwrite, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        system, path = _open(self.options["path"])
        system.create_dir(path, recursive=True)
        limit, level = int(self.options.get("filebytes", 128 << 20)), int(self.options.get("level", 3))
        task, files, out, size, records = uuid.uuid4().hex, [], None, 0, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                files.append({"name": f"part-{task}-{len(files):05d}.warc.gz", "bytes": size, "records": records})
                out = None

        for b in iterator:
            columns = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                data = member(record_bytes({n: c[i].as_py() for n, c in columns.items()}), level)
                if out is not None and size + len(data) > limit:
                    close()
                if out is None:  # members are packed already
                    out, size, records = system.open_output_stream(f"{path.rstrip('/')}/part-{task}-{len(files):05d}.warc.gz", compression=None), 0, 0
                out.write(data)
                size, records = size + len(data), records + 1
        close()
        return Written(files)

    def commit(self, messages) -> None:
        from pyarrow import fs as pfs
        system, path = _open(self.options["path"])
        system.create_dir(path, recursive=True)
        path = path.rstrip("/")
        old = [i.path for i in system.get_file_info(pfs.FileSelector(path)) if i.base_name.startswith("_manifest-")]
        name = f"{path}/_manifest-{self.job}.json"
        with system.open_output_stream(f"{path}/.{self.job}.tmp") as f:
            f.write(json.dumps({"files": [x for m in messages if m for x in m.files]}).encode())
        if self.overwrite:
            for m in old:
                with system.open_input_stream(m) as f:
                    gone = json.loads(f.read())["files"]
                system.delete_file(m)
                for x in gone:
                    system.delete_file(f"{path}/{x['name']}")
        system.move(f"{path}/.{self.job}.tmp", name)

    def abort(self, messages) -> None:
        system, path = _open(self.options["path"])
        for m in messages:
            for x in m.files if m else ():
                system.delete_file(f"{path.rstrip('/')}/{x['name']}")


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        kind = PushingReader if str(self.options.get("pushfilters", "")).lower() == "true" else WarcReader
        return kind({k.lower(): v for k, v in self.options.items()}, schema)

    def writer(self, schema, overwrite: bool):
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


# --- functions over DataFrames -----------------------------------------------
def read(spark: SparkSession, path: str, columns: list[str] | None = None, types: list[str] | None = None,
         payload_types: list[str] | None = None, headers: dict | None = None, prefixes: dict | None = None, **options) -> DataFrame:
    """Records of the archives under ``path``: only the ``columns`` asked for
    (payloads stay packed where ``payload`` is not among them, or the type is
    not among ``payload_types``), only records of ``types`` whose headers equal
    ``headers`` and start with ``prefixes``.  Filters of the result are pushed
    down too if the session allows it."""
    spark.dataSource.register(WarcSource)
    fields = [f for f in SCHEMA.split(", ") if columns is None or f.split()[0] in columns]
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("warc").schema(", ".join(fields)).option("pushfilters", push)
    if types is not None:
        reader = reader.option("types", ",".join(types))
    if payload_types is not None:
        reader = reader.option("payloadtypes", ",".join(payload_types))
    for kind, given in (("header", headers), ("prefix", prefixes)):
        for name, value in (given or {}).items():
            reader = reader.option(f"{kind}.{name}", value)
    return reader.options(**options).load(path)


def write(records: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Columns of ``SCHEMA`` by name (``record_type``, ``payload``, ...) as records."""
    records.sparkSession.dataSource.register(WarcSource)
    names = [c for c in (f.split()[0] for f in SCHEMA.split(", ")) if c in records.columns and c not in ("headers", "file", "offset")]
    records.select(*names).write.format("warc").options(**options).mode(mode).save(path)


def base32(digest: Column) -> Column:
    """A hex SHA-1 as 32 upper-case base-32 characters: 20 bits at a time."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def sha1_base32(payload: Column) -> Column:
    return let(F.sha1(payload), base32)


def record_name(row_id: Column, place: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(row_id.cast("string"), F.lit("")), F.lit(":"), place.cast("string"), F.lit(">"))


def named_id(record: Column) -> Column:
    """The id in a record's name; none if it has none."""
    return F.nullif(F.regexp_extract(record, r"^<urn:page:(.*):\d+>$", 1), F.lit(""))


def page_records(pages: DataFrame, row_id: str = "page_id", uri: str = "url", text: str = "html", min_bytes: int = 0) -> DataFrame:
    """Records of pages: of equal payloads of ``min_bytes`` or more the one of
    the smallest id is a response (null ids last; of rows equal in id, one), the others
    revisit it.  The first of a payload is found by a pre-aggregated minimum over ids,
    so a payload that a third of the pages share is one row by then."""
    payload = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(row_id).alias("row_id"), F.col(uri).cast("string").alias("target_uri"), payload.alias("payload"),
                        F.monotonically_increasing_id().alias("place"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    order = F.struct(F.col("row_id").isNull().alias("last"), "row_id", "place")
    first = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.min(order).alias("first"))
    joined = rows.join(first, "digest", "left")
    revisit = F.coalesce(F.col("first.place") != F.col("place"), F.lit(False))
    return joined.select(
        record_name(F.col("row_id"), F.col("place")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(revisit, record_name(F.col("first.row_id"), F.col("first.place"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), base32(F.col("digest"))).alias("payload_digest"), "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"))

