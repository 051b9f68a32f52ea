"""WARC archives as a Spark data source in Python: ``format("warc")`` writes and reads them.

Writing: a task writes files of its own, each record a gzip member (a *response* with its payload, or a
*revisit* without, naming the record that holds an equal payload). Every member carries its compressed length
in an extra field of the gzip header, which other readers ignore. A file counts once the commit lists it in a
manifest, so repeated or lost tasks leave nothing behind that a reader would see.

Reading: ``partitions`` plans from the manifests' sizes and split offsets (or from a listing, a file each, for
archives made elsewhere), cutting large files at records and putting small ones together. Comparisons of any
column but the payload are pushed down and evaluated on a record's headers, of which only the first bytes are
inflated. The payload of a record that fails them, or that nobody selected, is never inflated: its member is
skipped by the length in the extra field (a plain file by Content-Length; a foreign member without the field
has to be inflated, but is thrown away). Payloads that are read are checked against their digest.

Columns: record_type, record_id, target_uri, date, refers_to, payload_digest (bare base32 SHA-1),
payload_bytes (of the full payload, for revisits as the archived HTTP header tells), key and refers_key (row
keys in extension fields), headers (map), payload (binary), file, offset. Files lie in any store that Arrow's
file systems reach by URI.

Defined results: a null payload is an empty one; a null url leaves Target-URI out; characters no URI or header
may hold are percent-encoded; of equal payloads of at least ``least_bytes`` bytes the largest key is the response and
named keys go before null; rows that repeat this key and payload are responses all, as are all rows of a group without
keys; an empty table gives an archive without responses, read back as no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path
from .common import table

FORMAT = "warc"
COLUMNS = {
    "record_type": "string", "record_id": "string", "target_uri": "string", "date": "string", "refers_to": "string",
    "payload_digest": "string", "payload_bytes": "bigint", "key": "string", "refers_key": "string",
    "headers": "map<string,string>", "payload": "binary", "file": "string", "offset": "bigint",
}
SPLIT, MARK, HEAD, READ, BATCH = 64 << 20, 4 << 20, 2048, 1 << 20, 4 << 20
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.large_binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
# Fixed values of the format: field names, the profile of revisits, the extra field of skip lengths.
_FIELDS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
           "refers_to": "warc-refers-to", "key": "x-row-key", "refers_key": "x-refers-to-key"}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LENGTHS = b"sl"
_URI = "".join(map(chr, range(33, 127)))


def _store(path: str):
    return arrow_fs.FileSystem.from_uri(path)


# --- records ------------------------------------------------------------------

def _id(key: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest}/{key}')}>"


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{name}: {value}\r\n" for name, value in fields if value is not None]
    return "".join(["WARC/1.1\r\n", *lines, f"Content-Length: {len(block)}\r\n\r\n"]).encode() + block + b"\r\n\r\n"


def page_record(key: str | None, refers_key: str | None, revisit: bool, uri: str | None, payload: bytes, digest: str,
                size: int, date: str) -> bytes:
    """A response or revisit; ``digest`` (base32) and ``size`` are the full payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _id(key, digest)), ("WARC-Date", date),
              ("WARC-Target-URI", uri if uri is None else quote(uri, safe=_URI)), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Content-Type", "application/http; msgtype=response"), ("X-Row-Key", key if key is None else quote(key, safe=""))]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _id(refers_key, digest)),
                   ("X-Refers-To-Key", refers_key if refers_key is None else quote(refers_key, safe=""))]
    return _record(fields, head if revisit else head + payload)


def member(record: bytes, level: int) -> bytes:
    """``record`` as one gzip member whose extra field holds the lengths of its deflated and plain bytes."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(record) + deflate.flush()
    extra = _LENGTHS + struct.pack("<HII", 8, len(body), len(record) & 0xFFFFFFFF)
    head = struct.pack("<BBBBIBBH", 0x1F, 0x8B, 8, 4, 0, 0, 255, len(extra))
    return head + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _parsed(head: bytes) -> dict[str, str]:
    """Fields of a header block by lower-case name; a line that begins with white space goes on with the last."""
    out, last = {}, ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()
    return out


class _File:
    """Random reads of one file through one buffer."""

    def __init__(self, store, path: str):
        self.handle, self.start, self.data = store.open_input_file(path), 0, b""
        self.size = self.handle.size()

    def at(self, offset: int, length: int) -> bytes:
        """Up to ``length`` bytes from ``offset``; fewer at the end of the file."""
        low = offset - self.start
        if low < 0 or low + length > len(self.data):
            self.handle.seek(offset)
            self.start, self.data, low = offset, self.handle.read(max(length, READ)), 0
        return self.data[low:low + length]


@dataclass
class _Place:
    """Where a record lies, how to get its first bytes, all of them, and the place of the next."""
    offset: int
    first: Callable[[int], bytes]
    whole: Callable[[], bytes]
    next: Callable[[dict, int], int]


def _skippable(file: _File, offset: int, start: int, length: int) -> _Place:
    def first(size: int) -> bytes:
        return zlib.decompressobj(-zlib.MAX_WBITS).decompress(file.at(start, min(length, size)), size)

    def whole() -> bytes:
        data = zlib.decompress(file.at(start, length), -zlib.MAX_WBITS)
        if zlib.crc32(data) != struct.unpack("<I", file.at(start + length, 4))[0]:
            raise ValueError(f"checksum of the member at {offset} differs")
        return data

    return _Place(offset, first, whole, lambda fields, head: start + length + 8)


def _inflated(file: _File, offset: int) -> _Place:
    """A member without lengths, inflated once."""
    inflate, parts, at = zlib.decompressobj(zlib.MAX_WBITS | 16), [], offset
    while not inflate.eof and at < file.size:
        chunk = file.at(at, READ)
        parts.append(inflate.decompress(chunk))
        at += len(chunk)
    data = b"".join(parts)
    return _Place(offset, lambda size: data[:size], lambda: data, lambda fields, head: at - len(inflate.unused_data))


def _plain(file: _File, offset: int) -> _Place:
    held: dict[str, int] = {}

    def after(fields: dict, head: int) -> int:
        held["size"] = head + int(fields.get("content-length", 0)) + 4
        return offset + held["size"]

    return _Place(offset, lambda size: file.at(offset, size), lambda: file.at(offset, held["size"]), after)


def _place(file: _File, offset: int) -> _Place:
    head = file.at(offset, 24)
    if head[:2] != b"\x1f\x8b":
        return _plain(file, offset)
    if len(head) == 24 and head[3] == 4 and head[10:16] == struct.pack("<H", 12) + _LENGTHS + struct.pack("<H", 8):
        return _skippable(file, offset, offset + 24, struct.unpack("<I", head[16:20])[0])
    return _inflated(file, offset)


def _heads(place: _Place) -> tuple[dict, int, dict, int]:
    """Fields of the record and of the HTTP message in it (or none), and where either header ends."""
    size, seen = HEAD, -1
    while True:
        data = place.first(size)
        end = data.find(b"\r\n\r\n") + 4
        if end > 3:
            fields = _parsed(data[:end])
            last = end + int(fields.get("content-length", 0))
            if not fields.get("content-type", "").lower().startswith("application/http"):
                return fields, end, {}, end
            inner = data.find(b"\r\n\r\n", end, last) + 4
            if inner > 3:
                return fields, end, _parsed(data[end:inner]), inner
            if len(data) >= last:
                return fields, end, {}, end
        if len(data) == seen:
            raise ValueError(f"no record at {place.offset}")
        size, seen = size * 4, len(data)


def records(file: _File, start: int, end: int, wanted: Callable[[dict], bool], with_payload: bool, verify: bool) -> Iterator[dict]:
    """The records that begin in a range of a file and are ``wanted`` by their headers."""
    at = start
    while at < min(end, file.size):
        place = _place(file, at)
        fields, head, http, inner = _heads(place)
        following = place.next(fields, head)
        digest = fields.get("warc-payload-digest", "")
        row = {name: fields.get(field) for name, field in _FIELDS.items()}
        row |= {k: unquote(row[k]) for k in ("key", "refers_key") if row[k] is not None}
        size = head + int(fields.get("content-length", 0)) - inner
        if row["record_type"] == "revisit":
            size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
        row |= {"payload_digest": digest.split(":", 1)[1] if ":" in digest else None, "payload_bytes": size, "headers": fields, "offset": at}
        if wanted(row):
            if with_payload:
                row["payload"] = None
                if row["record_type"] != "revisit":
                    row["payload"] = place.whole()[inner:inner + size]
                    if verify and digest.lower().startswith("sha1:") and _base32(row["payload"]) != digest[5:]:
                        raise ValueError(f"payload of the record at {at} does not have its digest")
            yield row
        at = following


def _base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- predicates ---------------------------------------------------------------

def _predicate(f: ds.Filter) -> Callable[[dict], bool] | None:
    """``f`` on a record's columns, None if it can't be judged by headers. A comparison with null doesn't hold."""
    if isinstance(f, ds.Not):
        inner = f.child
        if isinstance(inner, ds.EqualTo) and (base := _predicate(inner)):
            name = inner.attribute[0]
            return lambda row: row[name] is not None and not base(row)
        if isinstance(inner, (ds.IsNull, ds.IsNotNull)) and (base := _predicate(inner)):
            return lambda row: not base(row)
        return None
    name = getattr(f, "attribute", ("",))[0]
    if len(getattr(f, "attribute", ())) != 1 or name not in COLUMNS or name in ("payload", "headers", "file"):
        return None
    tests: dict[type, Callable] = {
        ds.IsNull: lambda v: v is None, ds.IsNotNull: lambda v: v is not None,
        ds.EqualNullSafe: lambda v: v == f.value, ds.EqualTo: lambda v: v is not None and v == f.value,
        ds.In: lambda v: v is not None and v in f.value,
        ds.StringStartsWith: lambda v: v is not None and v.startswith(f.value),
        ds.StringEndsWith: lambda v: v is not None and v.endswith(f.value),
        ds.StringContains: lambda v: v is not None and f.value in v}
    if COLUMNS[name] == "bigint":
        tests |= {ds.GreaterThan: lambda v: v is not None and v > f.value, ds.GreaterThanOrEqual: lambda v: v is not None and v >= f.value,
                  ds.LessThan: lambda v: v is not None and v < f.value, ds.LessThanOrEqual: lambda v: v is not None and v <= f.value}
    test = tests.get(type(f))
    return None if test is None else lambda row: test(row[name])


# --- data source --------------------------------------------------------------

class WarcReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        wrong = [f.name for f in schema.fields if COLUMNS.get(f.name) != f.dataType.simpleString()]
        if wrong:
            raise ValueError(f"columns {wrong} are not those of an archive: {COLUMNS}")
        self.path, self.verify = options["path"], options.get("verify", "true") == "true"
        self.tasks = int(options.get("tasks", "1"))
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if _predicate(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[ds.InputPartition]:
        ranges = [(name, low, high) for name, size, marks in listed(self.path) for low, high in zip([0, *marks], [*marks, size])]
        goal = min(SPLIT, max(MARK // 4, sum(high - low for _, low, high in ranges) // self.tasks))
        plan: list[list[tuple[str, int, int]]] = []
        room = 0
        for name, low, high in ranges:
            if room < high - low:
                plan.append([])
                room = goal
            room -= high - low
            if plan[-1] and plan[-1][-1][0] == name and plan[-1][-1][2] == low:
                plan[-1][-1] = (name, plan[-1][-1][1], high)
            else:
                plan[-1].append((name, low, high))
        return [ds.InputPartition(p) for p in plan] or [ds.InputPartition([])]

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        tests = [_predicate(f) for f in self.filters]
        schema = pa.schema([(n, _ARROW[COLUMNS[n]]) for n in self.names])
        store, root = _store(self.path)
        held: list[dict] = []
        weight = 0
        for name, low, high in partition.value:
            file = _File(store, posixpath.join(root, name))
            for row in records(file, low, high, lambda r: all(t(r) for t in tests), "payload" in self.names, self.verify):
                held.append(row | {"file": name, "headers": list(row["headers"].items())})
                weight += 256 + len(row.get("payload") or b"")
                if weight > BATCH:
                    yield _batch(held, schema)
                    held, weight = [], 0
        if held:
            yield _batch(held, schema)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def listed(path: str) -> Iterator[tuple[str, int, list[int]]]:
    """(file, size, split offsets) of an archive: by its manifests, or all .warc and .warc.gz files below a folder without."""
    store, root = _store(path)
    found = store.get_file_info(arrow_fs.FileSelector(root, recursive=True))
    manifests = sorted(f.path for f in found if posixpath.basename(f.path).startswith("_manifest-"))
    for manifest in manifests:
        with store.open_input_file(manifest) as f:
            yield from map(tuple, json.loads(f.read()))
    if not manifests:
        for f in sorted(found, key=lambda f: f.path):
            if f.is_file and f.path.endswith((".warc", ".warc.gz")):
                yield posixpath.relpath(f.path, root), f.size, []


@dataclass
class _Written(ds.WriterCommitMessage):
    files: list


class WarcWriter(ds.DataSourceArrowWriter):
    """Rows: key, refers_key, revisit, target_uri, payload, sha1 (hex, of the full payload), payload_bytes."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.level, self.date = int(options.get("level", "6")), options.get("date", "1970-01-01T00:00:00Z")
        self.limit = int(options.get("file_bytes", str(1 << 30)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        files: list[list] = []
        out, size, marks = None, 0, []

        def close():
            if out is not None:
                out.close()
                files.append([name, size, marks])

        info = member(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _id(None, "warcinfo")), ("WARC-Date", self.date),
                               ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), self.level)
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self.limit:
                    close()
                    name, size, marks = f"part-{uuid.uuid4().hex}.warc.gz", len(info), []
                    out = store.open_output_stream(posixpath.join(root, name), compression=None)
                    out.write(info)
                if size - (marks[-1] if marks else 0) >= MARK:
                    marks.append(size)
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                data = member(page_record(row["key"], row["refers_key"], row["revisit"], row["target_uri"], row["payload"] or b"",
                                          digest, row["payload_bytes"], self.date), self.level)
                out.write(data)
                size += len(data)
        close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        old = [f.path for f in store.get_file_info(arrow_fs.FileSelector(root)) if f.is_file] if self.overwrite else []
        made = [f for m in messages if m for f in m.files]
        with store.open_output_stream(posixpath.join(root, f"_manifest-{uuid.uuid4().hex}.json"), compression=None) as out:
            out.write(json.dumps(made).encode())
        for path in old:
            if posixpath.basename(path) not in {f[0] for f in made}:
                store.delete_file(path)

    def abort(self, messages: list[_Written | None]) -> None:
        store, root = _store(self.path)
        for name, _, _ in [f for m in messages if m for f in m.files]:
            store.delete_file(posixpath.join(root, name))


class WarcSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ", ".join(f"{n} {t}" for n, t in COLUMNS.items())

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None, verify: bool = True) -> DataFrame:
    """The records of an archive; without ``payload`` among the columns no payload is inflated."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    schema = ", ".join(f"{n} {COLUMNS[n]}" for n in columns or COLUMNS)
    return (spark.read.format(FORMAT).schema(schema).option("verify", str(verify).lower())
            .option("tasks", spark.sparkContext.defaultParallelism).load(path))


def write_warc(pages: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               least_bytes: int = 0, **options: str) -> None:
    """One record per row. Of equal payloads of at least ``least_bytes`` bytes one is stored, the others revisit it."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{key_col}`").alias("key"), F.col(f"`{url_col}`").cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha256": F.sha2("payload", 256)})
    groups = (rows.where(F.col("payload_bytes") >= least_bytes).groupBy("sha256", "payload_bytes")
              .agg(F.max("key").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha256", "payload_bytes", "keep", F.lit(True).alias("many")))
    revisit = F.col("many").isNotNull() & ~F.col("key").eqNullSafe(F.col("keep"))
    out = rows.join(groups, ["sha256", "payload_bytes"], "left").select(
        F.col("key").cast("string").alias("key"), F.when(revisit, F.col("keep").cast("string")).alias("refers_key"), revisit.alias("revisit"),
        "target_uri", F.when(~revisit, F.col("payload")).alias("payload"), F.sha1("payload").alias("sha1"), "payload_bytes")
    out.write.format(FORMAT).mode("append").options(**options).save(path)


def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Archives in the shared folder, read back: payloads of responses, headers alone of revisits."""
    pages = table(spark, folder, "pages")
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    kind = dict(pages.dtypes)["page_id"]
    names = ["record_type", "payload_digest", "payload_bytes", "key", "refers_key"]

    def rows(records: DataFrame, size) -> DataFrame:
        return records.select(F.col("key").cast(kind).alias("page_id"), size.cast("long").alias("payload_bytes"), "payload_digest",
                              "record_type", F.col("refers_key").cast(kind).alias("refers_to"))

    full = read_warc(spark, path, [*names, "payload"]).where("record_type = 'response'")
    short = read_warc(spark, path, names).where("record_type = 'revisit'")
    return rows(full, F.octet_length("payload")).unionByName(rows(short, F.col("payload_bytes")))


OP12_SQL = """
with p as (select page_id, coalesce(html, '') as html, max(page_id) over (partition by coalesce(html, '')) as keep from pages)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((('0x' || substr(sha1(html), 5 * i + 1, 5))::int >> (15 - 5 * j)) & 31 as bigint) + 1, 1)), '')), '')
    as payload_digest,
  case when page_id is not distinct from keep then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from keep then keep end as refers_to
from p"""
