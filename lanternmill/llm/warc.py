"""WARC archives as a Spark data source, format "warc", for reading and writing.

Writing: a task writes one .warc.gz, a gzip member a record, with an index of the members beside it; the commit lists
the files that count in a manifest of its own, _files-*.json, and readers take all of them, so folders can be added
to. Reading: the driver plans parts from the sizes of files and indexes alone; a task reads its part of the index and
decodes each record's head first and tests it against the pushed filters; only a record that passes is decoded in
full, and only if its payload is asked for. Archives of other writers (.warc or .warc.gz, no index) are read too, a
file a task.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from lanternmill.llm import scratch

FIELDS = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_SCHEMA = pa.schema({"record_id": pa.string(), "record_type": pa.string(), "target_uri": pa.string(), "refers_to": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary()})
#: Columns that a record's head settles; filters on them are pushed down.
_HEAD_COLUMNS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to"}
_MEMBER = struct.Struct("<QQ")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_CONTROL = {**{i: f"%{i:02X}" for i in range(0x21)}, 0x7F: "%7F"}


def record(record_id: str, record_type: str, payload: bytes, digest: str, target_uri: str | None = None, refers_to: str | None = None, date: str = _DATE) -> bytes:
    """One record, not compressed. A revisit has the HTTP head of the full payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if record_type == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if target_uri is not None:
        head.append(f"WARC-Target-URI: {target_uri.translate(_CONTROL)}")
    if record_type == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _parse(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


@dataclass
class Part(InputPartition):
    path: str
    members: tuple[int, int] | None  # first and one past the last in the index; None: the whole file, members unknown

    def __init__(self, path: str, members: tuple[int, int] | None):
        self.path, self.members = path, members


class _Unpacked:
    """A stream of the file's bytes after gzip, if it has any, for archives without an index."""

    def __init__(self, stream):
        self.stream, self.held, self.gzip = stream, b"", None

    def _more(self) -> bool:
        raw = self.stream.read(1 << 20)
        if self.gzip is None and raw:
            self.gzip = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else False
        if not raw:
            return False
        while raw:
            if self.gzip is False:
                self.held, raw = self.held + raw, b""
            else:
                self.held += self.gzip.decompress(raw)
                raw = self.gzip.unused_data if self.gzip.eof else b""
                if self.gzip.eof:
                    self.gzip = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                return None
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, n: int, keep: bool) -> bytes:
        parts, got = [], 0
        while got < n:
            if not self.held and not self._more():
                break
            piece, self.held = self.held[: n - got], self.held[n - got :]
            got += len(piece)
            if keep:
                parts.append(piece)
        return b"".join(parts)


def _manifests(names) -> list[str]:
    return sorted(n for n in names if n.startswith("_files-") and n.endswith(".json"))


def _names(fs, path: str) -> list[str]:
    with fs.open_input_stream(path, compression=None) as s:
        return json.loads(s.read())


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.part_bytes = int(options.get("partbytes", 32 << 20))
        self.payload = options.get("payload", "true") == "true"
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        self.filters = []
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in _HEAD_COLUMNS and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                value = None if isinstance(f, IsNotNull) else frozenset(f.value) if isinstance(f, In) else f.value
                self.filters.append((column, type(f).__name__, value))
            else:
                yield f

    def _wanted(self, row: dict) -> bool:
        for column, kind, value in self.filters:
            own = row[column]
            if own is None or kind == "EqualTo" and own != value or kind == "In" and own not in value or kind == "StringStartsWith" and not own.startswith(value):
                return False
        return True

    def partitions(self) -> list[Part]:
        fs, at = scratch.file_system(self.path)
        from pyarrow.fs import FileSelector

        found = {f.base_name: f.size for f in fs.get_file_info(FileSelector(at)) if f.is_file}
        if manifests := _manifests(found):
            names = sorted(n for m in manifests for n in _names(fs, f"{at}/{m}"))
        else:
            names = sorted(n for n in found if n.endswith((".warc", ".warc.gz")))
        parts: list[Part] = []
        for name in names:
            if f"{name}.idx" not in found:
                parts.append(Part(name, None))
                continue
            n = found[f"{name}.idx"] // _MEMBER.size
            step = max(1, -(-n // max(1, -(-found[name] // self.part_bytes))))
            parts += [Part(name, (first, min(n, first + step))) for first in range(0, n, step)]
        return parts

    def _row(self, head: dict[str, str]) -> dict:
        row = {column: head.get(name) for column, name in _HEAD_COLUMNS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c].strip("<>") if row[c] else row[c]
        digest = head.get("warc-payload-digest")
        return row | {"payload_digest": digest.removeprefix("sha1:") if digest else None, "payload_bytes": None, "payload": None}

    def _finish(self, row: dict, block: bytes, http: bool) -> dict:
        body = block
        if http:
            head, _, body = block.partition(b"\r\n\r\n")
            length = _parse(head).get("content-length")
            row["payload_bytes"] = int(length) if length and length.isdigit() else len(body)
        else:
            row["payload_bytes"] = len(body)
        if row["record_type"] != "revisit":
            row["payload_bytes"], own = len(body), sha1_base32(body)
            if row["payload_digest"] not in (None, own):
                raise ValueError(f"{row['record_id']}: the payload doesn't have the digest in its head")
            row["payload_digest"] = own
            if self.payload:
                row["payload"] = body
        return row

    def _rows(self, part: Part) -> Iterator[dict]:
        fs, at = scratch.file_system(self.path)
        if part.members is None:
            with fs.open_input_stream(f"{at}/{part.path}", compression=None) as stream:
                text = _Unpacked(stream)
                while (lines := text.until(b"\r\n\r\n")) is not None:
                    head = _parse(lines.lstrip(b"\r\n"))
                    row, n = self._row(head), int(head.get("content-length", 0))
                    wanted = self._wanted(row)
                    block = text.take(n, wanted)
                    text.take(4, False)
                    if wanted:
                        yield self._finish(row, block, "application/http" in head.get("content-type", ""))
            return
        with fs.open_input_file(f"{at}/{part.path}.idx") as stream:
            stream.seek(part.members[0] * _MEMBER.size)
            members = np.frombuffer(stream.read((part.members[1] - part.members[0]) * _MEMBER.size), "<u8").reshape(-1, 2)
        with fs.open_input_file(f"{at}/{part.path}") as stream:
            first = 0
            while first < len(members):  # neighbours in one read of about 4 MB
                start = int(members[first, 0])
                last = max(first, int(np.searchsorted(members[:, 0] + members[:, 1], start + (4 << 20), "right")) - 1)
                stream.seek(start)
                held = memoryview(stream.read(int(members[last].sum()) - start))
                for offset, length in members[first : last + 1].tolist():
                    member = held[offset - start : offset - start + length]
                    gz = zlib.decompressobj(31)
                    text = gz.decompress(member, 2048)
                    while (at_end := text.find(b"\r\n\r\n")) < 0:
                        more = gz.decompress(gz.unconsumed_tail, 4096)
                        if not more:
                            raise ValueError(f"{part.path}: no whole record at {offset}")
                        text += more
                    head = _parse(text[:at_end])
                    row = self._row(head)
                    if self._wanted(row):
                        text += gz.decompress(gz.unconsumed_tail) + gz.flush()
                        block = text[at_end + 4 : at_end + 4 + int(head["content-length"])]
                        yield self._finish(row, block, "application/http" in head.get("content-type", ""))
                first = last + 1

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in self._rows(partition) if partition is not None else ():  # Spark asks for one part even where there are none
            rows.append(row)
            size += len(row["payload"] or b"") + 200
            if size >= 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    """Takes record_id, record_type, target_uri, refers_to, payload (null: empty)."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.level, self.overwrite = options["path"].rstrip("/"), int(options.get("level", 1)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        fs, at = scratch.file_system(self.path)
        fs.create_dir(at, recursive=True)
        index, offset = [], 0
        with fs.open_output_stream(f"{at}/{name}", compression=None) as out:
            for batch in iterator:
                columns = [batch[c] for c in ("record_id", "record_type", "payload", "target_uri", "refers_to")]
                for record_id, kind, payload, uri, refers in zip(*columns):
                    gz, body = zlib.compressobj(self.level, zlib.DEFLATED, 31), payload.as_py() or b""
                    member = gz.compress(record(record_id.as_py(), kind.as_py(), body, sha1_base32(body), uri.as_py(), refers.as_py())) + gz.flush()
                    out.write(member)
                    index.append((offset, len(member)))
                    offset += len(member)
        if not index:
            fs.delete_file(f"{at}/{name}")
            return Written(None)
        with fs.open_output_stream(f"{at}/{name}.idx", compression=None) as out:
            out.write(np.array(index, "<u8").tobytes())
        return Written(name)

    def commit(self, messages: list) -> None:
        fs, at = scratch.file_system(self.path)
        fs.create_dir(at, recursive=True)
        from pyarrow.fs import FileSelector

        old = _manifests(f.base_name for f in fs.get_file_info(FileSelector(at)) if f.is_file) if self.overwrite else []
        with fs.open_output_stream(f"{at}/_files-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(sorted(m.name for m in messages if m is not None and m.name)).encode())
        for manifest in old:
            gone = _names(fs, f"{at}/{manifest}")
            for name in (manifest, *gone, *[f"{n}.idx" for n in gone]):
                fs.delete_file(f"{at}/{name}")

    def abort(self, messages: list) -> None:
        fs, at = scratch.file_system(self.path)
        for m in messages:
            if m is not None and m.name:
                for name in (m.name, f"{m.name}.idx"):
                    fs.delete_file(f"{at}/{name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """Writes a record per row of page_id, url, html to a folder, beside what is there; payloads are held against those
    of this call alone.

    Of rows with equal payloads of at least `min_bytes` bytes, the one with the largest page_id is a response and the
    others revisit it. A null html is an empty payload; a null url has no target; a null page_id is below all others,
    and rows that tie for the largest are all responses. Extra columns are not read; an empty table adds nothing. The
    table of repeated digests is saved first, so that Spark broadcasts it where its size allows; beyond that, rows are
    shuffled by digest for the join.
    """
    register(pages.sparkSession)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload")))
    counted = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    repeated = scratch.saved(counted.where("n > 1 and last is not null").select("sha1", "last"), "repeated")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    first = F.col("last").isNull() | F.col("page_id").eqNullSafe(F.col("last"))
    records = rows.join(repeated, "sha1", "left").select(
        urn("page_id").alias("record_id"),
        F.when(first, "response").otherwise("revisit").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(~first, urn("last")).alias("refers_to"),
        "payload",
    )
    records.write.format("warc").mode("append").save(folder)


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records that archive() wrote."""
    page = lambda c: F.try_to_number(F.nullif(F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1), F.lit("")), F.lit("S9999999999999999999")).cast("long")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.new_path(spark, "warc")
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    # each filter is pushed down: of the records that another read wants, only the heads are decoded
    parts = [read_warc(spark, folder, payload=False).where(F.col("record_type") == kind) for kind in ("response", "revisit")]
    return pages_of(parts[0].unionByName(parts[1]))


SQL = """
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, upper(sha1(html)) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p),
b AS (SELECT *, array_to_string(list_transform(range(40), lambda i: lpad(bin(instr('0123456789ABCDEF', hex[i + 1]) - 1), 4, '0')), '') AS bits FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: CAST(bits[5 * k + j + 1] AS INTEGER) * (16 >> j)))::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to FROM b
"""
