"""Token-id files: one zstandard frame a document, all with one shared trained dictionary.

A shard: magic, version, id width, SHA-256 of the dictionary; then a frame a document; then an index (doc_id, frame
offset, frame length, tokens) and its place in the last 24 bytes. A document is read with two small reads, of the
index and of its own frame, and a reader with another dictionary refuses the shard.
"""

from __future__ import annotations

import hashlib
import io
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternmill.llm import scratch
from lanternmill.llm.tokens import default_path, encoder

MAGIC = b"LMTOKENS"
VERSION = 1
_HEAD = struct.Struct("<8sHH32s")
_TAIL = struct.Struct("<QQ8s")
_INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("offset", "<u8"), ("length", "<u8"), ("tokens", "<u8")])


def train_dictionary(samples: list[bytes], size: int = 64 * 1024) -> bytes:
    """A raw dictionary of at most `size` bytes; empty if there's too little to learn from."""
    import zstandard

    samples = [s for s in samples if len(s) >= 8]
    size = min(size, sum(map(len, samples)) // 8)
    if len(samples) < 8 or size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes, level: int | None = None):
    """For compression at a level, digested once and not for every document."""
    import zstandard

    if not raw:
        return None
    out = zstandard.ZstdCompressionDict(raw)
    if level is not None:
        out.precompute_compress(level=level)
    return out


class ShardWriter:
    """Appends documents to an open binary stream."""

    def __init__(self, stream, dictionary: bytes, width: int, level: int = 1):
        import zstandard

        self.stream, self.width, self.at = stream, width, 0
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary, level), write_checksum=False).compress
        self.index: list[tuple] = []
        self._put(_HEAD.pack(MAGIC, VERSION, width, hashlib.sha256(dictionary).digest()))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.compress(ids.astype("<u2" if self.width == 2 else "<u4").tobytes())
        self.index.append((doc_id or 0, doc_id is not None, self.at, len(frame), len(ids)))
        self._put(frame)

    def finish(self) -> None:
        at = self.at
        self._put(zlib.compress(np.array(self.index, _INDEX).tobytes(), 1))
        self._put(_TAIL.pack(at, len(self.index), MAGIC))


class Shard:
    """Reads a shard from a seekable binary stream."""

    def __init__(self, stream, dictionary: bytes):
        import zstandard

        self.stream = stream
        stream.seek(0, io.SEEK_END)
        end = stream.tell()
        magic, version, self.width, digest = _HEAD.unpack(self._read(0, _HEAD.size))
        at, n, tail = _TAIL.unpack(self._read(end - _TAIL.size, _TAIL.size))
        if magic != MAGIC or tail != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        self.index = np.frombuffer(zlib.decompress(self._read(at, end - _TAIL.size - at)), _INDEX)
        if len(self.index) != n:
            raise ValueError("the index is cut short")
        self.decompress = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    def _read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def _ids(self, tokens: int, frame: bytes) -> np.ndarray:
        n = tokens * self.width
        raw = self.decompress(frame, max_output_size=n) if n else b""
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def document(self, doc_id: int) -> np.ndarray:
        """One document's ids, without reading the others."""
        found = np.flatnonzero((self.index["doc_id"] == doc_id) & (self.index["known"] == 1))
        if not len(found):
            raise KeyError(doc_id)
        row = self.index[found[0]]
        return self._ids(int(row["tokens"]), self._read(int(row["offset"]), int(row["length"])))

    def documents(self, at_once: int = 1 << 22) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order; reads about `at_once` bytes together."""
        offsets, lengths, counts = (self.index[c].tolist() for c in ("offset", "length", "tokens"))
        ids, known = self.index["doc_id"].tolist(), self.index["known"].tolist()
        first = 0
        while first < len(ids):
            start, last = offsets[first], first
            while last + 1 < len(ids) and offsets[last + 1] + lengths[last + 1] - start <= at_once:
                last += 1
            block = self._read(start, offsets[last] + lengths[last] - start)
            for k in range(first, last + 1):
                at = offsets[k] - start
                yield (ids[k] if known[k] else None), self._ids(counts[k], block[at : at + lengths[k]])
            first = last + 1


@dataclass
class TokenFiles:
    """A written corpus: `manifest` has a row per shard (path, part, docs, tokens, start)."""

    folder: str
    manifest: DataFrame
    dictionary: bytes


def write(documents: DataFrame, tokenizer_path: str | None = None, end_id: int = 2, dictionary_docs: int = 512, dictionary_doc_chars: int = 16_384, dictionary_bytes: int = 64 * 1024, shard_docs: int = 1 << 16, folder: str | None = None) -> TokenFiles:
    """Writes the ids of each whole text (null: empty) and `end_id`, in ascending doc_id order (nulls first).

    The dictionary is trained on at most `dictionary_docs` documents of at most `dictionary_doc_chars` characters,
    those with the smallest hash of doc_id; every document is encoded with it. Rows that repeat a doc_id are all
    written, next to each other. Shards have about `shard_docs` documents at most. Ids take 2 bytes if the vocabulary fits, else 4. Each task writes a shard under a
    name of its own; the manifest, saved before it is read, names the shards that count, so what a lost or repeated
    task has left behind is ignored. Extra columns are not read.
    """
    spark = documents.sparkSession
    path = tokenizer_path or default_path()
    folder = folder or scratch.new_path(spark, "tokens")
    short = documents.where(F.length("text") <= dictionary_doc_chars)
    chosen = [r.doc_id for r in short.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(dictionary_docs).collect()]
    sample = short.where(F.col("doc_id").isin(chosen)).select("text").limit(dictionary_docs) if chosen else short.select("text").limit(0)
    encode = encoder(path)
    width = 2 if max(encode.vocabulary, end_id + 1) <= 1 << 16 else 4
    kind = "<u2" if width == 2 else "<u4"
    dictionary = train_dictionary([encode.ids(r.text).astype(kind).tobytes() for r in sample.collect()], dictionary_bytes)
    files, where = scratch.file_system(folder)
    files.create_dir(where, recursive=True)
    with files.open_output_stream(f"{where}/dictionary.zdict", compression=None) as out:
        out.write(dictionary)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name, encode, end = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.tok", encoder(path), np.array([end_id], "<u4")
        fs, at = scratch.file_system(folder)
        writer, total = None, 0
        with fs.open_output_stream(f"{at}/{name}", compression=None) as out:
            writer = ShardWriter(out, dictionary, width)
            for batch in batches:
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                    ids = np.concatenate([encode.ids(text.as_py()), end])
                    writer.add(doc_id, ids)
                    total += len(ids)
            writer.finish()
        if not writer.index:
            fs.delete_file(f"{at}/{name}")
            return
        yield pa.RecordBatch.from_pydict({"name": [name], "part": [task.partitionId()], "docs": [len(writer.index)], "tokens": [total]}, schema=pa.schema({"name": pa.string(), "part": pa.int64(), "docs": pa.int64(), "tokens": pa.int64()}))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(documents.count() / shard_docs))
    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    manifest = scratch.saved(ordered.mapInArrow(shard, "name string, part long, docs long, tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return TokenFiles(folder, manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))), dictionary)


def read(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shards."""
    folder, dictionary = files.folder, files.dictionary

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema({"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()})
        fs, at = scratch.file_system(folder)
        for batch in batches:
            for name, start in zip(batch["name"].to_pylist(), batch["start"].to_pylist()):
                rows: list[tuple] = []
                with fs.open_input_file(f"{at}/{name}") as stream:
                    for doc_id, ids in Shard(stream, dictionary).documents():
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    shards = files.manifest.select("name", "start")
    return shards.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards.count())).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, write(spark.read.parquet(f"{sf_dir}/documents.parquet")))
