"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints within `radius` of each other agree in full on some `bands - radius` of `bands` bit ranges, so each
fingerprint is filed under every choice of so many ranges. The fingerprints of a file are laid out as 64 bit planes,
64 fingerprints to a machine word. All pairs at the same offset are compared at once: the planes are XORed with the
shifted planes, carry-save counters add up the differing bits, and words whose pairs have all passed the radius are
dropped before the next planes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternmill.llm import scratch
from lanternmill.llm.components import components, find_roots
from lanternmill.llm.runs import whole_runs

BITS = 64
#: Fingerprints of one file in a tile; larger files are compared tile by tile.
TILE = 2048


def shingle_hashes(text: str | None, size: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a whole text, repeats included, in arrays of a bounded size; of the whole sequence
    if it has fewer words, nothing without words."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split() if text else []  # bytes: only A-Z fall, only ASCII space splits
    if not words:
        return
    buffer, digest, size = b" ".join(words), xxhash.xxh64_digest, min(size, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths).tolist(), ends[size - 1 :].tolist()
    for at in range(0, len(ends), 1 << 15):
        h = b"".join([digest(buffer[a:b], seed) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])])
        yield np.frombuffer(h, ">u8")


def majority(hashes: Iterator[np.ndarray]) -> int:
    """The number whose bits are 1 where over half of the hashes have a 1; 0 of none."""
    n, counts = 0, np.zeros(BITS, np.int64)
    for h in hashes:
        n += len(h)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text over word shingles, repeats included; 0 without words."""
    return majority(shingle_hashes(text, shingle, seed))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch["text"]), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def planes(values: np.ndarray) -> np.ndarray:
    """64 rows of words: bit i of the row b is bit b of the i-th value."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, "<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def close_at(sliced: np.ndarray, offset: int, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Of the pairs (i, i + offset), those at most `radius` bits apart; lanes: words with a bit for each i that counts."""
    words = np.flatnonzero(lanes)
    if not len(words):
        return words
    counters = [np.zeros(len(words), np.uint64) for _ in range(radius.bit_length())]
    over, lanes = ~lanes[words], lanes[words]
    skip, shift = divmod(offset, 64)
    padded = sliced.shape[1] - 1
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for first in range(0, BITS, 8):
        low, high = np.minimum(words + skip, padded), np.minimum(words + skip + 1, padded)
        for b in range(first, first + 8):
            plane = sliced[b]
            other = plane[low]
            if shift:
                other = (other >> np.uint64(shift)) | (plane[high] << np.uint64(64 - shift))
            carry = plane[words] ^ other
            for k, counter in enumerate(counters):
                counters[k], carry = counter ^ carry, counter & carry
            over |= carry
        alive = over != full
        if not alive.all():  # whole words have passed the radius
            words, over, counters = words[alive], over[alive], [c[alive] for c in counters]
            if not len(words):
                return words
    if radius != (1 << len(counters)) - 1:  # counts that fit the counters but not the radius
        above = np.zeros(len(words), np.uint64)
        same = np.full(len(words), full)
        for k in range(len(counters) - 1, -1, -1):
            if radius >> k & 1:
                same &= counters[k]
            else:
                above |= same & counters[k]
                same &= ~counters[k]
        over |= above
    hit = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(hit)
    return words[at] * 64 + lane


def link_runs(values: np.ndarray, starts: np.ndarray, side: np.ndarray | None, radius: int) -> np.ndarray:
    """The root of each value, by links within its run; where side is given, only links between two sides count."""
    n = len(values)
    ends = np.append(starts[1:], n)
    run = np.repeat(np.arange(len(starts)), ends - starts)
    sliced = np.concatenate([planes(values), np.zeros((BITS, 1), np.uint64)], axis=1)
    width = sliced.shape[1]
    label = np.arange(n)
    size = ends - starts
    for offset in range(1, int(size.max()) if len(size) else 1):
        live = np.flatnonzero(size > offset)
        if len(live) * 8 < len(size):  # few runs are so long
            i = np.concatenate([np.arange(starts[k], ends[k] - offset) for k in live.tolist()])
        else:
            i = np.arange(n - offset)
            i = i[run[i] == run[i + offset]]
        keep = label[i] != label[i + offset]
        if side is not None:
            keep &= side[i] != side[i + offset]
        i = i[keep]
        if not len(i):
            continue
        lanes = np.zeros(width * 64, np.uint8)
        lanes[i] = 1
        found = close_at(sliced, offset, np.packbits(lanes, bitorder="little").view("<u8").astype(np.uint64), radius)
        if len(found):
            label = find_roots(np.append(found, np.arange(n)), np.append(found + offset, label), n)
    return label


def linked(fingerprints: DataFrame, radius: int = 3, bands: int = 5, tile: int = TILE) -> DataFrame:
    """a, b: links that connect all distinct fingerprints (long, column fp) at most `radius` bits apart.

    Where many are close together, a spanning forest of a file's links stands for all of them.
    """
    cuts = [BITS * i // bands for i in range(bands + 1)]
    masks = [sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen) for chosen in combinations(range(bands), bands - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    filed = fingerprints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("file", "key"))
    counts = filed.groupBy("file", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / tile).cast("int")
    dealt = filed.join(counts, ["file", "key"]).select("file", "key", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("block"))
    tiled = dealt.select("file", "key", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiled = tiled.select("file", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")
    keys = ["file", "key", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, keys):
            values = table["fp"].to_numpy().view(np.uint64)
            block = table["block"].to_numpy()
            crossed = (table["i"].to_numpy() != table["j"].to_numpy()).any()
            # a tile of two blocks compares them with each other; within a block, its own tile does
            side = np.where(table["i"].to_numpy() == table["j"].to_numpy(), np.arange(len(values)), block.astype(np.int64) + (1 << 40)) if crossed else None
            root = link_runs(values, starts, side, radius)
            tied = np.flatnonzero(root != np.arange(len(values)))
            yield pa.RecordBatch.from_pydict({"a": values.view(np.int64)[tied], "b": values.view(np.int64)[root[tied]]})

    parts = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiled.repartition(parts, *keys).sortWithinPartitions(*keys, "fp").mapInArrow(compare, "a long, b long")


def near_duplicates(documents: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    component_id: the smallest doc_id reachable over links of at most `radius` differing bits, own one included; null
    only where no doc_id is known. Null, empty and blank texts have fingerprint 0 and link like any other; repeated
    rows stay rows; other columns are not read.
    """
    prints = scratch.saved(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    distinct = scratch.saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(linked(distinct.select("fp"), radius))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    grouped = scratch.saved(grouped, "groups")
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    names = grouped.join(smallest, "root").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
