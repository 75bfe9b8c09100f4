"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learned so that the signs of rotated vectors lose as little as possible; the signs
are the binary code. Several such rotations, from different starts, give a code of several hundred bits. The code is
cut into substrings, one for each table: vectors of the same label that agree in a substring meet in a cell of that
table. Substrings grow with the logarithm of the rows, and tables with them, so that cells stay small and a pair at the
threshold meets as surely at any size.

Members of a cell are first compared by a part of their codes, in Hamming distance; only members with a neighbour within
a wide radius fetch their original vectors, which are compared in double precision. So no pair below the threshold is
linked; a pair that meets in several tables counts in the first.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternmill.llm import scratch
from lanternmill.llm.components import components, find_roots
from lanternmill.llm.runs import whole_runs

#: Vectors of a cell in a block; larger cells are compared block by block.
BLOCK = 1024
#: 64-bit words of the code that are compared before vectors are, and the differing bits up to which a pair goes on.
SKETCH, RADIUS = 4, 64
#: Rows of a cell, if all were alike, from which substrings have more bits; the fewest bits; and how likely a pair at
#: the threshold may miss every table, if bits were independent.
CELL, SUBSTRING, MISS = 16, 12, 6.5e-5


def itq(vectors: np.ndarray, bits: int, rounds: int = 30, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): the sign of (x - mean) @ projection is the code. bits <= the dimension."""
    mean = vectors.mean(axis=0)
    centred = vectors - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    start = np.random.default_rng(seed).standard_normal((bits, bits))
    rotation = np.linalg.qr(start)[0]
    flat = centred @ axes
    for _ in range(rounds):
        signs = np.where(flat @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ flat)
        rotation = (left @ right).T
    return mean, axes @ rotation


@dataclass
class Index:
    """The projections for each dimension, the table count and the bits of a substring."""

    models: dict[int, list[tuple[np.ndarray, np.ndarray]]]
    tables: int
    substring: int

    @property
    def bits(self) -> int:
        return max(self.tables * self.substring, 64 * SKETCH)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """A row of table keys for each vector, then SKETCH numbers of its code."""
        dim = vectors.shape[1]
        models = self.models.get(dim)
        if models is None:  # none in the sample: rotations that aren't fitted
            models = [(np.zeros(dim), np.linalg.qr(np.random.default_rng([dim, r]).standard_normal((dim, dim)))[0]) for r in range(-(-self.bits // dim))]
        bits = np.concatenate([(vectors - mean) @ projection >= 0 for mean, projection in models], axis=1)
        while bits.shape[1] < self.bits:  # vectors of so few dimensions have codes that repeat
            bits = np.concatenate([bits, bits], axis=1)
        sketch = np.ascontiguousarray(np.packbits(bits[:, : 64 * SKETCH], axis=1)).view(np.int64)
        bits = bits[:, : self.tables * self.substring].reshape(len(vectors), self.tables, self.substring)
        return np.concatenate([bits @ (1 << np.arange(self.substring, dtype=np.int64)), sketch], axis=1)


def tables_for(rows: int, threshold: float) -> tuple[int, int]:
    """(tables, bits of a substring) for so many rows."""
    substring = max(SUBSTRING, math.ceil(math.log2(max(1, rows) / CELL)))
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** substring
    return math.ceil(math.log(MISS) / math.log(1 - same)) if same < 1 else 1, substring


def _near(sketches: np.ndarray, a: int, b: int) -> np.ndarray:
    """Whether rows a to b are within the radius of each row. Bits are counted in unsigned words: of a signed one numpy
    counts those of its absolute value."""
    sketches = np.ascontiguousarray(sketches).view(np.uint64)
    own = np.zeros((b - a, len(sketches)), np.int16)
    for w in range(sketches.shape[1]):
        own += np.bitwise_count(sketches[a:b, w, None] ^ sketches[None, :, w])
    return own <= RADIUS


def fit(vectors: list[np.ndarray], tables: int, substring: int) -> Index:
    index = Index({}, tables, substring)
    for dim in Counter(map(len, vectors)):
        own = np.array([v for v in vectors if len(v) == dim])
        if len(own) >= 2 * dim:
            index.models[dim] = [itq(own, dim, seed=r) for r in range(-(-index.bits // dim))]
    return index


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, digest of the vector, the unit vector; without a digest where a vector links with nothing."""
    for batch in batches:
        digests, units = [], []
        for v in batch["embedding"]:
            v = v.as_py()
            x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
            most = float(np.abs(x).max()) if len(x) and np.isfinite(x).all() else 0.0
            if most and not 1e-100 < most < 1e100:  # squares would leave the range of doubles
                x = np.ldexp(x, -np.frexp(most)[1])
            norm = float(np.sqrt(x @ x)) if most else 0.0
            digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if norm > 0 else None)
            units.append((x / norm).tobytes() if norm > 0 else None)
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(digests, pa.binary()), pa.array(units, pa.binary())], names=["vec_id", "label", "digest", "unit"])


def _matrix(units: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(units.to_pylist()), np.float64).reshape(len(units), -1)


def _units(units: pa.ChunkedArray, group: np.ndarray) -> np.ndarray:
    """The unit vectors as rows, filled with zeros where lengths differ (only vectors of one group are compared)."""
    raw = units.to_pylist()
    out = np.zeros((len(raw), max(map(len, raw)) // 8))
    if len(np.unique(group)) == 1:
        return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    for k, r in enumerate(raw):
        out[k, : len(r) // 8] = np.frombuffer(r, np.float64)
    return out


def _cosines(x: np.ndarray, i: np.ndarray, j: np.ndarray, at_once: int = 1 << 14) -> np.ndarray:
    """Cosines of pairs of rows, a bounded number at once."""
    parts = [np.einsum("ij,ij->i", x[i[a : a + at_once]], x[j[a : a + at_once]]) for a in range(0, len(i), at_once)]
    return np.concatenate(parts) if parts else np.zeros(0)


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, sample: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors are compared if their labels are equal and not null and their lengths are equal. A vector that is null,
    empty, zero or has a null or non-finite component links with nothing. Equal vectors are one to the index and link
    with each other, so n_links counts them all; rows that repeat a vec_id are rows of their own. A null vec_id is kept
    and counts last in its component. The index is fitted on at most `sample` distinct vectors, those with the smallest
    digests, and holds every vector.

    Only cells with two vectors or more are gathered, and of these only members with a neighbour by code are gathered
    with their vectors; large cells are compared in tiles of two blocks, and a tile gives a count for each member and a
    spanning forest of its links, not the pairs.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = rows.mapInArrow(_usable, "vec_id long, label string, digest binary, unit binary")
    usable = usable.withColumn("digest", F.when(F.col("label").isNotNull(), F.col("digest")))
    usable = scratch.saved(usable.select("vec_id", "label", "digest", F.when(F.col("digest").isNotNull(), F.col("unit")).alias("unit")), "units")
    linkable = usable.where("digest is not null")
    groups = linkable.groupBy("label", "digest").agg(F.min(F.coalesce("vec_id", F.lit((1 << 63) - 1))).alias("first"), F.count("*").alias("n"), F.first("unit").alias("unit"))
    distinct = scratch.saved(groups.withColumn("id", F.monotonically_increasing_id()), "distinct")
    picked = distinct.select("unit").orderBy(F.xxhash64("digest", "label")).limit(sample)
    tables, substring = tables_for(distinct.count(), threshold)
    index = fit([np.frombuffer(r.unit, np.float64) for r in picked.collect()], tables, substring)
    width = tables + SKETCH

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(u) for u in batch["unit"].to_pylist()]) if batch.num_rows else np.zeros(0, int)
            keys = np.zeros((batch.num_rows, width), np.int64)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                keys[own] = index.keys(_matrix(batch["unit"].take(pa.array(own))))
            flat = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, width, dtype=np.int32), keys.ravel())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], batch["n"], batch["unit"], flat], names=["id", "label", "n", "unit", "keys"])

    coded = scratch.saved(distinct.select("id", "label", "n", "unit").mapInArrow(code, "id long, label string, n long, unit binary, keys array<long>"), "codes")
    # cells are told apart by a hash of all that makes them; equal hashes of two cells would only cost comparisons, as
    # pairs are held against labels, lengths and keys too
    group = F.xxhash64("label", F.octet_length("unit")).alias("group")
    sketches = [F.get("keys", F.lit(tables + k)).alias(f"s{k}") for k in range(SKETCH)]
    filed = coded.select("id", group, *sketches, F.posexplode(F.slice("keys", 1, tables)).alias("at", "key"))
    filed = filed.select("id", "group", "at", F.xxhash64("group", "at", "key").alias("cell"), *[f"s{k}" for k in range(SKETCH)])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def tiled(rows: DataFrame, *columns: str) -> DataFrame:
        """The rows of cells with two or more, in tiles of two blocks, sorted by tile."""
        cells = scratch.saved(rows.groupBy("cell").agg(F.count("*").alias("members")).where("members > 1"), "cells")
        dealt = rows.join(cells, "cell").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        tile = F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")).alias("tile")
        dealt = dealt.select(tile, "cell", "id", "group", "at", "block", (F.col("block") != F.col("other")).alias("crossed"), *columns)
        return dealt.repartition(parts, "tile").sortWithinPartitions("tile", "cell", "id")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int, int]]:
        for table, starts in whole_runs(batches, ["tile", "cell"], 4096):
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
                if b - a > 1:
                    yield table.slice(a, b - a).combine_chunks(), a, b

    def candidates(near: np.ndarray, table: pa.Table, a: int, b: int) -> np.ndarray:
        """near without pairs of a row with itself, of two groups, and of one block where a tile has two."""
        group, block = table["group"].to_numpy(), table["block"].to_numpy()
        near &= group[a:b, None] == group[None, :]
        if table["crossed"][0].as_py():
            near &= block[a:b, None] != block[None, :]
        near[np.arange(b - a), np.arange(a, b)] = False
        return near

    def by_code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _, _ in runs(batches):
            s = np.stack([table[f"s{k}"].to_numpy() for k in range(SKETCH)], axis=1)
            some = np.concatenate([candidates(_near(s, a, min(a + 256, len(s))), table, a, min(a + 256, len(s))).any(axis=1) for a in range(0, len(s), 256)])
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(table[c].to_numpy()[some]) for c in ("id", "at", "cell")], names=["id", "at", "cell"])

    def by_vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _, _ in runs(batches):
            ids, n, at = (table[c].to_numpy() for c in ("id", "n", "at"))
            keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(ids), width)
            links, left, right = np.zeros(len(ids), np.int64), [], []
            x = _units(table["unit"], table["group"].to_numpy())
            for a in range(0, len(ids), 256):
                i, j = np.nonzero(candidates(_near(keys[:, tables:], a, min(a + 256, len(ids))), table, a, min(a + 256, len(ids))))
                i += a
                for t in range(int(at[0])):  # a pair counts in the first table where it meets
                    new = keys[i, t] != keys[j, t]
                    i, j = i[new], j[new]
                good = _cosines(x, i, j) >= threshold
                i, j = i[good], j[good]
                links += np.bincount(i, weights=n[j], minlength=len(ids)).astype(np.int64)
                left.append(i)
                right.append(j)
            some = np.flatnonzero(links)
            roots = find_roots(np.concatenate(left), np.concatenate(right), len(ids))
            yield pa.RecordBatch.from_pydict({"id": ids[some], "links": links[some], "root": ids[roots[some]]})

    near = scratch.saved(tiled(filed, *[f"s{k}" for k in range(SKETCH)]).mapInArrow(by_code, "id long, at int, cell long").distinct(), "neighbours")
    fetched = near.join(coded.select("id", group, "n", "unit", "keys"), "id")
    found = tiled(fetched, "n", "unit", "keys").mapInArrow(by_vector, "id long, links long, root long")
    found = scratch.saved(found, "found")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = distinct.select("id", "label", "digest", "first", "n").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = scratch.saved(named.join(counts, "id", "left"), "named")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root").select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("component_id") < (1 << 63) - 1, F.col("component_id")).alias("component_id"))
    joined = usable.select("vec_id", "label", "digest").join(scratch.saved(named, "results"), ["label", "digest"], "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
