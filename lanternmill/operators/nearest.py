"""The nearest vectors of any number of queries in one pass, by matrices.

Queries and vectors are dealt to a grid of tiles. A tile holds its queries as a matrix and takes its vectors in batches;
the rows of a batch are grouped around some of themselves, the centres. The angle to a centre, less the widest angle
within its group, is the least angle that a query can have with any of the group (the triangle inequality), so groups
that cannot reach a query's k-th best are passed over; the others are one matrix product. A tile gives at most k rows a
query, which meet in a window that keeps k a task before it shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternmill.operators.retrieval import DEPTH, top

#: Queries of a tile and vectors of one at least; vectors of a batch; centres of a batch; queries of one product.
QUERIES, TILE_ROWS, BATCH, CENTRES, TOGETHER = 4096, 1 << 11, 4096, 32, 64


def _units(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the rows with a direction and their unit vectors. Null, empty and zero vectors and those with a null
    or non-finite component have none."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = {}
    for length in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == length)
        x = flat[starts[rows][:, None] + np.arange(length)]
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        ok = np.isfinite(norm) & (norm > 0)
        out[int(length)] = rows[ok], x[ok] / norm[ok, None]
    return out


def rounded(x: np.ndarray) -> np.ndarray:
    """To six places, halves away from zero, as SQL rounds; no negative zero."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x) + 0.0


class _Tile:
    def __init__(self, queries: list[pa.RecordBatch], k: int):
        table = pa.Table.from_batches(queries)
        self.k, self.ids, self.n = k, table["query_id"], table.num_rows
        self.units = _units(table["vector"].combine_chunks() if table["vector"].num_chunks != 1 else table["vector"].chunk(0))
        self.kth = np.full(self.n, -2.0)
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, object))] * self.n
        self.products = 0  # pairs whose cosine was worked out

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        near = scores >= self.kth[q]
        if not near.any():
            return
        scores, ids = (np.concatenate(x) for x in zip(self.found[q], (scores[near], ids[near])))
        if len(scores) > self.k:
            at = np.flatnonzero(scores >= np.partition(scores, -self.k)[-self.k])
            at = np.array(sorted(at, key=lambda i: (-scores[i], ids[i] is None, ids[i]))[: self.k])
            scores, ids = scores[at], ids[at]
        self.found[q] = scores, ids
        if len(scores) == self.k:
            self.kth[q] = scores.min()

    def search(self, batch: pa.Table) -> None:
        ids = np.empty(batch.num_rows, object)
        ids[:] = batch["id"].to_pylist()
        units = _units(batch["vector"].combine_chunks() if batch["vector"].num_chunks != 1 else batch["vector"].chunk(0))
        seen = np.zeros(self.n, bool)
        for length, (rows, queries) in self.units.items():
            seen[rows] = True
            own, x = units.get(length, (np.zeros(0, int), np.zeros((0, length))))
            if len(own):
                self._products(rows, queries, ids[own], x)
            other = np.ones(len(ids), bool)
            other[own] = False
            for q in rows[self.kth[rows] <= 0] if other.any() else ():
                self.offer(q, np.zeros(int(other.sum())), ids[other])
        for q in np.flatnonzero(~seen):  # queries without a direction
            self.offer(q, np.zeros(len(ids)), ids)

    def _products(self, rows: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        centres = x[np.linspace(0, len(x) - 1, min(CENTRES, len(x))).astype(int)]
        nearness = x @ centres.T
        group = nearness.argmax(axis=1)
        order = np.argsort(group, kind="stable")
        x, ids, group = x[order], ids[order], group[order]
        reach = np.arccos(np.clip(nearness[order, group], -1, 1))
        edges = np.searchsorted(group, np.arange(len(centres) + 1))
        widest = np.array([reach[a:b].max() if b > a else 0.0 for a, b in zip(edges, edges[1:])])
        for a in range(0, len(rows), TOGETHER):
            some = slice(a, a + TOGETHER)
            angle = np.arccos(np.clip(queries[some] @ centres.T, -1, 1)) - widest
            # scores are rounded, so what is a millionth below still counts
            open_ = (np.cos(np.maximum(angle, 0.0)) + 2e-6 >= self.kth[rows[some], None]).any(axis=0) & (edges[1:] > edges[:-1])
            if open_.any():
                at = np.concatenate([np.arange(edges[g], edges[g + 1]) for g in np.flatnonzero(open_)])
                scores = rounded(queries[some] @ x[at].T)
                self.products += scores.size
                for q, own in zip(rows[some], scores):
                    self.offer(q, own, ids[at])

    def out(self, kind: pa.DataType) -> pa.RecordBatch:
        sizes = [len(s) for s, _ in self.found]
        scores, ids = np.concatenate([s for s, _ in self.found]), np.concatenate([i for _, i in self.found])
        return pa.RecordBatch.from_arrays([self.ids.combine_chunks().take(pa.array(np.repeat(np.arange(self.n), sizes))), pa.array(ids.tolist(), kind), pa.array(scores)], names=["query_id", "id", "score"])


def _runs(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Where rows differ from the row before in a key, and the ends."""
    n = batch.num_rows
    new = np.zeros(max(n - 1, 0), bool)
    for c in keys:
        a, b = batch[c].slice(0, n - 1), batch[c].slice(1)
        new |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(new) + 1).tolist(), n]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = DEPTH) -> DataFrame:
    """query_id, id, score (cosine, rounded to six places), rank (from 0) of the k rows of vectors (id, vector) with the
    greatest cosine for each of queries (query_id, qvector), ties to the smaller id; where both have a column part, among
    the rows of the query's part.

    A vector without a direction (null, empty, zero, or with a null or non-finite component) has cosine 0 with all, and so
    have vectors of different lengths. A null id counts last. Queries are told apart by query_id, which is theirs alone.
    A tile holds at most about QUERIES queries; the vectors are shuffled once for each so many queries, the queries once
    for each group of vectors.
    """
    part = ["part"] if "part" in queries.columns else []
    shuffles = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = max(1, -(-queries.count() // QUERIES))
    rows = max(1, min(-(-shuffles // columns), -(-vectors.count() // TILE_ROWS)))
    id_type, query_type = vectors.schema["id"].dataType, queries.schema["query_id"].dataType
    own = lambda c, n, name: F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias(name)
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    asked = queries.select(*part, own("query_id", columns, "c"), each(rows, "r"), F.lit(0).alias("kind"), "query_id", F.lit(None).cast(id_type).alias("id"), F.col("qvector").cast("array<double>").alias("vector"))
    tried = vectors.select(*part, each(columns, "c"), own("id", rows, "r"), F.lit(1).alias("kind"), F.lit(None).cast(query_type).alias("query_id"), "id", F.col("vector").cast("array<double>").alias("vector"))
    keys = ["tile", *part, "c", "r"]
    dealt = asked.unionByName(tried).withColumn("tile", F.xxhash64(*part, "c", "r"))
    dealt = dealt.repartition(shuffles, "tile").sortWithinPartitions(*keys, "kind")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None
        tile: _Tile | None = None
        queries: list[pa.RecordBatch] = []
        held: list[pa.RecordBatch] = []

        def tried() -> None:
            if held and tile:
                tile.search(pa.Table.from_batches(held))
            held.clear()

        for batch in batches:
            cuts = _runs(batch, [*keys, "kind"])
            for a, b in zip(cuts, cuts[1:] if batch.num_rows else ()):
                rows = batch.slice(a, b - a)
                at = [rows[c][0].as_py() for c in keys]
                if at != last:
                    tried()
                    if tile:
                        yield tile.out(rows["id"].type)
                    last, tile = at, None
                    queries.clear()
                if rows["kind"][0].as_py() == 0:
                    queries.append(rows)
                    continue
                if queries:
                    tile = _Tile(queries, k)
                    queries.clear()
                for c in range(0, rows.num_rows, BATCH):
                    held.append(rows.slice(c, BATCH))
                    if sum(h.num_rows for h in held) >= BATCH:
                        tried()
        tried()
        if tile:
            yield tile.out(rows["id"].type)

    found = dealt.mapInArrow(best, f"query_id {query_type.simpleString()}, id {id_type.simpleString()}, score double")
    return top(found, k)
