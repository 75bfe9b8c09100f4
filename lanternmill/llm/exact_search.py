"""Exact search for the rows with the greatest inner products, by columnar branch and bound.

Queries and candidates are dealt to a grid of tiles; a tile holds its queries and streams its candidates. A batch of
candidates lies in vertical layout, a row a dimension, the dimensions of greatest mass first. Inner products are added up
block by block of dimensions; after each block, what a candidate can still add is at most the product of both remaining
masses (norms), so candidates that cannot reach any query's k-th best score go and the survivors are moved together.

A first, small search among a share of the candidates gives every query a score that its k-th best reaches at least, so
that tiles drop candidates from their first batch on and give few rows more than the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternmill.llm import scratch

K, SCALE = 10, 1024
#: Bytes of queries in a tile; candidates in a batch; queries that are worked on together; dimensions in a block.
QUERY_BYTES, BATCH, TOGETHER, DIMENSIONS = 16 << 20, 8192, 64, 8
#: Candidates of which the first search takes one in so many; candidates that are one tile's work at least.
FIRST, TILE_ROWS = 64, 1 << 11
#: Below this, sums of products are whole numbers that doubles hold exactly; beyond it they are Python's integers.
EXACT = float(1 << 53)
LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Share of candidates alive above which moving them together costs more than it saves.
DENSE = 0.75


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of a matrix, as doubles where these hold it, else as Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * x)
    if np.isfinite(scaled).all():
        return scaled
    return np.array([[int(s) if np.isfinite(s) else int(v) * SCALE for s, v in zip(*rows)] for rows in zip(scaled, x)], object)


def _most(x: np.ndarray) -> float:
    return float(np.abs(x).max()) if x.size and x.dtype != object else np.inf if x.size else 0.0


class Best:
    """The k best (score, vec_id, row) so far of each of some queries of one length."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, least: np.ndarray, k: int):
        self.queries, self.rows, self.least, self.k = queries, rows, least, k  # queries: a row each
        self.found = [(np.zeros(0, np.int64),) * 3 for _ in rows]
        self.mass = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=0)) if queries.dtype != object else None

    def take(self, q: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        other = rows != self.rows[q]
        scores, ids, rows = (np.concatenate(x) for x in zip(self.found[q], (scores[other], ids[other], rows[other])))
        if len(scores) > self.k:  # ~x orders as -x does, and has no overflow
            at = np.flatnonzero(scores >= scores[np.argpartition(~scores, self.k - 1)[self.k - 1]])
            at = at[np.lexsort((rows[at], ids[at], ~scores[at]))][: self.k]
            scores, ids, rows = scores[at], ids[at], rows[at]
        self.found[q] = scores, ids, rows
        if len(scores) == self.k:
            self.least[q] = max(self.least[q], int(scores.min()))

    def search(self, block: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Candidates in vertical layout: a row a dimension."""
        if _most(block) * _most(self.queries) * max(1, len(block)) < EXACT:
            self._bounded(block, ids, rows)
        else:
            self._unbounded(block, ids, rows)

    def _bounded(self, block: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(-self.mass * np.sqrt((block**2).sum(axis=1)), kind="stable")
        block, queries = block[order], self.queries[:, order]
        edges = [*range(0, len(order), DIMENSIONS), len(order)]
        left = lambda x: [np.sqrt(s) for s in [*np.cumsum(np.add.reduceat(x**2, edges[:-1], axis=0)[::-1], axis=0)[::-1][1:], np.zeros(x.shape[1])]]
        mine, theirs = left(queries.T), left(block)
        for a in range(0, len(queries), TOGETHER):
            z = slice(a, a + TOGETHER)
            sums, at, now = np.zeros((len(queries[z]), block.shape[1])), np.arange(block.shape[1]), block
            least = self.least[z, None].astype(np.float64)
            for b, (i, j) in enumerate(zip(edges, edges[1:])):
                sums += queries[z, i:j] @ now[i:j]
                # a little more than the bound, so that what rounding of norms takes off drops no candidate
                alive = sums + np.outer(mine[b][z], theirs[b][at]) * (1 + 1e-9) >= least - 0.5
                some = alive.any(axis=0)
                if not some.any():
                    at = at[:0]
                    break
                if some.mean() < DENSE and j < len(order):
                    sums, at, now = sums[:, some], at[some], now[:, some]
            if len(at):
                for q, near in enumerate(sums >= least):
                    if near.any():
                        self.take(a + q, sums[q, near].astype(np.int64), ids[at[near]], rows[at[near]])

    def _unbounded(self, block: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Exact in Python's integers; scores beyond the range of 64 bits are held at its ends."""
        integers = lambda x: x if x.dtype == object else np.array([[int(v) for v in r] for r in x], object)
        block = integers(block)
        for q, query in enumerate(integers(self.queries)):
            scores = np.clip(query @ block, LOW, HIGH).astype(np.int64)
            near = scores >= self.least[q]
            self.take(q, scores[near], ids[near], rows[near])


def _by_length(parts: list[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.Table]]:
    """(length, a row of a matrix for each vector, the rows) of the vectors of each length."""
    table = pa.Table.from_batches(parts).combine_chunks()
    vectors = table["vector"].combine_chunks()
    vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = vectors.value_lengths().to_numpy()
    flat, starts = vectors.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lengths)])
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        yield int(length), flat[starts[own][:, None] + np.arange(length)], table.take(pa.array(own))


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of rows of tiles, each tile's queries before its candidates."""
        tile, n = None, 0
        queries: list[pa.RecordBatch] = []
        held: list[pa.RecordBatch] = []
        best: dict[int, tuple[Best, np.ndarray]] = {}

        def tried() -> None:
            nonlocal n
            for length, x, rows in _by_length(held) if held and best else ():
                if length in best:
                    best[length][0].search(np.ascontiguousarray(whole(x).T), rows["vec_id"].fill_null(HIGH).to_numpy(), rows["row"].to_numpy())
            held.clear()
            n = 0

        def out() -> Iterator[pa.RecordBatch]:
            tried()
            for found, ids in best.values():
                sizes = [len(f[0]) for f in found.found]
                scores, others, rows = map(np.concatenate, zip(*found.found))
                columns = [np.repeat(found.rows, sizes), np.repeat(ids, sizes), scores, others, rows]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["query_row", "query_id", "score", "vec_id", "row"])
            best.clear()
            queries.clear()

        for batch in batches:
            kinds = batch["tile"].to_numpy() * 2 + ~batch["query"].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
            for a, b in zip(cuts, cuts[1:] if len(kinds) else ()):
                if kinds[a] >> 1 != tile:
                    yield from out()
                    tile = kinds[a] >> 1
                if not kinds[a] & 1:
                    queries.append(batch.slice(a, b - a))
                    continue
                for length, x, rows in _by_length(queries) if queries else ():
                    best[length] = Best(whole(x), rows["row"].to_numpy(), rows["least"].to_numpy().copy(), k), rows["vec_id"].to_numpy()
                queries.clear()
                for c in range(a, b, BATCH):
                    held.append(batch.slice(c, min(BATCH, b - c)))
                    n += held[-1].num_rows
                    if n >= BATCH:
                        tried()
        yield from out()

    return run


def _tiled(queries: DataFrame, candidates: DataFrame, columns: int, rows: int, k: int) -> DataFrame:
    """query_row, query_id, score, vec_id, row: the k best of each tile of a grid of so many groups of queries and of
    candidates, of those with a score of `least` or more."""
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    own = lambda n, name: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias(name)
    asked = queries.select(own(columns, "c"), spread(rows, "r"), F.lit(True).alias("query"), "row", "vec_id", "least", "vector")
    tried = candidates.select(spread(columns, "c"), own(rows, "r"), F.lit(False).alias("query"), "row", "vec_id", F.lit(LOW).alias("least"), "vector")
    dealt = asked.unionByName(tried).withColumn("tile", F.col("c").cast("long") * rows + F.col("r")).drop("c", "r")
    return dealt.repartitionById(columns * rows, F.col("tile").cast("int")).sortWithinPartitions("tile", F.desc("query")).mapInArrow(_search(k), "query_row long, query_id long, score long, vec_id long, row long")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of vectors (vec_id, embedding; others are passed over) that
    is_query (a condition on vec_id) names, the k other rows with the greatest inner products of floor(1024 * x), all if
    there are fewer. Ties go to the smaller vec_id.

    Vectors that are null, empty or hold a null or non-finite component take no part. Only vectors of equal length have a
    product. Rows that repeat a vec_id are rows of their own, as queries too, and meet each other; a null vec_id is a
    candidate like any other, behind its equals, and no query. Scores beyond 64 bits are held at the ends of their range
    and tie there. Without queries or candidates the result is empty.

    A tile holds QUERY_BYTES of queries at most, about, so the vectors are read once for each such group of queries; the
    queries are repeated for each group of candidates, of which there are as many as shuffle partitions or fewer.
    """
    spark = vectors.sparkSession
    with scratch.passing():
        doubles = F.col("embedding").cast("array<double>")
        usable = F.coalesce((F.size(doubles) > 0) & F.forall(doubles, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))
        rows = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("vector"), F.monotonically_increasing_id().alias("row"))
        rows = scratch.saved(rows, "vectors")  # row numbers stay what they are, whatever is computed again
        asked = rows.where(F.col("vec_id").isNotNull() & is_query(F.col("vec_id")))
        n, n_asked, size = rows.agg(F.count("*"), F.count_if(F.coalesce(is_query(F.col("vec_id")), F.lit(False))), F.max(F.size("vector"))).first()
        columns = max(1, -(-(n_asked * 8 * (size or 1)) // QUERY_BYTES))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        groups = lambda m: max(1, min(-(-parts // columns), -(-m // TILE_ROWS)))
        asked = asked.withColumn("least", F.lit(LOW))
        if n > FIRST * k:
            few = rows.where(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(FIRST)) == 0)
            first = _best(_tiled(asked, few, columns, groups(n // FIRST), k), k).where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("reached"))
            asked = asked.join(scratch.saved(first, "reached"), "row", "left").withColumn("least", F.coalesce("reached", F.lit(LOW))).drop("reached")
        found = _best(_tiled(asked, rows, columns, groups(n), k), k)
        named = found.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") < HIGH, F.col("vec_id")).alias("vec_id"), "score")
        return scratch.keep(scratch.Saved(named, "nearest")).df


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose id is divisible by 100 against all others."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 100 == 0)


SQL = f"""WITH v AS (SELECT vec_id, row_number() OVER () AS r, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.e) = len(c.e))
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= {K}"""
