"""Near-duplicate texts: SimHash fingerprints of five-word shingles, and exact Jaccard similarity of the whole sets.

Texts whose fingerprints are a few bits apart are proposed by bit-sliced comparison; a link counts only if the whole
shingle sets have the similarity. Fingerprints of sets at the threshold of 0.8 differ in about ten bits of 64, beyond
what files of equal bit ranges can find, so the pairs that the fingerprints leave open are found exactly: shingles are
put in one order for all texts, and two texts of a similarity of t or more share one of the first n - t n + 1 of the n
shingles of each (prefix filtering), so no pair is missed. The order is that of the shingles' hashes, with shingles
that a share of the texts finds common last; that changes what is compared, never the result.

First each text is held against the one that its fingerprint is near to and one that often comes with it in the files
of first shingles; then whatever is not connected by then against each other, where the prefixes share so much that
the whole sets may reach t.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternmill.llm import scratch, simhash
from lanternmill.llm.components import components
from lanternmill.llm.url_filter import Level

#: One document in so many is counted for common shingles; in how many of them a common one is; how many are kept.
SHARE, COMMON, MOST = 16, 3, 1 << 20
ROW = ["_file", "_at"]


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; of all its words if it has fewer than size."""
    return distinct(list(simhash.shingle_hashes(text, size)))


def distinct(hashes: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(hashes).astype(np.uint64)) if hashes else np.zeros(0, np.uint64)


def prefix(hashes: np.ndarray, threshold: float, common: np.ndarray) -> np.ndarray:
    """The shingles of which a text as similar as the threshold has one in its own prefix; common is sorted."""
    n = len(hashes) - math.ceil(threshold * len(hashes) - 1e-9) + 1 if len(hashes) else 0
    if len(common) and n:
        last = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = np.concatenate([hashes[~last], hashes[last]])
    return hashes[:n]


def with_row_keys(documents: DataFrame) -> DataFrame:
    """doc_id, text, the whole row as `row`, and _file and _at, which tell rows apart and stay the same however often they
    are read. Columns of documents can have any names."""
    if not documents._jdf.queryExecution().analyzed().children().isEmpty() or not documents.inputFiles():
        documents = scratch.saved(documents, "rows")
    where = documents.metadataColumn("_metadata")
    return documents.select("doc_id", "text", scratch.whole_row(documents).alias("row"), where["file_path"].alias("_file"), where["row_index"].alias("_at"))


def _common(documents: DataFrame, size: int) -> np.ndarray:
    """Shingles that a fixed share of the documents finds common: so those that are in more documents than some number
    come last in the order, whatever the number of documents. The most frequent MOST of them are kept, 8 bytes each."""
    picked = documents.where(F.pmod(F.xxhash64(*ROW), F.lit(SHARE)) == 0).select("text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch["text"]:
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), size).view(np.int64))], names=["h"])

    often = scratch.saved(picked.mapInArrow(counted, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON), "often")
    cut, kept = COMMON, 0
    for n, shingles_ in sorted(((r["n"], r["count"]) for r in often.groupBy("n").count().collect()), reverse=True):  # a row a count
        if kept + shingles_ > MOST:
            cut = n + 1
            break
        kept += shingles_
    return np.sort(often.where(F.col("n") >= cut).select("h").toArrow()["h"].to_numpy().view(np.uint64))


def _may_fit(shared: str, n: str, m: str, threshold: float) -> Column:
    """Whether sets of n and m shingles with so many in both prefixes can be similar enough: what the prefix that ends
    first has in common is in both, the rest is at most what is left of that set."""
    left = F.greatest(*[F.ceil(F.col(x) * F.lit(threshold) - F.lit(1e-9)) - 1 for x in (n, m)])
    close = F.least(n, m) >= F.greatest(n, m) * F.lit(threshold) - F.lit(1e-9)
    return close & (F.col(shared) + left >= (F.col(n) + F.col(m)) * F.lit(threshold / (1 + threshold)) - F.lit(1e-6))


def _crossed(filed: DataFrame, column: str) -> DataFrame:
    """The rows of keys under which the column has two values or more; an aggregate and a join, which can be split where
    a key is hot."""
    ends = filed.groupBy("key").agg(F.min(column).alias("low"), F.max(column).alias("high")).where("low <> high").select("key")
    return filed.join(ends, "key")


def repeats(documents: DataFrame, threshold: float = 0.8, size: int = 5, radius: int = 3) -> DataFrame:
    """_file, _at of all rows of documents (with_row_keys, doc_id, text) but the first of each group of near duplicates.

    Groups are connected by links of at least the threshold; first is the smallest doc_id (none at all comes last), then
    the smallest row key. Null, empty and blank texts are one group. Repeated rows are rows of their own; an empty table
    gives none; other columns are not read.
    """
    documents = documents.select(*ROW, F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch.passing():
        common = documents.sparkSession.sparkContext.broadcast(_common(documents, size))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            hashes = [list(simhash.shingle_hashes(t.as_py(), size)) for t in batch["text"]]
            prints = np.fromiter(map(simhash.majority, hashes), np.uint64, len(hashes)).view(np.int64)
            found = [distinct(h) for h in hashes]
            nodes = np.fromiter((xxhash.xxh64_intdigest(x.tobytes()) for x in found), np.uint64, len(found)).view(np.int64)
            first = pa.array([prefix(x, threshold, common.value).view(np.int64) for x in found], pa.list_(pa.int64()))
            counts = pa.array([len(x) for x in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch["_file"], batch["_at"], batch["doc_id"], pa.array(nodes), pa.array(prints), counts, first], names=["_file", "_at", "doc_id", "node", "fp", "n", "prefix"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingles(t.as_py(), size).view(np.int64) for t in batch["text"]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["node"], sets], names=["node", "hashes"])

    with scratch.passing():
        rows = scratch.saved(documents.mapInArrow(read, "_file string, _at long, doc_id long, node long, fp long, n int, prefix array<long>"), "shingled")
        nodes = scratch.saved(rows.groupBy("node").agg(F.min(F.struct(*ROW)).alias("row"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "nodes")

        def similar(pairs: DataFrame) -> DataFrame:
            """The pairs a, b whose whole sets are similar enough. A Bloom filter keeps other texts out of the shuffle."""
            pairs = scratch.saved(pairs.distinct(), "pairs")
            ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            one = scratch.saved(nodes.join(ends, "node", "left_semi").select("node", "row.*"), "asked")
            bloom = Level(one.select(F.xxhash64(*ROW).alias("key")), max(1, one.count()), 0.02, 11)
            texts = documents.select(*ROW, "text").where(bloom.passes(F.xxhash64(*ROW)))
            sets = scratch.saved(texts.join(one, ROW).select("node", "text").mapInArrow(whole, "node long, hashes array<long>"), "sets")
            both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
            rated = both.select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("k"))
            return scratch.saved(rated.where(F.col("k") / (F.col("n") + F.col("m") - F.col("k")) >= threshold).select("a", "b"), "links")

        # by fingerprint: a text and the first of its fingerprint, and the firsts of fingerprints that are close
        firsts = scratch.saved(nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("a")), "fingerprints")
        same = nodes.where("n > 0").join(firsts, "fp").where("a <> node").select("a", F.col("node").alias("b"))
        close = simhash.linked(firsts.select("fp"), radius).toDF("fp", "other").join(firsts, "fp").join(firsts.toDF("other", "b"), "other").select("a", "b")
        # by first shingles: a text and the one that most of its files have first
        filed = nodes.select("node", "n", F.explode("prefix").alias("key"))
        lowest = filed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("low"), F.max("node").alias("high")).where("low.node <> high").select("key", F.col("low.node").alias("a"), F.col("low.n").alias("m"))
        stars = filed.join(lowest, "key").where("a <> node").groupBy("a", "node", "n", "m").agg(F.count("*").alias("k")).where(_may_fit("k", "n", "m", threshold))
        stars = stars.groupBy("node").agg(F.max(F.struct("k", "a")).alias("best")).select("best.a", F.col("node").alias("b"))
        links = similar(same.unionByName(close).unionByName(stars))

        named = filed.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        crossed = scratch.saved(_crossed(scratch.saved(named, "filed"), "root").select("key", "node", "n", "root"), "crossed")
        other = crossed.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"))
        pairs = crossed.join(other, "key").where((F.col("node") < F.col("b")) & (F.col("root") != F.col("other")))
        pairs = pairs.groupBy(F.col("node").alias("a"), "b", "n", "m").agg(F.count("*").alias("k")).where(_may_fit("k", "n", "m", threshold))
        links = links.unionByName(similar(pairs.select("a", "b")))
        placed = rows.drop("prefix", "n", "fp").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW)
        first = placed.groupBy("root").agg(F.min(order).alias("first"))
        gone = placed.join(first, "root").where((F.col("first._file") != F.col("_file")) | (F.col("first._at") != F.col("_at")))
        return scratch.keep(scratch.Saved(gone.select(*ROW), "copies")).df
