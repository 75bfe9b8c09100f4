"""Chunks of documents: recursive and fixed splitting, numbering, and putting articles together again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternmill.functions.text import once
from lanternmill.session import stored

SIZE, OVERLAP = 900, 120
# Where a text is split, the strongest break first.
SEPARATORS = ("\n## ", "\n### ", "\n#### ", "\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters where the text has breaks, each starting with up to `overlap` characters of
    the one before. Separators open the next piece. A run without any break stays whole."""
    chosen = next((k for k, s in enumerate(separators) if s in text), None)
    if chosen is None:
        return [text.strip()] if text.strip() else []
    mark, rest = separators[chosen], separators[chosen + 1 :]
    head, *tail = text.split(mark)
    parts = [p for p in [head, *[mark + t for t in tail]] if p]
    out: list[str] = []
    window: list[str] = []
    length = 0

    def flush() -> None:
        if (joined := "".join(window).strip()):
            out.append(joined)

    for part in parts:
        if len(part) >= size:
            flush()
            window, length = [], 0
            out += split_text(part, size, overlap, rest)
            continue
        if window and length + len(part) > size:
            flush()
            while window and (length > overlap or length + len(part) > size):
                length -= len(window.pop(0))
        window.append(part)
        length += len(part)
    flush()
    return out


def recursive(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """source_id, chunk_index (from 0), total_chunks, text of columns source_id, text; empty texts give no chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["source_id"], pa.array([split_text(t.as_py() or "", size, overlap) for t in batch["text"]], pa.list_(pa.string()))], names=["source_id", "parts"])

    parts = docs.select(F.col("source_id").cast("string").alias("source_id"), "text").mapInArrow(cut, "source_id string, parts array<string>")
    return parts.select("source_id", F.posexplode("parts").alias("chunk_index", "text"), F.size("parts").alias("total_chunks"))


def fixed(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The same with windows of a fixed stride, all in expressions."""
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / stride).cast("int"))
    rows = docs.where(F.length("text") > 0).select("source_id", "text", F.explode(starts).alias("chunk_index"), F.size(starts).alias("total_chunks"))
    return rows.select("source_id", "chunk_index", "total_chunks", F.substring(F.col("text"), F.col("chunk_index") * stride + 1, F.lit(size)).alias("text"))


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """The texts of `fixed` as an array, empty for an empty text, null for none. The text is worked out once, not for
    each of its windows."""
    stride = size - overlap

    def cut(t: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.length(t) - 1) / stride).cast("int"))
        return F.when(F.length(t) > 0, F.transform(starts, lambda k: F.substring(t, k * stride + 1, F.lit(size)))).when(t.isNotNull(), F.array().cast("array<string>"))

    return once(text, cut)


def number(chunks: DataFrame, order: str) -> DataFrame:
    """Adds chunk_index (from 0, by `order`) and total_chunks within source_id; a missing source is 'unknown'."""
    # rows are sorted by range, so that a source of any size is dealt over tasks; a row's number is its place in its
    # partition and the count of its source's rows in the partitions before
    named = chunks.withColumn("source_id", F.coalesce("source_id", F.lit("unknown")))
    placed = named.repartitionByRange("source_id", order).sortWithinPartitions("source_id", order).withColumn("_row", F.monotonically_increasing_id())
    placed = stored(placed, "placed").withColumn("_part", F.shiftright("_row", 33))
    runs = placed.groupBy("source_id", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy("source_id")  # a row for each partition that a source is in
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("source_id", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("_total"))
    out = placed.join(runs, ["source_id", "_part"]).withColumn("chunk_index", F.col("_row") + F.col("_shift")).withColumn("total_chunks", F.col("_total"))
    return out.drop("_row", "_part", "_shift", "_total")


def rebuild(chunks: DataFrame, ranked: DataFrame, n: int = 3) -> DataFrame:
    """query_id, source_id, rank, score, text: the first n distinct sources of each query's ranked rows (query_id,
    source_id, rank, score), all their chunks in order, with the best row's score."""
    best = ranked.groupBy("query_id", "source_id").agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"))
    first = Window.partitionBy("query_id").orderBy("rank", "source_id")
    few = best.withColumn("place", F.row_number().over(first)).where(F.col("place") <= n).drop("place")
    needed = chunks.join(few.select("source_id").distinct(), "source_id", "left_semi")
    whole = needed.groupBy("source_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return few.join(whole, "source_id").select("query_id", "source_id", "rank", "score", "text")
