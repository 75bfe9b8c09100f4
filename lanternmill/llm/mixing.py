"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks. While its sources last, a mix gives each of them its share of every stretch; the
ideal (fluid) mix serves all at once, and block k of a source is served between the slots where the source's ideal
service is k and k + 1. Rounded outwards, these are the block's release and deadline. Earliest-deadline-first over
the released blocks meets every deadline, so at each slot a source is less than one block from its ideal. When a
source has run out, the others share its part in proportion to their weights; every document is placed exactly once.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternmill.llm import scratch

#: What a slot may be off by rounding of doubles.
_EPS = 1e-7


class Fluid:
    """The ideal mix: slot(v) is how much it has served when each lasting source has had v times its weight."""

    def __init__(self, blocks: list[int], weights: list[float]):
        ends = sorted((n / w, w) for n, w in zip(blocks, weights))
        self.at, self.served, self.rate = [0.0], [0.0], []
        rate = sum(weights)
        for v, w in ends:
            self.rate.append(rate)
            self.served.append(self.served[-1] + rate * (v - self.at[-1]))
            self.at.append(v)
            rate = max(0.0, rate - w)
        self.rate.append(0.0)

    def slot(self, v: float) -> float:
        k = max(0, bisect_left(self.at, v) - 1)
        return self.served[k] + self.rate[min(k, len(self.rate) - 1)] * (v - self.at[k])


def schedule(blocks: list[int], weights: list[float]) -> Iterator[tuple[int, int]]:
    """(source, block) for slots 0, 1, ...; ties of deadlines go to the first source. Holds one block a source."""
    fluid = Fluid(blocks, weights)
    ready: list[tuple[int, int, int]] = []
    later: list[tuple[int, int, int]] = []

    def put(s: int, k: int) -> None:
        if k < blocks[s]:
            heapq.heappush(later, (math.floor(fluid.slot(k / weights[s]) + _EPS), s, k))

    for s in range(len(blocks)):
        put(s, 0)
    for t in range(sum(blocks)):
        while later and (later[0][0] <= t or not ready):
            _, s, k = heapq.heappop(later)
            heapq.heappush(ready, (math.ceil(fluid.slot((k + 1) / weights[s]) - _EPS), s, k))
        _, s, k = heapq.heappop(ready)
        yield s, k
        put(s, k + 1)


def mix(documents: DataFrame, weights: dict[str, float] | None = None, block_docs: int = 256, power: float = 0.5) -> DataFrame:
    """doc_id, source, block, slot, position of every row.

    Weights are target shares by source, scaled to 1; sources without one, or all where none are given, get their
    number of documents to `power`, in the same scale as the rest. A null source counts as ''. Within a source, rows
    keep the order of doc_id (nulls first; ties in any order), block_docs to a block. A weight of 0 or less is an error. Positions ascend with the mix and
    skip what a source's last block lacks. An empty table gives no rows; extra columns aren't read.

    Ranks within a source come from a range partitioning and one offset for each source and partition, so a hot source
    is spread over many tasks. The schedule is one stream from the sources' block counts alone: its state is a block a
    source, and larger blocks make it shorter.
    """
    spark = documents.sparkSession
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"))
    narrow = narrow.repartitionByRange("source", F.col("doc_id").asc_nulls_first()).sortWithinPartitions("source", F.col("doc_id").asc_nulls_first())
    placed = scratch.saved(narrow.withColumn("row", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("row", 33)
    runs = placed.groupBy("source", part.alias("part")).agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = scratch.saved(runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "runs")
    totals = sorted((r.source, r.n) for r in runs.groupBy("source").agg(F.sum("n").alias("n")).collect())  # a row a source
    names = [s for s, _ in totals]
    given = weights or {}
    guess = {s: n**power for s, n in totals if s not in given}
    scale = sum(given.get(s, 0.0) for s in names) / max(1e-300, sum(n**power for s, n in totals if s in given)) if any(s in given for s in names) else 1.0
    shares = [given[s] if s in given else guess[s] * scale for s in names]
    if any(w <= 0 for w in shares):
        raise ValueError("weights must be over 0")
    total = sum(shares)
    shares, blocks = [w / total for w in shares], [-(-n // block_docs) for _, n in totals]

    def slots(_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in _:
            pass
        at, rows = 0, []
        for s, k in schedule(blocks, shares):
            rows.append((names[s], k, at))
            at += 1
            if len(rows) == 50_000:
                yield pd.DataFrame(rows, columns=["source", "block", "slot"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["source", "block", "slot"])

    timetable = scratch.saved(spark.range(1, numPartitions=1).mapInPandas(slots, "source string, block long, slot long"), "slots")
    ranked = placed.withColumn("part", part).join(runs, ["source", "part"]).withColumn("rank", F.col("row") - F.col("first") + F.col("before"))
    ranked = ranked.select("doc_id", "source", F.expr(f"rank div {block_docs}").alias("block"), (F.col("rank") % block_docs).alias("within"))
    joined = ranked.join(timetable, ["source", "block"])
    return joined.select("doc_id", "source", "block", "slot", (F.col("slot") * block_docs + F.col("within")).alias("position"))


def in_mixed_order(documents: DataFrame, **options) -> DataFrame:
    """All rows and columns of documents, laid out in the order of the mix: saved, the names of files and the rows in
    them ascend with it. (Spark may read files in another order; simhash_texts.with_row_keys and packing in order go by
    file and row.) Rows that repeat a doc_id stay next to each other; null texts and sources are rows like any other; an
    empty table stays empty."""
    places = mix(documents, **options).groupBy("doc_id").agg(F.min("position").alias("position"))
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), scratch.whole_row(documents).alias("row"))
    joined = rows.join(places, F.col("id").eqNullSafe(F.col("doc_id")), "left")
    return joined.repartitionByRange("position").sortWithinPartitions("position").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
