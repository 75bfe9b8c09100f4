"""Connected components by randomised contraction.

Each round gives every node a random rank, joins it to the lowest-ranked node among itself and its neighbours, and
keeps the links between what is left. A constant share of the nodes goes in each round, whatever the shape (long
paths, large stars), so the rounds grow with the logarithm of the input. All steps are joins and aggregates with
partial sums; nothing is gathered by node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternmill.llm import scratch

#: So many links are finished in one task, which bounds its memory; more go through another round.
LAST_LINKS = 16_384


def find_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of n nodes, by links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(deeper := label[label], label):
            label = deeper
        if np.array_equal(label, before):
            break
        open_links = label[a] != label[b]
        a, b = a[open_links], b[open_links]
    return label


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    a, b = table["a"].to_numpy(), table["b"].to_numpy()
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = nodes[find_roots(at[: len(a)], at[len(a) :], len(nodes))]
    yield pa.RecordBatch.from_pydict({"node": nodes, "root": root})


def components(links: DataFrame, last_links: int = LAST_LINKS) -> DataFrame:
    """node, root (both long) for every node of a link; links has long columns a and b.

    Nodes of one component share a root, which is one of them. Null ends and links from a node to itself are left out.
    """
    ends = links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = scratch.Saved(ends.distinct(), "links")
    labels: scratch.Saved | None = None
    r = 0
    while (n := now.df.count()) > last_links:
        rank = lambda c, r=r: F.struct(F.xxhash64(F.lit(r), F.col(c)).alias("rank"), F.col(c).alias("id"))
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = scratch.Saved(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", rank("a"))["id"].alias("to")), "step")
        ends = now.df.join(step.df.toDF("a", "ta"), "a").join(step.df.toDF("b", "tb"), "b")
        nxt = scratch.Saved(ends.where("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
        if labels is None:
            labels = scratch.Saved(step.df.toDF("node", "root"), "labels")
        else:
            old = labels
            labels = scratch.Saved(old.df.join(step.df.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
            old.drop()
        step.drop()
        now.drop()
        now, r = nxt, r + 1
    if n == 0:
        return labels.df if labels else now.df.toDF("node", "root")
    last = now.df.coalesce(1).mapInArrow(_finish, "node long, root long")
    if labels is None:
        return last
    return labels.df.join(last.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
