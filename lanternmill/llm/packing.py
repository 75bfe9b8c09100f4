"""Best-fit packing of documents into sequences, with a certificate for each partition.

A partition of items is packed by best-fit decreasing. Dual-feasible functions bound from below how many sequences
any packing of these items needs; a partition that meets its bound is done. The others put the items of their
emptiest sequences into common pools, which are packed anew; a pool is kept only if it saves sequences. So a round
never makes the packing worse, and the sum of certificates says how far it can be from the best.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternmill.llm import scratch
from lanternmill.llm.tokens import default_path, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def lower_bound(lengths: np.ndarray, capacity: int) -> float:
    """The largest bound of a family of dual-feasible functions, not rounded: no packing needs fewer sequences than
    its ceiling. Lengths are 1 to capacity."""
    if not len(lengths):
        return 0.0
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = float((n * x).sum()) / capacity
    for k in range(1, 33):  # x (k + 1) whole: x itself, else rounded down to a k-th
        scaled = x * (k + 1)
        f = np.where(scaled % capacity == 0, x / capacity, (scaled // capacity) / k)
        best = max(best, float((n * f).sum()))
    count, size = np.cumsum(n), np.cumsum(n * x)
    for k in range(0, capacity // 2 + 1):  # items over capacity - k count whole, those under k not at all
        large = count[-1] - count[capacity - k]
        below = k - 1 if k else 0
        middle = size[capacity - k] - size[below]
        best = max(best, float(large) + float(middle) / capacity)
    half = capacity // 2
    return max(best, float(count[-1] - count[half]))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence of each item from 0, offset in it): the longest first, each into the fullest sequence it fits."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by room left
    some, opened = 0, 0  # bit r of some: free[r] isn't empty
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        fits = some >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            s = free[room].pop()
            if not free[room]:
                some &= ~(1 << room)
        else:
            room, s, opened = capacity, opened, opened + 1
        sequence[i], offset[i] = s, capacity - room
        if room := room - length:
            free[room].append(s)
            some |= 1 << room
    return sequence, offset


def pieces(documents: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer_path: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of every whole text and its end id (null text: empty), and
    the columns named.

    Only documents over the capacity are cut; their first piece takes the remainder. Partitions are kept.
    """
    path = tokenizer_path or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), end_id.to_bytes(4, "little")
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[None] * len(keys))
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, *own in zip(batch["doc_id"].to_pylist(), batch["text"], *[batch[k].to_pylist() for k in keys]):
                ids = encode.encode(text.as_py()) + end
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = (n % capacity or min(n, capacity)) if start == 0 else capacity
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), *own))
                    start, piece = start + length, piece + 1
            for at in range(0, len(rows), 20_000):
                columns = list(zip(*rows[at : at + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", *keys])

    types = dict(documents.dtypes)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keys).mapInArrow(cut, ", ".join([PIECES, *[f"{k} {types[k]}" for k in keys]]))


def _packed(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Columns uid, length -> uid, length, sequence_id, offset, fill, bound, sequences."""
    frame = frame.sort_values("uid", kind="stable").reset_index(drop=True)
    lengths = frame["length"].to_numpy(np.int64)
    sequence, offset = best_fit_decreasing(lengths, capacity)
    n = int(sequence.max()) + 1 if len(sequence) else 0
    first = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, sequence, frame["uid"].to_numpy(np.int64))
    fill = np.bincount(sequence, weights=lengths, minlength=n).astype(np.int64)
    return pd.DataFrame({"uid": frame["uid"], "length": lengths, "sequence_id": first[sequence] * 2 + 1, "offset": offset, "fill": fill[sequence], "bound": lower_bound(lengths, capacity), "sequences": n})


STATE = "uid long, length long, sequence_id long, offset long, fill long, bound double, sequences long, shard long"


def _ranked(items: DataFrame, order: list[str]) -> DataFrame:
    """uid, length and the rank from 0 by columns: a range partitioning, and one offset for each of its partitions."""
    placed = items.repartitionByRange(*order).sortWithinPartitions(*order).select("uid", "length", F.monotonically_increasing_id().alias("row"))
    placed = scratch.saved(placed, "ranked")
    part = F.shiftright("row", 33)
    before, runs = 0, []
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row a partition
        runs.append((r.part, before))
        before += r.n
    runs = items.sparkSession.createDataFrame(runs, "part long, before long")
    within = F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(F.broadcast(runs), "part").select("uid", "length", (within + F.col("before")).alias("rank"))


def pack(items: DataFrame, capacity: int = 1024, shard_items: int = 32_768, rounds: int = 3, fan: int = 16, in_order: list[str] | None = None) -> DataFrame:
    """uid, sequence_id, offset for items (uid unique, length 1 to capacity - 1).

    Items are dealt to shards of about `shard_items`; with `in_order`, at every size, a shard holds a range by these
    columns, so a sequence takes neighbours, and a pool takes neighbouring shards. A shard or pool leaves the exchange once it meets
    its bound. Otherwise its emptiest sequences, at most shard_items / fan items, join a pool of up to `fan` shards; so
    no task ever holds more than about 2 x shard_items items. An empty table gives an empty result.
    """
    spark = items.sparkSession
    n = items.count()
    shards = max(1, math.ceil(n / shard_items))
    if in_order and shards > 1:
        items, shard = _ranked(items, in_order), F.expr(f"rank div {math.ceil(n / shards)}")
    else:
        shard = F.pmod(F.xxhash64("uid"), F.lit(shards))

    def first(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _packed(frame, capacity).assign(shard=int(key[0]))

    done: list[DataFrame] = []
    state = scratch.saved(items.select("uid", F.col("length").cast("long").alias("length"), shard.cast("long").alias("shard")).groupBy("shard").applyInPandas(first, STATE), "packed")
    share = max(1, shard_items // fan)

    def give(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """Marks the items of the emptiest sequences that leave for the pool."""
        bins = frame.groupby("sequence_id").agg(fill=("fill", "first"), items=("uid", "size")).reset_index()
        bins = bins[bins["fill"] < capacity].sort_values(["fill", "sequence_id"])
        leaving = set(bins["sequence_id"][bins["items"].cumsum() <= share])
        return frame.assign(leaves=frame["sequence_id"].isin(leaving))

    def again(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        new = _packed(frame[["uid", "length"]], capacity)
        if new["sequence_id"].nunique() >= frame["sequence_id"].nunique():
            new = frame.drop(columns=["pool"])
            new = new.assign(bound=lower_bound(frame["length"].to_numpy(np.int64), capacity), sequences=frame["sequence_id"].nunique())
        return new.assign(shard=int(key[0]))[[c.split()[0] for c in STATE.split(", ")]]

    for r in range(rounds):
        # a shard of over one sequence more than its unrounded bound may gain; alone, one less than one sequence can't
        open_shards = state.where("sequences - bound > 1e-9").select("shard").distinct().count()
        if open_shards < 2:
            break
        at_least = F.col("sequences") - F.col("bound") > 1e-9
        marked = scratch.Saved(state.where(at_least).groupBy("shard").applyInPandas(give, STATE + ", leaves boolean"), "marked")
        done += [state.where(~at_least), marked.df.where("not leaves").drop("leaves")]
        pools = max(1, math.ceil((shards if in_order else open_shards) / fan))
        pool = F.expr(f"shard div {fan}") if in_order else F.pmod(F.xxhash64(F.col("shard") + F.lit(7919 * r)), F.lit(pools))
        pooled = marked.df.where("leaves").drop("leaves").withColumn("pool", pool)
        state = scratch.saved(pooled.groupBy("pool").applyInPandas(again, STATE), "packed")
        shards = pools
        if pools == 1:
            break
    out = state
    for d in done:
        out = out.unionByName(d)
    return out.select("uid", "sequence_id", "offset")


def pack_documents(documents: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer_path: str | None = None, in_order: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null doc_id stays null, rows that repeat a doc_id are packed each on its own, extra columns are not read. Full
    pieces fill a sequence alone. Sequence numbers are odd for packed sequences, even for full pieces. With `in_order`,
    sequences take neighbours by the files and rows of documents, in whatever order Spark reads them.
    """
    from lanternmill.llm.simhash_texts import ROW, with_row_keys

    order = ROW if in_order else []
    documents = with_row_keys(documents) if in_order else documents
    cut = scratch.saved(pieces(documents, capacity, end_id, tokenizer_path, tuple(order)).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    whole = F.col("length") == capacity
    placed = pack(cut.where(~whole).select("uid", "length", "start", *order), capacity, in_order=[*order, "start"] if in_order else None)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = cut.where(whole).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("uid") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(cut.where(~whole).join(placed, "uid").select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
