"""Quality scores from supervised subword embeddings.

A document is the average of its words' vectors; a word's vector is the average of learned vectors of the word itself
and of its character n-grams, all found by hashing. Word pairs that repeat one word share a vector of their own; other
pairs, mostly seen once, have none. A softmax layer gives the classes. The model is trained by
stochastic gradient descent in numpy. As the layers are linear up to the softmax, a trained model is folded into one
number for each hash bucket, which is all that the scoring tasks get.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Characters above which a word, such as a text without spaces, is read slice by slice and not kept.
LONG = 256
SLICE = 1 << 15


def subwords(word: str, buckets: int, low: int = 3, high: int = 4) -> list[int]:
    """Buckets of a word and of all its character n-grams with the word's ends marked."""
    return [i for ids in slices(word, buckets, low, high) for i in ids]


def slices(word: str, buckets: int, low: int = 3, high: int = 4) -> Iterator[list[int]]:
    """The same in lists of a bounded size."""
    marked = f"<{word}>"
    yield [zlib.crc32(marked.encode("utf-8", "replace")) % buckets]
    if word == SAME:
        return
    for n in range(low, high + 1):
        for at in range(0, len(marked) - n + 1, SLICE):
            yield [zlib.crc32(marked[i : i + n].encode("utf-8", "replace"), n) % buckets for i in range(at, min(at + SLICE, len(marked) - n + 1))]


def long_word(word: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a long word and how often each comes."""
    counts = np.zeros(buckets, np.int64)
    for ids in slices(word, buckets):
        np.add.at(counts, ids, 1)
    found = np.flatnonzero(counts)
    return found.astype(np.int32), counts[found]


#: Stands for a pair of equal words; no text has it as a word.
SAME = " "


def features(text: str | None) -> tuple[list[str], int]:
    """The words of a whole text, and how many follow an equal one."""
    words = text.split() if text else []
    return words, sum(map(operator.eq, words, words[1:]))


@dataclass
class Model:
    weights: np.ndarray  # for each bucket, its share in the log-odds of class 1
    bias: float

    def score(self, text: str | None, words: "WordScores") -> float:
        """Probability of class 1; with no words, that of the bias alone."""
        split, same = features(text)
        z = self.bias + ((sum(map(words.__getitem__, split)) + same * words[SAME]) / len(split) if split else 0.0)
        return float(1 / (1 + np.exp(-z)))


class WordScores(dict):
    """word -> its share in the log-odds; emptied when it has `most` entries."""

    def __init__(self, model: Model, most: int = 500_000):
        super().__init__()
        self.buckets, self.most = len(model.weights), most
        self.weights = model.weights.tolist()

    def __missing__(self, word: str) -> float:
        if len(word) > LONG:
            total, n = 0.0, 0
            for ids in slices(word, self.buckets):
                total, n = total + sum([self.weights[i] for i in ids]), n + len(ids)
            return total / n
        if len(self) >= self.most:
            self.clear()
        ids = subwords(word, self.buckets)
        weights = self.weights
        got = self[word] = sum([weights[i] for i in ids]) / len(ids)
        return got


def train(texts: list[str], labels: list[int], buckets: int = 1 << 17, dim: int = 8, epochs: int = 8, rate: float = 0.5, seed: int = 7) -> Model:
    """Without both classes in the labels, the model gives their share (0.5 if there are none)."""
    random = np.random.default_rng(seed)
    share = (sum(labels) + 1) / (len(labels) + 2) if labels else 0.5
    bias = float(np.log(share / (1 - share)))
    if len(set(labels)) < 2:
        return Model(np.zeros(buckets, np.float32), bias)
    known: dict[str, np.ndarray] = {}
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for text in texts:
        split, same = features(text)
        counts, total = Counter(split), len(split)
        if same:
            counts[SAME] = same
        parts, weights = [], []
        for word, c in counts.items():
            if len(word) > LONG:
                ids, times = long_word(word, buckets)
                parts.append(ids)
                weights.append((times * (c / (times.sum() * total))).astype(np.float32))
                continue
            ids = known.get(word)
            if ids is None:
                if len(known) > 200_000:
                    known.clear()
                ids = known[word] = np.array(subwords(word, buckets), np.int32)
            parts.append(ids)
            weights.append(np.full(len(ids), c / (len(ids) * total), np.float32))
        if parts:
            ids, at = np.unique(np.concatenate(parts), return_inverse=True)
            rows.append((ids, np.bincount(at, np.concatenate(weights)).astype(np.float32)))
        else:
            rows.append((np.zeros(0, np.int32), np.zeros(0, np.float32)))
    vectors = random.uniform(-0.5 / dim, 0.5 / dim, (buckets, dim)).astype(np.float32)
    out, b = np.zeros((2, dim), np.float32), np.array([-bias / 2, bias / 2], np.float32)
    squares, out_squares, b_squares = np.full(buckets, 1e-6, np.float32), np.full((2, dim), 1e-6, np.float32), np.full(2, 1e-2, np.float32)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for k in random.permutation(len(rows)):
            ids, w = rows[k]
            hidden = w @ vectors[ids]
            z = out @ hidden + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            lr = rate * (1 - step / steps)
            back = p @ out
            g = np.outer(p, hidden)
            out_squares += g * g
            out -= lr * g / np.sqrt(out_squares)
            b_squares += p * p
            b -= 0.1 * lr * p / np.sqrt(b_squares)
            if len(ids):
                squares[ids] += w * w * float(back @ back) / dim
                vectors[ids] -= (lr * w / np.sqrt(squares[ids]))[:, None] * back[None, :]
            step += 1
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(b[1] - b[0]))


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = 4096) -> Model:
    """Trains on at most `max_rows` labelled documents outside the held-out fold, those with the smallest hash of
    doc_id, with their whole texts. Rows without a text, an id or a 0/1 label don't count; of several labels of a
    document, the largest does, and of several texts, the first in order. Without labels or documents, the model gives
    0.5 to all."""
    spark = documents.sparkSession
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out("doc_id"))
    chosen = marked.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()
    if not chosen:
        return train([], [])
    few = spark.createDataFrame([(r.doc_id, r.y) for r in chosen], "doc_id long, y int")  # max_rows rows at most
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(few), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).orderBy("doc_id").collect()  # max_rows rows at most
    return train([r.text for r in rows], [r.y for r in rows])


def held_out(doc_id: str):
    """crc32 of the id's text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts get the score of a text without words."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # one number a bucket: a fixed size

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = WordScores(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array([model.score(t.as_py(), words) for t in batch["text"]], pa.float64())], names=["doc_id", "held_out", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(documents, fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
