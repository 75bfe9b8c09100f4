"""The stored inverted index against the search that cuts every text."""

import random

import pytest
from pyspark.sql import functions as F

from lanternmill.operators import index
from lanternmill.operators import retrieval as R


def corpus(n, seed=0):
    r = random.Random(seed)
    words = [f"palabra{k}" for k in range(40)]
    text = lambda i: " ".join([w for k, w in enumerate(words) for _ in range(r.random() < 1 / (1 + k)) for _ in range(r.randint(1, 4))] + ["raro"] * (i % 211 == 5) + ["nota"])
    return [(i, text(i)) for i in range(n)] + [(n + 1, None), (n + 2, ""), (n + 3, "de la"), (n + 4, "raro " * 9), (n + 5, "raro " * 9)]


QUESTIONS = [(0, "raro palabra0"), (1, "palabra0 palabra1 palabra1"), (2, "nada"), (3, "de la"), (4, "Raro, nota: palabra39"), (5, None), (6, "palabra30 palabra0 raro")]


def rows(df):
    return sorted((r.query_id, r.rank, r.id, r.score) for r in df.collect())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_search_equals_bm25(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(index, "RANGE", 16)
    monkeypatch.setattr(index, "FIRST", 2)
    docs = spark.createDataFrame([(*r, "clash") for r in corpus(700)], "id long, text string, term string").withColumn("id", F.col("id").cast(kind))
    asked = spark.createDataFrame(QUESTIONS, "query_id long, text string")
    index.build(docs, str(tmp_path))
    found = index.Index(spark, str(tmp_path))
    for k in (3, 20):
        want = rows(R.top(R.bm25(docs.select("id", "text"), asked), k))
        assert rows(found.search(asked, k)) == want and len(want) > k
    assert rows(found.search(asked.limit(0))) == []


def test_ranges_that_cannot_matter_are_not_read(spark, tmp_path, monkeypatch):
    """With the k-th score known, blocks of ranges below it stay unread: a rare word decides, a common one is everywhere."""
    monkeypatch.setattr(index, "RANGE", 16)
    index.build(spark.createDataFrame(corpus(4000, 1), "id long, text string"), str(tmp_path))
    found = index.Index(spark, str(tmp_path))
    asked = found.asked(spark.createDataFrame([(0, "raro nota")], "query_id long, text string"))
    folders = [r.folder for r in asked.select("folder").distinct().collect()]
    most = found.bounds(asked, folders)
    _, rest = found.split(asked, folders, most, 5)
    place = most.orderBy(F.desc("most"), "range").limit(index.FIRST).select("query_id", "range").unionByName(rest)
    sizes = found._table("blocks", folders).join(asked.select("folder", "term", "query_id"), ["folder", "term"])
    read, whole = (x.agg(F.sum("size")).first()[0] for x in (sizes.join(place, ["query_id", "range"]), sizes))
    assert whole > 4000 and read < whole / 4


def test_a_search_opens_the_folders_of_its_terms(spark, tmp_path):
    index.build(spark.createDataFrame(corpus(50), "id long, text string"), str(tmp_path))
    plan = index.Index(spark, str(tmp_path))._table("blocks", [3]).select("term", "best")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "docs" not in plan


def test_an_index_without_documents(spark, tmp_path):
    index.build(spark.createDataFrame([], "id long, text string"), str(tmp_path))
    assert rows(index.Index(spark, str(tmp_path)).search(spark.createDataFrame(QUESTIONS, "query_id long, text string"))) == []
    index.build(spark.createDataFrame([(1, "raro")], "id long, text string"), str(tmp_path))
    assert [r[2] for r in rows(index.Index(spark, str(tmp_path)).search(spark.createDataFrame(QUESTIONS[:1], "query_id long, text string")))] == [1]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_many_questions_read_each_block_once(spark, tmp_path, monkeypatch, kind):
    """Batches of questions over ranges: the rows of the search by ranges, without a row a question and range."""
    monkeypatch.setattr(index, "RANGE", 16)
    monkeypatch.setattr(index.batch, "QUERIES", 4)
    docs = spark.createDataFrame(corpus(300), "id long, text string").withColumn("id", F.col("id").cast(kind))
    asked = spark.createDataFrame(QUESTIONS, "query_id long, text string")
    index.build(docs, str(tmp_path))
    found = index.Index(spark, str(tmp_path))
    want = rows(found.search(asked, 3))
    monkeypatch.setattr(index, "FEW_QUERIES", 0)
    monkeypatch.setattr(index.Index, "bounds", None)
    assert rows(found.search(asked, 3)) == want and len(want) > 3
