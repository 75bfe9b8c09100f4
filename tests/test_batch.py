"""The best documents of many questions, in batches, against the search that has a row for each pair."""

import pytest
from pyspark.sql import functions as F

from lanternmill.operators import batch
from lanternmill.operators import retrieval as R
from tests.test_index import QUESTIONS, corpus, rows


@pytest.mark.parametrize("kind", ["long", "string"])
def test_best_equals_bm25(spark, monkeypatch, kind):
    """Blocks, batches of questions, and terms inside and outside of the product of matrices."""
    for name, value in (("QUERIES", 3), ("DOCS", 64), ("TOGETHER", 2), ("COMMON", 5)):
        monkeypatch.setattr(batch, name, value)
    docs = spark.createDataFrame(corpus(300), "id long, text string").withColumn("id", F.col("id").cast(kind))
    asked = spark.createDataFrame(QUESTIONS, "query_id long, text string")
    for k in (3, 400):
        want = rows(R.top(R.bm25(docs, asked), k))
        assert rows(batch.bm25_top(docs, asked, k)) == want and len(want) > k
    assert rows(batch.bm25_top(docs, asked.limit(0), 3)) == [] == rows(batch.bm25_top(docs.limit(0), asked, 3))


def test_scores_of_zero_and_parts(spark):
    """A term in half of the documents has weight 0: its documents are found, others are not. Each question has its part."""
    docs = spark.createDataFrame([(p, i, "mitad" if i % 2 else "otra") for p in ("a", "b") for i in range(8 if p == "a" else 7)], "part string, id long, text string")
    asked = spark.createDataFrame([(0, "a", "mitad"), (1, "b", "mitad otra"), (2, "c", "mitad")], "query_id long, part string, text string")
    got = rows(batch.bm25_top(docs, asked, 9))
    assert got == rows(R.top(R.bm25(docs, asked), 9))
    assert [r[2] for r in got if r[0] == 0] == [1, 3, 5, 7] and {r[0] for r in got} == {0, 1}


def test_shuffles_the_best_alone(spark):
    """No row a pair leaves a task: before, each question had a row for each document with one of its words."""
    docs = spark.range(3000).select("id", F.concat(F.lit("comun palabra"), F.col("id").cast("string")).alias("text")).repartition(2)
    asked = spark.range(50).select(F.col("id").alias("query_id"), F.concat(F.lit("comun palabra"), F.col("id").cast("string")).alias("text"))
    best = batch.bm25_top(docs, asked, 2)
    assert len(best.collect()) == 100
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") and "HashAggregate" not in plan


def test_zeros_work_scores_out_once(spark):
    from pyspark.sql import functions as F

    from lanternmill.operators import retrieval

    scores = spark.range(12345).where("id >= 2").select(F.lit(0).cast("long").alias("query_id"), "id", (-F.col("id")).cast("double").alias("score"))
    docs, asked = spark.range(20000).select("id"), spark.createDataFrame([(0,), (1,)], "query_id long")
    filled = retrieval.with_zeros(scores, docs, asked, 2)
    assert filled._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 12345") == 1
    got = {(r.query_id, r.id): r.score for r in filled.where("id < 4").collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (0, 2): -2, (0, 3): -3, (1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): 0}


def test_reranking_of_found_texts(spark):
    from lanternmill.operators import retrieval

    docs = spark.createDataFrame([(1, "huelga portuaria"), (2, "huelga"), (3, None), (4, "nunca")], "id long, text string")
    found = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (8, 1), (8, 4)], "query_id long, id long")
    asked = spark.createDataFrame([(7, "huelga portuaria"), (8, "nunca huelga"), (9, "nada")], "query_id long, question string")
    want = retrieval.overlap_rerank(found.join(docs, "id").join(asked, "query_id"), 2)
    got = retrieval.overlap_reranked(found, docs, asked, 2)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and got.count() == 4


@pytest.mark.parametrize("positive", [True, False])
def test_best_of_blocks(monkeypatch, positive):
    """Blocks, parts of them that are scored anew, rows that are dropped, ties and a null id, against all scores."""
    import numpy as np
    import pyarrow as pa

    for name, value in (("DOCS", 50), ("TOGETHER", 7), ("COMMON", 6), ("OFTEN", 0.01), ("AGAIN", 40), ("HELD", 30)):
        monkeypatch.setattr(batch, name, value)
    r = np.random.default_rng(3)
    tf = (r.random((400, 30)) < 1 / np.arange(1, 31)) * r.integers(1, 3, (400, 30))
    asked = r.random((20, 30)) < 0.3
    query, code = np.nonzero(asked)
    df, length = (tf > 0).sum(axis=0), np.full(400, 9)
    w = np.round(np.log(500 / (df + 1)), 1) - (0 if positive else 1.5)
    part = batch.Part(query + 2, code, w[code], df, 400, 9.0)
    assert part.positive == positive and part.terms == 6
    ids = [None, *range(1, 400)]
    scores = batch.rounded((tf * 2.5 / (tf + 1.5)) @ (asked * w).T)
    matched = (tf > 0).astype(int) @ asked.T.astype(int)
    want = {q + 2: sorted((-scores[d, q], d == 0, ids[d], matched[d, q]) for d in range(400) if matched[d, q])[:5] for q in range(20) if asked[q].any()}
    for least in (None, np.array([-np.inf, -np.inf, *[-want[q + 2][-1][0] if q % 2 and q + 2 in want and len(want[q + 2]) == 5 else -np.inf for q in range(20)]])):
        best = batch.Best({"": part}, 22, 5, least)
        for a in range(0, 400, 130):
            doc, own = np.nonzero(tf[a : a + 130])
            best.take("", pa.array(ids[a : a + 130], pa.int64()), doc, own, tf[a : a + 130][doc, own], length[doc])
        got = {}
        for rows in best.out():
            for x in rows.to_pylist():
                got.setdefault(x["query"], []).append((-x["score"] + 0.0, x["id"] is None, x["id"], x["matched"]))
        assert got == {q: [(s + 0.0, *x) for s, *x in v] for q, v in want.items() if v}


def test_a_sample_first(spark, monkeypatch):
    """With scores known from one document in some, the rows are the same, and tasks give fewer."""
    monkeypatch.setattr(batch, "MANY", 100)
    monkeypatch.setattr(batch, "SAMPLE", 4)
    docs = spark.createDataFrame(corpus(900), "id long, text string").repartition(8)
    asked = spark.createDataFrame(QUESTIONS, "query_id long, text string")
    assert rows(batch.bm25_top(docs, asked, 6)) == rows(R.top(R.bm25(docs, asked), 6))
    given = []
    monkeypatch.setattr(batch, "top", lambda scores, k: given.append(scores.count()) or R.top(scores, k))
    batch.bm25_top(docs, asked, 6)
    whole = given[-1]
    monkeypatch.setattr(batch, "MANY", 1 << 15)
    batch.bm25_top(docs, asked, 6)
    assert whole < given[-1]


def test_thousands_of_questions_cut_the_texts_once(spark):
    """Before, each 4,096 questions cut all texts into words twice more."""
    docs = spark.range(200).select("id", F.concat(F.lit("comun palabra"), F.col("id").cast("string")).alias("text"))
    asked = spark.range(9000).select(F.col("id").alias("query_id"), F.concat(F.lit("palabra"), (F.col("id") % 300).cast("string")).alias("text"))
    best = batch.bm25_top(docs, asked, 2)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("regexp_extract_all") <= 2  # one of each kind of text
    assert best.count() == 6000


def test_reranking_by_matched_words(spark):
    """The words that a document has of a question come with the search; before, found texts were cut once more."""
    from lanternmill.operators import retrieval

    docs = spark.createDataFrame([(1, "huelga portuaria rosario"), (2, "huelga huelga"), (3, None), (4, "nunca Huélga")], "id long, text string")
    asked = spark.createDataFrame([(7, "huelga portuaria huelga falta"), (8, "nunca huelga"), (9, "de la"), (10, "nada")], "query_id long, question string")
    found = batch.bm25_top(docs, asked.withColumnRenamed("question", "text"), 3, matched=True)
    want = retrieval.overlap_reranked(found, docs, asked, 2)
    got = retrieval.matched_reranked(found, asked, 2)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and got.count() == 4
