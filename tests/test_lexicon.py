"""The automaton against patterns and the join; numbering against a plain count."""

import random

import pytest
from pyspark.sql import functions as F

from lanternmill.operators import chunks, lexicon, scope


def found(df):
    return sorted((r.id, r.term) for r in df.collect())


def test_automaton_equals_patterns_and_the_join(spark):
    terms = ["La Plata", "la plata", "Córdoba", "cordoba", "UNLP", "in", "on in", "c++", "a-b", "ñu", "x", "La  Plata", " rio ", "", None]
    texts = ["Voy a LA PLATA, a Cordoba y a CÓRDOBA.", "unlpx UNLP_ xUNLP (UNLP)", "on in the river", "onin in on", "c++ c+++ ac++", "a-b-a", "á x́ ÑU", "La  Plata la plata", "rio", "x‿x x", "", None, "日x本", "²x x²"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id long, text string, term string").repartition(3)
    frame = spark.createDataFrame([(t,) for t in terms], "term string")
    want = sorted({(r.id, t) for r in docs.select("id", scope.find_terms(F.col("text"), [t.strip() for t in terms if t and t.strip()]).alias("f")).collect() for t in r.f or []})
    got = [(i, t.strip()) for i, t in found(lexicon.match(docs, frame))]
    assert sorted(set(got)) == want and len(want) > 15
    assert found(lexicon.match(docs, frame, term_bytes=0)) == found(scope.match_lexicon(docs, frame))
    assert found(lexicon.match(docs, frame.limit(0))) == [] == found(lexicon.match(docs.limit(0), frame))


def test_ten_thousand_terms(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeáñ") for _ in range(r.randint(2, 4)))
    terms = {" ".join(word() for _ in range(r.choice((1, 1, 2, 3)))) for _ in range(24_000)}
    assert len(terms) > 10_000
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(r.randint(0, 80)))) for i in range(60)] + [(99, "aa bb " * 20_000)], "id long, text string")
    frame = spark.createDataFrame([(t,) for t in terms], "term string")
    got = found(lexicon.match(docs, frame))
    assert got == found(scope.match_lexicon(docs, frame)) and len(got) > 500


@pytest.mark.parametrize("hot", [0, 3000])
def test_numbering(spark, hot):
    rows = [(f"s{i % 7}", i) for i in range(300)] + [(None, 1000 + i) for i in range(hot)] + [("unknown", 9)]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "source_id string, at long, total_chunks int").repartition(5)
    got = chunks.number(frame, "at").collect()
    want, seen = {}, {}
    for s, at in sorted(((s or "unknown", at) for s, at in rows), key=lambda x: x):
        want[(s, at)] = seen.get(s, 0)
        seen[s] = seen.get(s, 0) + 1
    assert {(r.source_id, r.at): r.chunk_index for r in got} == want and all(r.total_chunks == seen[r.source_id] for r in got) and len(got) == len(rows)


def test_no_window_over_a_source(spark):
    frame = spark.createDataFrame([("s", i) for i in range(50)], "source_id string, at long")
    plan = chunks.number(frame, "at")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "_part" in plan


def test_few_terms_go_to_the_texts(spark, monkeypatch):
    """One join, with the terms broadcast: no text is joined with what was found in it."""
    docs = spark.createDataFrame([(1, "La Plata, y en  la plata"), (1, "el río"), (2, "aplata"), (None, "LA PLATA"), (3, None)], "id long, text string")
    terms = spark.createDataFrame([("la plata",), ("La Plata",), ("rio",), (" ",), (None,)], "term string")
    few = scope.match_lexicon(docs, terms)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "broadcast" in plan
    got = sorted(map(repr, few.collect()))
    monkeypatch.setattr(scope, "BROADCAST_TERMS", 0)
    assert got == sorted(map(repr, scope.match_lexicon(docs, terms).collect())) and len(got) == 5
