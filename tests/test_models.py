"""Models: asked once a text, in batches, tried again, failures as a column; in reranking and in the index."""

import json

from pyspark.sql import functions as F

from lanternmill.operators import archive, models
from lanternmill.operators.scope import Lexicon


def noting(path, fails=lambda prompts, calls: False):
    """A model that writes down what it is asked, and answers with the prompt's length."""

    def load():
        def run(prompts):
            with open(path, "a") as f:
                f.write(json.dumps(prompts) + "\n")
            with open(path) as f:
                calls = sum(1 for _ in f)
            if fails(prompts, calls):
                raise RuntimeError("out of order")
            return [str(len(p)) for p in prompts]

        return run

    return load


def noted(path):
    return [json.loads(x) for x in open(path)] if path.exists() else []


def asked(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "key string, prompt string, answer string").repartition(2)


def answers(df):
    return {r.key: (r.answer, r.error) for r in df.collect()}


def test_each_text_is_asked_once(spark, tmp_path):
    log, cache = tmp_path / "log", str(tmp_path / "cache")
    model = models.Model("once", noting(log), batch=4)
    rows = [(f"k{i % 10}", "x" * (i % 10)) for i in range(50)] + [("none", None)]
    want = {f"k{i}": (str(i), None) for i in range(10)} | {"none": ("0", None)}
    first = models.ask(asked(spark, rows), model, cache)
    assert answers(first) == want and answers(first) == want and first.count() == 11
    prompts = [p for call in noted(log) for p in call]
    assert len(prompts) == 11 and max(map(len, noted(log))) <= 4
    again = models.ask(asked(spark, [*rows, ("new", "abc")]), model, cache)
    assert answers(again) == want | {"new": ("3", None)} and [p for call in noted(log) for p in call][11:] == ["abc"]
    other = models.ask(asked(spark, rows[:1]), models.Model("other", noting(log)), cache)
    assert answers(other) == {"k0": ("0", None)} and len([p for call in noted(log) for p in call]) == 13
    assert answers(models.ask(asked(spark, []), model, cache)) == {} == answers(models.ask(asked(spark, []), model))


def test_a_bad_prompt_costs_itself_alone(spark, tmp_path):
    log, cache = tmp_path / "log", str(tmp_path / "cache")
    model = models.Model("picky", noting(log, lambda prompts, _: "bad" in prompts), batch=8, tries=2, pause=0.01)
    rows = [(f"k{i}", f"p{i}") for i in range(5)] + [("kb", "bad")]
    got = answers(models.ask(asked(spark, rows), model, cache))
    assert got["kb"] == (None, "RuntimeError: out of order") and all(got[f"k{i}"] == ("2", None) for i in range(5))
    before = len(noted(log))
    assert answers(models.ask(asked(spark, rows), model, cache)) == got
    assert [c for c in noted(log)[before:]] == [["bad"], ["bad"]]  # failures aren't kept, and are tried again


def test_a_try_is_repeated(spark, tmp_path):
    log = tmp_path / "log"
    model = models.Model("shaky", noting(log, lambda _, calls: calls < 3), tries=3, pause=0.01)
    assert answers(models.ask(asked(spark, [("a", "12345")]), model)) == {"a": ("5", None)} and len(noted(log)) == 3


def test_rerank_and_its_failure(spark, tmp_path):
    score = lambda: lambda prompts: [str(len(json.loads(p)[1])) if json.loads(p)[1] != "odd" else "no number" for p in prompts]
    rows = [(1, i, i, "q", "t" * n) for i, n in enumerate((3, 9, 1, 9))] + [(2, i, i, "q", t) for i, t in enumerate(("aa", "odd", "a", "aaaa"))] + [(3, 7, 0, None, None)]
    frame = spark.createDataFrame(rows, "query_id long, id long, position long, question string, text string")
    got = models.rerank(frame, models.Model("length", score), 3).orderBy("query_id", "rerank_position").collect()
    assert [(r.query_id, r.id, r.rerank_score, r.error is None) for r in got] == [(1, 1, 9.0, True), (1, 3, 9.0, True), (1, 0, 3.0, True), (2, 0, None, False), (2, 1, None, False), (2, 2, None, False), (3, 7, 0.0, True)]


def test_all_layers_reach_the_index(spark, tmp_path):
    """A lexicon, anchors and a model: what each of them says is in the rows that are stored."""
    from lanternmill.functions.labels import embed

    near, far, open_ = "gol del equipo en la cancha grande ", "tratado de comercio con otros paises del norte ", "algo que nadie sabe bien donde pasa ni cuando "
    rows = [("u1", "la universidad de La Plata y sus aulas " * 6), ("u2", near * 6), ("u3", far * 6), ("u4", open_ * 6), ("u5", "corto")]
    docs = spark.createDataFrame([(i, "t", None, "d", "2002-05-06", t) for i, t in rows], "source_id string, title string, section string, newspaper string, published string, text string")
    vector = lambda t: list(map(float, spark.range(1).select(embed(F.lit(t)).alias("v")).first().v))
    anchors = {"argentina": [vector(near)], "international": [vector(far)], "unknown": [[1.0] + [0.0] * 63]}
    log = tmp_path / "log"
    model = models.Model("label", lambda: lambda prompts: ["Argentina." for _ in prompts])
    ask = lambda texts: models.ask(texts, model, str(tmp_path / "cache"))
    enriched = archive.enrich(docs, Lexicon(locations=["La Plata"]), anchors=anchors, ask=ask, model="label")
    got = {r.source_id: r for r in archive.index(enriched, "all").collect()}
    assert set(got) == {"u1", "u2", "u3", "u4", "u5"} and all(len(r.vector) == 64 for r in got.values())
    assert got["u1"].scope_signals == ["gazetteer:La Plata"] and got["u1"].country_scope == "argentina"
    assert got["u2"].country_scope == "argentina" and got["u2"].scope_signals[0].startswith("emb_arg:1.000")
    assert got["u3"].article_country_scope == "international"
    assert got["u4"].country_scope == "argentina" and got["u4"].scope_signals[-1] == "llm_local:label:argentina" and got["u4"].article_country_scope == "argentina"
    assert got["u5"].country_scope == "unknown" and not noted(log)
    alone = archive.index(archive.enrich(docs, Lexicon(locations=["La Plata"]), ask=ask, model="label"), "all").where("source_id = 'u4'").first()
    assert alone.scope_signals == ["llm_local:label:argentina"] and alone.article_country_scope == "unknown"  # one word of a model is not enough


def test_rows_that_no_model_is_asked_for_are_dealt(spark):
    """Texts that the lexicon decides have no key; they are not all one task's."""
    from pyspark.sql import functions as F

    from lanternmill.operators import scope

    rows = spark.range(400).select("id", F.concat(F.lit("en la plata " + "x" * 150), F.col("id").cast("string")).alias("text"), F.lit("s").alias("section"), F.array().cast("array<string>").alias("organizations"), F.lit(None).cast("array<double>").alias("vector"))
    ask = lambda texts: texts.select("key", F.lit("argentina").alias("answer"))
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in zip(names, ("false", "-1")):
            spark.conf.set(n, v)
        got = scope.cascade(rows, scope.Lexicon(locations=["la plata"]), ask=ask, model="m").select("scope", F.spark_partition_id().alias("p")).collect()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert len(got) == 400 and {r.scope for r in got} == {"argentina"} and len({r.p for r in got}) == 4
