"""The whole way in and out: pages to an index of chunks, questions to answers with their evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternmill.functions.labels import embed, entities
from lanternmill.functions.text import collapse
from lanternmill.functions.values import UNKNOWN_DATE, date_of, decade_of, point_id
from lanternmill.operators import answers, batch, chunks, retrieval, scope, store
from lanternmill.operators.nearest import nearest

INDEX = (
    "point_id string, chunk_id string, source_id string, newspaper string, section string, article_title string, publication_date string, date_imputed boolean, year int, decade int, "
    "persons array<string>, organizations array<string>, location_mentions array<string>, primary_location string, country_scope string, scope_signals array<string>, "
    "article_country_scope string, text string, text_clean string, chunk_index int, total_chunks int, vector array<float>"
)


def enrich(documents: DataFrame, lexicon: scope.Lexicon, country: str = "Argentina", anchors: dict[str, list[list[float]]] | None = None, ask=None, model: str = "", embedder=embed) -> DataFrame:
    """Chunks with all metadata of documents (source_id, title, section, newspaper, published, text). Tagging, lexicon and
    scope run once a chunk; the article's scope comes back to its chunks by one join on the source.

    With anchors or a model (ask, as of scope.cascade) a chunk's scope is that of all its layers, and the vectors that the
    anchors are held against are the chunks' own, which index then stores.
    """
    parts = chunks.recursive(documents.select("source_id", "text"))
    rows = parts.join(documents.drop("text").withColumn("source_id", F.col("source_id").cast("string")), "source_id")
    rows = rows.withColumn("found", entities(F.col("text"))).withColumn("location_mentions", scope.find_terms(F.col("text"), lexicon.locations))
    if anchors or ask:
        rows = rows.withColumn("organizations", F.col("found.organizations")).withColumn("vector", embedder(F.col("text")) if anchors else F.lit(None).cast("array<float>"))
        rows = scope.cascade(rows, lexicon, anchors, ask, model).withColumn("s", F.struct("scope", "signals"))
    else:
        rows = rows.withColumn("s", scope.lexical_scope(F.col("text"), F.col("section"), F.col("found.organizations"), lexicon))
    day = date_of(F.col("published"))
    rows = rows.select(
        "source_id", "newspaper", "section", F.col("title").alias("article_title"), day.cast("string").alias("publication_date"), (day == F.lit(UNKNOWN_DATE).cast("date")).alias("date_imputed"),
        F.year(day).alias("year"), decade_of(F.year(day)).alias("decade"), "found.persons", "found.organizations", "location_mentions", scope.primary_location(F.col("location_mentions"), country).alias("primary_location"),
        F.col("s.scope").alias("country_scope"), F.col("s.signals").alias("scope_signals"), "text", collapse(F.col("text")).alias("text_clean"), "chunk_index", "total_chunks",
        *(["vector"] if anchors else []),
    )
    rows = rows.withColumn("chunk_id", F.concat_ws("::", "source_id", F.lit("chunk"), F.col("chunk_index").cast("string")))
    articles = scope.article_scope(rows.select("source_id", F.col("country_scope").alias("scope"), F.col("scope_signals").alias("signals")))
    return rows.join(articles.withColumnRenamed("scope", "article_country_scope"), "source_id").withColumn("point_id", point_id(F.col("chunk_id"), F.col("text")))


def index(enriched: DataFrame, index_scope: str = "argentina", known: DataFrame | None = None, embedder=embed) -> DataFrame:
    """The rows to store: those in the index scope, with the vectors they have, or that are known by point_id, or else
    made."""
    rows = enriched.where(scope.in_index_scope(F.col("article_country_scope"), F.col("country_scope"), index_scope))
    if "vector" in rows.columns:
        pass
    elif known is None:
        rows = rows.withColumn("vector", embedder(F.col("text")))
    else:
        rows = store.fill_vectors(rows, known, "point_id", embedder(F.col("text"))).drop("reused")
    return rows.select(*[c.strip().split(" ")[0] for c in INDEX.split(", ")])


def answer(indexed: DataFrame, questions: DataFrame, filters: dict | None = None, embedder=embed) -> DataFrame:
    """query_id, intent, verdict, top_score, sources, context of questions (query_id, text): filtered retrieval both
    ways, fusion by the question's weights, rerank, verdict, and the articles behind the best chunks. A question is
    searched among the rows that its plan's filters (year, decade, date, section, newspaper) leave, with their statistics;
    the plan is a model's where questions have a column plan_answer, else names the first year. filters hold for all
    questions.

    A batch of questions is one plan; small talk and other subjects are answered without a search, so their verdict is
    null.
    """
    said = F.col("plan_answer") if "plan_answer" in questions.columns else F.lit(None).cast("string")
    asked = questions.select("query_id", "text", answers.planned(F.col("text"), said).alias("p"), retrieval.query_weights(F.col("text")).alias("w"))
    keys = [F.col(f"p.{f}").alias(f"p_{f}") for f in answers.PLAN_FILTERS]
    search = asked.where(answers.routed(F.col("p")) == "search").select("*", *keys).withColumn("part", F.sha2(F.to_json(F.struct(*[f"p_{f}" for f in answers.PLAN_FILTERS])), 256))
    rows = store.where_all(indexed, filters or {})
    docs = rows.select(F.col("point_id").alias("id"), "text")
    parts = _parts(rows, search).select(F.col("point_id").alias("id"), "text", "vector", "part")
    lexical = batch.bm25_top(parts.select("part", "id", "text"), search.select("query_id", "part", "text"))
    vectors = search.select("query_id", "part", embedder(F.col("text"), prefix="query: ").alias("qvector"))
    semantic = nearest(parts.select("part", "id", "vector"), vectors)
    weights = search.select("query_id", "w")
    fused = retrieval.fuse(semantic.join(weights, "query_id"), lexical.join(weights, "query_id"), F.col("w.semantic"), F.col("w.lexical"))
    ranked = retrieval.overlap_rerank(fused.join(docs, "id").join(search.select("query_id", F.col("text").alias("question")), "query_id"))
    best = ranked.join(rows.drop("vector"), ranked["id"] == rows["point_id"])
    judged = answers.verdict(
        search.join(best.select("query_id", "id", "source_id", "year", F.col("publication_date").alias("published"), F.col("rerank_score").alias("score")), "query_id", "left").select(
            "query_id", F.col("text").alias("question"), F.col("w.lexical").alias("lexical_weight"), "id", "source_id", "year", "published", "score"
        )
    )
    places = best.select("query_id", "source_id", (F.col("rerank_position") - 1).alias("rank"), F.col("rerank_score").alias("score"))
    articles = chunks.rebuild(rows.select("source_id", "chunk_index", "text"), places)
    heads = rows.where("chunk_index = 0").groupBy("source_id").agg(F.min(F.struct(F.col("article_title").alias("title"), F.col("publication_date").alias("published"))).alias("h")).select("source_id", "h.*")
    told = articles.join(heads, "source_id", "left").withColumn("url", F.col("source_id"))
    listed = F.sort_array(F.collect_list(F.struct("rank", "title", "published", "url", "text")))
    blocks = told.groupBy("query_id").agg(answers.context(listed).alias("context"))
    out = asked.select("query_id", F.col("p.intent").alias("intent")).join(judged.select("query_id", "verdict", "top_score"), "query_id", "left")
    enough = _answered(F.col("verdict"))
    out = out.join(answers.citations(told), "query_id", "left").join(blocks, "query_id", "left")
    return out.select("query_id", "intent", "verdict", "top_score", F.when(enough, F.col("sources")).alias("sources"), F.when(enough, F.col("context")).alias("context"))


def _parts(rows: DataFrame, search: DataFrame) -> DataFrame:
    """rows with the part of every set of filters that they meet, of those that a question asks for: one join by equality.
    A row has a key for each choice of columns that questions filter by, of which there are at most two to the number
    of filters: the values in these columns, none if one is missing."""
    kinds = search.select("part", *[F.col(f"p_{f}").alias(f) for f in answers.PLAN_FILTERS]).distinct()
    used = F.concat(*[F.when(F.col(f).isNull(), "0").otherwise("1") for f in answers.PLAN_FILTERS])
    choices = sorted(r[0] for r in kinds.select(used).distinct().collect())

    def key(choice: str) -> Column:
        names = [f for f, c in zip(answers.PLAN_FILTERS, choice) if c == "1"]
        there = reduce(Column.__and__, [F.col(f).isNotNull() for f in names], F.lit(True))
        return F.when(there, F.concat(F.lit(choice), F.to_json(F.struct(F.lit(choice).alias("_"), *[F.col(f).cast("string").alias(f) for f in names]))))

    if not choices:
        return rows.withColumn("part", F.lit("")).limit(0)
    asked = kinds.select("part", reduce(lambda out, c: F.when(used == c, key(c)).otherwise(out), choices, F.lit(None).cast("string")).alias("_key"))
    return rows.withColumn("_key", F.explode(F.array_compact(F.array(*map(key, choices))))).join(asked, "_key").drop("_key")


def _answered(verdict: Column) -> Column:
    return verdict.isin("SUFFICIENT", "LOW_CONFIDENCE")
