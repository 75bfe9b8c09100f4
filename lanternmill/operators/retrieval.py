"""Retrieval: BM25, rank fusion, query-adaptive weights, reranking.

All take batches of queries; ties go to the smaller document id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternmill.functions.text import spanish_tokens, tokens
from lanternmill.session import stored

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
DEPTH, RERANK_DEPTH = 20, 8
#: Distinct query terms up to which they are broadcast.
FEW_TERMS = 1 << 16


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, weight (how often the query has the term) of columns query_id, text.

    A query of stop words only keeps them.
    """
    plain = spanish_tokens(F.col("text"))
    terms = F.when(F.size(plain) > 0, plain).otherwise(tokens(F.col("text")))
    return queries.select("query_id", F.explode(terms).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("weight"))


def if_few(side: DataFrame, most: int) -> DataFrame:
    """Marked for broadcast if it has no more rows than stated; else Spark joins by shuffle."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def rated_terms(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, part (where queries have one), term, weight, w (weight by idf), df, n, avgdl of the terms of queries that docs
    have. Where both sides have a column part, the statistics are those of the query's part.

    The statistics shuffle a row a term and task, in which a term of none stands for the document itself. What is stored of
    them is a row for each term that is asked for, and of the others how many there are of each df, from which the mean
    comes: the words of the texts stay out of it.
    """
    part = ["part"] if "part" in queries.columns else []
    words = docs.select(*part, spanish_tokens(F.col("text")).alias("words"))
    marks = F.concat(F.array_distinct("words"), F.array(F.lit(None).cast("string")))
    counts = words.select(*part, F.size("words").cast("long").alias("words"), F.explode(marks).alias("term"))
    counts = counts.groupBy(*part, "term").agg(F.count("*").alias("df"), F.coalesce(F.sum(F.when(F.col("term").isNull(), F.col("words"))), F.lit(0).cast("long")).alias("words"))
    asked = query_terms(queries)
    asked = asked.join(queries.select("query_id", "part"), "query_id") if part else asked
    asked = stored(asked, "terms")
    terms = if_few(asked.select(*part, "term").distinct().withColumn("_asked", F.lit(True)), FEW_TERMS)
    kept = F.when(F.col("_asked"), F.col("term")).alias("kept")
    marked = counts.join(terms, [*part, "term"], "left").groupBy(*part, F.col("term").isNull().alias("whole"), kept, "df", "words").agg(F.count("*").alias("terms"))
    counts = stored(marked, "bm25-counts")
    sizes = counts.where("whole").select(*part, F.col("df").alias("n"), (F.col("words") / F.col("df")).alias("avgdl"))
    per_df = counts.where("not whole").select(*part, F.col("kept").alias("term"), "df", "terms")
    rated = per_df.join(sizes, "part") if part else per_df.join(F.broadcast(sizes))  # one row
    rated = rated.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    means = rated.groupBy(*part).agg((F.sum(F.col("terms") * F.col("idf")) / F.sum("terms")).alias("mean"))
    rated = rated.where("term is not null")
    rated = rated.join(means, "part") if part else rated.join(F.broadcast(means))
    idf = F.when(F.col("idf") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf"))
    return asked.join(rated, [*part, "term"]).select("query_id", *part, "term", "weight", (F.col("weight") * idf).alias("w"), "df", "n", "avgdl")


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, score of every document (id, text) that has a term of the query (Okapi, negative idf raised to a
    share of the mean idf). Filter docs before: all statistics are those of what is left. Where both sides have a
    column part, a query is scored over the documents of its part, with that part's statistics.

    A row a query and document: for the best of many queries there is batch.bm25_top. Two passes over the texts; the scores
    explode the words and keep those asked for before anything is shuffled.
    """
    part = ["part"] if "part" in queries.columns else []
    words = docs.select(*part, "id", spanish_tokens(F.col("text")).alias("words"))
    asked = stored(rated_terms(docs, queries), "rated")
    terms = if_few(asked.select(*part, "term").distinct(), FEW_TERMS)
    # the length is there before the words are exploded, so that no row has to carry all of them; and what is exploded is no
    # plain column, from whose size Spark would make a filter that cuts every text into words once more
    long = words.select(*part, "id", F.size("words").alias("dl"), "words")
    found = long.select(*part, "id", "dl", F.explode(F.coalesce("words", F.array().cast("array<string>"))).alias("term")).join(terms, [*part, "term"], "left_semi")
    found = found.groupBy(*part, "id", "dl", "term").agg(F.count("*").alias("tf"))
    tf = F.col("tf")
    score = F.col("w") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return found.join(asked, [*part, "term"]).groupBy("query_id", "id").agg(F.round(F.sum(score), 6).alias("score"))


def with_zeros(scores: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Adds, with score 0, the k smallest ids of docs to each query that lacks them, so that every query has k rows. By a
    group, not a join: scores are worked out once."""
    few = docs.select("id").orderBy("id").limit(2 * k)
    fill = queries.select("query_id").join(F.broadcast(few)).select("query_id", "id")  # 2 k rows a query
    both = scores.select("query_id", "id", "score").unionByName(fill.withColumn("score", F.lit(None).cast("double")))
    return both.groupBy("query_id", "id").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))


def top(scores: DataFrame, k: int = DEPTH) -> DataFrame:
    """query_id, id, score, rank (from 0) of the k best of each query."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    # the bound is on the row number itself, so each task keeps its k best before the shuffle
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).withColumn("rank", (F.col("rank") - 1).cast("long"))


def fuse(semantic_top: DataFrame, lexical_top: DataFrame, w_semantic: Column | float = 0.5, w_lexical: Column | float = 0.5) -> DataFrame:
    """Weighted reciprocal ranks: query_id, id, rrf, semantic_rank, bm25_rank, by a union and a sum. Both lists, some rows a
    query, are dealt alike and to a stated number of partitions first: a union of sides that Spark has dealt by
    themselves fails where it then splits or joins partitions of one of them."""
    lit = lambda w: w if isinstance(w, Column) else F.lit(w)
    none = F.lit(None).cast("long")
    a = semantic_top.select("query_id", "id", (lit(w_semantic) / (RRF_K + F.col("rank"))).alias("part"), F.col("rank").alias("sr"), none.alias("br"))
    b = lexical_top.select("query_id", "id", (lit(w_lexical) / (RRF_K + F.col("rank"))).alias("part"), none.alias("sr"), F.col("rank").alias("br"))
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = a.repartition(n, "query_id", "id").unionByName(b.repartition(n, "query_id", "id"))
    return both.groupBy("query_id", "id").agg(F.round(F.sum("part"), 8).alias("rrf"), F.max("sr").alias("semantic_rank"), F.max("br").alias("bm25_rank"))


# Months and words that mark a question about facts or about ideas.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
IDEA_WORDS = ("porque", "como", "explicacion", "concepto", "significado", "analisis", "motivo", "razon", "teoria", "opinion", "debate")


def query_weights(text: Column) -> Column:
    """struct<semantic, lexical>: 0.4/0.6 for facts (a number of 2 to 4 digits, a month, a capitalised word after the
    first), else 0.6/0.4 for ideas (a marking word, or over 8 words), else even. Not folded: accented words don't match."""
    words = F.regexp_extract_all(F.trim(text), F.lit(r"(?U)\w+"), F.lit(0))
    low = F.transform(words, lambda w: F.lower(w))
    fact = F.trim(text).rlike(r"(?U)\b\d{2,4}\b") | F.exists(low, lambda w: w.isin(*MONTHS)) | F.exists(F.slice(words, 2, 1 << 20), lambda w: w.rlike(r"^\p{Lu}"))
    idea = F.exists(low, lambda w: w.isin(*IDEA_WORDS)) | (F.size(words) > 8)
    pair = lambda s, b: F.struct(F.lit(s).alias("semantic"), F.lit(b).alias("lexical"))
    return F.when(fact, pair(0.4, 0.6)).when(idea, pair(0.6, 0.4)).otherwise(pair(0.5, 0.5))


def overlap_rerank(candidates: DataFrame, n: int = RERANK_DEPTH) -> DataFrame:
    """query_id, id, rerank_score, rerank_position of query_id, id, question, text: a deterministic stand-in for a
    cross-encoder, the share of the question's words that the text has."""
    return best_overlaps(candidates.select("query_id", "id", overlap(F.array_distinct(spanish_tokens(F.col("question"))), spanish_tokens(F.col("text"))).alias("rerank_score")), n)


def overlap(asked: Column, words: Column) -> Column:
    """The share of the distinct words asked that are among words."""
    return F.round(F.size(F.array_intersect(asked, words)) / F.greatest(F.size(asked), F.lit(1)), 6)


def best_overlaps(rated: DataFrame, n: int = RERANK_DEPTH) -> DataFrame:
    """The n best of each query (query_id, id, rerank_score) with rerank_position, ties to the smaller id."""
    best = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "id")
    return rated.withColumn("rerank_position", F.row_number().over(best)).where(F.col("rerank_position") <= n).withColumn("rerank_position", F.col("rerank_position").cast("long"))


def overlap_reranked(found: DataFrame, docs: DataFrame, questions: DataFrame, n: int = RERANK_DEPTH) -> DataFrame:
    """overlap_rerank of found (query_id, id), docs (id, text) and questions (query_id, question). A text that was found is
    cut into words once, not for each question that it is found for, and is dealt by its id alone; the questions meet it
    there with their own words."""
    found = stored(found.select("query_id", "id"), "found")
    asked = questions.select("query_id", F.array_distinct(spanish_tokens(F.col("question"))).alias("asked"))
    words = docs.join(found.select("id").distinct(), "id", "left_semi").select("id", spanish_tokens(F.col("text")).alias("words"))
    rated = words.join(found.join(asked, "query_id"), "id").select("query_id", "id", overlap(F.col("asked"), F.col("words")).alias("rerank_score"))
    return best_overlaps(rated, n)


def matched_reranked(found: DataFrame, questions: DataFrame, n: int = RERANK_DEPTH) -> DataFrame:
    """overlap_rerank of found (query_id, id, matched: how many of the question's distinct words the document has) and
    questions (query_id, question): no text is read again."""
    asked = questions.select("query_id", F.size(F.array_distinct(spanish_tokens(F.col("question")))).alias("asked"))
    share = F.round(F.col("matched") / F.greatest(F.col("asked"), F.lit(1)), 6)
    return best_overlaps(found.join(asked, "query_id").select("query_id", "id", share.alias("rerank_score")), n)


# More words that mark a question about ideas, where a tagger has read it.
MORE_IDEA_WORDS = ("filosofia", "definicion", "resumen", "contexto")


def tagged_weights(text: Column, has_entity: Column, has_name: Column, has_number: Column) -> Column:
    """query_weights with a tagger's word: whether it has found entities, proper names or numbers. Numbers of two or four
    digits and months are facts too; "por que" asks for ideas."""
    words = F.transform(F.regexp_extract_all(F.trim(text), F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0)), lambda w: F.lower(w))
    number = text.rlike(r"(?U)\b(19\d{2}|20\d{2}|\d{2})\b")
    fact = F.coalesce(has_entity, F.lit(False)) | F.coalesce(has_name, F.lit(False)) | F.coalesce(has_number, F.lit(False)) | F.exists(words, lambda w: w.isin(*MONTHS)) | number
    why = F.array_contains(F.zip_with(words, F.slice(words, 2, 1 << 20), lambda a, b: (a == "por") & F.coalesce(b == "que", F.lit(False))), True)
    idea = F.exists(words, lambda w: w.isin(*IDEA_WORDS, *MORE_IDEA_WORDS)) | why | (F.size(words) > 8)
    pair = lambda s, b: F.struct(F.lit(s).alias("semantic"), F.lit(b).alias("lexical"))
    return F.when(fact, pair(0.4, 0.6)).when(idea, pair(0.6, 0.4)).otherwise(pair(0.5, 0.5))


def ordered(fused: DataFrame) -> DataFrame:
    """fused rows with their position (from 0) in each query: the best first; of equal ones, those of the semantic list
    in its order, then the others in the lexical list's."""
    own = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.asc_nulls_last("semantic_rank"), F.asc_nulls_last("bm25_rank"), "id")
    return fused.withColumn("position", F.row_number().over(own).cast("long") - 1)
