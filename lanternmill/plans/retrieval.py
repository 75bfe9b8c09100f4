"""Queries of tokens, BM25, cosine and rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternmill.functions.text import STOP_WORDS, spanish_tokens, tokens
from lanternmill.operators import batch, index
from lanternmill.operators import retrieval as R
from lanternmill.operators.nearest import nearest
from lanternmill.operators.scope import anchor_scope
from lanternmill.session import spread, table

QUESTION = "de la que para con por los una tion"
LONG_QUESTION = "queaux entre ciónmente para los eau la la"


def _docs(spark: SparkSession, d: str, lang: str | None = None) -> DataFrame:
    docs = table(spark, d, "documents")
    return spread((docs.where(F.col("lang") == lang) if lang else docs).select(F.col("doc_id").alias("id"), "text"))


def _one(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "query_id long, text string")


def _many(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _lexical(spark, d, lang=None, text=QUESTION):
    docs, asked = _docs(spark, d, lang), _one(spark, text)
    return R.top(R.with_zeros(R.bm25(docs, asked), docs, asked, R.DEPTH))


def _query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The queries of a search: every row whose id is divisible by 100."""
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvector"))


def _fused(spark, d, *weights):
    """The nearest vectors of every query vector, and the best documents of one question."""
    best = _lexical(spark, d).withColumnRenamed("query_id", "question")  # the question is searched once
    lexical = _query_vectors(spark, d).select("query_id", F.lit(0).cast("long").alias("question")).join(F.broadcast(best), "question").drop("question")  # DEPTH rows
    return R.fuse(_semantic(spark, d), lexical, *weights)


def _semantic(spark, d, label=None):
    vectors = table(spark, d, "embeddings")
    vectors = vectors.where(F.col("label") == label) if label is not None else vectors
    return nearest(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), _query_vectors(spark, d))


def tokenize_stats(spark, d):
    return _docs(spark, d).select(F.col("id").alias("doc_id"), F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(spanish_tokens(F.col("text"))).cast("long").alias("n_kept"))


def stopword_filtered_tf(spark, d):
    words = _docs(spark, d).select("id", F.explode(spanish_tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))
    return words.groupBy("term").agg(F.sum("n").alias("tf"), F.count("id").alias("df")).where("df > 1")


def bm25_topk(spark, d):
    return R.top(R.bm25(_docs(spark, d), _one(spark, LONG_QUESTION)))


def bm25_filtered(spark, d):
    return _lexical(spark, d, "es")


def bm25_zero_fill(spark, d):
    return _lexical(spark, d, "de", "ciónmente xyzzy")


def bm25_batch(spark, d):
    return batch.bm25_top(_docs(spark, d), _many(spark, d), 5)


def bm25_indexed(spark, d):
    """The questions of bm25_batch by a stored index."""
    return index.indexed(_docs(spark, d)).search(_many(spark, d), 5)


def cosine_topk(spark, d):
    return _semantic(spark, d)


def cosine_filtered(spark, d):
    return _semantic(spark, d, 3)


def rrf_fusion(spark, d):
    return _fused(spark, d)


def rrf_weighted(spark, d):
    return _fused(spark, d, 0.4, 0.6)


def rrf_order(spark, d):
    return R.ordered(_fused(spark, d, 0.6, 0.4)).select("query_id", "id", "position")


def hybrid_rerank(spark, d):
    questions = _query_vectors(spark, d).select("query_id", F.lit(QUESTION).alias("question"))
    return R.overlap_reranked(_fused(spark, d), _docs(spark, d), questions)


def query_weights(spark, d):
    asked = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", R.query_weights(F.col("text")).alias("w"))
    return asked.select("conv_id", "turn", F.col("w.semantic").alias("w_semantic"), F.col("w.lexical").alias("w_lexical"))


def model_weights(spark, d):
    text = F.col("text")
    w = R.tagged_weights(text, text.rlike(r"\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+"), F.lit(None).cast("boolean"), F.col("turn") % 3 == 2)
    return table(spark, d, "conversations").select("conv_id", "turn", w.alias("w")).select("conv_id", "turn", F.col("w.semantic").alias("w_semantic"), F.col("w.lexical").alias("w_lexical"))


ANCHORS = {"argentina": 1, "international": 2, "unknown": 3}


def anchor_margin(spark, d):
    e = table(spark, d, "embeddings")
    found = e.where("vec_id < 12").orderBy("vec_id").collect()  # twelve stated anchors, four a class
    anchors = {c: [list(map(float, r.embedding)) for r in found if r.vec_id % 3 == k - 1] for c, k in ANCHORS.items()}
    return e.select("vec_id", anchor_scope(F.col("embedding"), anchors).alias("a")).select("vec_id", F.col("a.scope").alias("scope"), F.col("a.margin").alias("margin"), F.col("a.final").alias("final"))


QUERIES = {f.__name__: f for f in (tokenize_stats, stopword_filtered_tf, bm25_topk, bm25_filtered, bm25_zero_fill, bm25_batch, bm25_indexed, cosine_topk, cosine_filtered, rrf_fusion, rrf_weighted, rrf_order, model_weights, hybrid_rerank, query_weights, anchor_margin)}

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOK = r"regexp_extract_all(regexp_replace(strip_accents(lower({})), '\p{{Mn}}+', '', 'g'), '[\p{{L}}\p{{N}}_]+')"


def _tok(column: str) -> str:
    return _TOK.format(column)


def _kept(column: str) -> str:
    return f"list_filter({_tok(column)}, lambda w: w NOT IN ({_STOP}))"


def _bm25_sql(docs: str, asked: str) -> str:
    """CTEs up to scores(query_id, id, score)."""
    return f"""docs AS ({docs}), asked AS ({asked}),
q AS (SELECT query_id, term, count(*) AS weight FROM (SELECT query_id, unnest(CASE WHEN len({_kept('text')}) > 0 THEN {_kept('text')} ELSE {_tok('text')} END) AS term FROM asked) GROUP BY ALL),
w AS (SELECT id, {_kept('text')} AS words FROM docs),
st AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM w),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(words) AS dl, unnest(words) AS term FROM w) GROUP BY ALL),
idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
eps AS (SELECT 0.25 * avg(idf) AS e FROM idf),
scores AS (SELECT query_id, id, round(sum(weight * CASE WHEN idf < 0 THEN e ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN idf USING (term) JOIN q USING (term), st, eps GROUP BY query_id, id)"""


def _zero_sql() -> str:
    return "filled AS (SELECT * FROM scores UNION ALL SELECT query_id, id, 0 FROM asked, (SELECT id FROM docs ORDER BY id LIMIT 40) x WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.query_id = asked.query_id AND s.id = x.id))"


def _top_sql(source: str, k: int = R.DEPTH) -> str:
    return f"SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM {source} QUALIFY rank < {k}"


def _lexical_sql(lang: str | None, text: str, asked: str = "SELECT CAST(0 AS BIGINT) AS query_id") -> str:
    docs = "SELECT doc_id AS id, text FROM documents" + (f" WHERE lang = '{lang}'" if lang else "")
    return _bm25_sql(docs, f"SELECT query_id, '{text}' AS text FROM ({asked})") + ", " + _zero_sql()


def _semantic_sql(where: str = "true") -> str:
    dot = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
    return f"sem AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round({dot}, 6) AS score FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) q WHERE {where})"


def _fuse_sql(a: float, b: float) -> str:
    return f"""WITH {_semantic_sql()}, {_lexical_sql(None, QUESTION, "SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 100 = 0")}, s AS ({_top_sql('sem')}), l AS ({_top_sql('filled')}),
fused AS (SELECT query_id, id, round(sum(part), 8) AS rrf, max(sr) AS semantic_rank, max(br) AS bm25_rank FROM (SELECT query_id, id, {a}::DOUBLE / (60 + rank) AS part, rank AS sr, NULL::BIGINT AS br FROM s UNION ALL SELECT query_id, id, {b}::DOUBLE / (60 + rank), NULL, rank FROM l) GROUP BY query_id, id)"""


_W = "regexp_extract_all(trim(text), '[\\p{L}\\p{N}_]+')"
SQL = {
    "tokenize_stats": f"SELECT doc_id, len({_tok('text')}) AS n_tokens, len({_kept('text')}) AS n_kept FROM documents",
    "stopword_filtered_tf": f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_kept('text')}) AS term FROM documents) GROUP BY term HAVING count(DISTINCT doc_id) > 1",
    "bm25_topk": "WITH " + _lexical_sql(None, LONG_QUESTION) + " " + _top_sql("scores"),
    "bm25_filtered": "WITH " + _lexical_sql("es", QUESTION) + " " + _top_sql("filled"),
    "bm25_zero_fill": "WITH " + _lexical_sql("de", "ciónmente xyzzy") + " " + _top_sql("filled"),
    "bm25_batch": "WITH " + _bm25_sql("SELECT doc_id AS id, text FROM documents", "SELECT item_id AS query_id, text FROM benchmark") + " " + _top_sql("scores", 5),
    "cosine_topk": f"WITH {_semantic_sql()} {_top_sql('sem')}",
    "cosine_filtered": f"WITH {_semantic_sql('e.label = 3')} {_top_sql('sem')}",
    "rrf_fusion": _fuse_sql(0.5, 0.5) + " SELECT * FROM fused",
    "rrf_weighted": _fuse_sql(0.4, 0.6) + " SELECT * FROM fused",
    "rrf_order": _fuse_sql(0.6, 0.4) + " SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, semantic_rank ASC NULLS LAST, bm25_rank ASC NULLS LAST, id) - 1 AS position FROM fused",
    "model_weights": f"""WITH w AS (SELECT conv_id, turn, regexp_matches(text, '\\p{{Lu}}\\p{{Ll}}+ \\p{{Lu}}\\p{{Ll}}+') OR turn % 3 = 2 OR len(list_filter({_W}, lambda x: lower(x) IN ({', '.join(f"'{m}'" for m in R.MONTHS)}))) > 0 OR regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])(19\\d{{2}}|20\\d{{2}}|\\d{{2}})([^\\p{{L}}\\p{{N}}_]|$)') AS fact,
list_transform(regexp_extract_all(trim(text), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]'), lambda x: lower(x)) AS t FROM conversations),
i AS (SELECT conv_id, turn, fact, len(list_filter(t, lambda x: x IN ({', '.join(f"'{m}'" for m in (*R.IDEA_WORDS, *R.MORE_IDEA_WORDS))}))) > 0 OR len(list_filter(range(1, len(t)), lambda k: t[k] = 'por' AND t[k + 1] = 'que')) > 0 OR len(t) > 8 AS idea FROM w)
SELECT conv_id, turn, CASE WHEN fact THEN 0.4 WHEN idea THEN 0.6 ELSE 0.5 END::DOUBLE AS w_semantic, CASE WHEN fact THEN 0.6 WHEN idea THEN 0.4 ELSE 0.5 END::DOUBLE AS w_lexical FROM i""",
    "hybrid_rerank": _fuse_sql(0.5, 0.5)
    + f""", r AS (SELECT query_id, f.id, round(len(list_intersect(list_distinct({_kept(f"'{QUESTION}'")}), {_kept('docs.text')})) / greatest(len(list_distinct({_kept(f"'{QUESTION}'")})), 1), 6) AS rerank_score FROM fused f JOIN docs ON docs.id = f.id)
SELECT query_id, id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS rerank_position FROM r QUALIFY rerank_position <= {R.RERANK_DEPTH}""",
    "query_weights": f"""WITH w AS (SELECT conv_id, turn, regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])\\d{{2,4}}([^\\p{{L}}\\p{{N}}_]|$)') OR len(list_filter({_W}, lambda x: lower(x) IN ({', '.join(f"'{m}'" for m in R.MONTHS)}))) > 0 OR len(list_filter({_W}[2:], lambda x: regexp_matches(x, '^\\p{{Lu}}'))) > 0 AS fact,
len(list_filter({_W}, lambda x: lower(x) IN ({', '.join(f"'{m}'" for m in R.IDEA_WORDS)}))) > 0 OR len({_W}) > 8 AS idea FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN fact THEN 0.4 WHEN idea THEN 0.6 ELSE 0.5 END::DOUBLE AS w_semantic, CASE WHEN fact THEN 0.6 WHEN idea THEN 0.4 ELSE 0.5 END::DOUBLE AS w_lexical FROM w""",
    "anchor_margin": """WITH s AS (SELECT e.vec_id, a.vec_id % 3 AS place, max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < 12) a GROUP BY ALL),
r AS (SELECT vec_id, place, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, place) AS k, score - lead(score) OVER (PARTITION BY vec_id ORDER BY score DESC, place) AS gap FROM s)
SELECT vec_id, ['argentina', 'international', 'unknown'][place + 1] AS scope, round(gap, 6) AS margin, gap > 0.15 AS final FROM r WHERE k = 1""",
}
SQL["bm25_indexed"] = SQL["bm25_batch"]
