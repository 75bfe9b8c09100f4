"""The jobs as registered queries: each runs twice into one new folder and returns what is there after the second run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import archive_chunks, question_report
from jobs.settings import config
from lanternmill.operators.answers import DEFAULT_QUESTION, RELEVANT, SURE
from lanternmill.plans import archive, retrieval
from lanternmill.session import shared_path


def job1_archive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = shared_path(spark, "archive-chunks")
    for _ in range(2):
        # a pattern that only this name fits: a stream takes a table of one file by a pattern, not by its name
        archive_chunks.run(spark, f"{sf_dir}/documents.parque[t]", f"{place}/collection", f"{place}/checkpoint", config("archive_chunks"))
    rows = archive_chunks.current(spark, f"{place}/collection")
    return rows.withColumn("text_md5", F.md5(F.encode("text", "UTF-8"))).withColumn("scope_signals", F.array_join("scope_signals", "|")).drop("text")


def job2_question_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = shared_path(spark, "question-report")
    for _ in range(2):
        question_report.run(spark, f"{sf_dir}/conversations.parquet", f"{sf_dir}/documents.parquet", place, config("question_report"))
    rows = question_report.answered(spark, place)
    cited = F.array_join(F.transform("cited", lambda c: c["doc_id"].cast("string")), ",")
    return rows.select("conv_id", "intent", "year", "verdict", F.round("top_score", 6).alias("top_score"), "relevant_count", "n_sources", cited.alias("cited"))


QUERIES = {f.__name__: f for f in (job1_archive_chunks, job2_question_report)}

_CHUNKS = f"""WITH d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), sha1(coalesce(text, ''))) AS source_id, coalesce(text, '') AS x, nullif(lang, '') AS lang, source AS section FROM documents
QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY md5(x) DESC) = 1),
f AS (SELECT source_id, lang, section, CASE WHEN contains(x, 'Ã') OR contains(x, 'â€') OR contains(x, 'Â') THEN {archive._BROKEN} ELSE x END AS whole FROM d),
c AS (SELECT source_id, lang, section, CAST(k AS INTEGER) AS chunk_index, CAST(1 + (length(whole) - 1) // 780 AS INTEGER) AS total_chunks, substr(whole, CAST(k * 780 + 1 AS BIGINT), 900) AS text FROM (SELECT *, unnest(range(1 + (length(whole) - 1) // 780)) AS k FROM f WHERE length(whole) > 0)),
s AS (SELECT *, length(trim(text)) < 100 AS short, coalesce(lower(trim(section)) IN ('src1', 'src2'), false) AS direct, {archive._list(archive._STRONG)} AS strong, {archive._list(archive._WEAK)} AS weak FROM c),
l AS (SELECT *, CASE WHEN NOT short AND (direct OR len(strong) > 0) THEN 'argentina' ELSE 'unknown' END AS country_scope, CASE WHEN short THEN [] WHEN direct THEN ['seccion:' || lower(trim(section))] ELSE strong || weak END AS signals, source_id || '::chunk::' || chunk_index AS chunk_id FROM s),
a AS (SELECT source_id FROM l GROUP BY source_id HAVING bool_or(country_scope = 'argentina')),
n AS (SELECT *, sha1('\\x6B\\xA7\\xB8\\x11\\x9D\\xAD\\x11\\xD1\\x80\\xB4\\x00\\xC0\\x4F\\xD4\\x30\\xC8'::BLOB || encode(chunk_id)) AS h FROM l JOIN a USING (source_id))
SELECT source_id, lang, section, 'argentina' AS article_country_scope, total_chunks, chunk_index, chunk_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', 1 + (instr('0123456789abcdef', h[17]) - 1) % 4, 1) || h[18:20] || '-' || h[21:32] AS point_id,
country_scope, array_to_string(signals, '|') AS scope_signals, md5(text) AS text_md5 FROM n"""

_YEARS = "regexp_extract_all(question, '\\b(?:19|20)\\d{2}\\b')"
_W = retrieval._W.replace("text", "question")
_MONTHS = ", ".join(f"'{m}'" for m in retrieval.R.MONTHS)
_ANSWERS = f"""WITH t AS (SELECT conv_id, coalesce(nullif(max_by(text, turn) FILTER (WHERE role = 'user'), ''), '{DEFAULT_QUESTION}') AS question FROM conversations GROUP BY conv_id),
i AS (SELECT conv_id, question, CASE WHEN {archive._TALK.replace('(said,', '(question,')} THEN 'CHITCHAT' ELSE 'ARCHIVE_SEARCH' END AS intent FROM t),
{retrieval._bm25_sql("SELECT doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL", "SELECT DISTINCT question AS query_id, question AS text FROM i WHERE intent = 'ARCHIVE_SEARCH'")},
b AS (SELECT query_id, id FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20),
r AS (SELECT query_id, id, source, round(len(list_intersect(list_distinct({retrieval._kept('query_id')}), {retrieval._kept('text')})) / greatest(len(list_distinct({retrieval._kept('query_id')})), 1), 6) AS score FROM b JOIN (SELECT doc_id AS id, text, source FROM documents) USING (id)),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM r QUALIFY position <= 8),
v AS (SELECT query_id, count(*) AS n, coalesce(max(score), 0) AS top_score, count(*) FILTER (WHERE score >= {RELEVANT}) AS relevant_count, count(DISTINCT source) FILTER (WHERE score >= {RELEVANT} AND source <> 'unknown') AS n_sources, string_agg(id, ',' ORDER BY position) FILTER (WHERE position <= 5) AS cited FROM p GROUP BY query_id),
q2 AS (SELECT conv_id, question, intent, {_YEARS} AS years, regexp_matches(question, '(^|[^\\p{{L}}\\p{{N}}_])\\d{{2,4}}([^\\p{{L}}\\p{{N}}_]|$)') OR len(list_filter({_W}, lambda x: lower(x) IN ({_MONTHS}))) > 0 OR len(list_filter({_W}[2:], lambda x: regexp_matches(x, '^\\p{{Lu}}'))) > 0 AS fact FROM i),
m AS (SELECT q2.*, v.cited, coalesce(v.n, 0) AS n, coalesce(v.top_score, 0) AS top_score, coalesce(v.relevant_count, 0) AS relevant_count, coalesce(v.n_sources, 0) AS n_sources FROM q2 LEFT JOIN v ON v.query_id = q2.question)
SELECT conv_id, intent, CAST(years[1] AS INTEGER) AS year, CASE WHEN intent = 'CHITCHAT' THEN 'NOT_SEARCHED' WHEN n = 0 OR len(years) > 0 THEN 'INSUFFICIENT'
WHEN fact THEN CASE WHEN n_sources >= 1 AND (relevant_count >= 2 OR top_score >= {SURE}) THEN 'SUFFICIENT' WHEN n_sources >= 1 THEN 'LOW_CONFIDENCE' ELSE 'INSUFFICIENT' END
WHEN relevant_count >= 3 AND n_sources >= 2 THEN 'SUFFICIENT' WHEN relevant_count >= 1 AND n_sources >= 1 THEN 'LOW_CONFIDENCE' ELSE 'INSUFFICIENT' END AS verdict,
CASE WHEN intent <> 'CHITCHAT' THEN top_score::DOUBLE END AS top_score, CASE WHEN intent <> 'CHITCHAT' THEN relevant_count END AS relevant_count, CASE WHEN intent <> 'CHITCHAT' THEN n_sources END AS n_sources, cited FROM m"""

SQL = {"job1_archive_chunks": _CHUNKS, "job2_question_report": _ANSWERS}
