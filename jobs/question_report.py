"""Answers the questions of a batch of conversations from an archive of documents, and says which it cannot answer.

    python -m jobs.question_report CONVERSATIONS DOCUMENTS REPORT [--config FILE]

The last thing that a user said in each conversation (conv_id, turn, role, text) is its question. Small talk is told apart;
the others are searched among the documents (doc_id, text, source) by BM25 in batches, reranked and judged by their
evidence. REPORT/answers is the report, a folder a verdict, with the documents to cite.

A run replaces it, so it can be repeated; a reader of the report waits for it. Each distinct question is asked once, and
as long as the documents stay what they are, later runs search only for questions that are new: REPORT/state names the documents
(by the sums of their hashes) and settings that the ranks in REPORT/ranked are of. All documents are read to see that. No
posting is stored or shuffled.
"""

from __future__ import annotations

import json
import logging
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.settings import main
from lanternmill.operators import answers, batch, retrieval
from lanternmill.session import deleted, exists, spread, without_shuffle_files

log = logging.getLogger("jobs.question_report")

ANSWERS = (
    "conv_id long, question string, intent string, year int, top_score double, relevant_count long, n_sources long, "
    "cited array<struct<position:bigint,doc_id:bigint,score:double>>, verdict string"
)

#: What a document's words and a question's ranks are worked out by; to be raised when this changes.
RANKING = 1
STATE = "made string, place string"


def asked(conversations: DataFrame) -> DataFrame:
    """conv_id, question, query_id (that of the question's text), intent, year."""
    turns = answers.last_user_turn(conversations.select("conv_id", "turn", "role", "text"))
    plan = answers.plan(F.col("question"))
    return turns.select("conv_id", "question", F.sha2("question", 256).alias("query_id"), plan["intent"].alias("intent"), plan["year"].alias("year"))


def made_of(docs: DataFrame, config: dict) -> str:
    """What ranks depend on besides the question: the documents (id, text), in any order, and the settings."""
    hashes = [F.sum(F.xxhash64("id", "text").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), "id", "text")).alias("xor")]
    row = docs.agg(F.count(F.lit(1)).alias("n"), *hashes).first()
    return json.dumps([RANKING, config["depth"], config["rerank_depth"], row["n"], str(row["sum"]), row["xor"]])


def last_state(spark: SparkSession, report: str) -> tuple[str | None, str | None]:
    """(what the ranks that the last run left are made of, their folder). The state is written when the ranks are there, so a
    lost run leaves none, or the one before with its ranks."""
    state = spark.read.schema(STATE).json(f"{report}/state").first() if exists(spark, f"{report}/state") else None
    return (state["made"], state["place"]) if state else (None, None)


def ranks(spark: SparkSession, docs: DataFrame, search: DataFrame, report: str, config: dict) -> DataFrame:
    """query_id, id, rerank_score, rerank_position of the questions of search; questions without a document have none."""
    made, (of, last) = made_of(docs, config), last_state(spark, report)
    table = spark.read.schema(f"query_id string, id {docs.schema['id'].dataType.simpleString()}, rerank_score double, rerank_position long")
    old = table.parquet(f"{report}/{last}") if of == made else None
    new = search if old is None else search.join(old.select("query_id").distinct(), "query_id", "left_anti")
    n = new.count()
    log.info("%d questions are new to these documents", n)
    if old is not None and not n:
        return old.where("id is not null")
    place = "ranked/b" if last == "ranked/a" else "ranked/a"
    found = batch.bm25_top(spread(docs.select("id", "text")), new.select("query_id", F.col("question").alias("text")), config["depth"], matched=True)
    best = new.select("query_id").join(retrieval.matched_reranked(found, new, config["rerank_depth"]), "query_id", "left")  # a row without an id: nothing found
    if old is not None:
        best = best.unionByName(old.join(search.select("query_id"), "query_id", "left_semi"))
    best.write.mode("overwrite").parquet(f"{report}/{place}")
    spark.range(1).select(F.lit(made).alias("made"), F.lit(place).alias("place")).write.mode("overwrite").json(f"{report}/state")
    if last:
        deleted(spark, f"{report}/{last}")
    return table.parquet(f"{report}/{place}").where("id is not null")


def run(spark: SparkSession, conversations: str, documents: str, report: str, config: dict) -> None:
    with without_shuffle_files(spark):
        write(spark, conversations, documents, report, config)


def write(spark: SparkSession, conversations: str, documents: str, report: str, config: dict) -> None:
    read, wrote = Observation(), Observation()
    docs = spark.read.parquet(documents).select(F.col("doc_id").alias("id"), "text", "source").where("id is not null")
    turns = spark.read.parquet(conversations).observe(read, F.count(F.lit(1)).alias("turns"))
    asked(turns).write.mode("overwrite").parquet(f"{report}/questions")
    log.info("read %d turns of %s", read.get["turns"], conversations)

    questions = spark.read.parquet(f"{report}/questions")
    search = questions.where("intent = 'ARCHIVE_SEARCH'").select("query_id", "question", retrieval.query_weights(F.col("question"))["lexical"].alias("lexical_weight")).dropDuplicates(["query_id"])
    log.info("searching %s for the questions", documents)
    best = ranks(spark, docs, search, report, config)

    # the year of a document is not known here, so a question that names one has no evidence for it
    rows = search.join(best.join(docs.select("id", "source"), "id"), "query_id", "left")
    judged = answers.verdict(rows.select("query_id", "question", "lexical_weight", "id", F.col("source").alias("source_id"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("published"), F.col("rerank_score").alias("score")))
    shown = best.where(F.col("rerank_position") <= config["shown"]).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.col("rerank_position").alias("position"), F.col("id").alias("doc_id"), F.col("rerank_score").alias("score")))).alias("cited"))
    out = questions.join(judged.select("query_id", "verdict", "top_score", "relevant_count", "n_sources"), "query_id", "left").join(shown, "query_id", "left")
    out = out.select("conv_id", "question", "intent", "year", "top_score", "relevant_count", "n_sources", "cited", F.coalesce("verdict", F.lit("NOT_SEARCHED")).alias("verdict"))
    out = out.observe(wrote, F.count(F.lit(1)).alias("answers"), F.count_if(F.col("verdict") == "INSUFFICIENT").alias("open"))
    out.write.mode("overwrite").partitionBy("verdict").parquet(f"{report}/answers")
    log.info("wrote %d answers, %d of them without evidence, to %s/answers", wrote.get["answers"], wrote.get["open"], report)


def answered(spark: SparkSession, report: str) -> DataFrame:
    """The report's answers."""
    return spark.read.schema(ANSWERS).parquet(f"{report}/answers")


if __name__ == "__main__":
    main("question_report", run, "conversations", "documents", "report")
