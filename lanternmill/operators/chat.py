"""Conversations in, replies out: what a chat over an archive says, batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternmill.functions.labels import embed
from lanternmill.operators import answers, archive, models
from lanternmill.session import stored

#: What is said without a model; an archive names itself here.
REPLIES = {
    "chit-chat": "Hola. Puedo buscar notas y hechos en el archivo.",
    "out-of-scope": "Solo puedo responder preguntas sobre el archivo.",
    "abstained": "El archivo no tiene información suficiente para responder.\n\nUna fecha, un tema, una sección o palabras más precisas pueden ayudar.",
}
SYSTEM = "Respondé solo con lo que dicen estos documentos y citalos como [Fuente N].\n\n{context}"
SMALL_TALK = "Respondé brevemente, en el idioma del usuario, y ofrecé ayuda para buscar en el archivo."
# The list of sources under a reply, a date that is not known, and what is said of an error.
SOURCES_HEAD, NO_DATE, ERROR = "\n\nFuentes:\n", "s/f", "Error procesando la solicitud: "


def source_list(sources: Column) -> Column:
    """The lines under a reply for sources (citation_id, label, url, published), each label, url and date once; empty for
    none."""
    date = lambda s: F.coalesce(s["published"].cast("string"), F.lit(NO_DATE))
    name = lambda s: F.when(F.coalesce(s["url"], F.lit("")) != "", F.concat(F.lit("["), s["label"], F.lit("]("), s["url"], F.lit(")"))).otherwise(s["label"])
    lines = F.array_distinct(F.transform(F.sort_array(sources), lambda s: F.concat(F.lit("- "), name(s), F.lit(" | "), date(s), F.lit("\n"))))
    return F.when(F.size(lines) > 0, F.concat(F.lit(SOURCES_HEAD), F.array_join(lines, ""))).otherwise("")


def replies(answered: DataFrame, model: models.Model, small_talk: models.Model | None = None, said: dict[str, str] | None = None, cache: str | None = None, system: str = SYSTEM) -> DataFrame:
    """query_id, status, content of answered questions (query_id, question, intent, verdict, sources, context).

    Status is chit-chat, out-of-scope, abstained (too little evidence), answered or failed. A model is given the turns as
    JSON, each distinct prompt once; small talk goes to a model of its own if there is one, and what that fails on is
    answered as without it. An answer ends with its sources; what the model fails on is said with its error.
    """
    said = REPLIES | (said or {})
    status = F.when(F.col("intent") == "CHITCHAT", "chit-chat").when(F.col("intent") == "OUT_OF_SCOPE", "out-of-scope").when(F.col("verdict").isin("SUFFICIENT", "LOW_CONFIDENCE"), "answered").otherwise("abstained")
    prompt = lambda template, context: F.to_json(answers.messages(F.col("question"), context, template))
    asks = F.when(F.col("status") == "answered", prompt(system, F.col("context")))
    if small_talk:
        asks = asks.when(F.col("status") == "chit-chat", prompt(SMALL_TALK, F.lit("")))
    rows = stored(answered.withColumn("status", status).withColumn("prompt", asks).withColumn("key", F.sha2("prompt", 256)), "replies")
    found = models.ask(rows.where("status = 'answered'").select("key", "prompt"), model, cache).withColumn("of", F.lit("answered"))
    if small_talk:
        found = found.unionByName(models.ask(rows.where("status = 'chit-chat'").select("key", "prompt"), small_talk, cache).withColumn("of", F.lit("chit-chat")))
    rows = rows.join(found.select(F.col("of").alias("status"), "key", "answer", "error"), ["status", "key"], "left")
    content = F.when(F.col("status") == "answered", F.when(F.col("answer").isNotNull(), F.concat("answer", source_list(F.col("sources")))).otherwise(F.concat(F.lit(ERROR), F.coalesce("error", F.lit("")))))
    for name, text in said.items():
        content = content.when(F.col("status") == name, F.coalesce(F.nullif(F.trim("answer"), F.lit("")), F.lit(text)) if name == "chit-chat" else F.lit(text))
    failed = (F.col("status") == "answered") & F.col("answer").isNull()
    return rows.select("query_id", F.when(failed, "failed").otherwise(F.col("status")).alias("status"), content.alias("content"))


def chat(indexed: DataFrame, conversations: DataFrame, model: models.Model, small_talk: models.Model | None = None, filters: dict | None = None, embedder=embed, **options) -> DataFrame:
    """conv_id, status, content: the reply to the last user turn of each of conversations (conv_id, turn, role, text), a
    greeting where there is none, from the archive's index. options are those of replies."""
    asked = stored(answers.last_user_turn(conversations).select(F.col("conv_id").alias("query_id"), F.col("question").alias("text")), "questions")
    answered = archive.answer(indexed, asked, filters, embedder).join(asked.withColumnRenamed("text", "question"), "query_id")
    return replies(answered, model, small_talk, **options).withColumnRenamed("query_id", "conv_id")
