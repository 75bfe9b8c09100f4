"""From ranked chunks to an answer: plans, evidence verdicts, citations, chat turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternmill.functions.text import fold, years

RELEVANT, SURE = 0.25, 0.3
# What is taken for a question where none was asked; the first day of a month; labels of cited sources and of
# the blocks that a model is shown.
DEFAULT_QUESTION = "Hola"
FIRST_DAY = r"\b(1|uno|primero|1ro)\b"
NO_TITLE, NO_ARTICLE_TITLE, NO_DATE = "Fuente sin título", "Artículo sin título", "s/f"
BLOCK_HEAD, BLOCK_TITLE, BLOCK_DATE, BLOCK_URL = "[Documento ", "]\nTítulo: ", "\nFecha: ", "\nURL: "
# Small talk that needs no search.
SMALL_TALK = (
    r"^\s*(hola|hello|hi|hey|buenas|buen\s?d[ií]a|buen(o|a)s?\s?(d[ií]as|tardes|noches))(\s*,\s*(hola|hello|hi|hey|buenas|buen\s?d[ií]a|buen(o|a)s?\s?(d[ií]as|tardes|noches)))?\s*[!.?]*\s*$",
    r"^\s*(gracias|thanks|thank\s*you|thx|ty|muchas\s*gracias)\s*[!.?]*\s*$",
    r"^\s*(chau|adi[oó]s|bye|nos\s*vemos|hasta\s*(luego|pronto|la\s*vista))\s*[!.?]*\s*$",
    r"^\s*(ok|dale|perfecto|genial|bien|entendido|listo|excelente|copado|joya)\s*[!.?]*\s*$",
    r"^\s*(qui[eé]n\s+(sos|eres)|what\s+are\s+you|who\s+are\s+you|c[oó]mo\s+te\s+llam[aá]s)\s*[?!.]*\s*$",
)


def intent(question: Column) -> Column:
    out = F.lit(False)
    for p in SMALL_TALK:
        out = out | question.rlike("(?iu)" + p)
    return F.when(out, "CHITCHAT").otherwise("ARCHIVE_SEARCH")


def plan(question: Column) -> Column:
    """struct<intent, year, query>: without a model, the first year named filters and the question is the query."""
    year = F.get(years(question), F.lit(0)).cast("int")
    return F.struct(intent(question).alias("intent"), year.alias("year"), question.alias("query"))


def planned_section(section: Column) -> Column:
    return F.replace(F.lower(fold(section)), F.lit(" "), F.lit(""))


def planned_date(value: Column, question: Column) -> Column:
    """An ISO date; the first of a month only if the question names that day."""
    named = F.lower(fold(question)).rlike(FIRST_DAY)
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$") & (~value.endswith("-01") | named), value)


def last_user_turn(turns: DataFrame) -> DataFrame:
    """conv_id, question: the last user text, a greeting if there is none."""
    own = F.when(F.col("role") == "user", F.struct("turn", "text"))
    return turns.groupBy("conv_id").agg(F.max(own).alias("last")).select("conv_id", F.coalesce(F.nullif(F.col("last.text"), F.lit("")), F.lit(DEFAULT_QUESTION)).alias("question"))


def verdict(ranked: DataFrame) -> DataFrame:
    """query_id, verdict, top_score, relevant_count, n_sources of query_id, question, lexical_weight, id, source_id,
    year, published, score (all null but the first three for a query without rows)."""
    asked = years(F.col("question"))
    fits = (F.size(asked) == 0) | F.exists(asked, lambda y: (y.cast("int") == F.col("year")) | F.coalesce(F.col("published"), F.lit("")).contains(y))
    relevant = F.col("score") >= RELEVANT
    known = F.coalesce("source_id", F.lit("unknown"))
    sums = ranked.groupBy("query_id").agg(
        F.bool_or(F.coalesce(fits, F.lit(False))).alias("dated"), F.max("lexical_weight").alias("lexical"), F.count("id").alias("n"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("top_score"), F.count_if(relevant).alias("relevant_count"),
        F.countDistinct(F.when(relevant & (known != "unknown"), known)).alias("n_sources"),
    )
    sources, count, best = F.col("n_sources"), F.col("relevant_count"), F.col("top_score")
    specific = F.when((sources >= 1) & ((count >= 2) | (best >= SURE)), "SUFFICIENT").when(sources >= 1, "LOW_CONFIDENCE").otherwise("INSUFFICIENT")
    broad = F.when((count >= 3) & (sources >= 2), "SUFFICIENT").when((count >= 1) & (sources >= 1), "LOW_CONFIDENCE").otherwise("INSUFFICIENT")
    out = F.when((F.col("n") == 0) | ~F.col("dated"), "INSUFFICIENT").when(F.col("lexical") > 0.5, specific).otherwise(broad)
    return sums.select("query_id", out.alias("verdict"), "top_score", "relevant_count", "n_sources")


def citations(context: DataFrame) -> DataFrame:
    """query_id, sources: an array of (citation_id, label, url, published, score), in rank order, repeats by label, url
    and date left out."""
    label = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("url"), F.lit("")), F.lit(NO_TITLE))
    date = F.try_to_date(F.substring("published", 1, 10), "yyyy-MM-dd")
    rows = context.groupBy("query_id", label.alias("label"), "url", date.alias("published")).agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"))
    listed = F.sort_array(F.collect_list(F.struct("rank", "label", "url", "published", "score")))
    return rows.groupBy("query_id").agg(listed.alias("rows")).select(
        "query_id", F.transform("rows", lambda r, i: F.struct((i + 1).alias("citation_id"), r["label"].alias("label"), r["url"].alias("url"), r["published"].alias("published"), r["score"].alias("score"))).alias("sources")
    )


def cited(answer: Column, n: Column | int) -> Column:
    """The numbers in [Fuente N], in order, each once, 1 to n."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"(?i)\[fuente\s+(\d+)\]"), F.lit(1)), lambda x: F.try_to_number(x, F.lit("999999999")).cast("int")))
    return F.filter(found, lambda k: (k >= 1) & (k <= n))


def context(docs: Column) -> Column:
    """Numbered blocks of an array of structs title, published, url, text."""
    block = lambda d, i: F.concat(F.lit(BLOCK_HEAD), (i + 1).cast("string"), F.lit(BLOCK_TITLE), F.coalesce(d["title"], F.lit(NO_ARTICLE_TITLE)), F.lit(BLOCK_DATE), F.coalesce(d["published"], F.lit(NO_DATE)), F.lit(BLOCK_URL), F.coalesce(d["url"], F.lit("")), F.lit("\n---\n"), d["text"], F.lit("\n---"))
    return F.array_join(F.transform(docs, block), "\n\n")


# What a model may answer about a question.
INTENTS = ("CHITCHAT", "OUT_OF_SCOPE", "ARCHIVE_SEARCH")
PLAN = "intent string, year int, decade int, publication_date string, section string, newspaper string, search_query string"
#: The filters of a plan, all by equality.
PLAN_FILTERS = ("year", "decade", "publication_date", "section", "newspaper")


def planned(question: Column, answer: Column, newspaper: str | None = None) -> Column:
    """struct of intent, the filters and query. Small talk is told without a model; else the model's answer (JSON) counts
    if it names an intent, with its section and date put right; without such an answer the question is searched as it
    is, in the first year that it names."""
    said = F.from_json(answer, PLAN)
    ok = said["intent"].isin(*INTENTS)
    talk, none = intent(question) == "CHITCHAT", lambda kind: F.lit(None).cast(kind)
    paper = F.lit(newspaper).cast("string")
    pick = lambda of_talk, of_model, fallback: F.when(talk, of_talk).when(ok, of_model).otherwise(fallback)
    year = F.get(years(question), F.lit(0)).cast("int")
    return F.struct(
        pick(F.lit("CHITCHAT"), said["intent"], F.lit("ARCHIVE_SEARCH")).alias("intent"), pick(none("int"), said["year"], year).alias("year"),
        pick(none("int"), said["decade"], none("int")).alias("decade"), pick(none("string"), planned_date(said["publication_date"], question), none("string")).alias("publication_date"),
        pick(none("string"), planned_section(said["section"]), none("string")).alias("section"), pick(paper, F.coalesce(said["newspaper"], paper), paper).alias("newspaper"),
        pick(question, F.coalesce(F.nullif(F.trim(said["search_query"]), F.lit("")), question), question).alias("query"),
    )


def messages(question: Column, context: Column, system: str, user: str = "{question}") -> Column:
    """The turns that a model is given: {context} and {question} of the templates filled in."""
    turn = lambda role, template, slot, value: F.struct(F.lit(role).alias("role"), F.replace(F.lit(template), F.lit(slot), F.coalesce(value, F.lit(""))).alias("content"))
    return F.array(turn("system", system, "{context}", context), turn("user", user, "{question}", question))


def routed(plan: Column) -> Column:
    """Where a plan's question goes: small talk and other subjects are answered without a search."""
    return F.when(plan["intent"] == "CHITCHAT", "reply").when(plan["intent"] == "OUT_OF_SCOPE", "decline").otherwise("search")
