"""Lexicon matching and the scope of chunks and articles."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternmill.functions.text import fold, once
from lanternmill.functions.values import cosine

MIN_CHARS, MARGIN = 100, 0.15
CLASSES = ("argentina", "international", "unknown")
# Signals that stand without a model's word.
FIRM_SIGNALS = ("seccion:", "gazetteer:", "institution:", "political_org:", "club:", "term:", "emb_")


def norm(text: Column) -> Column:
    return F.lower(fold(text, "NFKD"))


def term_pattern(term: str, loose_spaces: bool = False) -> str:
    """The term between non-word characters; with loose_spaces, any white space matches its spaces."""
    body = r"\s+".join(map(re.escape, term.split(" "))) if loose_spaces else re.escape(term)
    return rf"(?iU)(?<!\w){body}(?!\w)"


def find_terms(text: Column, terms: list[str], loose_spaces: bool = False) -> Column:
    """The terms that a text has, in the list's order and spelling, each once. The lexicon is a parameter, so it is
    part of the plan; matching is one pass of native patterns over a text that is folded once."""
    return once(norm(text), lambda flat: find_folded(flat, terms, loose_spaces))


def find_folded(flat: Column, terms: list[str], loose_spaces: bool = False) -> Column:
    """find_terms of a text that norm has folded."""
    from unicodedata import combining, normalize

    plain = lambda t: "".join(c for c in normalize("NFKD", t) if not combining(c)).lower()
    found = [F.when(flat.rlike(term_pattern(plain(t), loose_spaces)), F.lit(t)) for t in dict.fromkeys(terms)]
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")


def whole_term(plain: Column) -> Column:
    """The pattern of a folded term between characters that are not of words."""
    return F.concat(F.lit(r"(?U)(?<!\w)\Q"), plain, F.lit(r"\E(?!\w)"))


#: Terms of match_lexicon up to which they are broadcast.
BROADCAST_TERMS = 1 << 16


def match_lexicon(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """id, term of docs (id, text) and terms (term): the same matches as find_terms, for lexicons too large for a plan.
    Texts and terms meet by equal runs of words, so it is an equi-join whatever the number of terms; the text between
    the words is verified after. Up to BROADCAST_TERMS terms go to the texts, which then are not shuffled."""
    words = lambda c: F.regexp_extract_all(norm(c), F.lit(r"(?U)\w+"), F.lit(0))
    known = terms.where(F.trim("term") != "").dropDuplicates(["term"]).select("term", norm(F.trim("term")).alias("plain"), words(F.col("term")).alias("w")).where(F.size("w") > 0)
    known = known.select("term", "plain", F.size("w").alias("size"), F.array_join("w", " ").alias("gram"))
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # lengths of terms, a handful
    own = docs.select("id", norm(F.col("text")).alias("flat"), words(F.col("text")).alias("w"))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    none = F.array().cast("array<string>")
    runs = F.array_distinct(F.concat(*[F.when(F.size("w") >= n, grams(n)).otherwise(none) for n in sizes])) if sizes else none
    if known.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        # a run keeps a reference to its text, which is written for none but those that are a term
        met = own.select("id", "flat", F.explode(runs).alias("gram")).join(F.broadcast(known), "gram")
        return met.where(F.regexp(F.col("flat"), whole_term(F.col("plain")))).select("id", "term").distinct()
    met = own.select("id", F.explode(runs).alias("gram")).join(known, "gram")
    # a text is read once for all the terms it may have, and isn't copied for every run of words
    asked = met.groupBy("id").agg(F.collect_set(F.struct("term", "plain")).alias("asked"))
    there = lambda x: F.regexp(F.col("flat"), whole_term(x["plain"]))
    found = own.alias("d").join(asked.alias("a"), F.col("d.id").eqNullSafe(F.col("a.id"))).select("d.id", F.filter("asked", there).alias("found"))
    return found.select("id", F.explode("found.term").alias("term")).distinct()


def is_known(value: Column, aliases: list[str]) -> Column:
    """Whether a place, whatever its case and accents, is one of the aliases."""
    plain = F.trim(norm(value))
    return (plain != "") & F.array_contains(F.transform(F.array(*map(F.lit, aliases)) if aliases else F.array().cast("array<string>"), lambda a: F.trim(norm(a))), plain)


def read_gazetteer(spark, path: str) -> "Lexicon":
    """The lexicon of a JSON file. Places come in the order country (or city), city, provinces, cities, neighbourhoods,
    nearby districts, landmarks, with repeats; lists named strong_ win over those without."""
    names = ["provinces", "cities", "neighborhoods", "nearby_partidos", "landmarks", "direct_argentina_sections", "ambiguous_institutions", "contextual_terms"]
    strong = {"institutions": "strong_institutions", "political_organizations": "strong_political_organizations", "clubs": "strong_clubs", "keywords": "strong_terms"}
    schema = "country string, city string, " + ", ".join(f"{n} array<string>" for n in [*names, *strong, *strong.values()])
    row = spark.read.schema(schema).option("multiLine", "true").json(path).first()  # one object
    if row is None or row.city is None:
        raise ValueError("the gazetteer names no city")
    of = lambda n: list(row[n] or [])
    places = [row.country or row.city, row.city, *[x for n in names[:5] for x in of(n)]]
    own = {n: of(s) or of(n) for n, s in strong.items()}
    return Lexicon(of("direct_argentina_sections"), places, own["institutions"], own["political_organizations"], own["clubs"], own["keywords"], of("ambiguous_institutions"), of("contextual_terms"))


# Kinds of signals of which a preview shows the first chunk each.
SIGNAL_KINDS = {"section": ("seccion:",), "lexicon": ("gazetteer:", "term:", "institution:", "political_org:", "club:"), "anchors": ("emb_",), "model": ("llm_",)}


def first_with_signals(chunks: DataFrame, order: str) -> DataFrame:
    """kind, found: for each kind of signal, the first chunk (a struct of its columns, by `order`) that has one; null for
    none. One pass."""
    has = lambda prefixes: F.exists("signals", lambda s: _any(s.startswith(p) for p in prefixes))
    firsts = chunks.agg(*[F.min_by(F.when(has(p), F.struct(*chunks.columns)), F.when(has(p), F.col(order))).alias(k) for k, p in SIGNAL_KINDS.items()])
    return firsts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("found")) for k in SIGNAL_KINDS])).alias("x")).select("x.*")


def primary_location(found: Column, country: str) -> Column:
    return F.when(F.array_contains(found, country), F.lit(country)).otherwise(F.get(found, F.lit(0)))


@dataclass
class Lexicon:
    """Terms that place a text: some alone decide (strong), some only hint (weak)."""

    sections: list[str] = field(default_factory=list)
    locations: list[str] = field(default_factory=list)
    institutions: list[str] = field(default_factory=list)
    political: list[str] = field(default_factory=list)
    clubs: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    weak_institutions: list[str] = field(default_factory=list)
    contextual: list[str] = field(default_factory=list)

    @staticmethod
    def direct(terms: list[str]) -> list[str]:
        """Those clear enough to be looked for in the text itself: with a space, or over four characters."""
        return [t for t in terms if " " in t or len(t) > 4]


def lexical_scope(text: Column, section: Column, organizations: Column, lexicon: Lexicon) -> Column:
    """struct<scope, signals> by the lexicon alone: a direct section decides; else any strong signal does. The text is
    folded once for all lists of terms, and not at all where its length or section decides."""
    tagged = lambda tag, found: F.transform(found, lambda t: F.concat(F.lit(tag), t))

    def named(term: str) -> Column:
        return F.when(F.exists(organizations, lambda o: norm(o) == norm(F.lit(term))), F.lit(term))

    inside = lambda terms: F.filter(F.array(*map(named, terms)), lambda x: x.isNotNull()) if terms else F.array().cast("array<string>")

    def strong(flat: Column, joined: Column) -> Column:
        return F.array_distinct(F.concat(
            tagged("gazetteer:", find_folded(flat, lexicon.locations)), tagged("institution:", inside(lexicon.institutions)),
            tagged("political_org:", inside(lexicon.political)), tagged("club:", inside(lexicon.clubs)),
            tagged("institution:", find_folded(joined, Lexicon.direct(lexicon.institutions), True)),
            tagged("political_org:", find_folded(joined, Lexicon.direct(lexicon.political), True)), tagged("term:", find_folded(joined, lexicon.terms, True)),
        ))

    def weak(joined: Column) -> Column:
        return F.concat(tagged("weak_institution:", find_folded(joined, lexicon.weak_institutions, True)), tagged("contextual_term:", find_folded(joined, lexicon.contextual, True)))

    result = lambda scope, signals: F.struct(F.lit(scope).alias("scope"), signals.alias("signals"))
    none = F.array().cast("array<string>")

    def by_terms(flat: Column) -> Column:
        # folding takes one character at a time, so the folded parts are those of the text and organizations put together
        joined = F.concat_ws(" ", flat["own"], flat["others"])
        return once(F.struct(strong(flat["own"], joined).alias("strong"), weak(joined).alias("weak")), lambda f: F.when(F.size(f["strong"]) > 0, result("argentina", F.concat(f["strong"], f["weak"]))).otherwise(result("unknown", f["weak"])))

    own = F.lower(F.trim(F.coalesce(section, F.lit(""))))
    return (
        F.when(F.length(F.trim(text)) < MIN_CHARS, result("unknown", none))
        .when(own.isin([s.lower() for s in lexicon.sections]) if lexicon.sections else F.lit(False), result("argentina", F.array(F.concat(F.lit("seccion:"), own))))
        .otherwise(once(F.struct(norm(text).alias("own"), norm(F.array_join(organizations, " ")).alias("others")), by_terms))
    )


def _nearest(vector: Column, anchors: dict[str, list[list[float]]]) -> Column:
    """The best cosine with an anchor of each of CLASSES, worked out once for all that is told of it."""
    return F.array(*[F.array_max(F.transform(F.array(*[F.array(*map(F.lit, a)) for a in anchors[c]]), lambda a: cosine(vector, a))) for c in CLASSES])


def _ahead(best: Column, margin: float) -> list[Column]:
    """scope, margin, final of the best scores of CLASSES. Ties keep their order."""
    ranked = F.sort_array(F.array(*[F.struct((-best[k]).alias("minus"), F.lit(k).alias("place"), F.lit(c).alias("name")) for k, c in enumerate(CLASSES)]))
    gap = ranked[1]["minus"] - ranked[0]["minus"]
    return [ranked[0]["name"].alias("scope"), F.round(gap, 6).alias("margin"), (gap > margin).alias("final")]


def anchor_scope(vector: Column, anchors: dict[str, list[list[float]]], margin: float = MARGIN) -> Column:
    """struct<scope, margin, final>: the class with the nearest anchor, final if ahead of the next by over the margin.
    Ties keep the order of CLASSES."""
    return F.transform(F.array(_nearest(vector, anchors)), lambda best: F.struct(*_ahead(best, margin)))[0]


def anchor_scores(vector: Column, anchors: dict[str, list[list[float]]], margin: float = MARGIN) -> Column:
    """struct<scope, final, signals>: as anchor_scope, with the scores and the margin as signals."""
    shown = lambda tag, x: F.format_string(f"emb_{tag}:%.3f", x)

    def told(best: Column) -> Column:
        (scope, _, final), scores = _ahead(best, margin), F.sort_array(best, asc=False)
        signals = F.array(*[shown(tag, best[k]) for k, tag in enumerate(("arg", "int", "unknown"))], shown("margin", scores[0] - scores[1]))
        return F.struct(F.when(final, scope).otherwise("unknown").alias("scope"), final.alias("final"), signals.alias("signals"))

    return F.transform(F.array(_nearest(vector, anchors)), told)[0]


#: Characters from which a model is asked, and how many it is shown.
MODEL_CHARS, PROMPT_CHARS = 150, 3500


def cascade(rows: DataFrame, lexicon: "Lexicon", anchors: dict[str, list[list[float]]] | None = None, ask=None, model: str = "", margin: float = MARGIN) -> DataFrame:
    """rows (text, section, organizations, vector and others) with scope and signals, by three layers: the lexicon; where
    that leaves a text of some length open, the anchors; where their margin is small, a model.

    ask takes the open texts (key, prompt), each text once whatever its number of rows, and gives key, answer; a null or
    missing answer is an error of the model. Rows without a vector skip the second layer, rows under MODEL_CHARS the third.
    """
    none = F.array().cast("array<string>")
    one = lexical_scope(F.col("text"), F.col("section"), F.col("organizations"), lexicon)
    own = rows.columns
    rows = rows.withColumn("_one", one)
    is_open = (F.col("_one.scope") == "unknown") & (F.length(F.trim("text")) >= MIN_CHARS)
    two = F.when(is_open & F.col("vector").isNotNull(), anchor_scores(F.col("vector"), anchors, margin)) if anchors else F.lit(None).cast("struct<scope:string,final:boolean,signals:array<string>>")
    rows = rows.withColumn("_two", two)
    grey = F.coalesce(is_open, F.lit(False)) & ~F.coalesce(F.col("_two.final"), F.lit(False))
    asked = grey & (F.length(F.trim("text")) >= MODEL_CHARS)
    rows = rows.withColumn("_key", F.when(asked, F.sha2("text", 256)) if ask else F.lit(None).cast("string"))
    if ask:
        texts = rows.where("_key is not null").groupBy(F.col("_key").alias("key")).agg(F.first(F.substring("text", 1, PROMPT_CHARS)).alias("prompt"))
        # rows that nothing is asked for have a key of their own, which no answer has: by null they would all be one task's
        plain = [c for c in own if not any(k in dict(rows.dtypes)[c] for k in ("map<", "variant", "interval"))]
        dealt = F.coalesce("_key", F.concat(F.lit("-"), F.xxhash64(*[rows[c] for c in plain]).cast("string")))
        rows = rows.withColumn("_key", dealt).join(ask(texts).select(F.col("key").alias("_key"), F.col("answer").alias("_answer")), "_key", "left")
    label = label_of(F.col("_answer")) if ask else F.lit("unknown")
    said = F.when(~asked, F.lit("llm_skipped:short_text")).otherwise(F.lit("llm_skipped:disabled"))
    if ask:
        said = F.when(~asked, F.lit("llm_skipped:short_text")).when(F.col("_answer").isNull(), F.lit(f"llm_error:{model}")).otherwise(F.concat(F.lit(f"llm_local:{model}:"), label))
    last = F.when(F.col("_answer").isNotNull(), label).otherwise("unknown") if ask else F.lit("unknown")
    scope = F.when(grey, last).when(F.coalesce(F.col("_two.final"), F.lit(False)), F.col("_two.scope")).otherwise(F.col("_one.scope"))
    signals = F.concat(F.col("_one.signals"), F.coalesce(F.col("_two.signals"), none), F.when(grey, F.array(said)).otherwise(none))
    return rows.withColumn("scope", scope).withColumn("signals", signals).drop("_one", "_two", "_key", "_answer")


def _votes() -> dict[str, Column]:
    """How many chunks (scope, signals) speak for what."""
    firm = F.exists("scope_signals", lambda s: F.lit(False) if not FIRM_SIGNALS else _any(s.startswith(p) for p in FIRM_SIGNALS))
    model = F.exists("scope_signals", lambda s: s.startswith("llm_local:"))
    here = F.col("country_scope") == "argentina"
    return {"_firm": F.count_if(here & firm), "_model": F.count_if(here & ~firm & model), "_abroad": F.count_if(F.col("country_scope") == "international")}


def _decided() -> Column:
    return F.when(F.col("_firm") > 0, "argentina").when(F.col("_model") >= 2, "argentina").when(F.col("_abroad") > 0, "international").otherwise("unknown")


def article_scope(chunks: DataFrame) -> DataFrame:
    """source_id, scope of source_id, scope, signals: a firm argentine chunk decides; then two that a model named; then
    any international one; else unknown."""
    named = chunks.select("source_id", F.col("scope").alias("country_scope"), F.col("signals").alias("scope_signals"))
    return named.groupBy("source_id").agg(*[v.alias(k) for k, v in _votes().items()]).select("source_id", _decided().alias("scope"))


def with_article_scope(chunks: DataFrame) -> DataFrame:
    """chunks (source_id, country_scope, scope_signals) with article_country_scope, for chunks that are dealt by their
    source already: a window then needs no shuffle, where article_scope and a join would work out the chunks twice."""
    own = Window.partitionBy("source_id")
    return chunks.withColumns({k: v.over(own) for k, v in _votes().items()}).withColumn("article_country_scope", _decided()).drop(*_votes())


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def in_index_scope(article: Column, chunk: Column, wanted: str = "argentina") -> Column:
    """Whether the article's scope, or else the chunk's, is one of a comma-separated list; 'all' takes everything."""
    names = [x.strip().lower() for x in wanted.split(",") if x.strip()]
    if "all" in names:
        return F.lit(True)
    return F.lower(F.coalesce(F.nullif(article, F.lit("")), F.nullif(chunk, F.lit("")), F.lit(""))).isin(names)


def label_of(answer: Column) -> Column:
    """The first word of a model's answer without marks, if it is a class."""
    word = F.lower(F.btrim(F.get(F.split(F.trim(answer), r"\s+"), F.lit(0)), F.lit(".,;:!?")))
    return F.when(word.isin(*CLASSES), word).otherwise("unknown")
