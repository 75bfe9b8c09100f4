"""Queries of chunks, scope, urls, html, cleaning, dates, stores and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternmill.functions import html as H
from lanternmill.functions import text as T
from lanternmill.functions import values as V
from lanternmill.operators import answers as A
from lanternmill.operators import archive
from lanternmill.operators import chunks as C
from lanternmill.operators import batch, lexicon, models
from lanternmill.operators import retrieval as R
from lanternmill.operators import scope as S
from lanternmill.operators import store as ST
from lanternmill.plans import stand_ins
from lanternmill.plans.retrieval import _bm25_sql as bm25_sql
from lanternmill.session import shared_path, spread, stored, table
from lanternmill.sources import tables
from lanternmill.streaming import ingest

TERMS = ["the", "of and", "ing", "nicht", "la", "des"]
LEXICON = S.Lexicon(sections=["src1", "src2"], locations=["la", "der"], institutions=["in the", "tion"], terms=["nicht"], weak_institutions=["des"], contextual=["que"])


def _texts(spark: SparkSession, d: str, *columns) -> DataFrame:
    return spread(table(spark, d, "documents").select(*columns or ("doc_id", "text")))


def _html(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "pages").select("page_id", "html"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, F.col("doc_id").cast("string").alias("source_id"), "text")


def chunk_fixed(spark, d):
    return C.fixed(_sources(spark, d)).select("source_id", F.col("chunk_index").cast("long"), F.col("total_chunks").cast("long"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def chunk_recursive(spark, d):
    return C.recursive(_sources(spark, d)).select("source_id", F.col("chunk_index").cast("long"), F.col("total_chunks").cast("long"), F.length("text").cast("long").alias("n_chars"))


def chunk_index_totals(spark, d):
    rows = table(spark, d, "documents").select(F.when(F.col("doc_id") % 50 != 0, F.col("source")).alias("source_id"), "doc_id")
    return C.number(rows, "doc_id").select("doc_id", "source_id", "chunk_index", "total_chunks")


def rebuild_articles(spark, d):
    chunks = C.fixed(_sources(spark, d))
    ranked = table(spark, d, "labels").select((F.col("quality").cast("long")).alias("query_id"), F.col("doc_id").cast("string").alias("source_id"), F.col("doc_id").alias("rank"), (1 / (60 + F.col("doc_id"))).alias("score"))
    return C.rebuild(chunks, ranked, 5).select("query_id", "source_id", "rank", F.round("score", 8).alias("score"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def lexicon_match(spark, d):
    rows = _texts(spark, d).select("doc_id", F.posexplode(S.find_terms(F.col("text"), TERMS)).alias("pos", "term"))
    return rows.select("doc_id", F.col("pos").cast("long"), "term")


def primary_location(spark, d):
    found = S.find_terms(F.col("text"), TERMS)
    return _texts(spark, d).select("doc_id", S.primary_location(found, "la").alias("location"))


def _scopes(spark, d):
    docs = _texts(spark, d, "doc_id", "lang", "source", "text")
    own = S.lexical_scope(F.col("text"), F.col("source"), F.array().cast("array<string>"), LEXICON)
    return docs.select("doc_id", "lang", "source", own.alias("s")).select("doc_id", "lang", "source", "s.scope", "s.signals")


def scope_lexical(spark, d):
    return _scopes(spark, d).select("doc_id", "scope", F.array_join("signals", "|").alias("signals"))


def article_scope(spark, d):
    chunks = _scopes(spark, d).select(F.col("source").alias("source_id"), F.when((F.col("scope") == "unknown") & (F.col("lang") == "en"), "international").otherwise(F.col("scope")).alias("scope"), "signals")
    return S.article_scope(chunks)


def index_scope_filter(spark, d):
    docs = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "Argentina").otherwise("").alias("article"), F.when(F.col("toxic") == 1, "unknown").alias("chunk"))
    return docs.where(S.in_index_scope(F.col("article"), F.col("chunk"), "argentina, unknown")).select("doc_id")


def scope_histogram(spark, d):
    return _scopes(spark, d).groupBy("source", "scope").agg(F.count("*").alias("n"))


def facets(spark, d):
    return ST.facets(table(spark, d, "documents").withColumn("lang", F.when(F.col("doc_id") % 10 != 0, F.col("lang"))), ["lang", "source"])


def url_parts(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", V.url_host(url).alias("host"), V.url_path(url).alias("path"), V.without_fragment(url).alias("clean"), V.safe_file_name(V.url_path(url)).alias("file_name"))


def url_predicate(spark, d):
    url = F.col("url")
    dated = F.concat(F.lit("https://a.example.com/diario/suplementos/x/"), F.col("page_id").cast("string"), F.lit("-2024-"), F.lpad((F.col("page_id") % 14).cast("string"), 2, "0"), F.lit("-11.html"))
    return table(spark, d, "pages").select("page_id", V.is_article_url(url).alias("article"), V.is_archive_url(dated).alias("archive"), V.url_date(dated).cast("string").alias("day"), V.url_section(dated).alias("section"))


def link_explode(spark, d):
    pages = table(spark, d, "pages")
    return H.links(pages).join(pages.select("page_id", "url"), "page_id").select("page_id", F.col("pos").cast("long"), V.without_fragment(F.col("href")).alias("href"), "text", (V.url_host(H.absolute(F.col("href"), F.col("url"))) == V.url_host(F.col("url"))).alias("same_host"))


def first_links(spark, d):
    own = Window.partitionBy("href").orderBy("page_id", "pos")
    return H.links(table(spark, d, "pages")).withColumn("k", F.row_number().over(own)).where("k = 1").select("href", "page_id", F.col("pos").cast("long"))


def top_n_per_host(spark, d):
    pages = table(spark, d, "pages").select("page_id", V.url_host(F.col("url")).alias("host"))
    return ST.top_per_group(pages, "host", "page_id", 3)


def edition_links(spark, d):
    """The links to articles of a dated archive in each page, to which two are added: an article's and an index's."""
    n = F.col("page_id").cast("string")
    more = F.concat("html", F.lit('<div><a href="../x/../diario/elpais/1-'), n, F.lit('-2024-05-06.html#top">Nota <b>'), n, F.lit('</b></a></div><a href="/diario/secciones/index-2024-05-06.html">no</a>'))
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://archivo.example.com/a/"), n).alias("url"), more.alias("html"))
    return H.edition_links(pages).select("page_id", "link", "title", "section")


def html_text(spark, d):
    return _html(spark, d).select("page_id", H.title(F.col("html")).alias("title"), F.md5(F.encode(H.plain_text(F.col("html")), "UTF-8")).alias("text_md5"), (F.length(H.plain_text(F.col("html"))) >= H.MIN_TEXT).alias("kept"))


def html_parsed(spark, d):
    return _html(spark, d).select("page_id", F.length(H.parsed_text(F.col("html"))).cast("long").alias("n_chars"))


def clean_text(spark, d):
    marked = F.concat(F.lit("{{< note >}}\n<b>"), F.col("text"), F.lit("</b>\n-----\n\n\n\n![x](a.png) end  \n"))
    return _texts(spark, d).select("doc_id", F.md5(F.encode(T.clean_markdown(marked), "UTF-8")).alias("text_md5"))


def whitespace(spark, d):
    return _texts(spark, d).select("doc_id", F.md5(F.encode(T.collapse(F.col("text")), "UTF-8")).alias("text_md5"), T.truncate(F.col("text"), 40).alias("preview"))


def mojibake(spark, d):
    broken = F.concat(F.lit("â€œ"), F.col("text"), F.lit("â€¦"))
    fixed = T.replace_broken_punctuation(F.when(F.col("doc_id") % 2 == 0, broken).otherwise(F.col("text")))
    return _texts(spark, d).select("doc_id", F.md5(F.encode(fixed, "UTF-8")).alias("text_md5"))


def year_extract(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.years(F.concat_ws(" ", F.lit("del"), F.date_format("o_orderdate", "dd-MM-yyyy"), F.col("o_orderkey").cast("string"))), ",").alias("years"))


def date_coerce(spark, d):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-13-dd")).otherwise(" s/f ")
    day = V.date_of(raw)
    return table(spark, d, "orders").select("o_orderkey", day.cast("string").alias("day"), F.year(day).alias("year"), V.decade_of(F.year(day)).alias("decade"), V.coerce_date(raw).alias("coerced"))


def point_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", V.point_id(F.when(F.col("doc_id") % 4 != 0, F.concat(F.col("doc_id").cast("string"), F.lit("::chunk::0"))), F.col("text")).alias("point_id"))


def upsert_latest(spark, d):
    e = table(spark, d, "events")
    store = e.where("event_id % 3 = 0").select(F.col("user_id").alias("point_id"), "value").dropDuplicates(["point_id"]).withColumn("value", F.lit(-1.0))
    return ST.upsert(store, e.select(F.col("user_id").alias("point_id"), "value", F.col("event_id").alias("seq"))).select("point_id", "value")


def dedupe_by_hash(spark, d):
    return table(spark, d, "documents").groupBy(F.sha1(F.encode("text", "UTF-8")).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def skip_existing(spark, d):
    return ST.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), "doc_id")


def vector_reuse(spark, d):
    docs, known = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id")), table(spark, d, "embeddings").where("vec_id % 5 <> 0").select("vec_id", F.col("embedding").alias("vector"))
    stand_in = F.array(F.col("vec_id").cast("float"), F.lit(1.0).cast("float"))
    out = ST.fill_vectors(docs, known, "vec_id", stand_in)
    return out.select("vec_id", "reused", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"), F.size("vector").cast("long").alias("dim"))


def evidence_verdict(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(
        (F.col("doc_id") % 97).alias("query_id"), F.concat(F.lit("que paso en "), F.when(F.col("doc_id") % 97 % 3 == 0, "1999").otherwise("la ciudad")).alias("question"), F.when(F.col("doc_id") % 97 % 2 == 0, 0.6).otherwise(0.4).alias("lexical_weight"),
        F.col("doc_id").alias("id"), F.col("source").alias("source_id"), (1990 + F.col("doc_id") % 13).cast("int").alias("year"), F.lit(None).cast("string").alias("published"), ((F.col("doc_id") * 37 % 100) / 250 + F.col("quality") * 0.01).alias("score"),
    )
    return A.verdict(rows).withColumn("top_score", F.round("top_score", 6))


def last_user_turn(spark, d):
    return A.last_user_turn(table(spark, d, "conversations"))


def chitchat_intent(spark, d):
    turns = table(spark, d, "conversations")
    polite = F.when(F.col("turn") % 2 == 0, "Hola, buenas tardes!").otherwise("Muchas gracias.")
    return turns.select("conv_id", "turn", A.intent(F.col("text")).alias("intent"), A.intent(polite).alias("polite"), A.intent(F.concat(polite, F.lit(" "), F.col("text"))).alias("both"))


def query_plan(spark, d):
    asked = F.concat(F.lit("notas de "), F.when(F.col("turn") % 2 == 0, "1998 y 2003: ").otherwise(""), F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", A.plan(asked).alias("p")).select("conv_id", "turn", F.col("p.intent").alias("intent"), F.col("p.year").alias("year"))


def cited_sources(spark, d):
    answer = F.concat(F.lit("Ver [Fuente "), (F.col("doc_id") % 7).cast("string"), F.lit("] y [fuente 2], [Fuente 9] y [Fuente 2]"))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(A.cited(answer, 5), lambda x: x.cast("string")), ",").alias("cited"))


def citations(spark, d):
    pages = table(spark, d, "pages")
    rows = pages.select((F.col("page_id") % 10).alias("query_id"), F.col("page_id").alias("rank"), F.when(F.col("page_id") % 3 != 0, V.url_host(F.col("url"))).alias("title"), V.url_host(F.col("url")).alias("url"), F.lit("2024-05-06").alias("published"), (1.0 / (1 + F.col("page_id"))).alias("score"))
    out = A.citations(rows).select("query_id", F.explode("sources").alias("s"))
    return out.select("query_id", F.col("s.citation_id").cast("long").alias("citation_id"), F.col("s.label").alias("label"), F.col("s.published").cast("string").alias("published"), F.round("s.score", 6).alias("score"))


def date_range_coverage(spark, d):
    days = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-02-05')) AS day")
    seen = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.join(seen, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_day_ingest(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))



def planned_query(spark, d):
    """Plans by a stated model answer a turn: none, one of each intent with filters, and one that isn't JSON."""
    k = F.col("turn") % 4
    answer = F.when(k == 1, '{"intent":"OUT_OF_SCOPE"}').when(k == 2, '{"intent":"ARCHIVE_SEARCH","year":2004,"publication_date":"2004-05-01","section":"El Pa\u00eds","search_query":"  "}').when(k == 3, "not json")
    p = A.planned(F.col("text"), answer, "diario")
    return table(spark, d, "conversations").select("conv_id", "turn", p.alias("p"), A.routed(p).alias("route")).select("conv_id", "turn", "route", "p.intent", "p.year", "p.publication_date", "p.section", "p.newspaper", F.md5("p.query").alias("query_md5"))


def scope_cascade(spark, d):
    """All three layers: the lexicon, twelve stated anchors, and a stand-in for a model that is asked once a text."""
    docs, e = _texts(spark, d, "doc_id", "text", "source"), table(spark, d, "embeddings")
    found = e.where("vec_id < 12").orderBy("vec_id").collect()  # twelve stated anchors, four a class
    anchors = {c: [list(map(float, r.embedding)) for r in found if r.vec_id % 3 == k] for k, c in enumerate(S.CLASSES)}
    rows = docs.join(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id", "left")
    rows = rows.select("doc_id", "text", F.col("source").alias("section"), F.array().cast("array<string>").alias("organizations"), "vector")
    ask = lambda texts: texts.select("key", F.when(F.col("prompt").contains("ing"), "International, creo.").when(F.col("prompt").contains("ado"), "argentina").alias("answer"))
    few = S.Lexicon(sections=["src1"], locations=["der"], terms=["nicht"], contextual=["que"])
    return S.cascade(rows, few, anchors, ask, "stand-in", 0.05).select("doc_id", "scope", F.array_join("signals", "|").alias("signals"))


def lexicon_join(spark, d):
    """The matches of lexicon_match by an equi-join of runs of words."""
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    return S.match_lexicon(_texts(spark, d, F.col("doc_id").alias("id"), "text"), terms).select(F.col("id").alias("doc_id"), "term")


def lexicon_automaton(spark, d):
    """All words of the benchmark texts as a lexicon, looked for in every document by one automaton."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))
    terms = table(spark, d, "benchmark").select(F.explode(words).alias("term")).distinct()
    found = lexicon.match(_texts(spark, d, F.col("doc_id").alias("id"), "text"), terms)
    per = found.groupBy(F.col("id").alias("doc_id")).agg(F.collect_set(T.fold(F.col("term"), "NFKD")).alias("t"))
    return per.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.encode(F.array_join(F.sort_array("t"), " "), "UTF-8")).alias("terms_md5"))


def model_rerank(spark, d):
    """Two stand-in models over the benchmark's questions and their five best documents: one that counts letters, and one
    that fails on some texts, whose questions keep the order they had."""
    docs, asked = _texts(spark, d, F.col("doc_id").alias("id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    best = batch.bm25_top(docs, asked, 5)
    pairs = stored(best.join(docs, "id").join(asked.withColumnRenamed("text", "question"), "query_id").withColumn("position", F.col("rank")), "pairs")
    cache = shared_path(spark, "answers")
    rows = [models.rerank(pairs, m, 3, cache).withColumn("model", F.lit(m.name)) for m in (models.Model("letters", stand_ins.letters), models.Model("brittle", stand_ins.brittle, tries=1))]
    return rows[0].unionByName(rows[1]).select("model", "query_id", "id", F.round("rerank_score", 6).alias("rerank_score"), "rerank_position", F.col("error").isNotNull().alias("failed"))


def known_location(spark, d):
    place = F.concat(F.when(F.col("doc_id") % 2 == 0, " Córdoba ").otherwise(" x"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")))
    return table(spark, d, "documents").select("doc_id", S.is_known(place, ["CORDOBA", "Xsrc1"]).alias("known"))


def signal_previews(spark, d):
    return S.first_with_signals(_scopes(spark, d), "doc_id").select("kind", F.col("found.doc_id").alias("doc_id"))


def page_metadata(spark, d):
    n = F.col("page_id")
    head = F.concat(
        F.when(n % 2 == 0, "<meta property='og:title' content='  Un  t\u00edtulo '>").otherwise("<meta name='twitter:title' content=''>"), F.when(n % 3 == 0, '<meta name="author" content="Ana">').otherwise(""),
        F.when(n % 5 == 0, "<meta name='section' content='Sociedad'>").otherwise("<p class='nota-seccion chica'>El <b>mundo</b></p>"), F.when(n % 4 == 0, '<meta itemprop="datePublished" content="2004-05-06T10:00">').otherwise(""),
    )
    page, own = F.concat(head, F.col("html")), F.when(n % 7 == 0, "Propio")
    return _html(spark, d).select("page_id", H.title(page, own).alias("title"), H.author(page).alias("author"), H.section(page, own).alias("section"), H.published(page).alias("published"))


def markdown_documents(spark, d):
    n = F.col("doc_id")
    block = F.when(n % 3 == 0, "---\ntitle: 'Un t\u00edtulo'\nkeywords: [a, \"b c\"]\ntags: solo\n---\n").when(n % 3 == 1, "---\ndescription: d\ntags:\n- x\n- 'y z'\n---\n").otherwise("")
    docs = _texts(spark, d).select("doc_id", F.concat(block, F.col("text"), F.lit("  \n\n\n\n<b>fin</b>")).alias("text"))
    return T.markdown_documents(docs).select("doc_id", "doc_title", "doc_description", "keywords", "tags", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def section_limit(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit(" "), F.upper("source"))).alias("section"))
    return ST.wanted(rows, "doc_id", ["SRC1", " src2 ", "none", ""], 5, 12)


def inspect_listing(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("section"), F.col("source").alias("country_scope"), "text")
    return ST.inspect(docs, {"section": "es", "country_scope": None}, "doc_id", 25, 60)[0].select("doc_id", "section", "text")


def inspect_facets(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("section"), F.col("source").alias("country_scope"), "text")
    return ST.inspect(docs, {}, "doc_id", 40)[1]


def edition_pages(spark, d):
    day = V.date_argument(F.date_format("o_orderdate", "dd-MM-yyyy"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(V.edition_urls(day, "https://h"), " ").alias("urls"), V.article_path(day, F.lit("https://h/a/b c.html?x")).alias("path"))


def archive_answers(spark, d):
    """All documents in, the questions of the benchmark table out, by the whole chain with its stand-in models."""
    docs = _texts(spark, d, F.col("doc_id").cast("string").alias("source_id"), F.concat(F.lit("Nota "), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("section"), F.col("lang").alias("newspaper"), F.lit("2001-05-06").alias("published"), "text")
    indexed = stored(archive.index(archive.enrich(docs, LEXICON), "all"), "index")  # many branches of an answer read it
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return archive.answer(indexed, asked).select("query_id", "intent", "verdict", F.round("top_score", 6).alias("top_score"), F.size("sources").cast("long").alias("n_sources"))


COLLECTION = "point_id string, text string, section string, year int"


def collection_upsert(spark, d):
    """Two loads into one collection: all documents, then the labelled ones with a new text, some of them in another year.
    What the second load does not name stays."""
    path = shared_path(spark, "collection")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("point_id"), "text", F.col("source").alias("section"), (1990 + F.col("doc_id") % 7).cast("int").alias("year"))
    tables.upsert_collection(spark, path, COLLECTION, docs)
    labels = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("point_id"), "quality")
    tables.upsert_collection(spark, path, COLLECTION, docs.join(labels, "point_id").withColumn("text", F.concat("text", F.lit(" (corregido)"))).withColumn("year", F.col("year") + F.col("quality")))
    live = tables.collection(spark, path, COLLECTION)
    return live.where("year between 1991 and 1994").select("point_id", "section", "year", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def stream_ingest(spark, d):
    """The same counts as per_day_ingest, of rows that a stream has loaded file by file."""
    base = shared_path(spark, "stream")
    schema = table(spark, d, "events").schema
    ingest.load_new(ingest.read_folder(spark, d, schema, "events.parquet"), f"{base}/rows", f"{base}/state")
    loaded = spark.read.schema(schema).parquet(f"{base}/rows")
    return loaded.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


QUERIES = {f.__name__: f for f in (
    chunk_fixed, chunk_recursive, chunk_index_totals, rebuild_articles, lexicon_match, primary_location, scope_lexical, article_scope, index_scope_filter,
    scope_histogram, facets, url_parts, url_predicate, link_explode, first_links, top_n_per_host, edition_links, html_text, html_parsed, clean_text, whitespace, mojibake,
    year_extract, date_coerce, point_ids, upsert_latest, dedupe_by_hash, skip_existing, vector_reuse, evidence_verdict, last_user_turn, chitchat_intent,
    query_plan, planned_query, scope_cascade, lexicon_join, lexicon_automaton, model_rerank, known_location, signal_previews, page_metadata, markdown_documents, section_limit, inspect_listing, inspect_facets, edition_pages, cited_sources, citations, date_range_coverage, per_day_ingest, collection_upsert, stream_ingest, archive_answers,
)}


def _has(text: str, term: str) -> str:
    return f"regexp_matches(lower(strip_accents({text})), '(^|[^\\p{{L}}\\p{{N}}_]){term}([^\\p{{L}}\\p{{N}}_]|$)')"


_FOUND = "list_filter([" + ", ".join(f"CASE WHEN {_has('text', t)} THEN '{t}' END" for t in TERMS) + "], lambda x: x IS NOT NULL)"
_SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}', ' ', 'g'))"


def _loose(term: str) -> str:
    return _has("text", term.replace(" ", r"\s+"))


_STRONG = [("gazetteer:", "la", _has("text", "la")), ("gazetteer:", "der", _has("text", "der")), ("institution:", "in the", _loose("in the")), ("term:", "nicht", _loose("nicht"))]
_WEAK = [("weak_institution:", "des", _loose("des")), ("contextual_term:", "que", _loose("que"))]
_list = lambda rows: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{tag}{t}' END" for tag, t, c in rows) + "], lambda x: x IS NOT NULL)"
_SCOPES = f"""sc AS (SELECT doc_id, lang, source, CASE WHEN length(trim(text)) < 100 THEN 'unknown' WHEN source IN ('src1', 'src2') OR len({_list(_STRONG)}) > 0 THEN 'argentina' ELSE 'unknown' END AS scope,
CASE WHEN length(trim(text)) < 100 THEN [] WHEN source IN ('src1', 'src2') THEN ['seccion:' || source] ELSE {_list(_STRONG)} || {_list(_WEAK)} END AS signals FROM documents)"""
_HOST, _PATH = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))", "regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"
_LINKS = r"links AS (SELECT page_id, url, pos - 1 AS pos, regexp_extract(tag, '(?is)href\s*=\s*[\"'']([^\"'']*)[\"'']', 1) AS href, " + _flat("regexp_replace(tag, '<[^>]*>', ' ', 'g')") + r" AS text FROM (SELECT page_id, url, unnest(tags) AS tag, unnest(range(1, len(tags) + 1)) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*href\s*=\s*[\"''][^\"'']*[\"''][^>]*>.*?</a>') AS tags FROM pages)))"
_LINKS = _LINKS.replace('\\"', '"')
_FIXED = "c AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, k AS chunk_index, 1 + (length(text) - 1) // 780 AS total_chunks, substr(text, CAST(k * 780 + 1 AS BIGINT), 900) AS text FROM (SELECT doc_id, text, unnest(range(1 + (length(text) - 1) // 780)) AS k FROM documents WHERE length(text) > 0))"
_BODY = r"""coalesce(nullif(regexp_extract(html, '(?is)<article\b[^>]*>(.*)</article>', 1), ''), html)"""
for _t in ("script", "style", "nav", "footer", "aside"):
    _BODY = rf"regexp_replace({_BODY}, '(?is)<{_t}\b[^>]*>.*?</{_t}>', ' ', 'g')"
_BODY = f"regexp_replace({_BODY}, '<[^>]*>', ' ', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
    _BODY = f"replace({_BODY}, '{_a}', '{_b}')"
_BODY = _flat(_BODY)
_INNER = lambda tag: "nullif(" + _flat(f"regexp_replace(regexp_extract(html, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}>', 1), '<[^>]*>', ' ', 'g')") + ", '')"
_TALK = " OR ".join(f"regexp_matches(said, '(?i){p.replace(chr(39), chr(39) * 2)}')" for p in A.SMALL_TALK)
_BROKEN = "x"
for _a, _b in T.MOJIBAKE_PUNCTUATION.items():
    _BROKEN = f"replace({_BROKEN}, '{_a.replace(chr(0x9D), '')}' || {'chr(157)' if chr(0x9D) in _a else repr('')}, '{_b.replace(chr(39), chr(39) * 2)}')"
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '\{\{[<%][\s\S]*?[%>]\}\}', '', 'g'), '</?[a-zA-Z][^>]*>', '', 'g'), '!\[([^\]]*)\]\(([^)]+)\)', '[Imagen: \1]', 'g'), '(?m)^\s*[-=_]{3,}\s*$', '', 'g'), '(?m)[ \t]+$', '', 'g')"

SQL = {
    "chunk_fixed": f"WITH {_FIXED} SELECT source_id, chunk_index, total_chunks, md5(text) AS text_md5 FROM c",
    "chunk_index_totals": "WITH s AS (SELECT doc_id, coalesce(CASE WHEN doc_id % 50 <> 0 THEN source END, 'unknown') AS source_id FROM documents) SELECT doc_id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) - 1 AS chunk_index, count(*) OVER (PARTITION BY source_id) AS total_chunks FROM s",
    "rebuild_articles": f"WITH {_FIXED}, r AS (SELECT CAST(quality AS BIGINT) AS query_id, CAST(doc_id AS VARCHAR) AS source_id, doc_id AS rank, 1 / (60 + doc_id)::DOUBLE AS score FROM labels QUALIFY row_number() OVER (PARTITION BY quality ORDER BY doc_id) <= 5) SELECT query_id, source_id, rank, round(score, 8) AS score, md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index)) AS text_md5 FROM r JOIN c USING (source_id) GROUP BY ALL",
    "lexicon_match": f"WITH f AS (SELECT doc_id, {_FOUND} AS found FROM documents) SELECT doc_id, unnest(range(len(found))) AS pos, unnest(found) AS term FROM f",
    "primary_location": f"WITH f AS (SELECT doc_id, {_FOUND} AS found FROM documents) SELECT doc_id, CASE WHEN list_contains(found, 'la') THEN 'la' ELSE found[1] END AS location FROM f",
    "scope_lexical": f"WITH {_SCOPES} SELECT doc_id, scope, array_to_string(signals, '|') AS signals FROM sc",
    "article_scope": f"WITH {_SCOPES}, c AS (SELECT source AS source_id, CASE WHEN scope = 'unknown' AND lang = 'en' THEN 'international' ELSE scope END AS scope FROM sc) SELECT source_id, CASE WHEN bool_or(scope = 'argentina') THEN 'argentina' WHEN bool_or(scope = 'international') THEN 'international' ELSE 'unknown' END AS scope FROM c GROUP BY source_id",
    "index_scope_filter": "SELECT doc_id FROM labels WHERE quality = 1 OR toxic = 1",
    "scope_histogram": f"WITH {_SCOPES} SELECT source, scope, count(*) AS n FROM sc GROUP BY ALL",
    "facets": "WITH s AS (SELECT coalesce(CASE WHEN doc_id % 10 <> 0 THEN lang END, 'missing') AS lang, coalesce(source, 'missing') AS source FROM documents) SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'source' END AS facet, coalesce(lang, source) AS value, count(*) AS n FROM s GROUP BY GROUPING SETS ((lang), (source))",
    "url_parts": f"WITH p AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path FROM pages), f AS (SELECT *, regexp_replace(string_split(path, '/')[-1], '[^a-zA-Z0-9._-]+', '-', 'g') AS base FROM p) SELECT page_id, host, path, regexp_replace(url, '#.*$', '') AS clean, CASE WHEN ends_with(base, '.html') THEN base ELSE base || '.html' END AS file_name FROM f",
    "url_predicate": f"WITH p AS (SELECT page_id, {_PATH} AS path, page_id % 14 AS m FROM pages) SELECT page_id, path <> '' AND path <> '/' AND " + " AND ".join(f"NOT contains(path, '{b}')" for b in V.BLOCKED_PATHS) + " AS article, m BETWEEN 1 AND 12 AS archive, CASE WHEN m BETWEEN 1 AND 12 THEN '2024-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-11' END AS day, 'suplementos/x' AS section FROM p",
    "link_explode": f"WITH {_LINKS}, a AS (SELECT *, regexp_replace(href, '#.*$', '') AS h FROM links) SELECT page_id, pos, h AS href, text, CASE WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN lower(regexp_extract(h, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) = {_HOST} WHEN starts_with(h, '//') THEN lower(regexp_extract(h, '^//([^/?#]*)', 1)) = {_HOST} ELSE true END AS same_host FROM a",
    "first_links": f"WITH {_LINKS} SELECT href, page_id, pos FROM links QUALIFY row_number() OVER (PARTITION BY href ORDER BY page_id, pos) = 1",
    "top_n_per_host": f"SELECT page_id, {_HOST} AS host FROM pages QUALIFY row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) <= 3",
    "html_text": f"SELECT page_id, coalesce({_INNER('h1')}, {_INNER('title')}) AS title, md5({_BODY}) AS text_md5, length({_BODY}) >= 120 AS kept FROM pages",
    "clean_text": "WITH d AS (SELECT doc_id, '{{< note >}}' || chr(10) || '<b>' || text || '</b>' || chr(10) || '-----' || repeat(chr(10), 4) || '![x](a.png) end  ' || chr(10) AS m FROM documents) SELECT doc_id, md5(trim(regexp_replace(regexp_replace(" + _CLEAN + r", '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g'))) AS text_md5 FROM d",
    "whitespace": f"WITH d AS (SELECT doc_id, {_flat('text')} AS t FROM documents) SELECT doc_id, md5(t) AS text_md5, CASE WHEN length(t) > 40 THEN substr(t, 1, 37) || '...' ELSE t END AS preview FROM d",
    "mojibake": f"WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'â€œ' || text || 'â€¦' ELSE text END AS x FROM documents) SELECT doc_id, md5(CASE WHEN contains(x, 'Ã') OR contains(x, 'â€') OR contains(x, 'Â') THEN {_BROKEN} ELSE x END) AS text_md5 FROM d",
    "year_extract": r"SELECT o_orderkey, array_to_string(list_transform(regexp_extract_all('del ' || strftime(o_orderdate, '%d-%m-%Y') || ' ' || o_orderkey, '\b(?:19|20)\d{2}\b'), lambda x: x), ',') AS years FROM orders",
    "date_coerce": "WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-13-%d') ELSE ' s/f ' END AS raw FROM orders), c AS (SELECT o_orderkey, raw, try_cast(substr(raw, 1, 10) AS DATE) AS d FROM r) SELECT o_orderkey, CAST(coalesce(d, DATE '1900-01-01') AS VARCHAR) AS day, CAST(year(coalesce(d, DATE '1900-01-01')) AS INTEGER) AS year, CAST(year(coalesce(d, DATE '1900-01-01')) // 10 * 10 AS INTEGER) AS decade, coalesce(CAST(d AS VARCHAR), trim(raw)) AS coerced FROM c",
    "point_ids": "WITH n AS (SELECT doc_id, sha1('\\x6B\\xA7\\xB8\\x11\\x9D\\xAD\\x11\\xD1\\x80\\xB4\\x00\\xC0\\x4F\\xD4\\x30\\xC8'::BLOB || encode(coalesce(CASE WHEN doc_id % 4 <> 0 THEN doc_id || '::chunk::0' END, sha1(text)))) AS h FROM documents) SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', 1 + (instr('0123456789abcdef', h[17]) - 1) % 4, 1) || h[18:20] || '-' || h[21:32] AS point_id FROM n",
    "upsert_latest": "SELECT user_id AS point_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "dedupe_by_hash": "SELECT sha1(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha1(text)",
    "skip_existing": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "vector_reuse": "SELECT doc_id AS vec_id, embedding IS NOT NULL AS reused, round(CASE WHEN embedding IS NULL THEN doc_id ELSE embedding[1] END::DOUBLE, 6) AS first, CASE WHEN embedding IS NULL THEN 2 ELSE len(embedding) END AS dim FROM documents LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 5 <> 0) e ON e.vec_id = doc_id",
    "evidence_verdict": "WITH r AS (SELECT doc_id % 97 AS query_id, doc_id % 97 % 3 = 0 AS dated, CASE WHEN doc_id % 97 % 2 = 0 THEN 0.6 ELSE 0.4 END AS w, source, 1990 + doc_id % 13 AS year, (doc_id * 37 % 100) / 250::DOUBLE + quality * 0.01::DOUBLE AS score FROM labels JOIN documents USING (doc_id)), a AS (SELECT query_id, bool_or(NOT dated OR year = 1999) AS fits, max(w) AS w, max(score) AS top_score, count(*) FILTER (WHERE score >= 0.25) AS relevant_count, count(DISTINCT source) FILTER (WHERE score >= 0.25) AS n_sources FROM r GROUP BY query_id) SELECT query_id, CASE WHEN NOT fits THEN 'INSUFFICIENT' WHEN w > 0.5 THEN CASE WHEN n_sources >= 1 AND (relevant_count >= 2 OR top_score >= 0.3) THEN 'SUFFICIENT' WHEN n_sources >= 1 THEN 'LOW_CONFIDENCE' ELSE 'INSUFFICIENT' END WHEN relevant_count >= 3 AND n_sources >= 2 THEN 'SUFFICIENT' WHEN relevant_count >= 1 AND n_sources >= 1 THEN 'LOW_CONFIDENCE' ELSE 'INSUFFICIENT' END AS verdict, round(top_score, 6) AS top_score, relevant_count, n_sources FROM a",
    "last_user_turn": "SELECT conv_id, coalesce(nullif(max_by(text, turn) FILTER (WHERE role = 'user'), ''), 'Hola') AS question FROM conversations GROUP BY conv_id",
    "chitchat_intent": "WITH s AS (SELECT conv_id, turn, text, CASE turn % 2 WHEN 0 THEN 'Hola, buenas tardes!' ELSE 'Muchas gracias.' END AS polite FROM conversations) SELECT conv_id, turn, " + ", ".join(f"CASE WHEN {_TALK.replace('(said,', f'({x},')} THEN 'CHITCHAT' ELSE 'ARCHIVE_SEARCH' END AS {name}" for x, name in (("text", "intent"), ("polite", "polite"), ("polite || ' ' || text", '"both"'))) + " FROM s",
    "planned_query": f"WITH s AS (SELECT conv_id, turn, text AS said, turn % 4 AS k FROM conversations), t AS (SELECT *, {_TALK} AS talk FROM s), p AS (SELECT conv_id, turn, CASE WHEN talk THEN 'CHITCHAT' WHEN k = 1 THEN 'OUT_OF_SCOPE' ELSE 'ARCHIVE_SEARCH' END AS intent, CASE WHEN talk OR k = 1 THEN NULL WHEN k = 2 THEN 2004 ELSE CAST(nullif(regexp_extract(said, '\\b(?:19|20)\\d{{2}}\\b'), '') AS INTEGER) END AS year, CASE WHEN NOT talk AND k = 2 AND regexp_matches(lower(strip_accents(said)), '\\b(1|uno|primero|1ro)\\b') THEN '2004-05-01' END AS publication_date, CASE WHEN NOT talk AND k = 2 THEN 'elpais' END AS section, 'diario' AS newspaper, md5(said) AS query_md5 FROM t) SELECT *, CASE intent WHEN 'CHITCHAT' THEN 'reply' WHEN 'OUT_OF_SCOPE' THEN 'decline' ELSE 'search' END AS route FROM p",
    "scope_cascade": f"""WITH sc AS (SELECT doc_id, text, source, length(trim(text)) AS n, {_list([("gazetteer:", "der", _has("text", "der")), ("term:", "nicht", _loose("nicht"))])} AS strong, {_list([("contextual_term:", "que", _loose("que"))])} AS weak FROM documents),
one AS (SELECT doc_id, text, n, CASE WHEN n >= 100 AND (source = 'src1' OR len(strong) > 0) THEN 'argentina' ELSE 'unknown' END AS scope, CASE WHEN n < 100 THEN [] WHEN source = 'src1' THEN ['seccion:src1'] ELSE strong || weak END AS signals FROM sc),
c AS (SELECT one.doc_id, a.vec_id % 3 AS place, max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) AS score FROM one JOIN embeddings e ON e.vec_id = one.doc_id, (SELECT * FROM embeddings WHERE vec_id < 12) a WHERE one.scope = 'unknown' AND n >= 100 GROUP BY ALL),
two AS (SELECT doc_id, list(score ORDER BY place) AS by_class, list(score ORDER BY score DESC) AS best, arg_max(place, score) AS place FROM c GROUP BY doc_id),
m AS (SELECT one.*, scope = 'unknown' AND n >= 100 AS open, best[1] - best[2] > 0.05 AS final, two.place, CASE WHEN best IS NULL THEN [] ELSE [printf('emb_arg:%.3f', by_class[1]), printf('emb_int:%.3f', by_class[2]), printf('emb_unknown:%.3f', by_class[3]), printf('emb_margin:%.3f', best[1] - best[2])] END AS emb, CASE WHEN contains(substr(text, 1, 3500), 'ing') THEN 'international' WHEN contains(substr(text, 1, 3500), 'ado') THEN 'argentina' END AS said FROM one LEFT JOIN two USING (doc_id)),
g AS (SELECT *, open AND NOT coalesce(final, false) AS grey FROM m)
SELECT doc_id, CASE WHEN grey THEN CASE WHEN n >= 150 THEN coalesce(said, 'unknown') ELSE 'unknown' END WHEN open THEN ['argentina', 'international', 'unknown'][place + 1] ELSE scope END AS scope,
array_to_string(signals || CASE WHEN open THEN emb ELSE [] END || CASE WHEN NOT grey THEN [] WHEN n < 150 THEN ['llm_skipped:short_text'] WHEN said IS NULL THEN ['llm_error:stand-in'] ELSE ['llm_local:stand-in:' || said] END, '|') AS signals FROM g""",
    "lexicon_join": f"WITH f AS (SELECT doc_id, {_FOUND} AS found FROM documents) SELECT doc_id, unnest(found) AS term FROM f",
    "known_location": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 ELSE doc_id % 2 = 1 AND source = 'src1' END AS known FROM documents",
    "signal_previews": f"WITH {_SCOPES} SELECT 'section' AS kind, min(doc_id) FILTER (WHERE len(list_filter(signals, lambda s: starts_with(s, 'seccion:'))) > 0) AS doc_id FROM sc UNION ALL SELECT 'lexicon', min(doc_id) FILTER (WHERE len(list_filter(signals, lambda s: regexp_matches(s, '^(gazetteer|term|institution|political_org|club):'))) > 0) FROM sc UNION ALL SELECT 'anchors', NULL UNION ALL SELECT 'model', NULL",
    "page_metadata": f"SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'Propio' WHEN page_id % 2 = 0 THEN 'Un t\u00edtulo' ELSE coalesce({_INNER('h[12]').replace('</h[12]>', '</h[12]>')}, {_INNER('title')}) END AS title, CASE WHEN page_id % 3 = 0 THEN 'Ana' END AS author, CASE WHEN page_id % 7 = 0 THEN 'Propio' WHEN page_id % 5 = 0 THEN 'Sociedad' ELSE 'El mundo' END AS section, CASE WHEN page_id % 4 = 0 THEN '2004-05-06' END AS published FROM pages",
    "markdown_documents": "WITH d AS (SELECT doc_id, text || '  ' || repeat(chr(10), 4) || '<b>fin</b>' AS m FROM documents), c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(" + _CLEAN + r", '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS t FROM d) SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Un t" + "\u00ed" + r"tulo' END AS doc_title, CASE WHEN doc_id % 3 = 1 THEN 'd' END AS doc_description, CASE WHEN doc_id % 3 = 0 THEN 'a, b c' END AS keywords, CASE WHEN doc_id % 3 = 1 THEN 'x, y z' END AS tags, md5(t) AS text_md5 FROM c WHERE length(trim(t)) >= 30",
    "section_limit": "WITH s AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN ' ' || upper(source) END AS section FROM documents), w AS (SELECT * FROM s WHERE coalesce(lower(trim(section)), 'none') IN ('src1', 'src2', 'none') QUALIFY row_number() OVER (PARTITION BY coalesce(lower(trim(section)), 'none') ORDER BY doc_id) <= 5) SELECT * FROM w ORDER BY doc_id LIMIT 12",
    "inspect_listing": f"WITH l AS (SELECT doc_id, lang AS section, {_flat('text')} AS t FROM documents WHERE lang = 'es' ORDER BY doc_id LIMIT 25) SELECT doc_id, section, CASE WHEN length(t) > 60 THEN substr(t, 1, 57) || '...' ELSE t END AS text FROM l",
    "inspect_facets": "WITH l AS (SELECT doc_id, coalesce(CASE WHEN doc_id % 4 <> 0 THEN lang END, 'missing') AS section, source AS country_scope FROM documents ORDER BY doc_id LIMIT 40) SELECT 'section' AS facet, section AS value, count(*) AS n FROM l GROUP BY section UNION ALL SELECT 'country_scope', country_scope, count(*) FROM l GROUP BY country_scope",
    "edition_pages": "SELECT o_orderkey, strftime(o_orderdate, 'https://h/diario/secciones/index-%Y-%m-%d.html https://h/diario/principal/index-%Y-%m-%d.html https://h/%Y/%m-%Y/dia/%d-%m-%Y.html') AS urls, strftime(o_orderdate, '%Y/%m/') || 'b-c.html' AS path FROM orders",
    "query_plan": f"WITH s AS (SELECT conv_id, turn, 'notas de ' || CASE WHEN turn % 2 = 0 THEN '1998 y 2003: ' ELSE '' END || text AS said FROM conversations) SELECT conv_id, turn, CASE WHEN {_TALK} THEN 'CHITCHAT' ELSE 'ARCHIVE_SEARCH' END AS intent, CAST(nullif(regexp_extract(said, '\\b(?:19|20)\\d{{2}}\\b'), '') AS INTEGER) AS year FROM s",
    "cited_sources": "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '2' WHEN 2 THEN '2' WHEN 6 THEN '2' ELSE (doc_id % 7) || ',2' END AS cited FROM documents",
    "citations": f"WITH r AS (SELECT page_id % 10 AS query_id, page_id AS rank, {_HOST} AS label, 1.0::DOUBLE / (1 + page_id) AS score FROM pages), f AS (SELECT query_id, label, min(rank) AS rank, arg_min(score, rank) AS score FROM r GROUP BY query_id, label) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS citation_id, label, '2024-05-06' AS published, round(score, 6) AS score FROM f",
    "date_range_coverage": "SELECT CAST(CAST(day AS DATE) AS VARCHAR) AS day, count(event_id) AS n FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 1 DAY) g(day) LEFT JOIN events ON CAST(ts AS DATE) = CAST(day AS DATE) GROUP BY day",
    "per_day_ingest": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY ALL",
}
SQL["stream_ingest"] = SQL["per_day_ingest"]
SQL["collection_upsert"] = """WITH b AS (SELECT CAST(doc_id AS VARCHAR) AS point_id, source AS section, CAST(1990 + doc_id % 7 + coalesce(quality, 0) AS INTEGER) AS year, md5(text || CASE WHEN quality IS NULL THEN '' ELSE ' (corregido)' END) AS text_md5 FROM documents LEFT JOIN labels USING (doc_id))
SELECT * FROM b WHERE year BETWEEN 1991 AND 1994"""
SQL["lexicon_automaton"] = r"""WITH b AS (SELECT DISTINCT strip_accents(unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS t FROM benchmark), w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}_]+')) AS t FROM documents)
SELECT doc_id, count(*) AS n_terms, md5(string_agg(t, ' ' ORDER BY t)) AS terms_md5 FROM w JOIN b USING (t) GROUP BY doc_id"""
SQL["model_rerank"] = "WITH " + bm25_sql("SELECT doc_id AS id, text FROM documents", "SELECT item_id AS query_id, text FROM benchmark") + """, b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM scores QUALIFY position <= 5),
p AS (SELECT b.query_id, b.id, position, docs.text AS t, lower(substr(asked.text, 1, 1)) AS c FROM b JOIN docs USING (id) JOIN asked ON asked.query_id = b.query_id),
r AS (SELECT query_id, id, position, CASE WHEN c = '' THEN 0 ELSE round((length(lower(t)) - length(replace(lower(t), c, ''))) / greatest(1, length(t)), 6) END AS score, bool_or(length(t) % 2 = 1) OVER (PARTITION BY query_id) AS odd FROM p),
m AS (SELECT model, query_id, id, position, CASE WHEN model = 'letters' OR NOT odd THEN score END AS rerank_score, model = 'brittle' AND odd AS failed FROM r, (VALUES ('letters'), ('brittle')) v(model))
SELECT model, query_id, id, rerank_score, row_number() OVER (PARTITION BY model, query_id ORDER BY rerank_score DESC NULLS LAST, position) AS rerank_position, failed FROM m QUALIFY rerank_position <= 3"""
SQL["edition_links"] = "SELECT page_id, 'https://archivo.example.com/diario/elpais/1-' || page_id || '-2024-05-06.html' AS link, 'Nota ' || page_id AS title, 'elpais' AS section FROM pages"
