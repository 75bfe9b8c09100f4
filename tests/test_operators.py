import math

import pytest
from pyspark.sql import functions as F

from lanternmill.functions import html as H
from lanternmill.operators import answers as A
from lanternmill.operators import chunks as C
from lanternmill.operators import retrieval as R
from lanternmill.operators import scope as S
from lanternmill.operators import store as ST


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


DOCS = [(1, "la universidad nacional de la plata", 2001), (2, "huelga docente en la universidad universidad", 2002), (3, "gol de river", 2001), (4, None, 2001)]


def brute_bm25(docs, query, stop):
    words = {i: [w for w in (t or "").split() if w not in stop] for i, t in docs}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    df = {t: sum(t in w for w in words.values()) for w in words.values() for t in w}
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    eps = 0.25 * sum(idf.values()) / len(idf)
    out = {}
    for i, w in words.items():
        s = sum((idf[t] if idf[t] >= 0 else eps) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in query if t in w)
        if any(t in w for t in query):
            out[i] = round(s, 6)
    return out


def test_bm25_equals_brute_force_and_filters_first(spark):
    from lanternmill.functions.text import STOP_WORDS

    docs = frame(spark, [(i, t or "") for i, t, _ in DOCS], "id long, text string")
    asked = frame(spark, [(0, "universidad docente universidad")], "query_id long, text string")
    got = {r.id: r.score for r in R.bm25(docs, asked).collect()}
    assert got == brute_bm25([(i, t) for i, t, _ in DOCS], ["universidad", "docente", "universidad"], STOP_WORDS)
    some = [(i, t) for i, t, y in DOCS if y == 2001]
    got = {r.id: r.score for r in R.bm25(docs.where("id <> 2"), asked).collect()}
    assert got == brute_bm25(some, ["universidad", "docente", "universidad"], STOP_WORDS)


def test_zero_fill_ties_and_stop_word_queries(spark):
    docs = frame(spark, [(i, t or "") for i, t, _ in DOCS], "id long, text string")
    asked = frame(spark, [(0, "nada"), (1, "de la")], "query_id long, text string")
    rows = R.top(R.with_zeros(R.bm25(docs, asked), docs, asked, 3), 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.score) for r in rows] == [(0, 1, 0.0), (0, 2, 0.0), (0, 3, 0.0), (1, 1, 0.0), (1, 2, 0.0), (1, 3, 0.0)]


def test_fusion_keeps_ranks_of_both_lists(spark):
    schema = "query_id long, id string, score double, rank long"
    out = {r.id: r for r in R.fuse(frame(spark, [(0, "c1", 0.9, 0), (0, "c2", 0.8, 1)], schema), frame(spark, [(0, "c3", 5.0, 0), (0, "c1", 4.0, 1)], schema), 0.4, 0.6).collect()}
    assert out["c1"].rrf == round(0.4 / 60 + 0.6 / 61, 8) and out["c2"].bm25_rank is None and out["c3"].semantic_rank is None and len(out) == 3


@pytest.mark.parametrize("question,want", [("notas sobre 1998", (0.4, 0.6)), ("que paso en mayo", (0.4, 0.6)), ("discurso de Perón", (0.4, 0.6)), ("debate economico", (0.6, 0.4)), ("a b c d e f g h i", (0.6, 0.4)), ("inflacion", (0.5, 0.5)), ("", (0.5, 0.5))])
def test_query_weights(spark, question, want):
    w = frame(spark, [(question,)], "t string").select(R.query_weights(F.col("t")).alias("w")).first().w
    assert (w.semantic, w.lexical) == want


def test_chunks_cover_the_text_and_keep_their_size():
    text = "\n\n".join(f"## Parte {i}\n" + "Una frase de prueba con palabras. " * 40 for i in range(5))
    parts = C.split_text(text, 300, 60)
    assert all(len(p) <= 300 for p in parts) and len(parts) > 10
    assert C.split_text("x" * 2000, 300, 60) == ["x" * 2000] and C.split_text("  ") == [] and C.split_text("uno dos") == ["uno dos"]
    bare = lambda t: {w.strip(".") for w in t.split()} - {""}  # noqa: E731  a ". " opens the next piece
    assert bare(" ".join(parts)) == bare(text)


def test_numbering_and_rebuild(spark):
    rows = frame(spark, [("a", 1), ("a", 2), (None, 3)], "source_id string, pos int")
    got = sorted((r.source_id, r.chunk_index, r.total_chunks) for r in C.number(rows, "pos").collect())
    assert got == [("a", 0, 2), ("a", 1, 2), ("unknown", 0, 1)]
    chunks = frame(spark, [("a", 1, "dos"), ("a", 0, "uno"), ("b", 0, "tres")], "source_id string, chunk_index int, text string")
    ranked = frame(spark, [(0, "b", 0, 0.9), (0, "a", 1, 0.8), (0, "b", 2, 0.7)], "query_id long, source_id string, rank long, score double")
    out = {r.source_id: (r.text, r.score) for r in C.rebuild(chunks, ranked, 2).collect()}
    assert out == {"a": ("uno\n\ndos", 0.8), "b": ("tres", 0.9)}


LEX = S.Lexicon(sections=["elpais"], locations=["La Plata", "Gonnet"], institutions=["UNLP", "Universidad Nacional"], clubs=["Gimnasia"], terms=["provincia de buenos aires"], weak_institutions=["senado"], contextual=["pesos"])
LONG = " relleno" * 20


@pytest.mark.parametrize("text,section,orgs,scope,signals", [
    ("corto", "elpais", [], "unknown", []), (LONG, "ElPais ", [], "argentina", ["seccion:elpais"]), ("En LA  PLATA" + LONG, None, [], "unknown", []),
    ("En la plata" + LONG, None, [], "argentina", ["gazetteer:La Plata"]), ("aplataforma la platada" + LONG, None, [], "unknown", []),
    ("la universidad\nnacional" + LONG, "", [], "argentina", ["institution:Universidad Nacional"]), ("la UNLP" + LONG, "", [], "unknown", []),
    (LONG, "", ["unlp"], "argentina", ["institution:UNLP"]), ("ganó gimnasia" + LONG, "", [], "unknown", []), ("el senado y los pesos" + LONG, "", [], "unknown", ["weak_institution:senado", "contextual_term:pesos"]),
])
def test_lexical_scope(spark, text, section, orgs, scope, signals):
    row = frame(spark, [(text, section, orgs)], "t string, s string, o array<string>").select(S.lexical_scope(F.col("t"), F.col("s"), F.col("o"), LEX).alias("x")).first().x
    assert (row.scope, row.signals) == (scope, signals)


def test_anchor_scope_needs_a_margin(spark):
    anchors = {"argentina": [[1.0, 0.0, 0.0]], "international": [[0.0, 1.0, 0.0]], "unknown": [[0.0, 0.0, 1.0]]}
    rows = frame(spark, [([1.0, 0.0, 0.0],), ([1.0, 1.0, 1.0],), ([0.0, 0.0, 2.0],)], "v array<double>").select(S.anchor_scope(F.col("v"), anchors).alias("a")).collect()
    assert [(r.a.scope, r.a.final) for r in rows] == [("argentina", True), ("argentina", False), ("unknown", True)]


def test_article_scope_priority(spark):
    rows = [("a", "argentina", ["gazetteer:x"]), ("a", "international", ["llm_local:m:international"]), ("b", "argentina", ["llm_local:m:argentina"]), ("c", "argentina", ["llm_local:m:argentina"]), ("c", "argentina", ["llm_local:m:argentina"]),
            ("d", "argentina", ["llm_local:m:argentina"]), ("d", "international", []), ("e", "argentina", ["emb_arg:0.9", "llm_local:m:argentina"]), ("f", "unknown", [])]
    got = {r.source_id: r.scope for r in S.article_scope(frame(spark, rows, "source_id string, scope string, signals array<string>")).collect()}
    assert got == {"a": "argentina", "b": "unknown", "c": "argentina", "d": "international", "e": "argentina", "f": "unknown"}


def test_index_scope_and_labels(spark):
    rows = frame(spark, [("Argentina", None), ("", "international"), (None, None)], "a string, c string")
    pick = lambda w: [r[0] for r in rows.select(S.in_index_scope(F.col("a"), F.col("c"), w)).collect()]
    assert pick("argentina") == [True, False, False] and pick("argentina, international") == [True, True, False] and pick("all") == [True, True, True]
    labels = frame(spark, [("Argentina.",), ("no se",), ("",), ("UNKNOWN!",)], "t string").select(S.label_of(F.col("t"))).collect()
    assert [r[0] for r in labels] == ["argentina", "unknown", "unknown", "unknown"]


VERDICT = "query_id long, question string, lexical_weight double, id long, source_id string, year int, published string, score double"


@pytest.mark.parametrize("rows,want", [
    ([(0, "x", 0.6, None, None, None, None, None)], "INSUFFICIENT"), ([(0, "en 1999", 0.6, 1, "a", 2001, "05-06-2001", 0.9)], "INSUFFICIENT"), ([(0, "en 2001", 0.6, 1, "a", None, "05-06-2001", 0.9)], "SUFFICIENT"),
    ([(0, "x", 0.6, 1, "a", 2001, None, 0.27)], "LOW_CONFIDENCE"), ([(0, "x", 0.5, i, s, 2001, None, 0.3) for i, s in enumerate("aab")], "SUFFICIENT"), ([(0, "x", 0.5, 1, "unknown", 2001, None, 0.3)], "INSUFFICIENT"),
])
def test_evidence(spark, rows, want):
    assert A.verdict(frame(spark, rows, VERDICT)).first().verdict == want


def test_plans_and_turns(spark):
    said = ["Hola!", "muchas gracias", "quién sos?", "notas de 1998 y 2001", ""]
    rows = frame(spark, [(s,) for s in said], "t string").select(A.plan(F.col("t")).alias("p")).collect()
    assert [(r.p.intent, r.p.year) for r in rows] == [("CHITCHAT", None)] * 3 + [("ARCHIVE_SEARCH", 1998), ("ARCHIVE_SEARCH", None)]
    dates = frame(spark, [("2001-05-01", "en mayo"), ("2001-05-01", "el primero de mayo"), ("2001-05-02", "x"), ("mayo", "x")], "d string, q string").select(A.planned_date(F.col("d"), F.col("q"))).collect()
    assert [r[0] for r in dates] == [None, "2001-05-01", "2001-05-02", None]
    turns = frame(spark, [(1, 0, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c"), (2, 0, "assistant", "d")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.question for r in A.last_user_turn(turns).collect()} == {1: "b", 2: "Hola"}
    assert frame(spark, [("[Fuente 2] [fuente 1] [Fuente 2] [Fuente 7]",)], "t string").select(A.cited(F.col("t"), 3)).first()[0] == [2, 1]


def test_store(spark):
    store = frame(spark, [("a", 1.0), ("b", 2.0)], "point_id string, value double")
    new = frame(spark, [("b", 3.0, 0), ("b", 4.0, 1), ("c", 5.0, 2)], "point_id string, value double, seq long")
    once = ST.upsert(store, new)
    assert {r.point_id: r.value for r in once.collect()} == {"a": 1.0, "b": 4.0, "c": 5.0}
    assert sorted(map(tuple, ST.upsert(once, new).collect())) == sorted(map(tuple, once.collect()))
    rows = frame(spark, [(1, ["x", "y"], 2005), (2, ["z"], 2005)], "id long, persons array<string>, year int")
    assert [r.id for r in ST.where_all(rows, {"persons": "y", "year": 2005, "section": None}).collect()] == [1] and ST.where_all(rows, {}).count() == 2
    known = frame(spark, [(1, [1.0]), (2, None), (3, [])], "id long, vector array<double>")
    out = {r.id: (r.vector, r.reused) for r in ST.fill_vectors(frame(spark, [(i,) for i in (1, 2, 3, 4)], "id long"), known, "id", F.array(F.lit(9.0))).collect()}
    assert out == {1: ([1.0], True), 2: ([9.0], False), 3: ([9.0], False), 4: ([9.0], False)}
    top = ST.top_per_group(frame(spark, [("a", 1), ("a", 2), ("b", 3)], "g string, o int"), "g", "o", 1)
    assert sorted(r.o for r in top.collect()) == [1, 3]


def test_links_and_titles(spark):
    page = '<html><head><title>T</title><meta property="og:title" content="Meta"></head><body><nav><a href="/n">n</a></nav><article><h1>Uno</h1><p>Texto &amp; más</p><script>x()</script><a href="../b#f">B <b>c</b></a></article></body></html>'
    rows = frame(spark, [(1, page)], "page_id long, html string")
    assert [(r.href, r.text) for r in H.links(rows).orderBy("pos").collect()] == [("/n", "n"), ("../b#f", "B c")]
    got = rows.select(H.title(F.col("html")).alias("t"), H.plain_text(F.col("html")).alias("p"), H.parsed_text(F.col("html")).alias("q")).first()
    assert got.t == "Meta" and got.p == "Uno Texto & más B c" and got.q == "Uno Texto & más B c"
    urls = frame(spark, [("/x",), ("y#f",), ("//o/z",), ("http://q/",), ("",)], "h string").select(H.absolute(F.col("h"), F.lit("https://a.b/c/d"))).collect()
    assert [r[0] for r in urls] == ["https://a.b/x", "https://a.b/c/y", "https://o/z", "http://q/", "https://a.b/c/d"]


def test_texts_are_folded_and_cut_once(spark):
    """However many terms, a text is folded once for them; a text is repaired once, not for each of its windows."""
    rows = frame(spark, [("x", "y", ["z"])], "t string, s string, o array<string>")
    lexicon = S.Lexicon(locations=list("abcdef"), terms=list("ghi"), contextual=list("jkl"))
    plan = rows.select(S.lexical_scope(F.col("t"), F.col("s"), F.col("o"), lexicon).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 2  # the text, the organizations
    plan = rows.select(C.windows(F.replace("t", F.lit("a"), F.lit("b"))).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(") == 1
    want = [("", []), ("é" * 25, ["é" * 10, "é" * 10, "é" * 9, "é"]), (None, None)]
    got = frame(spark, [(t,) for t, _ in want], "t string").select("t", C.windows(F.col("t"), 10, 2).alias("w")).collect()
    assert [tuple(r) for r in got] == want
