"""Functions that no registered query shows whole: anchors and links, phrases, gazetteers, messages, payloads."""

import json

import pytest
from pyspark.sql import functions as F

from lanternmill.functions import html as H
from lanternmill.functions import text as T
from lanternmill.operators import answers, scope, store

PAGE = """<html><body><div class="top"><a href="/diario/principal/index-2004-05-06.html">Tapa</a></div>
<article><h2><a href="/diario/elpais/1-100-2004-05-06.html#c">Paro  general</a></h2><p>Los gremios anuncian medidas.</p></article>
<ul><li><a href="../sociedad/3-200-2004-05-06.html">Escuelas</a> abren tarde</li><li><a href="/diario/elpais/1-100-2004-05-06.html">otra vez</a></li>
<li><a href="/diario/suplementos/radar/9-7-2004-05-06.html">Radar</a></li><li><a href="/diario/elpais/1-101-2004-05-07.html">Otro dia</a></li><li><a href="https://x.example.com/">Fuera</a></li></ul></body></html>"""


def test_links_of_an_edition(spark):
    pages = spark.createDataFrame([(1, "https://h.example.com/diario/principal/index.html", PAGE, "c"), (2, "https://h.example.com/", None, "c"), (3, "https://h.example.com/", "", "c")], "page_id long, url string, html string, pos string")
    got = {r.link.rsplit("/", 1)[1]: r for r in H.edition_links(pages).collect()}
    assert set(got) == {"1-100-2004-05-06.html", "3-200-2004-05-06.html", "9-7-2004-05-06.html", "1-101-2004-05-07.html"}
    first = got["1-100-2004-05-06.html"]
    assert first.title == "Paro general" and first.section == "elpais" and first.link.startswith("https://h.example.com/diario/elpais/") and first.page_id == 1
    assert got["3-200-2004-05-06.html"].section == "sociedad" and got["9-7-2004-05-06.html"].section == "suplementos/radar"
    of_day = H.edition_links(pages, F.lit("2004-05-06").cast("date")).collect()
    assert {r.link.rsplit("/", 1)[1] for r in of_day} == set(got) - {"1-101-2004-05-07.html"}
    assert [r.pos for r in H.anchors(pages).orderBy("pos").collect()] == list(range(7))


def test_phrases(spark):
    rows = spark.createDataFrame([("El  Paro\nGeneral de mayo",), ("paro generalizado",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.contains_phrase(F.col("t"), " paro GENERAL  de ")).collect()] == [True, False, False, None]


def test_gazetteer(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"country": "Argentina", "city": "La Plata", "cities": ["Berisso"], "provinces": ["Buenos Aires"], "institutions": ["UNLP"], "strong_institutions": ["Universidad Nacional"], "clubs": ["Gimnasia"], "strong_clubs": [], "keywords": ["k"], "direct_argentina_sections": ["elpais"], "contextual_terms": ["centro"]}))
    got = scope.read_gazetteer(spark, str(path))
    assert got.locations == ["Argentina", "La Plata", "Buenos Aires", "Berisso"] and got.institutions == ["Universidad Nacional"] and got.clubs == ["Gimnasia"] and got.terms == ["k"]
    assert got.sections == ["elpais"] and got.contextual == ["centro"] and got.weak_institutions == []
    path.write_text("{}")
    with pytest.raises(ValueError):
        scope.read_gazetteer(spark, str(path))


def test_messages_and_payloads(spark):
    rows = spark.createDataFrame([(1, "p1", "que paso", "[Documento 1]", None), (2, "p2", None, None, "x")], "k int, point_id string, q string, c string, section string")
    got = [r.m for r in rows.orderBy("k").select(answers.messages(F.col("q"), F.col("c"), "Leé: {context}", "P: {question}").alias("m")).collect()]
    assert [(m.role, m.content) for m in got[0]] == [("system", "Leé: [Documento 1]"), ("user", "P: que paso")] and got[1][1].content == "P: "
    assert {r.point_id: json.loads(r.payload) for r in store.payload(rows, ["q", "section"]).collect()} == {"p1": {"q": "que paso"}, "p2": {"section": "x"}}


def test_pages_are_parsed_some_at_a_time():
    """Anchors that each repeat a large block, and texts of many pages, do not pile up in a worker."""
    import tracemalloc

    import pyarrow as pa

    page = "<div>" + "texto " * 700 + "".join(f"<a href='/{k}'>x</a>" for k in range(100)) + "</div>"
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(["https://a.example.com/"] * 60), pa.array([page] * 60)], names=["page_id", "url", "html"])

    def peak(found):
        tracemalloc.start()
        n = sum(found)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return n, most

    n, most = peak(b.num_rows for b in H.parse_anchors(iter([batch])))
    assert n == 6000 and most < 20e6  # all of them have 26 million characters
    n, most = peak(len(a) for a in H.parse_texts(iter([pa.array([page] * 1000)])))
    assert n == 1000 and most < 6e6  # all pages have 6 million characters, their texts 4
    assert next(H.parse_texts(iter([pa.array([None, "<p>a</p>"])]))).to_pylist() == [None, "a"] and len(next(H.parse_texts(iter([pa.array([], pa.string())])))) == 0
