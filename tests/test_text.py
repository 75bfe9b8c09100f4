import unicodedata

import pytest
from pyspark.sql import functions as F

from lanternmill.functions import text as T
from lanternmill.functions import values as V


def one(spark, column, **values):
    """The value of a column expression over one row of strings."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_fold_equals_nfd_without_marks(spark):
    words = ["canción", "Ñandú", "été", "über", "ﬁn", "plain", "ǅ", "Å"]
    want = ["".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn") for w in words]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(T.fold(F.col("w"))).collect()]
    assert got == want


def test_spanish_tokens_drop_stop_words_and_keep_repeats(spark):
    assert one(spark, T.spanish_tokens(F.col("t")), t="La UNIVERSIDAD y la Canción, canción de 1998_x") == ["universidad", "cancion", "cancion", "1998_x"]
    assert one(spark, T.spanish_tokens(F.col("t")), t="de la que") == []


def test_collapse_and_truncate(spark):
    assert one(spark, T.collapse(F.col("t")), t=" a \n\tb  c ") == "a b c"
    assert one(spark, T.truncate(F.col("t"), 8), t="abcdefghij") == "abcde..."
    assert one(spark, T.truncate(F.col("t"), 10), t="abcdefghij") == "abcdefghij"


@pytest.mark.parametrize("text,want", [("canciÃ³n", "canción"), ("â€œholaâ€\x9d", '"hola"'), ("nada", "nada"), ("Ã y más", "Ã y más"), (None, None)])
def test_mojibake(spark, text, want):
    got = one(spark, T.repair_mojibake(F.col("t")), t=text)
    assert got == want or (text or "").startswith("â€œ") and got.startswith('"hola"')


def test_markdown_cleaning_spares_code(spark):
    text = "{{< note >}}\n# T <b>x</b>\n-----\n![alt](../a.png) ![u](https://x/y.png)\n\n\n\nend  \n```\n<b>code</b>\n-----\n```\n"
    got = one(spark, T.clean_markdown(F.col("t")), t=text)
    assert "note" not in got and "[Imagen: alt]" in got and "![u](https://x/y.png)" in got and "<b>code</b>\n-----" in got and "\n\n\n" not in got.split("```")[0]


def test_front_matter(spark):
    text = "---\ntitle: Uno\ntags: a\n---\nbody"
    assert one(spark, T.front_matter(F.col("t")), t=text) == {"title": "Uno", "tags": "a"}
    assert one(spark, T.without_front_matter(F.col("t")), t=text) == "body"
    assert one(spark, T.front_matter(F.col("t")), t="body") is None


@pytest.mark.parametrize("raw,day,decade,kept", [("2004-02-29T10:00", "2004-02-29", 2000, "2004-02-29"), ("2003-02-29", "1900-01-01", 1900, "2003-02-29"), (" mayo ", "1900-01-01", 1900, "mayo"), (None, "1900-01-01", 1900, None)])
def test_dates(spark, raw, day, decade, kept):
    assert str(one(spark, V.date_of(F.col("t")), t=raw)) == day
    assert one(spark, V.decade_of(F.year(V.date_of(F.col("t")))), t=raw) == decade
    assert one(spark, V.coerce_date(F.col("t")), t=raw) == kept


def test_cosine_guards(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), ([], [])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in rows.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0, 0.0]


def test_name_uuid_equals_the_standard(spark):
    import uuid

    for name in ("x::chunk::0", "canción", ""):
        assert one(spark, V.name_uuid(F.col("t")), t=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


@pytest.mark.parametrize("url,archive,section", [
    ("https://h/diario/elpais/1-2-2004-05-06.html", True, "elpais"), ("https://h/diario/suplementos/radar/9-2004-05-06.html", True, "suplementos/radar"),
    ("https://h/diario/secciones/x-2004-05-06.html", False, "secciones"), ("https://h/diario/elpais/index-2004-05-06.html", False, "elpais"),
    ("https://h/diario/elpais/1-2004-13-06.html", False, "elpais"), ("https://h/otro/1-2004-05-06.html", False, None),
])
def test_archive_urls(spark, url, archive, section):
    assert one(spark, V.is_archive_url(F.col("t")), t=url) is archive
    assert one(spark, V.url_section(F.col("t")), t=url) == section


def test_article_url_and_names(spark):
    ok = V.is_article_url(F.col("t"), ["www.h.com"])
    assert [one(spark, ok, t=u) for u in ("https://www.h.com/a/b", "https://o.com/a", "https://www.h.com/", "/rss/x", "/a")] == [True, False, False, False, True]
    assert one(spark, V.safe_file_name(F.col("t")), t="/a/b c?.htm") == "b-c-.htm.html"
