import json

import pytest
from pyspark.sql import functions as F

from lanternmill.sources import files
from lanternmill.streaming import ingest


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes("﻿# canción larga".encode())
    (tmp_path / "sub/b.md").write_bytes("canción en latin".encode("latin-1"))
    (tmp_path / "short.md").write_text("x")
    (tmp_path / "c.txt").write_text("not this one, whatever it says")
    got = {r.file_name: r.text for r in files.read_markdown(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "# canción larga", "b.md": "canción en latin"}


def test_pages_with_sidecars(spark, tmp_path):
    body = "<html><body><h1>Título</h1><article><p>" + "texto " * 40 + "</p></article></body></html>"
    for name in ("x-2004-05-06", "y-2004-05-07", "z-2004-05-06"):
        (tmp_path / f"{name}.html").write_text(body)
    (tmp_path / "x-2004-05-06.json").write_text(json.dumps({"source_url": "https://h/x", "article_title": "Otro", "publication_date": "2004-05-06T10:00"}))
    (tmp_path / "y-2004-05-07.json").write_text("{broken")
    rows = {r.file_name: r for r in files.read_pages(spark, str(tmp_path)).collect()}
    assert len(rows) == 3 and rows["x-2004-05-06.html"].source_url == "https://h/x" and rows["y-2004-05-07.html"].source_url is None
    assert files.read_pages(spark, str(tmp_path), "2004-05-06").count() == 2
    parsed = {r.title: r for r in files.parse_pages(files.read_pages(spark, str(tmp_path))).collect()}
    assert parsed["Otro"].published == "2004-05-06" and "Título" in parsed and parsed["Otro"].text.startswith("texto texto")
    assert files.parse_pages(files.read_pages(spark, str(tmp_path)), 10_000).count() == 0


def test_manifest_round_trip(spark, tmp_path):
    urls = spark.createDataFrame([("2004-05-06", 1, "u1", "t1", None, "s"), ("2004-05-06", 0, "u0", None, None, None)], "date string, pos int, url string, title string, snippet string, section string")
    files.write_manifest(urls, str(tmp_path / "m"), "diario", "edition")
    got = files.read_manifest(spark, str(tmp_path / "m"), "diario").orderBy("pos").collect()
    assert [(r.date, r.pos, r.url, r.section) for r in got] == [("2004-05-06", 0, "u0", None), ("2004-05-06", 1, "u1", "s")]
    with pytest.raises(Exception, match="not a url manifest"):
        files.read_manifest(spark, str(tmp_path / "m"), "other").collect()


def test_robots(spark):
    text = "User-agent: other\nDisallow: /a\nUser-agent: *\nDisallow: /b # no\nDisallow:\nUser-agent: mill\nDisallow: /c"
    lines = spark.createDataFrame(list(enumerate(text.split("\n"))), "pos int, line string")
    assert {r.value for r in files.robots_blocked(lines, "lanternmill").collect()} == {"/b", "/c"}


def test_stream_takes_each_file_once(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = spark.range(10).withColumn("day", (F.col("id") % 3).cast("int"))
    rows.where("day < 2").write.mode("append").parquet(source)
    stream = lambda: ingest.read_folder(spark, source, rows.schema)
    ingest.load_new(stream(), target, state)
    assert spark.read.parquet(target).count() == 7
    rows.where("day = 2").write.mode("append").parquet(source)
    ingest.load_new(stream(), target, state)
    ingest.load_new(stream(), target, state)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(10))


def test_stream_keys_once(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:20:00")], "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    rows.write.parquet(source)
    ingest.load_new(ingest.once_per_key(ingest.read_folder(spark, source, rows.schema), "k", "t"), target, state)
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == ["a", "b"]
