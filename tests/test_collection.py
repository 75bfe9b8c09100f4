"""The collection: upserts keep what they are not given, lost runs leave it as it was, days are ingested from files."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from lanternmill.operators import archive, ingest
from lanternmill.operators.scope import Lexicon
from lanternmill.sources import tables

SCHEMA = "point_id string, text string, year int"
LEXICON = Lexicon(locations=["La Plata"])


def live(spark, path, schema=SCHEMA):
    return sorted(map(tuple, tables.collection(spark, path, schema).collect()), key=repr)


def put(spark, path, rows):
    tables.upsert_collection(spark, path, SCHEMA, spark.createDataFrame([(*r, "clash", 5) for r in rows], SCHEMA + ", gone string, batch long"))


def test_upserts_keep_the_rest(spark, tmp_path):
    path = str(tmp_path / "c")
    assert live(spark, path) == []
    put(spark, path, [("a", "1", 2000), ("b", "1", 2000), ("c", None, None), (None, "n", 2001)])
    put(spark, path, [("a", "2", 2000), ("b", "2", 2003), ("d", "2", 2001)])
    put(spark, path, [])
    assert live(spark, path) == sorted([("a", "2", 2000), ("b", "2", 2003), ("c", None, None), (None, "n", 2001), ("d", "2", 2001)], key=repr)
    put(spark, path, [("b", "3", 2000), ("c", "3", 2001), ("d", "x", 2001), ("d", "x", 2001)])
    want = sorted([("a", "2", 2000), ("b", "3", 2000), ("c", "3", 2001), (None, "n", 2001), ("d", "x", 2001)], key=repr)
    assert live(spark, path) == want
    tables.compact_collection(spark, path, SCHEMA)
    assert live(spark, path) == want and os.listdir(path) == ["batch=4"]
    put(spark, path, [("a", "5", 2000)])
    assert ("a", "5", 2000) in live(spark, path) and len(live(spark, path)) == 5
    assert tables.create_collection(spark, path, SCHEMA, force=True).count() == 0


def test_a_year_reads_its_folders_only(spark, tmp_path):
    path = str(tmp_path / "c")
    put(spark, path, [(f"p{i}", "x", 2000 + i % 5) for i in range(20)])
    put(spark, path, [("p1", "y", 2003)])
    rows = tables.collection(spark, path, SCHEMA).where("year = 2003")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "year#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "2003" in plan
    assert {r.point_id for r in rows.collect()} == {"p1", "p3", "p8", "p13", "p18"} and tables.collection(spark, path, SCHEMA).where("year = 2001").count() == 3


def test_a_lost_upsert_leaves_the_collection_as_it_was(spark, tmp_path):
    path = str(tmp_path / "c")
    put(spark, path, [("a", "1", 2000), ("b", "1", 2001)])
    before = live(spark, path)
    broken = spark.createDataFrame([("a", "2", 2000), ("b", "2", 2005)], SCHEMA).withColumn("text", F.when(F.col("point_id") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        tables.upsert_collection(spark, path, SCHEMA, broken)
    assert live(spark, path) == before
    put(spark, path, [("a", "2", 2000), ("b", "2", 2005)])
    os.remove(f"{path}/batch=1/_SUCCESS")  # the driver was lost before the batch was whole
    assert live(spark, path) == before
    put(spark, path, [("b", "3", 2001)])
    assert live(spark, path) == [("a", "1", 2000), ("b", "3", 2001)]


def page(folder, name, day, section, url, words):
    where = folder / day[:4] / day[5:7]
    where.mkdir(parents=True, exist_ok=True)
    (where / f"{name}-{day}.html").write_text(f"<html><body><article><p>{words} en La Plata, una ciudad con muchas cosas que contar. {'Sigue la nota del dia. ' * 8}</p></article></body></html>")
    (where / f"{name}-{day}.json").write_text(json.dumps({"source_url": url, "publication_date": day, "newspaper": "d", "article_title": name, "section": section}))


def stored(spark, path):
    return {r.source_id: r for r in tables.collection(spark, path, archive.INDEX).collect()}


def test_a_day_ingested_again_in_part_keeps_the_rest(spark, tmp_path):
    pages, path = tmp_path / "pages", str(tmp_path / "c")
    page(pages, "uno", "2004-05-06", "a", "u0", "Primera nota")
    page(pages, "dos", "2004-05-06", "b", "u1", "Segunda nota")
    page(pages, "tres", "2004-05-07", "a", "u2", "Tercera nota")
    found = ingest.ingest_range(spark, str(pages), dt.date(2004, 5, 6), dt.date(2004, 5, 8), path, LEXICON).collect()
    assert [(r.day.day, r.ok) for r in found] == [(6, True), (7, True), (8, True)] or [r.ok for r in found] == [True, True, False]
    first = stored(spark, path)
    assert set(first) == {"u0", "u1", "u2"} and first["u0"].section == "a" and len(first["u0"].vector) == 64
    day = dt.date(2004, 5, 6)
    for part in ({"sections": ["a"]}, {"per_section": 1}, {"most": 1}, {"index_scope": "international"}):
        ingest.ingest_day(spark, str(pages), day, path, LEXICON, **part)
        assert stored(spark, path) == first
    page(pages, "uno", "2004-05-06", "c", "u0", "Primera nota")  # the section changes, the chunk stays the same point
    ingest.ingest_day(spark, str(pages), day, path, LEXICON)
    again = stored(spark, path)
    assert again["u0"].section == "c" and again["u0"].point_id == first["u0"].point_id and again["u1"] == first["u1"]
    only = ingest.ingest_day(spark, str(pages), day, path, LEXICON, reset=True, sections=["b"])
    assert set(stored(spark, path)) == {"u1"} and only.count() == 1


def test_stages_and_parsed_documents(spark, tmp_path):
    pages, day = tmp_path / "pages", dt.date(2004, 5, 6)
    page(pages, "uno", "2004-05-06", "a", "u0", "Primera nota")
    run = lambda stage, **o: ingest.ingest_day(spark, str(pages), day, str(tmp_path / "c"), LEXICON, stage, **o)
    assert [r.source_id for r in run("parse", parsed=str(tmp_path / "parsed")).collect()] == ["u0"]
    where = f"{tmp_path}/parsed/2004/05/documents_06-05-2004"
    assert spark.read.json(where).count() == 1 and spark.read.json(f"{where}_header").first().total_documents == 1
    assert run("enrich").first().article_country_scope == "argentina"
    assert "vector" not in run("preview").columns and run("preview").first().chunk_id == "u0::chunk::0"
    assert not (tmp_path / "c").exists()
    with pytest.raises(ValueError):
        run("else")
