import pytest
from pyspark.sql import functions as F

from lanternmill.functions import labels as L
from lanternmill.operators import archive
from lanternmill.operators.scope import Lexicon
from lanternmill.sources.tables import check_dimension, create_collection, upsert_collection

LEXICON = Lexicon(sections=["sociedad"], locations=["La Plata"], institutions=["UNLP"])


@pytest.fixture(scope="module")
def indexed(spark):
    body = lambda topic: f"La universidad de La Plata discute {topic}. " * 30
    rows = [("u1", "Conflicto docente", "sociedad", "diario", "2002-05-06", body("el conflicto docente y los salarios")), ("u2", "Reforma", "x", "diario", "2003-01-01", body("la reforma del plan de estudios")), ("u3", "Nada", "x", "diario", "mal", "Un texto de otro lugar sin nada que ver. " * 30)]
    documents = spark.createDataFrame(rows, "source_id string, title string, section string, newspaper string, published string, text string")
    return archive.index(archive.enrich(documents, LEXICON), "argentina").cache()


def test_index_has_the_schema_and_only_its_scope(spark, indexed):
    assert indexed.columns == [c.strip().split(" ")[0] for c in archive.INDEX.split(", ")]
    assert {r.source_id for r in indexed.collect()} == {"u1", "u2"} and indexed.where("point_id is null or size(vector) <> 64").count() == 0
    assert {r.primary_location for r in indexed.collect()} == {"La Plata"}


def test_answers(spark, indexed):
    asked = spark.createDataFrame([(0, "conflicto docente salarios en 2002"), (1, "hola"), (2, "xyzzy en 1985"), (3, "conflicto docente salarios en 1985")], "query_id long, text string")
    got = {r.query_id: r for r in archive.answer(indexed, asked).collect()}
    assert got[0].verdict == "SUFFICIENT" and got[0].sources[0].label == "Conflicto docente" and "[Documento 1]" in got[0].context
    assert got[1].intent == "CHITCHAT" and got[1].verdict is None and got[2].verdict == got[3].verdict == "INSUFFICIENT" and got[3].sources is None
    only = {r.query_id: r for r in archive.answer(indexed, asked, {"year": 2003}).collect()}
    assert all(s.label == "Reforma" for s in only[0].sources or [])


def test_a_dated_question_is_searched_in_its_year(spark):
    topic = "conflicto docente por los salarios de la universidad en 2002 "
    rows = [(f"o{i:02d}", "Otro", "x", "diario", "1999-03-04", topic * 4 + f"nota {i}") for i in range(40)] + [("right", "Bueno", "x", "diario", "2002-05-06", "El conflicto docente y los salarios siguen sin acuerdo entre las partes en la provincia. " * 2)]
    found = archive.index(archive.enrich(spark.createDataFrame(rows, "source_id string, title string, section string, newspaper string, published string, text string"), LEXICON), "all").cache()
    asked = spark.createDataFrame([(0, "conflicto docente salarios en 2002"), (1, "conflicto docente salarios")], "query_id long, text string")
    got = {r.query_id: r for r in archive.answer(found, asked).collect()}
    assert got[0].verdict == "SUFFICIENT" and [s.label for s in got[0].sources] == ["Bueno"]
    assert "Otro" in {s.label for s in got[1].sources}


def test_statistics_are_those_of_the_part(spark):
    from lanternmill.operators import retrieval

    docs = spark.createDataFrame([("a", i, " ".join(["perro"] * (i % 3) + ["gato", f"w{i}"])) for i in range(9)] + [("b", i, f"perro casa x{i % 4}") for i in range(20, 32)], "part string, id long, text string")
    asked = spark.createDataFrame([(0, "a", "perro w4"), (1, "b", "casa x2 perro"), (2, "c", "perro")], "query_id long, part string, text string")
    got = {(r.query_id, r.id): r.score for r in retrieval.bm25(docs, asked).collect()}
    want = {}
    for part in "abc":
        rows = retrieval.bm25(docs.where(F.col("part") == part).drop("part"), asked.where(F.col("part") == part).drop("part")).collect() if part != "c" else []
        want |= {(r.query_id, r.id): r.score for r in rows}
    assert got == want and got


def test_collection(spark, indexed, tmp_path):
    path = str(tmp_path / "collection")
    assert create_collection(spark, path, archive.INDEX).count() == 0
    upsert_collection(spark, path, archive.INDEX, indexed)
    assert create_collection(spark, path, archive.INDEX).count() == indexed.count()
    check_dimension(create_collection(spark, path, archive.INDEX), 64)
    with pytest.raises(ValueError):
        check_dimension(create_collection(spark, path, archive.INDEX), 384)
    assert create_collection(spark, path, archive.INDEX, force=True).count() == 0


@pytest.mark.parametrize("path,text,category,platform", [
    ("desktop/install/windows.md", "", "installation", "windows"), ("desktop/troubleshoot/index.md", "", "troubleshooting", "general"), ("reference/cli/run.md", "", "cli_reference", "general"), ("get-started/overview.md", "portable", "getting_started", "general"),
    ("docs/misc.md", "How to install it", "installation", "general"), ("docs/misc.md", "Some text", "getting_started", "general"), ("desktop/mac-install.md", "", "installation", "mac"), ("engine/install/ubuntu.md", "", "installation", "linux"),
    ("docs/misc.md", "This runs on Windows.", "getting_started", "general"), ("docs/misc.md", "Windows a. Windows b. Windows c.", "getting_started", "windows"),
])
def test_labels(spark, path, text, category, platform):
    row = spark.createDataFrame([(path, text)], "p string, t string").select(L.category(F.col("p"), F.col("t")).alias("c"), L.platform(F.col("p"), F.col("t")).alias("f")).first()
    assert (row.c, row.f) == (category, platform)


def test_entities_and_vectors(spark):
    row = spark.createDataFrame([("El juez Juan Carlos de Tal habló con la UNLP y la UNLP.",)], "t string").select(L.entities(F.col("t")).alias("e"), L.embed(F.col("t")).alias("v"), L.embed(F.lit("")).alias("z")).first()
    assert row.e.persons == ["Juan Carlos de Tal"] and row.e.organizations == ["UNLP"]
    assert abs(sum(x * x for x in row.v) - 1) < 1e-5 and sum(abs(x) for x in row.z) == 0
