"""The two jobs: growing input, replaced documents, lost runs, edge cases, command lines, and their SQL."""

import json
import logging
import os
import subprocess
import sys

import pytest

from jobs import archive_chunks, queries, question_report
from jobs.settings import config
from tests.test_queries import duck  # noqa: F401

TABLES = "/root/testdata/sf0.001"
LONG = "la casa de papel y la ciudad grande que nadie ha visto nunca desde aquel verano tan lejano y tan largo. "


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_equals_sql(spark, duck, name):  # noqa: F811
    rows = queries.QUERIES[name](spark, TABLES)
    columns = sorted(rows.columns)
    want = duck.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    got = sorted(repr(tuple(r[c] for c in columns)) for r in rows.collect())
    assert got and got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in want.fetchall())


def add(spark, folder, rows):
    """One more file of documents."""
    frame = spark.createDataFrame(rows, archive_chunks.DOCUMENTS + ", text_clean string, batch int")
    frame.coalesce(1).write.mode("append").parquet(str(folder))


def row(doc_id, text, lang="es", source="s"):
    return (doc_id, text, lang, source, "clash", 99)


def chunks_of(spark, place):
    rows = archive_chunks.current(spark, f"{place}/collection").select("source_id", "chunk_index", "total_chunks", "lang", "section", "country_scope", "chunk_id", "point_id", "text").collect()
    return sorted(map(tuple, rows))


def take(spark, place, **given):
    archive_chunks.run(spark, f"{place}/documents", f"{place}/collection", f"{place}/checkpoint", config("archive_chunks", **given))


def files_below(place):
    return sorted((d, f, os.path.getmtime(f"{d}/{f}")) for d, _, names in os.walk(place) for f in names)


def test_second_run_takes_only_what_is_new(spark, tmp_path, caplog):
    """Documents that come again replace their earlier versions, also where nothing of them is in scope any more; the end
    is that of one run over the final input."""
    caplog.set_level(logging.INFO, "jobs.archive_chunks")
    add(spark, tmp_path / "documents", [row(1, LONG * 20), row(2, LONG * 3), row(3, LONG * 2, "en"), row(4, "x" * 300), row(5, LONG * 30)])
    take(spark, tmp_path)
    first = chunks_of(spark, tmp_path)
    assert {c[0] for c in first} == {"1", "2", "3", "5"} and len([c for c in first if c[0] == "1"]) == 3
    kept = files_below(tmp_path / "collection/batch=0")

    add(spark, tmp_path / "documents", [row(2, LONG * 9), row(3, "nothing here " * 30, "en"), row(5, ""), row(6, LONG * 2, None), row(4, LONG * 4)])
    caplog.clear()
    take(spark, tmp_path)
    assert "read 5 rows" in caplog.text and "wrote 5 documents" in caplog.text and caplog.text.count("read ") == 1
    assert files_below(tmp_path / "collection/batch=0") == kept
    second = chunks_of(spark, tmp_path)
    assert {c[0] for c in second} == {"1", "2", "4", "6"} and [c for c in second if c[0] == "1"] == [c for c in first if c[0] == "1"]
    assert "".join(c[8] for c in second if c[0] == "2").startswith(LONG * 8)

    caplog.clear()
    take(spark, tmp_path)
    assert "read " not in caplog.text and chunks_of(spark, tmp_path) == second
    with pytest.raises(Exception, match="not the checkpoint"):
        archive_chunks.run(spark, f"{tmp_path}/documents", f"{tmp_path}/collection", f"{tmp_path}/other", config("archive_chunks"))
    assert chunks_of(spark, tmp_path) == second

    final = [row(1, LONG * 20), row(2, LONG * 9), row(3, "nothing here " * 30, "en"), row(4, LONG * 4), row(5, ""), row(6, LONG * 2, None)]
    add(spark, tmp_path / "whole/documents", final)
    take(spark, tmp_path / "whole")
    assert chunks_of(spark, tmp_path / "whole") == second


def test_a_lost_run_is_made_up_for(spark, tmp_path, monkeypatch):
    """A run that dies after its rows were written, before the checkpoint knows, does the batch again, with one result."""
    add(spark, tmp_path / "documents", [row(1, LONG * 20), row(2, LONG * 3)])
    take(spark, tmp_path)
    add(spark, tmp_path / "documents", [row(2, LONG * 5), row(7, LONG)])
    real = archive_chunks.log.info

    def dies(message, *args):
        if message.startswith("batch"):
            raise RuntimeError("lost")
        real(message, *args)

    monkeypatch.setattr(archive_chunks.log, "info", dies)
    with pytest.raises(Exception, match="lost"):
        take(spark, tmp_path)
    monkeypatch.undo()
    take(spark, tmp_path)
    assert sorted(p.name for p in (tmp_path / "collection").glob("batch=*")) == ["batch=0", "batch=1"]
    add(spark, tmp_path / "whole/documents", [row(1, LONG * 20), row(2, LONG * 5), row(7, LONG)])
    take(spark, tmp_path / "whole")
    assert chunks_of(spark, tmp_path) == chunks_of(spark, tmp_path / "whole")


def test_documents_of_all_kinds(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and ids: the largest hash of equal files wins."""
    rows = [row(None, LONG * 3), row(None, LONG * 3), row(None, None), row(1, None), row(2, ""), row(3, LONG * 3000), row(4, LONG * 2, "", None), row(4, LONG * 2, "", None), row(8, "d" * 99)]
    add(spark, tmp_path / "documents", rows)
    take(spark, tmp_path)
    got = chunks_of(spark, tmp_path)
    by = {s: [c for c in got if c[0] == s] for s in {c[0] for c in got}}
    long = LONG * 3000
    assert {len(s) for s in by} == {1, 40} and len(by["3"]) == 1 + (len(long) - 1) // 780
    assert [c[8] for c in sorted(by["3"], key=lambda c: c[1])] == [long[k : k + 900] for k in range(0, len(long), 780)]
    assert len(by["4"]) == 1 and by["4"][0][3] is None
    take(spark, tmp_path, index_scope="all")  # nothing new, whatever the settings
    assert chunks_of(spark, tmp_path) == got


def test_no_documents(spark, tmp_path):
    (tmp_path / "documents").mkdir()
    take(spark, tmp_path)
    assert chunks_of(spark, tmp_path) == []
    add(spark, tmp_path / "documents", [row(9, LONG * 2)])
    take(spark, tmp_path)
    assert len(chunks_of(spark, tmp_path)) == 1


def report(spark, place, turns, docs, **given):
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, question string").write.mode("overwrite").parquet(f"{place}/turns")
    spark.createDataFrame(docs, archive_chunks.DOCUMENTS + ", verdict string, id int").write.mode("overwrite").parquet(f"{place}/docs")
    question_report.run(spark, f"{place}/turns", f"{place}/docs", f"{place}/report", config("question_report", **given))
    return {r.conv_id: r for r in question_report.answered(spark, f"{place}/report").collect()}


def test_questions_of_all_kinds(spark, tmp_path):
    said = lambda conv, text, turn=1, role="user": (conv, turn, role, text, "clash")
    docs = [(1, "huelga portuaria rosario", "es", "a", "c", 1), (2, "huelga portuaria", "es", "b", "c", 1), (3, "huelga rosario", "es", "b", "c", 1), (4, None, "es", "b", "c", 1), (None, "huelga", "es", "b", "c", 1), (5, "", None, None, "c", 1)]
    turns = [
        said(1, "vieja"), said(1, "huelga portuaria rosario", 2), said(1, "claro", 3, "assistant"), said(2, "Hola!"), said(3, None), said(4, "nada parecido"), said(5, "huelga portuaria en 1999"),
        said(6, "huelga portuaria rosario"), (None, 1, "user", "huelga", "clash"), said(7, "de la"), said(8, "solo asistente", 1, "assistant"),
    ]
    got = report(spark, tmp_path, turns, docs)
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8, None}
    assert got[1].verdict == got[6].verdict == "SUFFICIENT" and [c.doc_id for c in got[1].cited] == [1, 2, 3] and got[1].top_score == 1.0
    assert got[2].verdict == got[3].verdict == got[8].verdict == "NOT_SEARCHED" and got[2].cited is None
    assert got[4].verdict == got[7].verdict == "INSUFFICIENT" and got[5].verdict == "INSUFFICIENT" and got[5].year == 1999
    again = report(spark, tmp_path, turns, docs)
    assert again == got
    assert {c.doc_id for c in report(spark, tmp_path, turns, docs, shown=1)[1].cited} == {1}
    assert report(spark, tmp_path, [], docs) == {} and report(spark, tmp_path, turns, [])[1].verdict == "INSUFFICIENT"


def test_command_line(tmp_path):
    settings = tmp_path / "own.json"
    settings.write_text(json.dumps({"index_scope": "all"}))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run(
        [sys.executable, "-m", "jobs.archive_chunks", f"{TABLES}/documents.parque[t]", f"{tmp_path}/collection", f"{tmp_path}/checkpoint", "--config", str(settings), "--master", "local[2]"],
        cwd=root, capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": root},
    )
    assert out.returncode == 0, out.stderr[-2000:]
    assert "read 200 rows" in out.stderr and os.path.isdir(tmp_path / "collection/batch=0/lang=es")
    with pytest.raises(ValueError):
        config("archive_chunks", nothing=1)


def test_a_report_stores_no_postings(spark, tmp_path):
    """Beside the answers a run leaves a row a question and one a document shown, no row a word of the documents."""
    docs = [(i, f"huelga portuaria rosario {' '.join(f'w{i}x{k}' for k in range(200))}", "es", "a", "c", 1) for i in range(100)]
    got = report(spark, tmp_path, [(c, 1, "user", f"huelga w{c}x1", "clash") for c in range(80)], docs)
    assert all(got[c].cited[0].doc_id == c for c in range(80))
    assert sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(tmp_path / "report") for f in names) < 100_000


def test_a_later_run_searches_for_new_questions_alone(spark, tmp_path, caplog, monkeypatch):
    """As long as the documents and settings stay; the answers are those of a run that searches for all. A lost run is made
    up for, and no old ranks are left."""
    caplog.set_level(logging.INFO, "jobs.question_report")
    docs = [(i, f"huelga {'portuaria' if i % 2 else 'naval'} {'rosario' if i < 4 else ''}", "es", "ab"[i % 2], "c", 1) for i in range(9)]
    turns = [(c, 1, "user", q, "clash") for c, q in enumerate(["huelga rosario", "naval", "nada parecido", "hola"])]
    more = turns[1:] + [(9, 1, "user", "portuaria naval rosario", "clash")]
    new = lambda: [r.getMessage().split(" ")[0] for r in caplog.records if "are new" in r.getMessage()][-1]
    first = report(spark, tmp_path, turns, docs)
    assert new() == "3" and report(spark, tmp_path, turns, docs) == first and new() == "0"
    second = report(spark, tmp_path, more, docs)
    assert new() == "1" and second == report(spark, tmp_path / "whole", more, docs) and new() == "3" and set(second) == {1, 2, 3, 9}
    assert report(spark, tmp_path, turns, docs) == first and new() == "1"

    changed = docs[:-1] + [(8, "nada parecido", "es", "a", "c", 1)]
    real = question_report.retrieval.matched_reranked
    monkeypatch.setattr(question_report.retrieval, "matched_reranked", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        report(spark, tmp_path, turns, changed)
    monkeypatch.setattr(question_report.retrieval, "matched_reranked", real)
    third = report(spark, tmp_path, turns, changed)
    assert new() == "3" and third[2].verdict != first[2].verdict and third == report(spark, tmp_path / "whole", turns, changed)
    assert report(spark, tmp_path, turns, changed, depth=1) != third and new() == "3"
    assert len(list((tmp_path / "report/ranked").iterdir())) == 1
