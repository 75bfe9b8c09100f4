"""Replies of a chat: small talk, other subjects, too little evidence, answers with their sources, failures."""

import json

from lanternmill.operators import archive, chat, models
from lanternmill.operators.scope import Lexicon

ANSWERED = "query_id long, question string, intent string, verdict string, sources array<struct<citation_id:int,label:string,url:string,published:date,score:double>>, context string, status string"


def parrot(fails=""):
    def load():
        def run(prompts):
            if fails and any(fails in p for p in prompts):
                raise RuntimeError("gone")
            return [f"dice {len(json.loads(p))} turnos: {json.loads(p)[1]['content']}" for p in prompts]

        return run

    return load


def test_replies(spark):
    source = lambda *rows: [(k + 1, label, url, None, 0.5) for k, (label, url) in enumerate(rows)]
    rows = [
        (1, "hola", "CHITCHAT", None, None, None), (2, "el clima", "OUT_OF_SCOPE", None, None, None), (3, "nada", "ARCHIVE_SEARCH", "INSUFFICIENT", None, None), (4, "huelga", "ARCHIVE_SEARCH", "SUFFICIENT", source(("Uno", "u1"), ("Uno", "u1"), ("Dos", None)), "[Documento 1]"),
        (5, "malo", "ARCHIVE_SEARCH", "LOW_CONFIDENCE", source(("Uno", "u1")), "c"), (6, "huelga", "ARCHIVE_SEARCH", None, None, None), (7, None, "CHITCHAT", None, None, None), (8, "sola", "ARCHIVE_SEARCH", "SUFFICIENT", [], None),
    ]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], ANSWERED)
    got = {r.query_id: (r.status, r.content) for r in chat.replies(frame, models.Model("parrot", parrot("malo"), tries=1), said={"abstained": "No alcanza."}).collect()}
    assert got[1] == got[7] == ("chit-chat", chat.REPLIES["chit-chat"]) and got[2] == ("out-of-scope", chat.REPLIES["out-of-scope"])
    assert got[3] == got[6] == ("abstained", "No alcanza.")
    assert got[4] == ("answered", "dice 2 turnos: huelga\n\nFuentes:\n- [Uno](u1) | s/f\n- Dos | s/f\n") and got[8] == ("answered", "dice 2 turnos: sola")
    assert got[5] == ("failed", "Error procesando la solicitud: RuntimeError: gone")
    own = {r.query_id: r.content for r in chat.replies(frame, models.Model("parrot2", parrot()), models.Model("talk", parrot("hola"), tries=1)).collect()}
    assert own[1] == chat.REPLIES["chit-chat"] and own[7] == "dice 2 turnos:" and own[5].startswith("dice 2 turnos: malo\n\nFuentes")
    assert chat.replies(frame.limit(0), models.Model("parrot", parrot())).count() == 0


def test_chat_over_an_archive(spark):
    body = "La universidad de La Plata discute el conflicto docente y los salarios. " * 20
    docs = spark.createDataFrame([("u1", "Conflicto docente", "sociedad", "diario", "2002-05-06", body)], "source_id string, title string, section string, newspaper string, published string, text string")
    indexed = archive.index(archive.enrich(docs, Lexicon(locations=["La Plata"])), "argentina").cache()
    turns = [(1, 1, "user", "hola"), (1, 2, "assistant", "Hola"), (1, 3, "user", "conflicto docente salarios en 2002"), (2, 1, "user", "gracias"), (3, 1, "user", "xyzzy en 1985"), (4, 1, "assistant", "solo")]
    got = {r.conv_id: r for r in chat.chat(indexed, spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), models.Model("parrot", parrot())).collect()}
    assert got[1].status == "answered" and got[1].content == "dice 2 turnos: conflicto docente salarios en 2002\n\nFuentes:\n- [Conflicto docente](u1) | 2002-05-06\n"
    assert [got[k].status for k in (2, 3, 4)] == ["chit-chat", "abstained", "chit-chat"]
