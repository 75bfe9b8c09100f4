"""Large lexicons: one automaton for all terms, walked once a text."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternmill.operators.scope import match_lexicon, norm

#: Bytes of folded terms up to which they are an automaton in every worker; beyond it, texts and terms meet by a join.
TERM_BYTES = 16 << 20
_automata: dict[str, tuple] = {}


@lru_cache(maxsize=1 << 12)
def is_word(c: str) -> bool:
    """What a pattern calls a word character: letters, marks, digits, connectors and joiners."""
    kind = unicodedata.category(c)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or c in "‌‍"


def _automaton(name: str, terms):
    """The automaton of a broadcast under a name, built once a worker process: folded terms, each with the numbers of those
    it stands for."""
    import ahocorasick

    if name not in _automata:
        _automata.clear()
        found: dict[str, list[int]] = {}
        for k, (_, plain) in enumerate(terms.value):
            found.setdefault(plain, []).append(k)
        machine = ahocorasick.Automaton()
        for plain, numbers in found.items():
            machine.add_word(plain, (len(plain), numbers))
        machine.make_automaton()
        _automata[name] = machine, [t for t, _ in terms.value]
    return _automata[name]


def match(docs: DataFrame, terms: DataFrame, term_bytes: int = TERM_BYTES) -> DataFrame:
    """id, term of docs (id, text) and terms (term): each term that a text has between characters that are not of words,
    whatever the case and accents, each once; as scope.find_terms and scope.match_lexicon find them. Blank and null terms
    match nothing; null texts have none; rows that repeat an id are one text's.

    Texts are read once and nothing of them is shuffled. Terms of over term_bytes go by match_lexicon's join.
    """
    known = terms.where(F.trim("term") != "").select("term", norm(F.trim("term")).alias("plain")).where("plain <> ''").distinct()
    size = known.agg(F.coalesce(F.sum(F.octet_length("plain") + F.octet_length("term")), F.lit(0))).first()[0]
    if size > term_bytes:
        return match_lexicon(docs, terms)
    shared = docs.sparkSession.sparkContext.broadcast([(r.term, r.plain) for r in known.orderBy("term").collect()])  # at most term_bytes
    name = uuid.uuid4().hex

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            machine, names = _automaton(name, shared)
            for k, text in enumerate(batch["flat"].to_pylist() if names else ()):
                if text:
                    numbers: set[int] = set()
                    for end, (length, own) in machine.iter(text):
                        first = end - length
                        if own[0] not in numbers and (first < 0 or not is_word(text[first])) and (end + 1 == len(text) or not is_word(text[end + 1])):
                            numbers.update(own)
                    at += [k] * len(numbers)
                    found += [names[n] for n in sorted(numbers)]
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["id", "term"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", norm(F.col("text")).alias("flat")).mapInArrow(walk, f"id {kind}, term string")
