"""Labels that a path or a text gives away, entities, and stand-in vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternmill.functions.text import collapse

# Words of a path, or else of the text, that tell the category.
CATEGORIES = (("installation", "install"), ("troubleshooting", "troubleshoot"), ("cli_reference", r"\bcli\b|reference"), ("getting_started", "get-started|getting started"))
# Words that tell the platform.
PLATFORMS = (("windows", "windows"), ("mac", r"\bmac"), ("linux", "linux|ubuntu|debian|fedora|centos|rhel"))


def category(path: Column, text: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for source in (path, text):
        for name, words in CATEGORIES:
            out = out.when(F.lower(source).rlike(words), name)
    return out.otherwise("getting_started")


def platform(path: Column, text: Column, mentions: int = 3) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, words in PLATFORMS:
        out = out.when(F.lower(path).rlike(words), name)
    for name, words in PLATFORMS:
        out = out.when(F.regexp_count(F.lower(text), F.lit(words)) >= mentions, name)
    return out.otherwise("general")


def entities(text: Column) -> Column:
    """struct<persons, organizations>: a deterministic stand-in for a tagger. Runs of two or more capitalised words are
    persons, words of two or more capitals organisations; ordered, each once."""
    flat = collapse(text)
    people = F.regexp_extract_all(flat, F.lit(r"\p{Lu}\p{Ll}+(?: (?:de |del |la )*\p{Lu}\p{Ll}+)+"), F.lit(0))
    groups = F.regexp_extract_all(flat, F.lit(r"(?U)\b\p{Lu}{2,}\b"), F.lit(0))
    return F.struct(F.array_distinct(people).alias("persons"), F.array_distinct(groups).alias("organizations"))


def embed(text: Column, dim: int = 64, prefix: str = "passage: ") -> Column:
    """A unit vector of hashed words: a deterministic stand-in for an embedder, which is passed in where there is one.
    The prefix tells passages from questions, as such models ask for; the stand-in leaves it out of the words."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t: str | None) -> list[float]:
            v = np.zeros(dim)
            for w in (t or "").removeprefix(prefix).lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1 if h >> 31 else -1
            n = float(np.sqrt(v @ v))
            return (v / n if n else v).astype(np.float32).tolist()

        for b in batches:
            yield b.map(one)

    return vectors(F.concat(F.lit(prefix), collapse(F.coalesce(text, F.lit("")))))
