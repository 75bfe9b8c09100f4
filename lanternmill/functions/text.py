"""Text as columns: folding, tokens, white space, encoding repair, markdown cleaning."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The Spanish stop words of the tokeniser.
STOP_WORDS = (
    "a al algo algunas algunos ante antes como con contra cual cuando de del desde donde durante e el la las le les lo "
    "los en entre era erais eran eras eres es esa esas ese esos esta estaba estaban estas este estos estoy fin fue fueron "
    "fui fuimos ha hace hacen hacer hacia han hasta incluso mas me mi mis mismo muchos muy no nos nosotros o otra otras "
    "otro otros para pero por que quien quienes se sea sin sobre sois somos son soy su sus tambien tanto te tenemos tener "
    "tengo ti tiene tienen todo todos trabajo tres tuyas tuyo tuyos un una unas uno unos usted ustedes va vamos van vaya "
    "verdad via y ya yo"
).split()

# Marks of text decoded with the wrong encoding, and what broken punctuation stood for.
MOJIBAKE_MARKS = ("Ã", "â€", "Â")
MOJIBAKE_PUNCTUATION = {
    "â€œ": '"', "â€": '"', "â€\x9d": '"', "â€˜": "'",
    "â€™": "'", "â€“": "-", "â€”": "-", "â€¦": "...",
}


def once(value: Column, told: Callable[[Column], Column]) -> Column:
    """told of a value that is worked out once, however often told names it."""
    return F.get(F.transform(F.array(value), told), F.lit(0))


@lru_cache
def _map(form: str) -> tuple[str, str]:
    """Characters that the normal form turns into one base character and marks, and these base characters."""
    pairs = []
    for c in map(chr, range(0xC0, 0x10000)):
        if not 0xD800 <= ord(c) < 0xE000:
            base = "".join(x for x in unicodedata.normalize(form, c) if unicodedata.category(x) != "Mn")
            if len(base) == 1 and base != c:
                pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column, form: str = "NFD") -> Column:
    """Without accents: composed letters become their base, free marks go. NFKD also folds width and style variants."""
    folded = F.regexp_replace(F.translate(text, *_map(form)), r"\p{Mn}+", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)  # most texts need none of it


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


@lru_cache
def _short_map() -> tuple[str, str]:
    """_map of the Latin letters that most accented words are written with."""
    pairs = [(a, b) for a, b in zip(*_map("NFD")) if a < "\u0180"]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_word(word: Column) -> Column:
    """fold of a word. Spark holds the whole table against the last one for each text that it translates, and a short one
    does for most words."""
    return once(F.translate(word, *_short_map()), lambda short: F.when(is_ascii(short), short).otherwise(fold(word)))


def tokens(text: Column) -> Column:
    """Lower-cased, folded words of letters, digits and underscores. Words are cut before they are folded, as letters and
    their marks are both parts of words; so only the few words with other than ASCII are folded."""

    def cut(low: Column) -> Column:
        words = F.regexp_extract_all(low, F.lit(r"(?U)\w+"), F.lit(0))
        folded = F.array_remove(F.transform(words, lambda w: F.when(is_ascii(w), w).otherwise(fold_word(w))), "")
        return F.when(is_ascii(low), F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))).otherwise(folded)

    return once(F.lower(text), cut)


def without_stop_words(words: Column) -> Column:
    """Keeps repeats, unlike array_except."""
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def spanish_tokens(text: Column) -> Column:
    return without_stop_words(tokens(text))


def collapse(text: Column) -> Column:
    """Every run of Unicode white space one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def truncate(text: Column, n: int) -> Column:
    """At most n characters of the collapsed text, the last three dots if any is left out."""
    flat = collapse(text)
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 3), F.lit("..."))).otherwise(flat)


def replace_broken_punctuation(text: Column) -> Column:
    marked = F.lit(False)
    for m in MOJIBAKE_MARKS:
        marked = marked | text.contains(m)
    out = text
    for broken, fixed in MOJIBAKE_PUNCTUATION.items():
        out = F.replace(out, F.lit(broken), F.lit(fixed))
    return F.when(marked, out).otherwise(text)


def _redecode(texts: pd.Series) -> pd.Series:
    score = lambda t: sum(t.count(m) for m in MOJIBAKE_MARKS)

    def best(text: str | None) -> str | None:
        if text is None or not score(text):
            return text
        options = [text]
        for encoding in ("latin-1", "cp1252"):
            try:
                options.append(text.encode(encoding).decode("utf-8"))
            except UnicodeError:
                pass
        return min(options, key=score)  # the first of the best

    return texts.map(best)


def repair_mojibake(text: Column) -> Column:
    """Broken punctuation is replaced, then a re-decoding is taken if it leaves fewer marks. The second step is Python,
    as Spark's own decoding fails where a candidate should only be passed over; unmarked texts come through unchanged."""
    return F.pandas_udf(_redecode, "string")(replace_broken_punctuation(text))


# What is not prose in markdown, what stands for a local image, and the block that heads a document.
SHORTCODE, TAG, RULE_LINE = r"\{\{[<%][\s\S]*?[%>]\}\}", r"</?[a-zA-Z][^>]*>", r"(?m)^\s*[-=_]{3,}\s*$"
LOCAL_IMAGE, IMAGE_NOTE = r"!\[([^\]]*)\]\((?!https?://)([^)]+)\)", "[Imagen: $1]"
FRONT_MATTER = r"\A---\s*\n([\s\S]*?)\n---\s*\n"


def clean_markdown(text: Column) -> Column:
    """Template shortcodes, tags, separator lines, trailing blanks and surplus empty lines go; local images become
    [Imagen: alt]; fenced code stays as it is."""

    def prose(part: Column) -> Column:
        part = F.regexp_replace(part, SHORTCODE, "")
        part = F.regexp_replace(part, TAG, "")
        part = F.regexp_replace(part, LOCAL_IMAGE, IMAGE_NOTE)
        part = F.regexp_replace(part, RULE_LINE, "")
        part = F.regexp_replace(part, r"(?m)[ \t]+$", "")
        return F.regexp_replace(part, r"\n{3,}", "\n\n")

    pieces = F.split(text, "```")  # odd pieces are code, but for the last, whose fence nothing closes
    return F.trim(F.regexp_replace(F.array_join(F.transform(pieces, lambda p, i: F.when((i % 2 == 1) & (i < F.size(pieces) - 1), p).otherwise(prose(p))), "```"), r"^\n+|\n+$", ""))


def front_matter(text: Column) -> Column:
    """The simple `key: value` lines of a leading --- block as a map; null without a block."""
    block = F.regexp_extract(text, FRONT_MATTER, 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\w+\s*:"))
    entries = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x)), F.lit(" \"'")).alias("value")))
    return F.when(block != "", F.map_from_entries(entries))


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, FRONT_MATTER, "")


def years(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0))


def contains_phrase(text: Column, phrase: str) -> Column:
    """Whether the text has the phrase, whatever the case and white space."""
    return F.lower(collapse(text)).contains(" ".join(phrase.lower().split()))


#: Characters from which a cleaned document counts.
MIN_CLEAN = 30


def front_matter_field(block: Column, key: str, lists_only: bool = False) -> Column:
    """A top-level field of a front matter block: a plain or quoted value, or a list in brackets or on lines, joined by
    commas; null without one (with lists_only, also for a plain value)."""
    bare = lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", "")
    joined = lambda items: F.array_join(F.filter(F.transform(items, bare), lambda x: x != ""), ", ")
    value = F.trim(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*(.*)$", 1))
    lines = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-[ \t]+.*\n?)+)", 1)
    out = F.when(lines != "", joined(F.regexp_extract_all(lines, F.lit(r"(?m)^[ \t]*-[ \t]+(.*)$"), F.lit(1)))).when(value.startswith("["), joined(F.split(F.btrim(value, F.lit("[]")), ",")))
    return out if lists_only else out.when(value != "", bare(value))


def markdown_documents(files: DataFrame) -> DataFrame:
    """files (text and other columns) with clean texts and doc_title, doc_description, keywords, tags of the front
    matter; documents with fewer than MIN_CLEAN characters left go. The block goes whether it can be read or not."""
    block = F.regexp_extract("text", FRONT_MATTER, 1)
    fields = {"doc_title": "title", "doc_description": "description", "keywords": "keywords", "tags": "tags"}
    out = files.withColumns({c: front_matter_field(block, k, k == "tags") for c, k in fields.items()})
    return out.withColumn("text", clean_markdown(without_front_matter(F.col("text")))).where(F.length(F.trim("text")) >= MIN_CLEAN)
