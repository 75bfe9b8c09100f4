"""Quality rules in DataFrame expressions: length and repetition counts, and how far a document's histograms of
character classes and common words are from those of its language.

The references are counted over all documents of a language. The distance is the Jensen-Shannon distance (base 2,
0 to 1). Short documents have ragged histograms, so each histogram has a least number of words from which it counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternmill.llm import scratch

SPACE = r"[\x20\x09-\x0D]+"
TRIMMED = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: References up to which they are broadcast.
BROADCAST = 1 << 14
#: Common words of a language, and how long they are at most: function words are short.
COMMON, COMMON_CHARS = 16, 5
#: Words from which a histogram counts, and the distance above which a document goes.
CLASS_WORDS, CLASS_DISTANCE = 60, 0.28
WORD_WORDS, WORD_DISTANCE = 20, 0.43


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words are in windows of so many words that are found twice or more, the first place included.

    Windows are compared by 64-bit hashes.
    """

    def cover(sorted_windows: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(sorted_windows, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(sorted_windows, i + 1)["h"], F.lit(False))
        places = F.sort_array(F.transform(F.filter(sorted_windows, same), lambda x: x["i"]))
        steps = lambda p: F.transform(p, lambda at, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - at, F.lit(window))))
        return F.aggregate(let(places, steps), F.lit(0).cast("long"), lambda a, x: a + x)

    def count(windows: Column) -> Column:
        found = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(found, cover))

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - window), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < window + 1, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: let(windows(h), count)))


def _columns(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id, lang, text (null: empty), norm: the words with one space between, words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang"), text.alias("text"), *more)
    rows = rows.withColumn("norm", F.trim(F.regexp_replace("text", SPACE, " ")))
    return rows.withColumn("words", F.when(F.col("norm") == "", F.array().cast("array<string>")).otherwise(F.split("norm", " ")))


def _classes() -> list[Column]:
    """Characters of the words by class: upper-case letters, other letters, digits, sentence marks, other."""
    upper, no_letter = F.regexp_count("norm", F.lit(r"\p{Lu}")), F.regexp_count("norm", F.lit(r"[^\p{L} ]"))
    digit, marks = F.regexp_count("norm", F.lit(r"\p{N}")), F.regexp_count("norm", F.lit(r"[.,;:?'()\-]"))
    total = F.length("norm") - F.greatest(F.size("words") - 1, F.lit(0))
    return [upper, total - no_letter - upper, digit, marks, no_letter - digit - marks]


def references(documents: DataFrame) -> DataFrame:
    """lang, words (the common words), word_counts (of each, then of all other words), class_counts of every language;
    lang '' for documents without one. Rows of fixed length."""
    rows = _columns(documents).withColumn("lang", F.coalesce("lang", F.lit("")))
    per_class = rows.select("lang", F.size("words").alias("n"), *[c.alias(f"c{i}") for i, c in enumerate(_classes())])
    totals = per_class.groupBy("lang").agg(F.sum("n").alias("n"), F.array(*[F.sum(f"c{i}") for i in range(5)]).alias("class_counts"))
    words = rows.select("lang", F.explode(F.filter(F.split(F.lower("norm"), " "), lambda w: F.length(w).between(1, COMMON_CHARS))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("k"))
    from pyspark.sql import Window

    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("k"), "word"))).where(F.col("place") <= COMMON)
    common = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "word", "k"))).alias("top"))
    common = common.select("lang", F.col("top.word").alias("words"), F.col("top.k").alias("ks"))
    out = totals.join(common, "lang", "left")
    ks = F.coalesce("ks", F.array().cast("array<long>"))
    rest = F.col("n") - F.aggregate(ks, F.lit(0).cast("long"), lambda a, x: a + x)
    return scratch.saved(out.select("lang", F.coalesce("words", F.array().cast("array<string>")).alias("words"), F.concat(ks, F.array(rest)).alias("word_counts"), "class_counts"), "references")


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; 0 if one has no counts."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    shares = lambda x: let(total(x), lambda n: F.transform(x, lambda v: v / n))
    part = lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)
    divergence = lambda p, q: total(F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))) / 2
    value = let(shares(a), lambda p: let(shares(b), lambda q: F.sqrt(F.greatest(divergence(p, q), F.lit(0.0)))))
    return F.when((total(a) > 0) & (total(b) > 0), value).otherwise(0.0)


def judge(documents: DataFrame, *more: str) -> DataFrame:
    """A row per document: doc_id, the counts, base_failed, class_distance, word_distance, kept, and the columns named.

    A null text has no words and fails; documents without a language are held against each other; rows that repeat
    are judged each; an empty table gives no rows. Text columns are not shuffled: references come in a broadcast, unless
    there are over BROADCAST languages.
    """
    refs = references(documents).toDF("ref", "ref_words", "ref_word_counts", "ref_class_counts")
    refs = F.broadcast(refs) if refs.count() <= BROADCAST else refs
    key = F.coalesce("lang", F.lit(""))
    n_words = F.size("words").cast("long")
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(TRIMMED)) != "")
    padded = F.concat(F.lit(" "), F.replace(F.lower("norm"), F.lit(" "), F.lit("  ")), F.lit(" "))
    found = lambda text: F.transform("ref_words", lambda w: ((F.octet_length(text) - F.octet_length(F.replace(text, F.concat(F.lit(" "), w, F.lit(" "))))) / (F.octet_length(w) + 2)))
    rows = _columns(documents, *more).withColumn("ref", key).join(refs, "ref", "left")
    counted = rows.select(
        "doc_id",
        *more,
        n_words.alias("n_words"),
        (F.length("norm") - F.greatest(n_words - 1, F.lit(0))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.array(*[c.cast("double") for c in _classes()]).alias("classes"),
        let(padded, found).alias("common"),
        "ref_word_counts",
        "ref_class_counts",
    )
    others = F.col("n_words") - F.aggregate("common", F.lit(0.0), lambda a, x: a + x)
    doubles = lambda c: F.transform(c, lambda x: x.cast("double"))
    judged = counted.select(
        "doc_id", *more, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        F.coalesce(js_distance(F.col("classes"), doubles("ref_class_counts")), F.lit(0.0)).alias("class_distance"),
        F.coalesce(js_distance(F.concat("common", F.array(others)), doubles("ref_word_counts")), F.lit(0.0)).alias("word_distance"),
    )
    far = ((F.col("n_words") >= CLASS_WORDS) & (F.col("class_distance") > CLASS_DISTANCE)) | ((F.col("n_words") >= WORD_WORDS) & (F.col("word_distance") > WORD_DISTANCE))
    return judged.withColumn("kept", ~F.col("base_failed") & ~far)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


SQL = rf"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, lang, coalesce(text, '') AS text, trim(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g')) AS norm FROM documents),
known AS (SELECT lang FROM d WHERE lang IS NOT NULL AND lang <> '' GROUP BY lang),
w AS (SELECT d.* EXCLUDE (lang), coalesce(known.lang, '') AS ref, CASE WHEN norm = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(norm, ' ') END AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d LEFT JOIN known USING (lang)),
win AS (SELECT doc_id, list_transform(range(1, len(words) - {WINDOW - 2}), lambda i: array_to_string(words[i : i + {WINDOW - 1}], ' ')) AS s FROM w WHERE len(words) >= {WINDOW}),
flat AS (SELECT doc_id, unnest(s) AS s, unnest(range(len(s))) AS i FROM win),
rep AS (SELECT doc_id, i FROM flat QUALIFY count(*) OVER (PARTITION BY doc_id, s) >= 2),
cov AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
base AS (SELECT w.doc_id, ref, norm, len(words) AS n_words, length(norm) - greatest(len(words) - 1, 0) AS word_chars, len(regexp_extract_all(text, '{SYMBOLS}')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  len(regexp_extract_all(norm, '\p{{Lu}}')) AS up, len(regexp_extract_all(norm, '[^\p{{L}} ]')) AS nl, len(regexp_extract_all(norm, '\p{{N}}')) AS dg, len(regexp_extract_all(norm, '[.,;:?''()\-]')) AS mk FROM w LEFT JOIN cov USING (doc_id)),
cls AS (SELECT doc_id, ref, unnest(range(5)) AS slot, unnest([up, word_chars - nl - up, dg, mk, nl - dg - mk]) AS a FROM base),
clsref AS (SELECT ref, slot, sum(a) AS b FROM cls GROUP BY ref, slot),
tok AS (SELECT doc_id, ref, unnest(string_split(lower(norm), ' ')) AS word FROM base WHERE norm <> ''),
common AS (SELECT ref, word, count(*) AS k, row_number() OVER (PARTITION BY ref ORDER BY count(*) DESC, word) AS slot FROM tok WHERE length(word) BETWEEN 1 AND {COMMON_CHARS} GROUP BY ref, word QUALIFY slot <= {COMMON}),
mine AS (SELECT doc_id, ref, word, count(*) AS c FROM tok GROUP BY doc_id, ref, word),
hits AS (SELECT b.doc_id, b.ref, common.slot, coalesce(mine.c, 0) AS a, common.k AS b FROM base b JOIN common USING (ref) LEFT JOIN mine ON mine.doc_id = b.doc_id AND mine.word = common.word),
wordslots AS (SELECT doc_id, slot, a, b FROM hits UNION ALL
  SELECT base.doc_id, 0, n_words - coalesce(h.a, 0), t.n - coalesce(h.b, 0) FROM base JOIN (SELECT ref, sum(n_words) AS n FROM base GROUP BY ref) t USING (ref) LEFT JOIN (SELECT doc_id, sum(a) AS a, sum(b) AS b FROM hits GROUP BY doc_id) h ON h.doc_id = base.doc_id),
slots AS (SELECT 'c' AS kind, doc_id, slot, a, b FROM cls JOIN clsref USING (ref, slot) UNION ALL SELECT 'w', doc_id, slot, a, b FROM wordslots),
shares AS (SELECT kind, doc_id, a / nullif(CAST(sum(a) OVER g AS DOUBLE), 0) AS p, b / nullif(CAST(sum(b) OVER g AS DOUBLE), 0) AS q FROM slots WINDOW g AS (PARTITION BY kind, doc_id)),
js AS (SELECT kind, doc_id, coalesce(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)), 0) AS v, min(p) IS NULL AS empty FROM shares GROUP BY kind, doc_id),
judged AS (SELECT base.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  CASE WHEN c.empty THEN 0 ELSE c.v END AS cd, CASE WHEN x.empty THEN 0 ELSE x.v END AS wd FROM base JOIN js c ON c.doc_id = base.doc_id AND c.kind = 'c' JOIN js x ON x.doc_id = base.doc_id AND x.kind = 'w')
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  round(cd, 6) AS class_distance, round(wd, 6) AS word_distance,
  NOT base_failed AND NOT ((n_words >= {CLASS_WORDS} AND cd > {CLASS_DISTANCE}) OR (n_words >= {WORD_WORDS} AND wd > {WORD_DISTANCE})) AS kept FROM judged
"""
