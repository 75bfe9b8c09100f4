"""Line deduplication by an exact set-similarity join, in DataFrame expressions.

A line is the set of its lower-cased words. The texts are split once: a saved table holds the word hashes of every
line, and all later steps read it. The words of a set are ordered by rarity: the class of how often words of the same
hash bucket occur in the corpus, then the word's hash. Two sets of Jaccard similarity t or more share a word among the
first of both; so each set is filed under its first words only, and of two sets filed together those pairs go on whose
lengths, positions and 128-bit word maps still allow the similarity. They are verified on all their words. A line goes
if an earlier line (by doc_id, then line number) is that similar; equal sets are similarity 1.

Large families of variants would give pairs with the square of their size, though one earlier match settles a line. So
each set is first held against the earliest set filed under the same word, one candidate for each of its first words
that is not rare; sets that this settles are no longer asked about in the join. A rare word, of at most 127 lines, brings
a set together with so few others that the join takes them as they are.

Words are compared by 64-bit hashes, sets that count as equal by 128 bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternmill.llm import scratch
from lanternmill.llm.url_filter import Level

#: Buckets of the table of word frequencies; it has a byte for each and goes into every plan.
BUCKETS = 1 << 18
#: Buckets up to twice as many as these are counted in the quick one of Spark's two hash maps, which by itself holds 2^16 keys.
WIDE = ("spark.sql.codegen.aggregate.fastHashMap.capacityBit", "19")
#: Tables of word hashes are written without Parquet's dictionary, which looks up each word in a large table. Most words of
#: the texts repeat; Zstandard finds that at less cost.
PLAIN = {"parquet.enable.dictionary": "false"}
PACKED = PLAIN | {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
#: Classes of frequency for each doubling of it.
STEPS = 4
#: A word's place in the order: its class of frequency in the bits above these, then its hash.
_CLASS_BIT = 56
#: With how many of its first words a set is held against the earliest set before the join.
GUESSES = 6
#: Class of frequency from which these are words of 128 lines or more, or share a bucket with others that make it so many.
COMMON = 7 * STEPS
#: Places (of 12 bytes each) up to which a set of them is broadcast.
BROADCAST_PLACES = 1 << 18
#: The join goes over the words in so many parts, one after the other, each with its share of the shuffle files.
PARTS = 3
#: Words up to which a set's map has 64 bits.
SHORT = 80
_LOW = (1 << _CLASS_BIT) - 1
_FIRST = -(1 << 63)  # stands for a null doc_id, which comes before all others


def _words(documents: DataFrame) -> DataFrame:
    """doc, line (from 0), words: the sorted distinct word hashes of the lines that have a word.

    White space but line breaks is made spaces. Each step is a projection of its own, so that none is worked out twice.
    """
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("doc"), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    other = F.col("low").contains("\t") | F.col("low").contains("\r") | F.col("low").contains("\x0b") | F.col("low").contains("\x0c")
    rows = rows.select("doc", F.when(other, F.translate("low", "\t\r\x0b\x0c", "    ")).otherwise(F.col("low")).alias("flat"))
    rows = rows.select("doc", F.posexplode(F.split("flat", "\n")).alias("line", "flat")).where(F.trim("flat") != "")
    hashes = F.transform(F.split("flat", " "), lambda w: F.xxhash64(w))
    return rows.select("doc", "line", F.sort_array(F.array_except(hashes, F.array(F.xxhash64(F.lit(""))))).alias("words"))  # array_except leaves each once


def rarity(words: DataFrame) -> DataFrame:
    """One row, `classes`: for each hash bucket, STEPS times the base-2 logarithm of the number of lines with its words,
    0 only if that is one line or none."""
    bucket = F.col("word").bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")
    counts = words.select(F.explode("words").alias("word")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).where("n > 1")
    classes = counts.select("bucket", F.least(F.lit(31 * STEPS), F.floor(F.log2("n") * STEPS)).cast("int").alias("class"))
    every = classes.unionByName(words.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("class")))
    dense = every.groupBy("bucket").agg(F.max("class").cast("tinyint").alias("class"))

    def in_order(key: str, value: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value])

    parts = dense.groupBy(F.shiftright("bucket", 9).alias("part")).agg(in_order("bucket", "class").alias("classes"))
    return parts.agg(F.flatten(in_order("part", "classes")).alias("classes"))


def _with_maps(rows: DataFrame) -> DataFrame:
    """rows with m0, m1: 128 bits, of which each of the words flips one. A short set has all of them in the first half,
    folded. The second half is a projection of its own, and the first starts from it, so that neither is worked out twice."""
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    flipped = lambda start, bit: F.aggregate("words", start, lambda m, h: m.bitwiseXOR(F.call_function("shiftleft", bit(h), F.shiftrightunsigned(h, 58).cast("int"))))
    second = F.when(F.size("words") <= SHORT, none).otherwise(flipped(none, lambda h: F.shiftrightunsigned(h, 57).bitwiseAND(one)))
    return rows.withColumn("m1", second).withColumn("m0", flipped(F.col("m1"), lambda h: one))


def _prefix(words: Column, classes: Column, threshold: float) -> Column:
    """The rarest words, as numbers in the order of rarity, of which a set that similar has one too; none for a set so
    short that only an equal one is similar."""
    bucket = lambda h: h.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")
    number = lambda h: F.shiftleft(F.get(classes, bucket(h)).cast("long"), _CLASS_BIT).bitwiseOR(h.bitwiseAND(F.lit(_LOW)))
    ordered = F.sort_array(F.transform(words, lambda h: F.coalesce(number(h), F.lit(0).cast("long"))))  # without nulls, sorted as plain numbers
    n = F.size(words)
    alone = n / (n + 1) < threshold - 1e-9
    return F.when(alone, F.array().cast("array<long>")).otherwise(F.slice(ordered, 1, n - F.ceil(n * threshold - 1e-9).cast("int") + 1))


def _sets(words: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """doc, line (of the earliest line), n, m0, m1, prefix of every distinct set."""
    w = F.col("words")
    # the table of classes passes through a column, as a subquery may not stand in a lambda function
    rows = _with_maps(words).withColumn("classes", classes.scalar()).select(
        F.struct("doc", "line").alias("place"), F.xxhash64("words").alias("s0"), F.xxhash64(F.lit(1), "words").alias("s1"),
        F.size(w).alias("n"), "m0", "m1", _prefix(w, F.col("classes"), threshold).alias("prefix"),
    )
    out = rows.groupBy("s0", "s1", "n").agg(F.min("place").alias("place"), *[F.first(c).alias(c) for c in ("m0", "m1", "prefix")])
    return out.select("place.doc", "place.line", "n", "m0", "m1", "prefix")


def _could_match(threshold: float) -> Column:
    """Whether sizes na, nb and word maps of two sets allow the similarity: each bit in which the maps differ takes a
    word that only one of the sets has."""
    na, nb = F.col("na"), F.col("nb")
    x, y = F.col("m0a").bitwiseXOR(F.col("m0b")), F.col("m1a").bitwiseXOR(F.col("m1b"))
    differ = F.when((na <= SHORT) | (nb <= SHORT), F.bit_count(x.bitwiseXOR(y))).otherwise(F.bit_count(x) + F.bit_count(y))
    return (F.least(na, nb) >= F.greatest(na, nb) * threshold - 1e-9) & (differ <= (na + nb) * ((1 - threshold) / (1 + threshold)) + 1e-9)


def _filed(sets: DataFrame, *more: str) -> DataFrame:
    """A row for each word among the first of a set: the set's place, size and map, p (place in the order), token. Words
    that a single line has bring no sets together and are not filed."""
    rows = sets.select("doc", "line", "n", "m0", "m1", *more, F.posexplode("prefix").alias("p", "token"))
    return rows.where(F.col("token") > _LOW)


def _sides(a: str, b: str) -> list[Column]:
    return [F.col(f"{own}.{c}").alias(c + side) for own, side in ((a, "a"), (b, "b")) for c in ("doc", "line", "n", "m0", "m1")]


def _comes_later(a: str, b: str) -> Column:
    """Whether the place doc, line of side a is after that of side b; plain comparisons, as joins ask this of every pair."""
    doc, line = (F.col("doc" + a), F.col("doc" + b)), (F.col("line" + a), F.col("line" + b))
    return (doc[0] > doc[1]) | ((doc[0] == doc[1]) & (line[0] > line[1]))


def _guesses(sets: DataFrame, threshold: float) -> DataFrame:
    """later, earlier, with repeats: sets, for each of their first words that is not rare, with the earliest that has this
    word among its first, if the two could be similar. Both steps can be split where a word is hot."""
    filed = _filed(sets.withColumn("prefix", F.slice("prefix", 1, GUESSES))).where(F.shiftright("token", _CLASS_BIT) >= COMMON)
    filed = filed.select("token", F.struct("doc", "line", "n", "m0", "m1").alias("own"))
    earliest = filed.groupBy("token").agg(F.min("own").alias("first"), F.count("*").alias("members")).where("members > 1").select("token", "first")
    pairs = filed.join(earliest, "token").select(*_sides("own", "first")).where(_could_match(threshold) & _comes_later("a", "b"))
    return pairs.select(F.struct(F.col("doca").alias("doc"), F.col("linea").alias("line")).alias("later"), F.struct(F.col("docb").alias("doc"), F.col("lineb").alias("line")).alias("earlier"))


def _flagged(sets: scratch.Saved, settled: DataFrame) -> DataFrame:
    """The sets with a column open: whether settled lacks them. Few settled ones are broadcast; with more than a stated
    number, the flagged sets are a table of their own in place of sets, so that this shuffle's files are gone before
    the next one's are there."""
    done, few = settled.select("later.*", F.lit(True).alias("done")), settled.count() <= BROADCAST_PLACES
    out = sets.df.join(done.hint("broadcast" if few else "merge"), ["doc", "line"], "left").withColumn("open", F.col("done").isNull()).drop("done")
    if few:
        return out
    out = scratch.Saved(out, "flagged", **PLAIN).df
    sets.drop()
    return out


def _met(sets: DataFrame, threshold: float, part: int = 0, parts: int = 1) -> DataFrame:
    """later, earlier, with repeats: sets that share a word among their first and could be similar, where the later one
    is open. Of two sets the longer (or, of equal length, the later) is asked with all its first words, the other filed
    under those from which the rest could still reach the threshold. Only words of the part, by hash, are looked at."""
    filed = _filed(sets, "open").where(F.pmod("token", F.lit(parts)) == part)
    # no column is null; said here, as tables that are read again do not say so, it spares the join asking for each pair
    filed = filed.select("p", *[F.coalesce(c, F.lit(0).cast(kind)).alias(c) for c, kind in filed.dtypes if c not in ("p", "open")], F.coalesce("open", F.lit(False)).alias("open"))
    a, b = (filed.select("token", *[F.col(c).alias(c + side) for c in ("doc", "line", "n", "m0", "m1", "open", "p")]) for side in "ab")
    b = b.where(F.col("pb") <= F.col("nb") - F.ceil(F.col("nb") * (2 * threshold / (1 + threshold)) - 1e-9))
    a_later = _comes_later("a", "b")
    together = a.join(b.hint("merge"), "token").where(
        _could_match(threshold)
        & ((F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & a_later))
        & F.when(a_later, F.col("opena")).otherwise(F.col("openb"))
        & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9)
    )
    one, two = F.struct(F.col("doca").alias("doc"), F.col("linea").alias("line")), F.struct(F.col("docb").alias("doc"), F.col("lineb").alias("line"))
    return together.select(F.when(a_later, one).otherwise(two).alias("later"), F.when(a_later, two).otherwise(one).alias("earlier"))


def _verified(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """later: the later places of distinct pairs (later, earlier) that are similar on all their words.

    A Bloom filter keeps the words of lines that nothing asks about out of the shuffle. Each later place is tried with
    its earliest partner; only those that this one does not settle are tried with all others, so what is joined with
    words is a row a place in most cases.
    """
    pairs = scratch.saved(pairs.distinct(), "pairs")
    asked = scratch.saved(pairs.select(F.col("later").alias("place")).unionByName(pairs.select(F.col("earlier").alias("place"))).distinct(), "asked")
    key = lambda doc, line: F.xxhash64(doc, line)  # noqa: E731  a number for a place; equal ones only let a row more through
    bloom = Level(asked.select(key(F.col("place.doc"), F.col("place.line")).alias("key")), max(1, asked.count()), 0.02, 11)
    wanted = words.where(bloom.passes(key(F.col("doc"), F.col("line")))).select(F.struct("doc", "line").alias("place"), "words")
    wanted = scratch.saved(wanted.join(asked, "place", "left_semi"), "words")

    def similar(some: DataFrame) -> DataFrame:
        both = some.join(wanted.toDF("later", "wa"), "later").join(wanted.toDF("earlier", "wb"), "earlier")
        enough = F.size(F.array_intersect("wa", "wb")) >= (F.size("wa") + F.size("wb")) * (threshold / (1 + threshold)) - 1e-9
        return both.where(enough).select("later").distinct()

    first = pairs.groupBy("later").agg(F.min("earlier").alias("earlier"))
    found = scratch.saved(similar(first), "found")
    rest = pairs.join(found, "later", "left_anti").join(first, ["later", "earlier"], "left_anti")
    return found.unionByName(similar(rest))


def first_lines(documents: DataFrame, threshold: float) -> DataFrame:
    """doc, top, bits: by document, the numbers of the lines that no earlier line is similar to, as set bits of numbers
    (place, value) of 64 bits each, and the largest place."""
    with scratch.passing():
        words = scratch.Saved(_words(documents), "words", **PACKED).df
        with scratch.setting(documents.sparkSession, *WIDE):
            classes = scratch.saved(rarity(words), "rarity")
        sets = scratch.Saved(_sets(words, classes, threshold), "sets", **PLAIN)
        settled = scratch.saved(_verified(_guesses(sets.df, threshold), words, threshold), "settled")
        flagged = _flagged(sets, settled)
        met = [scratch.saved(_met(flagged, threshold, part, PARTS).distinct(), "met") for part in range(PARTS)]
        matched = scratch.saved(_verified(reduce(DataFrame.unionByName, met), words, threshold), "matched")
        lines = flagged.where("open").select("doc", "line", F.lit(False).alias("gone")).unionByName(matched.select("later.*", F.lit(True).alias("gone")))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("line").bitwiseAND(63))
        bits = lines.groupBy("doc", F.shiftright("line", 6).alias("at")).agg(F.bit_or(one).alias("all"), F.bit_or(F.when(F.col("gone"), one).otherwise(F.lit(0).cast("long"))).alias("gone"))
        bits = bits.select("doc", "at", F.col("all").bitwiseXOR(F.col("gone")).alias("value")).where("value != 0")  # what is gone is among all
        bits = bits.groupBy("doc").agg(F.max("at").alias("top"), F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("bits"))
        return scratch.keep(scratch.Saved(bits, "kept")).df


def remove_lines(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """All rows and columns of documents with later similar lines taken out of text, and n_lines, n_removed (of lines
    with a word). Lines without a word stay. A null text stays null. A null doc_id comes before all others. Rows that
    repeat a doc_id are one place: a line number that one of them keeps, all keep. Other columns are passed
    on, but for an n_lines or n_removed, which these replace.
    """
    kept = first_lines(documents, threshold)
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("doc"), scratch.whole_row(documents).alias("row"))
    joined = rows.join(kept.hint("merge"), "doc", "left")  # a row a document
    dense = F.transform(F.sequence(F.lit(0), F.col("top")), lambda at: F.coalesce(F.element_at("bits", at), F.lit(0).cast("long")))

    has_word = lambda x: F.ltrim(x, F.lit(" \t\x0b\x0c\r")) != ""  # noqa: E731  ltrim stops at the first word, btrim goes over the whole line
    stays = lambda i: F.coalesce(F.getbit(F.get("bits", F.shiftright(i, 6)), i.bitwiseAND(63)) == 1, F.lit(False))
    joined = joined.select("row", F.when(F.col("top").isNotNull(), dense).alias("bits"), F.split("row.text", "\n").alias("lines"))
    joined = joined.select("row", "lines", F.filter("lines", lambda x, i: stays(i) | ~has_word(x)).alias("left"))
    with_word = F.coalesce(F.size(F.filter("lines", has_word)), F.lit(0)).cast("long")
    removed = F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long")  # only lines with a word go
    text = F.when(removed == 0, F.col("row.text")).otherwise(F.array_join("left", "\n"))
    columns = [text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in documents.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*columns, with_word.alias("n_lines"), removed.alias("n_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


SQL = r"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, text, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, line, l, list_sort(list_distinct(regexp_extract_all(lower(l), '[^\x20\x09-\x0D]+'))) AS ws FROM d),
s AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY doc_id, line) AS copy FROM w WHERE len(ws) > 0),
u AS (SELECT row_number() OVER (ORDER BY doc_id, line) AS id, doc_id, line, ws, len(ws) AS n FROM s WHERE copy = 1),
t AS (SELECT id, n, unnest(ws) AS t FROM u),
f AS (SELECT t, count(*) AS df FROM t GROUP BY t HAVING count(*) > 1),
p AS (SELECT id, n, t.t, row_number() OVER (PARTITION BY id ORDER BY f.df, t.t) + n - count(*) OVER (PARTITION BY id) AS at FROM t JOIN f USING (t)),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.t = b.t AND a.id > b.id AND a.at <= a.n - ceil(0.8 * a.n - 1e-9) + 1 AND b.at <= b.n - ceil(0.8 * b.n - 1e-9) + 1 AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n),
later AS (SELECT DISTINCT a FROM c JOIN u x ON x.id = c.a JOIN u y ON y.id = c.b WHERE len(list_intersect(x.ws, y.ws)) * 1.8 >= 0.8 * (x.n + y.n) - 1e-9),
gone AS (SELECT doc_id, line FROM s WHERE copy > 1 UNION ALL SELECT doc_id, line FROM u JOIN later ON later.a = u.id)
SELECT w.doc_id, count(*) FILTER (WHERE len(ws) > 0) AS n_lines, count(gone.line) AS n_removed, md5(coalesce(string_agg(l, chr(10) ORDER BY w.line) FILTER (WHERE gone.line IS NULL), '')) AS text_md5
FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.line = w.line GROUP BY w.doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
