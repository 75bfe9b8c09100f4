"""Audit of how far the sources of a language differ in their words.

Words are found on bytes: a lookup table turns concatenated UTF-8 buffers into lower-case letters and gaps, gaps and the
ends of texts are the boundaries, and slices are grouped by xxhash, each held against the first of its group byte for
byte. Counts meet by language and word. The shares of a language's sources are compressed sparse rows, cut into tiles of
words and sources; a tile gives sums for its pairs of sources, and tiles are added up.

All arithmetic is on 64-bit integers and exact: shares are thousand-millionths, rounded down, found in three steps of
three digits so that no product leaves the range below 9 * 10^15 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternmill.llm import scratch
from lanternmill.llm.runs import whole_runs

#: Documents of a language that a kept word is in, at least; ranks of the part `term`.
LEAST_DOCS, TOP = 3, 200
#: Bytes of text that are cut and counted at once.
PIECE = 8 << 20
#: Shares in a tile and sources in a block of it; sources up to which their sums are broadcast (see few()).
ENTRIES, BLOCK, FEW_BYTES = 1 << 17, 256, 8 << 20
#: Words up to this length are compared in lanes of eight bytes, longer ones whole.
LANES = 64

hash_of = xxhash.xxh3_64_intdigest
#: The lower-case letter of a byte, all other than ASCII being letters; 0 for what parts words.
LOWER = np.array([b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 0 for b in range(256)], np.uint8)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def words(low: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of letters; none goes over a cut, the first byte of a text or the end of all."""
    letter = low != 0
    before, after = np.zeros(len(low), bool), np.zeros(len(low), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    inner = cuts[(cuts > 0) & (cuts < len(low))]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1


def distinct(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first slice of each distinct word, the distinct word of each slice)."""
    slices = map(raw.__getitem__, map(slice, starts.tolist(), ends.tolist()))
    _, first, which = np.unique(np.fromiter(map(hash_of, slices), np.uint64, len(starts)), return_index=True, return_inverse=True)
    if _all_same(raw, starts, ends, first[which]):
        return first, which
    known: dict[bytes, int] = {}  # two words share a hash
    which = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())])
    return np.unique(which, return_index=True)[1], which


def _all_same(raw: bytes, starts: np.ndarray, ends: np.ndarray, twin: np.ndarray) -> bool:
    """Whether every slice has the bytes of its twin."""
    size = ends - starts
    if (size != size[twin]).any():
        return False
    lanes = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))
    long = np.flatnonzero(size > LANES)
    at = np.flatnonzero(size <= LANES)
    for k in range(0, LANES, 8):
        at = at[size[at] > k]
        if ((lanes[starts[at] + k] ^ lanes[starts[twin[at]] + k]) & _MASKS[np.minimum(size[at] - k, 8)]).any():
            return False
    return all(raw[starts[i] : ends[i]] == raw[starts[j] : ends[j]] for i, j in zip(long, twin[long]) if i != j)


def _pieces(data: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, text after the last, first byte, byte after the last): texts of PIECE bytes together; a longer text
    comes alone, in parts that end where a word ends."""
    k, n = 0, len(cuts) - 1
    while k < n:
        m = max(k + 1, int(np.searchsorted(cuts, cuts[k] + PIECE, "right")) - 1)
        a, end = int(cuts[k]), int(cuts[m])
        while end - a > PIECE:
            b = a + PIECE
            while b < end and not len(gaps := np.flatnonzero(LOWER[data[b : b + PIECE]] == 0)):
                b += PIECE
            b = min(b + int(gaps[0]) if b < end else end, end)
            yield k, m, a, b
            a = b
        yield k, m, a, end
        k = m


def _binary(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices as an Arrow array."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    data = low[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of lang, source, text (none null), added up for each piece of texts."""
    names = ["lang", "source", "term", "n", "docs"]
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.cast(batch["text"], pa.large_string())
        cuts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: cuts[-1]]
        codes: dict[tuple[str, str], int] = {}
        group = np.array([codes.setdefault(g, len(codes)) for g in zip(batch["lang"].to_pylist(), batch["source"].to_pylist())])
        langs, sources = (pa.array([g[k] for g in codes], pa.string()) for k in (0, 1))
        parts: dict[bytes, int] = {}  # of a text that comes in parts
        for k, m, a, b in _pieces(data, cuts):
            low = LOWER[data[a:b]]
            starts, ends = words(low, cuts[k : m + 1] - a)
            first, which = distinct(low.tobytes(), starts, ends)
            terms = _binary(low, starts[first], ends[first])
            if b - a < cuts[m] - cuts[k]:
                for t, c in zip(terms.to_pylist(), np.bincount(which).tolist()):
                    parts[t] = parts.get(t, 0) + c
                if b == cuts[m]:
                    n = pa.array(parts.values(), pa.int64())
                    own = pa.array(np.full(len(n), group[k]))
                    yield pa.RecordBatch.from_arrays([langs.take(own), sources.take(own), pa.array(parts, pa.binary()), n, pa.array(np.ones(len(n), np.int64))], names=names)
                    parts = {}
            elif len(terms):
                doc = np.searchsorted(cuts[k : m + 1] - a, starts, "right") - 1 + k
                pairs, count = np.unique(doc * len(terms) + which, return_counts=True)  # of texts and words
                keys, back = np.unique(group[pairs // len(terms)] * len(terms) + pairs % len(terms), return_inverse=True)  # of groups and words
                own = pa.array(keys // len(terms))
                n, docs = np.bincount(back, weights=count).astype(np.int64), np.bincount(back)
                yield pa.RecordBatch.from_arrays([langs.take(own), sources.take(own), terms.take(pa.array(keys % len(terms))), pa.array(n), pa.array(docs)], names=names)


def _share(count: str, size: str) -> str:
    """SQL of 1 + floor(10^9 * count / size) for count <= size; null for a size of 0."""
    size, first = f"nullif({size}, 0)", f"({count}) * 1000"
    second = f"({first} % {size}) * 1000"
    return f"1 + ({first} div {size}) * 1000000 + ({second} div {size}) * 1000 + (({second} % {size}) * 1000 div {size})"


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _tile(table: pa.Table) -> pa.RecordBatch:
    """lang, source, item, value of one tile, sorted by source, the row without a word first, which has the share of a
    word that the source lacks and, in one tile of a language, the number of kept words."""
    source = table["source"].to_numpy()
    rows = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]]))
    p, block, kept = (table[c].to_numpy() for c in ("p", "block", "kept"))
    absent, block, kept, names = p[rows], block[rows], int(kept[rows[0]]), source[rows]
    entry = np.ones(len(p), bool)
    entry[rows] = False
    p = p[entry]
    own = np.repeat(np.arange(len(rows)), np.diff([*rows, len(entry)]) - 1)
    start = np.searchsorted(own, np.arange(len(rows) + 1))  # where each source's compressed row starts
    full = np.flatnonzero(start[1:] > start[:-1])
    word = table["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)[entry].astype(np.int64) if len(p) else np.zeros(0, np.int64)
    n_words = int(word.max()) + 1 if len(word) else 0
    sources, items, values = [], [], []
    for g in range(len(rows)):
        mine = slice(start[g], start[g + 1])
        share, has = np.full(n_words, absent[g]), np.zeros(n_words, bool)
        share[word[mine]], has[word[mine]] = p[mine], True
        none = _f(absent[g], absent)  # for each source, of a word that neither has
        level, times = np.unique(p[mine], return_counts=True)
        value = kept * none + ((_f(level, absent[:, None]) - none[:, None]) * times).sum(axis=1)
        if len(p):
            met = share[word]
            more = _f(met, p) - none[own] - np.where(has[word], _f(met, absent[own]) - none[own], 0)
            value[full] += np.add.reduceat(more, start[full])
        with_ = np.flatnonzero(block != block[g]) if table["crossed"][0].as_py() else np.flatnonzero(np.arange(len(rows)) != g)
        sources.append(np.full(len(with_), g))
        items.append(with_)
        values.append(value[with_])
    sources, items, values = map(np.concatenate, (sources, items, values))
    lang = table["lang"][0].as_py()
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(names[sources], pa.string()), pa.array(names[items], pa.string()), pa.array(values)], names=["lang", "source", "item", "value"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, starts in whole_runs(batches, ["tile", "lang", "low", "high", "bucket"]):
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
            yield _tile(table.slice(a, b - a))


def few(groups: DataFrame) -> bool:
    """Whether the groups' rows are of FEW_BYTES at most, by their names' bytes and 64 more each."""
    n = groups.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 64)).first()[0]
    return (n or 0) <= FEW_BYTES


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of documents (lang, source, text; others are passed over).

    Part "pair": for each source of a language every other source of it, with the sum over the language's kept words of
    floor((p - q)^2 / q), p the source's share of a word and q the other's, thousand-millionths with one added to each
    count. Part "term": the first `top` words whose share in the source is above that in the language, by the same
    measure. Ranks are from 1, the greatest value first, equal ones by the item's bytes.

    Null languages, sources and texts are empty strings, which are a language and a source like any other; a source
    without words, or of a language without kept words, has its pairs (value 0 without kept words). Repeated rows are
    documents of their own. An empty table gives an empty one. A text of any length is cut in parts of PIECE bytes.
    Nothing is gathered by source or language: counts meet by language and word, and a tile holds about ENTRIES shares of
    at most two blocks of sources.
    """
    with scratch.passing():
        rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
        counted = rows.mapInArrow(_count, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))
        met = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        own = Window.partitionBy("lang", "term")
        met = met.select("lang", "source", "term", "n", F.sum("docs").over(own).alias("df"), F.sum("n").over(own).alias("total"), (F.row_number().over(own.orderBy("source")) == 1).alias("new"))
        kept = scratch.saved(met.where(F.col("df") >= least_docs).drop("df"), "terms")

        sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum(F.col("new").cast("long")).alias("kept"), F.count("*").alias("entries"))
        groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0, ["size", "kept", "entries"])
        whole = groups.groupBy("lang").agg(F.sum("size").alias("lang_size"), F.sum("kept").alias("kept"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.greatest(F.ceil(F.sum("entries") / ENTRIES), F.lit(1)).cast("int").alias("buckets"))
        groups = groups.drop("kept", "entries").join(whole, "lang")
        groups = groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
        groups = scratch.saved(groups.withColumn("absent", F.coalesce(F.expr(_share("1L", "size + kept")), F.lit(1).cast("long"))), "sources")

        # a large source's words are many rows of one key: they are dealt over salts unless the groups can be broadcast
        if few(groups):
            rated = kept.join(F.broadcast(groups), ["lang", "source"])
        else:
            salts = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
            rated = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(32)).cast("int")).join(salts, ["lang", "source", "salt"]).drop("salt")
        rated = scratch.saved(rated.withColumns({"p": F.expr(_share("n + 1", "size + kept")), "q": F.expr(_share("total + 1", "lang_size + kept"))}).drop("n", "total", "new", "size", "lang_size", "absent"), "shares")

        best = rated.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
        place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        best = best.withColumn("rank", place).where(F.col("rank") <= top)

        shares = rated.select("lang", "source", "term", "p", "block", "blocks", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), F.lit(0).cast("long").alias("kept"))
        heads = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("absent").alias("p"), "block", "blocks", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), "kept")
        heads = heads.withColumn("kept", F.when(F.col("bucket") == 0, F.col("kept")).otherwise(0))
        dealt = shares.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other"), "crossed": F.col("block") != F.col("other")})
        dealt = dealt.withColumn("tile", F.xxhash64("lang", "low", "high", "bucket")).drop("other", "blocks")
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = dealt.repartition(parts, "tile").sortWithinPartitions("tile", "lang", "low", "high", "bucket", "source", F.asc_nulls_first("term"))
        pairs = dealt.mapInArrow(_tiles, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", place)
        return scratch.keep(scratch.Saved(pairs.unionByName(best), "divergences")).df


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(total) AS size FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, v.v, coalesce(sum(c.n), 0) AS size, v.size AS lang_size FROM g LEFT JOIN c USING (lang, source) LEFT JOIN v ON v.lang = g.lang GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.size + s.v) AS p, 1 + 1000000000::HUGEINT * (k.total + 1) // (s.lang_size + s.v) AS q FROM s JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= {TOP}"""
