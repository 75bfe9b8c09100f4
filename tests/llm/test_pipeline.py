"""The pipeline against a plain version of all its stages."""

import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lanternmill.llm import entry, quality_rules, scratch, tokens  # noqa: E402
from tests.llm.test_near_duplicates import brute_lines, union_find  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(11)
    words = ["the"] * 8 + ["of"] * 5 + ["and"] * 5 + [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("nd", "st", "rm", "lking")]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = []
    for i in range(70):
        rows.append((i, "\n".join(line(r.randint(3, 40)) for _ in range(r.randint(2, 8))), "en", f"s{i % 4 if i % 3 else 0}"))
    rows += [(100 + i, rows[i][1], "en", "s1") for i in range(6)]  # copies
    rows += [(200 + i, rows[i][1].replace("the", "THE", 1) + "\n" + line(25), "en", None) for i in range(4)]
    rows += [(300, "short", "en", "s2"), (301, " ".join(["again and again it says so over there"] * 12), "en", "s2"), (302, None, "en", "s0"), (303, " ".join(w.upper() + "!!" for w in rows[0][1].split()), "en", "s0"), (304, line(3000), "en", "s3")]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def test_stages_equal_plain_versions(spark, tables):
    duckdb = pytest.importorskip("duckdb")
    folder, rows = tables
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    kept = {i for i, in con.execute(f"SELECT doc_id FROM ({quality_rules.SQL}) WHERE kept").fetchall()}
    assert not kept & {300, 301, 302} and len(kept) > 60
    texts = brute_lines([(i, t) for i, t, _, _ in rows if i in kept], 0.8)
    ids = sorted(texts)
    roots = union_find(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if jaccard(texts[ids[a]], texts[ids[b]]) >= 0.8])
    stay = [i for k, i in enumerate(ids) if roots[k] == k]
    encode = tokens.encoder(tokens.default_path()).tokenizer.encode
    want = set()
    for i in stay:
        all_ids = [*encode(texts[i], add_special_tokens=False).ids, 2]
        at, n = 0, len(all_ids)
        for piece in range(-(-n // 1024)):
            length = (n % 1024 or min(n, 1024)) if piece == 0 else 1024
            want.add((i, piece, at, length, zlib.crc32(struct.pack(f"<{length}I", *all_ids[at : at + length]))))
            at += length
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got} == want and len(got) == len(want)
    filled = {}
    for x in sorted(got, key=lambda x: x.offset):
        assert filled.get(x.sequence_id, 0) == x.offset
        filled[x.sequence_id] = x.offset + x.length
    assert max(filled.values()) <= 1024 and len(filled) <= sum(filled.values()) // 512 + 1


def test_sql_twins_are_sql():
    assert all(isinstance(x, str) for x in entry.oracle_sql().values()) and set(entry.oracle_sql()) <= set(entry.queries())


def jaccard(x, y, size=5):
    cut = lambda w: {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or {tuple(w)}
    x, y = cut(x.lower().split()), cut(y.lower().split())
    return len(x & y) / len(x | y)


def test_near_duplicates_equal_brute_force_jaccard(spark):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(4000)}"
    shared = [word() for _ in range(8)]
    texts = []
    for _ in range(40):
        base = [word() for _ in range(r.randint(60, 300))]
        base[10:10] = shared if r.random() < 0.5 else []
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 3)):  # similarities around the threshold
            for _ in range(r.randint(1, max(1, len(base) // 40))):
                base[r.randrange(len(base))] = word()
            texts.append(" ".join(base))
    texts += ["a b", "a b", "a c"]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    roots = union_find(len(texts), links)
    order = list(range(len(texts)))
    r.shuffle(order)
    rows = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string").repartition(5)
    got = sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, rows, "").collect())
    assert got == [i for i, x in enumerate(roots) if x == i] and 40 < len(got) < len(texts) - 20


def test_near_duplicates_are_dropped_by_row(spark):
    long = lambda c: " ".join(f"{c}{i}" for i in range(50))
    rows = [(1, long("a")), (1, long("a")), (2, long("b")), (3, long("b")), (3, long("c")), (None, long("c")), (None, long("d")), (None, long("d")), (4, long("e"))]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((x.text[0], x.doc_id) for x in got) == [("a", 1), ("b", 2), ("c", 3), ("d", None), ("e", 4)]


def test_stages_keep_columns_and_empty_tables(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS words", "2 AS position", "3 AS kept", "4 AS row")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_stages_take_columns_of_any_name(spark, tables, tmp_path):
    """Columns named as the stages' own working columns, with dots, spaces and quotes."""
    folder, rows = tables
    names = ["_file", "_at", "_metadata", "row", "_row", "id", "position", "part", "node", "key", "n", "kept", "ref", "a.b", "c d", "e`f", "uid", "n_lines2"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = docs.select("*", *[F.concat(F.lit(f"{k}-"), F.col("doc_id").cast("string")).alias(c) for k, c in enumerate(names)])
    plain, odd = docs, more
    for name, stage in corpus_pipeline.STAGES:
        plain, odd = scratch.saved(stage(spark, plain, folder), name), scratch.saved(stage(spark, odd, folder), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert odd.columns == more.columns
            for r in odd.collect():
                assert [r[c] for c in names] == [f"{k}-{r.doc_id}" for k in range(len(names))]
        own = lambda df: sorted(tuple(r[c] for c in plain.columns if c not in ("sequence_id", "offset")) for r in df.collect())
        assert own(plain) == own(odd)


def test_mixing_decides_the_order(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    from lanternmill.llm import mixing

    place = {x.doc_id: x.position for x in mixing.mix(docs, block_docs=4).collect()}
    order = [x.doc_id for x in mixing.in_mixed_order(docs, block_docs=4).collect()]
    assert [place[i] for i in order] == sorted(place.values())
    assert re.fullmatch(r"[a-z_]+", corpus_pipeline.STAGES[3][0])


def test_packing_goes_by_the_mix_after_it_is_read_again(spark, tmp_path):
    """Spark reads large files first; sequences still take neighbours of the mix."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(50)]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(r.randint(5, 400))), f"s{i % 5}") for i in range(1200)], "doc_id long, text string, source string")
    from lanternmill.llm import mixing, packing

    mixing.in_mixed_order(docs, block_docs=4).write.parquet(f"{tmp_path}/mixed")
    again = spark.read.parquet(f"{tmp_path}/mixed")
    place = {x.doc_id: x.position for x in mixing.mix(docs, block_docs=4).collect()}
    rank = {d: k for k, d in enumerate(sorted(place, key=place.get))}
    from lanternmill.llm.simhash_texts import ROW, with_row_keys

    keyed = scratch.saved(packing.pieces(with_row_keys(again), 1024, 2, None, tuple(ROW)).withColumn("uid", F.monotonically_increasing_id()), "keyed")
    order = [x.doc_id for x in with_row_keys(again).orderBy(*ROW).collect()]
    assert [rank[d] for d in order] == list(range(1200))
    packed = packing.pack(keyed.where("length < 1024").select("uid", "length", "start", *ROW), 1024, shard_items=100, rounds=0, in_order=[*ROW, "start"])
    held = packed.join(keyed.select("uid", "doc_id"), "uid").groupBy("sequence_id").agg(F.collect_list("doc_id").alias("ids")).collect()
    assert max(max(rank[d] for d in x.ids) - min(rank[d] for d in x.ids) for x in held) <= 100
