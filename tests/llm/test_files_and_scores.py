"""Archives, token files, mixing, packing, filters and scores."""

import hashlib
import io
import json
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternmill.llm import classifier, mixing, packing, quality_rules, scratch, token_files, tokens, url_filter, warc

ODD = ["", " ", "  ", "a  b", "a \n b", "a\n \nb", " x", "x ", "x\n ", "don't stop 's", "naïve café.", "tab\tx y", "a,. b", "<|endoftext|> hi", "x <|endoftext|> y", "a<|endoftext|>\nb c", "<|endof text|>", "日本 語 x", "a\n\n b c", "\n \n", "x  y", "I'm, they've.", "ªº µx ŉ ſ", "a.\n b", "foo\nBar baz\nQux. a\nb", "1 2,3 ."]


@pytest.fixture(scope="module")
def encoder():
    return tokens.encoder(tokens.default_path())


FRESH = []


def ids_of(encoder, text):
    """By a tokenizer that nothing of ours has touched."""
    from tokenizers import Tokenizer

    if not FRESH:
        FRESH.append(Tokenizer.from_file(tokens.default_path()))
    return FRESH[0].encode(text or "", add_special_tokens=False).ids


def test_chunked_ids_equal_the_library(encoder):
    r = random.Random(3)
    for text in [*ODD, *["".join(r.choice("ab .,\n'é1|") for _ in range(60)) for _ in range(500)]]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(encoder, text), text
    assert encoder.encode(None) == b""


def test_token_shard_round_trip_and_single_documents():
    r = np.random.default_rng(0)
    docs = [(i if i != 3 else None, r.integers(0, 50_000, n).astype("<u4")) for i, n in enumerate([5, 0, 1000, 7, 3])]
    dictionary = token_files.train_dictionary([r.integers(0, 50, 500).astype("<u2").tobytes() for _ in range(60)], 4096)
    out = io.BytesIO()
    writer = token_files.ShardWriter(out, dictionary, 2)
    for i, ids in docs:
        writer.add(i, ids)
    writer.finish()
    shard = token_files.Shard(out, dictionary)
    assert [(i, x.tolist()) for i, x in shard.documents(64)] == [(i, x.tolist()) for i, x in docs]
    assert shard.document(2).tolist() == docs[2][1].tolist()
    with pytest.raises(KeyError):
        shard.document(99)
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.Shard(out, b"x")


def test_token_files_round_trip(spark, encoder):
    rows = [(9, "uno dos"), (2, None), (2, "again"), (5, ""), (None, "no id"), (7, "largo " * 20_000), *[(20 + i, t) for i, t in enumerate(ODD)]]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, name int")
    got = token_files.read(spark, token_files.write(frame)).orderBy("start").collect()
    assert got[0].doc_id is None and [x.doc_id for x in got[1:]] == sorted(i for i, _ in rows if i is not None)
    assert [x.start for x in got] == [0, *np.cumsum([x.n_tokens for x in got])[:-1].tolist()]
    want = sorted((str(i), len(ids_of(encoder, t)) + 1, zlib.crc32(struct.pack(f"<{len(ids_of(encoder, t)) + 1}I", *ids_of(encoder, t), 2))) for i, t in rows)
    assert sorted((str(x.doc_id), x.n_tokens, x.ids_crc32) for x in got) == want
    assert token_files.read(spark, token_files.write(frame.limit(0))).count() == 0


def test_warc_round_trip_and_pushdown(spark):
    pages = spark.createDataFrame([(1, "http://a/1", "same"), (2, "http://a/2\r\nX: y", "same"), (3, None, None), (4, "http://b/", ""), (5, "http://a/é", "é" * 9000), (None, "u", "same"), (6, "v", "six")], "page_id long, url string, html string")
    folder = scratch.new_path(spark, "t")
    warc.archive(pages, folder)
    rows = {x.page_id: x for x in warc.pages_of(warc.read_warc(spark, folder)).collect()}
    digest = lambda t: warc.sha1_base32(t.encode())
    assert {k: (x.record_type, x.refers_to, x.payload_bytes, x.payload_digest) for k, x in rows.items()} == {
        1: ("revisit", 2, 4, digest("same")), 2: ("response", None, 4, digest("same")), None: ("revisit", 2, 4, digest("same")), 3: ("revisit", 4, 0, digest("")),
        4: ("response", None, 0, digest("")), 5: ("response", None, 18000, digest("é" * 9000)), 6: ("response", None, 3, digest("six")),
    }
    some = warc.read_warc(spark, folder).where("record_type = 'response' and target_uri like 'http://a/%'")
    assert sorted(bytes(x.payload).decode()[:4] for x in some.collect()) == ["same", "éééé"]
    reader = warc.WarcReader({"path": folder})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 4)]))
    assert len(left) == 1 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3
    empty = scratch.new_path(spark, "t")
    warc.archive(pages.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_archives_can_be_added_to_and_written_anew(spark):
    page = lambda i, t: spark.createDataFrame([(i, "u", t, "clash")], "page_id long, url string, html string, sha1 string")
    folder = scratch.new_path(spark, "t")
    for i in (1, 2, 3):
        warc.archive(page(i, f"page {i}"), folder)
    assert sorted(x.page_id for x in warc.pages_of(warc.read_warc(spark, folder)).collect()) == [1, 2, 3]
    rows = page(4, "four").selectExpr("'urn:page:4' AS record_id", "'response' AS record_type", "url AS target_uri", "CAST(NULL AS STRING) AS refers_to", "CAST(html AS BINARY) AS payload")
    rows.write.format("warc").mode("overwrite").save(folder)
    assert [x.page_id for x in warc.pages_of(warc.read_warc(spark, folder)).collect()] == [4]


def test_ties_for_the_largest_page_are_all_responses(spark):
    pages = spark.createDataFrame([(5, "a", "t"), (5, "b", "t"), (1, "c", "t")], "page_id long, url string, html string")
    folder = scratch.new_path(spark, "t")
    warc.archive(pages, folder)
    got = sorted((x.page_id, x.record_type, x.refers_to) for x in warc.pages_of(warc.read_warc(spark, folder)).collect())
    assert got == [(1, "revisit", 5), (5, "response", None), (5, "response", None)]


@pytest.mark.parametrize("part_bytes", [1, 700, 1 << 20])
def test_parts_hold_every_member_once(spark, part_bytes):
    pages = spark.createDataFrame([(i, "u", f"p{i} " * (1 + 50 * (i % 5))) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    folder = scratch.new_path(spark, "t")
    warc.archive(pages, folder)
    reader = warc.WarcReader({"path": folder, "partbytes": part_bytes})
    got = [x for p in reader.partitions() for b in reader.read(p) for x in b["record_id"].to_pylist()]
    assert sorted(got) == sorted(f"urn:page:{i}" for i in range(40))


@pytest.mark.parametrize("packed", [False, True])
def test_warc_of_other_writers(spark, tmp_path, packed):
    import gzip

    parts = [warc.record("urn:a", "response", b"x\r\n\r\ny", warc.sha1_base32(b"x\r\n\r\ny"), "http://h/"), b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"]
    data = b"".join(gzip.compress(p) for p in parts) if packed else b"".join(parts)
    (tmp_path / ("a.warc.gz" if packed else "a.warc")).write_bytes(data)
    got = {x.record_id: (x.record_type, bytes(x.payload)) for x in warc.read_warc(spark, f"file://{tmp_path}").collect()}
    assert got == {"urn:a": ("response", b"x\r\n\r\ny"), "urn:i": ("warcinfo", b"hello")}


@pytest.mark.parametrize("seed", range(20))
def test_schedule_stays_within_a_block(seed):
    r = random.Random(seed)
    n = r.randint(1, 10)
    blocks, weights = [r.randint(0, 40) for _ in range(n)], [r.random() + 0.01 for _ in range(n)]
    weights = [w / sum(weights) for w in weights]
    got = list(mixing.schedule(blocks, weights))
    assert sorted(got) == [(s, k) for s in range(n) for k in range(blocks[s])]
    fluid, done = mixing.Fluid(blocks, weights), [0] * n
    for t, (s, k) in enumerate(got):
        assert k == done[s]
        done[s] += 1
        low, high = 0.0, max(b / w for b, w in zip(blocks, weights)) + 1
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if fluid.slot(mid) < t + 1 else (low, mid)
        assert all(abs(done[j] - min(blocks[j], weights[j] * high)) < 1 + 1e-6 for j in range(n))


def test_mix_places_every_row_once(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None) for i in range(200)] + [(5, "s1"), (5, "s1"), (None, "s2")]
    frame = spark.createDataFrame([(i, s, 1) for i, s in rows], "doc_id long, source string, slot int")
    got = mixing.mix(frame, {"s0": 3.0}, block_docs=8).collect()
    assert len(got) == len(rows) and len({x.position for x in got}) == len(rows)
    assert sorted(str(x.doc_id) for x in got) == sorted(str(i) for i, _ in rows)
    for s in ("", "s0", "s1", "s2"):
        own = sorted((x for x in got if x.source == s), key=lambda x: x.position)
        assert [x.doc_id for x in own] == sorted((x.doc_id for x in own), key=lambda i: (i is not None, i or 0))
    assert mixing.mix(frame.limit(0)).count() == 0
    whole = mixing.in_mixed_order(frame, block_docs=8)
    assert whole.columns == frame.columns and whole.count() == len(rows)


def test_bounds_and_best_fit():
    r = np.random.default_rng(1)
    for _ in range(60):
        capacity = int(r.integers(5, 60))
        lengths = r.integers(1, capacity + 1, int(r.integers(0, 60)))
        sequence, offset = packing.best_fit_decreasing(lengths, capacity)
        n = int(sequence.max()) + 1 if len(lengths) else 0
        assert packing.lower_bound(lengths, capacity) <= n + 1e-9
        for s in range(n):
            own = sorted(zip(offset[sequence == s], lengths[sequence == s]))
            assert own[0][0] == 0 and all(a + x == b for (a, x), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= capacity
    assert packing.lower_bound(np.array([6] * 9), 10) == 9


def plain_best_fit(lengths, capacity):
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= x]
        if fits:
            k = min(fits, key=lambda k: rooms[k])
            rooms[k] -= x
        else:
            rooms.append(capacity - x)
            n += 1
    return n, sorted(rooms)


def fewest(lengths, capacity):
    """The least number of sequences, by trying all placements."""
    best = len(lengths)
    lengths = sorted(lengths, reverse=True)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= lengths[k]}.values():
            place(k + 1, [*rooms[:i], rooms[i] - lengths[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def test_best_fit_and_bound_against_plain_versions():
    r = np.random.default_rng(8)
    for _ in range(60):
        capacity, lengths = 20, r.integers(1, 21, int(r.integers(1, 11)))
        sequence, offset = packing.best_fit_decreasing(lengths, capacity)
        n = int(sequence.max()) + 1
        rooms = sorted(capacity - int(lengths[sequence == s].sum()) for s in range(n))
        assert (n, rooms) == plain_best_fit(lengths.tolist(), capacity)
        assert math.ceil(packing.lower_bound(lengths, capacity) - 1e-9) <= fewest(lengths.tolist(), capacity) <= n


def test_exchange_saves_sequences(spark):
    r = np.random.default_rng(4)
    items = [(i, int(n)) for i, n in enumerate(r.integers(1, 100, 3000))]
    frame = spark.createDataFrame(items, "uid long, length long")
    alone = packing.pack(frame, 100, shard_items=100, rounds=0).select("sequence_id").distinct().count()
    got = packing.pack(frame, 100, shard_items=100, rounds=3)
    rows = got.join(frame, "uid").groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.countDistinct("offset").alias("places"), F.count("*").alias("k")).collect()
    assert all(x.n == x.end <= 100 and x.places == x.k for x in rows) and sum(x.k for x in rows) == 3000
    assert sum(n for _, n in items) / 100 <= len(rows) <= alone
    assert packing.pack(frame.limit(0), 100).count() == 0


def test_packing_in_order_takes_neighbours_in_many_shards(spark):
    r = np.random.default_rng(5)
    uids = np.cumsum(r.integers(1, 1 << 34, 3000))  # with gaps, as in the uids of pieces
    rank = {int(u): i for i, u in enumerate(uids)}
    frame = spark.createDataFrame([(int(u), int(n)) for u, n in zip(uids, r.integers(1, 100, 3000))], "uid long, length long").repartition(7, "length")

    def spans(rounds):
        held = packing.pack(frame, 100, shard_items=30, rounds=rounds, fan=4, in_order=["uid"]).groupBy("sequence_id").agg(F.collect_list("uid").alias("uids")).collect()
        assert sorted(u for x in held for u in x.uids) == uids.tolist()
        return max(max(map(rank.get, x.uids)) - min(map(rank.get, x.uids)) for x in held)

    assert spans(0) < 30 and spans(1) < 4 * 30  # 100 shards, pools of 4


def test_pieces_of_documents(spark, encoder):
    rows = [(1, "uno dos tres " * 900), (2, None), (2, ""), (None, "x"), (3, "w " * 511)]
    frame = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, length int")
    got = packing.pack_documents(frame).collect()
    for i, t in rows[:1] + rows[3:]:
        own = sorted((x for x in got if x.doc_id == i), key=lambda x: x.piece)
        ids = [*ids_of(encoder, t), 2]
        assert [x.start for x in own] == [0, *np.cumsum([x.length for x in own])[:-1].tolist()] and sum(x.length for x in own) == len(ids)
        assert all(x.length == 1024 for x in own[1:]) and all(x.ids_crc32 == zlib.crc32(struct.pack(f"<{x.length}I", *ids[x.start : x.start + x.length])) for x in own)
    assert sum(x.doc_id == 2 and x.length == 1 for x in got) == 2


@pytest.mark.parametrize("max_bits", [1 << 26, 128])
def test_cascade_is_exact(spark, max_bits):
    r = random.Random(0)
    pages = [(i, f"http://H{r.randrange(30)}.net/p/{r.randrange(300)}?x#y") for i in range(800)] + [(900, None), (901, "no scheme"), (902, "http://a.example.org/es/1"), (903, "http://example.org/en/1x"), (904, "http://x.com/fr/"), (905, "http://xcom/fr/")]
    keys = sorted({u.split("://")[1].split("?")[0].lower() for _, u in pages if u and "://" in u})
    listed = [k for k in keys if r.random() < 0.3] + ["never/seen", None, keys[0], keys[0]]
    out = url_filter.judge(spark.createDataFrame([(i, u, 2) for i, u in pages], "page_id long, url string, key int"), spark.createDataFrame([(k,) for k in listed], "key string"), max_bits=max_bits)
    got = {x.page_id: x for x in out.collect()}
    assert len(got) == len(pages) and (got[900].host, got[900].path, got[900].rule, got[900].verdict) == ("", "", None, "allow")
    assert [(got[i].rule, got[i].verdict) for i in (902, 903, 904)] == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow")] and got[905].rule is None
    for i, u in pages[:800]:
        assert got[i].verdict == ("block" if got[i].host + got[i].path in set(listed) else "allow") and got[i].host.startswith("h")
    nothing = url_filter.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "key string"))
    assert nothing.count() == 0


def test_quality_counts_equal_brute_force(spark):
    import re

    r = random.Random(6)
    rows = [(1, None, "en"), (2, "", None), (3, " \n ", "xx"), (4, "uno " * 30, "en"), (5, "a b\na b\n\n|#x|\na b ", "en"), (None, "x " * 25, "en")]
    rows += [(10 + i, " ".join(r.choice("uno dos tres cuatro cinco seis siete ocho nueve diez".split()) for _ in range(r.randint(5, 120))) + "\nfin", "en") for i in range(40)]
    base = " ".join(f"p{i}" for i in range(20))
    rows += [(80, f"{base} q r {base} {base}", "en")]
    frame = spark.createDataFrame([(i, t, g, "w") for i, t, g in rows], "doc_id long, text string, lang string, words string")
    got = {x.doc_id: x for x in quality_rules.judge(frame).collect()}
    for i, text, _ in rows:
        text, x = text or "", got[i]
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        hit = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(8)}
        lines = [v for v in text.split("\n") if v.split()]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
        assert x.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (x.base_failed and x.kept)
    assert quality_rules.judge(frame.limit(0)).count() == 0


def test_divergence_rejects_what_differs_from_its_language(spark):
    r = random.Random(2)
    words = ["the"] * 6 + ["of"] * 4 + ["and"] * 4 + [f"word{chr(97 + i)}" for i in range(26)]
    prose = [" ".join(r.choice(words) for _ in range(150)) for _ in range(60)]
    junk = [" ".join(w.upper() + "!!" for w in prose[0].split()), " ".join(f"{w} |" for w in (f"zz{i}" for i in range(90)))]
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(prose + junk)], "doc_id long, text string, lang string")
    kept = {x.doc_id for x in quality_rules.judge(frame).where("kept").collect()}
    assert kept == set(range(60))


def test_classifier_holds_out_and_learns(spark):
    r = random.Random(8)
    good = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + r.choice(["", "s", "ing"]) for _ in range(40)) for _ in range(150)]
    bad = [" ".join(r.choice(["alpha", "beta"]) + "***" for _ in range(40)) for _ in range(75)] + [" ".join([w] * 40) for w in (f"{r.choice('abc')}{i}" for i in range(75))]
    rows = [(i, t, 1 if i < 150 else 0) for i, t in enumerate(good + bad)]
    documents = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (None, "alpha", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = classifier.fit(documents, labels)
    got = {x.doc_id: x for x in classifier.score(documents, model).collect()}
    assert len(got) == len(rows) + 3 and got[900].score == got[901].score
    for i, _, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.3)
    held = [(got[i].score, y) for i, _, y in rows if got[i].held_out]
    assert np.mean([(s >= 0.3) == (y == 1) for s, y in held]) > 0.9
    flipped = labels.withColumn("quality", F.when(classifier.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(classifier.fit(documents, flipped).weights, model.weights)
    assert classifier.score(documents, classifier.fit(documents, labels.limit(0))).where("score = 0.5").count() == len(got)


def test_each_of_many_languages_has_its_reference(spark, monkeypatch):
    r = random.Random(12)
    rows = []
    for k in range(70):
        own = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{c}" for c in "abcdefgh"]
        rows += [(10 * k + i, " ".join(r.choice(own) for _ in range(90)), f"l{k:02d}") for i in range(2 if k == 69 else 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    alone = {tuple(x) for x in quality_rules.judge(frame.where("lang = 'l69'")).collect()}
    every = {x.doc_id: x for x in quality_rules.judge(frame).collect()}
    assert alone == {tuple(x) for i, x in every.items() if i >= 690} and all(x.kept for x in every.values()) and len(every) == len(rows)
    monkeypatch.setattr(quality_rules, "BROADCAST", 8)
    assert {x.doc_id: x for x in quality_rules.judge(frame).collect()} == every


def test_every_ngram_of_a_long_word_counts():
    r = random.Random(6)
    word = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(70_000))
    marked, want = f"<{word}>", []
    for n in (3, 4):
        want += [zlib.crc32(marked[i : i + n].encode(), n) % 4096 for i in range(len(marked) - n + 1)]
    want.append(zlib.crc32(marked.encode()) % 4096)
    assert sorted(classifier.subwords(word, 4096)) == sorted(want)
    ids, times = classifier.long_word(word, 4096)
    assert np.array_equal(np.repeat(ids, times), np.sort(want))
    model = classifier.Model(np.random.default_rng(1).normal(size=4096).astype(np.float32), 0.0)
    scores = classifier.WordScores(model)
    assert abs(scores[word] - model.weights[want].astype(float).mean()) < 1e-9 and not len(scores)


def test_classifier_learns_from_the_middle_of_texts_without_spaces():
    r = random.Random(9)
    text = lambda mark: "".join(r.choice("一二三四五六七八九") + (mark if k in r.sample(range(900), 60) else "") for k in range(900))
    rows = [(text("好的吗" if i % 2 else "坏了啊"), i % 2) for i in range(60)]
    model = classifier.train([t for t, _ in rows[:40]], [y for _, y in rows[:40]])
    scores = classifier.WordScores(model)
    assert all((model.score(t, scores) > 0.5) == (y == 1) for t, y in rows[40:])


def test_manifest_of_archive_names_committed_files(spark):
    folder = scratch.new_path(spark, "t")
    warc.archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), folder)
    fs, at = scratch.file_system(folder)
    from pyarrow.fs import FileSelector

    names = warc._manifests(f.base_name for f in fs.get_file_info(FileSelector(at)))
    with fs.open_input_stream(f"{at}/{names[0]}", compression=None) as s:
        assert len(json.loads(s.read())) == 1
    assert hashlib.sha1(b"x").digest()


def test_scores_equal_a_plain_forward_pass(spark):
    """Every n-gram of every word of whole texts, one after the other."""
    r = random.Random(2)
    texts = [None, "", " \n", "uno uno dos", "x" * 10_000, "naïve café naïve", *[" ".join(r.choice(["alfa", "be", "c", "delta" * 80]) for _ in range(r.randint(1, 40))) for _ in range(20)]]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(3, "uno uno dos", 9), (None, "uno", 9)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, score int")
    model = classifier.Model(np.random.default_rng(0).standard_normal(1 << 10).astype(np.float32), 0.25)

    def word_score(word):
        marked = f"<{word}>"
        grams = [zlib.crc32(marked.encode())] + ([] if word == classifier.SAME else [zlib.crc32(marked[i : i + n].encode(), n) for n in (3, 4) for i in range(len(marked) - n + 1)])
        return sum(float(model.weights[g % 1024]) for g in grams) / len(grams)

    def plain(text):
        words = (text or "").split()
        pairs = sum(a == b for a, b in zip(words, words[1:]))
        z = (sum(map(word_score, words)) + pairs * word_score(classifier.SAME)) / len(words) if words else 0.0
        return 1 / (1 + math.exp(-0.25 - z))

    got = classifier.score(documents, model).collect()
    assert sorted((str(x.doc_id), round(x.score, 9), x.predicted) for x in got) == sorted((str(i), round(plain(t), 9), int(plain(t) >= 0.3)) for i, t, _ in rows)
    assert classifier.score(documents.limit(0), model).count() == 0


@pytest.mark.parametrize("url", ["http://" + "a" * 50_000 + ".org/x", "http://h/" + "p" * 200_000, "x" * 100_000])
def test_very_long_urls(spark, url):
    pages = spark.createDataFrame([(1, url, None, True)], "page_id long, url string, html string, listed boolean")
    got = url_filter.judge(pages, spark.createDataFrame([], "key string")).collect()[0]
    want = url.split("://")[1].split("/") if "://" in url else ["", ""]
    assert (got.host, got.path) == (want[0], "/" + want[1] if "://" in url else "") and got.verdict == "allow"


def test_very_long_texts_have_counts(spark):
    text = "uno dos tres " * 40_000 + "x" * 300_000
    got = quality_rules.judge(spark.createDataFrame([(1, text, "en", 5)], "doc_id long, text string, lang string, n_words int")).collect()[0]
    assert got.n_words == 120_001 and got.n_repeat_words == 120_000 and got.base_failed and not got.kept
