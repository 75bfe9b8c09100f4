"""Operators on pairs, against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from lanternmill.llm import components, embed_dedup, line_dedup, simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long, fp long, file int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 8) for i, t in rows], DOC)  # fp and file clash on purpose


def union_find(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "Uno", "uno DOS", "A b c", "É é a\x85b c d e", "a b c " * 500, "x" * 100_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 6, 7])
def test_bit_sliced_counts(radius):
    r = np.random.default_rng(radius)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.concatenate([base ^ np.bitwise_or.reduce([np.uint64(1) << np.uint64(b) for b in r.choice(64, k, replace=False)] or [np.uint64(0)]) for k in range(9)])
    sliced = np.concatenate([simhash.planes(values), np.zeros((64, 1), np.uint64)], axis=1)
    for offset in (1, 40, 64, 80, 200):
        lanes = np.zeros(sliced.shape[1] * 64, np.uint8)
        lanes[: len(values) - offset] = 1
        got = simhash.close_at(sliced, offset, np.packbits(lanes, bitorder="little").view("<u8").astype(np.uint64), radius)
        assert got.tolist() == [i for i in range(len(values) - offset) if int(values[i] ^ values[i + offset]).bit_count() <= radius]


def test_simhash_components_equal_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(None, "solo"), (900, None), (901, ""), (3, "twice"), (3, "twice")]
    for g in range(12):
        base = [r.choice(words) for _ in range(300)]
        for k in range(r.randint(1, 25)):
            own = list(base)
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = r.choice(words)
            rows.append((len(rows) + 10, " ".join(own)))
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    names = {}
    for (i, _), root in zip(rows, roots):
        if i is not None:
            names[root] = min(i, names.get(root, i))
    want = sorted((str(i), f"{p:016x}", str(names.get(root))) for (i, _), p, root in zip(rows, prints, roots))
    assert sorted((str(x.doc_id), x.fingerprint, str(x.component_id)) for x in got) == want
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_large_files_are_compared_in_tiles(spark):
    r = np.random.default_rng(3)
    base = int(r.integers(0, 1 << 62))
    values = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 40, (150, 2))})
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    links = simhash.linked(frame, tile=16).collect()
    at = {v: i for i, v in enumerate(values)}
    reach = union_find(len(values), [(at[x.a], at[x.b]) for x in links])
    assert all(reach[at[x.a]] == reach[at[x.b]] and x.a != x.b for x in links)
    got = union_find(len(values), [(at[x.a], at[x.b]) for x in links])
    assert got == union_find(len(values), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3])


@pytest.mark.parametrize("shape", ["path", "star", "random", "empty"])
def test_components_over_many_rounds(spark, shape):
    r = random.Random(1)
    links = {"path": [(i, i + 1) for i in range(300)], "star": [(0, i) for i in range(1, 300)], "random": [(r.randrange(400), r.randrange(400)) for _ in range(250)], "empty": []}[shape]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(links, "a long, b long"), last_links=8).collect()}
    want = union_find(401, links)
    groups = {}
    for a, b in links:
        for x in (a, b):
            if a != b:
                groups.setdefault(want[x], set()).add(got[x])
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups) if groups else not got


def test_embeddings_equal_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((120, 32))
    near = base[:60] + 0.12 * r.standard_normal((60, 32))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(np.concatenate([base, near, base[:10]]))]
    rows = [(i, v, rows[i % 120][2] if i >= 120 else k) for i, v, k in rows]
    n = len(rows)
    rows += [(500, None, 1), (501, [0.0] * 32, 1), (502, [1.0, None] * 16, 1), (503, [float("nan")] * 32, 1), (504, rows[0][1], None), (505, rows[0][1][:8], 0), (506, [], 0), (507, [1e-200] * 8, 2), (508, [1e-200] * 7 + [1.01e-200], 2), (509, [1e200] * 8, 2), (510, [5e-324] * 8, 2), (0, rows[0][1], 0), (None, rows[1][1], 1)]
    frame = spark.createDataFrame([(i, v, k, 5) for i, v, k in rows], "vec_id long, embedding array<double>, label int, id int")
    got = {}
    for x in embed_dedup.near_duplicates(frame).collect():
        got.setdefault(x.vec_id, []).append((x.n_links, x.component_id, x.kept))
    unit = lambda v: (lambda x: x / np.linalg.norm(x))(np.array(v) / np.abs(v).max())
    usable = [(k, unit(v)) if v and None not in v and np.isfinite(v).all() and np.any(v) and k is not None else None for _, v, k in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if usable[i] and usable[j] and usable[i][0] == usable[j][0] and len(usable[i][1]) == len(usable[j][1]) and usable[i][1] @ usable[j][1] >= 0.98]
    roots = union_find(len(rows), links)
    count = np.bincount(np.array(links).ravel(), minlength=len(rows))
    assert len(links) > 40 and n == 190
    members = {}
    for (i, _, _), root in zip(rows, roots):
        if i is not None:
            members[root] = min(i, members.get(root, i))
    found = sum(x[0] for v in got.values() for x in v)
    assert found == count.sum()
    for at, (i, _, _) in enumerate(rows):
        for n_links, component, kept in got[i]:
            assert n_links == count[at] and kept == (i == component) and component == members.get(roots[at])
    assert embed_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_pairs_at_the_threshold_are_found(spark):
    """2,000 planted pairs of cosine 0.98 to 0.985 in 64 dimensions, and as many just below it."""
    r = np.random.default_rng(0)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    x = unit(r.standard_normal((4000, 64)))
    away = r.standard_normal((4000, 64))
    away = unit(away - (away * x).sum(axis=1)[:, None] * x)
    cos = np.concatenate([r.uniform(0.98001, 0.985, 2000), r.uniform(0.975, 0.97999, 2000)])[:, None]
    both = np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * away])
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(both)], "vec_id long, embedding array<double>, label int")
    got = embed_dedup.near_duplicates(frame).collect()
    found = [g for g in got if g.n_links]
    assert all(g.n_links == 1 and g.component_id == g.vec_id % 4000 and g.vec_id % 4000 < 2000 for g in found)
    assert len(found) >= 0.999 * 4000
    assert all(g.kept and g.component_id == g.vec_id for g in got if not g.n_links)


def test_itq_codes_are_balanced_and_near_vectors_share_them():
    r = np.random.default_rng(0)
    x = r.standard_normal((2000, 16)) @ r.standard_normal((16, 16))
    mean, projection = embed_dedup.itq(x, 16)
    bits = (x - mean) @ projection >= 0
    assert (abs(bits.mean(axis=0) - 0.5) < 0.1).all()


def brute_lines(rows, t):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    seen, out = [], {}
    for k in order:
        i, text = rows[k]
        if text is None:
            out[i] = None
            continue
        left = []
        for line in text.split("\n"):
            words = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.lower()))
            if not words or not any(len(words & s) / len(words | s) >= t - 1e-12 for s in seen):
                left.append(line)
            if words:
                seen.append(words)
        out[i] = "\n".join(left)
    return out


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.95])
def test_lines_equal_brute_force(spark, threshold):
    r = random.Random(9)
    words = [f"w{i}" for i in range(60)] + ["the"] * 20
    base = [[r.choice(words) for _ in range(r.randint(1, 30))] for _ in range(40)]
    rows = [(None, "first line of no one"), (1, None), (2, ""), (3, " \n\t\n"), (4, "x" * 50_000 + " y\nFirst  line\tof no one")]
    for i in range(5, 60):
        lines = []
        for _ in range(r.randint(1, 8)):
            own = list(r.choice(base))
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = r.choice(words)
            lines.append(" ".join(own))
        rows.append((i, "\n".join(lines)))
    out = line_dedup.remove_lines(docs(spark, rows), threshold)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp", "file", "n_lines", "n_removed"]
    assert {x.doc_id: x.text for x in out.collect()} == brute_lines(rows, threshold)
    assert line_dedup.remove_lines(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [0, 1 << 18])
def test_long_lines_many_lines_and_families_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_PLACES", broadcast)
    r = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    base = [[r.choice(words) for _ in range(n)] for n in (4, 5, 40, 55, 56, 57, 60, 70, 120, 300)]
    rows = []
    for i in range(12):
        lines = []
        for _ in range(90):
            own = list(r.choice(base))
            for _ in range(r.randint(0, max(1, len(own) // 8))):
                own[r.randrange(len(own))] = r.choice(words)
            lines += [" ".join(own), ""]
        rows.append((i, "\n".join(lines)))
    got = line_dedup.remove_lines(docs(spark, rows)).collect()
    assert {x.doc_id: x.text for x in got} == brute_lines(rows, 0.8)
    assert all(x.n_lines == 90 and x.n_removed for x in got[1:])


def test_rows_that_share_a_doc_id_do_not_crash(spark):
    out = line_dedup.remove_lines(docs(spark, [(1, "a b c d\nz"), (1, "a b c d\nz"), (2, "z\nq")])).collect()
    assert sorted((x.doc_id, x.text) for x in out) == [(1, "a b c d\nz"), (1, "a b c d\nz"), (2, "q")]


@pytest.mark.parametrize(("size", "guessed"), [(60, False), (200, True)])
def test_only_words_of_many_lines_are_guessed_with(spark, size, guessed):
    r = random.Random(5)
    base = [f"v{i}" for i in range(81)]
    rows = [(i, " ".join(base[r.randint(0, 4):] + [f"own{i}"] * r.randint(0, 1)) + f"\nx{i} y{i} z{i} q{i} u{i}") for i in range(size)]
    words = line_dedup._words(docs(spark, rows))
    assert all(list(x.words) == sorted(set(x.words)) for x in words.collect())
    sets = line_dedup._sets(words, line_dedup.rarity(words), 0.8)
    assert bool(line_dedup._guesses(sets, 0.8).count()) == guessed
    assert {x.doc_id: x.text for x in line_dedup.remove_lines(docs(spark, rows)).collect()} == brute_lines(rows, 0.8)


def test_classes_tell_words_of_70_lines_from_words_of_120(spark):
    before = spark.conf.get(line_dedup.WIDE[0])
    words = spark.createDataFrame([(0, i, [2, 3][: 1 + (i < 70)]) for i in range(120)], "doc long, line int, words array<long>")
    classes = line_dedup.rarity(words).first().classes
    assert (classes[1], classes[2], classes[3]) == (0, 27, 24)
    assert {x.doc_id: (x.text, x.n_lines) for x in line_dedup.remove_lines(docs(spark, [(1, "a b\n \t\nc"), (2, "c\n\nd")])).collect()} == {1: ("a b\n \t\nc", 2), 2: ("\nd", 2)}
    assert spark.conf.get(line_dedup.WIDE[0]) == before
