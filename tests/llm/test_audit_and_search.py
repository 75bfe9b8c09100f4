"""The divergence audit and the exact search against brute force in plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lanternmill.llm import divergence, exact_search

DOC = "doc_id long, text string, lang string, source string, p long, kept int, term string, tile int"


def plain_audit(rows, least_docs=3, top=200):
    """rows: (text, lang, source)."""
    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [([re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in pattern.findall(t or "")], lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        df = Counter(w for words, _, _ in own for w in set(words))
        kept = {w for w, n in df.items() if n >= least_docs}
        counts = defaultdict(Counter)
        for words, _, s in own:
            counts[s].update(w for w in words if w in kept)
        total = sum(counts.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        f = lambda p, q: (p - q) * (p - q) // q
        of = {s: share(c) for s, c in counts.items()}
        whole = share(total)
        for s in of:
            pairs = [(sum(f(of[s][w], of[o][w]) for w in kept), o) for o in of if o != s]
            terms = [(f(of[s][w], whole[w]), w) for w in kept if counts[s][w] and of[s][w] > whole[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                best = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(best, 1) if part == "pair" or k <= top]
    return sorted(out)


def got_audit(spark, rows, **options):
    docs = spark.createDataFrame([(i, *r, 1, 2, "x", 3) for i, r in enumerate(rows)], DOC).repartition(3)
    return sorted(tuple(r) for r in divergence.audit(docs, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def sample(seed, n=160):
    r = random.Random(seed)
    words = ["la", "LA", "él", "İx", "ñandú", "a-b", "x1y", "日本", "é", "zz", "\x00q", "\x85", "ß", "of", "the", *(chr(97 + i % 26) * (i + 1) for i in range(40))]
    rows = [(" ".join(r.choices(words, k=r.randrange(0, 60))), r.choice(["en", "es", None]), r.choice(["hot"] * 5 + ["s1", "s2", "S2", "", None, "é"])) for _ in range(n)]
    return rows + rows[:10] + [(None, "en", "mute"), ("", "de", "a"), ("one two", "de", "b"), ("x" * 300_000 + " la", "en", "s1"), (" \n\t9", "fr", "only")]


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_brute_force(spark, seed):
    rows = sample(seed)
    assert got_audit(spark, rows) == plain_audit(rows)


def test_audit_in_small_pieces_tiles_and_blocks(spark, monkeypatch):
    """Texts in parts, many tiles, crossed blocks of sources, salted groups: the same rows."""
    rows = [(t, lang, s and f"{s}{i % 7}") for i, (t, lang, s) in enumerate(sample(3))]
    for name, value in (("PIECE", 64), ("ENTRIES", 16), ("BLOCK", 3), ("FEW_BYTES", 0), ("LANES", 8)):
        monkeypatch.setattr(divergence, name, value)
    assert got_audit(spark, rows, top=5) == plain_audit(rows, top=5)


def test_audit_of_no_documents(spark):
    assert got_audit(spark, []) == []


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(divergence, "hash_of", lambda x: len(x) // 2)
    raw = b"ab cd ab abc cd abcd"
    starts, ends = divergence.words(divergence.LOWER[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]))
    first, which = divergence.distinct(raw, starts, ends)
    found = [raw[starts[i] : ends[i]] for i in first]
    assert sorted(found) == [b"ab", b"abc", b"abcd", b"cd"] and [found[w] for w in which] == raw.split()


def test_a_long_word_is_compared_to_its_end():
    a, b = b"x" * 200 + b"a", b"x" * 200 + b"b"
    raw = a + b + a
    starts = np.array([0, 201, 402])
    assert divergence._all_same(raw, starts, starts + 201, np.array([0, 1, 0]))
    assert not divergence._all_same(raw, starts, starts + 201, np.array([0, 0, 0]))


def test_shares_are_exact_at_large_counts(spark):
    for count, size in ((1, 3), (7 * 10**14, 9 * 10**14), (10**12 + 7, 10**12 + 9), (5, 5)):
        got = spark.range(1).selectExpr(f"{divergence._share(f'{count}L', f'{size}L')} AS p").first().p
        assert got == 1 + 10**9 * count // size
    assert spark.range(1).selectExpr(f"{divergence._share('1L', '0L')} AS p").first().p is None


VEC = "vec_id long, embedding array<double>, label int, row string, least int"


def plain_search(rows, k=10):
    usable = [(i, [math.floor(1024 * x) if abs(1024 * x) != math.inf else int(x) * 1024 for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(usable):
        if q is not None and q % 100 == 0:
            scores = [(min(max(sum(i * j for i, j in zip(x, y)), exact_search.LOW), exact_search.HIGH), i) for b, (i, y) in enumerate(usable) if a != b and len(x) == len(y)]
            best = sorted(scores, key=lambda s: (-s[0], s[1] is None, s[1]))[:k]
            out += [(q, n, i, s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out, key=repr)


def got_search(spark, rows):
    vectors = spark.createDataFrame([(i, v, 1, "r", 2) for i, v in rows], VEC).repartition(3)
    return sorted((tuple(r) for r in exact_search.top_k(vectors, lambda i: i % 100 == 0).select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def vectors(n, seed=0, dim=20):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim)) * np.geomspace(3, 0.01, dim)
    x[: n // 3] = x[0]  # a third of all rows are alike
    return [(int(i), row) for i, row in zip(r.permutation(n), x.tolist())]


EDGES = [
    (100, None), (200, []), (300, [0.0] * 20), (400, [math.nan] + [0.0] * 19), (500, [math.inf] + [1.0] * 19), (None, [0.5] * 20), (7, [None] + [1.0] * 19), (700, [1.0, 2.0]), (701, [2.0, 1.0]), (702, [2.0, 1.0]),
    (800, [0.25] * 20), (800, [0.25] * 20), (900, [3.0]),
]


@pytest.mark.parametrize("n", [0, 30, 1500])
def test_search_equals_brute_force(spark, n):
    rows = vectors(n) + EDGES if n else []
    assert got_search(spark, rows) == plain_search(rows)


def test_search_in_many_tiles(spark, monkeypatch):
    for name, value in (("QUERY_BYTES", 640), ("BATCH", 50), ("TOGETHER", 3), ("DIMENSIONS", 3), ("TILE_ROWS", 100)):
        monkeypatch.setattr(exact_search, name, value)
    rows = vectors(1200, 1) + EDGES
    assert got_search(spark, rows) == plain_search(rows)


def test_search_beyond_doubles_and_longs(spark):
    """Sums past 2^53 are exact; past 64 bits they are held at the ends of the range."""
    r = np.random.default_rng(3)
    rows = [(int(i), row) for i, row in enumerate((r.standard_normal((120, 4)) * 3e5).tolist())]
    assert got_search(spark, rows) == plain_search(rows)
    rows += [(200, [1e300, -1e308, 0.3, 2.0]), (201, [1e307, 1e307, 1.5, -0.1]), (202, [-1e12, 1.0, 0.0, 0.0])]
    assert got_search(spark, rows) == plain_search(rows)


def test_bounds_drop_candidates(monkeypatch):
    """After the first batch most candidates go before their last dimensions."""
    r = np.random.default_rng(0)
    x = np.floor(1024 * r.standard_normal((4000, 64)) * np.geomspace(2, 0.01, 64))
    best = exact_search.Best(x[:8].copy(), np.arange(8), np.full(8, exact_search.LOW), 10)
    widths = []
    real = np.outer
    monkeypatch.setattr(np, "outer", lambda a, b: widths.append(len(b)) or real(a, b))
    for a in (0, 2000):
        best.search(np.ascontiguousarray(x[a : a + 2000].T), np.arange(a, a + 2000), np.arange(a, a + 2000))
    assert widths[8:][0] == 2000 and widths[-1] < 500
