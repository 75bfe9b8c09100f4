"""Nearest vectors by matrices against plain cosines of all pairs."""

import math

import numpy as np
import pytest

from lanternmill.operators import nearest as N


def plain(vectors, queries, k):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v, float) / np.linalg.norm(v)

    out = []
    for p, q, x in queries:
        x = unit(x)
        scores = []
        for part, i, y in vectors:
            if part == p:
                y = unit(y)
                c = float(x @ y) if x is not None and y is not None and len(x) == len(y) else 0.0
                scores.append((float(N.rounded(np.array([c]))[0]), i))
        out += [(q, n, i, s) for n, (s, i) in enumerate(sorted(scores, key=lambda s: (-s[0], s[1] is None, s[1]))[:k])]
    return sorted(out, key=repr)


def rows(n, seed, name=int):
    r = np.random.default_rng(seed)
    heads = r.standard_normal((12, 16))
    x = heads[r.integers(0, 12, n)] + 0.05 * r.standard_normal((n, 16))
    x[: n // 3] = x[0]
    return [("p" if i % 5 else "other", name(i), v) for i, v in enumerate(x.tolist())] + [("p", name(n), None), ("p", name(n + 1), []), ("p", name(n + 2), [0.0] * 16), ("p", name(n + 3), [1.0] * 3), ("p", name(n + 4), [math.nan] * 16), ("p", name(n + 5), [None] * 16), ("p", None, [1.0] * 16), (None, name(n + 6), [1.0] * 16)]


def run(spark, vectors, queries, k, part, kind="long"):
    v = spark.createDataFrame([(p, i, x, 1) for p, i, x in vectors], f"part string, id {kind}, vector array<double>, c int").repartition(3)
    q = spark.createDataFrame([(p, i, x, 1) for p, i, x in queries], "part string, query_id long, qvector array<double>, kind int")
    v, q = (v, q) if part else (v.drop("part"), q.drop("part"))
    return sorted(((r.query_id, r.rank, r.id, r.score) for r in N.nearest(v, q, k).collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_equals_all_pairs(spark, monkeypatch, small):
    if small:
        for name, value in (("QUERIES", 7), ("TILE_ROWS", 100), ("BATCH", 40), ("CENTRES", 5), ("TOGETHER", 3)):
            monkeypatch.setattr(N, name, value)
    vectors = rows(500, 1)
    queries = [(p, i, v) for p, i, v in rows(40, 1) if i is not None] + [("none", 99, [1.0] * 16)]
    assert run(spark, vectors, queries, 7, True) == plain(vectors, queries, 7)
    flat = [(None, i, v) for _, i, v in vectors]
    assert run(spark, vectors, queries, 7, False) == plain(flat, [(None, i, v) for _, i, v in queries], 7)


def test_names_as_ids_and_nothing_there(spark):
    vectors = rows(60, 2, lambda i: f"n{i}")
    queries = [("p", 1, vectors[1][2]), ("other", 2, vectors[5][2])]
    assert run(spark, vectors, queries, 5, True, "string") == plain(vectors, queries, 5)
    assert run(spark, [], queries, 5, False) == [] and run(spark, rows(5, 1), [], 5, True) == []


def test_groups_out_of_reach_are_passed_over():
    import pyarrow as pa

    vectors = [v for _, _, v in rows(4000, 3)][1400:4000]
    batch = lambda a, b: pa.table({"id": pa.array(range(a, b)), "vector": pa.array(vectors[a:b])})
    tile = N._Tile([pa.record_batch({"query_id": pa.array([0]), "vector": pa.array([vectors[0]])})], 10)
    tile.search(batch(0, 1300))
    before = tile.products
    tile.search(batch(1300, 2600))
    assert tile.products - before < 1300 / 3
