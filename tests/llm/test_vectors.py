"""Operators 7 and 8 against brute force."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import nearest, neardup_vectors
from loomline.llm.connected import components

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, n_links long"


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(8)
    base = r.standard_normal((300, 24))
    near = base[r.integers(0, 40, 300)] + r.standard_normal((300, 24)) * r.choice([0.05, 0.3, 0.42], (300, 1))
    x = np.concatenate([base, near, np.repeat(base[:1], 50, 0), base[1:3] * 7]).astype(np.float32)
    out = [(i, v.tolist(), 0, 1, 1) for i, v in enumerate(x)]
    bad = [None, [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [], [1.0, 2.0], [2.0, 4.0]]
    out += [(2000 + 20 * i, v, 0, 1, 1) for i, v in enumerate(bad)] + [(None, x[3].tolist(), 0, 1, 1), (5, x[5].tolist(), 0, 1, 1)]
    return out


def ok(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)


def brute_links(rows, threshold=0.9):
    live = [i for i, r in enumerate(rows) if ok(r[1])]
    n, root = [0] * len(rows), list(range(len(rows)))
    unit = {i: np.array(rows[i][1], np.float64) for i in live}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in live:
        for b in live:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((v for v in ids if v is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[i][0], n[i], least[find(i)]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("chunk", [2048, 40])
def test_near_vectors(spark, rows, chunk):
    found = neardup_vectors.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), recall=0.99999, chunk=chunk).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=str) == brute_links(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in found)


def test_pairs_at_the_threshold_are_met_as_in_production(spark, rows):
    found = neardup_vectors.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=str) == brute_links(rows)
    r, n, near = np.random.default_rng(12), 4000, 0.9002
    a = r.standard_normal((n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.standard_normal((n, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b = near * a + np.sqrt(1 - near**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    planted = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    got = neardup_vectors.near_vectors(spark.createDataFrame(planted, "vec_id long, embedding array<double>").repartition(4)).collect()
    assert sum(x.n_links == 0 for x in got) == 0 and {(x.n_links, x.component_id - x.vec_id % n) for x in got} == {(1, 0)}


def test_no_vectors(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    assert neardup_vectors.near_vectors(none).count() == 0 and nearest.nearest(none, F.col("vec_id") % 20 == 0).count() == 0
    bad = spark.createDataFrame([r for r in rows if not ok(r[1])], SCHEMA)
    assert {(r.n_links, r.kept) for r in neardup_vectors.near_vectors(bad).collect()} == {(0, True)}


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(1)
    unit = r.standard_normal((400, 64))
    unit[1:] += unit[0] * r.random((399, 1)) * 3
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    error, out = [], 0
    for seed in range(30):
        codes = neardup_vectors.Codes.of(unit, seed)
        codes = neardup_vectors.Codes.from_rows(codes.rows(), 64)  # as stored
        est, bound = codes.estimates(slice(0, 1), slice(1, None))
        est, bound = est[0], bound[0]
        error.append(est - unit[1:] @ unit[0])
        out += (np.abs(error[-1]) > bound).sum()
    assert abs(np.mean(error)) < 0.01 and out <= 30 * 399 * 0.002


def test_within_finds_every_code_in_the_radius():
    r = np.random.default_rng(2)
    codes = r.integers(0, 2**64, (500, 2), dtype=np.uint64)
    codes[1:200] = codes[0] ^ (np.uint64(1) << r.integers(0, 64, (199, 2)).astype(np.uint64))
    index = nearest.Index(codes, 128)
    far = np.bitwise_count(codes ^ codes[0]).sum(1)
    for radius in (0, 1, 2, 15, 16, 40, 55, 64, 128):
        assert sorted(index.within(codes[0], radius)[0]) == np.flatnonzero(far <= radius).tolist()


def test_nearest(spark, rows):
    found = nearest.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 20 == 0, n_rows=100, n_queries=7).collect()
    live = [(r[0], np.array(r[1], np.float64)) for r in rows if r[0] is not None and ok(r[1])]
    got, hit, total = defaultdict(list), 0, 0
    for r in found:
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    asked = [(i, v) for i, v in live if i % 20 == 0]
    assert set(got) == {i for i, v in asked}
    for q, v in asked:
        best = sorted(((-float(v @ w), i) for i, w in live if i != q and len(w) == len(v)))[:20]
        have = sorted(got[q])
        assert [h[0] for h in have] == list(range(1, len(best) + 1))
        assert [h[1:] for h in have] == sorted((h[1:] for h in have), key=lambda h: (-h[1], h[0]))
        hit, total = hit + len({i for _, i in best} & {h[1] for h in have}), total + len(best)
    assert hit >= 0.9 * total


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (9, 8), (7, 7), (None, 4)] + [(100 + i, 101 + i) for i in range(60)] + [(500, 501 + i) for i in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 551)}
    assert got == want
