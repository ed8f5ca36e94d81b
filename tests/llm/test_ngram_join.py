"""Operator 6 against brute force."""

import random

import numpy as np
import pytest

from loomline.llm import ngram_join


def brute(rows):
    def shingles(text):
        w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = [shingles(t) if d is not None else set() for d, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(shingles(t)), least.get(find(i))) for i, (d, t) in enumerate(rows)), key=str)


def family(r):
    """Texts around all sizes, with edits that bring pairs near the threshold on both sides."""
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for n in [*range(1, 40), 60, 61, 80, 120, 200, 333, 500, 501, 900, 1500]:
        base = [r.choice(vocab) for _ in range(n)]
        out.append(base)
        for _ in range(6):
            w = list(base)
            for _ in range(r.randint(0, max(1, n // 35))):
                i = r.randrange(len(w))
                kind = r.random()
                if kind < 0.4:
                    w[i] = r.choice(vocab)
                elif kind < 0.7:
                    w.insert(i, r.choice(vocab))
                elif len(w) > 1:
                    del w[i]
            out.append(w)
        cut = max(1, n * r.randint(78, 100) // 100)
        out += [base[:cut], base + base[: n // 9]]
    return [" ".join(w) for w in out]


def test_components(spark, odd, empty):
    r = random.Random(6)
    rows = [(i * 3 % 1009, t) for i, t in enumerate(family(r))]
    rows += [(r.doc_id, r.text) for r in odd.collect()] + [(2000 + i, rows[50][1].upper()) for i in range(30)]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, name int").repartition(5)
    found = ngram_join.near_documents(df).collect()
    want = brute(rows)
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in found), key=str) == want
    assert len({w[2] for w in want}) < len(want) / 2
    assert ngram_join.near_documents(empty).count() == 0
    left = ngram_join.first_of_each(df)
    assert left.columns == df.columns
    got = sorted((x.doc_id for x in left.collect()), key=str)
    assert got == sorted([d for d in {w[0] for w in want if w[1]} if d is not None and any(w[0] == w[2] == d and w[1] for w in want)] + [w[0] for w in want if not w[1] or w[0] is None], key=str)


def test_signatures_of_linked_sets_meet():
    r = np.random.default_rng(3)
    rarity = r.integers(0, 5, 64).astype(np.uint8)
    for n in [*range(1, 60), 100, 150, 333, 700, 3000]:
        for _ in range(20):
            x = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
            out = r.integers(0, n // 5 + 1)
            add = r.integers(0, max(0, (len(x) - out) * 5 // 4 - len(x)) + 1) if (len(x) - out) * 5 // 4 > len(x) else 0
            y = np.unique(np.concatenate([r.permutation(x)[out:], r.integers(0, 2**64, add, dtype=np.uint64)]))
            if len(y) and 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)):
                for levels in (None, rarity):
                    assert len(np.intersect1d(ngram_join.signatures(x, levels), ngram_join.signatures(y, levels))), (n, out, add)


def test_plan_of_sizes():
    assert 4 <= ngram_join.light_bound() <= 16
    for n in range(1, 400):
        assert ngram_join.prefix_length(n) == n - -(-4 * n // 5) + 1
        for b, k in ngram_join.subsets(n):  # what a set of b and one of n that link have in common at least
            assert all(5 * c < 4 * (n + b - c) for c in range(k)) or k == ngram_join.least_common(ngram_join.smallest_partner(b), b)


@pytest.mark.parametrize("star,chunk,names", [(3, 5, 0), (4000, 2000, 1 << 20)])
def test_a_family_that_no_single_set_links(spark, monkeypatch, star, chunk, names):
    """A chain of texts, each near the next but not to those further on, and many that share a passage only."""
    monkeypatch.setattr(ngram_join, "NAMES", names)
    r = random.Random(8)
    base = [f"c{i}" for i in range(400)]
    texts = [" ".join(base[12 * i : 12 * i + 160]) for i in range(20)]
    shared = [f"s{i}" for i in range(90)]
    texts += [" ".join(shared + [f"u{j}x{i}" for i in range(r.choice([8, 9, 10, 14]))]) for j in range(60)]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.near_documents(df, star=star, chunk=chunk).collect()), key=str)
    want = brute(rows)
    assert found == want and len({w[2] for w in want}) < 75


def test_bitmaps_rule_out_no_link():
    r, out = np.random.default_rng(4), 0
    for n in [*range(1, 30), 100, 500, 1000, 1024, 1030, 2040, 5000]:
        for _ in range(10):
            x = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
            y = np.unique(np.concatenate([x[r.integers(0, n // 4 + 1) :], r.integers(0, 2**64, r.integers(0, n // 4 + 1), dtype=np.uint64)]))
            if len(y):
                fits = len(ngram_join.Bitmaps([ngram_join.parities(v).tobytes() for v in (x, y)], np.array([len(x), len(y)])).partners(0))
                common = len(np.intersect1d(x, y))
                assert fits or 5 * common < 4 * (len(x) + len(y) - common)
                out += not fits
    assert out > 20
    sets = [np.unique(r.integers(0, 2**64, n, dtype=np.uint64)) for n in (10, 900, 1020, 1030, 2000, 4000, 4500)]
    maps = ngram_join.Bitmaps([ngram_join.parities(v).tobytes() for v in sets], np.array([len(v) for v in sets]))
    assert not any(len(maps.partners(i)) for i in range(7))  # sets that have nothing in common, large ones too


def test_clashing_names(spark, empty):
    names = ["doc_id", "text", "n_shingles", "component_id", "name", "row", "id", "members", "least", "a.b"]
    rows = [(i, "one two three four five six " + str(i // 2), *range(8)) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in names[2:]))
    left = ngram_join.first_of_each(df)
    assert left.columns == names and sorted(map(tuple, left.collect())) == rows[::2]
    assert ngram_join.first_of_each(df.limit(0)).count() == 0
