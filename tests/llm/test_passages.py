"""Operator 2 against brute force; the index against plain searches."""

import hashlib
import random

import numpy as np
import pytest

from loomline.llm import passage_dedup, passages


def brute(rows):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        if d is not None:
            for i in range(len(w) - 49):
                k = tuple(w[i : i + 50])
                first[k] = min(d, first.get(k, d))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows(odd):
    r = random.Random(2)
    vocab = [f"v{i}" for i in range(300)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    shared = [text(n) for n in (49, 50, 51, 60, 75, 130, 400)]
    out = []
    for i in range(150):
        w = text(r.choice([0, 10, 48, 60, 200]))
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, max(0, len(s) - 50))
            w[(p := r.randint(0, len(w))) : p] = s[a : a + r.randint(40, 200)]
        if r.random() < 0.2:
            w += ["same"] * r.randint(40, 160)
        if r.random() < 0.2:
            w = [x for x in w if r.random() > 0.01] + w
        out.append((i * 7 % 151, r.choice([" ", "\n"]).join(w)))
    out += [out[3], (out[3][0], out[9][1]), (None, out[5][1]), (300, out[5][1]), (301, out[5][1] + " more")]
    return out + [(x.doc_id, x.text) for x in odd.collect()]


@pytest.mark.parametrize("shard,hot", [(4000, 16000), (7, 3)])
def test_removal(spark, rows, shard, hot):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, region int, row string").repartition(5)
    found = passage_dedup.remove_repeats(df, shard=shard, hot=hot).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)
    if shard == 4000:
        left = passage_dedup.without_repeats(df)
        assert left.columns == df.columns
        assert sorted((x.doc_id for x in left.collect()), key=str) == sorted((b[0] for b in brute(rows) if not b[1] or b[2] < b[1]), key=str)


def test_what_the_filter_lets_through_does_no_harm(spark, rows, monkeypatch):
    monkeypatch.setattr(passage_dedup, "FILTER_BITS", 256)  # nearly everything passes
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (16000, 3):
        assert sorted(map(tuple, passage_dedup.remove_repeats(df, hot=hot).collect()), key=str) == brute(rows)


def test_empty(empty):
    assert passage_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("letters", [4, 30])
def test_index_against_plain_search(letters):
    r = np.random.default_rng(4)
    held = [r.integers(0, letters, r.integers(1, 60)).astype(np.uint64) for _ in range(40)]
    index = passages.FMIndex(held, np.arange(40), depth=6)
    asked = [r.integers(0, letters + 2, r.integers(1, 50)).astype(np.uint64) for _ in range(30)] + held[:3]
    length, low, high = index.matching_statistics(asked)
    least = index.least_numbers()
    texts, at = [w.tolist() for w in held], 0
    for w in asked:
        w = w.tolist()
        for i in range(len(w)):
            n = 0
            where = None
            for k in range(1, min(6, len(w) - i) + 1):
                hits = [d for d, t in enumerate(texts) for j in range(len(t) - k + 1) if t[j : j + k] == w[i : i + k]]
                if not hits:
                    break
                n, where = k, hits
            assert length[at + i] == n
            if n:
                assert high[at + i] - low[at + i] == len(where)
                assert sorted(index.numbers[low[at + i] : high[at + i]]) == where
            if n == 6:
                assert least[low[at + i]] == min(where)
        at += len(w)


def test_the_index_tells_what_repeats():
    """Of the streamed words most match nothing in the index; what does is found, with the least doc_id that has it."""
    r = np.random.default_rng(6)
    text = lambda n: r.integers(0, 2**40, n).astype(np.uint64)
    shared, near = text(60), text(49)
    words = [np.concatenate([text(200), shared, text(30)]), np.concatenate([text(90), shared[3:58], text(400)]), np.concatenate([text(300), near, text(80)]), np.concatenate([text(20), near, text(500)]), text(120)]
    docs, anchors = np.array([4, 9, 5, 8, 7]), np.array([1, 1, 2, 2, 3])
    found = passages.earlier_windows(words, docs, anchors)
    assert [f is None for f in found] == [True, False, True, False, True]  # the first of its anchor has nothing earlier
    assert np.flatnonzero(found[1]).tolist() == list(range(90, 96)) and not found[3].any()
    index = passages.FMIndex([words[0], words[2]], docs[[0, 2]])
    length, _, _ = index.matching_statistics([words[1], words[3]])
    assert (length == 0).mean() > 0.8 and (length == passages.WINDOW).sum() == 6
    assert length[90 : 90 + 55].tolist() == [min(50, n) for n in range(55, 0, -1)]


def test_regions_cover_all_windows_alike():
    r = np.random.default_rng(5)
    h = r.integers(0, 2**64, 500, dtype=np.uint64)
    a, f, e = passages.regions(h)
    assert f[0] == 0 and e[-1] == 451 and (f[1:] == e[:-1]).all()
    b, g, _ = passages.regions(h[100:400])
    assert set(b[1:-1]) <= set(a)
    full = passages.region_names(h, f, e)
    shifted = passages.region_names(np.concatenate([h[:7], h]), f + 7, e + 7)
    assert (full == shifted).all()
