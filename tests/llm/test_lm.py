"""Operator 5: base scores against plain counts, gradients, normalisation, held-out gain."""

import itertools
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from loomline.llm import attention, lm_score
from loomline.llm.common import TokenCache, Words, table
from loomline.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"
BYTE = tokenizer_path("byte_bpe_50k.json")


def brute(rows):
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5
    tokens = [(t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split() + [None] for _, t in rows]
    c = Counter(w for (d, _), t in zip(rows, tokens) if fold(d) != 1 for w in t)
    n, v = sum(c.values()), len(c)
    return sorted(((d, fold(d) == 1, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for (d, _), t in zip(rows, tokens)), key=str)


@pytest.mark.parametrize("frequent", [1 << 18, 5])
def test_base(spark, odd, frequent):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = sorted((tuple(r) for r in lm_score.score_texts(odd, BYTE, frequent=frequent).collect()), key=lambda r: str(r[:5]))
    want = brute(rows)
    assert len(found) == len(want)
    by = lambda rows_: sorted((str(r[:5]), round(r[5], 6)) for r in rows_)
    for a, b in zip(by([f[:6] for f in found]), by(want), strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-6)
    assert all(math.isfinite(f[6]) and f[6] < 0 for f in found)


def test_empty(spark, empty, odd):
    assert lm_score.score_texts(empty, BYTE).count() == 0
    unseen = lm_score.score_texts(odd.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 1"), BYTE).collect()
    assert unseen and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in unseen)


def test_gradients_equal_differences():
    r = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in attention.initial(7, np.zeros(7), width=4, window=6).items()}
    ids, targets = r.integers(0, 8, (3, 6)), r.integers(0, 7, (3, 6))
    targets[1, 4:] = -1
    g, _ = attention.gradients(w, ids, targets)
    for k in w:
        i = tuple(r.integers(0, s) for s in w[k].shape)
        x, e = w[k][i], 1e-5
        w[k][i] = x + e
        up = attention.gradients(w, ids, targets)[1]
        w[k][i] = x - e
        down = attention.gradients(w, ids, targets)[1]
        w[k][i] = x
        assert g[k][i] == pytest.approx((up - down) / 2 / e, rel=1e-3, abs=1e-6), k


def test_chances_sum_to_one_and_windows_score_each_id_once():
    w = attention.initial(5, np.zeros(5), window=4)
    total = sum(10 ** attention.log10_probabilities(w, [np.array(t)])[:3].sum() for t in itertools.product(range(5), repeat=3))
    assert total == pytest.approx(1, abs=1e-4)
    long = np.random.default_rng(0).integers(0, 5, 23)
    both = attention.log10_probabilities(w, [long, long[:0], long[:7]])
    assert both[23:] == pytest.approx(both[:6].tolist() + [attention.log10_probabilities(w, [long[:7]])[6]], abs=1e-5)
    assert (both < 0).all() and len(both) == 30


def test_classes_depend_on_words_alone(spark):
    # Each word stands once in each batch of more than 20,000 distinct words; one is longer than 40 bytes.
    words = [f"{a}{b}{c}q" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
    words.append("river" * 9)
    docs = spark.createDataFrame([(" ".join(words),), (" ".join(words[::-1]),)], "text string")
    few = spark.createDataFrame([(" ".join(words[i : i + 5000]),) for i in range(0, len(words), 5000)] * 2, "text string")
    found = [lm_score.learn(d, BYTE)[0] for d in (docs.repartition(2), docs.coalesce(1), few.repartition(7))]
    assert len(found[0].hashes) == len(words) > 20_000
    for v in found[1:]:
        assert (v.hashes == found[0].hashes).all() and (v.classes == found[0].classes).all()
    cache = TokenCache.get(BYTE, True)
    first = {w: cache.encode([" " + w])[0][:4] for w in words}
    many = Counter(first.values())
    most = sorted(many.values(), reverse=True)[lm_score.N_CLASSES - lm_score.OTHER - 1 :]
    hashes = Words([" ".join(words)]).hashes
    classes = dict(zip(words, found[0].classes[found[0].find(hashes)].tolist(), strict=True))
    assert all(classes[w] > lm_score.OTHER for w in words if not most or many[first[w]] > most[0])
    assert len({(first[w], classes[w]) for w in words}) == len(many)


def test_every_id_of_a_training_text_is_a_target_once():
    r = np.random.default_rng(4)
    texts = [r.integers(0, 128, n) for n in (1, 15, 16, 17, 31, 32, 33, 48, 49, 500)]
    blocks = list(attention.windows(texts, block=7))
    rows, of, nth = (np.concatenate(x) for x in zip(*blocks, strict=True))
    both = attention.with_targets(rows.astype(np.uint8), 128)
    before, targets = both[:, :32], both[:, 32:]
    for i, t in enumerate(texts):
        own = targets[of == i]
        assert own[own >= 0].tolist() == t.tolist() and nth[of == i].tolist() == list(range(len(own)))
        assert before[of == i][own >= 0].tolist() == [128, *t[:-1].tolist()]


def test_training_takes_all_windows(spark, monkeypatch):
    r = random.Random(3)
    text = " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(3000))
    docs = spark.createDataFrame([(text,), ("alpha beta",), (None,)], "text string")
    vocabulary, _ = lm_score.learn(docs, BYTE)
    kept, write = {}, lm_score.written
    monkeypatch.setattr(lm_score, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    lm_score.fit(docs, vocabulary)
    rows = np.stack([np.frombuffer(r["window"], np.uint8) for r in kept["windows"].collect()])
    assert (attention.with_targets(rows, lm_score.N_CLASSES)[:, attention.WINDOW :] >= 0).sum() == 3000 + 1 + 2 + 1 + 1


def plain_score(w, vocabulary, text):
    """The chance of a text, id by id: each in the window that shows most before it."""
    words = Words([text], lower=True)
    found, classes, (seq,) = lm_score._class_sequences(words, vocabulary)
    begin, total = len(w["ids"]) - 1, 0.0
    for i, target in enumerate(seq.tolist()):
        first = max(0, (i - 8) // 24 * 24)
        before = [begin, *seq.tolist()][first : i + 1]
        x = w["ids"][before].astype(float) + w["places"][: len(before)]
        q, k, v = x @ w["q"], x @ w["k"], x @ w["v"]
        h = np.zeros(16)
        e = np.exp(k @ q[-1] / 4)
        h = x[-1] + (e / e.sum()) @ v @ w["o"]
        h = h + np.maximum(h @ w["up"] + w["up_bias"], 0) @ w["down"]
        z = np.exp(h @ w["out"] + w["out_bias"])
        total += math.log10(z[target] / z.sum())
    for f, c in zip(found.tolist(), classes.tolist()):
        total += math.log10(vocabulary.counts[f] / vocabulary.sums[c] if f >= 0 else 0.5 / (vocabulary.sums[c] + 0.5 * (vocabulary.kinds[c] + 1)))
    return total


def test_scores_equal_plain_ones_however_rows_are_dealt(spark):
    r = random.Random(6)
    vocab = ["river", "stone", "walks", "under", "bridges", "seven", "green", "boats", "others", "sing"]
    docs = [(i, " ".join(r.choice(vocab[: 3 + i % 7]) for _ in range(r.choice([0, 1, 7, 8, 9, 31, 33, 60, 200])))) for i in range(80)]
    docs += [(100, docs[20][1]), (101, "river unseenword Stone")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    scores = [sorted((x.doc_id, x.score) for x in lm_score.score_texts(d, BYTE).collect()) for d in (df.coalesce(1), df.repartition(16))]
    assert [s for _, s in scores[0]] == pytest.approx([s for _, s in scores[1]], rel=1e-6)
    training = df.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1")
    vocabulary, _ = lm_score.learn(training.select("text", "doc_id"), BYTE)
    w = lm_score.fit(training.select("text", "doc_id"), vocabulary)
    assert [s for _, s in scores[0]] == pytest.approx([plain_score(w, vocabulary, t) for _, t in sorted(docs)], rel=1e-4)


def test_groups_do_not_depend_on_batches(spark, monkeypatch):
    r = random.Random(7)
    df = spark.createDataFrame([(i, " ".join(r.choice(["a", "b", "cc", "dd"]) for _ in range(400))) for i in range(30)], "doc_id long, text string")
    monkeypatch.setattr(lm_score, "GROUP", 100)
    monkeypatch.setattr(lm_score, "ROUND", 37)
    vocabulary, _ = lm_score.learn(df, BYTE)
    monkeypatch.setattr(lm_score, "START", 64)
    one = lm_score.fit(df.select("text", "doc_id").coalesce(1), vocabulary)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    two = lm_score.fit(df.select("text", "doc_id").repartition(7), vocabulary)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all((one[k] == two[k]).all() for k in one)


def test_masked():
    w = attention.initial(9, np.zeros(9))
    a = np.random.default_rng(0).integers(0, 9, (1, 20))
    b = a.copy()
    b[0, 12:] = 0
    assert np.allclose(attention.forward(w, a)[0][0, :12], attention.forward(w, b)[0][0, :12], atol=1e-6)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_held_out_gain(spark):
    found = lm_score.score_texts(table(spark, SF, "documents"), BYTE).where("held_out").collect()
    n = sum(r.n_tokens for r in found)
    assert found and sum(r.score for r in found) / n > sum(r.base_score for r in found) / n
