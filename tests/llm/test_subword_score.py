"""Operator 5 over all subword ids: base scores, chances of every id, gradients, dealing, held-out gain."""

import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomline.llm import attention, lm_score, queries, subword_score
from loomline.llm.common import TokenCache, Words, table
from loomline.llm.queries import tokenizer_path
from tests.llm.test_lm import brute

SF = "/root/testdata/sf0.01"
BYTE = tokenizer_path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(BYTE)
TOKENIZER.encode_special_tokens = True


def lower_words(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()


def ids_of(text):
    return TOKENIZER.encode("".join(" " + w.decode() for w in lower_words(text)), add_special_tokens=False).ids


def symbols_of(n, n_ids):
    """Symbols with ``n`` ids of falling counts, out of ``n_ids``; every seventh stands once."""
    ids = np.random.default_rng(2).permutation(n_ids)[:n]
    return subword_score.Symbols(np.sort(ids), np.where(np.arange(n) % 7 == 0, 1, 5 + np.arange(n)), n_ids, 9)


def test_later_subwords_follow_what_stands_before(spark, tmp_path):
    # Two words of one first subword and one count; only the ids after it tell which of them follows which.
    a, b = ids_of("zorblex"), ids_of("zorbnap")
    assert a[0] == b[0] and a != b
    r = random.Random(1)
    rows = [(i, " ".join(f"{x} zorb{'lex' if x == 'red' else 'nap'}" for x in r.sample(["red", "blue"] * 20, 40))) for i in range(400)]
    tests = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows += [(tests[0], "red zorblex blue zorbnap"), (tests[1], "red zorbnap blue zorblex")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {x.doc_id: x for x in queries.op5_lm_score(spark, str(tmp_path)).collect()}
    right, wrong = (found[t] for t in tests)
    assert right.base_score == pytest.approx(wrong.base_score)
    assert right.score > wrong.score + 1


@pytest.mark.parametrize("frequent", [1 << 18, 5])
def test_base(spark, odd, frequent):
    found = sorted((tuple(r) for r in subword_score.score_texts(odd, BYTE, frequent=frequent).collect()), key=lambda r: str(r[:5]))
    by = lambda rows: sorted((str(r[:5]), round(r[5], 6)) for r in rows)
    for x, y in zip(by(found), by(brute([(r.doc_id, r.text) for r in odd.collect()])), strict=True):
        assert x[0] == y[0] and x[1] == pytest.approx(y[1], rel=1e-6)
    assert all(math.isfinite(f[6]) and f[6] < 0 for f in found)


def test_empty(spark, empty, odd):
    assert subword_score.score_texts(empty, BYTE).count() == 0
    unseen = subword_score.score_texts(odd.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 1"), BYTE).collect()
    assert unseen and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in unseen)


@pytest.mark.parametrize("n", [0, 40, 300])
def test_chances_of_all_ids_and_the_end_sum_to_one(n):
    symbols = symbols_of(n, 400)
    w = subword_score.initial(symbols, window=4)
    y = np.random.default_rng(0).standard_normal((3, 16)).astype(np.float32)
    for own in y:
        chance, _ = subword_score.output(w, symbols, np.repeat(own[None], symbols.n, 0), np.arange(symbols.n))
        of_ids = 10 ** (chance[symbols.of] + symbols.within)
        assert of_ids.sum() + 10 ** chance[subword_score.END] == pytest.approx(1, abs=1e-4) and (of_ids > 0).all()


def test_gradients_equal_differences():
    r = np.random.default_rng(1)
    symbols = symbols_of(300, 400)
    w = {k: v.astype(np.float64) for k, v in subword_score.initial(symbols, width=4, window=6).items()}
    before, targets = r.integers(0, symbols.n + 1, (9, 6)), r.integers(0, symbols.n, (9, 6))
    targets[1, 4:] = -1
    g, other = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    assert subword_score.gradients(w, symbols, before, targets, g)[0] == 52
    for k in w:
        for i in [tuple(r.integers(0, s) for s in w[k].shape), np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)]:
            x, e = w[k][i], 1e-5
            w[k][i] = x + e
            up = subword_score.gradients(w, symbols, before, targets, other)[1]
            w[k][i] = x - e
            down = subword_score.gradients(w, symbols, before, targets, other)[1]
            w[k][i] = x
            assert g[k][i] == pytest.approx((up - down) / 2 / e, rel=1e-3, abs=1e-5), k


def plain_score(w, symbols, text):
    """The chance of a text, id by id: each in the window that shows most before it, against all ids."""
    ids, total = ids_of(text), 0.0
    seq = [*symbols.of[ids].tolist(), subword_score.END]
    for i, target in enumerate(seq):
        before = [symbols.n, *seq][max(0, (i - 8) // 24 * 24) : i + 1]
        x = w["ids"][before].astype(float) + w["places"][: len(before)]
        e = np.exp(x @ w["k"] @ (x[-1] @ w["q"]) / 4)
        h = x[-1] + (e / e.sum()) @ (x @ w["v"]) @ w["o"]
        h = h + np.maximum(h @ w["up"] + w["up_bias"], 0) @ w["down"]
        z = np.exp(h @ w["out"] + w["out_bias"])
        chance = z[: symbols.head] / z.sum()
        for k, (f, stop) in enumerate(symbols.groups):
            own = np.exp(w["tail"][f:stop] @ h + w["tail_bias"][f:stop])
            chance = np.concatenate([chance, z[symbols.head + k] / z.sum() * own / own.sum()])
        total += math.log10(chance[target])
    return total + symbols.within[ids].sum()


def test_scores_equal_plain_ones_however_rows_are_dealt(spark, monkeypatch):
    r = random.Random(6)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz'-é") for _ in range(r.randint(1, 9))) for _ in range(300)]
    docs = [(i, " ".join(r.choice(vocab[: 3 + i * 4]) for _ in range(r.choice([0, 1, 7, 8, 9, 31, 33, 60, 200])))) for i in range(80)]
    docs += [(100, docs[20][1]), (101, "River unseenword\n\n Stone x 日本"), (102, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept, fit = [], subword_score.fit
    monkeypatch.setattr(subword_score, "fit", lambda training, symbols, *rest: kept.append((fit(training, symbols, *rest), symbols)) or kept[-1][0])
    scores = [sorted((x.doc_id, x.score) for x in subword_score.score_texts(d, BYTE).collect()) for d in (df.coalesce(1), df.repartition(16))]
    assert [s for _, s in scores[0]] == pytest.approx([s for _, s in scores[1]], rel=1e-6)
    w, symbols = kept[0]
    assert len(symbols.groups) > 2
    assert [s for _, s in scores[0]] == pytest.approx([plain_score(w, symbols, t) for _, t in sorted(docs)], rel=1e-4)


def test_training_takes_every_id_and_groups_do_not_depend_on_batches(spark, monkeypatch):
    r = random.Random(7)
    docs = [(i, " ".join(r.choice(["zorblex", "b", "unbelievably", "dd"]) for _ in range(300))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(lm_score, "GROUP", 100)
    monkeypatch.setattr(lm_score, "ROUND", 37)
    monkeypatch.setattr(lm_score, "START", 64)
    vocabulary, _ = lm_score.learn(df, BYTE)
    found, seen, descend = [], [], lm_score.descend

    def count(windows, sample, n, *rest):
        rows = np.stack([np.frombuffer(x["window"], np.uint16) for x in windows.collect()])
        seen.append((len(rows), n(), int((attention.with_targets(rows, 60_000)[:, attention.WINDOW :] >= 0).sum())))
        return descend(windows, sample, n, *rest)

    monkeypatch.setattr(lm_score, "descend", count)
    for d, size in ((df.coalesce(1), "10000"), (df.repartition(7), "11")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        texts = subword_score.spell(d.selectExpr("doc_id", "text", "false as held_out"), vocabulary, BYTE, np.uint16)
        found.append(subword_score.fit(texts, *subword_score.learn(texts, 50_257, np.uint16), np.uint16))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all((found[0][k] == found[1][k]).all() for k in found[0])
    assert all(n == windows and ids == sum(len(ids_of(t)) + 1 for _, t in docs) for windows, n, ids in seen)


def test_frequent_words_are_spelled_once(monkeypatch):
    long = "river" * 9
    texts = [f"river naïve stone\u00a0x rare1 river! {long}", f"stone\u00a0x RIVER rare2 \x1c\x1cz {long} naïve rare1", None]
    words = Words(texts, lower=True)
    frequent = np.unique(np.concatenate([words.hashes[: words.at[1]][[0, 1, 2]], Words(["river!", long]).hashes]))
    vocabulary = lm_score.Vocabulary(frequent, np.ones(5), np.zeros(5), np.ones(1), np.ones(1), 1)
    cache, made = TokenCache(BYTE, True), []
    one = cache.after_space
    monkeypatch.setattr(cache, "after_space", type("", (), {"__getitem__": lambda self, w: made.append(w) or one[w]})())
    monkeypatch.setattr(cache, "encode", lambda t: made.extend(x[1:] for x in t) or [np.asarray(TOKENIZER.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in t])
    spellings = subword_score.Spellings.of(vocabulary)
    assert spellings is subword_score.Spellings.of(vocabulary)
    for again in (["river", "naïve", "stone\u00a0x", "river!"], []):
        made.clear()
        ids, at = spellings.spell(words, vocabulary.find(words.hashes), cache)
        assert [ids[a:b].tolist() for a, b in zip(at[words.at[:-1]], at[words.at[1:]])] == [ids_of(t) for t in texts]
        assert set(made) == {*again, "rare1", "rare2", "\x1c\x1cz", long}


def test_what_windows_share_is_context_alone(monkeypatch):
    r = np.random.default_rng(5)
    symbols = symbols_of(300, 400)
    w = subword_score.initial(symbols)
    texts = [r.integers(0, symbols.n, n) for n in (400, 250, 31, 300, 700)]
    both = attention.with_targets(np.concatenate([x for x, _, _ in attention.windows(texts)]).astype(np.uint16), symbols.n)
    before, targets = both[:, :32], both[:, 32:]
    assert np.allclose(attention.forward(w, before, 8)[0], attention.forward(w, before)[0][:, 8:], atol=1e-5)
    places, forward = [], attention.forward
    monkeypatch.setattr(attention, "forward", lambda w, ids, skip=0: places.append(len(ids) * (ids.shape[1] - skip)) or forward(w, ids, skip))
    g, whole = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    n, loss = subword_score.gradients(w, symbols, before, targets, g)
    assert sum(places) == 24 * len(before) + 8 * len(texts)
    monkeypatch.setattr(subword_score, "_split", lambda t: [(slice(None), 0, 32)])
    assert subword_score.gradients(w, symbols, before, targets, whole) == (n, pytest.approx(loss, rel=1e-5))
    assert n == sum(map(len, texts)) and sum(places) == (24 + 32) * len(before) + 8 * len(texts)
    for k in w:
        assert np.allclose(g[k], whole[k], rtol=1e-3, atol=1e-3), k


def test_logits_out_of_range():
    symbols = symbols_of(300, 400)
    w = subword_score.initial(symbols)
    own = (np.random.default_rng(8).standard_normal((symbols.n, 16)) * 200).astype(np.float32)
    t = np.arange(symbols.n)
    z = own.astype(float) @ w["out"] + w["out_bias"]
    log = lambda z: z - z.max(-1, keepdims=True) - np.log(np.exp(z - z.max(-1, keepdims=True)).sum(-1, keepdims=True))
    want = log(z)[t, symbols.column]
    for i in t[symbols.head :]:
        f, e = symbols.groups[symbols.column[i] - symbols.head]
        want[i] += log(w["tail"][f:e] @ own[i].astype(float) + w["tail_bias"][f:e])[i - symbols.head - f]
    g = {k: np.zeros_like(v) for k, v in w.items()}
    chance, back = subword_score.output(w, symbols, own, t, g)
    assert chance == pytest.approx(want / np.log(10), rel=1e-3, abs=1e-2) and np.isfinite(back).all() and all(np.isfinite(x).all() for x in g.values())
    # What stands later would have the largest weight by far; it is masked.
    w["ids"][7] *= 400
    ids = np.array([[1, 2, 3, 7]])
    with np.errstate(all="raise", under="ignore"):
        y, s = attention.forward(w, ids)
    assert np.isfinite(y).all() and np.allclose(y[:, :3], attention.forward(w, ids[:, :3])[0], atol=1e-4)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_held_out_gain(spark):
    # Against the plain counts of the same ids, with half a count more for each of the vocabulary.
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    counts = np.full(50_257, 0.5) + np.bincount([i for r in rows if not held(r.doc_id) for i in ids_of(r.text)], minlength=50_257)
    plain = np.log10(counts / counts.sum())
    want = sum(plain[ids_of(r.text)].sum() for r in rows if held(r.doc_id))
    found = subword_score.score_texts(table(spark, SF, "documents"), BYTE).where("held_out").collect()
    assert found and sum(r.score for r in found) > 0.8 * want
