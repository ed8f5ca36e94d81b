"""Operators 1, 3, 4 and 10 against plain Python and round trips."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import mixing, packing, sharding, tokenids
from loomline.llm.common import TokenCache, Words, hash_spans
from loomline.llm.queries import tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def plain(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("path,spaced", [(BYTE, True), (WORD, False)])
def test_cache_equals_plain_encoding(path, spaced):
    r = random.Random(1)
    texts = ["".join(r.choice("ab 1.\n\t é　\x1c'sŚ 日<|>") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    alphabet = ["a", "Ab", "é", "e\u0301", "ΑΣ", "Σ", "ß", "İ", "²", "½", "7", "_", ".", "%%%", "'", "'s", "'re", " ", "  ", "\n", "\n\n", "\n\n\n", "\t", "\x1c", "\x85", "　", "\u0301", "日本", "<|endoftext|>", "\x00", "🙂", "ﬁ", "Å"]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) for _ in range(6000)]
    texts += ["", " ", "  ", " a", "a ", "a  b", "\n a", "<|endoftext|> x <|endoftext|>", "don't  stop\n\n now"]
    assert [np.frombuffer(b, "<u4").tolist() for b in TokenCache(path, spaced, 50).encode(texts)] == plain(path, texts)


def test_words_are_hashed_wherever_they_stand():
    w = Words(["b a\tb", None, "", "a\x0bB \x1c"], lower=True)
    assert np.diff(w.at).tolist() == [3, 0, 0, 3]
    h = w.hashes.tolist()
    assert h[0] == h[2] == h[4] and h[1] == h[3] and len(set(h)) == 3
    assert hash_spans(w.raw, w.starts, w.ends, 2).tolist() == h
    assert len(hash_spans(np.zeros(0, np.uint8), np.zeros(0, int), np.zeros(0, int))) == 0


def test_codes_give_any_id():
    r = np.random.default_rng(2)
    for top in (3, 300, 70_000, 2**24 + 9):
        ids = r.integers(0, top, 3000).astype(np.uint32)
        code = tokenids.Codes.from_bytes(tokenids.Codes.encode(ids, [4, None], [0, 9, 3000]).to_bytes())
        assert code.ids().tolist() == ids.tolist()
        assert [code[i] for i in range(0, 3000, 7)] == ids[::7].tolist()


def test_token_ids(odd, empty):
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(tokenids.encode_documents(odd, BYTE).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, _ in rows]
    at = 0
    for r, ids in zip(got, plain(BYTE, [t for _, t in rows]), strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) + 1, crc([*ids, 0]))
        at += len(ids) + 1
    assert tokenids.encode_documents(empty, BYTE).count() == 0


def test_packing(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = Counter((d, crc([*ids, 1]), len(ids) + 1) for (d, _), ids in zip(rows, plain(WORD, [t for _, t in rows]), strict=True))
    for capacity in (2048, 100, 64):
        found = packing.pack_documents(odd, WORD, capacity, batch_windows=8).collect()
        seqs = defaultdict(list)
        for r in found:
            seqs[r.sequence_id].append(r)
        for s in seqs.values():
            s.sort(key=lambda r: r.offset)
            assert [r.offset for r in s] == np.cumsum([0] + [r.length for r in s])[:-1].tolist()
            n = sum(r.length for r in s)
            assert n == capacity or n < capacity and not n & (n - 1)
        assert sum(r.length for r in found) == sum(k[2] * v for k, v in want.items())
        by = defaultdict(set)
        for r in found:
            by[r.doc_id, r.doc_tokens].add((r.start, r.length))
        for (d, n), pieces in by.items():
            covered = Counter(t for a, k in pieces for t in (a, a + k))
            assert {0, n} <= set(covered), d
    whole = [r for r in packing.pack_documents(odd, WORD).collect() if r.length == r.doc_tokens]
    assert whole and all((r.doc_id, r.ids_crc32, r.length) in want for r in whole)
    assert packing.pack_documents(empty, WORD).count() == 0


def test_differencing_is_near_equal():
    r = random.Random(3)
    sizes = [r.randint(1, 400) for _ in range(300)]
    found = packing.difference(sizes, 16)
    sums = [sum(sizes[i] for i in w) for w in found]
    assert sorted(i for w in found for i in w) == list(range(300)) and max(sums) - min(sums) <= 2
    assert packing.difference([], 3) == [[], [], []] and packing.windows([], 10) == []
    assert all(sum(sizes[i] for i in w) <= 500 for w in packing.windows(sizes, 500))


def test_budgets_are_met():
    r = random.Random(4)
    for _ in range(200):
        lengths = sorted(r.sample(range(1, 60), r.randint(1, 12)))
        counts = [r.randint(1, 5) for _ in lengths]
        total = sum(a * b for a, b in zip(lengths, counts, strict=True))
        budget, reached = r.randint(0, total), {0}
        for a, b in zip(lengths, counts, strict=True):
            reached = {s + a * k for s in reached for k in range(b + 1)}
        take = mixing.fit_budget(np.array(lengths), np.array(counts), budget)
        assert (take >= 0).all() and (take <= counts).all()
        got = int((take * np.array(lengths)).sum())
        assert abs(got - budget) == min(abs(s - budget) for s in reached) or budget not in reached and abs(got - budget) <= max(lengths)
        far = mixing.fit_budget(np.array(lengths), np.array(counts) * 1000, budget * 1000)
        assert abs(int((far * np.array(lengths)).sum()) - budget * 1000) <= max(lengths)
    assert mixing.water_fill([10, 10, 80], [1, 2, 3]) == pytest.approx([17.5, 30, 52.5])
    assert mixing.water_fill([0, 5], [1, 2]) == [0, 5] and mixing.water_fill([], []) == []


@pytest.mark.parametrize("many", [1, 20])
@pytest.mark.parametrize("budget", [4_000, 32_000, 32_768, 33_500, 400_000])
def test_each_length_gives_its_share_at_every_budget(many, budget):
    lengths = np.arange(20, 2000)
    take = mixing.fit_budget(lengths, np.full(len(lengths), many), budget)
    assert int((take * lengths).sum()) == budget and (take >= 0).all() and (take <= many).all()
    thirds = [int((take * lengths)[(lengths >= a) & (lengths < b)].sum()) for a, b in ((20, 1155), (1155, 1633), (1633, 2000))]
    assert all(abs(t - budget / 3) <= 2500 for t in thirds), thirds  # each a third of all words


def test_mixing(odd, empty):
    import re

    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in odd.collect()]
    found = mixing.mix_sources(odd).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((d, n) for d, _, n in rows)
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip([sizes[s] for s in order], mixing.water_fill([sizes[s] for s in order], [1, 2, 3, 1][: len(order)]), strict=True))
    taken = defaultdict(int)
    for r in found:
        assert r.target == pytest.approx(target[r.source_size])
        assert r.taken <= 3 * r.size and (not r.taken or r.taken % r.size == 0)
        taken[r.source_size] += r.taken
    got = {s: (taken[sizes[s]], target[sizes[s]]) for s in sizes if s != "c"}  # c is one document
    assert all(abs(a - t) <= 30 for a, t in got.values()), got  # a source may lack documents as small as what is left
    assert Counter(map(tuple, mixing.mix_sources(odd).collect())) == Counter(map(tuple, found))
    assert mixing.mix_sources(empty).count() == 0


def test_sharding(odd, empty):
    rows = [(r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in odd.collect()]
    found = sharding.shard_documents(odd, 7).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == Counter(rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == set(range(7)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shard_documents(empty).count() == 0


def test_written_shards(spark, odd, empty, tmp_path):
    sharding.write_shards(odd.drop("shard"), f"{tmp_path}/a", 4)
    back = spark.read.parquet(f"{tmp_path}/a")
    assert set(back.columns) == {*odd.columns, "slot"} and back.count() == odd.count()
    assert Counter(r.doc_id for r in back.collect()) == Counter(r.doc_id for r in odd.collect())
    sharding.write_shards(odd, f"{tmp_path}/b", 4)  # which has a column shard
    back = spark.read.parquet(f"{tmp_path}/b")
    assert {r.shard for r in back.collect()} == {r.shard for r in odd.collect()} and {r._shard for r in back.collect()} == {0, 1, 2, 3}
    assert sharding.exact_shards(empty, F.col("doc_id")).count() == 0


def test_matrix_has_its_margins():
    m = sharding.communication_matrix([5, 0, 12, 3], [7, 7, 6], 1)
    assert m.sum(1).tolist() == [5, 0, 12, 3] and m.sum(0).tolist() == [7, 7, 6]
    rng = np.random.default_rng(1)
    draws = [sharding._hypergeometric(rng, 2 * 10**9, 4 * 10**9, 300) for _ in range(400)]
    assert abs(np.mean(draws) - 100) < 2 and 5 < np.std(draws) < 11
