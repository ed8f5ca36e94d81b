"""The pipeline, stage by stage, against the brute-force versions of its operators."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from loomline.llm import mixing

from .test_ngram_join import brute as near_brute
from .test_passages import brute as passage_brute


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(9)
    vocab = ["and", "the", "river", "Stone", "walks", "under", "long", "bridges,", "with", "seven", "green", "boats", "while", "others", "sing."]
    text = lambda n: " ".join(r.choice(vocab) + r.choice(["", "", "ly", "s"]) for _ in range(n))
    shared = text(70)
    docs = []
    for i in range(120):
        t = text(r.randint(20, 160))
        if i % 6 == 0:
            t = docs[-1][1] if docs else t
        elif i % 6 == 1:
            t += " " + shared + " " + text(5)
        elif i % 6 == 2:
            t = "$$$ ### %%% " * r.randint(3, 40)
        docs.append((i, t, "en", f"s{i % 4}" if i % 9 else None, len(t)))
    docs += [(200, None, "en", "s0", 0), (201, "", "en", "s1", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 2), 0) for i in range(0, 120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, tables)
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(after, spark.read.parquet(f"{tables}/documents.parquet").schema)
        kept.append((before, after))
    good, near, passages, mixed, packed = kept
    lost = {r.doc_id for r in good[0]} - {r.doc_id for r in good[1]}
    assert {i for i in range(120) if i % 6 == 2} <= lost and not [i for i in lost if i < 120 and i % 6 != 2]
    want = {d for d, n, c in near_brute([(r.doc_id, r.text) for r in near[0]]) if d == c}
    assert {r.doc_id for r in near[1]} == want and len(want) < len(near[0])
    left = {d: (n, gone) for d, n, gone, _ in passage_brute([(r.doc_id, r.text) for r in passages[0]])}
    assert sum(g for _, g in left.values()) > 0
    assert {r.doc_id: len(r.text.split()) for r in passages[1] if r.text} == {d: n - g for d, (n, g) in left.items() if n > g}
    sizes, took = defaultdict(int), defaultdict(int)
    for r in mixed[0]:
        sizes[r.source] += len((r.text or "").split())
    for r in mixed[1]:
        took[r.source] += len(r.text.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s, t in zip(order, mixing.water_fill([sizes[s] for s in order], [1, 2, 3, 1, 2]), strict=True):
        assert abs(took[s] - t) <= 5
    assert max(Counter(r.doc_id for r in mixed[1]).values()) <= 3
    pieces = defaultdict(int)
    for r in packed[1]:
        pieces[r.doc_id, r.doc_tokens] += r.length
    assert Counter({d: n // t for (d, t), n in pieces.items()}) == Counter(r.doc_id for r in mixed[1])


def test_run(spark, tables):
    found = corpus_pipeline.run(spark, tables)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and found.count() > 50


CLASHING = ["doc_id", "text", "source", "n_chars", "n_shingles", "component_id", "n_words", "n_removed", "kept_sha256", "kept_text", "predicted", "score", "held_out", "_copies", "_key", "_copy", "id", "row", "copies", "name", "size", "taken", "target", "label", "a.b"]


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Null doc_ids and texts, repeats, ties, one very long text, and columns with the names that stages use."""
    r = random.Random(4)
    vocab = ["walks", "river", "stone", "under", "seven", "boats", "green", "others", "while", "sing"]
    text = lambda n: " ".join(r.choice(vocab) + r.choice(["", "s", "ed"]) for _ in range(n))
    long = text(60_000)
    rows = [(i, text(60)) for i in range(30)] + [(None, text(60)), (None, None), (40, None), (41, ""), (42, " \n ")] + [(43, text(70))] * 3
    rows += [(50, long), (51, long), (52, text(9) + " " + long)] + [(60 + i, text(50)) for i in range(5)] * 2
    rows = [(d, t, f"s{(d or 0) % 3}" if d != 7 else None, len(t or ""), *(i * 100 + k for k in range(len(CLASHING) - 4))) for i, (d, t) in enumerate(rows)]
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHING[4:])
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 30)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_odd_rows_and_clashing_names(spark, odd_tables):
    docs = spark.read.parquet(f"{odd_tables}/documents.parquet")
    schema = docs.schema
    given = {r["size"]: r for r in docs.collect()}  # tells rows apart
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, odd_tables)
        assert docs.columns == CLASHING, name
        rows = docs.collect()
        assert rows, name
        for x in rows:  # the user's own values, all of one row
            was = given[x["size"]]
            assert [x[c] for c in CLASHING if c not in ("text", "n_chars")] == [was[c] for c in CLASHING if c not in ("text", "n_chars")], name
        docs = spark.createDataFrame(rows, schema).repartition(2)
    assert {r.doc_id for r in rows} >= set(range(30)) - {None}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, odd_tables).count() > 0


def test_empty_tables(spark, odd_tables):
    docs = spark.read.parquet(f"{odd_tables}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, odd_tables).count() == 0, name
