"""Operator 9: marginals against enumeration, held-out accuracy, odd rows."""

import itertools
from pathlib import Path

import numpy as np
import pytest

from loomline.llm import quality
from loomline.llm.common import table

SF = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    at = np.array([0, 1, 4, 9])
    good, pairs = r.standard_normal(9), r.standard_normal((2, 2))
    got, expected, log_z = quality.forward_backward(good, pairs, at)
    total = np.zeros((2, 2))
    for c, (a, b) in enumerate(zip(at[:-1], at[1:])):
        ways = list(itertools.product((0, 1), repeat=b - a))
        p = np.array([np.exp(sum(good[a + i] * y for i, y in enumerate(w)) + sum(pairs[y, z] for y, z in zip(w, w[1:]))) for w in ways])
        assert log_z[c] == pytest.approx(np.log(p.sum()))
        p /= p.sum()
        for i in range(b - a):
            assert got[a + i] == pytest.approx(sum(q for q, w in zip(p, ways) if w[i]))
        for q, w in zip(p, ways):
            for y, z in zip(w, w[1:]):
                total[y, z] += q
    assert expected == pytest.approx(total)


def test_features_do_not_depend_on_the_batch():
    texts = ["One line.\nTwo  lines, 22!\n\nTwo  lines, 22!", None, "", "ÀÉ 日本 ### ###", "\n"]
    x, length, at = quality.line_features(texts)
    assert np.diff(at).tolist() == [4, 1, 1, 1, 2] and length.sum() == sum(len((t or "").encode()) + 1 for t in texts)
    for i, t in enumerate(texts):
        alone, _, _ = quality.line_features([t])
        assert alone == pytest.approx(x[at[i] : at[i + 1]])


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(60)] + [(None, 1, 0, "x"), (3, None, 0, "x"), (104, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    found = quality.score_quality(odd, quality.train_quality(odd, labels)).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert len({r.score for r in found if r.doc_id in (104, 105, 106)}) == 1
    flat = quality.score_quality(odd, quality.train_quality(odd, labels.limit(0))).collect()
    assert {r.score for r in flat} == {0.5}
    assert quality.score_quality(empty, quality.train_quality(empty, labels)).count() == 0
    assert quality.good_documents(odd, labels).columns == odd.columns


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    found = quality.score_quality(docs, quality.train_quality(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    good = [r for r in found if r.quality == 1]
    assert len(found) > 80 and np.mean([r.predicted == r.quality for r in found]) >= 0.95
    assert np.mean([r.predicted for r in good]) >= 0.97
