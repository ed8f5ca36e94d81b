"""A quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. What a line looks like, and what the lines before and after it look like, are its features;
the two weights for staying in a label and leaving it tie neighbours together. Training takes the mark of a document as
the label of its lines. The score of a document is the mean of its lines' forward-backward marginals, weighted by
their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, remainder, slices

#: Labelled documents the field is fitted on, at most; which ones is drawn by a hash.
SAMPLE = 6_000
#: Lines of the sample after which no document is added (250 MB of features).
LINES = 1_000_000
#: Draws the sample.
SEED = 23

_CLASS = np.zeros((8, 256), np.float32)  # upper, lower, digit, other marks, sentence marks, space, beyond ASCII, all
_CLASS[0, 65:91] = _CLASS[1, 97:123] = _CLASS[2, 48:58] = 1
_CLASS[3, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-?"]] = 1
_CLASS[4, [ord(c) for c in ".,;:'\"-?"]] = 1
_CLASS[5, [32, 9, 11, 12, 13]] = 1
_CLASS[6, 128:] = 1
_CODE = np.full(256, 7, np.uint8)
for _k in range(7):
    _CODE[_CLASS[_k] > 0] = _k

FEATURES = ("bias", "short", "long", "upper", "digit", "marks", "sentence", "beyond ASCII", "word length", "long words", "same word", "word seen", "few words", "word marks", "no words", "line seen")
N = len(FEATURES)


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line of each text: features and length; and of each text its range of lines (one at least)."""
    words = Words(texts, lower=True)
    raw = np.frombuffer(b"\n".join((t or "").encode("utf-8", "surrogatepass") for t in texts) + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = ends - starts
    lines = np.array([(t or "").count("\n") + 1 for t in texts])
    at = np.concatenate([[0], np.cumsum(lines)])
    code = _CODE[raw]
    counts = np.stack([np.add.reduceat((code == k).astype(np.int32), starts) for k in (0, 2, 3, 4, 6)])
    size = np.maximum(n, 1)
    # Words of a line; whether each equals the one before it, or occurred in its document.
    first = np.searchsorted(words.starts, starts)
    last = np.searchsorted(words.starts, ends)
    m = last - first
    own = np.maximum(m, 1)
    h, length = words.hashes, words.ends - words.starts
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(words.at))
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.stack([first, last])], axis=0)[0]
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    with np.errstate(over="ignore"):
        key = h ^ doc * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(key, kind="stable")
        seen = np.zeros(len(h))
        seen[order[1:]] = key[order[1:]] == key[order[:-1]]
        # A line that stood before in its document: the sum of its words' hashes says so.
        csum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
        of = np.repeat(np.arange(len(texts), dtype=np.uint64), lines)
        line = (csum[last] - csum[first]) ^ of * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(line, kind="stable")
    again = np.zeros(len(line))
    again[order[1:]] = line[order[1:]] == line[order[:-1]]
    marked = np.add.reduceat((code == 3).astype(np.int32), words.starts) > 0 if len(h) else np.zeros(0)
    out = np.empty((len(n), N), np.float32)
    for k, x in enumerate((1, n < 20, np.log1p(n) / 8, counts[0] / size, counts[1] / size, counts[2] / size, counts[3] / size, counts[4] / size, np.minimum(total(length) / own, 20) / 10, total(length > 14) / own, total(same) / own, total(seen) / own, m < 4, total(marked) / own, m == 0, again * (m > 0))):
        out[:, k] = x
    return out, n + 1.0, at


def with_neighbours(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The features of each line, of the line before and of the line after (zero where there is none)."""
    out = np.zeros((len(x), 3 * N), np.float32)
    out[:, :N] = x
    out[1:, N : 2 * N] = x[:-1]
    out[:-1, 2 * N :] = x[1:]
    out[at[:-1], N : 2 * N] = 0
    out[at[1:] - 1, 2 * N :] = 0
    return out


@dataclass
class Field:
    """Weights of a line being good, and of a pair of neighbours being [[bad bad, bad good], [good bad, good good]]."""

    weights: np.ndarray
    pairs: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def potentials(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((with_neighbours(x, at) - self.mean) / self.scale) @ self.weights


def forward_backward(good: np.ndarray, pairs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of good for each line, expected pairs for each chain, and log partition sums; all chains in step."""
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    begin, most = at[:-1][order], int(n.max(initial=0))
    alive = np.searchsorted(-n[order], -np.arange(most), side="left")  # chains longer than t
    e = np.exp(pairs)
    score = np.stack([np.zeros(len(good)), np.asarray(good, np.float64)], 1)
    top = score.max(1)
    emit = np.exp(score - top[:, None])
    alpha, norm = np.empty((len(good), 2)), np.empty(len(good))
    for t in range(most):
        i = begin[: alive[t]] + t
        a = emit[i] if t == 0 else (alpha[i - 1] @ e) * emit[i]
        s = a.sum(1)
        alpha[i], norm[i] = a / s[:, None], s
    beta = np.ones((len(good), 2))
    expected = np.zeros((2, 2))
    for t in range(most - 2, -1, -1):
        i = begin[: alive[t + 1]] + t
        b = emit[i + 1] * beta[i + 1]
        beta[i] = (b @ e.T) / norm[i + 1][:, None]
        expected += e * (alpha[i].T @ (b / norm[i + 1][:, None]))
    marginal = alpha * beta
    log_z = np.add.reduceat(np.log(norm) + top, at[:-1]) if len(at) > 1 else np.zeros(0)
    return marginal[:, 1] / marginal.sum(1), expected, log_z


def fit(x: np.ndarray, at: np.ndarray, label: np.ndarray, penalty: float = 2.0, steps: int = 100) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam over all chains at once; each document weighs the same."""
    full = with_neighbours(x, at)
    mean, scale = full.mean(0), full.std(0) + 1e-3
    mean[0], scale[0] = 0, 1
    z = ((full - mean) / scale).astype(np.float32)
    y = np.repeat(label, np.diff(at)).astype(np.float64)
    w, pairs = np.zeros(z.shape[1]), np.zeros((2, 2))
    w[0] = np.log((label.sum() + 1) / (len(label) - label.sum() + 1))
    state = [np.zeros(z.shape[1] + 4), np.zeros(z.shape[1] + 4)]
    inside = np.ones(len(y), bool)
    inside[at[:-1]] = False
    prev, cur = y[:-1][inside[1:]].astype(int), y[1:][inside[1:]].astype(int)
    seen = np.bincount(prev * 2 + cur, minlength=4).reshape(2, 2)
    theta = np.concatenate([w, pairs.ravel()])
    for step in range(1, steps + 1):
        got, expected, _ = forward_backward(z @ theta[:-4].astype(np.float32), theta[-4:].reshape(2, 2), at)
        grad = np.concatenate([z.T @ (got - y).astype(np.float32), (expected - seen).ravel()]) / len(label)
        grad += penalty * theta / len(label)
        grad[-4:] += 0.3 * theta[-4:]  # lines of a document all bear its mark; this keeps them from being one decision
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad * grad
        rate = 0.1 * (1 - step / (steps + 1))
        theta = theta - rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:-4].astype(np.float32), theta[-4:].reshape(2, 2), mean.astype(np.float32), scale.astype(np.float32))


def document_scores(field: Field, texts: list[str | None]) -> np.ndarray:
    """Of each text, the chance of a good line, weighted by the lengths of its lines."""
    x, length, at = line_features(texts)
    good, _, _ = forward_backward(field.potentials(x, at), field.pairs, at)
    return np.add.reduceat(good * length, at[:-1]) / np.add.reduceat(length, at[:-1])


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 3, held_out: int = 1, most_lines: int = LINES) -> Field:
    """A field fitted on at most ``sample`` labelled rows outside the held-out fold, and no more of them once they have
    ``most_lines`` lines. Without any, all scores are 0.5.

    Labels with a null doc_id or mark are left out; a doc_id marked twice takes part with each mark.
    """
    usable = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.where(remainder(F.col("doc_id"), folds) != held_out)
    drawn = usable.orderBy(F.xxhash64(F.lit(SEED), "doc_id", "quality"), "doc_id", "quality").limit(sample)  # bounded
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "quality")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for a, b, texts in slices(batch, 1):
                x, _, at = line_features(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([x[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["doc_id", "quality", "x"])

    # One row for each document, until there are enough lines: what the driver holds is bounded whatever texts are like.
    drawn, lines = [], 0
    order = [F.xxhash64(F.lit(SEED), "doc_id", "quality"), "doc_id", "quality", "x"]
    for r in marked.mapInArrow(run, "doc_id long, quality int, x binary").orderBy(*order).limit(sample).toLocalIterator():
        drawn.append(r)
        lines += len(r["x"]) // (4 * N)
        if lines >= most_lines:
            break
    rows = sorted(drawn, key=lambda r: (r[0], r[1], r[2]))
    if not rows:
        return Field(np.zeros(3 * N, np.float32), np.zeros((2, 2)), np.zeros(3 * N, np.float32), np.ones(3 * N, np.float32))
    parts = [np.frombuffer(r[2], np.float32).reshape(-1, N) for r in rows]
    return fit(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.array([r[1] for r in rows], float))


def score_quality(docs: DataFrame, field: Field, folds: int = 3, held_out: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with held_out, score (0 to 1) and predicted, after the columns of ``keep``.

    A null or empty text is one empty line. A null doc_id counts as the empty text for the fold; repeated rows are
    scored each. Nothing but the text bears on the score. No row moves between tasks. An empty table gives no rows.
    """
    return _scored(docs, F.struct("doc_id", *keep), field, folds, held_out).select("row.*", "held_out", "score", "predicted")


def _scored(docs: DataFrame, row: Column, field: Field, folds: int = 3, held_out: int = 1) -> DataFrame:
    slim = docs.select(F.coalesce(remainder(docs["doc_id"], folds), F.lit(0)).eqNullSafe(F.lit(held_out)).alias("held_out"), "text", row.alias("row"))
    schema = slim.select("row", "held_out").schema.add("score", T.DoubleType()).add("predicted", T.IntegerType())

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for a, b, texts in slices(batch, 1):
                score = document_scores(field, texts)
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(a, b - a), batch.column(0).slice(a, b - a), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["row", "held_out", "score", "predicted"])

    return slim.mapInArrow(run, schema)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose score is 0.5 or more: every repeat of a row, rows
    with a null doc_id too. A null or empty text is one empty line. An empty table gives no rows."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return _scored(docs, row, train_quality(docs, labels)).where("predicted = 1").select("row.*")
