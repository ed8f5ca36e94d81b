"""Scores texts by a language model: self-attention over all subword ids of a text.

The lower-cased words of a text, each after a space, are written as ids of a public vocabulary; an end follows. Each id
and the end has its chance given the ids before it, by the attention model, and the score is the log10 of their product.
The output is a tree of two levels: the most frequent ids have columns of their own, all others lie in groups by
frequency, which have a column each, and a softmax over the ids of the group follows. So every id's chance depends on
what stands before it, and the chances of all ids of the vocabulary add up to one. Ids that the training texts hold at
most once share one symbol, and what it gets by their counts and half a count more.
"""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention, lm_score
from .common import TokenCache, Words, mix, remainder, slices, written

#: Symbols: the end of a text, ids that training texts hold at most once, then the others by falling counts.
END, NEW, NAMED = 0, 1, 2
#: Ids with an output of their own, and those of the first groups; sizes of groups double after every second.
HEAD, GROUP = 80, 32
#: Bytes of the longest words whose ids a worker keeps: of 2^18 frequent words it holds at most 32 MB.
KEPT = 32


class Symbols:
    """The symbols of a vocabulary's ids, from the ids that training texts hold with their counts."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, n_ids: int, n_docs: int):
        seen = np.zeros(n_ids, np.int64)
        seen[ids] = counts
        often = np.flatnonzero(seen >= 2)
        ranked = often[np.argsort(-seen[often], kind="stable")]
        self.of = np.full(n_ids, NEW, np.int32)
        self.of[ranked] = NAMED + np.arange(len(ranked))
        new = self.of == NEW
        #: log10 of the chance of an id within its symbol.
        self.within = np.where(new, np.log10((seen + 0.5) / max((seen[new] + 0.5).sum(), 0.5)), 0.0)
        self.counts = np.concatenate([[n_docs, seen[new].sum()], seen[ranked]])
        self.n = len(self.counts)
        self.head, at, size, self.groups = min(self.n, NAMED + HEAD), 0, GROUP, []
        while at < self.n - self.head:
            #: Ranges of symbols, counted from the first that has no output of its own.
            self.groups.append((at, min(at + size, self.n - self.head)))
            at, size = at + size, size * (1 + (len(self.groups) % 2 == 0))
        #: The output that each symbol begins with: its own, or that of its group.
        self.column = np.concatenate([np.arange(self.head), np.repeat(self.head + np.arange(len(self.groups)), [e - f for f, e in self.groups])]).astype(np.uint16)
        #: How symbols are kept; the largest value means none.
        self.kind = np.uint16 if self.n < (1 << 16) - 1 else np.uint32


def initial(symbols: Symbols, **sizes: int) -> dict[str, np.ndarray]:
    """Random weights; the outputs start as the symbols' own frequencies."""
    w = attention.initial(symbols.n, np.zeros(symbols.n), **sizes)
    n = symbols.head + len(symbols.groups)
    totals = np.bincount(symbols.column, symbols.counts, n) + 1
    w["tail"] = w["out"][:, symbols.head :].T.copy()
    w["tail_bias"] = np.log(symbols.counts[symbols.head :] + 1).astype(np.float32)
    for f, e in symbols.groups:
        w["tail_bias"][f:e] -= w["tail_bias"][f:e].mean()
    w["out"], w["out_bias"] = w["out"][:, :n].copy(), np.log(totals / totals.sum()).astype(np.float32)
    return w


def _head(own: np.ndarray, out: np.ndarray, at: np.ndarray, g: np.ndarray | None, block: int = 4 * attention.ROWS) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural logarithms of the chances of outputs ``at``, one for each row of ``own``, among all rows of ``out``
    (both end with the bias's column). ``g`` takes their gradients; the second result is that of ``own``."""
    chance, back = np.empty(len(own)), None if g is None else np.empty((len(own), own.shape[1] - 1), own.dtype)
    turned, ones = np.ascontiguousarray(out.T), np.ones(len(out), own.dtype)
    for a in range(0, len(own), block):
        y = own[a : a + block]
        p = attention.times(y, turned)
        index = np.arange(0, p.size, len(out)) + at[a : a + block]
        z = p.take(index)
        with np.errstate(over="ignore"):
            np.exp(p, out=p)
            total = p @ ones
        if not attention.in_range(total):
            p = attention.times(y, turned)
            p -= p.max(1, keepdims=True)
            z = p.take(index)
            np.exp(p, out=p)
            total = p @ ones
        chance[a : a + block] = z - np.log(total.astype(np.float64))
        if g is not None:  # divided by the sums only where arrays are narrow
            p.ravel()[index] -= total
            part = (1 / total)[:, None]
            g += attention.sums(p, y * part)
            np.multiply(attention.times(p, out[:, :-1]), part, out=back[a : a + block])
    return chance, back


def _within(y: np.ndarray, tail: np.ndarray, spans: list[tuple[int, int, int, int]], at: np.ndarray, g: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """As ``_head``, for rows a to b of ``y`` among rows f to e of ``tail``, for each (f, e, a, b) of ``spans``; ``at``
    counts from f. What needs no product is done for all of them at once."""
    width = np.repeat([e - f for f, e, _, _ in spans], [b - a for _, _, a, b in spans])
    start = np.cumsum(width) - width
    p, parts, n = np.empty(int(width.sum()), y.dtype), [], 0
    for f, e, a, b in spans:
        parts.append(p[n : n + (b - a) * (e - f)].reshape(b - a, e - f))
        n += parts[-1].size

    def logits() -> None:
        for (f, e, a, b), part in zip(spans, parts, strict=True):
            np.matmul(y[a:b], tail[f:e].T, out=part)

    logits()
    index = start + at
    z = p.take(index)
    with np.errstate(over="ignore"):
        np.exp(p, out=p)
        total = np.add.reduceat(p, start)
    if not attention.in_range(total):
        logits()
        p -= np.repeat(np.maximum.reduceat(p, start), width)
        z = p.take(index)
        np.exp(p, out=p)
        total = np.add.reduceat(p, start)
    chance = z - np.log(total.astype(np.float64))
    if g is None:
        return chance, None
    p[index] -= total
    share = (1 / total)[:, None]
    mine, back = y * share, np.empty((len(y), y.shape[1] - 1), y.dtype)
    for (f, e, a, b), part in zip(spans, parts, strict=True):
        np.matmul(part.T, mine[a:b], out=g[f:e])
        np.matmul(part, tail[f:e, :-1], out=back[a:b])
    back *= share
    return chance, back


def output(w: dict[str, np.ndarray], symbols: Symbols, own: np.ndarray, targets: np.ndarray, g: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """log10 of the chances of ``targets`` from hidden states. With ``g``, its outputs' arrays take the gradients of
    the sum of natural logarithms, negated, and the second result is that of the hidden states."""
    own = np.concatenate([own, np.ones((len(own), 1), own.dtype)], 1)
    out, tail = np.column_stack([w["out"].T, w["out_bias"]]), np.column_stack([w["tail"], w["tail_bias"]])
    g_out, g_tail = (None, None) if g is None else (np.zeros_like(out), np.zeros_like(tail))
    column = symbols.column.take(targets)
    chance, back = _head(own, out, column, g_out)
    late = np.flatnonzero(column >= symbols.head)
    if len(late):
        late = late[np.argsort(column[late], kind="stable")]
        bounds = np.searchsorted(column[late], np.arange(symbols.head, symbols.head + len(symbols.groups) + 1).astype(column.dtype)).tolist()
        spans = [(f, e, a, b) for (f, e), a, b in zip(symbols.groups, bounds, bounds[1:]) if a < b]
        firsts = np.repeat([f for f, _, _, _ in spans], [b - a for _, _, a, b in spans])
        more, more_back = _within(own.take(late, 0), tail, spans, targets[late] - symbols.head - firsts, g_tail)
        chance[late] += more
        if g is not None:
            back[late] += more_back
    if g is not None:
        g["out"][...], g["out_bias"][...] = g_out[:, :-1].T, g_out[:, -1]
        g["tail"][...], g["tail_bias"][...] = g_tail[:, :-1], g_tail[:, -1]
    return chance / np.log(10), back


def gradients(w: dict[str, np.ndarray], symbols: Symbols, before: np.ndarray, targets: np.ndarray, g: dict[str, np.ndarray]) -> tuple[int, float]:
    """Into ``g``, of the summed loss over targets of 0 and more; their number and that loss."""
    parts, d = [], w["ids"].shape[1]
    for of, skip, stop in _split(targets):
        ids, t = before[of, :stop], targets[of, skip:stop].ravel()
        y, s = attention.forward(w, ids, skip)
        parts.append((ids, s, y, np.flatnonzero(t >= 0), t))
    held = [len(rows) for _, _, _, rows, _ in parts]
    own, t = (np.concatenate(x) for x in zip(*((y.reshape(-1, d).take(rows, 0), t[rows]) for _, _, y, rows, t in parts), strict=True))
    chance, back = output(w, symbols, own, t, g)
    found = []
    for (ids, s, y, rows, _), at in zip(parts, np.cumsum(held) - held, strict=True):
        dy = np.zeros_like(y)
        dy.reshape(-1, d)[rows] = back[at : at + len(rows)]
        found.append(attention.back(w, ids, s, dy))
    for k in found[0]:
        g[k][...] = found[0][k]
        for x in found[1:]:
            g[k] += x[k]
    return len(t), float(-chance.sum() * np.log(10))


def _split(targets: np.ndarray) -> list[tuple[np.ndarray | slice, int, int]]:
    """Windows with the places whose hidden states they need: of most, those after what they share with the window
    before; of windows that have targets there, these places too, which nothing after them bears on."""
    n = targets.shape[1]
    shared = n // attention.SHARED
    first = np.flatnonzero((targets[:, :shared] >= 0).any(1))
    if 4 * len(first) > len(targets):
        return [(slice(None), 0, n)]
    return [(slice(None), shared, n)] + ([(first, 0, shared)] if len(first) else [])


def _views(like: dict[str, np.ndarray], flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _keep_memory() -> None:
    """Has the C library keep up to 64 MB of freed memory, rather than take the pages of each array anew."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


def train(w: dict[str, np.ndarray], symbols: Symbols, windows: np.ndarray, rate: float, seed: int, batch: int = 128, epochs: int = 1) -> dict[str, np.ndarray]:
    """Adam over ``windows``, as ``attention.train``, on all weights in one array."""
    _keep_memory()
    flat = np.concatenate([w[k].ravel() for k in sorted(w)])
    slope, m, v, x = (np.zeros_like(flat) for _ in range(4))
    w, g = _views(w, flat), _views(w, slope)
    order_, step, n = np.random.default_rng(seed), 0, windows.shape[1] // 2
    total = max(1, epochs * -(-len(windows) // batch))
    for _ in range(epochs):
        order = order_.permutation(len(windows))
        for at in range(0, len(order), batch):
            part = windows[order[at : at + batch]].astype(np.int64)
            found, _ = gradients(w, symbols, part[:, :n], part[:, n:], g)
            slope *= 1 / max(1, found)
            step += 1
            scale = rate * min(1.0, step / 20) * (1 - 0.9 * step / total) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            # Sums of slopes and squares in place of means, ten and a hundred times these, which cancel out.
            m *= 0.9
            m += slope
            v *= 0.99
            np.multiply(slope, slope, out=x)
            v += x
            np.sqrt(v, out=x)
            x += 1e-7
            np.divide(m, x, out=x)
            x *= flat.dtype.type(scale)
            flat -= x
    return {k: x.copy() for k, x in w.items()}


class Spellings:
    """The ids of words, each after a space. Those of frequent words are kept by their numbers in the vocabulary, so
    that a worker spells each once; other words and long ones are spelled once for each call."""

    def __init__(self, n: int):
        self.begin, self.size, self.kept = np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int64), np.zeros(0, np.uint32)

    @classmethod
    def of(cls, vocabulary: lm_score.Vocabulary) -> Spellings:
        """One for each vocabulary that a Python worker holds."""
        if not hasattr(vocabulary, "spellings"):
            vocabulary.spellings = cls(len(vocabulary.hashes))
        return vocabulary.spellings

    def spell(self, words: Words, known: np.ndarray, cache: TokenCache) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another; and where those of each begin, and the end. ``known``: the numbers
        of frequent words, -1 of others."""
        raw, known = words.raw.tobytes(), np.where(words.ends - words.starts <= KEPT, known, -1)

        def encode(on: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """``after`` with the ids of these words; where each begins, and how many it has."""
            named = [raw[s:e].decode("utf-8", "replace") for s, e in zip(words.starts[on].tolist(), words.ends[on].tolist(), strict=True)]
            odd = [i for i, w in enumerate(named) if not (w.isascii() and w.isprintable())]  # all others are one piece
            found = [cache.after_space[w] if w.isascii() and w.isprintable() else b"" for w in named]
            for i, ids in zip(odd, cache.encode([" " + named[i] for i in odd]), strict=True):
                found[i] = ids
            size = np.array([len(x) // 4 for x in found], np.int64)
            return np.concatenate([after, np.frombuffer(b"".join(found), "<u4")]), len(after) + np.cumsum(size) - size, size

        fresh = np.flatnonzero((known >= 0) & (self.size[known] < 0))
        if len(fresh):
            names, once = np.unique(known[fresh], return_index=True)
            self.kept, self.begin[names], self.size[names] = encode(fresh[once], self.kept)
        flat, begin, size, rest = self.kept, self.begin[known], self.size[known], np.flatnonzero(known < 0)
        if len(rest):
            _, once, which = np.unique(words.hashes[rest], return_index=True, return_inverse=True)
            flat, at, many = encode(rest[once], flat)
            begin[rest], size[rest] = at[which], many[which]
        at = np.concatenate([[0], np.cumsum(size)])
        return flat[np.repeat(begin - at[:-1], size) + np.arange(at[-1])], at


def _binary(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """Ranges of an array as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * flat.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _sequences(texts: list[bytes], symbols: Symbols, kind: type) -> tuple[np.ndarray, list[np.ndarray]]:
    """The ids of texts one after another, and each text's symbols with the end."""
    ids, end = np.frombuffer(b"".join(texts), kind), np.array([END], np.int32)
    at = np.cumsum([0] + [len(t) // np.dtype(kind).itemsize for t in texts])
    found = symbols.of[ids]
    return ids, [np.concatenate([found[a:b], end]) for a, b in zip(at[:-1], at[1:], strict=True)]


def spell(slim: DataFrame, vocabulary: lm_score.Vocabulary, tokenizer: str, kind: type) -> DataFrame:
    """Of each text its ids, the base score of its end and frequent words, and its other words by hash."""
    sent = slim.sparkSession.sparkContext.broadcast(vocabulary)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, cache = sent.value, TokenCache.get(tokenizer, True)
        spellings = Spellings.of(vocab)
        base = vocab.base(vocab.counts)
        key = TaskContext.get().partitionId() << 33
        for batch in found:
            for a, b, texts in slices(batch, 1):
                words = Words(texts, lower=True)
                known = vocab.find(words.hashes)
                on = known >= 0
                per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[words.at])
                plain = per(np.where(on, base[known], 0) if len(base) else np.zeros(len(known))) + vocab.base(np.array(float(vocab.n_docs)))
                n_known = per(on.astype(np.int64)) + (vocab.n_docs > 0)
                ids, at = spellings.spell(words, known, cache)
                rows = [np.unique(words.hashes[f:e][~on[f:e]], return_counts=True) for f, e in zip(words.at[:-1], words.at[1:], strict=True)]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[c] for r in rows]).view(np.int64).astype(t))) for c, t in ((0, np.int64), (1, np.int32))]
                cols = [pa.array(np.arange(key, key + b - a)), batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.diff(words.at) + 1, pa.int64()), pa.array(n_known, pa.int64()), pa.array(plain), _binary(ids.astype(kind), at[words.at]), *lists]
                key += b - a
                yield pa.RecordBatch.from_arrays(cols, ["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "ids", "hash", "many"])

    schema = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, ids binary, hash array<long>, many array<int>"
    return written(slim.select("doc_id", "text", "held_out").mapInArrow(run, schema), "ids")


def learn(training: DataFrame, n_ids: int, kind: type) -> tuple[Symbols, int]:
    """The symbols of the ids of training texts (column ids), and how many windows these texts have."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, windows, docs = np.zeros(n_ids, np.int64), 0, 0
        for batch in found:
            for a, b, texts in slices(batch, 0):
                n += np.bincount(np.frombuffer(b"".join(texts), kind), minlength=n_ids)
                windows += sum(len(attention.cut_windows(len(t) // np.dtype(kind).itemsize + 1)) for t in texts)
                docs += b - a
        on = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([on, [-1, -2]])), pa.array(np.concatenate([n[on], [windows, docs]]))], ["id", "n"])

    rows = {r["id"]: r["n"] for r in training.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}  # at most the vocabulary
    windows, docs = rows.pop(-1, 0), rows.pop(-2, 0)
    return Symbols(np.array(sorted(rows), np.int64), np.array([rows[i] for i in sorted(rows)], np.int64), n_ids, docs), windows


def fit(training: DataFrame, symbols: Symbols, n_windows: int, kind: type, seed: int = 41) -> dict[str, np.ndarray]:
    """Attention weights from all windows of the ids of every training text (columns ids, doc_id), as ``lm_score.fit``:
    starting weights from a bounded number of windows, then groups of windows, whose weights are averaged."""
    sent = training.sparkSession.sparkContext.broadcast(symbols)

    def cut(below: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Windows with marks up to ``below``."""

        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in found:
                for a, b, texts in slices(batch, 0):
                    _, seqs = _sequences(texts, sent.value, kind)
                    ids = batch.column(1).slice(a, b - a).to_pylist()  # tells copies apart, so that they are dealt to all groups
                    names = np.array([zlib.crc32(t, zlib.crc32(str(i).encode(), seed)) for t, i in zip(texts, ids, strict=True)], np.uint64)
                    for rows, of, nth in attention.windows(seqs, kind=np.int32):
                        marks = mix((names[of] << np.uint64(32)) + nth.astype(np.uint64)).view(np.int64)
                        on = np.flatnonzero(marks <= below)
                        yield pa.RecordBatch.from_arrays([pa.array(marks[on]), _binary(rows[on].astype(sent.value.kind).ravel(), np.arange(len(on) + 1) * rows.shape[1])], ["mark", "window"])

        return run

    def targets(blobs: list[bytes]) -> np.ndarray:
        return attention.with_targets(np.frombuffer(b"".join(blobs), sent.value.kind).reshape(len(blobs), -1), sent.value.n)

    begin = lambda w, held: train(w, sent.value, targets(held), 0.01, seed, batch=64, epochs=4)
    step = lambda w, held: train(w, sent.value, targets(held), 0.01, seed)
    all_of = lambda below: training.select("ids", "doc_id").mapInArrow(cut(below), "mark long, window binary")
    top = (1 << 63) - 1
    # Twice as many as the starting weights take, as marks are even.
    below = min(top, int(2 * lm_score.START / max(1, n_windows) * 2.0**64) - (1 << 63))
    return lm_score.descend(all_of(top), all_of(below), lambda: n_windows, initial(symbols), begin, step)


def score_texts(docs: DataFrame, tokenizer: str, folds: int = 5, held_out: int = 1, frequent: int = lm_score.FREQUENT) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with held_out, n_tokens, n_known, train_tokens, base_score and score.

    A null or blank text is its end alone. A null doc_id counts as the empty text for the fold. Repeated rows are
    scored, and learned from, each. Without training rows every id is new. An empty table gives no rows.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder(F.col("doc_id"), folds) == held_out).alias("held_out"))
    vocabulary, rare = lm_score.learn(slim.where(~F.col("held_out")).select("text", "doc_id"), tokenizer, frequent)
    n_ids = max(TokenCache.get(tokenizer, True).tokenizer.get_vocab().values()) + 1
    kind = np.uint16 if n_ids <= 1 << 16 else np.uint32
    texts = spell(slim, vocabulary, tokenizer, kind)
    training = texts.where(~F.col("held_out"))
    symbols, n_windows = learn(training, n_ids, kind)
    sent = spark.sparkContext.broadcast((symbols, fit(training, symbols, n_windows, kind)))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        names, w = sent.value
        for batch in found:
            for a, b, blobs in slices(batch, 6):
                ids, seqs = _sequences(blobs, names, kind)
                at = np.cumsum([0] + [len(s) for s in seqs])
                model = np.add.reduceat(attention.log10_probabilities(w, seqs, output=lambda w, own, t: output(w, names, own, t)[0]), at[:-1])
                model += np.diff(np.concatenate([[0], np.cumsum(names.within[ids])])[at - np.arange(len(at))])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:6]), pa.array(model)], ["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    schema = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    scored = written(texts.select("key", "doc_id", "held_out", "n_tokens", "n_known", "base", "ids").mapInArrow(run, schema), "scores")
    # Words beyond the frequent ones wait for their counts: each distinct one of a text, with how often it stands.
    each = texts.select("key", F.explode(F.arrays_zip("hash", "many")).alias("r")).select("key", "r.hash", "r.many")
    base = F.log10((F.coalesce(F.col("n"), F.lit(0)) + 0.5) / F.lit(vocabulary.tokens + 0.5 * (vocabulary.words + 1)))
    sums = each.join(rare.select("hash", "n"), "hash", "left").groupBy("key").agg(F.sum(F.col("many") * base).alias("more_base"), F.sum(F.when(F.col("n").isNotNull(), F.col("many")).otherwise(0)).alias("more_known"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = scored.join(sums, "key", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more_known")).cast("long").alias("n_known"), F.lit(int(vocabulary.tokens)).cast("long").alias("train_tokens"), (F.col("base") + zero("more_base")).alias("base_score"), "score")
