"""Scores texts by a language model: self-attention over subword ids, and words given their subword id by counts.

The chance of a word is that of its class given the classes before it, by the attention model, times that of the word
in its class, by the corpus. The class of a frequent word is the id of its first subword in a public vocabulary (the
most frequent of those ids; others share one class). Rare and unknown words fall in classes by their first byte; there,
as in the base score, a word that training texts lack is one more word of half a count. The score is the log10 chance
of the words of a text and its end.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import TokenCache, Words, mix, remainder, slices, written

#: Frequent words, at most: their table goes to all tasks (about 5 MB).
FREQUENT = 1 << 18
#: Classes: the end of a text, rare words by their first byte, other frequent words, and first subwords.
END, RARE, N_CLASSES = 0, 16, 128
OTHER = 1 + RARE
#: Windows the common starting weights are fitted on; all windows take part after that, in each task.
START = 8192
#: Windows of a group, about: each group goes on from the starting weights, and the groups' weights are averaged. Which
#: windows are a group, and in what order, follows from the windows alone, not from how they are dealt to tasks.
GROUP = 1 << 16
#: Windows trained on at a time, in one round of falling steps.
ROUND = 1 << 13
#: Groups' weights are summed in so many parts before the driver sums those.
PARTS = 16

_FIRST = np.array([zlib.crc32(bytes([b])) % RARE for b in range(256)], np.int64)


def rare_class(words: Words) -> np.ndarray:
    return 1 + _FIRST[words.raw[words.starts]]


class Vocabulary:
    """What tasks get: frequent words in order of their hashes with counts and classes, and the sums of classes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, classes: np.ndarray, sums: np.ndarray, kinds: np.ndarray, n_docs: int):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.classes = hashes[order], counts[order].astype(np.float64), classes[order].astype(np.int16)
        #: Of each class its tokens, and of rare ones its distinct words, in training texts.
        self.sums, self.kinds, self.n_docs = sums, kinds, n_docs
        self.tokens, self.words = float(sums.sum()), int(kinds.sum()) + (n_docs > 0)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each frequent word; -1 of others."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.words + 1)))


def _class_sequences(words: Words, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    found = vocabulary.find(words.hashes)
    classes = rare_class(words)
    on = found >= 0
    classes[on] = vocabulary.classes[found[on]]
    end = np.array([END])
    return found, classes, [np.concatenate([classes[a:b], end]) for a, b in zip(words.at[:-1], words.at[1:], strict=True)]


def _count(slim: DataFrame) -> DataFrame:
    """Training words by hash with count, rare class and the word."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for _, _, texts in slices(batch, 0):
                words = Words(texts, lower=True)
                if not len(words.hashes):
                    continue
                h, once, n = np.unique(words.hashes, return_index=True, return_counts=True)
                raw, begin, stop = words.raw.tobytes(), words.starts[once], words.ends[once]
                text = [raw[s:e] for s, e in zip(begin.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(rare_class(words)[once].astype(np.int32)), pa.array(text, pa.binary())], ["hash", "n", "class", "word"])

    found = slim.select("text").mapInArrow(run, "hash long, n long, class int, word binary")
    counted = written(found.groupBy("hash", "class").agg(F.sum("n").alias("n"), F.max("word").alias("word")), "counts")
    return counted


def learn(slim: DataFrame, tokenizer: str, frequent: int = FREQUENT) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of the training texts (column text), and the counts of the words beyond it."""
    n_docs = slim.count()
    counted = _count(slim)
    # The least count of a frequent word: from how many words have each count.
    by_count = sorted(((r["n"], r["count"]) for r in counted.groupBy("n").count().collect()), reverse=True)
    least, room = 2, frequent  # words that stand once tell what unknown ones are like
    for n, many in by_count:
        if n < 2:
            break
        if many > room:
            least = n + 1
            break
        room -= many

    def first_subwords(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TokenCache.get(tokenizer, True)
        for batch in found:
            words = [" " + w.decode("utf-8", "replace") for w in batch.column(2).to_pylist()]
            ids = [int.from_bytes(got[:4], "little") for got in cache.encode(words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64())], ["hash", "n", "first"])

    # Spellings stay in the tasks: words may be long.
    top = counted.where(F.col("n") >= least).select("hash", "n", "word").mapInArrow(first_subwords, "hash long, n long, first long").toPandas()  # at most ``frequent``
    rare = counted.where(F.col("n") < least)
    first, counts = top["first"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    mass = pd.Series(counts, dtype=np.int64).groupby(first).sum().sort_index().sort_values(ascending=False, kind="stable")
    named = {int(s): OTHER + 1 + i for i, s in enumerate(mass.index[: N_CLASSES - OTHER - 1])}
    classes = np.array([named.get(int(s), OTHER) for s in first], np.int64)
    sums, kinds = np.zeros(N_CLASSES), np.zeros(N_CLASSES)
    np.add.at(sums, classes, counts)
    np.add.at(kinds, classes, 1)
    for r in rare.groupBy("class").agg(F.sum("n").alias("s"), F.count("*").alias("k")).collect():
        sums[r["class"]], kinds[r["class"]] = r["s"], r["k"]
    sums[END] = n_docs
    return Vocabulary(top["hash"].to_numpy(np.int64).view(np.uint64), counts, classes, sums, kinds, n_docs), rare


def fit(slim: DataFrame, vocabulary: Vocabulary, seed: int = 41) -> dict[str, np.ndarray]:
    """Attention weights from all windows of every training text (column text; doc_id tells copies apart): starting
    weights from a bounded number of windows, then each group of windows goes on over all of its own, and the groups'
    weights are averaged by their windows. How rows are dealt to tasks doesn't matter."""
    spark = slim.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for a, b, texts in slices(batch, 0):
                _, _, seqs = _class_sequences(Words(texts, lower=True), sent.value)
                ids = batch.column(1).slice(a, b - a).to_pylist()  # tells copies apart, so that they are dealt to all groups
                names = np.array([zlib.crc32(s.astype(np.int16).tobytes(), zlib.crc32(str(i).encode(), seed)) for s, i in zip(seqs, ids, strict=True)], np.uint64)
                for rows, of, nth in attention.windows(seqs):
                    marks = mix((names[of] << np.uint64(32)) + nth.astype(np.uint64)).view(np.int64)
                    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
                    blobs = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.astype(np.uint8))])
                    yield pa.RecordBatch.from_arrays([pa.array(marks), blobs], ["mark", "window"])

    def targets(blobs: list[bytes]) -> np.ndarray:
        return attention.with_targets(np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1), N_CLASSES)

    prior = np.log((vocabulary.sums + 1) / (vocabulary.sums + 1).sum())
    start = attention.initial(N_CLASSES, prior)
    slim = slim.select("text", F.col("doc_id") if "doc_id" in slim.columns else F.lit(None).cast("long").alias("doc_id"))
    windows = written(slim.mapInArrow(cut, "mark long, window binary"), "windows")
    begin = lambda w, held: attention.train(w, targets(held), 0.01, seed, epochs=4)
    return descend(windows, windows, windows.count, start, begin, lambda w, held: attention.train(w, targets(held), 0.002, seed))


Step = Callable[[dict[str, np.ndarray], list[bytes]], dict[str, np.ndarray]]


def descend(windows: DataFrame, sample: DataFrame, count: Callable[[], int], start: dict[str, np.ndarray], begin: Step, train: Step) -> dict[str, np.ndarray]:
    """``begin`` on a bounded number of windows, then ``train`` over all of ``windows`` (mark, window) in groups, whose
    weights are averaged. There are ``count()`` windows; ``sample`` holds those of the lowest marks at least."""
    spark = windows.sparkSession
    drawn = sample.orderBy("mark", "window").limit(START).collect()  # bounded
    if not drawn and not count():
        return start
    if drawn:
        start = begin(start, [bytes(r["window"]) for r in drawn])
    first = spark.sparkContext.broadcast(start)

    def go_on(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of their groups: the weights that each ends with, and its windows."""
        group, w, n, held = None, None, 0, []

        def step() -> None:
            nonlocal w, n, held
            w, n, held = train(w, held), n + len(held), []

        def close() -> pa.RecordBatch:
            if held:
                step()
            return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([n], pa.int64()), pa.array([attention.pack(w)], pa.binary())], ["g", "n", "w"])

        for batch in found:
            groups = np.asarray(batch.column(0))
            at = 0
            while at < len(groups):
                if groups[at] != group:
                    if group is not None:
                        yield close()
                    group, w, n, held = int(groups[at]), first.value, 0, []
                same = at + int(np.searchsorted(groups[at:] != group, True)) if groups[-1] != group else len(groups)
                end = min(same, at + ROUND - len(held))
                held += batch.column(1).slice(at, end - at).to_pylist()
                at = end
                if len(held) == ROUND:
                    step()
        if group is not None:
            yield close()

    def add(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order: the sums of their parts, each weighted by its windows."""
        part, n, total = None, 0, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "n", "w"])
        for batch in found:
            for p, k, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    if part is not None:
                        yield row()
                    part, n, total = p, 0, 0.0
                n, total = n + k, total + k * np.frombuffer(w, "<f4").astype(np.float64)
        if part is not None:
            yield row()

    groups = max(1, round(count() / GROUP))
    dealt = windows.select(F.pmod("mark", F.lit(groups)).alias("g"), "mark", "window").repartition("g").sortWithinPartitions("g", "mark", "window").select("g", "window")
    ended = dealt.mapInArrow(go_on, "g long, n long, w binary").withColumn("part", F.col("g") % PARTS)
    sums = ended.repartition("part").sortWithinPartitions("part", "g").select("part", "n", "w").mapInArrow(add, "part long, n long, w binary")
    rows = sorted(sums.collect())  # one row for each part
    total = sum(np.frombuffer(r["w"]) for r in rows) / sum(r["n"] for r in rows)
    return attention.unpack(total.astype("<f4").tobytes(), start)


def score_texts(docs: DataFrame, tokenizer: str, folds: int = 5, held_out: int = 1, frequent: int = FREQUENT) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with held_out, n_tokens, n_known, train_tokens, base_score and score.

    A null or blank text is its end alone. A null doc_id counts as the empty text for the fold. Repeated rows are
    scored, and learned from, each. Without training rows every word is unknown. An empty table gives no rows.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder(F.col("doc_id"), folds) == held_out).alias("held_out"))
    training = slim.where(~F.col("held_out")).select("text", "doc_id")
    vocabulary, rare = learn(training, tokenizer, frequent)
    weights = fit(training, vocabulary)
    sent = spark.sparkContext.broadcast((vocabulary, weights))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, w = sent.value
        in_class = np.log10(vocab.counts / vocab.sums[vocab.classes]) if len(vocab.counts) else np.zeros(0)
        base = vocab.base(vocab.counts)
        key = TaskContext.get().partitionId() << 33
        for batch in found:
            for a, b, texts in slices(batch, 1):
                words = Words(texts, lower=True)
                known, classes, seqs = _class_sequences(words, vocab)
                n = np.array([len(s) for s in seqs])
                at = np.concatenate([[0], np.cumsum(n)])
                model = np.add.reduceat(attention.log10_probabilities(w, seqs), at[:-1])
                on = known >= 0
                per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[words.at])
                model += per(np.where(on, in_class[known], 0) if len(in_class) else np.zeros(len(known)))
                plain = per(np.where(on, base[known], 0) if len(base) else np.zeros(len(known))) + vocab.base(np.array(float(vocab.n_docs)))
                n_known = per(on.astype(np.int64)) + (vocab.n_docs > 0)
                # Rare and unknown words wait for their counts: each distinct one of a text, with how often it stands.
                rows = []
                for i in range(b - a):
                    f, e = words.at[i], words.at[i + 1]
                    off = np.flatnonzero(~on[f:e]) + f
                    h, once, many = np.unique(words.hashes[off], return_index=True, return_counts=True)
                    off = off[once]
                    rows.append((h.view(np.int64), many.astype(np.int32), classes[off].astype(np.int32)))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[c] for r in rows]))) for c in range(3)]
                cols = [pa.array(np.arange(key, key + b - a)), batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array(plain), pa.array(model), *lists]
                key += b - a
                yield pa.RecordBatch.from_arrays(cols, ["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "hash", "many", "class"])

    schema = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, hash array<long>, many array<int>, class array<int>"
    scored = written(slim.select("doc_id", "text", "held_out").mapInArrow(run, schema), "scores")
    each = scored.select("key", F.explode(F.arrays_zip("hash", "many", "class")).alias("r")).select("key", "r.hash", "r.many", "r.class")
    found = each.join(rare.select("hash", "n"), "hash", "left")
    # In a rare class: as the base has it in all, half a count more for each word and for what is unknown.
    room = F.element_at(F.lit([float(vocabulary.sums[k] + 0.5 * (vocabulary.kinds[k] + 1)) for k in range(1, 1 + RARE)]).cast("array<double>"), F.col("class"))
    base = F.log10((F.coalesce(F.col("n"), F.lit(0)) + 0.5) / F.lit(vocabulary.tokens + 0.5 * (vocabulary.words + 1)))
    model = F.log10((F.coalesce(F.col("n"), F.lit(0)) + 0.5) / room)
    sums = found.groupBy("key").agg(F.sum(F.col("many") * base).alias("more_base"), F.sum(F.col("many") * model).alias("more_model"), F.sum(F.when(F.col("n").isNotNull(), F.col("many")).otherwise(0)).alias("more_known"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = scored.drop("hash", "many", "class").join(sums, "key", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more_known")).cast("long").alias("n_known"), F.lit(int(vocabulary.tokens)).cast("long").alias("train_tokens"), (F.col("base") + zero("more_base")).alias("base_score"), (F.col("model") + zero("more_model")).alias("score"))
