"""Substring dedup of a whole table: finds regions, files them to shards, and removes what earlier documents have."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, mix, remove, slices, written
from .passages import WINDOW, earlier_windows, region_names, regions, words_kept

#: Regions of a shard, about.
SHARD = 4_000
#: Distinct regions of an anchor beyond which each window is filed by its own words instead.
HOT = 4 * SHARD
#: Bits of the filter of regions to be indexed, at most (16 MB). What it lets through in vain is true of its document
#: and only makes shards larger.
FILTER_BITS = 1 << 27


def _slot(name: np.ndarray, doc_id: int, n_bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(name ^ mix(np.array([doc_id], np.int64).view(np.uint64))) & np.uint64(n_bits - 1)).astype(np.int64)


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = (), with_text: bool = False, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with n_words, n_removed and kept_sha256, after the columns of ``keep``.

    A word goes where a window of 50 words that covers it also starts in a row of a smaller doc_id; windows are judged
    on the input. ``with_text`` adds ``kept_text``: the text itself where nothing goes, else the words that stay,
    joined by spaces. A null text has no words and stays null. Rows of one doc_id aren't earlier than one another. A
    row with a null doc_id loses nothing and takes nothing from others. An empty table gives no rows.
    """
    return _removed(docs, F.struct("doc_id", *keep), with_text, shard, hot).select("row.*", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []))


def _removed(docs: DataFrame, row: Column, with_text: bool, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_t"), "text", row.alias("row"))

    # 1. The distinct regions of each document.
    def find(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, texts in slices(batch, 2):
                words, cols = Words(texts), ([], [], [], [])
                for i in range(a, b):
                    h = words.hashes[words.at[i - a] : words.at[i - a + 1]]
                    if len(h) >= WINDOW:
                        anchor, first, end = regions(h)
                        name, once = np.unique(region_names(h, first, end), return_index=True)
                        for c, x in zip(cols, (np.full(len(name), ids[i]), np.full(len(name), marks[i]), anchor[once].view(np.int64), name.view(np.int64)), strict=True):
                            c.append(x)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["doc_id", "_t", "anchor", "region"])

    lined = written(slim.where("doc_id is not null and text is not null").select("doc_id", "_t", "text").mapInArrow(find, "doc_id long, _t long, anchor long, region long"), "regions")

    # 2. Regions whose anchor occurs in several documents.
    single = lined.groupBy("anchor", "region").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    anchors = single.groupBy("anchor").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.count("*").alias("n")).where("least < most")
    shared = written(single.select("anchor", "region", "least").join(anchors.select("anchor", "n"), "anchor"), "shared")
    n_shared = shared.count()
    shards = max(1, math.ceil(n_shared / shard))
    hot_rows = shared.where(F.col("n") > hot).select("anchor").distinct().collect()  # at most n_shared / hot
    hot_anchors = np.array(sorted(r[0] for r in hot_rows), np.int64)
    n_bits = 1 << min(FILTER_BITS.bit_length() - 1, max(12, (n_shared * 64).bit_length()))

    def slots(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            with np.errstate(over="ignore"):
                name, doc = (np.asarray(c).astype(np.int64).view(np.uint64) for c in batch.columns)
                at = (mix(name ^ mix(doc)) & np.uint64(n_bits - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bit"])

    filter_ = np.zeros(n_bits // 64, np.int64)
    for r in shared.select("region", "least").mapInArrow(slots, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # one row for each word of the filter
        filter_[r["word"]] = r["bits"]
    sent = spark.sparkContext.broadcast((filter_.view(np.uint64), hot_anchors))

    # 3. Their words, from the first document that has them; windows of hot anchors one by one.
    def take(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hot_ = sent.value
        for batch in found:
            ids = batch.column(0).to_pylist()
            for a, b, texts in slices(batch, 1):
                words, out = Words(texts), []
                for i in range(a, b):
                    h = words.hashes[words.at[i - a] : words.at[i - a + 1]]
                    if len(h) < WINDOW:
                        continue
                    anchor, first, end = regions(h)
                    name = region_names(h, first, end)
                    at = _slot(name, ids[i], n_bits)
                    on = np.flatnonzero(known[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
                    on = on[np.sort(np.unique(name[on], return_index=True)[1])]
                    split = np.isin(anchor[on].view(np.int64), hot_)
                    low = h.astype(np.uint64) >> np.uint64(24)  # 40 bits of a word's hash
                    for j, apart in zip(on.tolist(), split.tolist(), strict=True):
                        f, e = int(first[j]), int(end[j])
                        if not apart:
                            out.append((int(mix(anchor[j : j + 1])[0] % np.uint64(shards)), int(name[j].view(np.int64)), 0, ids[i], low[f : e + WINDOW - 1], int(anchor[j].view(np.int64))))
                            continue
                        own = region_names(h, np.arange(f, e), np.arange(f + 1, e + 1))
                        for w in range(f, e):
                            out.append((int(mix(own[w - f : w - f + 1])[0] % np.uint64(shards)), int(name[j].view(np.int64)), w - f + 1, ids[i], low[w : w + WINDOW], int(own[w - f].view(np.int64))))
                if out:
                    pack = lambda x: x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.int64()), pa.array([pack(o[4]) for o in out], pa.binary()), pa.array([o[5] for o in out], pa.int64())], ["shard", "region", "part", "doc_id", "words", "anchor"])

    filed = slim.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(take, "shard int, region long, part int, doc_id long, words binary, anchor long")

    # 4. Each shard: which windows of a region start in a document before its first.
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = [np.frombuffer(w, np.uint8).reshape(-1, 5) for w in pdf["words"]]
        flat = np.zeros((sum(map(len, raw)), 8), np.uint8)
        flat[:, :5] = np.concatenate(raw)
        words = np.split(flat.view("<u8")[:, 0], np.cumsum([len(r) for r in raw])[:-1])
        doc_ids = pdf["doc_id"].to_numpy(np.int64)
        found = earlier_windows(words, doc_ids, pdf["anchor"].to_numpy(np.int64))
        masks = [np.packbits(f, bitorder="little").tobytes() if f is not None and f.any() else None for f in found]
        return pd.DataFrame({"region": pdf["region"], "part": pdf["part"], "least": doc_ids, "mask": pd.Series(masks, dtype=object)})

    hits = filed.groupBy("shard").applyInPandas(search, "region long, part int, least long, mask binary")
    # What the filter let through in vain is of later documents: the first one's answer holds. Windows that were filed
    # one by one come together again: at most those of one region.
    hits = hits.groupBy("region", "part").agg(F.min("least").alias("least"), F.min_by("mask", "least").alias("mask"))
    one = hits.where("part = 0").select("region", "least", "mask", F.lit(None).cast("array<int>").alias("parts"))
    many = hits.where("part > 0").groupBy("region").agg(F.min("least").alias("least"), F.lit(None).cast("binary").alias("mask"), F.collect_set(F.when(F.col("mask").isNotNull(), F.col("part"))).alias("parts"))
    hits = written(one.union(many) if len(hot_anchors) else one, "hits")

    # 5. What each document loses.
    told = lined.select("doc_id", "_t", "region").join(hits, "region").where("doc_id > least or mask is not null or size(parts) > 0")
    whole = F.col("doc_id") > F.col("least")
    told = told.distinct().groupBy("doc_id", "_t").agg(F.collect_list(F.struct("region", F.when(~whole, F.col("mask")).alias("mask"), F.when(~whole, F.col("parts")).alias("parts"))).alias("told"))
    both = slim.join(told.withColumnRenamed("doc_id", "_d"), (F.col("doc_id") == F.col("_d")) & (slim["_t"] == told["_t"]), "left").select("row", "text", "told")

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts, told_ = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            n, gone, sha, kept = [], [], [], []
            for text, regs in zip(texts, told_, strict=True):
                which = {}
                for r in regs or ():
                    mask = None if r["mask"] is None else np.unpackbits(np.frombuffer(r["mask"], np.uint8), bitorder="little")
                    if r["parts"]:
                        mask = np.zeros(max(r["parts"]), np.uint8)
                        mask[np.array(r["parts"]) - 1] = 1
                    which[r["region"]] = mask
                words, stays = words_kept(text, which)
                left = [w for w, s in zip(words, stays.tolist(), strict=True) if s] if which else words
                joined = b" ".join(left)
                n.append(len(words))
                gone.append(len(words) - len(left))
                sha.append(hashlib.sha256(joined).hexdigest())
                kept.append(text if len(left) == len(words) else joined.decode("utf-8", "surrogatepass"))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(kept, pa.string())] if with_text else [])], ["row", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])])

    schema = both.select("row").schema.add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept_sha256", T.StringType())
    if with_text:
        schema = schema.add("kept_text", T.StringType())
    remove(shared)
    return both.mapInArrow(cut, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, with what stays of their texts. A row that loses every
    word goes; n_chars, where there is such a column, becomes the length of what stays. Null and blank texts, rows with
    a null doc_id, and repeated rows are kept as they are or cut as ``remove_repeats`` says. An empty table gives no rows."""
    found = _removed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), True).where("n_words = 0 or n_removed < n_words")
    own = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("kept_text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return found.select(*[x.alias(c) for c, x in own.items()])
