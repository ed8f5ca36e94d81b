"""Mixing sources to target weights by fitting each source's budget as a subset sum.

Documents are counted by exact length; whole repeats of a source come first, then each length gives its share of the
rest, whatever that is, but for a reserve as small as will do, and a bounded-knapsack dynamic programme over the counts
that are left closes the remaining budget, nearly always to the word. Which documents of a length are taken is drawn by a seeded hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: Words of budget that the dynamic programme covers; what is beyond goes to the longest documents first.
REACH = 1 << 15
#: Parts of each (source, length) class, by hash, so that no task ranks a large class whole.
PARTS = 1024


def water_fill(sizes: list[int], weights: list[int], share: float = 1.0, most: float = 3.0) -> list[float]:
    """Targets: ``share`` of all sizes by weight, none above ``most`` times its own size; excess is shared again."""
    targets, left, open_ = [0.0] * len(sizes), float(sum(sizes)) * share, list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = most * sizes[i]
        left -= sum(targets[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def _share(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Of each length its share of ``budget``; fractions are carried to the next shorter length, so that the sum is at
    most ``budget`` and less by no more than the longest document."""
    total, take = int((lengths * counts).sum()), np.zeros(len(lengths), np.int64)
    seen, done, budget = 0, 0, min(budget, total)
    for i in np.argsort(-lengths, kind="stable").tolist() if total else ():
        seen += int(counts[i])
        take[i] = seen * budget // total - done
        done += int(take[i])
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, reach: int = REACH) -> np.ndarray:
    """How many documents of each length to take, so that their lengths sum to ``budget`` or as near as found.

    Each length gives its share, but for a reserve that the programme fills; the reserve is as small as will do."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    counts = counts * (lengths > 0)
    best, missed, reserve = take, budget + 1, min(budget, -(-total // int(counts.sum())))
    while missed:
        take = _share(lengths, counts, budget - reserve)
        while True:  # what is still beyond the reserve is shared among the documents that fit in it
            left = budget - reserve - int((lengths * take).sum())
            more = _share(lengths, (counts - take) * (lengths <= left), left)
            if not more.any():
                break
            take += more
        take = _close(lengths, counts, take, budget, reach)
        off = abs(budget - int((lengths * take).sum()))
        if off < missed:
            best, missed = take, off
        if reserve >= min(budget, reach):
            break
        reserve = min(reserve * 2, budget, reach)
    return best


def _close(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, budget: int, reach: int) -> np.ndarray:
    """``take`` and what the programme adds to it."""
    left = budget - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:  # the longest first, down to what the programme covers
        if left <= reach or not lengths[i]:
            break
        n = min(int(counts[i] - take[i]), (left - reach // 2) // int(lengths[i]))
        if n > 0:
            take[i] += n
            left -= n * int(lengths[i])
    # Bounded knapsack: sums reachable so far are the bits of one integer; counts are split in powers of two.
    mask, reached, steps = (1 << (left + 1)) - 1, 1, []
    for i in order[::-1]:
        size, have, k = int(lengths[i]), int(counts[i] - take[i]), 1
        if not size:
            continue
        if size > left:
            break
        have = min(have, left // size)
        while have > 0 and not reached >> left & 1:
            n = min(k, have)
            steps.append((reached, i, n))
            reached |= (reached << (n * size)) & mask
            have, k = have - n, k * 2
        if reached >> left & 1:
            break
    at = reached.bit_length() - 1
    missed = left - at
    for before, i, n in reversed(steps):
        if not before >> at & 1:
            at -= n * int(lengths[i])
            take[i] += n
    if missed:  # one document more, where that comes nearer
        near = [(abs(missed - int(lengths[i])), i) for i in range(len(lengths)) if take[i] < counts[i] and lengths[i]]
        if near and min(near)[0] < missed:
            take[min(near)[1]] += 1
    return take


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 11, keep: tuple[Column, ...] = ()) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source) with size, source_size, target and taken, and what ``keep`` adds.

    Sources in code-point order, null last, get ``weights`` in turn. A null or blank text has size 0 and is taken 0
    times. ``taken`` is a whole multiple of size, at most ``most`` of them. Equal rows differ by no more than one
    repeat. An empty table gives no rows. The driver holds one row for each source. Reruns give the same rows.
    """
    spark = docs.sparkSession
    hashed = F.xxhash64(F.lit(seed), "doc_id", "text")
    slim = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), hashed.alias("_h"), *keep)
    kept = slim.columns[4:]
    slim = written(slim.withColumn("_part", F.pmod("_h", F.lit(PARTS)).cast("int")), "mix")
    parts = slim.groupBy("source", "size", "_part").agg(F.count("*").alias("_n"))
    sums = parts.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("s")).collect()
    sums = sorted(((r[0], r[1]) for r in sums), key=lambda r: (r[0] is None, r[0] or ""))
    sizes, by = [s for _, s in sums], [weights[i % len(weights)] for i in range(len(sums))]
    full = water_fill(sizes, by, share, most)
    # Budgets are whole words; rounding never passes ``most`` times the source, which is whole itself.
    rows = [(n, s, float(t), max(0, math.floor(t + 0.5))) for (n, s), t in zip(sums, full, strict=True)]
    targets = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_rank int, _source string, source_size long, target double, _budget long")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        size, budget = int(pdf["source_size"].iloc[0]), int(pdf["_budget"].iloc[0])
        repeats = budget // size if size else 0
        extra = fit_budget(pdf["size"].to_numpy(), pdf["_n"].to_numpy() * (pdf["size"].to_numpy() > 0), budget - repeats * size)
        return pd.DataFrame({"_rank": pdf["_rank"], "size": pdf["size"], "_repeats": repeats, "_extra": extra})

    ranked = parts.join(targets, parts["source"].eqNullSafe(targets["_source"])).drop("_source", "source")
    classes = ranked.groupBy("_rank", "size", "source_size", "_budget").agg(F.sum("_n").alias("_n"))
    planned = classes.groupBy("_rank").applyInPandas(plan, "_rank int, size long, _repeats long, _extra long")
    before = F.sum("_n").over(Window.partitionBy("_rank", "size").orderBy("_part")) - F.col("_n")
    quota = ranked.withColumn("_before", before).join(planned, ["_rank", "size"])
    quota = quota.select("_rank", "source_size", "target", "_repeats", "size", "_part", F.least(F.greatest(F.col("_extra") - F.col("_before"), F.lit(0)), F.col("_n")).alias("_quota"), "_n")
    names = targets.select("_rank", "_source")
    slim = slim.join(names, slim["source"].eqNullSafe(names["_source"])).drop("_source", "source")
    found = slim.join(quota, ["_rank", "size", "_part"])
    nth = F.row_number().over(Window.partitionBy("_rank", "size", "_part").orderBy("_h", "doc_id"))
    return found.withColumn("_nth", nth).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("_repeats") + (F.col("_nth") <= F.col("_quota")).cast("long"))).cast("long").alias("taken"), *kept)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 11) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, as often as the mix takes them; null and blank texts go.
    Each row is taken on its own account, repeated ones and those with a null doc_id or source too. An empty table gives
    no rows. ``docs`` is written once to the shared folder, so that the numbers of its rows stay."""
    fixed = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("id")), "mixed")
    slim = fixed.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), F.col("row.source").alias("source"), "id")
    taken = mix_sources(slim, weights, share, most, seed, (F.col("id"),)).where("taken > 0").select("id", F.expr("cast(taken div size as int)").alias("copies"))
    return fixed.join(taken, "id").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
