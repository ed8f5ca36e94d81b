"""Sharding by a hypergeometric communication matrix: a uniform shuffle into shards of exact sizes.

Every input partition learns how many of its rows go to each shard (one row of the matrix, drawn exactly from the
multivariate hypergeometric distribution), permutes its rows and cuts them accordingly; rows are exchanged and each
shard permutes what it got. Which rows share a text, or how large they are, plays no part, so hot groups need no care.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a shard that one task permutes.
BLOCK = 20_000


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """An exact draw; beyond numpy's limit by inversion, outwards from the mode."""
    if not n or not good:
        return 0
    if not bad:
        return n
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    log = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    top = math.exp(log(good, mode) + log(bad, n - mode) - log(good + bad, n))
    u, up, down, i, j = rng.random() - top, top, top, mode, mode
    while u > 0 and (i < high or j > low):
        if i < high:
            up *= (good - i) * (n - i) / ((i + 1) * (bad - n + i + 1))
            i += 1
            u -= up
            if u <= 0:
                return i
        if j > low:
            down *= j * (bad - n + j) / ((good - j + 1) * (n - j + 1))
            j -= 1
            u -= down
            if u <= 0:
                return j
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """How many rows each partition (a row, of ``counts`` rows) sends to each shard (a column, of ``sizes`` rows)."""
    rng = np.random.default_rng(seed)
    left, out = [int(s) for s in sizes], np.zeros((len(counts), len(sizes)), np.int64)
    if sum(left) < 10**9:
        left = np.array(left, np.int64)
        for i, n in enumerate(counts):
            out[i] = rng.multivariate_hypergeometric(left, int(n), method="marginals")
            left -= out[i]
        return out
    for i, n in enumerate(counts):
        rest, n = sum(left), int(n)
        for k in range(len(left)):
            rest -= left[k]
            out[i, k] = take = _hypergeometric(rng, left[k], rest, n)
            left[k] -= take
            n -= take
            rest = sum(left[k + 1 :])
    return out


def exact_shards(rows: DataFrame, key: Column, n_shards: int = 40, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in its shard), uniformly shuffled.

    Where ``rows`` has such columns, the new ones are named ``_shard`` and ``_slot`` (or with more underscores).
    Shard sizes differ by one row at most: the first ``count % n_shards`` shards have one more. ``key`` is any
    expression that tells rows apart; equal rows are told apart by their place. An empty table gives no rows. Nulls are
    ordinary values. ``rows`` is written once to the shared folder, so partition, place and counts stay those drawn for.
    The driver holds one count for each input partition and shard, nothing for each row.
    """
    spark = rows.sparkSession
    names = rows.columns
    fixed = written(rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_r"), F.spark_partition_id().alias("_p"), F.xxhash64(F.lit(seed), key, F.monotonically_increasing_id()).alias("_k")), "shards")
    counts = sorted((r[0], r[1]) for r in fixed.groupBy("_p").count().collect())
    total = sum(n for _, n in counts)
    sizes = [total // n_shards + (k < total % n_shards) for k in range(n_shards)]
    drawn = communication_matrix([n for _, n in counts], sizes, seed).cumsum(1)
    plan = spark.createDataFrame([(p, c.tolist()) for (p, _), c in zip(counts, drawn, strict=True)], "_p int, _ends array<long>")
    local = fixed.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy("_k")) - 1)
    sent = local.join(plan, "_p").select("_r", F.xxhash64(F.lit(seed + 1), "_k").alias("_k"), F.expr("size(filter(_ends, e -> e <= _i))").alias("shard"))
    blocks = max(1, math.ceil(total / n_shards / block))
    sent = sent.withColumn("_b", F.pmod(F.col("_k"), F.lit(blocks)))
    before = sent.groupBy("shard", "_b").count().withColumn("_base", F.sum("count").over(Window.partitionBy("shard").orderBy("_b")) - F.col("count")).drop("count")
    place = F.row_number().over(Window.partitionBy("shard", "_b").orderBy("_k")) - 1
    found = sent.withColumn("_j", place).join(before, ["shard", "_b"]).select("_r", "shard", (F.col("_j") + F.col("_base")).cast("long").alias("slot"))
    return found.select("_r.*", F.col("shard").alias(_free("shard", names)), F.col("slot").alias(_free("slot", names)))


def _free(name: str, taken: list[str]) -> str:
    """``name``, after as many underscores as it takes to differ from all of ``taken``."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 17) -> DataFrame:
    """All rows of ``docs`` (doc_id, text, further columns ignored) with size, text_crc32, law ``rows``, shard and slot.

    A null text has size 16 and the checksum of the empty text. Repeated and null doc_ids are rows like others.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"))
    out = exact_shards(slim, F.xxhash64("doc_id", "text_crc32"), n_shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, seed: int = 17) -> None:
    """Writes whole rows of ``docs``, null and repeated ones too, to one folder for each shard, with their slots; where
    ``docs`` has a column shard, folders are named ``_shard=...``, as ``exact_shards`` says. An empty table writes no
    folder. Columns may have any names."""
    exact_shards(docs, F.xxhash64("doc_id"), n_shards, seed).write.partitionBy(_free("shard", docs.columns)).parquet(path)
