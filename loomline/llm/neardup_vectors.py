"""Embedding near-dedup with randomised-rotation binary codes.

A vector's code is the signs of its rotated components; with it are stored a correction factor, the inner product of the
code and the vector, and the rotated components in four bits. Of two vectors, the code of one and the rotated other give
an unbiased estimate of their inner product, and the factor a bound of its error. Pairs come from buckets of equal code
substrings of many independent rotations. First only codes go to the buckets; rows of pairs whose bound reaches the
threshold come back with their vectors, and such pairs are computed anew in double precision. A pair counts in the first
bucket that has both. The number of substrings follows from their length, so that a pair at the threshold is met with
the chance ``recall``, and pairs nearer than that with more.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .connected import components
from .vectors import bits, rotation, usable

#: Rows of a bucket that one task compares; larger buckets are cut in chunks, and all pairs of chunks get tasks.
CHUNK = 1024
#: Standard errors of the confidence bound.
SURE = 4.0
#: Levels of a rotated component.
LEVELS = 15


def plan_bands(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a substring, and how many substrings: about 64 unrelated rows in a bucket."""
    k = min(40, max(4, round(math.log2(max(n, 1) / 64))) if n > 64 else 4)
    meet = (1 - math.acos(threshold) / math.pi) ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def band_keys(x: np.ndarray, k: int, bands: int, seed: int) -> np.ndarray:
    """One column for each band: k signs of rotated components as a whole number."""
    rng, dim = np.random.default_rng(seed), x.shape[1]
    turns = np.concatenate([rotation(rng, dim) for _ in range(-(-k * bands // dim))], axis=1)[:, : k * bands]
    signs = (x @ turns > 0).reshape(len(x), bands, k)
    return signs @ (1 << np.arange(k, dtype=np.int64))


class Codes:
    """Binary codes and correction factors of unit vectors, and their rotated components in four bits."""

    def __init__(self, code: np.ndarray, level: np.ndarray, low: np.ndarray, step: np.ndarray, factor: np.ndarray):
        self.code, self.level, self.low, self.step, self.factor, self.dim = code, level, low, step, factor, level.shape[1]
        # What the code can't see is a random direction; four bits add rounding of at most a step for each component.
        self.spread = np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(self.dim - 1, 1))

    @classmethod
    def of(cls, unit: np.ndarray, seed: int) -> Codes:
        turned = unit @ rotation(np.random.default_rng(seed), unit.shape[1])
        low = turned.min(1)
        step = np.maximum(turned.max(1) - low, 1e-12) / LEVELS
        # Rounded up or down by a chance that depends on the vector alone.
        r = np.modf(np.abs(np.sin(turned * 12.9898 + np.arange(unit.shape[1])) * 43758.5453))[0]
        level = np.floor((turned - low[:, None]) / step[:, None] + r).clip(0, LEVELS).astype(np.uint8)
        return cls(bits(turned).view(np.uint8).reshape(len(unit), -1), level, low, step, np.abs(turned).sum(1) / math.sqrt(unit.shape[1]))

    def rows(self) -> np.ndarray:
        """What is stored: one row of bytes for each vector."""
        nibbles = np.pad(self.level, ((0, 0), (0, self.dim % 2)))
        rest = np.stack([self.low, self.step, self.factor], axis=1).astype("<f4").view(np.uint8)
        return np.concatenate([self.code, nibbles[:, ::2] | nibbles[:, 1::2] << 4, rest], axis=1)

    @classmethod
    def from_rows(cls, raw: np.ndarray, dim: int) -> Codes:
        width = -(-dim // 64) * 8
        low, step, factor = np.ascontiguousarray(raw[:, -12:]).view("<f4").astype(np.float64).T
        nibbles = raw[:, width:-12]
        level = np.stack([nibbles & 15, nibbles >> 4], axis=2).reshape(len(raw), -1)[:, :dim]
        return cls(raw[:, :width], level, low, step, factor)

    def estimates(self, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
        """Unbiased estimates of the inner products of the vectors ``a`` with the codes ``b``, and half the widths of
        their bounds."""
        signs = np.unpackbits(self.code[b], axis=1, count=self.dim, bitorder="little").astype(np.float32) * 2 - 1
        turned = self.low[a, None] + self.step[a, None] * self.level[a]
        scale = math.sqrt(self.dim) * self.factor[b]
        return turned.astype(np.float32) @ signs.T / scale, SURE * np.hypot(self.spread[b][None, :], self.step[a, None] / 2 / self.factor[b])


def _above(codes: Codes, split: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose bound reaches the threshold; with ``split``, those of a row before it and one from it on."""
    n, out = len(codes.code), []
    for at in range(0, split or n, 512):
        a, b = slice(at, min(at + 512, split or n)), slice(split or at, n)
        est, bound = codes.estimates(a, b)
        i, j = np.nonzero(est + bound >= threshold - 1e-6)
        i, j = i + a.start, j + b.start
        out.append(np.stack([i, j])[:, i < j])
    i, j = np.concatenate(out, axis=1)
    return i, j


def bucket_links(x: np.ndarray, weight: np.ndarray, keys: np.ndarray, band: int, codes: Codes, split: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the weight of those it links with, and the smallest row it reaches; rows from ``split`` on are the
    second chunk (0: one chunk, all pairs). Pairs that agree in a key before ``band`` were met there."""
    norm = np.sqrt((x * x).sum(1))
    links, parent = np.zeros(len(x), np.int64), np.arange(len(x))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    i, j = _above(codes, split, threshold)
    for at in range(0, len(i), 1 << 14):
        a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        on = (x[a] * x[b]).sum(1) / (norm[a] * norm[b]) >= threshold
        a, b = a[on], b[on]
        if band:
            on = ~(keys[a, :band] == keys[b, :band]).any(1)
            a, b = a[on], b[on]
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            p, q = find(p), find(q)
            parent[max(p, q)] = min(p, q)
    return links, np.array([find(r) for r in range(len(x))], np.int64)


def near_vectors(rows: DataFrame, threshold: float = 0.9, recall: float = 0.99999, seed: int = 29, chunk: int = CHUNK) -> DataFrame:
    """Every row of ``rows`` (vec_id, embedding) with n_links, component_id and kept.

    Rows with the same components are one class with a weight; classes are told apart by a 64-bit hash. Vectors that
    are null, empty, zero or not finite, and vectors of other lengths, link with nothing. Of an unlinked row and of a
    repeated vec_id, each row counts on its own. A row with a null vec_id is linked, but names no component; where a
    component has no other row, component_id is null and kept false. An empty table gives no rows.
    """
    slim = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable(F.col("embedding")), F.col("embedding").cast("array<double>")).alias("x"))
    slim = slim.withColumn("class", F.when(F.col("x").isNotNull(), F.xxhash64("x")))
    classes = written(slim.where("x is not null").groupBy("class").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("x").alias("x")), "vectors")
    dims = [r[0] for r in classes.select(F.size("x")).distinct().collect()]
    found = None
    for dim in sorted(dims):
        part = _links(classes.where(F.size("x") == dim).select("class", "weight", "x"), dim, threshold, recall, seed, chunk)
        found = part if found is None else found.union(part)
    if found is None:
        return slim.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = written(found, "vector-links")
    degree = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("class"), "root")
    named = classes.select("class", "least", "weight").join(degree, "class", "left").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = named.join(least, "root").select("class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    # Rows that link with nothing have no class to look up; those of one class may be many, so AQE may split it.
    out = slim.drop("x").where("class is not null").join(by_class, "class").select("vec_id", "n_links", "component_id")
    alone = slim.where("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _by_bucket(found: Iterator[pa.RecordBatch], solve: Callable[[pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """``solve`` of the rows of each bucket (the first four columns), which come in order."""
    held: pa.Table | None = None
    for batch in found:
        t = pa.Table.from_batches([batch])
        held = t if held is None or not len(held) else pa.concat_tables([held, t]).combine_chunks()
        key = np.stack([held[c].to_numpy() for c in ("band", "key", "lo", "hi")])
        at = 0
        for c in (np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist():
            if c - at > 1 and (got := solve(held.slice(at, c - at))) is not None:
                yield got
            at = c
        held = held.slice(at)
    if held is not None and len(held) > 1 and (got := solve(held)) is not None:
        yield got


def _split(t: pa.Table) -> int | None:
    """Where the second chunk of a bucket begins; 0: it has one chunk; None: the other chunk is empty."""
    lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
    split = int((t["mine"].to_numpy() == lo).sum()) if lo != hi else 0
    return None if lo != hi and split in (0, len(t)) else split


def _links(classes: DataFrame, dim: int, threshold: float, recall: float, seed: int, chunk: int) -> DataFrame:
    k, bands = plan_bands(classes.count(), threshold, recall)

    # Codes and keys are made once and stored: what is compared later is what was stored.
    def encode(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in found:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                x = np.asarray(batch.column(2).flatten(), np.float64).reshape(-1, dim)
                unit = x / np.sqrt((x * x).sum(1, keepdims=True))
                keys = band_keys(unit, k, bands, seed)
                code = Codes.of(unit, seed + 7).rows()
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * bands)
                cols = [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in code], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))]
                yield pa.RecordBatch.from_arrays(cols, ["class", "weight", "x", "code", "keys"])

    stored = written(classes.mapInArrow(encode, "class long, weight long, x binary, code binary, keys array<long>"), "codes")
    each = stored.select("class", "code", F.posexplode("keys").alias("band", "key"))
    # Buckets of more rows than a task compares: counts are combined before the shuffle.
    counted = stored.select(F.posexplode("keys").alias("band", "key")).groupBy("band", "key").count()
    hot = written(counted.where(F.col("count") > chunk).select("band", "key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "hot-buckets")
    n_hot = hot.count()
    if n_hot:
        small = F.broadcast(hot) if n_hot <= 10_000 else hot  # 200 KB; beyond that, a sort-merge join that AQE may split
        mine = F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int")
        each = each.join(small, ["band", "key"], "left").withColumn("mine", F.when(F.col("chunks").isNull(), 0).otherwise(mine))
        each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks") - 1, F.lit(0)))))
        each = each.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    else:
        each = each.withColumn("mine", F.lit(0)).withColumn("lo", F.lit(0)).withColumn("hi", F.lit(0))
    place = ["band", "key", "lo", "hi", "mine", "class"]
    bucket = place[:4]

    def estimate(t: pa.Table) -> pa.RecordBatch | None:
        split = _split(t)
        if split is None:
            return None
        raw = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(len(t), -1)
        i, j = _above(Codes.from_rows(raw, dim), split, threshold)
        if not len(i):
            return None
        return t.select(place).take(np.unique(np.concatenate([i, j]))).combine_chunks().to_batches()[0]

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        split = _split(t)
        if split is None:
            return None
        ids, weight, band = t["class"].to_numpy(), t["weight"].to_numpy(), t["band"][0].as_py()
        x = np.frombuffer(b"".join(t["x"].to_pylist()), np.float64).reshape(-1, dim)
        raw = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(len(t), -1)
        keys = np.frombuffer(t["keys"].combine_chunks().flatten().to_numpy(), np.int64).reshape(len(t), -1)
        links, root = bucket_links(x, weight, keys, band, Codes.from_rows(raw, dim), split, threshold)
        on = links > 0
        if not on.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(ids[root[on]]), pa.array(links[on])], ["class", "root", "links"])

    dealt = each.select(*place, "code").repartition(*bucket).sortWithinPartitions(*place[:5])
    undecided = dealt.mapInArrow(lambda b: _by_bucket(b, estimate), "band int, key long, lo int, hi int, mine int, class long")
    again = written(undecided, "undecided").join(stored, "class").select(*place, "weight", "x", "code", "keys")
    return again.repartition(*bucket).sortWithinPartitions(*place[:5]).mapInArrow(lambda b: _by_bucket(b, compare), "class long, root long, links long")
