"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes by rotations learned to keep the signs' quantisation error small. A block of rows indexes
every substring of its codes; by the pigeonhole principle, a code within the radius agrees with the query's in some
substring up to the radius's share, so probing those finds every code within the radius. What is found is ranked anew
by the inner products of the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import numbered
from .common import written
from .vectors import bits, rotation, usable

#: Rows the rotations and the radius are learned from, at most; which ones is drawn by a hash.
SAMPLE = 8192
ROTATIONS = 4
#: Rows of an indexed block, and queries of a block of queries.
ROWS, QUERIES = 16384, 256
SUBSTRING = 8
#: Share of true neighbours of sampled queries that the radius takes in.
COVER = 0.98


class Hashing:
    """Learned codes of vectors of one length. Inner products are turned into angles by one more component, which
    brings every row to the largest norm and is zero for queries."""

    def __init__(self, sample: np.ndarray, largest: float, k: int, seed: int, rotations: int = ROTATIONS):
        self.largest = largest
        x = self.raised(sample)
        rng, dim = np.random.default_rng(seed), x.shape[1]
        turns = []
        for _ in range(rotations):
            turn = rotation(rng, dim)
            for _ in range(15):  # nearest orthogonal map to the signs of the last
                u, _, v = np.linalg.svd(np.sign(x @ turn).T @ x)
                turn = (u @ v).T
            turns.append(turn)
        self.turns = np.concatenate(turns, axis=1)
        self.n_bits = self.turns.shape[1]
        # The radius: how far the true neighbours' codes lie, within the sample, where neighbours are farther.
        q = np.random.default_rng(seed).permutation(len(sample))[: min(len(sample), 200)]
        near = sample[q] @ sample.T
        near[np.arange(len(q)), q] = -np.inf
        n = min(k, len(sample) - 1)
        if n < 1:
            self.radius = self.n_bits
            return
        top = np.argpartition(-near, n - 1, axis=1)[:, :n]
        codes, asked = self.codes(sample), self.codes(sample[q], True)
        far = np.bitwise_count(codes[top] ^ asked[:, None]).sum(2, dtype=np.int64)
        self.radius = int(np.quantile(far, COVER))

    def raised(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) if query else self.largest)
        more = np.zeros((len(x), 1)) if query else np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))
        return np.concatenate([x, more], axis=1)

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        return bits(self.raised(x, query) @ self.turns)


class Index:
    """The substrings of a block's codes: of each, the rows in order of their value, and where each value begins."""

    def __init__(self, codes: np.ndarray, n_bits: int):
        self.codes, self.m = codes, -(-n_bits // SUBSTRING)
        parts = codes.view(np.uint8)[:, : self.m]
        self.parts = np.ascontiguousarray(parts.T)
        self.rows, self.begin = [], []
        for j in range(self.m):
            self.rows.append(np.argsort(parts[:, j], kind="stable").astype(np.int32))
            self.begin.append(np.concatenate([[0], np.cumsum(np.bincount(parts[:, j], minlength=256))]))
        apart = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))
        self.inside = [apart <= r for r in range(SUBSTRING + 1)]
        self.balls = [[np.flatnonzero(apart[v] <= r) for v in range(256)] for r in range(2)]

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows within ``radius`` of ``code``, and their distances."""
        share, rest = divmod(radius, self.m)
        if share >= SUBSTRING:
            found = np.arange(len(self.codes))
        else:
            seen = np.zeros(len(self.codes), bool)
            for j, v in enumerate(code.view(np.uint8)[: self.m]):
                near = share if j <= rest else share - 1  # m substrings can't all exceed these without exceeding radius
                if near < 0:
                    break
                if near < 2:  # few buckets: each is a run of rows
                    for value in self.balls[near][v]:
                        seen[self.rows[j][self.begin[j][value] : self.begin[j][value + 1]]] = True
                else:  # many: the values of all rows are looked up in the ball
                    seen |= self.inside[near][v][self.parts[j]]
                    if j % 4 == 3 and 2 * np.count_nonzero(seen) > len(seen):
                        seen[:] = True  # comparing all codes is cheaper than probing on
                        break
            found = np.flatnonzero(seen)
        far = np.bitwise_count(self.codes[found] ^ code).sum(1, dtype=np.int64)
        keep = far <= radius
        return found[keep], far[keep]


def search_block(model: Hashing, ids: np.ndarray, x: np.ndarray, index: Index, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query, up to ``k`` rows of the block: number of the query, row, inner product."""
    asked = model.codes(queries, True)
    out = ([], [], [])
    for i in range(len(queries)):
        radius = model.radius
        while True:  # the radius grows where it holds too few
            found, _ = index.within(asked[i], radius)
            found = found[ids[found] != query_ids[i]]
            if len(found) >= k or radius >= model.n_bits:
                break
            radius = min(model.n_bits, radius + max(4, model.n_bits // 16))
        score = (x[found] * queries[i]).sum(1)  # in one order, so that equal vectors have equal scores
        order = np.lexsort((ids[found], -score))[:k]
        for o, v in zip(out, (np.full(len(order), i), ids[found][order], score[order]), strict=True):
            o.append(v)
    return tuple(np.concatenate(o) if o else np.zeros(0, int) for o in out)


def nearest(rows: DataFrame, is_query: Column, k: int = 20, seed: int = 31, n_rows: int = ROWS, n_queries: int = QUERIES) -> DataFrame:
    """Up to ``k`` rows nearest to each row of ``rows`` (vec_id, embedding) that ``is_query`` holds of.

    Returns query_id, rank (from 1), vec_id and score, the inner product in double precision; ties go to the smaller
    vec_id. Rows whose vec_id is null, and vectors that are null, empty, zero or not finite, take no part. Vectors of
    different lengths aren't compared. Rows of the query's own vec_id are no candidates of it; a repeated query is
    answered once for each distinct vector. Every other row is indexed. An empty table gives no rows.

    Each block of queries meets each block of rows once, by a join on the block's number.
    """
    spark = rows.sparkSession
    slim = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    out = None
    norms = slim.groupBy(F.size("x").alias("dim")).agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).alias("largest")).collect()
    for dim, largest in sorted(norms):  # one row for each length of vectors
        found = _search(slim.where(F.size("x") == dim), dim, largest, k, seed, n_rows, n_queries)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out


def _search(rows: DataFrame, dim: int, largest: float, k: int, seed: int, n_rows: int, n_queries: int) -> DataFrame:
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "x").select("x").limit(SAMPLE).collect()  # bounded
    model = Hashing(np.array([r[0] for r in sample]), largest, k, seed)

    def blocks(size: int):
        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in found:
                for at in range(0, len(batch), size):
                    part = batch.slice(at, size)
                    ids = np.asarray(part.column(0), np.int64)
                    x = np.asarray(part.column(1).flatten(), np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([x.tobytes()])], ["ids", "x"])

        return run

    schema = "ids binary, x binary"
    base = rows.select("vec_id", "x").mapInArrow(blocks(n_rows), schema).withColumn("_at", F.monotonically_increasing_id())
    base = numbered(base, [F.col("_at")], "block").drop("_at")
    asked = rows.where("asks").select("vec_id", "x").distinct().mapInArrow(blocks(n_queries), schema)
    asked = written(asked.withColumn("q", F.monotonically_increasing_id()), "queries")
    met = asked.select("q", F.col("ids").alias("q_ids"), F.col("x").alias("q_x")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(base.count() - 1).cast("long"))))
    pairs = met.join(base, "block").sortWithinPartitions("block")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in found:
            for r in range(len(batch)):
                block, q, q_ids, q_x, ids, x = (batch.column(c)[r].as_py() for c in range(6))
                if block != last:
                    own = np.frombuffer(x).reshape(-1, dim)
                    last, held = block, (np.frombuffer(ids, np.int64), own, Index(model.codes(own), model.n_bits))
                names = np.frombuffer(q_ids, np.int64)
                i, v, s = search_block(model, held[0], held[1], held[2], names, np.frombuffer(q_x).reshape(-1, dim), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), q, np.int64)), pa.array(i.astype(np.int32)), pa.array(names[i.astype(int)]), pa.array(v.astype(np.int64)), pa.array(s.astype(np.float64))], ["q", "i", "query_id", "vec_id", "score"])

    found = pairs.select("block", "q", "q_ids", "q_x", "ids", "x").mapInArrow(run, "q long, i int, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("q", "i").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
