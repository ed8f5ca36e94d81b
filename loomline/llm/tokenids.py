"""Token ids in directly addressable codes.

Ids are cut into chunks of eight bits, the lowest first. Level 0 holds the first chunk of every id, level k the k-th
chunk of those that have one; a bit for each chunk tells whether its id goes on, and a directory counts the set bits
before every 512. So the place of an id in the next level is a rank, and any id is read without decoding others.

A file is a Parquet table with one container in each row: ``part`` and ``seq`` give the order, ``start`` the ids before
it in its part, ``n_ids`` its ids, ``data`` the bytes below. Parts hold ascending ranges of doc_id.

    "DAC1", u32 levels, u64 ids, u64 documents,
    i64 doc_id of each document, u8 whether it is null, u64 first id of each and the end,
    for each level: u64 chunks, the chunks, and but for the last level: bitmap (least bit first), u64 directory
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TokenCache, new_path, slices

STEP = 512
#: Ids after which a container is closed; a document is never split.
CONTAINER = 1 << 20


class Codes:
    """One container; ``code[i]`` is its i-th id."""

    def __init__(self, levels: list[tuple], doc_ids: np.ndarray, nulls: np.ndarray, starts: np.ndarray):
        self.levels, self.doc_ids, self.nulls, self.starts = levels, doc_ids, nulls, starts

    @classmethod
    def encode(cls, ids: np.ndarray, doc_ids: list, starts: np.ndarray) -> Codes:
        rest, levels = ids.astype(np.uint32), []
        while True:
            chunks = (rest & 255).astype(np.uint8)
            on = rest > 255
            if not on.any():
                levels.append((chunks, None, None))
                break
            bits = np.packbits(on, bitorder="little")
            per = np.add.reduceat(on.astype(np.uint64), np.arange(0, len(on), STEP))
            levels.append((chunks, bits, np.concatenate([[0], np.cumsum(per)[:-1]]).astype("<u8")))
            rest = rest[on] >> 8
        return cls(levels, np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], np.uint8), np.asarray(starts, "<u8"))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        out, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            out |= int(chunks[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // STEP
            before = bits[block * STEP // 8 : i // 8 + 1].copy()
            before[-1] &= (1 << (i & 7)) - 1
            i, shift = int(ranks[block]) + int(np.bitwise_count(before).sum()), shift + 8
        return out

    def ids(self) -> np.ndarray:
        """All ids, level by level."""
        out, at = np.zeros(len(self), "<u4"), np.arange(len(self))
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks.astype("<u4") << np.uint32(8 * k)
            if bits is not None:
                at = at[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)]
        return out

    def to_bytes(self) -> bytes:
        out = [b"DAC1", struct.pack("<IQQ", len(self.levels), len(self), len(self.doc_ids)), self.doc_ids.tobytes(), self.nulls.tobytes(), self.starts.tobytes()]
        for chunks, bits, ranks in self.levels:
            out += [struct.pack("<Q", len(chunks)), chunks.tobytes()] + ([bits.tobytes(), ranks.tobytes()] if bits is not None else [])
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> Codes:
        if data[:4] != b"DAC1":
            raise ValueError("not a container of token ids")
        n_levels, _, n_docs = struct.unpack_from("<IQQ", data, 4)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        doc_ids, nulls, starts, levels = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs + 1), []
        for k in range(n_levels):
            n = int(take("<u8", 1)[0])
            chunks, last = take("u1", n), k == n_levels - 1
            levels.append((chunks, None if last else take("u1", -(-n // 8)), None if last else take("<u8", -(-n // STEP))))
        return cls(levels, doc_ids, nulls, starts)


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, container: int = CONTAINER) -> None:
    """Writes the ids of all rows of ``docs`` (doc_id, text), each document's followed by ``end_id``, to ``path``.

    Ascending doc_id, nulls first, rows of one doc_id by the hash of their text. A null or empty text is its end id
    alone. Spark's own writer commits the files, so that lost executors leave none behind.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, seq, base = TokenCache.get(tokenizer, True), TaskContext.get().partitionId(), 0, 0
        names, data, n = [], [], 0

        def close() -> pa.RecordBatch:
            starts = np.cumsum([0] + [len(d) // 4 for d in data])
            code = Codes.encode(np.frombuffer(b"".join(data), "<u4"), names, starts)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([base], pa.int64()), pa.array([n], pa.int64()), pa.array([code.to_bytes()], pa.binary())], ["part", "seq", "start", "n_ids", "data"])

        for batch in found:
            for a, b, texts in slices(batch, 1, 4_000_000):
                for i, got in zip(batch.column(0).slice(a, b - a).to_pylist(), cache.encode(texts), strict=True):
                    names.append(i)
                    data.append(got + end)
                    n += len(got) // 4 + 1
                    if n >= container:
                        yield close()
                        seq, base, names, data, n = seq + 1, base + n, [], [], 0
        if data:
            yield close()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_h"), "text")
    ranged = slim.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    ranged.mapInArrow(run, "part int, seq long, start long, n_ids long, data binary").write.option("compression", "zstd").parquet(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The containers at ``path``, with ``base``: the ids of all parts before."""
    found = spark.read.schema("part int, seq long, start long, n_ids long, data binary").parquet(path)
    parts, base, rows = found.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect(), 0, []
    for r in parts:  # one row for each part
        rows.append((r["part"], base))
        base += r["n"]
    return found.join(spark.createDataFrame(rows, "part int, base long"), "part")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Of each document, from the files: doc_id (may be null or repeated), start, n_tokens and ids_crc32. Files of an
    empty table give no rows."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                code = Codes.from_bytes(data.as_buffer())
                raw, starts = memoryview(code.ids().tobytes()), code.starts.astype(np.int64)
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(code.doc_ids, pa.int64(), mask=code.nulls.astype(bool)), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    slim = read_token_ids(spark, path).select((F.col("base") + F.col("start")).alias("base"), "data")
    return slim.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the ids of ``docs`` to the shared folder and gives what the files hold of each document: a row for each
    row of ``docs``, repeated ones too. A null or empty text has its end id alone, a null doc_id stays null and comes
    first. Further columns are ignored. An empty table gives no rows."""
    path = new_path(docs.sparkSession, "ids")
    write_token_ids(docs, path, tokenizer, end_id)
    return token_digests(docs.sparkSession, path)
