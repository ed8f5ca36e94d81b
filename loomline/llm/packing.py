"""Packing documents into sequences by Karmarkar-Karp multiway differencing.

The tails of documents (what whole sequences leave over) are dealt to near-equal windows: partial partitions merge the
fullest window of one with the emptiest of the other, so that imbalances cancel; the window count rises while any
window exceeds the capacity. Tokens of documents that must be cut anyway then fill what is still free of each window.
What is left of a partition of the input in the end becomes sequences whose lengths are powers of two.
"""

from __future__ import annotations

import heapq
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import TokenCache, slices

#: Windows of tails that are packed at a time.
BATCH_WINDOWS = 48
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Deals the items to ``k`` windows with near-equal sums; of each window, the numbers of its items."""
    heap = [(-n, i, [n] + [0] * (k - 1), [[i]] + [[] for _ in range(k - 1)]) for i, n in enumerate(sizes)]
    if not heap:
        return [[] for _ in range(k)]
    heapq.heapify(heap)
    fresh = len(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)  # sums in descending order; the largest imbalances first
        _, _, b, y = heapq.heappop(heap)
        merged = sorted(((p + q, r + s) for p, q, r, s in zip(a, reversed(b), x, reversed(y), strict=True)), key=lambda m: -m[0])
        least = merged[-1][0]
        sums = [m[0] - least for m in merged]
        heapq.heappush(heap, (-sums[0], fresh, sums, [m[1] for m in merged]))
        fresh += 1
    return heap[0][3]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """As few near-equal windows as differencing can keep within ``capacity``."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, k)
        over = max((sum(sizes[i] for i in w) for w in found), default=0) - capacity
        if over <= 0:
            return [w for w in found if w]
        k += max(1, over * k // (capacity * 4))


class Packer:
    """Takes documents as id bytes, and gives pieces: (document, start, length, sequence, offset)."""

    def __init__(self, capacity: int, batch_windows: int, first_sequence: int):
        self.capacity, self.most, self.sequence = capacity, batch_windows * capacity, first_sequence
        self.tails: list[tuple[object, int, int]] = []
        self.held = 0
        self.filler: deque[list] = deque()  # [document, start, length], in order, to be cut at will

    def add(self, doc: object, n: int) -> Iterator[tuple]:
        body = n - n % self.capacity
        if body:
            self.filler.append([doc, 0, body])
        if n > body:
            self.tails.append((doc, body, n - body))
            self.held += n - body
        if self.held >= self.most:
            yield from self.flush()

    def cut(self, need: int) -> Iterator[tuple[object, int, int]]:
        while need and self.filler:
            doc, start, have = self.filler[0]
            n = min(need, have)
            if n == have:
                self.filler.popleft()
            else:
                self.filler[0] = [doc, start + n, have - n]
            need -= n
            yield doc, start, n

    def flush(self) -> Iterator[tuple]:
        tails, self.tails, self.held = sorted(self.tails, key=lambda t: -t[2]), [], 0
        found = [[tails[i] for i in w] for w in windows([t[2] for t in tails], self.capacity)]
        found.sort(key=lambda w: -sum(t[2] for t in w))
        free = sum(self.capacity - sum(t[2] for t in w) for w in found)
        have = sum(f[2] for f in self.filler)
        while found and have < free:  # the emptiest window is dissolved to fill the others
            w = found.pop()
            n = sum(t[2] for t in w)
            free, have = free - (self.capacity - n), have + n
            self.filler.extend([list(t) for t in w])
        for w in found:
            w += self.cut(self.capacity - sum(t[2] for t in w))
            yield from self.placed(w)
        have = sum(f[2] for f in self.filler)
        while have >= self.capacity:
            yield from self.placed(list(self.cut(self.capacity)))
            have -= self.capacity

    def finish(self) -> Iterator[tuple]:
        yield from self.flush()
        while have := sum(f[2] for f in self.filler):
            yield from self.placed(list(self.cut(1 << min(have, self.capacity).bit_length() - 1)))

    def placed(self, pieces: list[tuple[object, int, int]]) -> Iterator[tuple]:
        at = 0
        for doc, start, n in pieces:
            yield doc, start, n, self.sequence, at
            at += n
        self.sequence += 1


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, batch_windows: int = BATCH_WINDOWS) -> DataFrame:
    """The pieces of all rows of ``docs`` (doc_id, text): each id of each document lies in exactly one piece.

    ``tokenizer`` is the path of a file of the tokenizers library, the same on all machines. A null or empty text is
    its end id alone. Repeated doc_ids are packed as documents of their own; a null doc_id stays null. Sequences are
    full, but for those of the powers of two at the end of a partition. No row moves between tasks: each partition
    packs what it reads, holding about ``batch_windows`` windows and the longest document.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TokenCache.get(tokenizer, False)
        packer = Packer(capacity, batch_windows, TaskContext.get().partitionId() << 33)

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            rows = [(doc[0], start, n, zlib.crc32(doc[1][4 * start : 4 * (start + n)]), len(doc[1]) // 4, seq, at) for doc, start, n, seq, at in pieces]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in found:
            for a, b, texts in slices(batch, 1, 4_000_000):
                pieces = []
                for i, got in zip(batch.column(0).slice(a, b - a).to_pylist(), cache.encode(texts), strict=True):
                    pieces += packer.add((i, got + end), len(got) // 4 + 1)
                if pieces:
                    yield table(pieces)
        if pieces := list(packer.finish()):
            yield table(pieces)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
