"""Substring dedup: repeated passages, found by backward search in compressed FM-indexes.

A passage is a window of ``WINDOW`` words. Each window is filed under its anchor, the k-gram of least hash in it, so
that equal windows meet under one anchor; consecutive windows of one anchor are a region. Regions whose anchor occurs
in several documents go, each distinct one once and with the smallest doc_id that has it, to the shard of their anchor.
A shard is an FM-index, the Burrows-Wheeler transform of regions in a wavelet tree. It holds those regions that another
document may repeat later: of each anchor, all but the latest. Regions that may repeat an earlier one, of each anchor
all but the earliest, are streamed through it by backward search; the matching statistic at each word is how far the
text from there on matches the shard, cut at ``WINDOW`` words, and with it comes the interval of suffixes that match. A
window is reported where the statistic reaches ``WINDOW``; the smallest doc_id of the interval tells whether it starts
in an earlier document.
"""

from __future__ import annotations

import numpy as np

from .common import Words, mix

WINDOW, GRAM = 50, 8
_C = np.uint64(0x9E3779B97F4A7C15)
#: Low bits that hold a position; the rest orders k-grams.
_PLACE = np.uint64((1 << 24) - 1)
_SLICE = 1 << 22


def _rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words."""
    out = h[: len(h) - n + 1].copy()
    with np.errstate(over="ignore"):
        for j in range(1, n):
            out *= _C
            out += h[j : len(h) - n + 1 + j]
        return mix(out)


def regions(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words ``h``: the anchor, the first window and the end of the windows of each region, in order."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n > _SLICE:
        parts = [regions(h[a : a + _SLICE + WINDOW - 1]) for a in range(0, n, _SLICE)]
        return tuple(np.concatenate([p[k] + (i * _SLICE if k else np.uint64(0)) for i, p in enumerate(parts)]) for k in range(3))
    grams = _rolling(h, GRAM)
    low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    width, span = WINDOW - GRAM + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[width - span : width - span + n])  # the leftmost of the least
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return grams[(low[first] & _PLACE).astype(np.int64)], first, np.concatenate([first[1:], [n]])


def region_names(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words of each region."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h), _C, np.uint64)]))
        inverse = np.uint64(pow(int(_C), -1, 1 << 64))
        back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h), inverse, np.uint64)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)])])
        stop = end + WINDOW - 1
        return mix((sums[stop] - sums[first]) * back[first] + (stop - first).astype(np.uint64))


class WaveletTree:
    """Ranks of symbols in a sequence: one packed bit for each of its levels, and the set bits before every 64."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.n, self.levels = len(symbols), []
        for b in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            bit = symbols >> b & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.pad(packed, (0, 8 + -len(packed) % 8)).view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]).astype(np.int32)
            zeros = int(self.n - bit.sum())
            self.levels.append((b, packed, before, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.first = np.zeros(n_symbols, np.int64)
        self.first = self.walk(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, packed, before, zeros in self.levels:
            word = i >> 6
            ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where(symbol >> b & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place ``i``."""
        return self.walk(symbol, i) - self.first[symbol]


class FMIndex:
    """An index of word sequences (64-bit hashes), each with a number; matches are cut at ``depth`` words."""

    def __init__(self, words: list[np.ndarray], numbers: np.ndarray, depth: int = WINDOW):
        self.depth, k = depth, len(words)
        sizes = np.array([len(w) for w in words])
        flat = np.concatenate(words)
        self.vocabulary, ids = np.unique(flat, return_inverse=True)
        n = len(flat) + k
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = ids + 1
        # Suffixes in order of their first words, by doubling; each sequence's end differs from all others.
        rank = text + k
        rank[ends] = np.arange(k)
        ranks, span = [], 1
        while True:
            ranks.append(rank)
            if span > depth:
                break
            after = np.concatenate([rank[span:] + 1, np.zeros(min(span, n), np.int64)])[:n]
            key = rank * (rank.max() + 2) + after
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            span *= 2
        suffix = np.argsort(rank, kind="stable")
        # How many words neighbours in that order share: up to twice the depth, from the ranks.
        a, b, shared = suffix[:-1].copy(), suffix[1:].copy(), np.zeros(n - 1, np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            fits = np.maximum(a, b) < n
            same = fits & (ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)])
            shared += same << level
            a += same << level
            b += same << level
        self.shared = np.concatenate([[0], shared, [0]])
        self.tree = WaveletTree(text[suffix - 1], len(self.vocabulary) + 1)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.vocabulary) + 1))])[:-1]
        self.n, self.left, self.right = n, self._smaller(self.shared), n - self._smaller(self.shared[::-1])[::-1]
        self.numbers = np.repeat(numbers, sizes + 1)[suffix]

        cut = np.flatnonzero(self.shared[:-1] < depth)
        size = np.diff(np.concatenate([cut, [n]]))
        #: Of each suffix, the interval of those that share its first ``depth`` words.
        self.low, self.high = np.repeat(cut, size), np.repeat(cut + size, size)

    @staticmethod
    def _smaller(x: np.ndarray) -> np.ndarray:
        """Of each place, the nearest before it that has a smaller value; 0 where there is none."""
        out = np.arange(-1, len(x) - 1)
        todo = np.arange(len(x))
        while len(todo := todo[(out[todo] >= 0) & (x[out[todo]] >= x[todo])]):
            out[todo] = out[out[todo]]  # all between that place and this one are no smaller
        return np.maximum(out, 0)

    def parents(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next larger intervals of suffixes that share words, and how many words they share. A word that can't be
        put before what an interval shares can't be put before any more than that either."""
        a, b = self.shared[lo], self.shared[hi]
        depth = np.maximum(a, b)
        low, high = np.where(a == depth, self.left[lo], lo), np.where(b == depth, self.right[hi], hi)
        return np.where(depth > 0, low, 0), np.where(depth > 0, high, self.n), depth

    def least_numbers(self) -> np.ndarray:
        """Of each suffix, the least number among those that share its first ``depth`` words."""
        first = np.flatnonzero(np.concatenate([[True], self.low[1:] != self.low[:-1]]))
        return np.repeat(np.minimum.reduceat(self.numbers, first), self.high[first] - self.low[first])

    def matching_statistics(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """At each word of each sequence (one after another): the length of the longest match that starts there, cut
        at the depth, and the interval of suffixes it matches. All sequences go leftwards in step."""
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.concatenate(words)
        place = np.minimum(np.searchsorted(self.vocabulary, flat), max(len(self.vocabulary) - 1, 0))
        symbol = np.where(self.vocabulary[place] == flat, place + 1, -1)
        last = np.cumsum(sizes) - 1
        length, low, high = (np.zeros(len(flat), np.int64) for _ in range(3))
        order = np.argsort(-sizes, kind="stable")
        last, sizes = last[order], sizes[order]
        have = np.zeros(len(words), np.int64)
        lo, hi = np.zeros(len(words), np.int64), np.full(len(words), self.n, np.int64)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -t, side="left"))
            at = last[:live] - t
            c = symbol[at]
            todo = np.arange(live)
            gone = todo[c < 0]
            have[gone], lo[gone], hi[gone] = 0, 0, self.n
            todo = todo[c >= 0]
            while len(todo):
                s = c[todo]
                both = self.tree.rank(np.concatenate([s, s]), np.concatenate([lo[todo], hi[todo]]))
                a, b = self.before[s] + both[: len(s)], self.before[s] + both[len(s) :]
                hit = b > a
                done = todo[hit]
                lo[done], hi[done] = a[hit], b[hit]
                have[done] += 1
                todo = todo[~hit]  # fewer words at the right, and again
                lo[todo], hi[todo], have[todo] = self.parents(lo[todo], hi[todo])
            over = np.flatnonzero(have[:live] > self.depth)
            if len(over):
                hi[over], lo[over], have[over] = self.high[lo[over]], self.low[lo[over]], self.depth
            length[at], low[at], high[at] = have[:live], lo[:live], hi[:live]
        return length, low, high


def earlier_windows(words: list[np.ndarray], doc_ids: np.ndarray, anchors: np.ndarray) -> list[np.ndarray | None]:
    """Of each region of a shard, which of its windows also start in an indexed region of a smaller doc_id; None of
    regions that aren't streamed, as no region of their anchor is of an earlier document."""
    _, of = np.unique(anchors, return_inverse=True)
    least, most = np.full(of.max() + 1, np.iinfo(np.int64).max), np.full(of.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(least, of, doc_ids)
    np.maximum.at(most, of, doc_ids)
    held, asked = np.flatnonzero(doc_ids < most[of]), np.flatnonzero(doc_ids > least[of])
    out: list[np.ndarray | None] = [None] * len(words)
    if not len(asked):
        return out
    index = FMIndex([words[i] for i in held], doc_ids[held])
    length, low, _ = index.matching_statistics([words[i] for i in asked])
    first, at = index.least_numbers(), 0
    for i in asked.tolist():
        window = slice(at, at + len(words[i]) - WINDOW + 1)
        out[i] = (length[window] == WINDOW) & (first[low[window]] < doc_ids[i])
        at += len(words[i])
    return out


def words_kept(text: str | None, found: dict[int, np.ndarray | None]) -> tuple[list[bytes], np.ndarray]:
    """The words of a text, and which stay; ``found``: the regions to remove, or which of their windows."""
    cut = (text or "").encode("utf-8", "surrogatepass").split()
    gone = np.zeros(len(cut) + 1, np.int64)
    if found:
        h = Words([text]).hashes
        _, first, end = regions(h)
        for name, a, b in zip(region_names(h, first, end).view(np.int64).tolist(), first.tolist(), end.tolist(), strict=True):
            if name in found:
                which = found[name]
                on = np.arange(a, b) if which is None else a + np.flatnonzero(which[: b - a])
                np.add.at(gone, on, 1)
                np.add.at(gone, on + WINDOW, -1)
    return cut, np.cumsum(gone)[:-1] == 0
