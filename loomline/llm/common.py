"""Shared pieces: the shared folder, cut lineage, words, hashing and the token cache."""

from __future__ import annotations

import itertools
import os
import re
import unicodedata
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import release as remove
from ..plans.tables import shared_dir
from ..plans.tables import stored as written

__all__ = ["remove", "shared_dir", "written"]

#: A word is a maximal run of anything but these six white-space bytes; ``bytes.split()`` cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomline-{name}-{uuid.uuid4().hex}"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32(doc_id as text) mod ``by``; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that are hashed at once; what working arrays take is about 40 times that.
MOST = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """The powers 0..n-1 of the base or of its inverse, modulo 2**64. Only as many as usual are kept."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(2 * MOST, n)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE if kind == "up" else _INVERSE, np.uint64)]))
        if size == 2 * MOST:
            _powers[kind] = have
    return have[:n]


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word of a byte array."""
    inside = np.empty(len(raw) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_SPACE[raw], out=inside[1:-1].view(bool))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = MOST) -> np.ndarray:
    """A 64-bit hash of each of the ordered byte spans, whatever its place; about ``most`` bytes are worked on at once."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        begin = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, begin + most)))
        out[i:j] = _hash_spans(raw[begin : int(ends[j - 1])], starts[i:j] - begin, ends[i:j] - begin)
        i = j
    return out


def _hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Differences of one prefix sum, all vectorised."""
    with np.errstate(over="ignore"):
        sums = np.empty(len(raw) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTES[raw] * _power("up", len(raw)), out=sums[1:])
        own = (sums[ends] - sums[starts]) * _power("down", len(raw) + 1)[starts]
        return mix(own ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words of a batch of texts as 64-bit hashes: ``hashes``, and of each text its range ``at[i]:at[i+1]``."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        if lower:
            raw = _LOWER[raw]
        self.raw = raw
        self.starts, self.ends = word_bounds(raw)
        self.hashes = hash_spans(raw, self.starts, self.ends)
        #: One byte stands after each text, so its end is where the next begins, less one.
        offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
        self.at = np.searchsorted(self.starts, offsets)


def slices(batch: pa.RecordBatch, column: int, budget: int = 1_000_000) -> Iterator[tuple[int, int, list[str | None]]]:
    """Ranges of rows whose texts in ``column`` have about ``budget`` bytes (one row at least), and the texts: neither
    they nor numpy's working arrays are ever made for a whole batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + budget, side="right")))
        yield begin, end, batch.column(column).slice(begin, end - begin).to_pylist()
        begin = end


#: Where a text may be cut: before a single space or line feed between non-spaces.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: White space that keeps a text from being cut at every space and line feed; none lies beyond U+3000.
_OTHER = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: A piece that any of the vocabularies takes as letters and a run of ASCII marks (but for the apostrophe).
_PLAIN = re.compile(r"([ \n]?)([^\W\d_]*)([!-&(-/:-@[-`{-~]*)")
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


class _Generations(dict):
    """A bounded cache: when full, entries that aren't asked for again until it is full once more are dropped. An entry
    counts by its length, so that long pieces don't make it large."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.used, self.old = make, most, 0, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if self.used >= self.most:
            self.old, self.used = dict(self), 0
            self.clear()
        self.used += 1 + len(key) // 32
        self[key] = found
        return found


class TokenCache:
    """Encodes texts with a ``tokenizers`` file, each distinct piece once: byte-level BPE with the usual pattern.

    No token crosses a place where ``_CUT`` cuts, so the ids of a text are those of its pieces in turn. Letters with
    marks go to the file's model at once; other pieces through the whole tokenizer. The ids are little-endian unsigned
    32-bit integers, as bytes. ``spaced``: the vocabulary keeps white space, as part of the word that follows.
    """

    _open: dict[tuple[str, bool], TokenCache] = {}

    def __init__(self, path: str, spaced: bool, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.spaced = self.tokenizer.model, spaced
        # Byte-level vocabularies write each byte as one printable character.
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.bytes = {b: chr(b if b in set(kept) else next(rest)) for b in range(256)}
        self.words, self.known = _Generations(self._word, most), _Generations(self._piece, most)
        self.after_space = _Generations(lambda p: self._piece(p if p[:1] == "\n" else " " + p), most)

    @classmethod
    def get(cls, path: str, spaced: bool) -> TokenCache:
        """One for each Python worker."""
        if (path, spaced) not in cls._open:
            cls._open[path, spaced] = cls(path, spaced)
        return cls._open[path, spaced]

    def _ids(self, written: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _word(self, word: str) -> bytes:
        written = word if word.isascii() and word.isalpha() else "".join(map(self.bytes.__getitem__, word.encode()))
        return self._ids(written)

    def _piece(self, piece: str) -> bytes:
        bare = piece[1:] if piece[:1] == " " else piece
        letters = bare.rstrip(_MARKS)
        if letters.isalpha() and (self.spaced or letters.isascii()):  # most pieces are a word, after a space or none
            if len(letters) < len(bare):  # with marks: the word itself is a piece too
                word = self.after_space if self.spaced and bare is not piece else self.known
                return word[letters] + self.words[bare[len(letters) :]]
            written = bare if bare.isascii() else "".join(map(self.bytes.__getitem__, bare.encode()))
            return self._ids((self.bytes[32] + written if bare is not piece else written) if self.spaced else written.lower())
        plain = _PLAIN.fullmatch(piece)
        space, letters, marks = plain.groups() if plain else ("", "?", "")
        if not self.spaced and not letters.isascii():
            letters = unicodedata.normalize("NFC", letters).lower() if "\u03a3" not in letters else "?"  # whose lower case depends on its place
        if letters and not letters.isalpha():
            return np.asarray(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        if not self.spaced:
            letters = letters.lower()
            if not marks:
                return self._word(letters) if letters else b""
            return (self.words[letters] if letters else b"") + self.words[marks]
        out = self.words[space] if space == "\n" or space and not letters and not marks else b""
        space = "" if space == "\n" else space
        if letters:
            return out + self.words[space + letters] + (self.words[marks] if marks else b"")
        return out + (self.words[space + marks] if marks else b"")

    def _irregular(self, text: str) -> bool:
        """Whether white space stands anywhere but once before a word."""
        return "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1] in " \n" or any(c in text for c in _OTHER)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text. Each distinct piece of ``texts`` is looked up once, so a few million bytes at a time
        are best."""
        texts = [t or "" for t in texts]
        odd = {i for i, t in enumerate(texts) if self.spaced and t and self._irregular(t)}
        whole = pa.array(["" if i in odd else t for i, t in enumerate(texts)], pa.large_string())
        lists = pc.split_pattern(pc.replace_substring(whole, "\n", " \n" if self.spaced else " "), " ")
        named, offsets = lists.values.dictionary_encode(), np.asarray(lists.offsets)
        cache = self.after_space if self.spaced else self.known
        found = pa.array(map(cache.__getitem__, named.dictionary.to_pylist()), pa.large_binary()).take(named.indices)
        ends, data = np.frombuffer(found.buffers()[1], np.int64), memoryview(found.buffers()[2] or b"")
        if not self.spaced:  # white space between words is dropped
            at = ends[offsets].tolist()
            return [bytes(data[a:b]) for a, b in itertools.pairwise(at)]
        firsts = lists.values.take(lists.offsets[:-1]).to_pylist()  # no space stands before them
        out = [(self.known[f] if f else b"") + bytes(data[a:b]) for f, a, b in zip(firsts, ends[offsets[:-1] + 1].tolist(), ends[offsets[1:]].tolist(), strict=True)]
        for i in odd:
            out[i] = b"".join(map(self.known.__getitem__, _CUT.split(texts[i])))
        return out
