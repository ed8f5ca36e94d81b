"""N-gram Jaccard self-join of documents: a size-aware heavy-light join, and the components of its links.

A document is the set of its five-word shingles, as 64-bit hashes. Light sets (few shingles) enumerate all subsets of a
size that only the larger size of a pair fixes; linked sets share one. Heavy sets are filed in inverted lists under
their rarest shingles: of two linked sets, each has so few shingles that the other lacks that some list holds both. The
lists are scanned. The boundary is where enumeration gets dearer than scanning.

All sets of lists with one first set are a group. A bitmap of parities bounds from below in how many shingles two sets
differ; what no other set of its group can link with, by sizes and bitmaps, is out. Each set of a group is compared with
its first; linked ones become one component, and what is still apart in a group is compared pair by pair, in chunks. An
exact count of common shingles decides every link. The order of shingles by rarity bears on the length of lists, never
on what is found, and bitmaps rule out only what can't link.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, mix, slices, written
from .connected import components

SHINGLE = 5
#: A link: SHARE[1] * common >= SHARE[0] * union.
SHARE = (4, 5)
#: How dear a list entry to be scanned is, in enumerated subsets.
SCAN = 8.0
#: Counters that tell frequent shingles from rare ones (one byte each is sent to all tasks), in blocks that are summed.
COUNTERS, BLOCK = 1 << 21, 1 << 16
#: Sets that one task compares with a first set, and sets of a chunk whose pairs one task compares.
STAR, SETS = 4_000, 2_000
#: Names a task remembers so as to file equal sets once.
SEEN = 200_000
#: Bits of the filter of candidate sets, at most (8 MB); what it lets through in vain is dropped by a join.
FILTER_BITS = 1 << 26
#: Rows of pairs of names up to which they are broadcast to the sets (24 MB); beyond, both sides are shuffled.
NAMES = 1 << 20
#: Least bits of a set's bitmap; larger sets have as many as members, or up to twice that.
PARITIES = 1024


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, without words none."""
    words = Words(texts, lower=True)
    h, n = words.hashes, np.diff(words.at)
    with np.errstate(over="ignore"):
        rolled = h.copy()
        for j in range(1, SHINGLE):
            rolled[: len(h) - j] = rolled[: len(h) - j] * np.uint64(0x9E3779B97F4A7C15) + h[j:]
        rolled = mix(rolled)
        out = []
        for a, k in zip(words.at[:-1].tolist(), n.tolist(), strict=True):
            if k >= SHINGLE:
                out.append(np.unique(rolled[a : a + k - SHINGLE + 1]))
            elif k:
                one = np.uint64(k)
                for x in h[a : a + k]:
                    one = one * np.uint64(0x9E3779B97F4A7C15) + x
                out.append(mix(np.array([one ^ np.uint64(0x5851F42D4C957F2D)])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_name(s: np.ndarray) -> int:
    """A 64-bit hash of a set; equal sets are one node of the join."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].view(np.int64))


def smallest_partner(n: int) -> int:
    return -(-SHARE[0] * n // SHARE[1])


def largest_partner(n: int) -> int:
    return SHARE[1] * n // SHARE[0]


def least_common(a: int, b: int) -> int:
    return -(-SHARE[0] * (a + b) // (SHARE[0] + SHARE[1]))


def prefix_length(n: int) -> int:
    """In how many lists a heavy set is filed: a linked set lacks fewer of its shingles, whatever their order."""
    return n - smallest_partner(n) + 1


def subsets(n: int) -> list[tuple[int, int]]:
    """Of a light set: the larger size of a pair, and the size of the subsets that are enumerated for it."""
    return [(b, k) for b in range(n, largest_partner(n) + 1) if (k := least_common(smallest_partner(b), b)) <= n]


@lru_cache(None)
def light_bound() -> int:
    """The largest size up to which enumerating subsets is no dearer than scanning lists."""
    n = 1
    while sum(math.comb(n, k) for _, k in subsets(n)) <= SCAN * prefix_length(n):
        n += 1
    return n - 1


def signatures(s: np.ndarray, rarity: np.ndarray | None = None) -> np.ndarray:
    """The lists a set is filed in: sets that link share one of these hashes. ``rarity``: a level for each residue of
    hashes, the lower the rarer."""
    n, out, light = len(s), [], light_bound()
    mixed = mix(s ^ np.uint64(0xE7037ED1A0B428DB))
    with np.errstate(over="ignore"):
        if n <= largest_partner(light):  # the smaller one of a pair is light
            for b, k in subsets(n) if n <= light else [x for x in subsets(n) if x[0] == n]:
                out.append(mix(np.array([mixed[list(c)].sum(dtype=np.uint64) for c in combinations(range(n), k)], np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(b)))
        if n > light:  # both are heavy
            first = np.arange(n) if rarity is None else np.argsort(rarity[(s & np.uint64(len(rarity) - 1)).astype(np.int64)], kind="stable")
            out.append(mixed[first[: prefix_length(n)]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def count_common(one: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many members each of ``sets`` has in common with ``one``."""
    flat = np.concatenate(sets)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    return np.add.reduceat(hit, np.cumsum([0] + [len(s) for s in sets[:-1]]), dtype=np.int64)


def are_linked(common: np.ndarray, a: int | np.ndarray, b: int | np.ndarray) -> np.ndarray:
    return SHARE[1] * common >= SHARE[0] * (a + b - common)


def parities(s: np.ndarray) -> np.ndarray:
    """Of each residue of hashes, whether the set has an odd number of them: in as many bits as two such bitmaps differ,
    their sets differ in at least as many members."""
    n = max(PARITIES, 1 << int(len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1)


class Bitmaps:
    """Sets of a group in order of their sizes, as bitmaps. Residues of half as many are the halves, put together."""

    def __init__(self, maps: list[bytes], size: np.ndarray):
        self.order = np.argsort(size, kind="stable")
        self.size = size[self.order]
        self.width = np.array([len(maps[i]) // 8 for i in self.order])
        self.folded, rows = {}, [np.frombuffer(maps[i], np.uint64) for i in self.order]
        for w in sorted(set(self.width.tolist()), reverse=True):
            begin, last = int(np.searchsorted(self.width, w)), int(np.searchsorted(self.width, w, side="right"))
            above = self.folded.get(w * 2)
            if above is None and last < len(rows):  # wider ones, none of twice the width
                above = min((x for k, x in self.folded.items() if k > w), key=lambda x: x.shape[1])
            while above is not None and above.shape[1] > w:
                above = above[:, : above.shape[1] // 2] ^ above[:, above.shape[1] // 2 :]
            own = np.stack(rows[begin:last])
            self.folded[w] = own if above is None else np.concatenate([own, above])
        self.begin = {w: int(np.searchsorted(self.width, w)) for w in self.folded}

    def partners(self, i: int) -> np.ndarray:
        """Places after ``i`` of sets that can link with its."""
        n, w = int(self.size[i]), int(self.width[i])
        end = int(np.searchsorted(self.size, largest_partner(n), side="right"))
        own = self.folded[w]
        differ = np.bitwise_count(own[i + 1 - self.begin[w] : end - self.begin[w]] ^ own[i - self.begin[w]]).sum(1, dtype=np.int64)
        return np.flatnonzero((SHARE[0] + SHARE[1]) * differ <= (SHARE[1] - SHARE[0]) * (n + self.size[i + 1 : end])) + i + 1


def links_of_group(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what is still apart: pairs of sets whose components, to begin with ``root``, differ. Where
    ``side`` has two values, only pairs of both."""
    maps = Bitmaps([parities(s).tobytes() for s in sets], np.array([len(s) for s in sets]))
    _, comp = np.unique(root, return_inverse=True)
    order, size = maps.order, maps.size
    comp, side, crossing, found = comp[order], side[order], len(np.unique(side)) > 1, []
    for i in range(len(sets) - 1):
        if (comp[i + 1 :] == comp[i]).all():
            continue
        rest = maps.partners(i)
        if crossing:
            rest = rest[side[rest] != side[i]]
        for b in range(0, len(rest), 64):
            part = rest[b : b + 64]
            part = part[comp[part] != comp[i]]
            if not len(part):
                continue
            for j in part[are_linked(count_common(sets[order[i]], [sets[order[j]] for j in part.tolist()]), size[i], size[part])].tolist():
                if comp[j] != comp[i]:
                    found.append((int(order[i]), int(order[j])))
                    comp[comp == comp[j]] = comp[i]
    return found


def _read(docs: DataFrame, row: Column) -> DataFrame:
    """All rows of ``docs``, and after them each task's counts of shingles: how many of its sets have one, for each
    residue of hashes. A set counts once where a task remembers it."""
    slim = docs.select(row.alias("row"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    fields = [("id", T.LongType()), ("n_shingles", T.LongType()), ("name", T.LongType()), ("map", T.BinaryType()), ("block", T.IntegerType()), ("counts", T.BinaryType())]
    schema = T.StructType().add("row", slim.schema["row"].dataType).add("doc_id", T.LongType())
    for name, kind in fields:
        schema = schema.add(name, kind)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, at, kind = np.zeros(COUNTERS, np.uint32), set(), TaskContext.get().partitionId() << 33, None
        for batch in found:
            kind = batch.column(0).type
            known = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            for a, b, own in slices(batch, 1):
                names, sizes, maps = [], [], []
                for i, s in enumerate(shingle_sets(own)):
                    name = set_name(s) if len(s) else None
                    sizes.append(len(s))
                    names.append(name)
                    maps.append(parities(s).tobytes() if len(s) else None)
                    if len(s) and known[a + i] and name not in seen:
                        if len(seen) < SEEN:
                            seen.add(name)
                        counts[(s & np.uint64(COUNTERS - 1)).astype(np.int64)] += np.uint32(1)  # residues of one set meet seldom
                n = b - a
                cols = [batch.column(0).slice(a, n), batch.column(2).slice(a, n), pa.array(np.arange(at, at + n)), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(maps, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, schema.names)
                at += n
        parts = counts.reshape(-1, BLOCK)
        for b in np.flatnonzero(parts.any(1)).tolist():
            cols = [pa.nulls(1, kind), *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())), pa.array([b], pa.int32()), pa.array([zlib.compress(parts[b].tobytes(), 1)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return written(slim.mapInArrow(run, schema), "shingled")


def _rarity(counts: DataFrame) -> np.ndarray:
    """How rare shingles are: for each residue of hashes the logarithm of how many sets have one, in quarters of a
    doubling. Counts come together block by block, so that the driver gets one row a block."""

    def add(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of their blocks: the sum of each."""
        block, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.round(4 * np.log2(1.0 + total)).astype(np.uint8).tobytes()], pa.binary())], ["block", "level"])
        for batch in found:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != block:
                    if block is not None:
                        yield row()
                    block, total = b, np.zeros(BLOCK, np.uint64)
                total += np.frombuffer(zlib.decompress(data.as_py()), np.uint32)
        if block is not None:
            yield row()

    levels = counts.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, level binary")
    out = np.zeros(COUNTERS, np.uint8)
    for r in levels.collect():  # COUNTERS bytes
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["level"], np.uint8)
    return out


def _groups(texts: DataFrame, rarity) -> DataFrame:
    """least and name: the sets that share a list with one of a smaller name, the least of the list."""

    def sign(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = rarity.value, set()
        for batch in found:
            for _, _, own in slices(batch, 0):
                names, sigs = [], []
                for s in shingle_sets(own):
                    if len(s) and (name := set_name(s)) not in seen:
                        if len(seen) < SEEN:
                            seen.add(name)
                        names.append(name)
                        sigs.append(signatures(s, levels))
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(names, np.int64), [len(x) for x in sigs]))], ["sig", "name"])

    def gather(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order, so of the list that a batch ends in nothing is held but its least name."""
        last, first = None, None
        for batch in found:
            sig, name = (np.asarray(c) for c in batch.columns)
            if not len(sig):
                continue
            begin = np.concatenate([[True], sig[1:] != sig[:-1]])
            least = np.repeat(name[begin], np.diff(np.concatenate([np.flatnonzero(begin), [len(sig)]])))
            if sig[0] == last:
                least[sig == last] = first
            last, first = sig[-1], least[-1]
            pairs = np.stack([least, name])[:, least != name]
            if pairs.shape[1]:
                pairs = pairs[:, np.lexsort(pairs)]
                pairs = pairs[:, np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(0)])]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["least", "name"])

    filed = texts.mapInArrow(sign, "sig long, name long").repartition("sig").sortWithinPartitions("sig", "name")
    return written(filed.mapInArrow(gather, "least long, name long").distinct(), "groups")


def _in_chunks(groups: DataFrame, chunk: int) -> DataFrame:
    """``groups`` (grp, name) dealt to tasks: lo, hi and mine are 0 but for groups of more than ``chunk`` rows, whose
    pairs of chunks each get a task."""
    sizes = groups.groupBy("grp").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    dealt = groups.join(sizes, "grp").withColumn("mine", F.pmod(F.xxhash64("name"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("chunks", "other")


def _by_task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each grp, lo and hi, which come in order; of a single row none."""
    held: pa.Table | None = None
    for batch in found:
        t = pa.Table.from_batches([batch])
        held = t if held is None or not len(held) else pa.concat_tables([held, t]).combine_chunks()
        key = np.stack([held[c].to_numpy() for c in ("grp", "lo", "hi")])
        at = 0
        for c in (np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist():
            if c - at > 1:
                yield held.slice(at, c - at)
            at = c
        held = held.slice(at)
    if held is not None and len(held) > 1:
        yield held


def _near(groups: DataFrame, maps: DataFrame, chunk: int) -> DataFrame:
    """Those rows of ``groups`` (grp, name) that sizes and bitmaps let link with another of their group."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_task(found):
            maps = Bitmaps(t["map"].to_pylist(), t["n_shingles"].to_numpy())
            side, on = t["mine"].to_numpy()[maps.order], np.zeros(len(t), bool)
            crossing = len(np.unique(side)) > 1
            for i in range(len(t) - 1):
                fits = maps.partners(i)
                if crossing:
                    fits = fits[side[fits] != side[i]]
                if len(fits):
                    on[maps.order[i]] = True
                    on[maps.order[fits]] = True
            if on.any():
                yield pa.RecordBatch.from_arrays([pa.array(t[c].to_numpy()[on]) for c in ("grp", "name")], ["grp", "name"])

    dealt = _in_chunks(groups, chunk).join(maps, "name").select("grp", "lo", "hi", "mine", "name", "n_shingles", "map")
    return dealt.repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi").mapInArrow(run, "grp long, name long").distinct()


def _filter(names: DataFrame, n_names: int) -> tuple[int, np.ndarray]:
    n_bits = 1 << min(FILTER_BITS.bit_length() - 1, max(10, (n_names * 64).bit_length()))
    bit = names.select(F.shiftright(F.col("name").bitwiseAND(n_bits - 1), 6).alias("word"), F.expr("shiftleft(1L, cast(name & 63 as int))").alias("bit"))
    out = np.zeros(n_bits // 64, np.int64)
    for r in bit.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # one row for each word of the filter
        out[r["word"]] = r["bits"]
    return n_bits, out


def _sets(texts: DataFrame, names: DataFrame) -> DataFrame:
    """name and members of the sets that have one of ``names``, once each."""
    n_bits, filter_ = _filter(names, names.count())
    shared = texts.sparkSession.sparkContext.broadcast(filter_)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, set()
        for batch in found:
            for _, _, own in slices(batch, 0):
                rows = {}
                for s in shingle_sets(own):
                    name = set_name(s) if len(s) else 0
                    if len(s) and int(known[(name & (n_bits - 1)) >> 6]) >> (name & 63) & 1 and name not in seen:
                        if len(seen) < SEEN:
                            seen.add(name)
                        rows[name] = s.tobytes()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.binary())], ["name", "members"])

    found = texts.mapInArrow(run, "name long, members binary").join(names, "name", "left_semi")
    return written(found.groupBy("name").agg(F.first("members").alias("members")), "candidates")


def _sent(names: DataFrame) -> DataFrame:
    """A written table of names, to be broadcast where it is small."""
    return F.broadcast(names) if names.count() <= NAMES else names


def _compared(pairs: DataFrame, sets: DataFrame, star: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) that link. The rows of one a are split among tasks of ``star`` of them."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / star).alias("n"))
    dealt = _sent(written(pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("salt")), "pairs"))
    first = _sent(written(dealt.select("a", "salt").distinct(), "firsts")).join(sets.withColumnRenamed("name", "a"), "a").select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("b"), "members")
    others = dealt.join(sets.withColumnRenamed("name", "b"), "b").select("a", "salt", F.lit(1).alias("role"), "b", "members")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, one = None, None
        for batch in found:
            a, role, b = (np.asarray(batch.column(c)) for c in range(3))
            edges = [0, *(np.flatnonzero((role[1:] == 0) | (a[1:] != a[:-1])) + 1).tolist(), len(a)] if len(a) else []
            for f, e in zip(edges[:-1], edges[1:]):
                if role[f] == 0:
                    own, one, f = a[f], np.frombuffer(batch.column(3)[f].as_py(), np.uint64), f + 1
                for at in range(f, e, 256):
                    part = slice(at, min(at + 256, e))
                    held = [np.frombuffer(x, np.uint64) for x in batch.column(3).slice(at, part.stop - at).to_pylist()]
                    on = are_linked(count_common(one, held), len(one), np.array([len(x) for x in held]))
                    if on.any():
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(int(on.sum()), own, np.int64)), pa.array(b[part][on])], ["a", "b"])

    return first.union(others).repartition("a", "salt").sortWithinPartitions("a", "salt", "role").select("a", "role", "b", "members").mapInArrow(run, "a long, b long")


def _rest(near: DataFrame, first: DataFrame, roots: DataFrame, sets: DataFrame, chunk: int) -> DataFrame:
    """Links (a, b) between what is still apart in the groups ``near``, but for the first of each, which was compared
    with all others."""
    named = near.join(first, "grp").where("name <> a").drop("a")
    named = named.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    open_ = named.groupBy("grp").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("grp")
    rest = written(named.join(open_, "grp"), "rest")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_task(found):
            names = t["name"].to_numpy()
            links = links_of_group([np.frombuffer(x, np.uint64) for x in t["members"].to_pylist()], t["root"].to_numpy(), t["mine"].to_numpy())
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(names[[x[k] for x in links]]) for k in range(2)], ["a", "b"])

    dealt = _sent(written(_in_chunks(rest, chunk), "rest")).join(sets, "name").select("grp", "lo", "hi", "mine", "name", "root", "members")
    return dealt.repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi").mapInArrow(run, "a long, b long")


def _named(docs: DataFrame, row: Column, star: int = STAR, chunk: int = SETS) -> tuple[DataFrame, DataFrame]:
    """All rows of ``docs`` with ``row``, id, doc_id, n_shingles and name; and of each name its component_id."""
    texts = docs.where("doc_id is not null and text is not null").select("text")
    read = _read(docs, row)
    rows = read.where("block is null")
    rarity = docs.sparkSession.sparkContext.broadcast(_rarity(read.where("block is not null").select("block", "counts")))
    stars = _groups(texts, rarity)
    groups = stars.select(F.col("least").alias("grp"), "name")
    groups = groups.union(groups.select("grp", F.col("grp").alias("name")).distinct())
    maps = rows.where("name is not null and doc_id is not null").groupBy("name").agg(F.first("n_shingles").alias("n_shingles"), F.first("map").alias("map"))
    near = written(_near(groups, maps, chunk), "near")
    sets = _sets(texts, near.select("name").distinct())

    # Every set meets the first of its groups: one of them before the others, which that may settle.
    first = near.groupBy("grp").agg(F.min("name").alias("a"))
    pairs = near.join(first, "grp").where("a <> name").select("a", F.col("name").alias("b")).distinct()
    one = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = written(_compared(one, sets, star), "links")
    joined = links.select(F.col("b").alias("node"), F.col("a").alias("top"))
    label = lambda df, c: df.join(joined.select(F.col("node").alias(c), F.col("top").alias(f"_{c}")), c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))
    others = label(label(pairs.join(one, ["a", "b"], "left_anti"), "a"), "b").where("_a <> _b").select("a", "b")
    links = written(links.union(_compared(others, sets, star)), "links")
    roots = components(links)
    links = links.union(_rest(near, first, roots, sets, chunk))
    tops = components(links).select(F.col("node").alias("name"), F.col("root").alias("top"))

    # The smallest doc_id of each component.
    least = rows.where("name is not null and doc_id is not null").groupBy("name").agg(F.min("doc_id").alias("least")).join(tops, "name", "left").withColumn("top", F.coalesce("top", "name"))
    least = written(least, "components")
    by_name = least.join(least.groupBy("top").agg(F.min("least").alias("component_id")), "top").select("name", "component_id")
    return rows.select("row", "id", "doc_id", "n_shingles", "name"), by_name


def near_documents(docs: DataFrame, keep: tuple[str, ...] = (), star: int = STAR, chunk: int = SETS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with n_shingles and component_id, after the columns of ``keep``.

    component_id is the smallest doc_id that links reach from the row. Null and blank texts have no shingles and link
    with nothing. Rows of one doc_id are rows of their own. A row with a null doc_id is not linked with anything, and
    its component_id is null. An empty table gives no rows. Equal sets are one node, however many rows have them.
    Columns of ``keep`` may have any names, those of the result but for doc_id too.
    """
    rows, by_name = _named(docs, F.struct("doc_id", *keep), star, chunk)
    linked = rows.where("name is not null and doc_id is not null").join(by_name, "name").select("row.*", "n_shingles", "component_id")
    alone = rows.where("name is null or doc_id is null").select("row.*", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that stay when one document of each component does: that
    of the smallest doc_id. Rows with a null doc_id stay, and so do those without words. Of several rows of one doc_id
    with words, one stays: the first of its partition with the least number. An empty table gives no rows."""
    rows, by_name = _named(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    own = rows.where("name is not null and doc_id is not null").select("id", "doc_id", "name").join(by_name, "name").where("doc_id = component_id")
    kept = own.groupBy("doc_id").agg(F.min("id").alias("id")).select("id")
    linked = rows.where("name is not null and doc_id is not null").join(kept, "id", "left_semi")
    return linked.select("row.*").union(rows.where("name is null or doc_id is null").select("row.*"))
