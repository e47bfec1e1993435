"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection of sorted arrays.

1. Each document becomes the sorted names of its distinct word n-grams. Documents with equal sets form a
   class; everything below works on classes.
2. Two sets that link share an element among the first ``size - ceil(t * size) + 1`` of each, in any
   common order. The order used puts n-grams of rare words first and elements that many documents share
   last; it affects speed only. Two sets of like sizes even share many of those elements. Classes that
   share as many as a link needs are drawn into one candidate group, so links never leave a group.
3. A group is cut into tiles: blocks of a size band against blocks of the same or the next band, as sizes
   of linked sets differ by the factor ``t`` at most. A group that fits a block is one tile; in every tile
   the rows stand by size, and a row meets its own band of sizes only.
4. In a tile, hashed bitmaps bound each pair's intersection from above by bit counts. For pairs that
   remain, the sorted arrays are merged once for the tile, which gives each element its rank, and the
   pairs' rank arrays are intersected exactly.

A tile gives, for each class, the smallest class it is joined with inside the tile and its number of
links; pairs are never written out. Components of the tiles' results are the join's components.

Defined results: a document with fewer words than n is the whole sequence as one n-gram; null, empty and
blank texts have no n-gram, link with nothing and are their own component; copies are links of each
other; repeated rows are documents like others; texts are read whole; an empty table gives an empty
table; further columns are ignored. An n-gram's name holds a 58-bit hash, and equal names count as equal
n-grams. A class has a 64-bit name; different sets that share one are told apart by a second hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.checkpoints import cut, shared_table
from grainmill.llm.common import extend, lower_ascii, mix, slices, tidied, word_hashes
from grainmill.operators.graph import components, smallest_labels
from grainmill.operators.skew import join_counted
from grainmill.shipping import ship
from grainmill.tables import table

#: Common elements and frequent words known by name, at most; elements a task counts together to find them.
COMMON, WORDS, CHUNK = 1 << 18, 1 << 16, 2_000_000
#: Documents of an element for each part that the element is dealt to.
PART_ROWS = 512
#: Classes and bytes of sets in a block of a tile, at most on average.
BLOCK_ROWS, BLOCK_BYTES = 2048, 16 << 20


@dataclass(frozen=True)
class Words:
    """Hashes of frequent words, sorted, and their weights: the more frequent, the heavier."""

    hashes: np.ndarray
    weights: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.weights[at], 0.0)


NO_WORDS = Words(np.zeros(0, np.uint64), np.zeros(0))


def ngrams(text: str | None, n: int, words: Words = NO_WORDS) -> np.ndarray:
    """Sorted names of the distinct word n-grams: six bits of how frequent the words are, then a 58-bit hash.

    N-grams of rare words come first in the order; few documents share those by chance.
    """
    h = word_hashes(lower_ascii(text))
    if not len(h):
        return h
    k = min(n, len(h))
    last = len(h) - k + 1
    acc, level, weight = np.full(last, k, np.uint64), np.zeros(last), words.of(h)
    for i in range(k):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : last + i])
        level += weight[i : last + i]
    return np.unique((np.minimum(level, 63).astype(np.uint64) << np.uint64(58)) | (acc >> np.uint64(6)))


def class_of(s: np.ndarray, salt: int = 0xA5A5A5A5A5A5A5A5) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(s ^ np.uint64(salt))) ^ (np.bitwise_xor.reduce(s) * np.uint64(31)) + np.uint64(len(s))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def told_apart(sets: DataFrame) -> DataFrame:
    """``sets`` (cls, check, ...) with new names for classes whose sets differ in their second hash.

    Two different sets among 10^10 share a name a few times by chance, so the list of such names is short.
    """
    shared = [r.cls for r in sets.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("check").alias("a"), F.max("check").alias("b")).filter("a <> b").select("cls").collect()]
    name = F.when(F.col("cls").isin(shared), F.xxhash64("cls", "check")).otherwise(F.col("cls")) if shared else F.col("cls")
    return sets.withColumn("cls", name).drop("check")


def sets_of(df: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, cls, check, grams): ``cls`` is null for documents without n-grams."""
    docs = df.select("doc_id", F.col(text_col).alias("text"))
    words = df.sparkSession.sparkContext.broadcast(frequent_words(docs))  # at most WORDS entries

    def kernel():
        w = words.value

        def run(texts: pa.Array) -> list:
            sets = [ngrams(t, n, w) for t in texts.to_pylist()]
            return [pa.array([len(s) for s in sets], pa.int64()), *[pa.array([class_of(s, salt) if len(s) else None for s in sets], pa.int64()) for salt in (0xA5A5A5A5A5A5A5A5, 0x3C6EF372FE94F82B)], pa.array([s.tobytes() for s in sets], pa.binary())]

        return run

    return extend(docs, ["text"], "n_shingles long, cls long, check long, grams binary", kernel).drop("text")


def counted(df: DataFrame, arrays, least: int) -> DataFrame:
    """(e, c): sums over tasks of what a chunk of a task's elements holds ``least`` times or more.

    ``arrays`` gives a batch's arrays of 64-bit elements.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            e, c = np.unique(np.concatenate(held), return_counts=True)
            often = c >= least
            return pa.RecordBatch.from_arrays([pa.array(e[often].view(np.int64)), pa.array(c[often])], names=["e", "c"])

        for b in batches:
            for x in arrays(b):
                held.append(x)
                size += len(x)
                if size > CHUNK:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return cut(df.mapInArrow(tidied(run), "e long, c long").groupBy("e").agg(F.sum("c").alias("c")))


def most_frequent(sums: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The elements of the largest counts, at most ``limit``, sorted by element, with their counts.

    A histogram of the counts gives the least count to take, so what reaches the driver is bounded.
    """
    step = F.floor(F.log2("c") * 4).cast("int")
    total, least = 0, None
    for s in sums.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += s["count"]
        if total > limit:
            break
        least = s["step"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    t = sums.filter(step >= least).toArrow()
    e, c = t["e"].to_numpy().view(np.uint64), t["c"].to_numpy()
    order = np.argsort(e)
    return e[order], c[order]


def frequent_words(docs: DataFrame) -> Words:
    """Counts the words of all texts; a word's weight is the log of its count in units of the least one kept."""
    sums = counted(docs.select("text"), lambda b: (word_hashes(lower_ascii(t)) for t in b.column("text").to_pylist()), 8)
    e, c = most_frequent(sums, WORDS)
    return Words(e, np.log2(c / c.min() + 1)) if len(e) else NO_WORDS


def common_elements(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Elements that many documents share, sorted, with their counts over all documents."""
    return most_frequent(counted(sets.select("grams"), lambda b: (np.frombuffer(g, np.uint64) for g in b.column("grams").to_pylist()), 4), COMMON)


def least_overlap(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def prefix(s: np.ndarray, common: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The elements of a set of which a linked set has at least one in its own prefix."""
    p = len(s) - least_overlap(len(s), percent) + 1
    if not len(common):
        return s[:p]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    known = common[at] == s
    rare = s[~known]
    if len(rare) >= p:
        return rare[:p]
    own, c = s[known], counts[at[known]]
    return np.concatenate([rare, own[np.lexsort((own, c))][: p - len(rare)]])


def least_shared(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """How many prefix elements sets of sizes a and b have in common at least, if they link.

    Of two prefixes, one ends first in the common order; what both sets share up to there is in both
    prefixes. The rest of that set, ``least_overlap - 1`` elements, holds what else they can share.
    """
    both = -(-percent * (a + b) // (100 + percent))
    return np.maximum(1, both - (-(-percent * np.maximum(a, b) // 100)) + 1)


def shared_entries(sets: DataFrame, percent: int, most: int, part_rows: int = PART_ROWS) -> DataFrame:
    """(kind, a, b, least) from the classes' prefix elements that two or more classes have.

    Kind 0 is a pair of classes that share an element and whose sizes let them link, once for each element;
    ``least`` is how many they must share. Of an element that more than ``most`` classes have, kind 1 joins
    each class a with the element's least class b. An element that very many documents have is dealt to parts
    of about ``part_rows``; in a part kind 1 joins the classes, and kind 2 names the element a and the part's
    least class b. Elements of one class give nothing.
    """
    shared = sets.sparkSession.sparkContext.broadcast(common_elements(sets))  # at most COMMON entries

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        many = counts > part_rows
        hot, parts = common[many], -(-counts[many] // part_rows)
        seen: set[int] = set()
        for b in (piece for whole in batches for piece in slices(whole, ["grams"])):
            es, cs, ns = [], [], []
            for c, g in zip(b.column("cls").to_pylist(), b.column("grams").to_pylist(), strict=True):
                if c not in seen:
                    seen.add(c)
                    es.append(prefix(np.frombuffer(g, np.uint64), common, counts, percent))
                    cs.append(np.full(len(es[-1]), c))
                    ns.append(np.full(len(es[-1]), len(g) // 8, np.int32))
            if es:
                e, c = np.concatenate(es), np.concatenate(cs)
                part = np.zeros(len(e), np.int32)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, e), len(hot) - 1)
                    own = hot[at] == e
                    part[own] = 1 + (mix(c[own].view(np.uint64)) % parts[at[own]].astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)), pa.array(part), pa.array(c), pa.array(np.concatenate(ns))], names=["e", "part", "cls", "n"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch(kind: int, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(least.astype(np.int64))], names=["kind", "a", "b", "least"])

        def out(e: np.ndarray, part: np.ndarray, c: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            keep = np.ones(len(e), bool)
            keep[1:] = (e[1:] != e[:-1]) | (part[1:] != part[:-1]) | (c[1:] != c[:-1])
            e, part, c, n = e[keep], part[keep], c[keep], n[keep].astype(np.int64)
            start = np.flatnonzero(np.concatenate(([True], (e[1:] != e[:-1]) | (part[1:] != part[:-1])))) if len(e) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(e)))
            dealt = part[start] > 0
            if dealt.any():
                yield batch(2, e[start[dealt]], c[start[dealt]], np.ones(dealt.sum()))
            rows, first = np.repeat(size, size), np.repeat(c[start], size)
            many = ((rows > most) | (part > 0)) & (c != first)
            if many.any():
                yield batch(1, c[many], first[many], np.ones(many.sum()))
            few = (rows > 1) & (rows <= most) & (part == 0)
            e, c, n = e[few], c[few], n[few]
            for d in range(1, most):
                at = np.flatnonzero(e[d:] == e[:-d])
                if not len(at):
                    break
                x, y = n[at], n[at + d]
                at = at[100 * np.minimum(x, y) >= percent * np.maximum(x, y)]
                if len(at):
                    yield batch(0, c[at], c[at + d], least_shared(n[at], n[at + d], percent))

        for b in batches:
            own = tuple(b.column(k).to_numpy() for k in ("e", "part", "cls", "n"))
            if not len(own[0]):
                continue
            last = int(np.searchsorted(own[0], own[0][-1]))  # where the batch's last element begins; it may go on
            if last or (held and held[-1][0][-1] != own[0][0]):
                held.append(tuple(x[:last] for x in own))
                yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            held.append(tuple(x[last:] for x in own))
        if held:
            yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    found = sets.select("cls", "grams").mapInArrow(tidied(entries), "e long, part int, cls long, n int")
    return found.repartition("e", "part").sortWithinPartitions("e", "part", "cls").mapInArrow(tidied(tiles), "kind int, a long, b long, least long")


def bounded(percent: int, n: np.ndarray, sig: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    """Those of rows ``js`` that bit counts leave as possible links of row i.

    Each bit that one bitmap has and the other lacks is an element outside the intersection.
    """
    only_i = np.bitwise_count(sig[i] & ~sig[js]).sum(1, dtype=np.int64)
    only_j = np.bitwise_count(sig[js] & ~sig[i]).sum(1, dtype=np.int64)
    most = np.minimum(n[i] - only_i, n[js] - only_j)
    return js[(100 + percent) * most >= percent * (n[i] + n[js])]


def candidate_groups(sets: DataFrame, percent: int, most: int = 256, part_rows: int = PART_ROWS) -> DataFrame:
    """(node, root): classes that may link with another, and the smallest class of their group.

    Classes are drawn together if they share as many prefix elements as a link of their sizes needs; where
    more than ``most`` classes share an element, all are drawn together.
    """
    found = cut(shared_entries(sets, percent, most, part_rows).groupBy("kind", "a", "b").agg(F.count("*").alias("n"), F.max("least").alias("least")).filter("kind > 0 OR n >= least"))
    parts = found.filter("kind = 2").select(F.col("a").alias("e"), F.col("b").alias("u"))
    first = parts.groupBy("e").agg(F.min("u").alias("v"))
    edges = found.filter("kind < 2").select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(parts.join(first, "e").select("u", "v"))
    return components(edges)


def members_filter(nodes: DataFrame) -> np.ndarray:
    """Bits of a Bloom filter of the nodes, at most 16 MB; it may let others pass, which a join drops."""
    bits = 1 << min(27, max(16, (16 * nodes.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, mask = _bits(b.column("node").to_numpy(zero_copy_only=False), bits)
            w, at = np.unique(word.ravel(), return_inverse=True)
            m = np.zeros(len(w), np.uint64)
            np.bitwise_or.at(m, at.ravel(), mask.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(m.view(np.int64))], names=["w", "m"])

    t = nodes.select("node").mapInArrow(run, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[t["w"].to_numpy()] = t["m"].to_numpy().view(np.uint64)
    return out


def _bits(nodes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(nodes.view(np.uint64))
    at = np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)])
    return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))


def sets_among(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cls, grams) once for each class of ``nodes``; a Bloom filter keeps most other sets from moving."""
    bloom = sets.sparkSession.sparkContext.broadcast(members_filter(nodes))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bloom.value
        seen: set[int] = set()
        for b in batches:
            c = b.column("cls").to_numpy(zero_copy_only=False)
            word, mask = _bits(c, len(words) * 64)
            own = ((words[word] & mask) != 0).all(0)
            own &= [not (x in seen or seen.add(x)) if o else False for x, o in zip(c.tolist(), own.tolist(), strict=True)]
            yield b.filter(pa.array(own))

    once = sets.mapInArrow(tidied(near), "cls long, grams binary").groupBy("cls").agg(F.first("grams").alias("grams"))
    return once.join(nodes.select(F.col("node").alias("cls")), "cls", "left_semi")


def tile_links(percent: int, sizes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For rows ``left`` of a tile, the rows ``right`` that link with each; with ``same``, later rows only.

    Both come in the order of their sizes.
    """
    width = 1 << max(7, min(13, int(np.median(sizes) * 2).bit_length()))
    signature = np.zeros((len(sets), width), bool)
    for i, s in enumerate(sets):
        signature[i, (s >> np.uint64(20)) & np.uint64(width - 1)] = True
    packed = np.packbits(signature, axis=1).view(np.uint64)
    del signature
    n = sizes[right]  # ascending
    low, high = np.searchsorted(n, -(-percent * sizes[left] // 100)), np.searchsorted(n, 100 * sizes[left] // percent, "right")
    survivors = {}
    for k, i in enumerate(left):
        band = right[max(k + 1, low[k]) if same else low[k] : high[k]]
        js = bounded(percent, sizes, packed, i, band) if len(band) else band
        if len(js):
            survivors[i] = js
    if not survivors:
        return
    own = np.unique(np.concatenate([np.fromiter(survivors, np.int64), *survivors.values()]))
    own = own[np.lexsort((own, sizes[own]))]
    place = np.full(len(sets), -1)
    place[own] = np.arange(len(own))
    values, ranks = np.unique(np.concatenate([sets[i] for i in own]), return_inverse=True)
    ranks = ranks.astype(np.int32)
    start = np.concatenate(([0], np.cumsum(sizes[own])))
    mark = np.zeros(len(values), bool)
    for i, js in survivors.items():
        mine = ranks[start[place[i]] : start[place[i] + 1]]
        mark[mine] = True
        at = place[js]
        lo, hi = at.min(), at.max() + 1
        if hi - lo <= 2 * len(at):
            held = mark[ranks[start[lo] : start[hi]]]
            overlap = np.add.reduceat(held, start[lo:hi] - start[lo], dtype=np.int64)[at - lo]
        else:
            held = mark[np.concatenate([ranks[start[j] : start[j + 1]] for j in at])]
            overlap = np.add.reduceat(held, np.concatenate(([0], np.cumsum(sizes[js])[:-1])), dtype=np.int64)
        mark[mine] = False
        linked = js[100 * overlap >= percent * (sizes[i] + sizes[js] - overlap)]
        if len(linked):
            yield int(i), linked


def _tiles(percent: int):
    """A task's rows, sorted by tile: for each tile, its classes' least companion and links."""

    def one(rows: list[tuple]) -> pa.RecordBatch | None:
        cls = np.array([r[1] for r in rows])
        copies = np.array([r[2] for r in rows])
        side = np.array([r[3] for r in rows])
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets])
        same = bool((side == 2).all())
        order = np.lexsort((cls, sizes))
        left = order if same else order[side[order] == 0]
        right = order if same else order[side[order] == 1]
        if not len(left) or not len(right):
            return None
        links, us, vs = np.zeros(len(rows), np.int64), [], []
        for i, js in tile_links(percent, sizes, sets, left, right, same):
            links[i] += copies[js].sum()
            links[js] += copies[i]
            us.append(np.full(len(js), i))
            vs.append(js)
            if sum(map(len, us)) > 1_000_000:
                root = smallest_labels(len(rows), np.concatenate(us), np.concatenate(vs))
                us, vs = [np.arange(len(rows))], [root]
        if not us:
            return None
        root = smallest_labels(len(rows), np.concatenate(us), np.concatenate(vs))
        own = links > 0
        return pa.RecordBatch.from_arrays([pa.array(cls[own]), pa.array(cls[root[own]]), pa.array(links[own])], names=["u", "v", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for r in zip(*[b.column(c).to_pylist() for c in ("tile", "cls", "copies", "side", "grams")], strict=True):
                if held and held[0][0] != r[0]:
                    if len(held) > 1 and (out := one(held)) is not None:
                        yield out
                    held = []
                held.append(r)
        if len(held) > 1 and (out := one(held)) is not None:
            yield out

    return run


def tiled(members: DataFrame, percent: int, block_rows: int, block_bytes: int) -> DataFrame:
    """(cls, copies, tile, side) for each tile that a class of ``members`` (root, cls, copies, n) goes to.

    A group that fits a block is one tile. Side 2 is a block that meets itself, 0 and 1 are two blocks. Of others,
    each size band is cut into blocks by a hash of the class; a block meets itself, the other blocks of its band
    and those of the next band. Each pair of blocks is one tile.
    """
    groups = members.groupBy("root").agg(F.count("*").alias("g_rows"), F.sum("n").alias("g_n"))
    big = (F.col("g_rows") > block_rows) | (8 * F.col("g_n") > block_bytes)
    named = members.join(groups, "root")
    small = named.filter(~big).select("cls", "copies", F.col("root").alias("tile"), F.lit(2).alias("side"))
    width = math.log(100 / percent) * 1.0001
    large = cut(named.filter(big).withColumn("band", F.floor(F.log("n") / width).cast("int")))
    cells = cut(large.groupBy("root", "band").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(8 * F.sum("n") / block_bytes)).cast("int").alias("blocks")))
    at = lambda d, name: cells.select("root", (F.col("band") + d).alias("band"), F.col("blocks").alias(name))
    placed = large.join(at(0, "own"), ["root", "band"]).join(at(1, "below"), ["root", "band"], "left").join(at(-1, "above"), ["root", "band"], "left")
    placed = placed.withColumn("i", F.pmod(F.xxhash64("cls", F.lit(5)), F.col("own")).cast("int"))
    none = F.array().cast("array<struct<tile:bigint,side:int>>")
    span = lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)).otherwise(none)
    name = lambda band, i, upper, j: F.xxhash64("root", band, i, upper, j).alias("tile")
    b, i = F.col("band"), F.col("i")
    tiles = F.concat(
        span("own", lambda j: F.struct(name(b, F.least(i, j), b, F.greatest(i, j)), F.when(i == j, 2).otherwise((i > j).cast("int")).alias("side"))),
        span("above", lambda j: F.struct(name(b, i, b + 1, j), F.lit(0).alias("side"))),
        span("below", lambda j: F.struct(name(b - 1, j, b, i), F.lit(1).alias("side"))),
    )
    return small.unionByName(placed.select("cls", "copies", F.explode(tiles).alias("t")).select("cls", "copies", "t.tile", "t.side"))


def join(docs: DataFrame, n: int = 4, percent: int = 85, text_col: str = "text", block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, class_id) for each row of ``docs`` (doc_id, text).

    ``class_id`` is the smallest doc_id with the same set; ``n_links`` counts other rows that link.
    """
    spark = docs.sparkSession
    ship(spark)
    with shared_table(sets_of(docs, n, text_col)) as written:
        written = told_apart(written)
        every = cut(written.select("doc_id", "n_shingles", "cls"))
        sets = written.filter("cls IS NOT NULL").select("cls", "grams")
        nodes = cut(candidate_groups(sets, percent, part_rows=part_rows))
        found = cut(sets_among(sets, nodes))
    named_sets = every.filter("cls IS NOT NULL")
    classes = named_sets.groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"))
    members = cut(nodes.withColumnRenamed("node", "cls").join(classes.select("cls", "copies", "n"), "cls"))
    tiles = found.join(tiled(members, percent, block_rows, block_bytes), "cls")
    links = cut(tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(tidied(_tiles(percent)), "u long, v long, links long"))
    roots = components(links.select("u", "v"))
    n_links = links.groupBy(F.col("u").alias("cls")).agg(F.sum("links").alias("links"))
    joined = classes.join(roots.withColumnRenamed("node", "cls"), "cls").join(n_links, "cls", "left")
    least = joined.groupBy("root").agg(F.min("class_id").alias("component_id"))
    linked = joined.join(least, "root").select("cls", "component_id", "links")
    named = classes.join(linked, "cls", "left").select("cls", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    full = join_counted(named_sets, cut(named), "cls", "copies")
    alone = every.filter("cls IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"))
    return full.select("doc_id", "n_shingles", "component_id", "n_links", "class_id").unionByName(alone)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op2_jaccard": op2_jaccard}
ORACLES: dict[str, str] = {}
