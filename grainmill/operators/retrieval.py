"""Lexical retrieval: terms, BM25, and overlap of content terms."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.checkpoints import cut, drop_cut
from grainmill.operators.skew import join_counted
from grainmill.shipping import ship

# Words that don't tell one memory from another.
STOPWORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "my", "your", "our", "their", "his", "her", "its",
    "i", "you", "we", "they", "it", "this", "that",
    "and", "or", "of", "to", "in", "on", "for", "with", "as", "at",
]


def terms(c: Column) -> Column:
    """X2"""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9']+"), F.lit(0))


def content_terms(c: Column) -> Column:
    return F.array_except(terms(c), F.array(*map(F.lit, STOPWORDS)))


#: Weight of a block of sets at least and at most, as far as there are ``BLOCKS`` of it: a set weighs its terms and ``SET_WEIGHT``. A tile holds two blocks.
LEAST_WEIGHT, BLOCK_WEIGHT, BLOCKS, SET_WEIGHT = 1 << 19, 5 << 19, 24, 256
#: Parts that blocks are dealt to at least, and blocks of a part; shared terms looked at at a time.
LEAST_PARTS, PART_BLOCKS, CELLS = 8, 8, 1 << 18
#: Most frequent terms, whose order by frequency is sent to the tasks; bits of a term's hash.
FREQUENT, HASH_BITS = 1 << 16, 62
#: Terms, and sets, that a task remembers at most.
TASK_TERMS = 1 << 17


def alike(texts: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, other): for each text the first one whose set of content terms has a Jaccard index of 1/2 or
    more with its own, which may be itself; ``texts`` has (doc_id, text). Texts without content terms are like none.

    Sets of sizes n and m that are alike share ``(n + m) / 3`` terms, so their sizes differ by a factor of 2 at
    most. Sets go by size into blocks; of two blocks that meet, a set gives as many of its rarest terms as it
    must for sets that are alike to share some of them (``_dropped``). Only pairs that share enough of them are
    compared. Equal sets count as one.

    Texts are read once: tasks make the sets and count their terms. Terms are hashes, under a seed that gives no
    two terms of the texts the same; the most frequent ones come last in the order of rareness. Sets are packed
    into blocks, which are written once; a tile reads two of them from there, so neither sets nor pairs are
    shuffled for it, and it gives no more than one row a set.
    """
    ship(texts.sparkSession)
    read, frequent = _term_sets(texts, text)
    names = cut(read.filter("k IS NOT NULL").select("doc_id", "k"))
    once = read.filter("t IS NOT NULL").select("doc_id", "n", "k", "t")
    total = once.agg(F.sum(F.col("n") + SET_WEIGHT)).first()[0] or 0
    weight = min(BLOCK_WEIGHT, max(LEAST_WEIGHT, total // BLOCKS))
    ordered = once.repartitionByRange(max(1, -(-total // weight)), "n", "k").sortWithinPartitions("n", "k", "doc_id")
    blocks = cut(ordered.mapInArrow(lambda batches: _blocks(_coded(batches, frequent), weight + weight // 2), _BLOCK).withColumn("i", F.monotonically_increasing_id()))
    drop_cut(read)
    linked = _blocks_met(blocks).groupBy("a").agg(F.min("b").alias("b"))
    first = names.groupBy("k").agg(F.min("doc_id").alias("a")).join(linked, "a", "left").select("k", F.coalesce("b", "a").alias("other"))
    return names.join(first, "k").select("doc_id", "other")


def _hash(term: bytes, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(term, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "big") >> (64 - HASH_BITS)


def _term_sets(texts: DataFrame, text: str) -> tuple[DataFrame, np.ndarray]:
    """What ``_read`` gives under a seed by which no two terms have the same hash, and the hashes of the most frequent terms, rarest first."""
    lowered = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col(text)).cast("binary").alias("t")).filter("t IS NOT NULL")
    for seed in count():
        make = _hash
        x = cut(lowered.mapInArrow(lambda batches: _read(batches, lambda term: make(term, seed)), _SETS))  # noqa: B023
        seen = cut(x.filter("term IS NOT NULL").groupBy("h").agg(F.sum("n").alias("df"), F.min("term").alias("least"), F.max("term").alias("most")))
        if seen.filter("least <> most").isEmpty():
            top = seen.select("h", "df").orderBy(F.desc("df"), "h").limit(FREQUENT).collect()
            drop_cut(seen)
            return x, np.array([r.h for r in reversed(top)], np.int64)
        drop_cut(seen)
        drop_cut(x)


_SETS = "doc_id long, n long, k binary, t binary, term binary, h long"
#: Bytes that are no part of a term become blanks.
_TERM_BYTES = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789'" else 32 for c in range(256))


def _read(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: a text's set (doc_id, n, k, t) with its size, digest and hashes, and terms (n, term, h) with the sets that have them.

    A set that the task gave for an earlier id has no ``t``.
    """
    stop = frozenset(x.encode() for x in STOPWORDS)
    hashes: dict[bytes, int] = {}
    seen: dict[bytes, int] = {}
    counts: Counter[bytes] = Counter()

    def rows(doc_id=None, n=None, k=None, t=None, term=None, h=None) -> pa.RecordBatch:
        given = {"doc_id": (doc_id, pa.int64()), "n": (n, pa.int64()), "k": (k, pa.binary()), "t": (t, pa.binary()), "term": (term, pa.binary()), "h": (h, pa.int64())}
        return pa.RecordBatch.from_arrays([pa.nulls(len(n), ty) if x is None else pa.array(x, ty) for x, ty in given.values()], names=list(given))

    def counted() -> pa.RecordBatch:
        out = rows(n=list(counts.values()), term=list(counts), h=[hashes[x] for x in counts])
        counts.clear()
        hashes.clear()
        return out

    for b in batches:
        ids, ns, ks, ts = [], [], [], []
        for doc_id, t in zip(b.column("doc_id").to_pylist(), b.column("t").to_pylist(), strict=True):
            own = set(t.translate(_TERM_BYTES).split()) - stop
            if not own or doc_id is None:
                continue
            counts.update(own)
            for x in own:
                if x not in hashes:
                    hashes[x] = make(x)
            held = np.sort(np.fromiter(map(hashes.__getitem__, own), np.int64, len(own))).tobytes()
            k = hashlib.sha256(held).digest()
            first = seen.setdefault(k, doc_id) >= doc_id
            seen[k] = min(seen[k], doc_id)
            ids.append(doc_id)
            ns.append(len(own))
            ks.append(k)
            ts.append(held if first else None)
            if len(seen) > TASK_TERMS:
                seen.clear()
        yield rows(doc_id=ids, n=ns, k=ks, t=ts)
        if len(counts) > TASK_TERMS:
            yield counted()
    yield counted()


def _coded(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, terms): the first of equal sets that follow each other, rarest terms first; frequent terms are numbered above all hashes."""
    order = np.argsort(frequent)
    known = frequent[order]
    last = None
    for b in batches:
        for doc_id, k, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "k", "t")), strict=True):
            if k != last:
                last, terms = k, np.frombuffer(t, np.int64)
                at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
                yield doc_id, np.sort(np.where(known[at] == terms, (1 << HASH_BITS) + order[at], terms))


_BLOCK = "least long, most long, ids binary, ns binary, vocabulary binary, terms binary"


def _blocks(sets: Iterator[tuple[int, np.ndarray]], most: int) -> Iterator[pa.RecordBatch]:
    """Sets (doc_id, terms) in blocks, in their order: a block's terms are numbers of places in its vocabulary."""
    held: list[tuple[int, np.ndarray]] = []
    weight = 0

    def out() -> pa.RecordBatch:
        ns = [len(t) for _, t in held]
        vocabulary, terms = np.unique(np.concatenate([t for _, t in held]), return_inverse=True)
        columns = [np.array(x, t).tobytes() for x, t in (([i for i, _ in held], np.int64), (ns, np.int64), (vocabulary, np.int64), (terms, np.int32))]
        return pa.RecordBatch.from_arrays([pa.array([min(ns)], pa.int64()), pa.array([max(ns)], pa.int64()), *[pa.array([x], pa.binary()) for x in columns]], names=["least", "most", "ids", "ns", "vocabulary", "terms"])

    for doc_id, terms in sets:
        if held and weight + len(terms) + SET_WEIGHT > most:
            yield out()
            held, weight = [], 0
        held.append((doc_id, terms))
        weight += len(terms) + SET_WEIGHT
    if held:
        yield out()


def _blocks_met(blocks: DataFrame) -> DataFrame:
    """(a, b): for the sets of two blocks that meet the smallest b < a that is alike, if any.

    Each two parts of the blocks meet in a task, which reads them where they were written; which of two tasks
    takes a pair of blocks goes by their numbers, so all have work.
    """
    n = blocks.count()
    parts = cut(blocks.repartition(max(1, min(n, max(LEAST_PARTS, n // PART_BLOCKS)))))
    drop_cut(blocks)
    x, y = (parts.select([F.col(c).alias(f"{c}_{side}") for c in parts.columns]) for side in "xy")
    own = "(i_x = i_y OR (i_x < i_y) = (pmod(xxhash64(least(i_x, i_y), greatest(i_x, i_y)), 2) = 0))"
    tiles = x.join(y.hint("shuffle_replicate_nl"), F.expr(f"{own} AND 2 * most_x >= least_y AND 2 * most_y >= least_x"))
    return tiles.mapInArrow(_tiles, "a long, b long")


@dataclass
class _Sets:
    """Sets of one block in the order of their sizes: terms (rarest first) one after the other, from ``at`` on."""

    ids: np.ndarray
    n: np.ndarray
    at: np.ndarray
    terms: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, n: np.ndarray, terms: np.ndarray) -> _Sets:
        return cls(ids, n, np.concatenate(([0], np.cumsum(n))), terms)

    def rare(self, dropped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, term) of each set's rarest terms, all but ``dropped`` of them."""
        width = np.maximum(0, self.n - dropped)
        return np.repeat(np.arange(len(width)), width), self.terms[_spread(self.at[:-1], width)]


def _dropped(n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of their most frequent terms sets of sizes ``n`` leave out before they meet sets of ``least`` terms or more, and how many
    shared terms are left then.

    Of sets of n and m terms that are alike ``(n + m) / 3`` are shared; the set whose last kept term is the rarer
    one has left out ``dropped`` of these at most, and the other one keeps all the rest.
    """
    share = -(-(n + np.maximum(least, (n + 1) // 2)) // 3)
    dropped = np.maximum(0, share - 4 - n // 64)
    return dropped, share - dropped


def _spread(start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """``start[0], start[0] + 1, ...`` of ``width[0]`` numbers, then those of ``start[1]``, ..."""
    return np.repeat(start - (np.cumsum(width) - width), width) + np.arange(width.sum())


def _shared(x: _Sets, i: np.ndarray, y: _Sets, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets ``i`` of ``x`` with sets ``j`` of ``y``."""
    out = np.zeros(len(i), np.int64)
    size = (x.at[i + 1] - x.at[i]) + (y.at[j + 1] - y.at[j])
    for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(np.cumsum(size) >> 21)) + 1):
        keys = []
        for s, k in ((x, i[part]), (y, j[part])):
            width = s.at[k + 1] - s.at[k]
            keys.append((np.repeat(np.arange(len(part)), width) << 32) + s.terms[_spread(s.at[k], width)])
        if len(keys[0]) and len(keys[1]):
            at = np.searchsorted(keys[1], keys[0])
            both = keys[1][np.minimum(at, len(keys[1]) - 1)] == keys[0]
            out[part] = np.bincount(keys[0][both] >> 32, minlength=len(part))
    return out


def _least_alike(x: _Sets, y: _Sets) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b): for each set of ``x`` and of ``y``, which may be the same, the least b < a of the other that is alike.

    Both are in the order of their sizes; a term of ``x`` that no set of ``y`` has may be -1.
    """
    best = {id(s): np.full(len(s.ids), np.iinfo(np.int64).max) for s in (x, y)}
    (drop_x, share_x), (drop_y, share_y) = _dropped(x.n, int(y.n.min())), _dropped(y.n, int(x.n.min()))
    row, term = y.rare(drop_y)
    own, own_term = x.rare(drop_x)
    size, m = 1 + max(t.max(initial=0) for t in (term, own_term)), len(y.ids)
    at = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=size))))
    shift = m.bit_length()
    rows = (np.sort((term.astype(np.int64) << shift) + row) & ((1 << shift) - 1)).astype(np.int32)
    del row, term
    held = (own_term >= 0) & (at[own_term + 1] > at[own_term])
    own, own_term = own[held], own_term[held]
    start, width = at[own_term], at[own_term + 1] - at[own_term]
    begin = np.searchsorted(own, np.arange(len(x.ids) + 1))
    # pairs (row of x, row of y) that share a term, some rows of x at a time
    met = np.concatenate(([0], np.cumsum(width)))[begin]
    lo = 0
    while lo < len(x.ids):
        hi = max(lo + 1, min(lo + (1 << 31) // m - 1, int(np.searchsorted(met, met[lo] + CELLS, "right")) - 1))
        part = slice(begin[lo], begin[hi])
        key = np.repeat(((own[part] - lo) * m).astype(np.int32), width[part])
        key += rows[_spread(start[part], width[part])]
        key.sort()
        first, last = np.searchsorted(y.n, [(x.n[lo] + 1) // 2, 2 * x.n[hi - 1] + 1])
        many = min(share_x[lo:hi].min(), share_y[first:last].min(initial=share_x[lo]))
        found = key[many - 1 :][key[many - 1 :] == key[: max(0, len(key) - many + 1)]]
        if len(found):
            pairs = found[np.concatenate(([True], found[1:] != found[:-1]))]
            shared = np.searchsorted(key, pairs, "right") - np.searchsorted(key, pairs)
            i, j = np.divmod(pairs.astype(np.int64), m)
            i += lo
            n, k = x.n[i], y.n[j]
            enough = (shared >= -(-(n + k) // 3) - np.maximum(drop_x[i], drop_y[j])) & (2 * np.minimum(n, k) >= np.maximum(n, k))
            _compare(x, y, i[enough], j[enough], best)
        lo = hi
    for s in (x, y) if x is not y else (x,):
        found = best[id(s)] < s.ids
        yield s.ids[found], best[id(s)][found]


def _compare(x: _Sets, y: _Sets, i: np.ndarray, j: np.ndarray, best: dict[int, np.ndarray]) -> None:
    """Takes pairs of sets ``i`` of ``x`` and ``j`` of ``y`` that are alike into ``best``."""
    for s, o, p, q in ((x, y, i, j), (y, x, j, i)):
        # sets of s after those of o that they may be like, nearest the first
        later = s.ids[p] > o.ids[q]
        p, q = p[later], q[later]
        order = np.lexsort((o.ids[q], p))
        p, q, many = p[order], q[order], 1
        while len(p):
            fresh = o.ids[q] < best[id(s)][p]
            p, q = p[fresh], q[fresh]
            place = np.arange(len(p)) - np.searchsorted(p, p)
            now = place < many
            a, b = p[now], q[now]
            both = _shared(x, a, y, b) if s is x else _shared(x, b, y, a)
            good = 3 * both >= s.n[a] + o.n[b]
            np.minimum.at(best[id(s)], a[good], o.ids[b[good]])
            p, q, many = p[~now], q[~now], 4 * many
        if x is y:
            break


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the two blocks of each row; terms become numbers in the second one's vocabulary, -1 if they aren't in it."""
    for b in batches:
        for k in range(b.num_rows):
            read = lambda c, t=np.int64: np.frombuffer(b.column(c)[k].as_buffer(), t)  # noqa: E731, B023
            y = _Sets.of(read("ids_y"), read("ns_y"), read("terms_y", np.int32))
            if b.column("i_x")[k].as_py() == b.column("i_y")[k].as_py():
                x = y
            else:
                own, other = read("vocabulary_x"), read("vocabulary_y")
                at = np.minimum(np.searchsorted(other, own), len(other) - 1)
                number = np.where(other[at] == own, at, -1).astype(np.int32)
                x = _Sets.of(read("ids_x"), read("ns_x"), number[read("terms_x", np.int32)])
            for a, least in _least_alike(x, y):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(least)], names=["a", "b"])


#: Terms of queries, of some 20 bytes each, that are broadcast at most.
BROADCAST_TERMS = 100_000


def term_counts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, len, term, tf) for the terms ``known``, and a row with the empty term for each document, which carries its length.

    Few known terms are broadcast, and texts are split once. Beyond that the documents' own rows stay out of the
    join by term, in which they would be one key. A null text is no document.
    """
    held = docs.select("doc_id", F.explode(F.array(terms(F.col("text")))).alias("t")).select("doc_id", F.size("t").alias("len"), "t").filter("t IS NOT NULL")
    few = known.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    own = F.concat(F.array(F.lit("")), F.col("t")) if few else F.col("t")
    rows = held.select("doc_id", "len", F.explode(own).alias("term")).groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    if few:
        return rows.join(F.broadcast(known.unionByName(known.sparkSession.createDataFrame([("",)], "term string"))), "term", "left_semi")
    return rows.join(known, "term", "left_semi").unionByName(held.select("doc_id", "len", F.lit("").alias("term"), F.lit(1).cast("long").alias("tf")))


@dataclass(frozen=True)
class Postings:
    """What documents give to a score by term, and the most that a block of documents gives."""

    rows: DataFrame  # block, term, doc_id, gain
    bounds: DataFrame  # block, term, most, n


def postings(docs: DataFrame, known: DataFrame, block: int = 64, k1: float = 1.5, b: float = 0.75) -> Postings:
    """The inverted index of ``docs`` (doc_id, text) for the terms ``known``, in blocks of about ``block`` documents."""
    counts = cut(term_counts(docs, known))
    n, mean = counts.filter("term = ''").agg(F.count("*"), F.avg("len")).first()
    rows = counts.filter("term <> ''")
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / (mean or 1.0)))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n // block))))
    rows = cut(join_counted(rows, cut(df.withColumn("times", F.col("df"))), "term", "times").select(place.alias("block"), "term", "doc_id", (idf * tf).alias("gain")))
    return Postings(rows, cut(rows.groupBy("block", "term").agg(F.max("gain").alias("most"), F.count("*").alias("n"))))


def scores_in(index: Postings, wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, read): whole scores of the documents of the blocks (query_id, block), and the postings read for each."""
    asked = blocks.select("query_id", "block").join(wanted, "query_id")
    read = index.rows.join(asked, ["block", "term"])
    return read.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("times") * F.col("gain")), 6).alias("score"), F.count("*").alias("read")).filter("score > 0")


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, block: int = 64) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best; a term repeated in a query counts as often.

    ``docs`` has (doc_id, text), ``queries`` (query_id, text). See ``best_documents``.
    """
    return best_documents(docs, queries, k, k1, b, block)[0]


def best_documents(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, block: int = 64) -> tuple[DataFrame, DataFrame]:
    """The k best of each query, and (query_id, read, postings): how many of its postings were read.

    A block's largest gains, one a term, bound the score of every document in it. The k blocks with the largest
    bounds, which are those with rare terms, are read first; their k-th score is one that the result can't
    fall below, so blocks whose bound is less are skipped. Blocks meet queries by term through their bounds
    only, and postings are joined by block and term, so a common term's postings are read where they matter.
    """
    wanted = cut(queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")))
    index = postings(docs, wanted.select("term").distinct(), block, k1, b)
    tops = cut(index.bounds.join(wanted, "term").groupBy("query_id", "block").agg(F.sum(F.col("times") * F.col("most")).alias("most"), F.sum("n").alias("n")))
    seeds = cut(top_rows(tops, ["query_id"], [F.desc("most"), F.col("block")], k).select("query_id", "block"))
    order = [F.desc("score"), F.col("doc_id")]
    first = cut(scores_in(index, wanted, seeds))
    floor = top_rows(first, ["query_id"], order, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("have"))
    # scores are rounded to six places, and documents of equal score are told apart by their ids
    rest = tops.join(seeds, ["query_id", "block"], "left_anti").join(floor, "query_id", "left").filter(f"coalesce(have, 0) < {k} OR most >= least - 0.00001")
    total = cut(first.unionByName(scores_in(index, wanted, rest)))
    share = total.groupBy("query_id").agg(F.sum("read").alias("read")).join(tops.groupBy("query_id").agg(F.sum("n").alias("postings")), "query_id")
    return top_rows(total.drop("read"), ["query_id"], order, k), share


def top_rows(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank; tasks drop the rest before the shuffle."""
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
