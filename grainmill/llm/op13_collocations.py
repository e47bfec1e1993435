"""Phrase collocation mining by hashed bucket counts and Apriori pruning.

Pass k counts phrases of k words exactly and, in the same reading, counts phrases of k + 1 words in a
fixed number of hash buckets. Buckets below the support give a bitmap, as do the phrases of k words
that reach it. In pass k + 1 a place in a text is counted only where the bucket bitmap has the phrase
and the other bitmap has both phrases of k words in it. Bitmaps err on one side only, so what is
counted exactly is all that can reach the support. Hashes decide nothing else: within a batch phrases
are told apart by the numbers of their words, across tasks by their text.

Bitmaps have ``1 << bits`` bits whatever the table's size; buckets of a task saturate at the support,
which keeps every sum on the right side of it. Phrases are summed within tasks before they are
shuffled. Levels of candidates are joined to the level below by their first and last words, which
carries the counts of all first and last parts along; so cuts need no further join.

Phrases inside a longer one need one comparison: a part occurs at least as often as what it lies in,
so if a much longer phrase covers it, one longer by a word does.

Defined results: null texts are empty, a null language is ``und``; pieces end with texts; the empty
table, and tables where nothing reaches the support, give an empty table; repeated rows count each;
ties are broken by the phrase's bytes; texts of any length are read in parts that end at a piece's
end; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainmill.checkpoints import cut, shared_table
from grainmill.llm.common import Hasher, mix, word_bounds
from grainmill.operators.skew import join_counted
from grainmill.shipping import ship
from grainmill.tables import table


@dataclass(frozen=True)
class Mining:
    """Phrases of 2 to ``longest`` words that occur ``support`` times; ``cover`` is in percent; ``bits`` is the logarithm of the buckets."""

    longest: int = 5
    support: int = 100
    cover: int = 100
    top: int = 2000
    bits: int = 22


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_APART = _BREAK.copy()
_APART[[32, 9]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are split at a time; phrases that a task holds; buckets in a row of counts.
PART, HELD, BLOCK = 4 << 20, 200_000, 1 << 16


class Words:
    """The words of some text as numbers, with the piece and the language of each."""

    def __init__(self, data: np.ndarray, lang: np.ndarray, names: list[str], base: int, ends: np.ndarray):
        starts, stops = word_bounds(data, _APART)
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(stops - starts, out=offsets[1:])
        own = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~_APART[data]])]).dictionary_encode()
        self.ids = own.indices.to_numpy().astype(np.int64)
        self.piece = np.cumsum(_BREAK[data], dtype=np.int32)[starts]
        self.lang, self.names = lang[np.searchsorted(ends, starts + base)], names
        self.known = own.dictionary
        self.spelt = self.known.to_pylist()

    def __len__(self) -> int:
        return len(self.ids)

    def hashes(self) -> np.ndarray:
        """A hash of each word with its language, the same in every task."""
        k = len(self.known)
        at = np.frombuffer(self.known.buffers()[1], np.int32)[: k + 1].astype(np.int64)
        own = Hasher(np.frombuffer(self.known.buffers()[2], np.uint8))(at[:-1], at[1:])
        seed = np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in self.names], np.uint64)
        return mix(own[self.ids] ^ seed[self.lang])

    def inside(self, n: int) -> np.ndarray:
        """Where phrases of n words lie within a piece."""
        return self.piece[n - 1 :] == self.piece[: max(0, len(self) - n + 1)]

    def counted(self, n: int, at: np.ndarray) -> Iterator[tuple[str, bytes, int]]:
        """(language, phrase, occurrences) of the phrases of n words that begin at the places given."""
        if not len(at):
            return
        key, size = self.lang[at].astype(np.int64), len(self.spelt)
        for j in range(n):
            if int(key.max()) >= (1 << 62) // size:
                key = np.unique(key, return_inverse=True)[1]
            key = key * size + self.ids[at + j]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        for i, c in zip(at[first].tolist(), counts.tolist(), strict=True):
            yield self.names[self.lang[i]], b" ".join([self.spelt[x] for x in self.ids[i : i + n]]), c


def _parts(texts: pa.Array, langs: pa.Array) -> Iterator[Words]:
    """The words of a batch, in parts that end at the end of a piece."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets[1:] - offsets[0] + np.arange(len(texts))
    data = np.full(len(raw) + len(texts), 10, np.uint8)
    own = np.ones(len(data), bool)
    own[ends] = False
    data[own] = _LOWER[raw]
    code = pc.fill_null(langs, "und").dictionary_encode()
    lang, names, breaks = code.indices.to_numpy(), code.dictionary.to_pylist(), np.flatnonzero(_BREAK[data])
    start = 0
    while start < len(data):
        stop = int(breaks[min(np.searchsorted(breaks, start + PART), len(breaks) - 1)]) + 1
        words = Words(data[start:stop], lang, names, start, ends)
        if len(words):
            yield words
        start = stop


def _grams(words: Words, upto: int) -> list[np.ndarray]:
    """Hashes of the phrases of 1 to ``upto`` words that begin at each place."""
    h = words.hashes()
    out = [h]
    for n in range(2, upto + 1):
        out.append(mix(out[-1][: max(0, len(h) - n + 1)] * _STEP + h[n - 1 :]))
    return out


class Tally:
    """What a task finds: phrases with their counts, and counts of buckets that saturate at the support."""

    def __init__(self, mining: Mining):
        self.mining, self.phrases, self.held = mining, defaultdict(lambda: defaultdict(int)), 0
        self.buckets = np.zeros(1 << mining.bits, np.uint32)

    def phrase(self, lang: str, phrase: bytes, n: int) -> None:
        own = self.phrases[lang]
        self.held += phrase not in own
        own[phrase] += n

    def bucket(self, hashes: np.ndarray, n: int = 1) -> None:
        np.add.at(self.buckets, hashes >> np.uint64(64 - self.mining.bits), np.uint32(n))

    def rows(self) -> Iterator[pa.RecordBatch]:
        for lang, own in self.phrases.items():
            k = len(own)
            phrase = pa.array(list(own), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k), phrase, pa.array(list(own.values()), pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=list(_PASS))
        self.phrases.clear()
        self.held = 0

    def blocks(self) -> Iterator[pa.RecordBatch]:
        size, small = min(BLOCK, len(self.buckets)), np.uint8 if self.mining.support < 256 else np.uint32
        for c in np.flatnonzero(self.buckets.reshape(-1, size).any(axis=1)).tolist():
            counts = np.minimum(self.buckets[c * size : (c + 1) * size], self.mining.support).astype(small)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([c], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=list(_PASS))


_PASS = {"lang": "string", "phrase": "string", "f": "long", "block": "int", "counts": "binary"}
_SCHEMA = ", ".join(f"{k} {t}" for k, t in _PASS.items())


def _pass(docs: DataFrame, n: int, mining: Mining, maps: list) -> DataFrame:
    """Counts of phrases of n words that the bitmaps leave, and buckets of phrases of n + 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, bitmaps = Tally(mining), [_bits(m.value) for m in maps]
        shift = np.uint64(64 - mining.bits)
        for b in batches:
            for w in _parts(b.column(0), b.column(1)):
                g = _grams(w, min(n + 1, mining.longest))
                may = w.inside(n)
                if bitmaps:
                    below, bucket = bitmaps
                    low = below[g[n - 2] >> shift]
                    may &= low[: len(may)] & low[1 : len(may) + 1] & bucket[g[n - 1] >> shift]
                for lang, phrase, c in w.counted(n, np.flatnonzero(may)):
                    tally.phrase(lang, phrase, c)
                if n < mining.longest:
                    longer = w.inside(n + 1)
                    tally.bucket(g[n][longer & may[: len(longer)] & may[1 : len(longer) + 1]])
                if tally.held >= HELD:
                    yield from tally.rows()
        yield from tally.rows()
        yield from tally.blocks()

    return docs.mapInArrow(run, _SCHEMA)


def _marks(level: DataFrame, n: int, mining: Mining) -> DataFrame:
    """Blocks of buckets in which the phrases of a level, all of n words, reach the support."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(mining)
        for b in batches:
            for w in _parts(b.column(1), b.column(0)):
                tally.bucket(_grams(w, n)[n - 1][w.inside(n)], mining.support)
        yield from tally.blocks()

    return level.select("lang", "phrase").mapInArrow(run, _SCHEMA)


def _bits(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)


def _bitmap(blocks: DataFrame, mining: Mining) -> bytes:
    """The buckets whose counts reach the support. Tasks sum blocks as they come; ``1 << bits`` bits reach the driver."""
    size = min(BLOCK, 1 << mining.bits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = sums.setdefault(block, np.zeros(size, np.uint32))
                new = np.frombuffer(counts.as_buffer(), np.uint8 if mining.support < 256 else np.uint32)
                np.minimum(own + new, np.uint32(mining.support), out=own)
        reached = [np.packbits(x >= mining.support).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(reached, pa.binary())], names=["block", "bits"])

    out = np.zeros((1 << mining.bits) // 8, np.uint8)
    for r in blocks.select("block", "counts").repartition("block").mapInArrow(add, "block int, bits binary").collect():
        out[r.block * size // 8 : (r.block + 1) * size // 8] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def frequent(docs: DataFrame, mining: Mining = Mining()) -> tuple[list[DataFrame], DataFrame]:
    """Levels of (lang, phrase, f) with f at the support or above, one for each number of words, and (lang, n).

    ``docs`` has the columns text and lang only. Levels end where one is empty, as no longer phrase can follow.
    """
    spark = docs.sparkSession
    ship(spark)
    levels: list[DataFrame] = []
    maps: list = []
    totals = None
    for n in range(1, mining.longest + 1):
        with shared_table(_pass(docs, n, mining, maps)) as rows:
            phrases = rows.filter("block is null")
            level = cut(phrases.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= mining.support))
            totals = totals or cut(phrases.groupBy("lang").agg(F.sum("f").alias("n")))
            buckets = _bitmap(rows.filter("block is not null"), mining) if n < mining.longest else b""
        if level.isEmpty():
            break
        levels.append(level)
        if n < mining.longest:
            for m in maps:
                m.unpersist()
            maps = [spark.sparkContext.broadcast(_bitmap(_marks(level, n, mining), mining)), spark.sparkContext.broadcast(buckets)]
    return levels, totals


def scored(levels: list[DataFrame], totals: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all candidates that no longer one covers."""
    spark = totals.sparkSession
    below = None
    kept: list[DataFrame] = []
    for n, level in enumerate(levels, 1):
        if below is None:
            below = level.select("lang", "phrase", F.array("f").alias("heads"), F.array("f").alias("tails"))
            continue
        head, tail = F.substring_index("phrase", " ", n - 1), F.substring_index("phrase", " ", 1 - n)
        rows = level.select("lang", "phrase", "f", head.alias("head"), tail.alias("tail"))
        rows = rows.join(below.select("lang", F.col("phrase").alias("head"), "heads"), ["lang", "head"])
        rows = cut(rows.join(below.select("lang", F.col("phrase").alias("tail"), "tails"), ["lang", "tail"]))
        if n > 2:
            covers = lambda part, counts: rows.filter(100 * F.col("f") >= mining.cover * F.element_at(counts, -1)).select("lang", F.col(part).alias("phrase"))
            kept.append(below.join(covers("head", "heads").unionByName(covers("tail", "tails")), ["lang", "phrase"], "left_anti"))
        below = rows.select("lang", "phrase", F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"))
    if below is None or len(levels) < 2:
        return spark.createDataFrame([], "lang string, phrase string, a long, l long, r long, n long, score long")
    rows = kept[0] if kept else below
    for x in kept[1:] + ([below] if kept else []):
        rows = rows.unionByName(x)
    rows = cut(rows)
    sizes = cut(totals.join(rows.groupBy("lang").agg(F.count("*").alias("rows")), "lang"))
    rows = join_counted(rows, sizes, "lang", "rows").withColumn("a", F.element_at("heads", -1))
    cuts = F.transform(F.sequence(F.lit(1), F.size("heads") - 1), lambda k: F.struct(k.alias("k"), F.element_at("heads", k).alias("l"), F.element_at("tails", F.size("tails") - k).alias("r")))
    whole = "decimal(38,0)"
    rows = rows.withColumn("cuts", cuts)
    rows = rows.withColumn("best", F.array_min(F.transform("cuts", lambda c: F.struct(
        F.call_function("div", F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(17,0)") * F.col("n").cast("decimal(17,0)"), (c["l"].cast("decimal(19,0)") * c["r"].cast("decimal(18,0)")).cast(whole)).alias("score"),
        c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"),
    ))))
    return rows.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


#: Parts of a language whose best phrases are found apart before they meet: at most SALTS * top rows do.
SALTS = 64


def collocations(docs: DataFrame, mining: Mining = Mining(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's best phrases: (lang, rank, phrase, a, l, r, n, score)."""
    texts = docs.select(F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    levels, totals = frequent(texts, mining)
    rows = scored(levels, totals, mining)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    rows = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    rows = rows.filter(F.col("rank") <= mining.top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return rows.filter(F.col("rank") <= mining.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM starts, range(1, 6) t(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
often AS (SELECT * FROM f WHERE f >= 100),
candidates AS (SELECT lang, k, phrase, f AS a FROM often WHERE k >= 2),
left_over AS (SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM candidates d WHERE d.lang = c.lang AND d.k > c.k AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * d.a >= 100 * c.a)),
cuts AS (SELECT lang, phrase, a, unnest(range(1, k)) AS j, string_split(phrase, ' ') AS w FROM left_over),
parts AS (SELECT c.lang, c.phrase, c.a, c.j, l.f AS l, r.f AS r, n,
    (1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:j], ' ') JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(w[j + 1:], ' ') JOIN total t ON t.lang = c.lang),
lowest AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM lowest
QUALIFY rank <= 2000
"""

QUERIES = {"op13_collocations": op13_collocations}
ORACLES = {"op13_collocations": _SQL}
