"""Toxicity by a classifier chain over word and word-prefix features.

Categories are predicted in order, ``toxic`` last, and it alone is the verdict. Each is a logistic model over
the features and the probabilities of the categories before it; in training those are out-of-fold
predictions, so a later model sees earlier ones as they will be on new documents. A fold's model selects its
features and is fitted without the fold's rows, and folds go by the text, so copies are never on both sides.

The earlier categories are weak: their labels are found in the text alone, by a few words of each
(``CATEGORIES``). The words are labels of the training sample only; a model decides by all features.

A feature is a hashed lower-case word or the first 4 to 9 bytes of one; its value grows with the
feature's rate among the document's words. Features are kept if their document rates differ most
between the labels of the sample.

Defined results: null and empty texts have no features and get the models' bias; long texts are read
whole; repeated rows get equal scores; an empty table gives an empty table; with no labelled row, or
one class only, a category's probability is the constant share (0 without labels); columns that clash
with an output's name are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.checkpoints import cut, drop_cut
from grainmill.llm.common import Hasher, extend, labelled_ids, mix, text_of, word_bounds
from grainmill.shipping import ship
from grainmill.tables import table

PREFIXES = (4, 5, 6, 7, 8, 9)
#: Documented bounds of the labelled sample, and of the features kept for a weak category and for the verdict.
TRAIN_ROWS, WEAK_FEATURES, FEATURES = 12_000, 300, 3000
FOLDS, THRESHOLD = 3, 0.4

#: Words that mark a text as a weak example of a category.
CATEGORIES = {
    "insult": ("idiot", "moron", "stupid", "loser", "clown", "dumb", "fool", "imbecile"),
    "contempt": ("trash", "scum", "worthless", "disgusting", "pathetic", "garbage", "vermin", "filth"),
}
NAMES = (*CATEGORIES, "toxic")
LIMITS = (*[WEAK_FEATURES] * len(CATEGORIES), FEATURES)

_APART = np.ones(256, bool)
_APART[128:] = False
_APART[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ'"]] = False


def feature_counts(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct feature hashes of a text, their counts, and its number of words."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    s, e = word_bounds(data, _APART)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    h = Hasher(data)
    parts = [h(s, e)]
    for k in PREFIXES:
        long = e - s >= k
        if long.any():
            parts.append(mix(h(s[long], s[long] + k) + np.uint64(k)))
    f, c = np.unique(np.concatenate(parts), return_counts=True)
    return f.view(np.int64), c, len(s)


def value(counts: np.ndarray, words: np.ndarray | int) -> np.ndarray:
    return np.log1p(100.0 * counts / np.maximum(words, 1))


@dataclass(frozen=True)
class Chain:
    """Sorted feature hashes; for each category the feature weights, the weights of earlier categories' probabilities, and a bias."""

    names: tuple[str, ...]
    features: np.ndarray
    weights: tuple[tuple[np.ndarray, np.ndarray, float], ...]

    def texts(self, texts: list[str]) -> np.ndarray:
        """(texts, categories) probabilities."""
        z = np.zeros((len(texts), len(self.names)))
        for i, t in enumerate(texts):
            f, c, n = feature_counts(t)
            if len(self.features) and len(f):
                at = np.minimum(np.searchsorted(self.features, f), len(self.features) - 1)
                own = self.features[at] == f
                x, at = value(c[own], n), at[own]
            else:
                x, at = np.zeros(0), np.zeros(0, np.int64)
            for k, (w, _, _) in enumerate(self.weights):
                z[i, k] = float(w[at] @ x) if len(w) else 0.0
        return _link(z, self.weights)


def _link(z: np.ndarray, weights) -> np.ndarray:
    p = np.zeros_like(z)
    for k, (_, earlier, bias) in enumerate(weights):
        p[:, k] = _sigmoid(z[:, k] + bias + (p[:, :k] @ earlier if k else 0))
    return p


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(rows: np.ndarray, cols: np.ndarray, x: np.ndarray, dense: np.ndarray, y: np.ndarray, n_cols: int, ridge: float = 2e-3, steps: int = 250) -> tuple[np.ndarray, np.ndarray, float]:
    """Ridge logistic regression on sparse triples and dense columns, by Adam on the full gradient."""
    n, width = len(y), n_cols + dense.shape[1] + 1
    if not n or y.min() == y.max():
        p = float(np.clip(y.mean() if n else 0.0, 1e-4, 1 - 1e-4))
        return np.zeros(n_cols), np.zeros(dense.shape[1]), float(np.log(p / (1 - p)))
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[cols] * x, n) + dense @ w[n_cols:-1] + w[-1]
        d = (_sigmoid(z) - y) / n
        g = np.concatenate([np.bincount(cols, d[rows] * x, n_cols), d @ dense, [d.sum()]])
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.08 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w[:n_cols], w[n_cols:-1], float(w[-1])


def lexicon() -> list[np.ndarray]:
    """Each weak category's words as feature hashes."""
    return [np.array([_word(w) for w in words], np.int64) for words in CATEGORIES.values()]


def _word(w: str) -> int:
    data = np.frombuffer(w.encode(), np.uint8)
    return int(Hasher(data)(np.array([0]), np.array([len(data)])).view(np.int64)[0])


def weak_labels(features: np.ndarray, words: list[np.ndarray]) -> list[int]:
    """For each weak category, whether one of its words is among a text's features."""
    return [int(np.isin(w, features).any()) for w in words]


def fold_of(features: np.ndarray) -> int:
    """A document's fold; it follows from what the text holds, so copies share one."""
    return int(mix(np.array([np.bitwise_xor.reduce(features.view(np.uint64), initial=np.uint64(0))], np.uint64))[0] % np.uint64(FOLDS))


def leanings(with_: np.ndarray, without: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """How far document rates differ between the classes, in standard errors; 0 for features of fewer than 4 documents."""
    p = (with_ + without + 1) / (n1 + n0 + 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = (with_ / max(n1, 1) - without / max(n0, 1)) / np.sqrt(p * (1 - p) * (1 / max(n1, 1) + 1 / max(n0, 1)))
    return np.where(with_ + without < 4, 0.0, z)


def strongest(features: np.ndarray, z: np.ndarray, limit: int, least: float = 2.5) -> np.ndarray:
    """Sorted hashes of the features that lean most to either class."""
    order = np.lexsort((features, -np.abs(z)))[:limit]
    return np.sort(features[order[np.abs(z[order]) > least]])


@dataclass(frozen=True)
class Selection:
    """Features chosen on all rows, and for each fold those chosen without it; each for all categories together."""

    every: np.ndarray
    without: tuple[np.ndarray, ...]

    def union(self) -> np.ndarray:
        return np.unique(np.concatenate([self.every, *self.without]))


def selected_from(features: np.ndarray, docs: np.ndarray, marked: np.ndarray, n: np.ndarray, n1: np.ndarray, limits: tuple[int, ...] = LIMITS) -> Selection:
    """Chooses from counts: ``docs`` (features, folds) documents, ``marked`` (features, categories, folds) of them marked.

    ``n`` (folds) and ``n1`` (categories, folds) count the sample's documents and its marked ones.
    """

    def choose(use: np.ndarray) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for k in range(n1.shape[0]):
            total, own = n[use].sum(), n1[k, use].sum()
            if 0 < own < total:
                a = marked[:, k][:, use].sum(1)
                out.append(strongest(features, leanings(a, docs[:, use].sum(1) - a, own, total - own), limits[k]))
        return np.unique(np.concatenate(out))

    folds = np.arange(len(n))
    return Selection(choose(folds >= 0), tuple(choose(folds != f) for f in folds))


def _triples(docs: list, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place among the features, value) of the documents' features that are among ``features``."""
    rows, ats, xs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for i, (ids, counts, words) in enumerate(docs if len(features) else []):
        at = np.minimum(np.searchsorted(features, ids), len(features) - 1)
        own = features[at] == ids
        rows.append(np.full(int(own.sum()), i))
        ats.append(at[own])
        xs.append(value(counts[own], words))
    return np.concatenate(rows), np.concatenate(ats), np.concatenate(xs)


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], labels: np.ndarray, fold: np.ndarray, names: tuple[str, ...], chosen: Selection) -> Chain:
    """Fits the chain; ``docs`` has (feature hashes, counts, words), ``labels`` one column for each category."""
    if not len(docs):
        return Chain(names, np.zeros(0, np.int64), tuple((np.zeros(0), np.zeros(k), -40.0) for k in range(len(names))))
    rows, at, x = _triples(docs, chosen.every)
    earlier, weights = np.zeros((len(docs), 0)), []
    for k in range(len(names)):
        y = labels[:, k].astype(float)
        weights.append(_logistic(rows, at, x, earlier, y, len(chosen.every)))
        if k + 1 < len(names):
            out = np.zeros(len(docs))
            for f, own in enumerate(chosen.without):
                if (fold == f).any():
                    r, c, v = _triples(docs, own)  # one fold's at a time
                    fitted = fold[r] != f
                    index = np.cumsum(fold != f) - 1
                    w, e, b = _logistic(index[r[fitted]], c[fitted], v[fitted], earlier[fold != f], y[fold != f], len(chosen.without[f]), steps=120)
                    z = np.bincount(r, w[c] * v, len(docs)) + earlier @ e + b
                    out[fold == f] = _sigmoid(z)[fold == f]
            earlier = np.concatenate([earlier, out[:, None]], axis=1)
    return Chain(names, chosen.every, tuple(weights))


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Chain:
    """Fits the weak categories and ``toxic`` on a sample of labelled documents.

    About ``limit`` labelled ids, chosen by a hash over the whole table, are broadcast and joined, so no text
    is shuffled; counts of the features that may be used reach the driver.
    """
    sample = docs.select("doc_id", "text").join(F.broadcast(labelled_ids(labels, "toxic", limit)), "doc_id")
    chosen = selected(sample)
    known = docs.sparkSession.sparkContext.broadcast(chosen.union())

    def kernel():
        own, words = known.value, lexicon()

        def run(texts: pa.Array) -> list:
            got, order, fold, weak = [], [], [], []
            for t in text_of(texts):
                f, c, n = feature_counts(t)
                kept = np.isin(f, own)
                got.append((f[kept], c[kept].astype(np.int32), n))
                order.append(int(np.bitwise_xor.reduce(f, initial=0)))
                fold.append(fold_of(f))
                weak.append(weak_labels(f, words))
            return [
                pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.int64()),
                pa.array(order, pa.int64()), pa.array(fold, pa.int32()), pa.array(weak, pa.list_(pa.int32())),
            ]

        return run

    t = extend(sample, ["text"], "f array<long>, c array<int>, n long, k long, fold int, weak array<int>", kernel).drop("text").toArrow()
    t = t.sort_by([("k", "ascending"), ("n", "ascending"), ("doc_id", "ascending"), ("y", "ascending")]).combine_chunks()
    ends = np.cumsum([0, *pc.list_value_length(t["f"]).to_pylist()]).tolist()
    f, c = (pc.list_flatten(t[x]).to_numpy() for x in ("f", "c"))
    own = [(f[a:b], c[a:b], n) for a, b, n in zip(ends[:-1], ends[1:], t["n"].to_pylist(), strict=True)]
    weak = pc.list_flatten(t["weak"]).to_numpy().reshape(len(own), len(CATEGORIES))
    y = np.concatenate([weak, t["y"].to_numpy().astype(np.int64)[:, None]], axis=1)
    return fit(own, y, t["fold"].to_numpy(), NAMES, chosen)


def selected(sample: DataFrame, limits: tuple[int, ...] = LIMITS) -> Selection:
    """The features to use, chosen from counts over the sample (text, y).

    Tasks count the documents of each feature by fold and category and Spark adds the counts up. Of the sums
    only those that lean far enough, on all rows or without one fold, reach the driver.
    """
    ship(sample.sparkSession)
    K, width = len(NAMES), FOLDS * (len(NAMES) + 1)
    names = [f"c{i}" for i in range(width)]  # documents by fold, then marked ones by category and fold

    def run(batches):
        words = lexicon()
        for b in batches:
            own, marks, size = [np.zeros(0, np.int64)], [np.zeros(width)], []
            for t, y in zip(text_of(b.column("text")), b.column("y").to_pylist(), strict=True):
                f = feature_counts(t)[0]
                m = np.zeros((K + 1, FOLDS), np.int64)
                m[:, fold_of(f)] = [1, *weak_labels(f, words), y]
                own.append(np.append(f, 0))  # 0 stands for the document itself
                marks.append(m.ravel())
                size.append(len(f) + 1)
            f, inverse = np.unique(np.concatenate(own), return_inverse=True)
            m = np.array(marks[1:]).reshape(len(size), width)
            cols = [np.bincount(inverse, np.repeat(m[:, i], size), len(f)).astype(np.int64) for i in range(width)]
            yield pa.RecordBatch.from_arrays([pa.array(f), *map(pa.array, cols)], names=["f", *names])

    sums = sample.select("text", "y").mapInArrow(run, "f long, " + ", ".join(f"{n} long" for n in names)).groupBy("f").agg(*[F.sum(n).alias(n) for n in names])
    sums = cut(sums)
    whole = sums.filter("f = 0").select(*names).first()
    totals = np.array(whole if whole else [0] * width, np.int64).reshape(K + 1, FOLDS)
    n, n1 = totals[0], totals[1:]
    pick = lambda k, use: sum((F.col(names[k * FOLDS + f]) for f in use), F.lit(0))
    leans = []
    for use in [range(FOLDS), *[[g for g in range(FOLDS) if g != f] for f in range(FOLDS)]]:
        every, own = pick(0, use), int(n[list(use)].sum())
        for k in range(K):
            a, m = pick(k + 1, use), int(n1[k, list(use)].sum())
            if 0 < m < own:
                p = (every + 1) / (own + 2)
                z = (a / m - (every - a) / (own - m)) / F.sqrt(p * (1 - p) * (1 / m + 1 / (own - m)))
                leans.append((F.when(every >= 4, F.abs(z)).otherwise(F.lit(0.0)), limits[k]))
    if not leans:
        return Selection(np.zeros(0, np.int64), tuple(np.zeros(0, np.int64) for _ in range(FOLDS)))
    found = sums.filter("f <> 0")
    top = None
    for z, limit in leans:  # at most ``limit`` rows for each
        best = found.withColumn("z", z).filter("z > 2.5").orderBy(F.desc("z"), "f").limit(limit).select("f")
        top = best if top is None else top.unionByName(best)
    t = found.join(F.broadcast(top.distinct()), "f").toArrow().sort_by("f")
    drop_cut(sums)
    counts = np.stack([t[x].to_numpy() for x in names], axis=1).reshape(-1, K + 1, FOLDS)
    return selected_from(t["f"].to_numpy(), counts[:, 0], counts[:, 1:], n, n1, limits)


def score(df: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """Adds one ``<prefix><category>`` for each category."""
    model = df.sparkSession.sparkContext.broadcast(chain)  # at most FEATURES weights a category

    def kernel():
        c = model.value

        def run(texts: pa.Array) -> list:
            p = c.texts(text_of(texts))
            return [pa.array(p[:, k]) for k in range(p.shape[1])]

        return run

    return extend(df, [text_col], ", ".join(f"{prefix}{n} double" for n in chain.names), kernel)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, chain).select("doc_id", *[f"p_{n}" for n in NAMES], (F.col("p_toxic") >= THRESHOLD).cast("int").alias("toxic"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
