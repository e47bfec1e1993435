"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees split the statistics of labelled texts; every path of a tree is a conjunctive
rule. A lasso logistic fit over the rules keeps few of them, and these compile to one Spark column
expression over the statistics' columns.

Defined results: null and empty texts have all-zero statistics and a score like any other; long texts
are read whole; repeated rows get equal scores; an empty table gives an empty table; with no labelled
row, or one class only, the score is the constant share of label 1 (0.5 without labels); a column
that clashes with the score's name is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import Hasher, extend, labelled_ids, text_of, word_bounds
from grainmill.tables import table

STATS = (
    "s_words", "s_word_bytes", "s_distinct", "s_repeat_next", "s_upper", "s_digit", "s_symbol", "s_mark", "s_bang",
    "s_bar", "s_lines", "s_line_distinct", "s_top_word", "s_other",
)

_GROUPS = np.zeros((256, 8))
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~<>{}[]\\_=", b".,;:?'\"()-", b"!", b"|", b"\n")):
    _GROUPS[[*_set], _i] = 1
_GROUPS[128:, 7] = 1


def stats_of(text: str) -> list[float]:
    """Statistics of one whole text, in the order of ``STATS``."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATS)
    data = np.frombuffer(raw, np.uint8)
    upper, digit, symbol, mark, bang, bar, lines, other = np.bincount(data, minlength=256) @ _GROUPS / len(data)
    s, e = word_bounds(data)
    n = len(s)
    if n:
        h = Hasher(data)(s, e)
        _, counts = np.unique(h, return_counts=True)
        distinct, top, again = len(counts) / math.sqrt(n), counts.max() / n, float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0
        size = float((e - s).mean())
    else:
        distinct = top = again = size = 0.0
    own = raw.split(b"\n")
    return [math.log1p(n), size, distinct, again, upper, digit, symbol, mark, bang, bar, lines, len({*own}) / len(own), top, other]


def with_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the statistics' columns."""

    def kernel():
        def run(texts: pa.Array) -> list:
            grid = np.array([stats_of(t) for t in text_of(texts)], np.float64).reshape(-1, len(STATS))
            return [pa.array(grid[:, i]) for i in range(len(STATS))]

        return run

    return extend(df, [text_col], ", ".join(f"{s} double" for s in STATS), kernel)


Condition = tuple[int, bool, float]  # statistic, whether above, threshold
Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class RuleModel:
    """``sigmoid(bias + sum of the weights of the rules that hold)``."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        z = F.lit(self.bias)
        for rule, w in self.rules:
            holds = None
            for i, above, t in rule:
                c = F.col(STATS[i]) > t if above else F.col(STATS[i]) <= t
                holds = c if holds is None else holds & c
            z = z + F.when(holds, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, w in self.rules:
            z += w * holds(rule, x)
        return 1 / (1 + np.exp(-z))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, above, t in rule:
        out &= (x[:, i] > t) if above else (x[:, i] <= t)
    return out


def _steps(paths: list[Rule], x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The tree's step at each row: the Newton step of the longest path, among one tree's, that holds."""
    out = np.zeros(len(x))
    for q in sorted(paths, key=len):
        own = holds(q, x)
        fitted = rows[own[rows]]
        out[own] = g[fitted].sum() / (h[fitted].sum() + 1)
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, depth: int, path: Rule, rules: list[Rule], least: int) -> None:
    """Grows one boosted tree; adds the path of every node to ``rules``."""
    if depth == 0 or len(rows) < 2 * least:
        return
    best, total, weight = (1e-6, None, None), g[rows].sum(), h[rows].sum()
    for i, c in enumerate(cuts):
        if not len(c):
            continue
        b = binned[rows, i]
        gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
        hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
        nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
        gain = gl**2 / (hl + 1) + (total - gl) ** 2 / (weight - hl + 1) - total**2 / (weight + 1)
        gain[(nl < least) | (len(rows) - nl < least)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), i, k)
    if best[1] is None:
        return
    _, i, k = best
    above = binned[rows, i] > k
    for side, part in ((False, rows[~above]), (True, rows[above])):
        own = (*path, (i, side, float(cuts[i][k])))
        rules.append(own)
        _grow(x, g, h, part, cuts, binned, depth - 1, own, rules, least)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 0.002, rate: float = 0.3, seed: int = 5) -> RuleModel:
    """Trees, their rules, then lasso logistic weights by accelerated proximal gradient."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return RuleModel(math.log(p / (1 - p)), ())
    r = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0.02, 0.98, 48)))[:-1] for i in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], 1)
    z = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    rules: list[Rule] = []
    least = max(5, len(y) // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(r.random(len(y)) < 0.7)
        first = len(rules)
        _grow(x, y - p, p * (1 - p), rows, cuts, binned, depth, (), rules, least)
        z += rate * _steps(rules[first:], x, y - p, p * (1 - p), rows)
    rules = sorted({tuple(sorted(q)) for q in rules})
    m = np.stack([holds(q, x) for q in rules], 1).astype(np.float64)
    mean = m.mean(0)
    keep = (mean > 0.002) & (mean < 0.998)
    m, rules = m[:, keep], [q for q, k in zip(rules, keep, strict=True) if k]
    w, b = np.zeros(m.shape[1]), math.log(y.mean() / (1 - y.mean()))
    lipschitz = 0.25 * float(np.linalg.norm(m, 2) ** 2) / len(y) + 0.25
    v, vb, t = w.copy(), b, 1.0
    for _ in range(400):
        d = (1 / (1 + np.exp(-(m @ v + vb))) - y) / len(y)
        w2 = v - m.T @ d / lipschitz
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - penalty / lipschitz, 0)
        b2 = vb - d.sum() / lipschitz
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return RuleModel(float(b), tuple((q, float(c)) for q, c in zip(rules, w, strict=True) if abs(c) > 1e-6))


#: Documented bound of the labelled sample that the model is fitted on.
TRAIN_ROWS = 12_000


def held_out(c: str = "doc_id") -> Column:
    return F.crc32(F.col(c).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN_ROWS) -> RuleModel:
    """Fits on about ``limit`` labelled rows that aren't held out; only their statistics reach the driver.

    The labelled ids are bounded by ``limit`` and broadcast, so no text is shuffled.
    """
    ids = labelled_ids(labels.filter(~held_out()), label, limit).withColumn("y", F.col("y").cast("double"))
    rows = with_stats(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")).drop("text").toPandas().sort_values(["doc_id", *STATS])
    return fit(rows[[*STATS]].to_numpy(np.float64).reshape(-1, len(STATS)), rows["y"].to_numpy(np.float64))


def score(df: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """``df`` with ``score``; a column of that name is replaced, others stay, those named like a statistic too."""
    kept = [c for c in df.columns if c.lower() != "score"]
    own = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)])
    scored = with_stats(df.select(own.alias("_kept"), F.col(text_col).alias("_text")), "_text").select("_kept", model.column().alias("score"))
    return scored.select(*[F.col(f"_kept.k{i}").alias(c) for i, c in enumerate(kept)], "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
