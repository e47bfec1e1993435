"""op7 and op8: held-out accuracy, compiled rules against numpy, and odd inputs."""

import math
import re
import zlib

import numpy as np
import pytest

from grainmill.llm import op7_quality as q
from grainmill.llm import op8_toxicity as t

SF = "/root/testdata/sf0.01"


def auc(y, z):
    pos, neg = z[y == 1], z[y == 0]
    return ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    rows = q.op7_quality(spark, SF).toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    own = rows[rows.held_out].merge(labels, on="doc_id")
    assert auc(own.quality.to_numpy(), own.score.to_numpy()) > 0.95
    assert (own.predicted == own.quality).mean() > 0.93


def test_rules_compile_to_the_same_score(spark):
    r = np.random.default_rng(0)
    x = r.random((400, len(q.STATS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    m = q.fit(x, y, trees=8)
    assert m.rules and auc(y, m.score(x)) > 0.95
    df = spark.createDataFrame([[float(v) for v in row] for row in x], list(q.STATS))
    got = np.array([row.s for row in df.select(m.column().alias("s")).collect()])
    assert np.allclose(got, m.score(x))


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    chain = t.train(docs, labels.filter("doc_id % 4 <> 0"))
    own = t.score(docs, chain).toPandas().merge(labels.toPandas(), on="doc_id")
    own = own[own.doc_id % 4 == 0]
    assert auc(own.toxic.to_numpy(), own.p_toxic.to_numpy()) > 0.9
    assert len(t.op8_toxicity(spark, SF).collect()) == 1000


def plain_stats(text):
    """The statistics of op7, by plain Python."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(q.STATS)
    share = lambda chars: sum(raw.count(bytes([c])) for c in chars) / len(raw)
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, lines = len(words), raw.split(b"\n")
    top = max((words.count(w) for w in set(words)), default=0)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / (n - 1) if n > 1 else 0.0
    return [
        math.log1p(n), sum(map(len, words)) / n if n else 0.0, len(set(words)) / math.sqrt(n) if n else 0.0, again,
        share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"), share(b"#$%&*@^~<>{}[]\\_="), share(b".,;:?'\"()-"), share(b"!"), share(b"|"), share(b"\n"),
        len(set(lines)) / len(lines), top / n if n else 0.0, sum(c >= 128 for c in raw) / len(raw),
    ]


def test_quality_query_by_brute_force(spark, monkeypatch):
    models = []
    fitted = q.fit
    monkeypatch.setattr(q, "fit", lambda x, y: models.append((fitted(x, y), len(y))) or models[-1][0])
    got = {r.doc_id: r for r in q.op7_quality(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = [r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    model, n = models[0]
    assert n == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in labels)
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        z = model.bias
        x = plain_stats(t)
        for rule, w in model.rules:
            z += w * all((x[s] > c) == above for s, above, c in rule)
        p = 1 / (1 + math.exp(-z))
        assert abs(p - got[i].score) < 1e-6
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].predicted == int(got[i].score >= 0.3)


def toy(n=240):
    r = np.random.default_rng(1)
    texts = [" ".join([["idiot", "trash", "calm", "calm"][i % 4]] + [f"w{k}" for k in r.integers(0, 30, 20)]) for i in range(n)]
    return texts, np.array([int(i % 4 < 2) for i in range(n)])


def counts_by_hand(texts, y):
    """Documents of each feature by fold, and marked ones by category and fold, one document at a time."""
    docs, marked, n, n1 = {}, {}, np.zeros(t.FOLDS, int), np.zeros((len(t.NAMES), t.FOLDS), int)
    for text, label in zip(texts, y, strict=True):
        f = t.feature_counts(text)[0]
        own = t.fold_of(f)
        marks = [*[int(any(w in text.split() for w in words)) for words in t.CATEGORIES.values()], label]
        n[own] += 1
        n1[:, own] += marks
        for h in f.tolist():
            docs.setdefault(h, np.zeros(t.FOLDS, int))[own] += 1
            marked.setdefault(h, np.zeros((len(t.NAMES), t.FOLDS), int))[:, own] += marks
    names = np.array(sorted(docs))
    return names, np.stack([docs[h] for h in names]), np.stack([marked[h] for h in names]), n, n1


def test_selection_from_spark_counts(spark):
    texts, y = toy()
    df = spark.createDataFrame([(x, int(v)) for x, v in zip(texts, y, strict=True)], "text string, y int").repartition(3)
    got, want = t.selected(df, (5, 6, 12)), t.selected_from(*counts_by_hand(texts, y), (5, 6, 12))
    assert (got.every == want.every).all() and all((a == b).all() for a, b in zip(got.without, want.without, strict=True))
    assert len(got.every) and t._word("idiot") in got.every


def test_folds_keep_copies_together():
    texts, _ = toy(40)
    assert len({t.fold_of(t.feature_counts(x)[0]) for x in texts}) == t.FOLDS
    assert t.fold_of(t.feature_counts("a b c a")[0]) == t.fold_of(t.feature_counts("a b c a")[0])


def test_the_verdict_goes_through_the_chain():
    texts, y = toy()
    docs = [t.feature_counts(x) for x in texts]
    weak = np.array([t.weak_labels(d[0], t.lexicon()) for d in docs])
    labels = np.concatenate([weak, y[:, None]], axis=1)
    fold = np.array([t.fold_of(d[0]) for d in docs])
    chain = t.fit(docs, labels, fold, t.NAMES, t.selected_from(*counts_by_hand(texts, y)))
    p = chain.texts(texts)
    assert ((p[:, -1] >= t.THRESHOLD) == y).mean() > 0.95
    w, earlier, bias = chain.weights[-1]
    assert (earlier > 0.1).all()
    cut = t.Chain(chain.names, chain.features, (*chain.weights[:-1], (w, np.zeros_like(earlier), bias)))
    assert (cut.texts(texts)[y == 1, -1] < p[y == 1, -1]).all()
    # the chain's arithmetic, one text at a time
    for x, own in zip(texts[:20], p, strict=False):
        f, c, n = t.feature_counts(x)
        done = []
        for weights, before, b in chain.weights:
            z = b + sum(weights[np.searchsorted(chain.features, h)] * math.log1p(100 * k / n) for h, k in zip(f, c, strict=True) if h in chain.features)
            z += sum(v * q_ for v, q_ in zip(before, done, strict=True))
            done.append(1 / (1 + math.exp(-z)))
        assert np.allclose(done, own)


def test_toxicity_query_goes_through_the_chain(spark, monkeypatch):
    chains = []
    trained = t.train
    monkeypatch.setattr(t, "train", lambda *a: chains.append(trained(*a)) or chains[-1])
    rows = {r.doc_id: r for r in t.op8_toxicity(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    p = chains[0].texts([texts[i] or "" for i in rows])
    assert np.allclose(p, [[r.p_insult, r.p_contempt, r.p_toxic] for r in rows.values()])
    assert [r.toxic for r in rows.values()] == [int(v >= t.THRESHOLD) for v in p[:, -1]]
    w, earlier, bias = chains[0].weights[-1]
    without = t.Chain(t.NAMES, chains[0].features, (*chains[0].weights[:-1], (w, np.zeros_like(earlier), bias)))
    assert ((without.texts([texts[i] or "" for i in rows])[:, -1] >= t.THRESHOLD) != (p[:, -1] >= t.THRESHOLD)).any()


def test_columns_named_like_statistics_stay(spark):
    df = spark.createDataFrame([(1, "a b", 5, 7)], "doc_id long, text string, s_words int, `odd.name` int")
    r = q.score(df, q.RuleModel(0.0, ())).first()
    assert r.asDict() == {"doc_id": 1, "text": "a b", "s_words": 5, "odd.name": 7, "score": 0.5}


@pytest.mark.parametrize("kind", ["empty", "one class"])
def test_cases(spark, kind):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "word " * 50_000, "z"), (3, "word " * 50_000, "z")], "doc_id long, text string, Score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    if kind == "empty":
        labels = labels.limit(0)
    got = q.score(docs, q.train(docs, labels)).collect()
    assert len(got) == 4 and len({round(r.score, 6) for r in got}) == 1
    got = t.score(docs, t.train(docs, labels)).collect()
    assert len(got) == 4 and all(r.p_toxic < 0.5 for r in got)
    assert t.score(docs.limit(0), t.train(docs, labels)).count() == 0
