"""op9: rules against whole-text expressions; the tagger's gradient, decoding and added kinds."""

import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grainmill.llm import op9_pii as op


def check_luhn(d):
    n = [int(c) for c in d]
    return (sum(n[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in n[-2::-2])) % 10 == 0


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and check_luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, r, ok in RULES for m in re.finditer(r, text or "") if ok(m[0])]


PART = st.sampled_from(["a", "b.c", "@", "@x.y", "+", "1", "255", "256.", "1.2.3.4", ".", " ", "-", "(", ")", "4532015112830366", "+1 (555) 123-4567", "é", "🙂", "\n", "000", "_"])


@settings(max_examples=800, deadline=None)
@given(st.lists(PART, max_size=14).map("".join))
def test_rules(text):
    assert [f"{op.KINDS[k]}:{s}:{e}" for k, s, e in op.base_spans(text)] == brute(text)


def test_gradient():
    q = op.Tagger(width=3)
    q.p = {k: v.astype(np.float64) for k, v in q.p.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(0, 20, (3, 7)), r.integers(0, op.TAGS, (3, 7))
    _, g = q.loss(x, y)
    for k in g:
        i = (x[0, 2], 1) if k[0] == "x" else tuple(s // 2 for s in q.p[k].shape)
        keep = q.p[k][i]
        q.p[k][i] = keep + 1e-4
        up = q.loss(x, y)[0]
        q.p[k][i] = keep - 1e-4
        down = q.loss(x, y)[0]
        q.p[k][i] = keep
        assert abs((up - down) / 2e-4 - g[k][i]) < 1e-3


@pytest.fixture(scope="module")
def tagger():
    return op.Tagger().fit(*(a[:1500] for a in op.examples(*op.synthetic(n=500))), passes=6)


def test_tagger_finds_held_out_spans(tagger):
    texts, spans = op.synthetic(seed=99, n=150)
    got = op.decode(tagger, texts)
    hit = sum(len({*a} & {*b}) for a, b in zip(got, spans, strict=True))
    assert hit >= 0.85 * sum(map(len, spans)) and hit >= 0.85 * sum(map(len, got))


def one_by_one(tagger, text):
    """Every window by itself, scores by depth, and the best path character by character."""
    x, out = op.char_classes(text), []
    for a, b in op.stretches(x):
        own = x[a:b]
        e, depth = np.zeros((len(own), op.TAGS)), np.full(len(own), -1)
        for s in op.window_starts(len(own)):
            part = own[s : s + op.WINDOW]
            got = tagger.scores(np.pad(part, (0, op.WINDOW - len(part)))[None])[0]
            for i in range(len(part)):
                d = min(i, len(part) - 1 - i) + (op.WINDOW if s == 0 and i < op.STRIDE else 0)
                if d > depth[s + i]:
                    depth[s + i], e[s + i] = d, got[i]
        score, back = e[0] + tagger.p["s"], []
        for t in range(1, len(own)):
            z = score[:, None] + tagger.p["t"]
            back.append(z.argmax(0))
            score = z.max(0) + e[t]
        tags = [int(score.argmax())]
        for q in reversed(back):
            tags.append(int(q[tags[-1]]))
        tags, kind = tags[::-1], -1
        for i, t in enumerate([*tags, 0]):
            if kind >= 0 and t != 2 + 2 * kind:
                out.append((kind, a + begun, a + i))
                kind = -1
            if t % 2:
                kind, begun = (t - 1) // 2, i
    return out


def test_decoding_is_exact_and_does_not_depend_on_pieces(tagger, monkeypatch):
    texts, _ = op.synthetic(seed=5, n=20)
    texts += [" ".join(texts), "12 " * 300, "", "9" * 64, "1" * 65, "a@b.c"]
    want = [one_by_one(tagger, t) for t in texts]
    assert op.decode(tagger, texts) == want and len(want[20]) > 30
    monkeypatch.setattr(op, "PIECE", 128)
    assert op.decode(tagger, texts) == want


def test_long_runs_of_digits(tagger):
    start = time.time()
    text = "4 5 6 +1 7-" * 30_000
    assert op.decode(tagger, [text]) == op.decode(tagger, [text])
    assert time.time() - start < 60
    many = "".join(f"+1 555 123 {i:04d} x 10.0.0.{i % 256} " for i in range(8000))
    assert sum(x[3] for x in op.merged(many, [(3, 5, 9), (1, 8_000_000, 8_000_007)])) == 16_000


def test_leading_zeros():
    assert op.base_spans("0" * 5000 + ".1.1.1") == [(1, 0, 5006)]
    assert [k for k, _, _ in op.base_spans("0" * 5000 + "256.1.1.1")] == []


def test_training_does_not_depend_on_partitions(spark):
    rows = [(None if i % 3 else i, f"call +1 (555) 123-{i:04d} or write a{i}@b.example.com about {i}") for i in range(300)] + [(1, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    x, y = op.labelled(df.repartition(1), 100)
    x2, y2 = op.labelled(df.repartition(7), 100)
    assert (x == x2).all() and (y == y2).all() and 50 < len(x) < 150 and (y > 0).any()
    assert op.labelled(df.limit(0))[0].shape == (0, op.WINDOW)
    assert op.find(df, op.train(df)).count() == 302


def test_base_stays_and_kinds_are_added(tagger):
    text = "call (555) 123-4567 today or +1 (555) 123-4567 or write ab.12@mail3.example.com"
    spans = op.merged(text, op.decode(tagger, [text])[0])
    assert {x[:3] for x in spans} >= {*op.base_spans(text)}
    assert all(not (a[1] < b[2] and b[1] < a[2]) for a in spans for b in spans if a is not b and not (a[3] and b[3]))


def test_cases(spark, tagger):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "1" * 100_000, "c"), (4, "a@b.co " * 3000, "d"), (4, "a@b.co " * 3000, "d")], "doc_id long, text string, SPANS string")
    rows = op.find(df, tagger).orderBy("doc_id").collect()
    assert [r.base_spans.count("email") for r in rows] == [0, 0, 0, 3000, 3000]
    masked = op.mask(df, tagger).orderBy("doc_id").collect()
    assert masked[0].text is None and "@" not in masked[3].text and "[email]" in masked[3].text
    assert op.find(df.limit(0), tagger).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op.op9_pii(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in op.KINDS]
        assert {*want} <= {*filter(None, r.spans.split(","))}
