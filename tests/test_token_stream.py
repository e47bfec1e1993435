"""Paragraphs once by ranges, the token stream that no shuffle moves, and memos that keep frequent keys."""

from grainmill.functions import bpe
from grainmill.operators import packing as K
from grainmill.operators.dedup import paragraphs, paragraphs_once
from grainmill.plans.tokens import TOKENIZER
from grainmill.registry import QUERIES

LONG = "a paragraph that is certainly longer than fifty characters"
BLANKS = " \t\x0b\f\r"


def once(rows, least=50):
    """The paragraphs of all texts once, by a plain loop."""
    seen, out = set(), []
    for k, text in sorted(rows):
        kept = []
        for p in (text or "").split("\n\n"):
            p = p.strip(BLANKS + "\n")
            if p and (len(p) < least or p not in seen):
                kept.append(p)
            if len(p) >= least:
                seen.add(p)
        if len("\n\n".join(kept)) >= least:
            out.append((k, "\n\n".join(kept)))
    return out


def odd_rows():
    rows = [(i, f"short {i % 7}\n\n {LONG} {i % 50}\t\n\n\n{LONG}\n\n{'é日' * (i % 40)}") for i in range(300)]
    return [*rows, (900, None), (901, ""), (902, " \n\n\t"), (903, "\n\n".join(f"{LONG} of {i}" if i % 3 else f"no {i}" for i in range(3000))), (-5, f"{BLANKS}{LONG}{BLANKS}")]


def test_paragraphs_by_ranges(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = once(rows)
    assert sorted(map(tuple, paragraphs_once(df).collect())) == want
    assert [tuple(r) for r in paragraphs_once(df, ranges=6).collect()] == want  # ranges come out in order
    assert paragraphs_once(df.limit(0), ranges=6).isEmpty()


def test_ends_of_paragraphs(spark):
    texts = ["", " ", "a", f"{BLANKS}a b{BLANKS}", "x\n\n\n y\n \n\nz ", "  a  ", "a" * 70_000 + " " * 70_000 + "b" + " " * 70_000]
    got = spark.createDataFrame([(x,) for x in texts], "text string").select(paragraphs("text").alias("p")).collect()
    assert [r.p for r in got] == [[p.strip(BLANKS + "\n") for p in x.split("\n\n")] for x in texts]


def test_stream_of_tokens(spark):
    rows = odd_rows()
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id")
    want, at = [], 0
    for k, text in sorted(rows):
        ids = TOKENIZER.encode(text or "")
        if len(ids) >= 9:
            want.append((k, at, [*ids, TOKENIZER.END]))
            at += len(ids) + 1
    assert sorted(map(tuple, K.token_stream(texts, TOKENIZER, "doc_id", least=9).collect())) == want
    assert K.token_stream(texts.limit(0), TOKENIZER, "doc_id").isEmpty()


def test_no_shuffle_moves_ids(spark):
    setting = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(setting)
    spark.conf.set(setting, "-1")  # no small table is broadcast that a large one wouldn't be
    try:
        plan = QUERIES["p6_pretokenized"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(setting, usual)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "Exchange" not in plan[: plan.index("BroadcastExchange")]


def test_frequent_keys_are_made_once(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 4)
    made = []
    memo = bpe.Memo(lambda k: made.append(k) or k.upper())
    for i in range(100):
        assert memo["the"] == "THE" and memo[f"w{i}"] == f"W{i}" and memo["x" * 100] == "X" * 100
        assert len(memo) <= 4 and len(memo.old) <= 4
    assert made.count("the") == 1 and made.count("x" * 100) == 100
