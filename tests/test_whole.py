"""Queries read whole texts: what lies far into a document counts too."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill import catalog
from grainmill.operators import packing
from grainmill.operators import retrieval as R
from grainmill.plans.tokens import vocabulary

QUERIES = catalog.queries()
LONG = "plain words and more of them go on here. " * 120


@pytest.fixture
def tables(spark, tmp_path):
    """Writes a table of rows to a data folder and gives the folder."""

    def put(name, schema, rows):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def test_p7_packs_whole_documents(spark, tables):
    texts = {1: LONG, 2: "short", 3: "", 4: None, **{i: LONG[: 97 * i] for i in range(5, 40)}}
    rows = QUERIES["p7_packed"](spark, tables("documents", "doc_id long, text string", list(texts.items()))).collect()
    own = vocabulary()
    want = Counter(i for t in texts.values() for i in own.encode(t or ""))
    pieces = [r.ids[a:b] for r in rows for a, b in zip(r.starts, r.ends, strict=True)]
    assert Counter(i for p in pieces for i in p[:-1]) == want and all(p[-1] == own.END for p in pieces)
    assert all(len(r.ids) <= 512 and r.ends[-1] == len(r.ids) for r in rows)
    assert len({r.row for r in rows}) == len(rows)
    whole = own.encode(LONG)
    assert {tuple(whole[i : i + 511]) for i in range(0, len(whole), 511)} <= {tuple(p[:-1]) for p in pieces}


@pytest.mark.parametrize(("n", "most", "width"), [(60, 200, 64), (400, 70, 64), (500, 16, 128), (300, 3, 32), (1, 1, 8)])
def test_packing_is_one_best_fit(spark, n, most, width):
    """Rows and spans are those of one best fit over all pieces, whatever the tasks."""
    r = random.Random(n)
    seqs = [(k, [r.randrange(90) for _ in range(r.randrange(most))]) for k in range(n)]
    got = packing.packed(spark.createDataFrame(seqs, "doc_id long, ids array<int>").coalesce(3), width, 99).orderBy("row").collect()
    pieces = [x[i : i + width - 1] for _, x in seqs for i in range(0, max(1, len(x)), width - 1)]
    rows, spans = packing.best_fit(pieces, width, 99)
    assert [r.ids for r in got] == rows and [list(zip(r.starts, r.ends, strict=True)) for r in got] == spans
    assert [r.row for r in got] == list(range(len(rows)))


def test_runs_of_large_counts():
    """A plan for many sequences is as short as one for few, and uses every sequence once within the width."""
    counts = np.array([0, *[10**9 + 7 * n for n in range(1, 65)]])
    runs = packing.best_fit_runs(counts, 64)
    assert len(runs) < 64 * 8
    few = packing.best_fit_runs(np.minimum(counts, 50), 64)
    _, spans = packing.best_fit([[0] * (n - 1) for n in range(1, 65) for _ in range(50)], 64, 1)
    assert few[:, 2].max() < len(spans) <= few[:, 2].max() + 50
    for n in range(1, 65):
        own = runs[runs[:, 0] == n]
        assert own[0, 1] == 0 and (np.diff(own[:, 1]) > 0).all() and (own[:, 4] + own[:, 3] * n <= 64).all()


def test_empty_tables_pack_to_none_and_ids_outside_fail(spark):
    assert packing.packed(spark.createDataFrame([], "ids array<int>"), 16, 1).isEmpty()
    got = packing.packed(spark.createDataFrame([(None,), ([],)], "ids array<int>"), 16, 1).collect()
    assert [(r.row, r.ids, r.starts, r.ends) for r in got] == [(0, [1, 1], [0, 1], [1, 2])]
    rows = spark.createDataFrame([([0, 3],), ([],), (None,)], "ids array<int>")
    assert [r.x for r in rows.select(packing.inside_vocabulary(F.col("ids"), 4).alias("x")).collect()] == [[0, 3], [], None]
    for size, bad in ((3, rows), (4, spark.createDataFrame([([-1],)], "ids array<int>"))):
        with pytest.raises(Exception, match="outside the vocabulary"):
            bad.select(packing.inside_vocabulary(F.col("ids"), size)).collect()


DOCS = "doc_id long, text string, lang string"


def test_samples_read_whole_texts(spark, tables):
    late = LONG + "Regenerate response. As an AI, I can't. A\tB\r\nC [[plain]] {{x}}"
    d = tables("documents", DOCS, [(5, late, "en"), (10, late, "en"), (11, LONG, "en"), (3, late, "en")])
    by = lambda q, c: {r.doc_id: r[c] for r in QUERIES[q](spark, d).collect()}
    assert by("f2_generated_whole", "generated")[5] and not by("f2_generated_whole", "generated")[11]
    assert by("f10_f11_f12_voice_whole", "boilerplate")[10]
    assert by("f2_generated", "generated")[5] and by("f10_f11_f12_voice", "boilerplate")[10] and by("t2_one_line", "line")[5].startswith(" ".join(late.split()))
    assert by("t1_clean_whole", "clean")[5] == late.replace("\r\n", "\n")
    assert by("t2_one_line_whole", "line")[5] == " ".join(late.split())
    assert by("t3_clean_wiki_whole", "clean")[5].startswith(LONG.strip())
    assert by("t5_book_text_whole", "body")[11] == LONG.strip()
    for q in ("t4_fan_wikitext", "t6_dump_wikitext"):
        assert LONG.strip() in by(q, "plain")[3] and "plain" in by(q, "plain")[3] and "[[" not in by(q, "plain")[3]


def test_keys_are_whole_texts(spark, tables):
    d = tables("documents", "doc_id long, text string", [(25, LONG + "a"), (26, LONG + "b"), (27, LONG + "A "), (28, LONG + "b"), (29, "q\n" + LONG), (30, " Q\n" + LONG)])
    ids = lambda q: sorted(r.doc_id for r in QUERIES[q](spark, d).collect())
    assert ids("j3_leak_guard_whole") == [26, 28, 29, 30]
    assert ids("d2_pairs_once") == ids("d3_captions_once") == [25, 26, 27, 29, 30]
    assert sorted((r.doc_id, r.n) for r in QUERIES["d9_questions_once"](spark, d).collect()) == [(25, 2), (26, 2), (29, 2)]


def test_j9_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", R.content_terms(F.col("text")).alias("t"))
    sets = {r.doc_id: set(r.t) for r in docs.collect()}
    want = {}
    for a, s in sets.items():
        near = [b for b, t in sets.items() if b < a and s & t and 2 * len(s & t) >= len(s | t)]
        want |= {a: min(near)} if near else {}
    assert want and {r.doc_id: r.replaces for r in QUERIES["j9_fuzzy_match"](spark, d).collect()} == want


def test_sets_and_bounds_of_whole_texts(spark, tables):
    rows = [(1, LONG + "seldom"), (2, LONG + "\u4e00"), (3, LONG + "\nlast line"), (4, "one short line")]
    tables("benchmark", "item_id long, text string", [(1, "seldom seen")])
    d = tables("documents", "doc_id long, text string", rows)
    assert QUERIES["u4_jaccard"](spark, d).first().k == 1
    assert {r.doc_id: r.inside for r in QUERIES["f21_vocab_bounds"](spark, d).collect()} == {1: True, 2: False, 3: True, 4: True}
    got = {r.doc_id: (r.status, r.prompt) for r in QUERIES["p11_fitted"](spark, d).collect()}
    assert got[4] == ("kept", "one short ") and got[3][0] == "trimmed" and LONG.strip().endswith(got[3][1])


def test_rules_judge_the_tables_texts(spark, tables):
    tables("conversations", "conv_id long, turn int, role string, text string", [(8, 0, "user", LONG + "what is 7 * 8"), (8, 1, "assistant", LONG)])
    d = tables("documents", "doc_id long, text string", [(11, LONG + "As an AI, I can't. </think>"), (23, LONG), (47, LONG + "a Qwen base model <search>x</search>")])
    assert {r.turn: r.arithmetic for r in QUERIES["f14_f15_intent_whole"](spark, d).collect()} == {0: True, 1: False}
    assert {r.reason: r.n for r in QUERIES["r9_mix_reasons_whole"](spark, d).collect()} == {"boilerplate": 1, "kept": 2}
    assert sorted(r.doc_id for r in QUERIES["r4_identity_whole"](spark, d).collect()) == [11, 23]
    assert [r.doc_id for r in QUERIES["f20_tag_rules_whole"](spark, d).collect() if r.doc_id == 47] == [47]
    assert "</think>" not in {r.doc_id: r.clean for r in QUERIES["t11_generated_whole"](spark, d).collect()}[11]
    assert all(r.valid for r in QUERIES["f13_valid_example"](spark, d).collect() if r.doc_id == 23)
    assert {r.id: r.completion for r in QUERIES["r9_mix_whole"](spark, d).collect()}[23] == LONG


def test_no_document_or_item_is_left_out(spark, tables):
    tables("labels", "doc_id long", [(1,), (2,), (3,)])
    tables("documents", "doc_id long, text string, n_chars long", [(1, "a", 1), (2, "b", 900), (3, "c", 900), (4, "d", 1), (5, "e", 1)])
    d = tables("benchmark", "item_id long, text string", [(i, "x") for i in range(40)])
    assert sorted(r.doc_id for r in QUERIES["u5_recrawl"](spark, d).collect()) == [2, 3, 4, 5]
    got = QUERIES["o16_distractors"](spark, d).collect()
    assert Counter(r.item_id for r in got) == Counter(r.other for r in got) == dict.fromkeys(range(40), 2)
    assert all(r.item_id != r.other for r in got) and len({(r.item_id, r.other) for r in got}) == 80
    assert any(r.item_id % 10 != r.other % 10 for r in got)


@pytest.mark.parametrize("items", [0, 1, 2])
def test_o16_of_few_items(spark, tables, items):
    d = tables("benchmark", "item_id long, text string", [(i, "x") for i in range(items)])
    assert sorted((r.item_id, r.other, r["rank"]) for r in QUERIES["o16_distractors"](spark, d).collect()) == ([(0, 1, 1), (1, 0, 1)] if items == 2 else [])
