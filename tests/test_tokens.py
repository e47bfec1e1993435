"""The token queries over whole texts, by brute force."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken

from grainmill import catalog
from grainmill.functions.bpe import MergeTokenizer
from grainmill.operators import packing
from grainmill.plans.tokens import BLOCK, vocabulary

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def digest(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_words_are_merged_like_the_vocabularys_own_encoder():
    t = vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    true = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    first = 4 + len(packing.CHAT_TOKENS)
    for w in ("hello", "Donaudampfschiff", "été", "漢字かな", "x" * 300, "abab" * 50, "\n\n  ", "12345678"):
        assert [i - first for i in t.encode(w, ends=False)] == true.encode_ordinary(w)


def test_encoded_and_decoded(spark, texts):
    t = vocabulary()
    for q, most in (("p4_encoded", 1), ("p3_dropout", 3)):
        rows = QUERIES[q](spark, SF).collect()
        assert len(rows) == len(texts)
        for r in rows:
            ids = t.encode(texts[r.doc_id] or "")
            assert t.decode(ids) == (texts[r.doc_id] or "") and len(ids) <= r.n <= most * len(ids)
            assert q == "p3_dropout" or (r.n == len(ids) and r.digest == digest(ids))
    assert any(t.encode(x, dropout=0.3, seed=1) != t.encode(x) and t.decode(t.encode(x, dropout=0.3, seed=1)) == x for x in texts.values() if x)
    assert [r.digest for r in QUERIES["p3_dropout"](spark, SF).orderBy("doc_id").collect()] == [r.digest for r in QUERIES["p3_dropout"](spark, SF).orderBy("doc_id").collect()]


def test_pretokenized_offsets(spark):
    rows = QUERIES["p6_pretokenized"](spark, SF).orderBy("doc_id").collect()
    at = 0
    for r in rows:
        assert r.offset == at and r.ids[-1] == MergeTokenizer.END
        at += len(r.ids)


def test_rules_of_ids(spark, texts):
    t = vocabulary()
    for r in QUERIES["f18_f19_f21_ids"](spark, SF).collect():
        n = len(t.encode(texts[r.doc_id] or ""))
        assert (r.enough, r.sft, r.dpo, r.inside) == (n >= 5, n <= 4 * BLOCK + 1, n <= 4 * BLOCK, True)


def test_masks_allow_what_the_spans_do(spark):
    assert all(r.pairs == r.expected for r in QUERIES["p8_masks"](spark, SF).collect())


def test_chats(spark):
    talks = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        talks.setdefault(r.conv_id, []).append({"role": r.role, "content": r.text})
    t = vocabulary()
    for r in QUERIES["p10_rendered"](spark, SF).collect():
        ids, learnt = packing.render(t, talks[r.conv_id], most=BLOCK)
        assert r.ids == ids and r.learnt == learnt
    for r in QUERIES["x14_parsed"](spark, SF).collect():
        text = talks[r.conv_id][r.turn]["content"] if talks[r.conv_id][r.turn]["role"] == "assistant" else None
        assert text is None or (r.content == text.strip() and r.thinking == str(len(text)) and f'"n": {len(text)}' in r.calls)
    labels = QUERIES["p12_feedback"](spark, SF).collect()
    assert labels and all(len(r.chosen) == len(r.rejected) == len(r.chosen_labels) for r in labels)


def test_preferences_and_fits(spark, texts):
    t = vocabulary()
    rows = {r.doc_id: r for r in QUERIES["p13_preferences"](spark, SF).collect()}
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for k, x in texts.items():
        line, _, rest = (x or "").partition("\n")
        want = packing.preference(t, line, (x or "")[len(line) :], sources[k], 4 * BLOCK)
        assert (k in rows) == (want is not None)
        if want:
            r = rows[k]
            assert (r.chosen, r.chosen_labels, r.rejected, r.rejected_labels) == (*want["chosen"], *want["rejected"])
