"""op1: whole-table encoding against the tiktoken library, and the tables' appends and edits."""

import base64
import hashlib
import random
import struct

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from grainmill.llm import op1_bpe as op

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
TRUE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
V = op.Vocabulary(RANKS)
E = op.Encoder(V, P.PATTERN, True)
SOME = st.text(st.sampled_from("ab é\n\t 's1漢　🙂.-"), max_size=30)


@settings(max_examples=400, deadline=None)
@given(SOME)
def test_encodes_as_the_library(x):
    assert np.frombuffer(E.packed(x), "<u4").tolist() == TRUE.encode_ordinary(x)


@settings(max_examples=200, deadline=None)
@given(SOME, SOME, st.data())
def test_edits_are_exact(x, new, data):
    a = data.draw(st.integers(0, len(x)))
    b = data.draw(st.integers(a, len(x)))
    t = op.EditableText(E, x)
    t.edit(a, b, new)
    assert t.text == x[:a] + new + x[b:]
    assert t.ids() == TRUE.encode_ordinary(t.text)
    t.append(x)
    assert t.ids() == TRUE.encode_ordinary(t.text)


def test_edit_encodes_few_pieces():
    t = op.EditableText(E, "word and another word " * 500)
    assert t.edit(5000, 5003, "xyz") < 8


def test_prefixes_of_a_piece():
    word = b" unquestionableness" * 3
    t = op.PieceTable(V)
    for i in range(len(word)):
        t.append(word[i : i + 1])
    assert t.last == op.PieceTable(V, word).last
    assert t.ids() == TRUE._encode_single_piece(word)
    t.replace(4, 9, b"abc")
    assert t.ids() == TRUE._encode_single_piece(word[:4] + b"abc" + word[9:])


def test_table(spark):
    rng = random.Random(3)
    texts = ["", None, "a", "a", "  x\n\n y", "long " * 50_000, "".join(rng.choice("abcdeé ") for _ in range(20_000)), "z" * 3000]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, IDS_LE string")
    tables = op.load(spark, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rows = {r.doc_id: r for r in op.decode(op.encode(df, tables), tables).collect()}
    for i, t in enumerate(texts):
        ids = TRUE.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids)
        assert bytes(rows[i].ids_le) == struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(rows[i].decoded) == (t or "").encode()
    assert op.encode(df.limit(0), tables).count() == 0
    both = {r.doc_id: (r.n_tokens, bytes(r.ids_le), bytes(r.decoded)) for r in op.round_trip(df, tables).collect()}
    assert both == {k: (r.n_tokens, bytes(r.ids_le), bytes(r.decoded)) for k, r in rows.items()}


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op.op1_bpe(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = TRUE.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_needs_all_bytes():
    with pytest.raises(ValueError):
        op.Vocabulary({b"a": 0})
