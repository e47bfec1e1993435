"""Ids of a text's beginning and end, merges skipped at random, and fits that read no more than a block takes."""

import random
import zlib

import pytest

from grainmill.functions import bpe
from grainmill.operators import packing as K
from grainmill.plans.tokens import TOKENIZER, vocabulary

TEXTS = ["", " ", "  a  b ", "a\n\n\n b'sx don't <think>", "日本語" * 100, "x" * 300, "aé'll" * 30 + " " * 50 + "\n" * 40, " \n" * 300 + "word " * 400, "word " * 400 + " \n" * 300, "the nation " * 500 + "ends.\nhere"]


@pytest.fixture(params=[vocabulary, lambda: TOKENIZER])
def t(request):
    return request.param()


@pytest.mark.parametrize("text", TEXTS)
def test_first_and_last(t, text):
    ids, inner = t.encode(text), t.encode(text, ends=False)
    for most in (1, 2, 40, 5000):
        assert t.first(text, most) == ids[:most] and t.first(text, most, ends=False) == inner[:most] and t.last(text, most) == inner[-most:]


def heap(t, word, dropout, chance):
    """A word's ids, each merge that comes up skipped by its own chance."""
    parts, dead = list(word), set()
    while True:
        pairs = [(r, i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := t.rank.get(a + b if t.by_token else (a, b))) is not None and i not in dead]
        if not pairs:
            return [t.id_of.get(p, t.UNKNOWN) for p in parts]
        i = min(pairs)[1]
        if chance.random() < dropout:
            dead.add(i)
            continue
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        dead = {d for d in dead if d < i - 1} | {d - 1 for d in dead if d > i + 1}


@pytest.mark.parametrize("seed", [0, 7, 2**40 + 1])
def test_skips_follow_the_seed(t, seed):
    for text in (TEXTS[3], TEXTS[5], "the nations and then the interesting reason " * 20):
        chance, want = random.Random(seed), []
        for w in t.split.findall(text):
            want += [t.id_of[w]] if w in t.specials else heap(t, t._own(w), 0.3, chance)
        for _ in range(2):  # from scratch, and from what is remembered
            assert t.encode(text, ends=False, dropout=0.3, seed=seed) == want


def test_fits_read_what_a_block_takes(t, monkeypatch):
    read = []
    own = bpe.MergeTokenizer._packed_part
    t._caches()
    t.packed_part = bpe.Memo(lambda part: read.append(part) or own(t, part))
    words = [f"w{i}" for i in range(20_000)]
    text = " ".join(words)
    assert K.fitted(t, text, "end", 64)[0] == "trimmed" and K.fitted(t, "q", text, 64) == ("dropped", None)
    got = K.preference(t, "q", text, text[::-1], 64)
    assert len(got["chosen"][0]) == 64 and len(read) < 1500
    t._caches()
