"""op5's private-key blocks of any length."""

import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from grainmill.llm import op5_secrets as op

BLOCK = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----[\s\S]{16,}?-----END \1-----")
LINE = "MIIEowIBAAKCAQEA" * 4 + "\n"


def keys(text):
    return [(s, e) for s, k, e in op.Scanner().spans(text) if op.KINDS[k] == "key"]


def test_long_block():
    text = "x -----BEGIN RSA PRIVATE KEY-----\n" + LINE * 300 + "-----END RSA PRIVATE KEY----- y"
    assert keys(text) == [(2, len(text) - 2)]


PART = st.sampled_from([f"-----{w} {k}-----" for w in ("BEGIN", "END") for k in ("PRIVATE KEY", "RSA PRIVATE KEY", "PUBLIC KEY")] + ["A" * 15, "A" * 16, "\n", "-----", "\u00e9"])


@settings(max_examples=500, deadline=None)
@given(st.lists(PART, max_size=14).map("".join))
def test_blocks_are_those_of_the_expression(text):
    assert keys(text) == [m.span() for m in BLOCK.finditer(text)]


def test_begin_lines_without_end_take_linear_time():
    began = time.process_time()
    assert keys("-----BEGIN EC PRIVATE KEY-----\n" * 50_000) == []
    assert time.process_time() - began < 10
