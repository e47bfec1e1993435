"""Secret scans: keyword automaton, anchored expressions at its hits, embedded checksums.

An Aho-Corasick automaton over the rules' keywords walks each text once. Only at its hits are the
rules' expressions tried, anchored where the hit demands. Kinds that carry a check of their own
(CRC-32 in base 62, a decodable JSON header, a key block with both of its lines) are kept only when
the check holds. Runs of hexadecimal digits have no keyword; a byte-class pass finds them.

Each search is linear in the text: a run that can't begin a token is tried once, and END lines of key
blocks are listed once.

Defined results: a null or empty text has no spans; a token whose header can't be parsed is none; spans are in code points, end exclusive; a match
that fails its length rule is dropped and what it covered is not searched again for that kind; long
texts are scanned whole; repeated rows give repeated results; an empty table gives an empty table;
columns clashing with an output's name are replaced.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from bisect import bisect_left

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import extend, text_of
from grainmill.tables import table

KINDS = ("assign", "access", "hex", "checked", "jwt", "key")
BASE = KINDS[:3]

#: Fixed values of the base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

#: Prefixes of tokens that end in a six-digit base-62 CRC-32 of what stands before it.
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CHECKED = re.compile(r"(ghp_|gho_|ghu_|ghs_|ghr_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]{16,}")
JWT_RUN = re.compile(r"[A-Za-z0-9_-]*")
KEY = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----")
KEY_END = re.compile(r"-----END ([A-Z ]*PRIVATE KEY)-----")
MIN_KEY = 16
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True


def crc62(body: str) -> str:
    """CRC-32 of the body, as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _jwt_ok(token: str) -> bool:
    """Whether the header is a JSON object that names an algorithm; one nested too deeply to parse isn't."""
    head = token.partition(".")[0]
    try:
        header = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(header, dict) and "alg" in header


def _key_ends(text: str) -> dict[str, list[tuple[int, int]]]:
    """The END lines of key blocks by label, as (start, end), in order."""
    out: dict[str, list[tuple[int, int]]] = {}
    for m in KEY_END.finditer(text):
        out.setdefault(m[1], []).append(m.span())
    return out


def _key_end(text: str, start: int, lines: dict[str, list[tuple[int, int]]]) -> int:
    """Where the key block that begins at ``start`` ends, however long it is; 0 if it has no END line."""
    m = KEY.match(text, start)
    own = lines.get(m[1], []) if m else []
    at = bisect_left(own, (m.end() + MIN_KEY,)) if own else 0
    return own[at][1] if at < len(own) else 0


def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


class Scanner:
    def __init__(self):
        self.folded = _automaton(ASSIGN_WORDS)
        self.exact = _automaton(("AKIA", *CHECKED_PREFIXES, "eyJ", "-----BEGIN "))

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """Spans of the base kinds as (start, kind, end), sorted."""
        found = []
        end = 0
        for last, n in self.folded.iter(text.lower() if text.isascii() else text.translate(_LOWER)):
            start = last - n + 1
            if start >= end and (m := ASSIGN.match(text, start)):
                end = m.end()
                if len(m[2]) >= MIN_ASSIGN:
                    found.append((start, 0, end))
        return found

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """All spans as (start, kind, end), sorted by start, then kind."""
        found = self.base(text) if any(w in text for w in "=:") else []
        ends = [0] * len(KINDS)
        lines: dict[str, list[tuple[int, int]]] | None = None
        for last, n in self.exact.iter(text):
            start = last - n + 1
            c = text[start]
            if c == "-":
                if lines is None:
                    lines = _key_ends(text)
                if start >= ends[5] and (end := _key_end(text, start, lines)):
                    ends[5] = end
                    found.append((start, 5, end))
                continue
            if c == "A":
                kind, m = 1, ACCESS.match(text, start) if start >= ends[1] else None
                ok = m and m.end() - start >= MIN_ACCESS
            elif c == "e":
                kind, m = 4, JWT.match(text, start) if start >= ends[4] else None
                ok = m and _jwt_ok(m[0])
                if not m and start >= ends[4]:  # what follows the run fails for all other starts in it too
                    ends[4] = JWT_RUN.match(text, start).end()
            else:
                kind, m = 3, CHECKED.match(text, start) if start >= ends[3] else None
                ok = m and crc62(m[2]) == m[3]
            if m:
                ends[kind] = m.end()
                if ok:
                    found.append((start, kind, m.end()))
        found += [(s, 2, e) for s, e in hex_runs(text)]
        found.sort()
        return found


def hex_runs(text: str) -> list[tuple[int, int]]:
    """Maximal runs of at least ``MIN_HEX`` of the characters 0-9 and a-f, in code points.

    A run of that length covers a place in every ``MIN_HEX``-th position, so only those are looked at
    first; few texts have one whose neighbours are in the class too.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) < MIN_HEX:
        return []
    inside = _HEX[data]
    step = MIN_HEX // 2
    probe = inside[step - 1 :: step]
    if not (probe[:-1] & probe[1:]).any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    starts, ends = edge[0::2], edge[1::2]
    long = ends - starts >= MIN_HEX
    starts, ends = starts[long], ends[long]
    if len(starts) and len(data) != len(text):
        chars = np.cumsum((data & 0xC0) != 0x80)
        starts = chars[starts] - 1
        ends = chars[ends - 1]
    return [*zip(starts.tolist(), ends.tolist(), strict=True)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``secrets``, an array of (kind, start, end, value, base), ``base_spans`` and ``spans``."""

    def kernel():
        scanner = Scanner()

        def run(texts: pa.Array) -> list:
            found, base, every = [], [], []
            for t in text_of(texts):
                spans = scanner.spans(t)
                found.append([{"kind": KINDS[k], "start": s, "end": e, "value": t[s:e], "base": k < len(BASE)} for s, k, e in spans])
                base.append(joined([x for x in spans if x[1] < len(BASE)]))
                every.append(joined(spans))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("base", pa.bool_())]))
            return [pa.array(found, kind), pa.array(base, pa.string()), pa.array(every, pa.string())]

        return run

    return extend(df, [text_col], "secrets array<struct<kind:string,start:long,end:long,value:string,base:boolean>>, base_spans string, spans string", kernel)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, BASE), F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


QUERIES = {"op5_secrets": op5_secrets}
ORACLES: dict[str, str] = {}
