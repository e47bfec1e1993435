"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each byte prefix of a piece there is exactly one token that the merge procedure leaves last.
``last[i]`` stores it, so a prefix's whole encoding is read off backwards, an append only extends
``last``, and an edit keeps every entry before it. A token ``t`` over bytes ``j..i`` is the last one
exactly if the pair ``(last[j], t)`` is stable: replaying both tokens' merges, no merge across their
border comes first.

Defined results: a null or empty text has no ids; a piece that is itself in the vocabulary is its
own id; long pieces take time linear in their length; rows repeat as given; an empty table gives an
empty table; columns clashing with an output's name are replaced.
"""

from __future__ import annotations

import base64
import struct
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import extend, text_of
from grainmill.tables import table

#: Entries of a worker's memo of encoded words, and the longest word that enters it. A full memo takes
#: no more words until half of the words looked up are missing from it; then it starts afresh.
MEMO_WORDS, MEMO_LENGTH = 400_000, 40
#: Entries of a worker's memos of stable pairs, and of the last tokens of prefixes up to a length in bytes.
PAIRS, PREFIXES, PREFIX_BYTES = 200_000, 200_000, 12


class Vocabulary:
    """Token ids by bytes, each token's final merge, and the stable-pair test."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        top = max(ranks.values()) + 1
        self.bytes_of: list[bytes | None] = [None] * top
        for b, r in ranks.items():
            self.bytes_of[r] = b
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.halves: list[tuple[int, int] | None] = [None] * top
        self.usable = bytearray(top)
        self._pairs: dict[int, bool] = {}
        self._known: dict[bytes, int] = {}
        for r, b in enumerate(self.bytes_of):
            if b is None:
                continue
            if len(b) == 1:
                self.usable[r] = 1
                continue
            for i in range(1, len(b)):
                x, y = ranks.get(b[:i], top), ranks.get(b[i:], top)
                if x < r and y < r and self.usable[x] and self.usable[y] and self._stable(x, y, r):
                    self.halves[r], self.usable[r] = (x, y), 1
                    break
        #: Ends of tokens: the token's id where the end is a whole token, else -1.
        self.ends = {b[i:]: -1 for r, b in enumerate(self.bytes_of) if b is not None and self.usable[r] for i in range(1, len(b))}
        self.ends.update((b, r) for r, b in enumerate(self.bytes_of) if b is not None and self.usable[r])

    @classmethod
    def read(cls, data: bytes) -> Vocabulary:
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)})

    def _stable(self, x: int, y: int, before: int) -> bool:
        """Whether merging by ranks below ``before`` leaves the tokens ``x`` and ``y`` beside each other.

        The two tokens at the border are undone, latest merge first; at each moment the merge of the
        pieces that touch the border must come later than the merge just undone. Of equal ranks the
        leftmost merge goes first, hence a border merge beats an equal one on its right only.
        """
        names, rank = self.bytes_of, self.rank
        while True:
            joined = rank.get(names[x] + names[y])
            if joined is not None and joined < before:
                return False
            left, right = self.halves[x], self.halves[y]
            if left is None and right is None:
                return True
            if right is None or (left is not None and x > y):
                before, x = x, left[1]
            else:
                before, y = y + 1, right[0]

    def stable(self, x: int, y: int) -> bool:
        found = self._stable(x, y, len(self.halves))
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        self._pairs[x << 32 | y] = found
        return found

    def __getstate__(self):
        return self.__dict__ | {"_pairs": {}, "_known": {}}


class PieceTable:
    """``last[i]``: the last token of the encoding of the first ``i`` bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Exact: earlier entries stay as they are."""
        start = len(self.data)
        self.data += data
        b, last = self.data, self.last
        ends, stable, pairs, known = self.v.ends, self.v.stable, self.v._pairs, self.v._known
        look, store = not start, len(known) < PREFIXES
        for i in range(start + 1, len(b) + 1):
            if i <= PREFIX_BYTES and look:  # prefixes are kept in order, so after the first unknown one none is known
                t = known.get(b[:i])
                if t is not None:
                    last.append(t)
                    continue
                look = False
            j = i - 1
            while True:
                t = ends.get(b[j:i])
                if t is None or j < 0:
                    raise AssertionError("no valid last token: the ranks are not those of a byte-level BPE")
                if t >= 0:
                    if not j:
                        break
                    fits = pairs.get(last[j] << 32 | t)
                    if fits or (fits is None and stable(last[j], t)):
                        break
                j -= 1
            last.append(t)
            if store and i <= PREFIX_BYTES:
                known[b[:i]] = t

    def replace(self, start: int, stop: int, data: bytes) -> None:
        """Replaces bytes ``start..stop``; entries up to ``start`` stay."""
        tail = self.data[stop:]
        self.data = self.data[:start]
        del self.last[start + 1 :]
        self.append(data + tail)

    def ids(self) -> list[int]:
        whole = self.v.rank.get(self.data)
        if whole is not None:
            return [whole]
        out, i = [], len(self.data)
        while i:
            t = self.last[i]
            out.append(t)
            i -= len(self.v.bytes_of[t])
        return out[::-1]


def splitter(pattern: str) -> regex.Pattern:
    """The pattern with white space as the Unicode property, as the tiktoken library reads it."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Encoder:
    """Encodes whole texts; the memo keeps words' ids as packed little-endian integers."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, by_space: bool):
        self.v, self.split, self.by_space = vocabulary, splitter(pattern), by_space
        self.memo: dict[str, bytes] = {}
        self.seen = self.missed = 0

    def pieces(self, text: str) -> list[str]:
        return [m.group() for m in self.split.finditer(text)]

    def chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for p in self.pieces(chunk):
            if p[0] == " " and (kept := self.memo.get(p[1:])) is not None:
                ids += struct.unpack(f"<{len(kept) // 4}I", kept)
                continue
            b = p.encode("utf-8", "replace")
            t = self.v.rank.get(b)
            if t is not None:
                ids.append(t)
            else:
                ids += PieceTable(self.v, b).ids()
        return struct.pack(f"<{len(ids)}I", *ids)

    def letters(self, word: str) -> bytes:
        """A space and letters only: one piece."""
        b = (" " + word).encode()
        t = self.v.rank.get(b)
        ids = [t] if t is not None else PieceTable(self.v, b).ids()
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: str) -> bytes:
        self.missed += 1
        if word.isalpha():
            found = self.letters(word)
        elif word[-1] in ".,!?;:" and word[:-1].isalpha():  # letters, then one mark: two pieces
            stem = word[:-1]
            found = (self.memo.get(stem) or self.letters(stem)) + self.chunk(word[-1])
        else:
            found = self.chunk(" " + word)
        if len(word) <= MEMO_LENGTH:
            if len(self.memo) < MEMO_WORDS:
                self.memo[word] = found
            elif self.seen > 1_000_000:
                if self.missed > 0.5 * self.seen:
                    self.memo.clear()
                self.seen = self.missed = 0
        return found

    def packed(self, text: str) -> bytes:
        """The ids of a text, packed.

        A space before a character other than white space always starts a piece, so words between
        such spaces are encoded by themselves, and mostly found in the memo.
        """
        if not self.by_space:
            return self.chunk(text)
        first, *words = text.split(" ")
        self.seen += len(words)
        known = [*map(self.memo.get, words)]
        if None not in known:
            return self.chunk(first) + b"".join(known)
        if all(w and not w[0].isspace() for w, k in zip(words, known, strict=True) if k is None):
            memo = self.memo
            return self.chunk(first) + b"".join([k if k is not None else memo.get(w) or self.word(w) for w, k in zip(words, known, strict=True)])
        out, run = [], [first]  # blanks that meet: keep them together
        head = True
        for w, k in zip(words, known, strict=True):
            if k is None and not (w and not w[0].isspace()):
                run.append(w)
                continue
            out.append(self._run(run, head))
            run, head = [w], False
        out.append(self._run(run, head))
        return b"".join(out)

    def _run(self, run: list[str], head: bool) -> bytes:
        if head:
            return self.chunk(" ".join(run))
        return self.memo.get(run[0]) or self.word(run[0]) if len(run) == 1 else self.chunk(" " + " ".join(run))


class EditableText:
    """A text with its pieces and ids; appends and edits re-encode only pieces near them."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.e, self.text, self.starts, self.encoded = encoder, "", [], []
        self.edit(0, 0, text)

    def ids(self) -> list[int]:
        return [i for x in self.encoded for i in x]

    def append(self, text: str) -> None:
        self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replaces characters ``start..stop``; returns how many pieces were encoded anew.

        Pieces that end before the one touching ``start`` stay. Splitting then runs from there until a
        piece starts, after the edit, where an old piece started; from that place on old pieces hold.
        """
        k = max(0, bisect_right(self.starts, start) - 2)
        at = self.starts[k] if self.starts else 0
        shift = len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        old = {s + shift: i for i, s in enumerate(self.starts) if s >= stop}
        starts, encoded, resume = self.starts[:k], self.encoded[:k], None
        fresh = 0
        for m in self.e.split.finditer(self.text, at):
            if m.start() > start + len(new) and m.start() in old:
                resume = old[m.start()]
                break
            starts.append(m.start())
            encoded.append(np.frombuffer(self.e.chunk(m.group()), "<u4").tolist())
            fresh += 1
        if resume is not None:
            starts += [s + shift for s in self.starts[resume:]]
            encoded += self.encoded[resume:]
        self.starts, self.encoded = starts, encoded
        return fresh


def load(spark: SparkSession, path: str, pattern: str):
    """Reads a rank file on the driver (some MB, fixed by the vocabulary) and broadcasts its tables."""
    with open(path, "rb") as f:
        v = Vocabulary.read(f.read())
    return spark.sparkContext.broadcast((v, pattern, _starts_at_spaces(pattern)))


def _starts_at_spaces(pattern: str) -> bool:
    """Whether pieces start at each space before a visible character, tried on the awkward contexts."""
    p = splitter(pattern)
    cases = [a + " " + b for a in ("a", "1", ".", "\n", " ", "\t\n", "'", "a'", "é") for b in ("a", "1", ".", "'s", "éa", "_", "́")]
    return all(any(m.start() == c.rindex(" ") for m in p.finditer(c)) and "".join(m.group() for m in p.finditer(c)) == c for c in cases)


_encoders: dict[int, Encoder] = {}


def encoder_of(tables) -> Encoder:
    """A worker's encoder for a broadcast; it lives as long as the worker does."""
    v, pattern, by_space = tables.value
    e = _encoders.get(id(v))
    if e is None or e.v is not v:
        _encoders.clear()
        e = _encoders[id(v)] = Encoder(v, pattern, by_space)
    return e


def encode(df: DataFrame, tables, text_col: str = "text") -> DataFrame:
    """Adds ``n_tokens`` and ``ids_le``, the ids as little-endian unsigned 32-bit integers."""

    def kernel():
        e = encoder_of(tables)

        def run(texts: pa.Array) -> list:
            out = [e.packed(t) for t in text_of(texts)]
            return [pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())]

        return run

    return extend(df, [text_col], "n_tokens long, ids_le binary", kernel)


def decode(df: DataFrame, tables, ids_col: str = "ids_le") -> DataFrame:
    """Adds ``decoded``: the bytes that the ids of ``ids_col`` stand for (null ids: no bytes)."""

    def kernel():
        names = tables.value[0].bytes_of

        def run(ids: pa.Array) -> list:
            return [pa.array([bytes_of_ids(names, x or b"") for x in ids.to_pylist()], pa.binary())]

        return run

    return extend(df, [ids_col], "decoded binary", kernel)


def bytes_of_ids(names: list[bytes], packed: bytes) -> bytes:
    return b"".join(map(names.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def round_trip(df: DataFrame, tables, text_col: str = "text") -> DataFrame:
    """``decode(encode(df))`` in one pass of Python workers."""

    def kernel():
        e = encoder_of(tables)

        def run(texts: pa.Array) -> list:
            out = [e.packed(t) for t in text_of(texts)]
            back = [bytes_of_ids(e.v.bytes_of, x) for x in out]
            return [pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary()), pa.array(back, pa.binary())]

        return run

    return extend(df, [text_col], "n_tokens long, ids_le binary, decoded binary", kernel)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tables = load(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    out = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), tables)
    return out.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op1_bpe": op1_bpe}
ORACLES: dict[str, str] = {}
