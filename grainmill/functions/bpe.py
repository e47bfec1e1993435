"""Merge-list tokenizers of words: splitting, encoding and decoding by given merges."""

from __future__ import annotations

import base64
import random
import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers and the tokens they stand for, and the word patterns of the two tokenizers.
MARKERS = {"Q:": "<Q>", "A:": "<A>", "User:": "<USER>", "Human:": "<USER>", "Bot:": "<BOT>", "Assistant:": "<BOT>"}
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\w+|[^\s\w]+"
WORD_OR_SPACE = WORD + r"|\s+"
#: Entries of each of a memo's two generations, and characters of a key in it, at most.
MEMO, MEMO_CHARS = 1 << 18, 64
#: Entries of the memo of words and the places of their skips, at most.
SKIPPED = 1 << 19
#: Characters of a word up to which pairs are searched in a list, beyond which in a heap.
SHORT = 48


def words(c: Column) -> Column:
    """P1 for texts without markers: words and runs of other marks; white space goes."""
    return F.regexp_extract_all(c, F.lit("(?U)" + WORD), F.lit(0))


def marked_words(text: str) -> list[str]:
    """Markers become their tokens, tags stay whole, the rest splits into words."""
    mark = r"(</?(?:think|search)>|(?<![A-Za-z])(?:Q|A|User|Bot|Human|Assistant):)"
    out: list[str] = []
    for i, part in enumerate(re.split(mark, text)):
        out += [MARKERS.get(part, part)] if i % 2 else re.findall(WORD, part)
    return out


class Memo(dict):
    """What ``make`` gives for short keys.

    A full memo becomes the old one, from which the keys that come up again return, so frequent keys are made once.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
            if len(key) > MEMO_CHARS:
                return got
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class Skips:
    """The places of a seeded stream of chances at which a merge is skipped; chances are drawn as they are needed.

    The stream is that of ``random.Random(seed)``.
    """

    def __init__(self, seed: int, dropout: float):
        key = [abs(seed) >> 32 * i & 0xFFFFFFFF for i in range(max(1, -(-abs(seed).bit_length() // 32)))]
        self.draw, self.dropout = np.random.RandomState(key).random_sample, dropout
        self.places: list[int] = []
        self.at = self.next = self.drawn = 0

    def _draw(self, n: int) -> None:
        self.places += (np.flatnonzero(self.draw(n) < self.dropout) + self.drawn).tolist()
        self.drawn += n

    def until(self, end: int) -> int:
        """The next place to skip, if it is before ``end``, else one that isn't."""
        while self.next >= len(self.places) and self.drawn < end:
            self._draw(max(256, end - self.drawn))
        return self.places[self.next] if self.next < len(self.places) else self.drawn

    def skip(self) -> bool:
        """Whether this merge is skipped; goes on to the next."""
        own = self.until(self.at + 1) == self.at < self.drawn
        self.next += own
        self.at += 1
        return own


class MergeTokenizer:
    """Merges in rank order within words; unknown pieces fall back to characters, then to ``unknown``.

    Ids: 0 pad, 1 begin, 2 end, 3 unknown, then specials, characters (or bytes) and merged tokens. A merge's
    rank is that of its pair, or, for a vocabulary of ranks, that of the token it makes.
    """

    PAD, BEGIN, END, UNKNOWN = 0, 1, 2, 3

    def __init__(self, merges: list[tuple[str, str]], specials: list[str] = (), alphabet: str | None = None, tokens: list[str] | None = None):
        self.bytes = alphabet is None
        chars = [chr(i) for i in range(256)] if self.bytes else sorted(set(alphabet))
        self.rank: dict = {p: i for i, p in enumerate(merges)} if tokens is None else {t: i for i, t in enumerate(tokens)}
        self.by_token = tokens is not None
        names = [*specials, *([*chars, *[a + b for a, b in merges]] if tokens is None else tokens)]
        self.id_of: dict[str, int] = {}
        for n in names:
            self.id_of.setdefault(n, 4 + len(self.id_of))
        self.name_of = {i: n for n, i in self.id_of.items()}
        longest = sorted(specials, key=len, reverse=True)
        self.specials = frozenset(specials)
        # words and white space begin with no other's first character, so they may be tried first
        free = not any(re.match(r"\w|\s", x) for x in specials)
        self.split = re.compile("|".join([*([r"\w+", r"\s+"] if free else []), *map(re.escape, longest), WORD_OR_SPACE]))
        #: Parts of a text that split by themselves as they do in it: up to where white space ends.
        self.parts = re.compile(r"\S+\s*|\s+" if not any(re.search(r"\s", x) for x in specials) else r"(?s).+")
        self._caches()

    @classmethod
    def from_ranks(cls, path: str, specials: list[str] = ()) -> MergeTokenizer:
        """A byte-level vocabulary of a given file: lines of a token in base 64 and its rank."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        return cls([], specials, tokens=[t.decode("latin-1") for t in sorted(ranks, key=ranks.__getitem__)])

    def _caches(self) -> None:
        self.packed, self.packed_part, self.skipped = Memo(self._packed), Memo(self._packed_part), {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("packed", "packed_part", "skipped")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._caches()

    def __len__(self) -> int:
        """Ids lie below this number."""
        return 4 + len(self.id_of)

    def _pieces(self, word: str) -> tuple[int, ...]:
        """The ids of a word."""
        if word in self.id_of:
            return (self.id_of[word],)
        return (self._short if len(word) <= SHORT else self._merged)(word)

    def _short(self, word: str, chances: Skips | None = None) -> tuple[int, ...]:
        get, none, by_token = self.rank.get, len(self.rank) + 1, self.by_token
        parts = list(word)
        ranks = [get(a + b if by_token else (a, b), none) for a, b in zip(parts, parts[1:], strict=False)]
        at, skipped = 0, none
        if chances:
            # a pair comes up once, and a merge makes two pairs at most
            at, skipped = chances.at, chances.until(chances.at + 3 * len(word))
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            if chances:
                at += 1
                if skipped < at:
                    chances.next += 1
                    skipped = chances.until(at + 3 * len(word))
                    ranks[i] = none
                    continue
            parts[i] = x = parts[i] + parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(x + parts[i + 1] if by_token else (x, parts[i + 1]), none)
            if i:
                ranks[i - 1] = get(parts[i - 1] + x if by_token else (parts[i - 1], x), none)
        if chances:
            chances.at = at
        return tuple([self.id_of.get(p, self.UNKNOWN) for p in parts])

    def _merged(self, word: str, chances: Skips | None = None) -> tuple[int, ...]:
        n = len(word)
        parts, after, before = list(word), [*range(1, n + 1)], [*range(-1, n - 1)]
        rank = (lambda i: self.rank.get(parts[i] + parts[after[i]])) if self.by_token else (lambda i: self.rank.get((parts[i], parts[after[i]])))
        todo = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapify(todo)
        while todo:
            _, i, a, b = heappop(todo)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b or (chances and chances.skip()):
                continue  # one of the two was merged meanwhile
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank(i)) is not None:
                    heappush(todo, (r, i, parts[i], parts[after[i]]))
            if (h := before[i]) >= 0 and (r := rank(h)) is not None:
                heappush(todo, (r, h, parts[h], parts[i]))
        return tuple(self.id_of.get(p, self.UNKNOWN) for p in parts if p)

    def _skipping(self, word: str, chances: Skips) -> bytes:
        """A word's ids where each merge that comes up has its own chance to be skipped.

        What merges come up follows from those skipped so far, so a word and the places of its skips say all.
        """
        start, first, key = chances.at, chances.next, word
        while (got := self.skipped.get(key)) is not None:
            end = start + got[1]
            at = chances.until(end)
            if at >= end:
                chances.at = end
                return got[0]
            chances.next += 1
            key = (key, at - start)
        chances.next = first
        own = self._own(word)
        ids = array("i", (self._short if len(own) <= SHORT else self._merged)(own, chances)).tobytes()
        if len(word) <= MEMO_CHARS:
            key = word
            for at in chances.places[first : chances.next]:
                key = (key, at - start)
            if len(self.skipped) >= SKIPPED:
                self.skipped.clear()
            self.skipped[key] = ids, chances.at - start
        return ids

    def _own(self, word: str) -> str:
        return word.encode("utf-8", "surrogatepass").decode("latin-1") if self.bytes else word

    def _packed(self, word: str) -> bytes:
        return array("i", [self.id_of[word]] if word in self.specials else self._pieces(self._own(word))).tobytes()

    def _packed_part(self, part: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.split.findall(part)))

    def _ids(self, text: str) -> bytes:
        return b"".join(map(self.packed_part.__getitem__, self.parts.findall(text)))

    def encode(self, text: str, ends: bool = True, dropout: float = 0.0, seed: int = 0) -> list[int]:
        if not text:
            return []
        out = array("i", self._dropped(text, dropout, seed) if dropout else self._ids(text)).tolist()
        return [self.BEGIN, *out, self.END] if ends else out

    def _dropped(self, text: str, dropout: float, seed: int) -> bytes:
        chances, out, whole, limit = Skips(seed, dropout), [], self.skipped.get, 0
        for w in self.split.findall(text):
            got = whole(w)
            if got is not None and chances.at + got[1] <= limit:  # as most words
                out.append(got[0])
                chances.at += got[1]
            elif w in self.specials:
                out.append(self.packed[w])
            else:
                out.append(self._skipping(w, chances))
                limit = chances.until(0)
        return b"".join(out)

    def encode_packed(self, text: str, dropout: float = 0.0, seed: int = 0) -> bytes:
        """Ids, begin and end among them, as 32-bit integers."""
        if not text:
            return b""
        return b"".join([array("i", [self.BEGIN]).tobytes(), self._dropped(text, dropout, seed) if dropout else self._ids(text), array("i", [self.END]).tobytes()])

    def first(self, text: str, most: int, ends: bool = True) -> list[int]:
        """The first ``most`` of the text's ids; the text is read as far as they go."""
        got, n = [], int(ends)
        for m in self.parts.finditer(text) if most > 0 else ():
            got.append(self.packed_part[m.group()])
            n += len(got[-1]) // 4
            if n >= most:
                break
        ids = array("i", b"".join(got)).tolist()
        return ([self.BEGIN, *ids, self.END] if ends and text else ids)[: max(0, most)]

    def last(self, text: str, most: int) -> list[int]:
        """The last ``most`` of the text's ids, without ends; the text is read from as far back as they go."""
        width = 8 * most
        while width < len(text):
            m = re.compile(r"(?<=\s)\S").search(text, len(text) - width) if self.parts.pattern[0] != "(" else None
            ids = array("i", self._ids(text[m.start() :])).tolist() if m else []
            if len(ids) >= most:
                return ids[-most:]
            width *= 4
        return array("i", self._ids(text)).tolist()[-most:]

    def decode(self, ids: list[int]) -> str:
        names = [self.name_of.get(i, "") for i in ids if i > self.UNKNOWN]
        if not self.bytes:
            return "".join(names)
        return b"".join(n.encode() if n in self.specials else n.encode("latin-1") for n in names).decode("utf-8", "replace")


class WordTokenizer:
    """P5: a known word is one id; other words are spelt; words are separated by the id of a blank."""

    PAD, BEGIN, END, UNKNOWN = 0, 1, 2, 3

    def __init__(self, words: list[str], alphabet: str):
        names = [*dict.fromkeys([" ", *alphabet, *words])]
        self.id_of = {n: 4 + i for i, n in enumerate(names)}
        self.name_of = {i: n for n, i in self.id_of.items()}

    def encode(self, text: str, ends: bool = True) -> list[int]:
        out: list[int] = []
        for i, w in enumerate(text.split(" ")):
            out += [self.id_of[" "]] * (i > 0)
            out += [self.id_of[w]] if w in self.id_of else [self.id_of.get(c, self.UNKNOWN) for c in w]
        return [self.BEGIN, *out, self.END] if ends else out

    def decode(self, ids: list[int]) -> str:
        return "".join(self.name_of.get(i, "") for i in ids)
