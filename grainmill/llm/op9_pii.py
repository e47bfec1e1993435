"""Personal data: rules, plus a character-level bidirectional LSTM with CRF transitions.

The rules find e-mail addresses, IP addresses, payment cards and telephone numbers exactly. The tagger
is trained in numpy from labelled spans and reads overlapping windows around places that can hold
personal data; where windows overlap, each character's scores come from the window in which it stands
farthest from an edge, and one best path over the whole joined stretch decides its spans. The path is found
exactly from segments: each segment's best scores from every tag to every tag, the best tags at segments'
ends, then the paths within. Segments of many texts are computed together, and of a long stretch only its
segments' scores are kept, so memory is bounded by some bytes for each character. The rules' spans stay;
the tagger adds spans that overlap none of them.

Every kind needs a digit or an at sign, so only stretches around these are read by the tagger.

Defined results: a null or empty text has no spans; spans are in code points, end exclusive; a rule's
match that fails its check is dropped and not retried; texts are read whole; repeated rows give
repeated results; an empty table gives an empty table; columns clashing with an output's name are
replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import extend, text_of
from grainmill.shipping import ship
from grainmill.tables import table

KINDS = ("email", "ip", "card", "phone")

#: Fixed values of the base rules.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
NEEDED = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the rules as (kind, start, end), sorted."""
    found = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_SET:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            found.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    if not DIGITS.search(text):
        return found
    for m in IP.finditer(text):
        parts = [x.lstrip("0") or "0" for x in m[0].split(".")]
        if all(len(x) <= 3 and int(x) <= 255 for x in parts):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.findall(m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


# ---- the tagger ---------------------------------------------------------------------------------

#: Tags: 0 outside; 1 + 2k begins kind k; 2 + 2k continues it.
TAGS = 1 + 2 * len(KINDS)
CLASSES, WIDTH, WINDOW, STRIDE, REACH = 48, 16, 64, 32, 24

#: Characters by class: letters, digits and marks that matter are told apart, others share classes.
_MARKS = "@._%+-() \n:/\"',;=#*!&$[]{}|<>"


def char_classes(text: str) -> np.ndarray:
    """The class of each character: lower, upper, other letters, digits, each mark, the rest."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _ASCII[np.minimum(codes, 127)], np.uint8(3))


_ASCII = np.full(128, 4, np.uint8)
_ASCII[[*range(97, 123)]] = 1
_ASCII[[*range(65, 91)]] = 2
for _i, _c in enumerate(_MARKS):
    _ASCII[ord(_c)] = 5 + _i
for _i in range(10):
    _ASCII[48 + _i] = 5 + len(_MARKS) + _i
assert 5 + len(_MARKS) + 10 <= CLASSES


class Tagger:
    """Embedding, LSTMs both ways, tag scores, CRF transitions; float32 throughout."""

    def __init__(self, width: int = WIDTH, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.width = width
        self.p = {}
        for way in "fb":
            self.p["x" + way] = 0.5 * f(CLASSES, 4 * width) * np.sqrt(CLASSES).astype(np.float32)
            self.p["h" + way] = f(width, 4 * width)
            bias = np.zeros(4 * width, np.float32)
            bias[width : 2 * width] = 1
            self.p["c" + way] = bias
        self.p["o"] = f(2 * width, TAGS)
        self.p["d"] = np.zeros(TAGS, np.float32)
        self.p["t"] = 0.1 * f(TAGS, TAGS)
        self.p["s"] = np.zeros(TAGS, np.float32)

    def _walk(self, x: np.ndarray, way: str, keep: bool):
        n, steps = x.shape
        w = self.width
        h, c = np.zeros((n, w), np.float32), np.zeros((n, w), np.float32)
        out = np.empty((steps, n, w), np.float32)
        trace = []
        b = self.p["c" + way]
        wx, wh, at = self.p["x" + way] + b, self.p["h" + way], np.ascontiguousarray(x.T, np.intp)
        half = np.repeat(np.array([0.5, 1], b.dtype), [3 * w, w])
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            g = wx.take(at[t], axis=0)
            g += h @ wh
            g *= half  # a sigmoid is a tangent of half the argument, halved and raised
            np.tanh(g, out=g)
            g *= half
            g += 1 - half
            i, f, o, u = (g[:, k * w : (k + 1) * w] for k in range(4))
            c2 = f * c + i * u
            tc = np.tanh(c2)
            if keep:
                trace.append((t, h, c, g, tc))
            h, c = o * tc, c2
            out[t] = h
        return out, trace

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(windows, steps, tags) emission scores."""
        h = np.concatenate([self._walk(x, w, False)[0] for w in "fb"], axis=2)
        return (h @ self.p["o"] + self.p["d"]).transpose(1, 0, 2)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tag paths ``y`` and its gradient."""
        n, steps = x.shape
        (hf, tf), (hb, tb) = self._walk(x, "f", True), self._walk(x, "b", True)
        h = np.concatenate([hf, hb], axis=2)
        e = h @ self.p["o"] + self.p["d"]
        trans, first = self.p["t"], self.p["s"]
        rows = np.arange(n)
        alpha = np.empty_like(e)
        alpha[0] = e[0] + first
        for t in range(1, steps):
            z = alpha[t - 1][:, :, None] + trans
            m = z.max(1)
            alpha[t] = m + np.log(np.exp(z - m[:, None]).sum(1)) + e[t]
        m = alpha[-1].max(1)
        logz = m + np.log(np.exp(alpha[-1] - m[:, None]).sum(1))
        gold = first[y[:, 0]] + sum(e[t][rows, y[:, t]] for t in range(steps)) + sum(trans[y[:, t - 1], y[:, t]] for t in range(1, steps))
        de, dt = np.zeros_like(e), np.zeros_like(trans)
        beta = np.zeros((n, e.shape[2]), np.float32)
        for t in range(steps - 1, -1, -1):
            de[t] = np.exp(alpha[t] + beta - logz[:, None])
            if t:
                joint = alpha[t - 1][:, :, None] + trans + (e[t] + beta)[:, None, :]
                dt += np.exp(joint - logz[:, None, None]).sum(0)
                m = joint.max(2)
                beta = m + np.log(np.exp(joint - m[:, :, None]).sum(2)) - alpha[t - 1]
                np.add.at(dt, (y[:, t - 1], y[:, t]), -1)
            de[t][rows, y[:, t]] -= 1
        g = {"t": dt / n, "s": de[0].sum(0) / n, "o": np.einsum("tnw,tnk->wk", h, de) / n, "d": de.sum((0, 1)) / n}
        dh = de @ self.p["o"].T / n
        w = self.width
        for way, trace, part in (("f", tf, dh[:, :, :w]), ("b", tb, dh[:, :, w:])):
            gx, gh, gb = np.zeros_like(self.p["x" + way]), np.zeros_like(self.p["h" + way]), np.zeros_like(self.p["c" + way])
            nh, nc = np.zeros((n, w), np.float32), np.zeros((n, w), np.float32)
            for t, h0, c0, gate, tc in reversed(trace):
                i, f, o, u = (gate[:, k * w : (k + 1) * w] for k in range(4))
                d = part[t] + nh
                c = d * o * (1 - tc * tc) + nc
                a = np.concatenate([c * u * i * (1 - i), c * c0 * f * (1 - f), d * tc * o * (1 - o), c * i * (1 - u * u)], axis=1)
                np.add.at(gx, x[:, t], a)
                gh += h0.T @ a
                gb += a.sum(0)
                nh, nc = a @ self.p["h" + way].T, c * f
            g["x" + way], g["h" + way], g["c" + way] = gx, gh, gb
        return float((logz - gold).mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray, passes: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Tagger:
        r, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(passes):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                own = order[i : i + batch]
                _, g = self.loss(x[own], y[own])
                step += 1
                norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
                for k, q in g.items():
                    q = q * min(1.0, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * q
                    v[k] = 0.99 * v[k] + 0.01 * q * q
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


def stretches(classes: np.ndarray, reach: int = REACH) -> list[tuple[int, int]]:
    """Parts of a text within ``reach`` of a digit or an at sign; parts that touch are one."""
    at = np.flatnonzero((classes >= 5 + len(_MARKS)) | (classes == 5))
    if not len(at):
        return []
    gaps = np.flatnonzero(np.diff(at) > 2 * reach)
    starts = at[np.concatenate(([0], gaps + 1))] - reach
    ends = at[np.concatenate((gaps, [len(at) - 1]))] + reach + 1
    return [*zip(np.maximum(starts, 0).tolist(), np.minimum(ends, len(classes)).tolist(), strict=True)]


def window_starts(n: int) -> list[int]:
    return [*range(0, max(1, n - WINDOW + STRIDE), STRIDE)]


def tag_spans(tags: np.ndarray, start: int = 0) -> list[tuple[int, int, int]]:
    """Spans (kind, start, end) of a tag path: a beginning tag and the continuing tags of its kind after it."""
    begun = np.flatnonzero(tags % 2)
    if not len(begun):
        return []
    edges = np.append(np.flatnonzero(tags[1:] != tags[:-1]) + 1, len(tags))
    after = np.minimum(begun + 1, len(tags) - 1)
    goes_on = (begun + 1 < len(tags)) & (tags[after] == tags[begun] + 1)
    ends = np.where(goes_on, edges[np.searchsorted(edges, begun + 1, side="right").clip(max=len(edges) - 1)], begun + 1)
    return [*zip(((tags[begun] - 1) // 2).tolist(), (begun + start).tolist(), (ends + start).tolist(), strict=True)]


#: Characters of a segment of the best path; characters and windows computed together.
SEGMENT, PIECE, BLOCK = 64, 1 << 16, 512


@dataclass
class Piece:
    """Characters a..b of a stretch; ``a`` is a multiple of the segment's length."""

    x: np.ndarray
    a: int
    b: int


class Segments:
    """Best scores within the segments of some pieces, from each tag before a segment to each tag at its end.

    A stretch's first segment has one lane, as nothing precedes it; others have a lane for each entering tag.
    """

    def __init__(self, tagger: Tagger, pieces: list[Piece], traced: bool = True):
        self.counts = [-(-(p.b - p.a) // SEGMENT) for p in pieces]
        total = sum(self.counts)
        e = np.zeros((total, SEGMENT, TAGS), np.float32)
        sizes, first, at = np.full(total, SEGMENT), np.zeros(total, bool), 0
        for p, n, own in zip(pieces, self.counts, emissions(tagger, pieces), strict=True):
            e[at : at + n].reshape(-1, TAGS)[: p.b - p.a] = own
            sizes[at + n - 1] = p.b - p.a - (n - 1) * SEGMENT
            first[at] = p.a == 0
            at += n
        lanes = np.where(first, 1, TAGS)
        self.lane = np.concatenate(([0], np.cumsum(lanes)))  # the first lane of each segment
        self.first = first
        of = np.repeat(np.arange(total), lanes)
        trans = tagger.p["t"]
        score = np.where(first[of][:, None], tagger.p["s"], trans[np.arange(len(of)) - self.lane[of]]) + e[of, 0]
        score, e, sizes = np.ascontiguousarray(score.T), np.ascontiguousarray(e.transpose(1, 2, 0)), sizes[of]
        self.back = np.zeros((SEGMENT, TAGS, len(of)), np.uint8) if traced else None
        short = sizes.min() if len(sizes) else SEGMENT
        for t in range(1, SEGMENT):
            step = score[0] + trans[0][:, None]
            for j in range(1, TAGS):
                z = score[j] + trans[j][:, None]
                if traced:
                    self.back[t][z > step] = j
                np.maximum(step, z, out=step)
            step += e[t][:, of]
            if t >= short:
                over = sizes <= t
                step[:, over] = score[:, over]
                if traced:
                    self.back[t][:, over] = np.arange(TAGS)[:, None]
            score = step
        self.score = score.T.astype(np.float64)

    def ways(self) -> list[list[np.ndarray]]:
        """For each piece its segments' scores: (entering tags or 1, tags)."""
        out, at = [], 0
        for n in self.counts:
            out.append([self.score[self.lane[i] : self.lane[i + 1]] for i in range(at, at + n)])
            at += n
        return out

    def paths(self, entering: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """(segments, SEGMENT): the best tags within each segment, given the tags before it and at its end."""
        lane = self.lane[:-1] + np.where(self.first, 0, entering)
        out = np.empty((len(lane), SEGMENT), np.uint8)
        now = ending
        for t in range(SEGMENT - 1, -1, -1):
            out[:, t] = now
            if t:
                now = self.back[t, now, lane]
        return out


def emissions(tagger: Tagger, pieces: list[Piece]) -> list[np.ndarray]:
    """Each piece's scores of its characters, each from the window in which it stands farthest from an edge."""
    grids, picks, rows = [], [], 0
    for p in pieces:
        at = np.arange(p.a, p.b)
        last = (max(1, len(p.x) - STRIDE) - 1) // STRIDE
        k = at // STRIDE
        own = np.where((k == 0) | ((at % STRIDE >= STRIDE // 2) & (k <= last)), k, k - 1)
        low, high = int(own[0]), int(own[-1])
        need = np.zeros((high - low + 2) * STRIDE, np.uint8)
        part = p.x[low * STRIDE : (high + 2) * STRIDE]
        need[: len(part)] = part
        grids.append(np.lib.stride_tricks.sliding_window_view(need, WINDOW)[::STRIDE])
        picks.append((rows + own - low, at - own * STRIDE))
        rows += high - low + 1
    grid = np.concatenate(grids)
    e = np.concatenate([tagger.scores(grid[i : i + BLOCK]) for i in range(0, rows, BLOCK)])
    return [e[r, c] for r, c in picks]


def ends_of(ways: list[np.ndarray]) -> np.ndarray:
    """The best path's tags at the ends of a stretch's segments."""
    score, back = ways[0][0], []
    for w in ways[1:]:
        z = score[:, None] + w
        back.append(z.argmax(0))
        score = z.max(0)
        score = score - score.max()
    out = np.empty(len(ways), np.int64)
    out[-1] = score.argmax()
    for i in range(len(back) - 1, -1, -1):
        out[i] = back[i][out[i + 1]]
    return out


def best_paths(tagger: Tagger, stretches: list[np.ndarray]) -> list[np.ndarray]:
    """The best tags of each of some stretches of at most ``PIECE`` characters."""
    s = Segments(tagger, [Piece(x, 0, len(x)) for x in stretches])
    ends = [ends_of(w) for w in s.ways()]
    entering = np.concatenate([np.concatenate(([0], x[:-1])) for x in ends])
    tags, out, at = s.paths(entering, np.concatenate(ends)), [], 0
    for x, n in zip(stretches, s.counts, strict=True):
        out.append(tags[at : at + n].ravel()[: len(x)])
        at += n
    return out


def long_path(tagger: Tagger, x: np.ndarray) -> np.ndarray:
    """The best tags of one stretch of any length: its pieces are computed twice, and not kept."""
    pieces = [Piece(x, a, min(len(x), a + PIECE)) for a in range(0, len(x), PIECE)]
    ends = ends_of([w for p in pieces for w in Segments(tagger, [p], traced=False).ways()[0]])
    entering, out, at = np.concatenate(([0], ends[:-1])), np.empty(len(x), np.uint8), 0
    for p in pieces:
        s = Segments(tagger, [p])
        n = s.counts[0]
        out[p.a : p.b] = s.paths(entering[at : at + n], ends[at : at + n]).ravel()[: p.b - p.a]
        at += n
    return out


def decode(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans the tagger finds in each text."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    held: list[tuple[int, int, np.ndarray]] = []
    waiting = 0

    def flush() -> None:
        for (doc, start, _), tags in zip(held, best_paths(tagger, [x for _, _, x in held]), strict=True):
            found[doc] += tag_spans(tags, start)
        held.clear()

    for d, t in enumerate(texts):
        if not NEEDED.search(t):
            continue
        x = char_classes(t)
        for a, b in stretches(x):
            if b - a > PIECE:
                found[d] += tag_spans(long_path(tagger, x[a:b]), a)
                continue
            held.append((d, a, x[a:b]))
            waiting += b - a
            if waiting > PIECE:
                flush()
                waiting = 0
    if held:
        flush()
    for own in found:
        own.sort(key=lambda s: s[1])
    return found


def examples(texts: list[str], spans: list[list[tuple[int, int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Training windows and their tags, taken where the tagger will look."""
    xs, ys = [], []
    for t, own in zip(texts, spans, strict=True):
        x = char_classes(t)
        y = tags_of(len(x), own)
        for a, b in stretches(x):
            for s in window_starts(b - a):
                xs.append(padded(x, a + s, b))
                ys.append(padded(y, a + s, b))
    return np.array(xs, np.int64).reshape(-1, WINDOW), np.array(ys, np.int64).reshape(-1, WINDOW)


def tags_of(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(n, np.uint8)
    for kind, s, e in spans:
        y[s:e] = 2 + 2 * kind
        y[s] = 1 + 2 * kind
    return y


def padded(v: np.ndarray, start: int, stop: int) -> np.ndarray:
    part = v[start : min(stop, start + WINDOW)]
    return np.pad(part, (0, WINDOW - len(part)))


#: Documented bound of the sample that the tagger is fitted on.
TRAIN_WINDOWS = 3000


def labelled(docs: DataFrame, limit: int = TRAIN_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """About ``limit`` windows of the texts and their tags, labelled by the rules.

    Every window of every text that the tagger will read may be chosen: by a hash of its characters' classes
    and its place, below a threshold that follows from the number of windows. Equal choices count once, and
    the windows come in the order of their hash, so they don't depend on how the table is split.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("text").alias("text")).filter("text RLIKE '[0-9@]'")

    def places(t: str) -> Iterator[tuple[np.ndarray, int, int]]:
        x = char_classes(t)
        for a, b in stretches(x):
            for s in window_starts(b - a):
                yield x, a + s, b

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for t in b.column("text"):
                n += sum(len(window_starts(e - a)) for a, e in stretches(char_classes(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    total = texts.mapInArrow(counted, "n long").agg(F.sum("n").alias("n")).first().n or 0
    least = int(min(1.0, limit / max(total, 1)) * (1 << 62))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, xs, ys = [], [], []
            for t in batch.column("text"):
                t, y = t.as_py(), None
                for x, a, b in places(t):
                    own = padded(x, a, b).astype(np.uint8).tobytes()
                    h = int.from_bytes(hashlib.blake2b(own + a.to_bytes(8, "big"), digest_size=8).digest(), "big") >> 2
                    if h < least:
                        y = tags_of(len(x), base_spans(t)) if y is None else y
                        hs.append(h)
                        xs.append(own)
                        ys.append(padded(y, a, b).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], names=["h", "x", "y"])

    rows = texts.mapInArrow(picked, "h long, x binary, y binary").groupBy("h").agg(F.min(F.struct("x", "y")).alias("w")).orderBy("h").limit(2 * limit).collect()
    grid = lambda name: np.frombuffer(b"".join(bytes(r.w[name]) for r in rows), np.uint8).reshape(-1, WINDOW).astype(np.int64)
    return grid("x"), grid("y")


def synthetic(seed: int = 11, n: int = 1200) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Labelled texts made from shapes, with kinds that the rules miss: addresses with blanks around the
    marks, national telephone numbers, and near misses that are nothing."""
    r = np.random.default_rng(seed)
    word = lambda: "".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9)))
    num = lambda k: "".join(str(d) for d in r.integers(0, 10, k))
    texts, spans = [], []
    for _ in range(n):
        out, own = "", []
        for _ in range(4):
            out += " ".join(word() for _ in range(r.integers(1, 5))) + " "
            k = int(r.integers(0, 9))
            value, kind = {
                0: (lambda: f"{word()}.{num(2)}@{word()}{num(1)}.example.com", 0),
                1: (lambda: f"{word()} @ {word()}.com", 0),
                2: (lambda: ".".join(str(x) for x in r.integers(0, 256, 4)), 1),
                3: (lambda: card(num(15)), 2),
                4: (lambda: f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", 3),
                5: (lambda: f"({num(3)}) {num(3)}-{num(4)}", 3),
                6: (lambda: f"{num(1)}.{num(1)}", -1),
                7: (lambda: num(int(r.integers(1, 9))), -1),
                8: (lambda: "".join("0123456789abcdef"[c] for c in r.integers(0, 16, 32)), -1),
            }[k]
            value = value()
            if kind >= 0:
                own.append((kind, len(out), len(out) + len(value)))
            out += value + r.choice([" ", ". ", "\n", "!! "])
        texts.append(out)
        spans.append(own)
    return texts, spans


def card(body: str) -> str:
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def train(docs: DataFrame) -> Tagger:
    """Fits the tagger on the driver: a bounded sample labelled by the rules, and synthetic texts."""
    x, y = labelled(docs)
    xs, ys = examples(*synthetic())
    return Tagger().fit(np.concatenate([x, xs[:TRAIN_WINDOWS]]), np.concatenate([y, ys[:TRAIN_WINDOWS]]))


def plausible(kind: int, value: str) -> bool:
    """Whether a span that the tagger adds has the parts its kind can't lack."""
    digits = len(DIGITS.findall(value))
    number = "".join(DIGITS.findall(value))
    return {0: "@" in value and "." in value, 1: value.count(".") == 3 and digits >= 4, 2: 13 <= digits <= 19 and luhn(number), 3: 7 <= digits <= 15 and len(value) >= 9}[kind]


def merged(text: str, tagged: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """The rules' spans and those of the tagger that overlap none of them, as (kind, start, end, base)."""
    base = base_spans(text)
    out = [(*x, True) for x in base]
    if tagged:
        taken = sorted((s, e) for _, s, e in base)
        reach = [*accumulate((e for _, e in taken), max)]
        for k, s, e in tagged:
            before = bisect_left(taken, (e,))  # the rules' spans that start before this one ends
            if plausible(k, text[s:e]) and not (before and reach[before - 1] > s):
                out.append((k, s, e, False))
    return sorted(out)


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[x[0]]}:{x[1]}:{x[2]}" for x in spans)


def find(df: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """Adds ``pii``, an array of (kind, start, end, value, base), ``base_spans`` and ``spans``."""
    ship_model = df.sparkSession.sparkContext.broadcast(tagger.p)  # some 30 kB, fixed by the widths

    def kernel():
        model = Tagger()
        model.p = ship_model.value

        def run(texts: pa.Array) -> list:
            texts = text_of(texts)
            found = [merged(t, s) for t, s in zip(texts, decode(model, texts), strict=True)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("base", pa.bool_())]))
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "value": t[s:e], "base": b} for k, s, e, b in own] for t, own in zip(texts, found, strict=True)]
            return [pa.array(rows, kind), pa.array([joined([x for x in own if x[3]]) for own in found], pa.string()), pa.array([*map(joined, found)], pa.string())]

        return run

    return extend(df, [text_col], "pii array<struct<kind:string,start:long,end:long,value:string,base:boolean>>, base_spans string, spans string", kernel)


def mask(df: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """``df`` with each span of personal data in ``text_col`` replaced by its kind in brackets (a null text stays null)."""
    ship_model = df.sparkSession.sparkContext.broadcast(tagger.p)

    def kernel():
        model = Tagger()
        model.p = ship_model.value

        def run(texts: pa.Array) -> list:
            plain = text_of(texts)
            out = []
            for raw, t, tagged in zip(texts.to_pylist(), plain, decode(model, plain), strict=True):
                parts, end = [], 0
                for k, s, e, _ in sorted(merged(t, tagged), key=lambda x: (x[1], -x[2])):
                    if e <= end:
                        continue
                    parts += [t[end : max(s, end)], f"[{KINDS[k]}]" if s >= end else ""]
                    end = e
                out.append(None if raw is None else "".join(parts) + t[end:])
            return [pa.array(out, pa.string())]

        return run

    order = df.columns
    return extend(df, [text_col], f"{text_col} string", kernel).select(*order)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find(docs, train(docs))
    count = lambda kind: F.size(F.filter("pii", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, KINDS), F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


QUERIES = {"op9_pii": op9_pii}
ORACLES: dict[str, str] = {}
