"""Shared plumbing: Arrow-batched column kernels, samples, and hashes of words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from grainmill.shipping import ship

Kernel = Callable[..., list]

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim, _libc.mallopt  # noqa: B018
except (OSError, AttributeError):
    _libc = None
#: glibc's number for the size from which memory is taken from the system, and given back to it, by itself.
_ALONE = -3


def tidy() -> None:
    """Gives what a worker has freed back to the system.

    Workers live on through a job's later stages, and so would the most memory that any stage took in between.
    """
    pa.default_memory_pool().release_unused()
    if _libc:
        _libc.malloc_trim(0)


def large_apart() -> None:
    """Has arrays of a megabyte or more taken from the system and given back one by one."""
    if _libc:
        _libc.mallopt(_ALONE, 1 << 20)


def tidied(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f``, a kernel over a task's batches, with large arrays apart from small ones, and tidied up at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large_apart()
        try:
            yield from f(batches)
        finally:
            tidy()

    return run


def extend(df: DataFrame, inputs: list[str], outputs: str, kernel: Callable[[], Kernel]) -> DataFrame:
    """``df`` with the columns of the DDL ``outputs``, computed in Arrow batches.

    ``kernel()`` is called once in each task and gives a function from the input arrays to a list of
    output arrays. Columns of ``df`` that clash with an output's name (in any case) are replaced.
    """
    ship(df.sparkSession)
    outs = StructType.fromDDL(outputs)
    taken = {f.name.lower() for f in outs}
    kept = [f for f in df.schema if f.name.lower() not in taken]
    kept_names = [f.name for f in kept]
    need = list(dict.fromkeys([*kept_names, *inputs]))
    source = df.select(*[f"`{c}`" for c in need])
    names = kept_names + outs.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = kernel()
        for b in batches:
            for piece in slices(b, inputs):
                cols = f(*[piece.column(c) for c in inputs])
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in kept_names] + [x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names=names)
            del b, piece, cols
            tidy()

    return source.mapInArrow(tidied(run), StructType(kept + list(outs)))


def slices(b: pa.RecordBatch, inputs: list[str], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy pieces of a batch with about ``limit`` bytes of input each; a row is never cut."""
    if b.num_rows <= 1:
        yield b
        return
    sizes = np.full(b.num_rows, 16, np.int64)
    for c in inputs:
        a = b.column(c)
        if pa.types.is_string(a.type) or pa.types.is_binary(a.type):
            sizes += np.diff(np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1])
    ends = np.cumsum(sizes)
    cuts = np.flatnonzero(np.diff(ends // limit)) + 1
    for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
        if stop > start:
            yield b.slice(start, stop - start)


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """About ``limit`` rows, chosen by a hash of ``key`` over the whole table.

    The hash's threshold follows from the row count, so no task sorts the table. The number of rows varies
    about ``limit`` by its square root; rows that share a key are chosen or left together.
    """
    n = df.count()
    part = F.pmod(F.xxhash64(key, F.lit(20)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    return df.filter(part < min(1.0, limit / max(n, 1)))


def labelled_ids(labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, y) of about ``limit`` labelled ids, each once; of several labels of one id the largest counts."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    return bounded_sample(known, "doc_id", limit).groupBy("doc_id").agg(F.max("y").alias("y"))


def text_of(array: pa.Array) -> list[str]:
    """Texts of a string column; null is empty."""
    return [x or "" for x in array.to_pylist()]


_MULT = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0x5DEECE66D * 2 + 1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit moves about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        step = np.full(max(n, 2 * len(_powers)), _ODD)
        step[0] = 1
        _powers = np.multiply.accumulate(step)
    return _powers[:n]


def word_bounds(data: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes not in ``apart``: space and 0x09-0x0D by default."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(apart[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


class Hasher:
    """64-bit hashes of parts of a byte string.

    A part's hash is a polynomial of its bytes modulo 2**64, read off running sums (each scaled to a
    common power) and finalised with the part's length; equal parts have equal hashes everywhere.
    """

    def __init__(self, data: np.ndarray):
        self.n = n = len(data)
        self.run = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n)[::-1], out=self.run[1:])

    def __call__(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        raw = (self.run[e] - self.run[s]) * inverse_powers(self.n + 1)[self.n - e]
        return mix(raw ^ ((e - s).astype(np.uint64) * _MULT))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of UTF-8 bytes, in order."""
    s, e = word_bounds(data)
    return Hasher(data)(s, e) if len(s) else np.zeros(0, np.uint64)


_inverses = np.ones(1, np.uint64)
_INV = np.uint64(pow(int(_ODD), -1, 1 << 64))


def inverse_powers(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        step = np.full(max(n, 2 * len(_inverses)), _INV)
        step[0] = 1
        _inverses = np.multiply.accumulate(step)
    return _inverses[:n]


def lower_ascii(text: str | None) -> np.ndarray:
    """UTF-8 bytes with A-Z lower-cased, other characters as they are."""
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
