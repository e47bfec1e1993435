"""Scans over runs by ranges of the order, so that a run with most of the rows is no single task.

What a scan combines is associative: tasks first fold the rows of their range to one element, the elements of
earlier ranges give each range what stands before it, and a second reading gives every row its own. An element
of a range is that of its last run only, with the range's first and last run to say where runs begin.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from grainmill.checkpoints import cut
from grainmill.shipping import ship


@dataclass(frozen=True)
class Scan:
    """``lift`` makes a row's inputs an element, ``join`` puts an element after another, ``show`` gives an element's outputs."""

    outputs: str
    lift: Callable[..., tuple]
    join: Callable[[tuple, tuple], tuple]
    show: Callable[[tuple], tuple]


#: What stands for rows: first run, last run, whether a run begins inside, the last run's element.
Span = tuple


def after(a: Span | None, b: Span, join: Callable[[tuple, tuple], tuple]) -> Span:
    if a is None:
        return b
    if b[2] or a[1] != b[0]:
        return a[0], b[1], True, b[3]
    return a[0], b[1], a[2], join(a[3], b[3])


def scanned(df: DataFrame, run: str, order: Column, inputs: list[Column], scan: Scan, down: bool = False) -> DataFrame:
    """``df`` with the outputs of ``scan`` over the rows of each run up to each row, in ``order``, which is unique in a run.

    With ``down`` runs go from their last row to their first. The columns of ``df`` are written to the shared
    folder in between. A null run is a run; runs are told apart by their text. Columns named like outputs are
    replaced. One row a task reaches the driver.
    """
    ship(df.sparkSession)
    outs = StructType.fromDDL(scan.outputs)
    kept = [f for f in df.schema if f.name not in outs.names]
    row = F.struct(*[F.col(f"`{f.name}`") for f in kept]).alias("row")
    x = df.select(F.col(f"`{run}`").cast("string").alias("run"), order.alias("at"), row, *[c.alias(f"i{k}") for k, c in enumerate(inputs)])
    by = [F.col("run"), F.col("at").desc() if down else F.col("at")]
    ranged = cut(x.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()))
    names = [f"i{k}" for k in range(len(inputs))]

    def spans(b: pa.RecordBatch) -> Iterator[Span]:
        for key, *values in zip(b.column("run").to_pylist(), *[b.column(n).to_pylist() for n in names], strict=True):
            yield key, key, False, scan.lift(*values)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, part = None, None
        for b in batches:
            for s in spans(b):
                whole = after(whole, s, scan.join)
            part = b.column("part")[0].as_py() if b.num_rows else part
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(whole)], pa.binary())], names=["part", "span"])

    before: dict[int, Span | None] = {}
    so_far = None
    for r in sorted(ranged.select("run", "part", *names).mapInArrow(fold, "part int, span binary").collect()):
        before[r.part] = so_far
        so_far = after(so_far, pickle.loads(r.span), scan.join)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far, started = None, False
        for b in batches:
            if not b.num_rows:
                continue
            if not started:
                so_far, started = before[b.column("part")[0].as_py()], True
            shown = []
            for s in spans(b):
                so_far = after(so_far, s, scan.join)
                shown.append(scan.show(so_far[3]))
            cols = list(zip(*shown, strict=True))
            types = [pa.int64() if f.dataType.typeName() == "long" else pa.float64() for f in outs]
            yield pa.RecordBatch.from_arrays([b.column("row"), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["row", *outs.names])

    out = ranged.mapInArrow(give, StructType([ranged.schema["row"], *outs]))
    return out.select(*[F.col(f"row.`{f.name}`").alias(f.name) for f in kept], *outs.names)


def advantages_scan(gamma: float = 0.99, lam: float = 0.95) -> Scan:
    """W5 over rows from the last to the first, with inputs (reward, value): an advantage needs the one after it, and its value.

    Rows map (advantage, value) of the row after them to (a * advantage + b * value + c, w), and maps are put
    together; a single row is applied as the definition has it, so that roundings are the definition's.
    """

    def join(p: tuple, q: tuple) -> tuple:
        a, b, c, w, reward = q
        own = a * p[2] + b * p[3] + c if reward is None else reward + gamma * p[3] - w + gamma * lam * p[2]
        return a * p[0], a * p[1], own, w, None

    return Scan("advantage double", lambda r, v: (gamma * lam, gamma, r - v, v, r), join, lambda e: (e[2],))


def _moments(p: tuple, q: tuple) -> tuple:
    n, gap = p[0] + q[0], q[1] - p[1]
    return (n, p[1] + gap * q[0] / n, p[2] + q[2] + gap * gap * p[0] * q[0] / n) if n else p


#: Count, mean and deviation of the values so far, nulls left out, from one input.
MOMENTS = Scan("n long, mean double, deviation double", lambda v: (0, 0.0, 0.0) if v is None else (1, v, 0.0), _moments, lambda e: (e[0], e[1] if e[0] else None, (max(e[2], 0.0) / e[0]) ** 0.5 if e[0] else None))

#: The least value and the sum of a count so far, from (value, count).
LEAST_AND_SUM = Scan("best double, bytes long", lambda v, k: (v, k or 0), lambda p, q: (p[0] if q[0] is None else q[0] if p[0] is None else min(p[0], q[0]), p[1] + q[1]), lambda e: e)

#: A row's place in its run, from 1; no inputs.
COUNT = Scan("step long", lambda: (1,), lambda p, q: (p[0] + q[0],), lambda e: e)


def moving_average_scan(width: int) -> Scan:
    """Mean of the finite values of the last ``width`` rows; other rows carry the average before them, at first 0.

    An element holds the last rows, and those up to the last finite value; where these are fewer than ``width``
    they begin with the range, and earlier ranges fill them up.
    """
    good = lambda v: v is not None and math.isfinite(v)

    def join(p: tuple, q: tuple) -> tuple:
        known = q[1] if len(q[1]) == width else (p[0] + q[1])[-width:] if q[1] else p[1]
        return (p[0] + q[0])[-width:], known

    def show(e: tuple) -> tuple:
        own = [v for v in e[1] if good(v)]
        return (math.fsum(own) / len(own) if own else 0.0,)

    return Scan("average double", lambda v: ((v,), (v,) if good(v) else ()), join, show)
