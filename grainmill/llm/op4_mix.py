"""Mixing sources to target weights, with a curriculum that varies over training time.

Each source's target of words is its share of a budget by weight, stopped at a number of passes over the
source; what that leaves over is shared again by weight until no source is above. A source's weight
varies over training time by a schedule; its integral, scaled to the target, is the source's cumulative
demand. Documents of a source stand in the order of a hash; a document's place in the running sum of
words, put through the inverse of the cumulative demand, is its training position. The mix is
range-sorted by position.

The running sum takes two steps, so that no task holds a source: sums of hash buckets, and places within
a bucket. A source has several buckets for each task, and more as the table grows.

Defined results: a null text has no words; documents without words are taken 0 times; a null source is
a source, after all others; ties of the hash are broken by doc_id and size; repeated rows are rows of
their own; an empty table gives an empty table; the mix has the columns of its documents, whatever their
names, as they are carried in one struct.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainmill.checkpoints import cut
from grainmill.llm.common import extend
from grainmill.tables import table

#: (time, weight) points, from time 0 to 1; weights between points are linear, and positive.
Schedule = tuple[tuple[float, float], ...]


@dataclass(frozen=True)
class Mix:
    """Weights by the rank of a source (repeating), each with its schedule; budget and passes as shares of a size."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    schedules: tuple[Schedule, ...] = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
    budget: float = 1.5
    passes: float = 2.0
    seed: int = 17


#: Rows that a hash bucket of a source holds on average, at most.
BUCKET_ROWS = 4096


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``size``: the number of words, split at space and 0x09-0x0D."""

    def kernel():
        def run(texts: pa.Array) -> list:
            return [pa.array([len(t.encode("utf-8", "surrogatepass").split()) if t else 0 for t in texts.to_pylist()], pa.int64())]

        return run

    return extend(df, [text_col], "size long", kernel)


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """One row for each source: source_size, its place in the cycle of weights, and its target of words.

    Works on one row a source. A source is capped if its cap for each unit of weight is at most the level
    at which the uncapped ones share the rest; sorted by that ratio, the level is found by running sums.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(mix.weights)
    ranked = by_source.withColumn("place", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % n)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), F.col("place") + 1)
    capped = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * mix.passes).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", "place", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * mix.budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = capped.withColumn("level", level)
    shared = levels.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return shared.select("source", "source_size", "place", target.alias("target"))


def inverse_demand(share: Column, schedule: Schedule) -> Column:
    """The time by which a share of the schedule's integral has passed."""
    areas = [(a + b) / 2 * (t - s) for (s, a), (t, b) in zip(schedule, schedule[1:])]
    total, done, out = sum(areas), 0.0, None
    for ((s, a), (t, b)), area in zip(zip(schedule, schedule[1:]), areas):
        slope = (b - a) / (t - s)
        rest = share * total - done
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + 2 * slope * rest))
        at = F.least(F.lit(t), F.lit(s) + 2 * rest / (a + root))
        out = F.when(share * total <= done + area, at) if out is None else out.when(share * total <= done + area, at)
        done += area
    return out.otherwise(F.lit(schedule[-1][0]))


def placed(docs: DataFrame, mix: Mix = Mix(), text_col: str = "text", kept: Column | None = None) -> DataFrame:
    """doc_id and source of ``docs`` with size, source_size, target, taken, copies, and position (of the first copy).

    ``position`` is in 0..1 for documents the mix takes and above 1, in the same order, for others. ``kept`` is
    carried along under that name; no column of ``docs`` stands beside what is computed here.
    """
    order = F.xxhash64("doc_id", F.lit(mix.seed))
    own = [] if kept is None else [kept.alias("kept")]
    sized = word_counts(docs.select("doc_id", "source", F.col(f"`{text_col}`").alias("text"), *own)).drop("text")
    small = cut(sized.select("doc_id", "source", "size"))
    n = small.count()
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 1 << max((4 * tasks).bit_length(), (n // BUCKET_ROWS).bit_length())
    bucketed = lambda df: df.withColumn("_h", order).withColumn("_b", F.pmod(F.shiftright("_h", 20), F.lit(buckets)))
    sums = bucketed(small).groupBy("source", "_b").agg(F.sum("size").alias("_sum"))
    aim = targets(small, mix)
    offsets = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("source").orderBy("_b")) - F.col("_sum"))
    offsets = offsets.join(aim, offsets["source"].eqNullSafe(aim["source"])).select(offsets["source"].alias("_s"), F.col("_b").alias("_k"), "_before", "source_size", "place", "target")
    rows = bucketed(sized if own else small)
    within = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = rows.join(offsets, rows["source"].eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_k")))
    passes = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) + 1e-12)
    middle = F.col("_before") + F.col("_in") + F.col("size") / 2
    joined = joined.withColumn("_middle", middle).withColumn("_passes", passes)
    more = (F.col("_middle") < F.col("target") - F.col("_passes") * F.col("source_size")) & (F.col("size") > 0)
    joined = joined.withColumn("copies", F.when(F.col("size") > 0, F.col("_passes") + more.cast("int")).otherwise(F.lit(0)).cast("int"))
    share = F.when(F.col("target") > 0, F.col("_middle") / F.col("target")).otherwise(F.lit(1.0))
    at = time_of(share, mix)
    rest = F.when(F.col("source_size") > 0, F.col("_middle") / F.col("source_size")).otherwise(F.pmod("_h", F.lit(1 << 20)) / float(1 << 20))
    joined = joined.withColumn("taken", F.col("copies").cast("long") * F.col("size"))
    joined = joined.withColumn("position", F.when(F.col("copies") > 0, at).otherwise(1 + rest))
    return joined.drop("_s", "_k", "_h", "_b", "_in", "_before", "_passes")


def time_of(share: Column, mix: Mix) -> Column:
    out = None
    for i, s in enumerate(mix.schedules):
        own = F.col("place") == i
        out = F.when(own, inverse_demand(F.least(share, F.lit(1.0)), s)) if out is None else out.when(own, inverse_demand(F.least(share, F.lit(1.0)), s))
    return out


def mixed(docs: DataFrame, mix: Mix = Mix(), text_col: str = "text") -> DataFrame:
    """The mix itself: each taken copy of a document is a row, range-sorted by its training position.

    Columns are those of ``docs``. Copies of a document stand at their own positions.
    """
    kept = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(docs.columns)])
    rows = placed(docs, mix, text_col, kept).filter("copies > 0")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    share = (F.col("_copy") * F.col("source_size") + F.col("_middle")) / F.col("target")
    rows = rows.withColumn("position", time_of(share, mix))
    return rows.repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id").select(*[F.col(f"kept.k{i}").alias(c) for i, c in enumerate(docs.columns)])


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "position").repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


QUERIES = {"op4_mix": op4_mix}
ORACLES: dict[str, str] = {}
