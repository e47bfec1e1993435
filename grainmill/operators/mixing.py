"""Instruction mixes: teachings, identity and tool examples, gates over general records, and their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.predicates import boilerplate, foreign_identity, stale
from grainmill.operators.ranks import places


def teachings(df: DataFrame) -> DataFrame:
    """Each question with its answer by rotation, and with the next answer if that is another one.

    ``df`` has (id, questions, answers).
    """
    q = df.select("id", "answers", F.posexplode("questions").alias("i", "q"))
    n = F.size("answers")
    both = F.array_distinct(F.array(F.element_at("answers", F.col("i") % n + 1), F.element_at("answers", (F.col("i") + 1) % n + 1)))
    return q.filter(n > 0).select("id", F.trim("q").alias("prompt"), F.explode(both).alias("completion")).filter("prompt <> '' AND completion <> ''").distinct()


def identity(df: DataFrame) -> DataFrame:
    """(prompt, completion) of anchors without those that name a stale lineage."""
    return df.filter(~stale(F.col("completion")))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.cast("string").alias("content"))


def tool_call(tool: str, argument: str, value: Column) -> Column:
    return F.to_json(F.struct(F.lit(tool).alias("name"), F.struct(value.alias(argument)).alias("arguments")))


def tool_examples(df: DataFrame, template: str, tool: str, argument: str) -> DataFrame:
    """Conversations that call a tool, one for each value; ``df`` has (id, value, result)."""
    call = tool_call(tool, argument, F.col("value"))
    return df.select("id", F.array(message("user", F.format_string(template, "value")), message("assistant", call), message("tool", F.col("result")), message("assistant", F.col("result"))).alias("messages"))


def tool_errors(df: DataFrame, template: str, tool: str, argument: str, apology: str) -> DataFrame:
    """The tool answers with an error, and the answer says so instead of making a result up; ``df`` has (id, value, error)."""
    call = tool_call(tool, argument, F.col("value"))
    failed = F.to_json(F.struct(F.col("error").alias("error")))
    return df.select("id", F.array(message("user", F.format_string(template, "value")), message("assistant", call), message("tool", failed), message("assistant", F.format_string(apology, "error"))).alias("messages"))


def tool_dialogues(df: DataFrame, template: str, again: str, tool: str, argument: str) -> DataFrame:
    """Two calls in one conversation; the second question follows the first answer. ``df`` has (id, values, results), two each."""
    at = lambda c, i: F.get(c, F.lit(i))
    turn = lambda t, i: [
        message("user", F.format_string(t, at("values", i))), message("assistant", tool_call(tool, argument, at("values", i))), message("tool", at("results", i)), message("assistant", at("results", i)),
    ]
    return df.filter((F.size("values") >= 2) & (F.size("results") >= 2)).select("id", F.array(*turn(template, 0), *turn(again, 1)).alias("messages"))


def tool_restraint(df: DataFrame) -> DataFrame:
    """Questions that need no tool are answered without one; ``df`` has (id, question, answer)."""
    return df.filter((F.trim("question") != "") & (F.trim("answer") != "")).select("id", F.array(message("user", F.col("question")), message("assistant", F.col("answer"))).alias("messages"))


def ring(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """(key, other, rank): for each key the next ``k`` others in a seeded hash order, which is a ring."""
    placed = places(df.select(F.col(key).alias("id"), F.xxhash64(key, F.lit(seed)).alias("_h")), ["_h", "id"]).select("id", "place")
    n = placed.count()
    steps = F.explode(F.sequence(F.lit(1), F.lit(min(k, n - 1)))) if n > 1 else F.explode(F.array().cast("array<int>"))
    asked = placed.select(F.col("id").alias(key), "place", steps.alias("rank")).withColumn("place", (F.col("place") + F.col("rank")) % max(n, 1))
    return asked.join(placed.withColumnRenamed("id", "other"), "place").select(key, "other", "rank")


def with_distractors(facts: DataFrame, k: int, seed: int = 3) -> DataFrame:
    """Each fact with up to k others, drawn from all facts by a ring of hashes; ``facts`` has unique (id, fact).

    Each fact is a distractor of k others, so no key is hot. The ring is cut into ranges of hashes, and each range
    gets the first facts of the next one, so a text moves once and finds its neighbours beside it.
    """
    from pyspark.sql import Window

    n = facts.count()
    bits = max(0, (n // RANGE_ROWS).bit_length() - 1)
    hashed = facts.withColumn("_h", F.xxhash64("id", F.lit(seed)))
    dealt = hashed.withColumn("_range", F.shiftright("_h", 64 - bits)) if bits else hashed.withColumn("_range", F.lit(0).cast("long"))
    sizes = dealt.groupBy("_range").count().agg(F.count("*"), F.min("count")).first()
    if not bits or sizes[0] < 1 << bits or sizes[1] < k:
        return _with_distractors_of_few(facts, k, seed)
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_h", "id"))
    heads = F.broadcast(dealt.select("id", "_h", "_range").withColumn("_place", place).filter(F.col("_place") <= k).select("id"))
    half = 1 << (bits - 1)
    before = F.when(F.col("_range") == -half, F.lit(half - 1)).otherwise(F.col("_range") - 1)
    both = dealt.withColumn("_guest", F.lit(0)).unionByName(dealt.join(heads, "id", "left_semi").withColumn("_range", before).withColumn("_guest", F.lit(1)))
    beside = Window.partitionBy("_range").orderBy("_guest", "_h", "id")
    others = F.array(*[F.lead("fact", i).over(beside) for i in range(1, k + 1)])
    return both.withColumn("distractors", F.sort_array(F.filter(others, lambda x: x.isNotNull()))).filter("_guest = 0").select("id", "fact", "distractors")


#: Facts of a range of the ring, on average, from half as many to as many again.
RANGE_ROWS = 2048


def _with_distractors_of_few(facts: DataFrame, k: int, seed: int) -> DataFrame:
    """The same by places, for tables that make no ranges."""
    near = ring(facts, "id", k, seed).join(facts.select(F.col("id").alias("other"), F.col("fact").alias("other_fact")), "other")
    lines = near.groupBy("id").agg(F.sort_array(F.collect_list("other_fact")).alias("others"))
    return facts.join(lines, "id", "left").select("id", "fact", F.coalesce("others", F.array().cast("array<string>")).alias("distractors"))


def preference_pairs(df: DataFrame, rejected: list[list[str]], probes: DataFrame) -> DataFrame:
    """(prompt, chosen, rejected), each triple once: a question's answer by rotation against one of each pool by rotation.

    ``df`` has (id, questions, answers); ``rejected`` are pools of wrong answers, ``probes`` (prompt) questions of
    the held-out evaluation, which stay out whatever their case and outer blanks. A question gives as many pairs as
    there are pools, so the output grows as the questions do. Blank questions and answers, and answers that equal
    what is rejected, give none.
    """
    q = df.select("answers", F.posexplode("questions").alias("i", "prompt")).filter((F.size("answers") > 0) & (F.trim("prompt") != ""))
    wrong = F.array(*[F.element_at(F.array(*map(F.lit, pool)), F.col("i") % len(pool) + 1) for pool in rejected])
    x = q.select("prompt", F.element_at("answers", F.col("i") % F.size("answers") + 1).alias("chosen"), F.explode(wrong).alias("rejected"))
    x = x.filter((F.trim("chosen") != "") & (F.col("chosen") != F.col("rejected")))
    held = probes.select(F.lower(F.trim("prompt")).alias("_q")).filter("_q IS NOT NULL").distinct()
    return x.join(held, F.lower(F.trim("prompt")) == F.col("_q"), "left_anti").distinct()


def gate(prompt: Column, completion: Column, leaked: Column) -> Column:
    """Why a general record goes, in the order in which the gates stand; null if it stays."""
    return F.when(boilerplate(completion), "boilerplate").when(foreign_identity(completion), "foreign").when(leaked, "leak")


def oversampled(df: DataFrame, times: int) -> DataFrame:
    """O9"""
    return df.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_k")


def search_corpus(positive: DataFrame, negative: DataFrame, only_positive: bool = False, only_negative: bool = False) -> DataFrame:
    """The union of both classes, or one of them."""
    if only_positive and only_negative:
        raise ValueError("choose one class or both")
    parts = ([] if only_negative else [positive.withColumn("positive", F.lit(True))]) + ([] if only_positive else [negative.withColumn("positive", F.lit(False))])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def sft_mix(general: DataFrame, probes: DataFrame, own: DataFrame, times: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(mix, reasons): own records oversampled, general ones that pass the gates, in a seeded order.

    All have (id, prompt, completion); ``probes`` has (prompt): questions of the held-out evaluation.
    """
    key = F.lower(F.trim("prompt"))
    asked = probes.select(key.alias("_q")).distinct().withColumn("_leaked", F.lit(True))
    judged = general.join(asked, key == F.col("_q"), "left").withColumn("reason", gate(F.col("prompt"), F.col("completion"), F.coalesce("_leaked", F.lit(False)))).drop("_q", "_leaked")
    reasons = judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    clean = own.join(asked, key == F.col("_q"), "left_anti")
    both = judged.filter("reason IS NULL").drop("reason").unionByName(oversampled(clean, times))
    return both.repartitionByRange(F.xxhash64("id", F.lit(seed))).sortWithinPartitions(F.xxhash64("id", F.lit(seed))), reasons
