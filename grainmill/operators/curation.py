"""Memories and curated datasets: entries, decisions and what is left for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators.dedup import first_rows
from grainmill.operators.ranks import places

STATUSES = ("pending", "approved", "rejected")


def added(entries: DataFrame, new: DataFrame, source: str, stage: str = "", status: str = "pending") -> DataFrame:
    """``entries`` (id, text, source, stage, status) with the texts of ``new`` (pos, text) that aren't there.

    Texts are stripped; blank ones, repeats and those among the entries go. New ids follow the largest one.
    """
    x = new.select("pos", F.regexp_replace("text", "^\\s+|\\s+$", "").alias("text")).filter("text <> ''")
    once = first_rows(x, F.sha2("text", 256), ["pos"])
    fresh = once.join(entries.select(F.sha2("text", 256).alias("_k")).distinct(), F.sha2("text", 256) == F.col("_k"), "left_anti")
    top = entries.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    placed = fresh.join(places(fresh.select("pos"), ["pos"]), "pos").crossJoin(F.broadcast(top))  # one row
    rows = placed.select((F.col("top") + 1 + F.col("place")).alias("id"), "text", F.lit(source).alias("source"), F.lit(stage).alias("stage"), F.lit(status).alias("status"))
    return entries.select("id", "text", "source", "stage", "status").unionByName(rows)


def decided(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entries after decisions (pos, id, status), the last for each id counts; ids that aren't there change nothing."""
    last = decisions.filter(F.col("status").isin(*STATUSES)).groupBy("id").agg(F.max_by("status", "pos").alias("_new"))
    return entries.join(last, "id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def all_pending(entries: DataFrame, status: str) -> DataFrame:
    """Every pending entry approved or rejected."""
    return entries.withColumn("status", F.when(F.col("status") == "pending", F.lit(status)).otherwise(F.col("status")))


def without(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries or memories but those whose id is among ``ids``; an empty list leaves all, ``entries.limit(0)`` clears."""
    return entries.join(ids.select("id").distinct(), "id", "left_anti")


def chosen(entries: DataFrame, status: str | None = None, source: str | None = None, stage: str | None = None) -> DataFrame:
    """Entries of a status, a source, a training stage."""
    out = entries
    for name, value in (("status", status), ("source", source), ("stage", stage)):
        if value:
            out = out.filter(F.col(name) == value)
    return out


def training_text(entries: DataFrame, stage: str | None = None) -> DataFrame:
    """(id, text) of approved entries in order; a writer of texts puts a blank line between them."""
    return chosen(entries, "approved", None, stage).select("id", "text").orderBy("id")


def valid_row(mode: str, row: dict[str, Column]) -> Column:
    """whether a row has the shape that a training mode needs; ``row`` has the mode's columns, those absent are null."""
    filled = lambda n: F.coalesce(F.trim(row[n]) != "", F.lit(False)) if n in row else F.lit(False)
    if mode in ("dpo", "simpo", "orpo", "reward_model"):
        return filled("prompt") & filled("chosen") & filled("rejected")
    if mode in ("grpo", "remax", "rest", "rlhf", "self_play"):
        return filled("prompt")
    if mode == "kto":
        return filled("prompt") & filled("response") & (row["desirable"].isNotNull() if "desirable" in row else F.lit(False))
    if mode == "lora":
        return filled("completion")
    if mode in ("vision", "audio"):
        return filled("image" if mode == "vision" else "audio") & filled("text")
    if mode == "sft":
        return filled("text") | (filled("prompt") & filled("completion"))
    raise ValueError(f"unknown training mode {mode!r}")


def checked(rows: DataFrame, ok: Column, mode: str) -> DataFrame:
    """the rows, or a failed job at the first row of a wrong shape."""
    return rows.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(f"a row isn't fit for mode {mode}")).cast("boolean")))
