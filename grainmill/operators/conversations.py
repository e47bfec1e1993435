"""Conversations: turns of a dialogue put together, chosen and rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def turns(df: DataFrame) -> DataFrame:
    """(conv_id, t): each conversation's turns in order; a conversation is bounded by its own length."""
    return df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))


def joined(df: DataFrame, by: str = "\n\n") -> DataFrame:
    return turns(df).select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), by).alias("text"))


def of_role(t: Column, role: str) -> Column:
    return F.filter(t, lambda x: (x["role"] == role) & (F.trim(x["text"]) != ""))


def first_text(t: Column, role: str) -> Column:
    return F.get(of_role(t, role), F.lit(0))["text"]


def last_text(t: Column, role: str) -> Column:
    return F.try_element_at(of_role(t, role), F.lit(-1))["text"]


def before_answer(t: Column) -> Column:
    """The turns before the first assistant's."""
    at = F.array_position(F.transform(t, lambda x: x["role"]), "assistant")
    return F.when(at > 0, F.slice(t, F.lit(1), (at - 1).cast("int"))).otherwise(t)


def talks(df: DataFrame) -> DataFrame:
    """(conv_id, questions, answers): what users and assistants said, in order, of conversations (conv_id, turn, role, text) that have both."""
    said = df.select("conv_id", "role", F.struct("turn", F.trim("text").alias("text")).alias("s")).filter("role IN ('user', 'assistant') AND s.text <> ''")
    own = lambda role: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.col("s")))), lambda s: s["text"])
    return said.groupBy("conv_id").agg(own("user").alias("questions"), own("assistant").alias("answers")).filter((F.size("questions") > 0) & (F.size("answers") > 0))
