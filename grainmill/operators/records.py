"""Instruction records: pairs from datasets of several shapes, aliases of fields, formats, prompts and tool specs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.predicates import english, pair_lengths
from grainmill.functions.text import one_line, trimmed
from grainmill.operators.dedup import first_rows, pair_key
from grainmill.shipping import ship

# System prompts that say nothing, names of fields, and the wording of tool specs.
GENERIC = ["you are an ai assistant.", "you are a helpful assistant.", ""]
PROMPTS, COMPLETIONS = ["prompt", "question", "instruction"], ["completion", "response", "answer", "output"]
TOOL_SYNTAX = 'Call a tool by writing <|tool_call|>{"name": "...", "arguments": {...}}<|/tool_call|> and wait for the result.'


def first_filled(names: list[str], row: Column) -> Column:
    """An empty field counts as missing (maps of strings)."""
    return F.coalesce(*[F.nullif(F.try_element_at(row, F.lit(n)), F.lit("")) for n in names], F.lit(""))


def first_present(names: list[str], row: Column) -> Column:
    """A field that is there counts, empty or not (maps of strings)."""
    return F.coalesce(*[F.try_element_at(row, F.lit(n)) for n in names], F.lit(""))


def _values(turns: Column, role: str, clean) -> Column:
    return F.filter(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: clean(t["text"])), lambda x: x != "")


def with_system(system: Column, prompt: Column) -> Column:
    s = F.coalesce(system, F.lit(""))
    return F.when(F.lower(s).isin(GENERIC), prompt).otherwise(F.concat(s, F.lit("\n\n"), prompt))


def last_of_roles(df: DataFrame, turns: str = "turns") -> DataFrame:
    """The last filled turn of each role, in front the system's, if it says something.

    ``turns`` is an array of (role, text) with the roles system, human and gpt.
    """
    t = F.col(turns)
    last = lambda r: F.try_element_at(_values(t, r, one_line), F.lit(-1))
    x = df.filter(F.size(t) >= 2).withColumns({"_s": last("system"), "_p": last("human"), "completion": last("gpt")})
    return x.filter(pair_lengths(F.col("_p"), F.col("completion"))).withColumn("prompt", with_system(F.col("_s"), F.col("_p"))).drop("_s", "_p")


def first_of_roles(df: DataFrame, turns: str = "turns") -> DataFrame:
    """The first human and the first gpt turn, as they are but for their ends."""
    t = F.col(turns)
    first = lambda r: F.get(_values(t, r, trimmed), F.lit(0))
    return df.withColumns({"prompt": first("human"), "completion": first("gpt")}).filter(pair_lengths(F.col("prompt"), F.col("completion")))


def until_answer(df: DataFrame, turns: str = "turns") -> DataFrame:
    """First filled turns up to the first filled answer; what comes after it doesn't count."""
    t = F.transform(F.col(turns), lambda x: F.struct(x["role"].alias("role"), one_line(x["text"]).alias("text")))
    t = F.filter(t, lambda x: x["text"] != "")
    stop = F.array_position(F.transform(t, lambda x: x["role"] == "assistant"), True)
    head = F.slice(t, F.lit(1), F.when(stop > 0, stop).otherwise(F.size(t)).cast("int"))
    first = lambda r: F.get(F.filter(head, lambda x: x["role"] == r), F.lit(0))["text"]
    x = df.withColumns({"_s": first("system"), "_p": first("user"), "completion": first("assistant")})
    return x.filter(pair_lengths(F.col("_p"), F.col("completion"))).withColumn("prompt", with_system(F.col("_s"), F.col("_p"))).drop("_s", "_p")


def instructions(df: DataFrame) -> DataFrame:
    """(instruction, context, response) to pairs, with the context below the instruction."""
    i, c, r = (one_line(F.coalesce(x, F.lit(""))) for x in ("instruction", "context", "response"))
    prompt = F.when(c == "", i).otherwise(F.concat(i, F.lit("\n\nContext: "), c))
    return df.withColumns({"_i": i, "prompt": prompt, "completion": r}).filter(pair_lengths(F.col("_i"), F.col("completion"))).drop("_i")


def replies(messages: DataFrame) -> DataFrame:
    """Root questions with their best answer: smallest rank, none counting as 999, then message order.

    ``messages`` has (message_id, parent_id, role, lang, rank, text, pos). The answer's language is checked
    after it was chosen.
    """
    roots = messages.filter((F.col("role") == "prompter") & F.col("parent_id").isNull() & english(F.col("lang")))
    best = messages.filter("role = 'assistant'").groupBy(F.col("parent_id").alias("message_id")).agg(F.min(F.struct(F.coalesce("rank", F.lit(999)), "pos", one_line(F.col("text")).alias("text"), F.coalesce("lang", F.lit("en")).alias("lang"))).alias("b"))
    x = roots.select("message_id", one_line(F.col("text")).alias("prompt")).join(best, "message_id").filter("b.lang = 'en'")
    return x.select("message_id", "prompt", F.col("b.text").alias("completion")).filter(pair_lengths(F.col("prompt"), F.col("completion"), 10))


def combined(parts: list[DataFrame]) -> DataFrame:
    """Pairs of several datasets in their order, each once."""
    every = None
    for i, p in enumerate(parts):
        own = p.select("prompt", "completion").withColumn("part", F.lit(i)).withColumn("at", F.monotonically_increasing_id())
        every = own if every is None else every.unionByName(own)
    return first_rows(every, pair_key(F.col("prompt"), F.col("completion")), ["part", "at"]).select("prompt", "completion")


# What opens a question and its answer, in texts of questions and in dialogues.
QA_MARKS = ((re.compile("Q:"), re.compile("A:")), (re.compile("(?i)(?:User|Human):"), re.compile("(?i)(?:AI|Assistant):")))
BLANKS = re.compile(r"\s*")


def turns(text: str, ask: re.Pattern, answer: re.Pattern) -> list[tuple[str, str]]:
    """Questions with their answers; a stripped text is read once from left to right.

    A question has a character before its answer's mark, and an answer goes on to the next question's, at least
    one character. A mark right behind the blanks of a question opens its answer only if no later one does.
    """
    out, at = [], 0
    while q := ask.search(text, at):
        start = BLANKS.match(text, q.end()).end()
        a = answer.search(text, start + 1)
        if not a or a.end() == len(text):
            a = answer.match(text, start) if start > q.end() else None
            if not a or a.end() == len(text):
                break
        begin = BLANKS.match(text, a.end()).end()
        following = ask.search(text, begin + 1)
        at = following.start() if following else len(text)
        out.append((text[q.end() : a.start()].strip(), text[begin:at].strip()))
    return out


def of_line(line: str) -> str | None:
    """The sequence of a JSON line; None for broken lines, lines that aren't objects, and those without a pair."""
    try:
        row = json.loads(line)
    except (ValueError, RecursionError):
        return None
    if not isinstance(row, dict):
        return None
    named = lambda *names: next((row[n] for n in names if n in row), "")
    p, c, think = named("prompt", "question"), named("completion", "answer", "response"), named("thinking", "reasoning")
    return f"User: {p}\nAssistant: " + (f"<think>{think}</think>\n" if think else "") + str(c) if p and c else None


def sequences(text: str | None) -> list[str]:
    """Training sequences of a text, by the first format that gives any; a null text has none."""
    text = (text or "").strip()
    pair = lambda p, c: f"User: {p}\nAssistant: {c}"
    out: list[str] = []
    if text.startswith("{") and (out := [*filter(None, map(of_line, filter(None, map(str.strip, text.split("\n")))))]):
        return out
    for marks in QA_MARKS:
        if out := [pair(q, a) for q, a in turns(text, *marks)]:
            return out
    out = [p for p in map(str.strip, text.split("\n\n")) if len(p) > 50]
    return out or [x for x in map(str.strip, text.split("\n")) if x]


def parsed(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, sequence): T18 for each document."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, s) for k, t in zip(b["k"], b["t"], strict=True) for i, s in enumerate(sequences(t))]
            yield pd.DataFrame(rows, columns=[key, "pos", "sequence"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} long, pos int, sequence string")


def tools_system(specs: Column) -> Column:
    """The system text for an array of (name, description, parameters: map of name to type); none gives nothing."""
    line = lambda s: F.to_json(F.struct(s["name"].alias("name"), F.coalesce(s["description"], F.lit("")).alias("description"), s["parameters"].alias("parameters")))
    return F.when(F.size(specs) > 0, F.concat(F.lit("Available tools:\n"), F.array_join(F.transform(specs, line), "\n"), F.lit("\n" + TOOL_SYNTAX))).otherwise(F.lit(""))


def call_envelopes(calls: Column) -> Column:
    """An array of (name, arguments: JSON) as envelopes; a call without a name goes, ids keep its place."""
    shown = F.transform(calls, lambda c, i: F.struct(F.concat(F.lit("call_"), i.cast("string")).alias("id"), F.lit("function").alias("type"), F.struct(c["name"].alias("name"), F.coalesce(c["arguments"], F.lit("{}")).alias("arguments")).alias("function")))
    return F.filter(shown, lambda e: F.coalesce(e["function"]["name"], F.lit("")) != "")


def example_prompt(index: Column, total: int, stage: Column, difficulty: Column, hint: Column) -> Column:
    """The request for one training example."""
    return F.concat(
        F.format_string(f"Training example #%d of {total}.\nStage: %s | Difficulty: %s\n\n", index, F.upper(stage), F.upper(difficulty)), hint,
        F.lit("\n\nWrite ONLY the example, no labels or meta-text. Make it different from previous examples."),
    )


def shots_prefix(shots: Column, n: int) -> Column:
    """The first n of an array of (q, a) before a question."""
    return F.when(F.lit(n) > 0, F.concat(F.array_join(F.transform(F.slice(shots, 1, max(n, 1)), lambda s: F.concat(F.lit("Question: "), s["q"], F.lit("\nAnswer: "), s["a"])), "\n\n"), F.lit("\n\n"))).otherwise(F.lit(""))
