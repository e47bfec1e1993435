"""Scalar functions: numbers in texts, scores, digests, formats."""

from __future__ import annotations

import ast
import html
import math
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


# How numbers stand in answers: marked as final, by themselves, and as fractions.
MARKED_NUMBER, PLAIN_NUMBER, FRACTION = r"####\s*(-?[\d,]*\.?\d+)", r"(-?[\d,]*\.?\d+)", r"(-?\d+(?:\.\d+)?(?:\s*/\s*\d+)?)"


def final_number(c: Column) -> Column:
    """The last number after ####, else the last number; commas go; null without one."""
    marked, any_ = (F.try_element_at(F.regexp_extract_all(c, F.lit(p), F.lit(1)), F.lit(-1)) for p in (MARKED_NUMBER, PLAIN_NUMBER))
    return F.regexp_replace(F.coalesce(marked, any_), ",", "").try_cast("double")


def last_fraction(c: Column) -> Column:
    """The last number, which may be a fraction a/b."""
    x = F.try_element_at(F.regexp_extract_all(c, F.lit(FRACTION), F.lit(1)), F.lit(-1))
    parts = F.split(x, r"\s*/\s*")
    top, bottom = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(bottom.isNull(), top).otherwise(F.try_divide(top, bottom))


# Ways in which judges state a score, in the order in which they are tried.
SCORE_PATTERNS = [
    r"(?i)SCORE\s*:\s*(\d{1,2})",
    r"\b(\d{1,2})\s*/\s*10\b",
    r"(?i)\b(?:score|rating)\s*(?:of\s+|:\s*|\s+)(\d{1,2})\b",
    r"(?i)(?:give|rate)\s+(?:this|it)\s+(?:a\s+)?(\d{1,2})\b",
]
BARE_SCORE = r"(?m)^\s*(10|[1-9])\s*$"


def judge_score(c: Column) -> Column:
    """The first pattern that matches decides, clamped to 1..10; a bare number must be in range; else 5."""
    found = [F.greatest(F.lit(1), F.least(F.lit(10), F.nullif(F.regexp_extract(c, p, 1), F.lit("")).try_cast("int"))) for p in SCORE_PATTERNS]
    # greatest and least skip nulls, so a pattern without a match must give null again
    tried = [F.when(F.regexp_extract(c, p, 1) != "", f) for p, f in zip(SCORE_PATTERNS, found, strict=True)]
    return F.coalesce(*tried, F.nullif(F.regexp_extract(c, BARE_SCORE, 1), F.lit("")).try_cast("int"), F.lit(5))


def loss_score(c: Column) -> Column:
    """round(9 - 4 * loss), half to even, within 1..8; 1 if the loss isn't finite."""
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(finite, F.greatest(F.lit(1), F.least(F.lit(8), F.bround(9 - 4 * F.greatest(F.lit(-1e6), F.least(c, F.lit(1e6))), 0).cast("int")))).otherwise(F.lit(1))


def tag_content(c: Column, tag: str) -> Column:
    """X10"""
    return F.nullif(F.trim(F.regexp_extract(c, f"(?is)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))


def eta(seconds: Column) -> Column:
    """X15"""
    s = seconds.cast("long")
    d, h, m = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    return F.when(d > 0, F.format_string("%dd %dh", d, h)).when(h > 0, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dm", m))


def magpie(c: Column, end_of_user: str, end_of_answer: str) -> Column:
    """(prompt, completion, error) of a raw completion."""
    at = F.instr(c, end_of_user)
    prompt = F.trim(F.substring(c, F.lit(1), at - 1))
    rest = F.substring(c, at + len(end_of_user), F.length(c))
    stop = F.instr(rest, end_of_answer)
    answer = F.trim(F.when(stop > 0, F.substring(rest, F.lit(1), stop - 1)).otherwise(rest))
    error = F.when(at == 0, F.lit("no marker")).when(prompt == "", F.lit("empty prompt")).when(answer == "", F.lit("empty answer"))
    return F.struct(F.when(error.isNull(), prompt).alias("prompt"), F.when(error.isNull(), answer).alias("completion"), error.alias("error"))


def next_step(average: Column, stage: Column, stages: int, attempt: Column, most: int) -> Column:
    """A score of 7 moves on; below it the stage is tried again, harder, until attempts run out."""
    onward = F.when(stage + 1 >= stages, F.lit("complete")).otherwise(F.lit("advance"))
    return F.when((average < 7) & (attempt < most), F.lit("retry")).otherwise(onward)


def harder(level: Column, levels: list[str]) -> Column:
    """The next difficulty; an unknown one counts as the first, the last stays."""
    at = F.greatest(F.lit(1), F.array_position(F.array(*map(F.lit, levels)), level))
    return F.element_at(F.array(*map(F.lit, levels)), F.least(F.lit(len(levels)), at + 1).cast("int"))


_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod}


def calculate(text: str | None) -> str | None:
    """Arithmetic with + - * / // % ** and brackets; None for what is refused."""
    if not text or len(text) > 256:
        return None

    def of(n: ast.AST) -> float:
        if isinstance(n, ast.Constant) and type(n.value) in (int, float):
            return n.value
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.UAdd, ast.USub)):
            return of(n.operand) if isinstance(n.op, ast.UAdd) else -of(n.operand)
        if isinstance(n, ast.BinOp):
            a, b = of(n.left), of(n.right)
            if isinstance(n.op, ast.Pow):
                if abs(b) > 1000 or abs(a) > 1e12:
                    raise ValueError
                return a**b
            return _OPS[type(n.op)](a, b)
        raise ValueError

    try:
        v = of(ast.parse(text.replace("×", "*").replace("÷", "/").strip(), mode="eval").body)
        if isinstance(v, complex) or (isinstance(v, float) and not math.isfinite(v)):
            return None
        return str(int(v)) if isinstance(v, float) and v.is_integer() and abs(v) < 1e15 else str(v)
    except (SyntaxError, ValueError, ZeroDivisionError, OverflowError, KeyError, RecursionError, MemoryError):
        return None  # a number of more digits than Python prints is a ValueError


@F.pandas_udf(StringType())
def calculated(s: pd.Series) -> pd.Series:
    return s.map(calculate)


@F.pandas_udf(StringType())
def unescape_all(s: pd.Series) -> pd.Series:
    """X9 for every entity of HTML."""
    return s.map(lambda x: None if x is None else html.unescape(x))


def format_reward(c: Column) -> Column:
    """Whether the response thinks in tags, then answers in tags."""
    return c.rlike(r"(?is)^\s*<think>.+?</think>\s*<answer>.+?</answer>\s*$").cast("double")


def math_reward(c: Column, truth: Column) -> Column:
    """Whether the answer's last number is the truth's."""
    return F.coalesce((F.abs(last_fraction(F.coalesce(tag_content(c, "answer"), c)) - last_fraction(truth)) < 1e-6).cast("double"), F.lit(0.0))


def reasoning_reward(c: Column, truth: Column) -> Column:
    return 0.8 * math_reward(c, truth) + 0.2 * format_reward(c)
