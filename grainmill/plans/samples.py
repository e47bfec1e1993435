"""Texts with known phrases put in, in Spark and in SQL alike, so that rare rules have something to find."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def injected(phrases: list[str], key: str = "doc_id", text: str = "text") -> tuple[Callable[[], Column], str]:
    """A whole text, a blank, and one of the phrases by key (none for one key in n + 1)."""
    n = len(phrases) + 1

    def column() -> Column:
        whole, out = F.col(text), None
        for i, p in enumerate(phrases):
            own = F.concat(whole, F.lit(" "), F.lit(p))
            out = F.when(F.col(key) % n == i, own) if out is None else out.when(F.col(key) % n == i, own)
        return out.otherwise(whole)

    cases = " ".join(f"WHEN {i} THEN {text} || ' ' || {quoted(p)}" for i, p in enumerate(phrases))
    return column, f"(CASE {key} % {n} {cases} ELSE {text} END)"


def whole(oracle: str, cut: str, text: str) -> str:
    """The oracle of a query of the texts as they are, from the one that reads them with phrases put in."""
    if cut not in oracle:
        raise ValueError(f"not in the oracle: {cut}")
    return oracle.replace(cut, text)


def chosen(values: list[str], key: str) -> tuple[Callable[[], Column], str]:
    """One of the values by key."""
    n = len(values)
    column = lambda: F.element_at(F.array(*map(F.lit, values)), (F.col(key) % n + 1).cast("int"))
    return column, f"list_extract([{', '.join(map(quoted, values))}], CAST({key} % {n} AS INTEGER) + 1)"


#: SQL of ``conversations.talks``.
TALKS_SQL = """(SELECT * FROM (SELECT conv_id, list(trim(text) ORDER BY turn, text) FILTER (role = 'user' AND trim(text) <> '') AS q, list(trim(text) ORDER BY turn, text) FILTER (role = 'assistant' AND trim(text) <> '') AS a
    FROM conversations GROUP BY conv_id) WHERE len(q) > 0 AND len(a) > 0)"""
