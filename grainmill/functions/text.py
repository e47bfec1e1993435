"""Column expressions over texts: cleaning, estimates and quality predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(c: Column) -> Column:
    """Drops NUL and control characters except tab, LF and CR; CRLF and CR become LF;
    trailing blanks of each line go; runs of three or more LF shrink to two; ends are stripped."""
    x = F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")
    x = F.regexp_replace(x, "\\r\\n?", "\n")
    x = F.regexp_replace(x, "[ \\t]+\\n", "\n")
    x = F.regexp_replace(x, "\\n{3,}", "\n\n")
    return F.regexp_replace(x, "^[ \\t\\n]+|[ \\t\\n]+$", "")


def token_estimate(c: Column) -> Column:
    """0 for an empty text, else a quarter of its length, at least 1."""
    n = F.length(c)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def quality_filter(c: Column, min_length: int = 500) -> Column:
    """long enough, at least half letters, and at least three sentence ends."""
    n = F.length(c)
    letters = F.length(F.regexp_replace(c, "\\P{L}", ""))
    ends = F.length(F.regexp_replace(c, "[^.?!]", ""))
    return (n >= min_length) & (letters >= 0.5 * n) & (ends >= 3)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def chain(c: Column, steps: list[tuple]) -> Column:
    """Regular-expression replacements, one after the other: (pattern, replacement), or (pattern, replacement, times)."""
    for pattern, to, *times in steps:
        for _ in range(times[0] if times else 1):
            c = F.regexp_replace(c, pattern, to)
    return c


def lines_kept(c: Column, keep) -> Column:
    """Strips each line, drops those that ``keep`` refuses, and joins the rest; at most one blank line in a row."""
    lines = F.filter(F.transform(F.split(c, "\n"), trimmed), lambda x: (x == "") | keep(x))
    return trimmed(F.regexp_replace(F.array_join(lines, "\n"), "\\n{3,}", "\n\n"))


def one_line(c: Column) -> Column:
    """Every run of white space becomes a space; ends are stripped."""
    return F.regexp_replace(F.regexp_replace(c, "(?U)\\s+", " "), "^ | $", "")


# What T3 takes out, in this order.
WIKI_STEPS = [("\\[\\d+\\]", ""), ("(?i)\\[citation needed\\]", ""), ("\\[.*?\\]", ""), ("https?://\\S+", ""), ("[ \\t]+", " ")]


def clean_wiki(c: Column) -> Column:
    """Reference marks, brackets and links go; short lines that end in a colon go."""
    return lines_kept(chain(c, WIKI_STEPS), lambda x: ~((F.length(x) < 20) & F.endswith(x, F.lit(":"))))


# Blocks whose content is not text.
WIKI_BLOCKS = ["gallery", "source", "syntaxhighlight", "pre", "math", "score", "timeline", "nowiki", "imagemap", "mapframe"]
WIKI_ENTITIES = [("&nbsp;", " "), ("&ndash;", "\u2013"), ("&mdash;", "\u2014"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#\\d+;", "")]


# A heading, which keeps its words: signs, words that end in no blank and in no sign before a sign, signs; or signs
# only. No part of it can end in two places, so a line that is no heading is left after one reading. Below it, the
# same for engines that don't backtrack.
HEADING = "(?m)^(?:=++\\s*+(?:=++|(.*?(?=.)(?:[^\\s=]|=(?!=)))\\s*+=++)|={2,})\\s*$"
PLAIN_HEADING = "(?m)^=+\\s*(.*?)\\s*=+\\s*$"

# What T4 takes out of a fan wiki's text, in this order; nested templates take fifteen turns, tables five.
FAN_STEPS = [
    ("(?s)<!--.*?-->", ""), ("(?s)<ref[^>]*>.*?</ref>", ""), ("<ref[^>]*/>", ""),
    *[(f"(?si)<{t}[^>]*>.*?</{t}>", "") for t in WIKI_BLOCKS], ("<[^>]+/?>", ""),
    ("(?s)\\{\\|[^{]*?\\|\\}", "", 5), ("\\{\\|.*", ""), ("\\{\\{[^{}]*\\}\\}", "", 15),
    ("(?i)\\[\\[(File|Image|Archivo|Fichier|Datei):[^\\]]*\\]\\]", ""), ("(?i)\\[\\[Category:[^\\]]*\\]\\]", ""),
    ("\\[\\[[^\\]|]*\\|([^\\]]*)\\]\\]", "$1"), ("\\[\\[([^\\]]*)\\]\\]", "$1"),
    ("\\[https?://\\S+\\s+([^\\]]*)\\]", "$1"), ("\\[https?://[^\\]]*\\]", ""), ("'{2,5}", ""),
    (HEADING, "$1"), ("(?m)^[*#:;]+\\s*", ""),
    *WIKI_ENTITIES, ("__[A-Z]+__", ""), ("\\n{3,}", "\n\n"), (" {2,}", " "),
]

# What T6 takes out of a dump's text, in this order; its rules differ from T4's.
DUMP_STEPS = [
    ("\\{\\{[^{}]*\\}\\}", "", 8),
    ("(?m)\\{\\{[^}]{0,500}$", ""), ("(?s)\\{\\|.*?\\|\\}", ""), ("(?si)<ref[^>]*>.*?</ref>", ""), ("(?i)<ref[^>]*/>", ""),
    ("(?s)<!--.*?-->", ""), ("<[^>]+>", ""), ("(?i)\\[\\[Category:[^\\]]*\\]\\]", ""), ("(?i)\\[\\[(?:File|Image):[^\\]]*\\]\\]", ""),
    ("\\[\\[[^|\\]]*\\|([^\\]]+)\\]\\]", "$1"), ("\\[\\[([^\\]]+)\\]\\]", "$1"), ("\\[https?://\\S+\\s+([^\\]]+)\\]", "$1"),
    ("\\[https?://\\S+\\]", ""), ("https?://\\S+", ""), ("'{2,5}", ""), (HEADING, "$1"),
    ("__[A-Z]+__", ""), ("\\[\\d+\\]", ""), ("(?i)\\[citation needed\\]", ""), ("\\{[^}]*\\}", ""), ("[ \\t]+", " "), ("\\n{3,}", "\n\n"),
]


def fan_wikitext(c: Column) -> Column:
    """T4: wikitext of fan wikis to plain text."""
    return trimmed(chain(c, FAN_STEPS))


def dump_wikitext(c: Column) -> Column:
    """Wikitext of dumps to plain text; short lines that end no sentence and lines of list marks go."""
    return lines_kept(chain(c, DUMP_STEPS), lambda l: ((F.length(l) >= 30) | l.rlike("[.!?:]$")) & ~l.rlike("^[*#;:]+$"))


# Lines around the text of a book, in the order in which they are looked for.
BOOK_STARTS = ["*** START OF THE PROJECT GUTENBERG", "*** START OF THIS PROJECT GUTENBERG", "*END*THE SMALL PRINT"]
BOOK_ENDS = ["*** END OF THE PROJECT GUTENBERG", "*** END OF THIS PROJECT GUTENBERG", "End of the Project Gutenberg", "End of Project Gutenberg"]


def first_listed(c: Column, markers: list[str]) -> Column:
    """The place (from 1) of the first marker of the list that occurs, or 0."""
    return F.coalesce(*[F.nullif(F.instr(c, m), F.lit(0)) for m in markers], F.lit(0))


def book_text(c: Column) -> Column:
    """T5: cuts what stands before the text's first line and after its last."""
    at = first_listed(c, BOOK_STARTS)
    line = F.when(at > 0, F.call_function("locate", F.lit("\n"), c, at)).otherwise(F.lit(0))
    end = first_listed(c, BOOK_ENDS)
    stop = F.when(end > 0, end - 1).otherwise(F.length(c))
    body = F.substring(c, line + 1, F.greatest(F.lit(0), stop - line))
    return trimmed(chain(body, [("[ \\t]+", " "), ("\\n{3,}", "\n\n")]))


# Entities that the pages use; the ampersand comes last.
ENTITIES = [("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\u00a0"), ("&#39;", "'"), ("&amp;", "&")]
HTML_BLOCKS = ["script", "style", "nav", "header", "footer", "aside", "menu"]


def unescaped(c: Column) -> Column:
    """X9 for the entities listed; ``unescape_all`` takes every entity."""
    for name, to in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(to))
    return c


def html_text(c: Column) -> Column:
    """Readable text of a page; lines under 30 characters go."""
    x = chain(c, [(f"(?si)<{t}[^>]*>.*?</{t}>", "") for t in HTML_BLOCKS])
    x = chain(unescaped(x), [("<[^>]+>", " "), ("[ \\t]+", " "), ("\\n{3,}", "\n\n")])
    return lines_kept(x, lambda l: F.length(l) >= 30)


def post_text(c: Column) -> Column:
    """Entities first, then code blocks and tags go."""
    steps = [("(?s)<pre><code>.*?</code></pre>", ""), ("(?s)<code>.*?</code>", ""), ("<[^>]+>", " "), ("[ \\t]+", " "), ("\\n{3,}", "\n\n")]
    return trimmed(chain(unescaped(c), steps))


def safe_name(c: Column) -> Column:
    """T9"""
    x = F.substring(F.regexp_replace(c, "(?U)[^\\w\\s-]", ""), 1, 80)
    return F.regexp_replace(trimmed(x), "\\s+", "_")


def url_name(c: Column) -> Column:
    """T10"""
    x = F.substring(F.regexp_replace(c, "(?U)[^\\w]", "_"), 1, 120)
    return F.regexp_replace(F.regexp_replace(x, "_+", "_"), "^_|_$", "")


def dedup_key(c: Column) -> Column:
    """Lower case, one blank, dots only between word characters, no cosmetic marks."""
    x = F.regexp_replace(F.lower(trimmed(c)), "\\s+", " ")
    x = F.regexp_replace(x, "(?U)(?<!\\w)\\.|\\.(?!\\w)", "")
    return F.regexp_replace(x, "[,;:!?\"'`~@#$%^&*(){}|\\\\<>+=_-]", "")


def generated_example(c: Column) -> Column:
    """Reasoning tags and the wrappers that a teacher puts before an example go."""
    x = trimmed(F.regexp_replace(c, "</?think>", ""))
    x = trimmed(F.regexp_replace(x, "(?i)^The answer is\\.{0,3}\\s*", ""))
    return trimmed(F.regexp_replace(x, "(?i)^(?:Here is|Here's) (?:a |an |the )?(?:training )?example[:.\\s]*", ""))


def found_stop(c: Column, stops: list[str]) -> Column:
    """The place (from 0) of the earliest stop string, or -1."""
    return F.coalesce(F.least(*[F.nullif(F.instr(c, s), F.lit(0)) for s in stops], F.lit(None).cast("int")) - 1, F.lit(-1))
