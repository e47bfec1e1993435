"""Row predicates over texts, titles, licences and records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of generated text; any strong one decides, of the weak ones four.
STRONG_MARKERS = [
    "as an ai language model",
    "as a large language model",
    "i'm an ai assistant",
    "i am an ai assistant",
    "as an artificial intelligence",
    "my training data",
    "my knowledge cutoff",
    "i was trained by openai",
    "i was trained by anthropic",
    "regenerate response",
    "i cannot provide real-time",
    "i don't have personal experiences",
    "i don't have the ability to browse",
]
WEAK_MARKERS = [
    "it's important to note that",
    "it is worth noting that",
    "in today's digital age",
    "in today's fast-paced world",
    "dive into the world of",
    "comprehensive guide to",
    "game-changer",
    "mastering the art of",
    "unlock the power of",
    "let's delve into",
    "without further ado",
    "in this article, we will explore",
    "in this comprehensive",
    "revolutionize your",
    "here are some key",
    "here are some tips",
    "overall, it is clear that",
    "in conclusion, it is evident",
    "there are several key factors",
    "it is essential to understand",
]

# Title prefixes of pages that are not articles.
NAMESPACES = [
    "Talk", "User", "User talk", "Wikipedia", "Wikipedia talk", "File", "File talk", "MediaWiki", "MediaWiki talk",
    "Template", "Template talk", "Help", "Help talk", "Category", "Category talk", "Portal", "Portal talk", "Draft",
    "Draft talk", "Module", "Module talk", "TimedText", "TimedText talk", "Gadget", "Gadget talk", "Gadget definition",
    "Gadget definition talk",
]

# Licence ids that permit use, and title parts that a fan wiki's pages are skipped for.
PERMISSIVE = ["mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense", "cc0-1.0", "0bsd"]
FANDOM_TITLE_PARTS = ["list of", "lists of", "category:", "template:", "disambiguation", "user:", "talk:"]


def any_of(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def count_of(c: Column, parts: list[str]) -> Column:
    out = F.lit(0)
    for p in parts:
        out = out + F.contains(c, F.lit(p)).cast("int")
    return out


def generated_text(c: Column) -> Column:
    """a strong marker, or four distinct weak ones."""
    low = F.lower(c)
    return any_of(low, STRONG_MARKERS) | (count_of(low, WEAK_MARKERS) >= 4)


def article_namespace(title: Column, ns: Column) -> Column:
    """main namespace by number and by title."""
    return (F.coalesce(F.nullif(ns, F.lit("")), F.lit("0")) == "0") & ~title.rlike("^(" + "|".join(NAMESPACES) + "):")


def redirect(text: Column, element: Column) -> Column:
    """a redirect element, or a text that begins with the redirect word."""
    return element.isNotNull() | F.startswith(F.lower(F.regexp_replace(text, r"^\s+", "")), F.lit("#redirect"))


def disambiguation(title: Column, text: Column) -> Column:
    """F5, dump pages: disambiguation by title or early text, and titles of lists."""
    t = F.lower(title)
    early = F.contains(F.lower(F.substring(text, 1, 500)), F.lit("(disambiguation)")) | F.contains(F.substring(F.lower(text), 1, 1000), F.lit("{{disambiguation"))
    return F.contains(t, F.lit("disambiguation")) | early | t.rlike("^lists? of ")


def list_title(title: Column) -> Column:
    """F5, interface pages: no blank is asked for after the title's first words."""
    t = F.lower(title)
    return F.contains(t, F.lit("disambiguation")) | t.rlike("^lists? of")


def fandom_title(title: Column) -> Column:
    """F5, fan wikis: any of the parts anywhere in the title."""
    return any_of(F.lower(title), FANDOM_TITLE_PARTS)


def usable_post(kind: Column, score: Column, body: Column, least: int) -> Column:
    """F6"""
    return kind.isin("1", "2") & (score >= least) & (F.coalesce(body, F.lit("")) != "")


def pair_lengths(prompt: Column, completion: Column, least_prompt: int = 5, least_completion: int = 10) -> Column:
    """F7"""
    return (F.length(prompt) >= least_prompt) & (F.length(completion) >= least_completion)


def english(lang: Column) -> Column:
    """F8: a missing language counts as English."""
    return F.coalesce(lang, F.lit("en")) == "en"


def permissive(licences: Column) -> Column:
    """no licence at all, or at least one that permits."""
    return (F.size(licences) == 0) | F.exists(licences, lambda x: F.lower(x).isin(PERMISSIVE))


# Expressions for intents, assistant boilerplate, foreign identities and leaked reasoning.
ARITHMETIC_WORDS = r"\b(plus|minus|times|divided|divide|multiply|multiplied|product|sum|subtract|square root|squared|cubed|percent|modulo|remainder|to the power)\b"
ARITHMETIC_SIGNS = r"\d\s*[-+*/%^]\s*\d|\d\s*(?:x|X)\s*\d"
MEMORABLE = (
    r"\b(remember|don'?t forget|note (that|this)|keep in mind|save (this|that)|call me|my name('s| is)|"
    r"my (\w+('s)? ){1,3}(is|are)\b|i (like|love|hate|prefer|live|work|drive|play|always|never|usually)|i'?m (allergic|from|married|working))"
)
BOILERPLATE = [
    r"\bas an ai\b",
    r"\bas a language model\b",
    r"\bas an ai language model\b",
    r"\bas a (helpful )?ai assistant\b",
    r"\bi'?m (just |only )?an ai\b",
    r"\bi am (just |only )?an ai\b",
    r"\bi('?m| am) an ai (language )?model\b",
    r"\bi (don'?t|do not) have (personal |real |the ability to feel )?(feelings|emotions|opinions|beliefs|preferences|a body|consciousness)\b",
    r"\b(i'?m sorry|i apologize),? but i (cannot|can'?t|am unable to|'?m unable to)\b",
]
FOREIGN = [
    r"open[- ]?assistant",
    r"\bLAION\b",
    r"trained by (deepmind|deep mind|openai|google|meta|anthropic|microsoft)",
    r"developed by (openai|google|deepmind|meta|anthropic|microsoft)",
    r"\bi('m| am) (chatgpt|chat gpt|gpt-?[345]|claude|llama|bard|gemini|alexa|siri)\b",
]
STALE = "qwen|base model"
LEAKED = "^I should |^I need to |^Let me think|^The user needs"


def insensitive(c: Column, patterns: list[str]) -> Column:
    return c.rlike("(?i)" + "|".join(patterns))


def arithmetic(c: Column) -> Column:
    """a digit, and an arithmetic word or a sign between digits."""
    return c.rlike("[0-9]") & (insensitive(c, [ARITHMETIC_WORDS]) | c.rlike(ARITHMETIC_SIGNS))


def memorable(c: Column) -> Column:
    """the message states something worth keeping."""
    return insensitive(c, [MEMORABLE])


def boilerplate(c: Column) -> Column:
    """F10"""
    return insensitive(c, BOILERPLATE)


def foreign_identity(c: Column) -> Column:
    """F11"""
    return insensitive(c, FOREIGN)


def stale(c: Column) -> Column:
    """F12"""
    return insensitive(c, [STALE])


def valid_example(c: Column, stage: Column) -> Column:
    """long enough, no leaked reasoning, and what the stage asks for."""
    low = F.lower(c)
    has = lambda x: F.contains(low, F.lit(x))
    command = F.contains(c, F.lit("[CMD]"))
    turns = (has("user:") & (has("assistant:") | has("ai:"))) | (has("q:") & has("a:")) | (F.contains(c, F.lit("\n")) & (F.length(c) >= 60))
    by_stage = F.when(stage == "commands", command & F.contains(c, F.lit("[/CMD]"))).when(stage == "web", command & has("search.web")).when(stage == "conversation", turns).otherwise(F.lit(True))
    return (F.length(c) >= 30) & ~insensitive(c, [LEAKED]) & by_stage


def graded(content: Column, want: Column, deny: Column) -> Column:
    """F16: some wanted part (or none asked for), and no denied part; case is ignored."""
    low = F.lower(content)
    wanted = (F.size(F.coalesce(want, F.array().cast("array<string>"))) == 0) | F.exists(want, lambda w: F.contains(low, F.lower(w)))
    return wanted & ~F.coalesce(F.exists(deny, lambda w: F.contains(low, F.lower(w))), F.lit(False))
