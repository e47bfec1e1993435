"""Readers of corpus files: texts, JSON lines, JSON arrays, XML dumps, logs, token files."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.operators.ranks import running_totals
from grainmill.shipping import ship

#: Files over this size are left out of a corpus.
MAX_FILE_BYTES = 100 << 30


def text_files(spark: SparkSession, path: str, suffix: str = "*.txt") -> DataFrame:
    """(path, text): one row a file below ``path``, read whole."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=suffix)
    return raw.filter(F.col("_metadata.file_size") <= MAX_FILE_BYTES).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def text_lines(spark: SparkSession, path: str, suffix: str = "*.txt") -> DataFrame:
    """(path, line): split over tasks within large files."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", suffix).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def json_lines(spark: SparkSession, path: str, key: str = "text", limit: int = 1_000_000) -> DataFrame:
    """(path, text): the string ``key`` of each line, stripped; broken lines and blank texts go; at most ``limit`` rows (S3)."""
    lines = text_lines(spark, path, "*.jsonl")
    kind = F.get_json_object("line", f"$.{key}")
    whole = F.from_json("line", T.MapType(T.StringType(), T.StringType()), {"mode": "PERMISSIVE"})
    good = lines.filter(whole.isNotNull()).select("path", F.regexp_replace(kind, "^\\s+|\\s+$", "").alias("text"))
    return good.filter("text <> ''").limit(limit)


def corpus(spark: SparkSession, path: str, key: str = "text") -> DataFrame:
    """(path, text) of every text, JSON-lines and JSON file below ``path``."""
    from grainmill.sources.json_parts import json_arrays

    return text_files(spark, path).unionByName(json_lines(spark, path, key)).unionByName(json_arrays(spark, path, key))


#: Rows of a posts dump.
POST = "_Id long, _PostTypeId string, _ParentId long, _Score int, _Title string, _Body string"


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, ns, redirect, text) of a dump."""
    schema = T.StructType([T.StructField("title", T.StringType()), T.StructField("ns", T.StringType()), T.StructField("redirect", T.StructType([T.StructField("_title", T.StringType())])), T.StructField("revision", T.StructType([T.StructField("text", T.StringType())]))])
    d = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return d.select("title", "ns", F.col("redirect._title").alias("redirect"), F.coalesce("revision.text", F.lit("")).alias("text"))


def posts(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, parent, score, title, body) of a posts dump."""
    d = spark.read.format("xml").option("rowTag", "row").schema(POST).load(path)
    return d.select(F.col("_Id").alias("id"), F.col("_PostTypeId").alias("kind"), F.col("_ParentId").alias("parent"), F.coalesce("_Score", F.lit(0)).alias("score"), F.col("_Title").alias("title"), F.col("_Body").alias("body"))


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompts: a JSON-lines file's ``prompt``, or lines of a text without blanks and comments."""
    if path.endswith(".jsonl"):
        return spark.read.text(path).select(F.trim(F.get_json_object("value", "$.prompt")).alias("prompt")).filter("prompt <> ''")
    return spark.read.text(path).select(F.trim("value").alias("prompt")).filter("prompt <> '' AND NOT startswith(prompt, '#')")


def payload(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a file by its suffix; broken rows fail."""
    if path.endswith(".txt"):
        return spark.read.text(path).filter("trim(value) <> ''")
    return spark.read.option("mode", "FAILFAST").option("multiLine", path.endswith(".json")).json(path)


def graded_questions(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """(question, answer) rows that have both, at most ``limit``."""
    d = spark.read.schema("question string, answer string").json(path)
    return d.filter("coalesce(question, '') <> '' AND coalesce(answer, '') <> ''").limit(limit)


STEP = r"step\s+(\d+).*?loss\s+([\d.]+)"
VALIDATION = r"val(?:idation)?\s+loss\s+([\d.]+).*?step\s+(\d+)"


def training_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """(step, loss, validation): training and validation rows of a log."""
    c = F.col(column)
    val = c.rlike(f"(?i){VALIDATION}")
    step = F.when(val, F.regexp_extract(c, f"(?i){VALIDATION}", 2)).otherwise(F.regexp_extract(c, f"(?i){STEP}", 1))
    loss = F.when(val, F.regexp_extract(c, f"(?i){VALIDATION}", 1)).otherwise(F.regexp_extract(c, f"(?i){STEP}", 2))
    return lines.select(step.try_cast("long").alias("step"), loss.try_cast("double").alias("loss"), val.alias("validation")).filter("step IS NOT NULL AND loss IS NOT NULL")


#: Token files: a magic word, a header of fixed size with a JSON description, then little-endian ids.
MAGIC, HEADER = b"ETOK", 256


def token_header(count: int, vocabulary: int) -> bytes:
    return (MAGIC + json.dumps({"count": count, "vocab": vocabulary, "dtype": "uint32"}).encode()).ljust(HEADER, b"\0")


def token_file(ids: list[int], vocabulary: int) -> bytes:
    """The bytes of a token file (K6)."""
    return token_header(len(ids), vocabulary) + struct.pack(f"<{len(ids)}I", *ids)


def read_tokens(data: bytes) -> list[int]:
    """The ids of a token file; fails on a wrong magic word, size, count, or an id outside the vocabulary."""
    if data[: len(MAGIC)] != MAGIC or len(data) < HEADER or (len(data) - HEADER) % 4:
        raise ValueError("not a token file")
    about = json.loads(data[len(MAGIC) : HEADER].rstrip(b"\0"))
    ids = list(struct.unpack(f"<{(len(data) - HEADER) // 4}I", data[HEADER:]))
    if len(ids) != about["count"] or any(i >= about["vocab"] for i in ids):
        raise ValueError("the token file's count or ids are wrong")
    return ids


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, ids) of token files."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "ids": [read_tokens(x) for x in b["content"]]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", "content").mapInPandas(run, "path string, ids array<long>")


def existing_images(rows: DataFrame, spark: SparkSession, folder: str, column: str = "image") -> DataFrame:
    """Caption rows whose image file exists."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("_name"))
    return rows.join(files, F.element_at(F.split(F.col(column), "/"), -1) == F.col("_name"), "left_semi")


def wiki_articles(pages: DataFrame, least: int = 500) -> DataFrame:
    """S6 and its rules: articles of the main namespace with enough text."""
    from grainmill.functions.predicates import article_namespace, disambiguation, redirect
    from grainmill.functions.text import dump_wikitext, quality_filter

    kept = pages.filter(article_namespace(F.col("title"), F.col("ns")) & ~redirect(F.col("text"), F.col("redirect")) & ~disambiguation(F.col("title"), F.col("text")))
    return kept.select("title", dump_wikitext(F.col("text")).alias("text")).filter(quality_filter(F.col("text"), least))


def budgeted(rows: DataFrame, target_bytes: int, order: str | list[str], batch: int = 5 << 20, text: str = "text") -> DataFrame:
    """O3, K5: rows in ``order``, which must be unique, until ``target_bytes`` are reached, with the number of
    the file they go to.

    The row that reaches the target is the last. Running sums are taken of keys and sizes; then the rows that
    stay are joined. Files are cut at multiples of ``batch`` bytes of the running sum, so each holds about that.
    """
    order = [order] if isinstance(order, str) else order
    sized = running_totals(rows.select(*order, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_bytes")), order, F.col("_bytes"))
    kept = sized.filter(F.col("before") < target_bytes).select(*order, F.floor(F.col("before") / batch).alias("file"))
    return rows.join(kept, order)


@dataclass(frozen=True)
class Preset:
    """What is taken of a streamed source."""

    target_bytes: int
    least_chars: int = 500
    human_only: bool = True


#: The presets of the streamed web corpora; targets are parameters of a run.
PRESETS = {
    "fineweb-edu": Preset(50 << 30, human_only=False),
    "openwebtext": Preset(20 << 30),
    "c4": Preset(30 << 30),
    "dclm": Preset(50 << 30),
}


def preset_accepted(rows: DataFrame, presets: dict[str, Preset], by: str = "source", text: str = "text") -> DataFrame:
    """Rows of the sources that have a preset, after its quality rules."""
    from grainmill.functions.predicates import generated_text
    from grainmill.functions.text import quality_filter

    good = None
    for human, least in sorted({(p.human_only, p.least_chars) for p in presets.values()}):
        names = [n for n, p in presets.items() if (p.human_only, p.least_chars) == (human, least)]
        rule = F.col(by).isin(names) & quality_filter(F.col(text), least)
        part = rows.filter(rule & ~generated_text(F.col(text)) if human else rule)
        good = part if good is None else good.unionByName(part)
    return good


def preset_rows(rows: DataFrame, presets: dict[str, Preset], by: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of the sources that have a preset: its quality rules, then its byte budget, in order.

    All sources go through one running sum, from which each takes its own start, so a large source is no hot key.
    """
    good = preset_accepted(rows, presets, by, text)
    sized = running_totals(good.select(by, order, F.octet_length(text).cast("long").alias("_bytes")), [by, order], F.col("_bytes"))
    start = sized.groupBy(by).agg(F.min("before").alias("_start"))
    target = F.create_map(*[F.lit(x) for n, p in presets.items() for x in (n, p.target_bytes)])
    inside = sized.join(F.broadcast(start), by).filter(F.col("before") - F.col("_start") < F.try_element_at(target, F.col(by)))  # one row a preset
    return good.join(inside.select(by, order), [by, order], "left_semi")


def shared_budget(rows: DataFrame, ranks: dict[str, int], by: str, target_bytes: int, order: str, batch: int = 5 << 20) -> DataFrame:
    """Sources in their order of priority until they have ``target_bytes`` together; others are left out."""
    rank = F.try_element_at(F.create_map(*[F.lit(x) for p in ranks.items() for x in p]), F.col(by))
    return budgeted(rows.withColumn("source_rank", rank).filter("source_rank IS NOT NULL"), target_bytes, ["source_rank", order], batch)


def halved_budget(rows: DataFrame, halves: tuple[str, str], by: str, target_bytes: int, order: str, least_bytes: int = 100_000_000) -> DataFrame:
    """Half of the bytes from each of two configurations, and at least ``least_bytes`` from each."""
    each = max(least_bytes, target_bytes // 2)
    first, second = (budgeted(rows.filter(F.col(by) == h), each, [order]) for h in halves)
    return first.unionByName(second)


def archived_pages(pages: DataFrame, least: int = 500, human_only: bool = True) -> DataFrame:
    """(page_id, url, name, text): texts of archived pages that pass the quality rule and, if asked, aren't
    generated; of pages with one name the first stays. ``pages`` has (page_id, url, html)."""
    from grainmill.functions.predicates import generated_text
    from grainmill.functions.text import html_text, quality_filter, url_name

    x = pages.select("page_id", "url", url_name(F.col("url")).alias("name"), F.explode(F.array(html_text(F.col("html")))).alias("text"))
    good = x.filter(quality_filter(F.col("text"), least))
    return first_of_names(good.filter(~generated_text(F.col("text"))) if human_only else good, F.col("name"), ["page_id"])


def fan_articles(pages: DataFrame, least: int = 1500) -> DataFrame:
    """(id, title, text) of a fan wiki: wikitext of 200 characters or more, no redirects and no titles of the
    deny-list, cleaned as wikitext and then as text. ``pages`` has (id, title, text)."""
    from grainmill.functions.predicates import fandom_title, generated_text, redirect
    from grainmill.functions.text import clean_wiki, fan_wikitext, quality_filter

    kept = pages.filter((F.length("text") >= 200) & ~redirect(F.col("text"), F.lit(None).cast("string")) & ~fandom_title(F.col("title")))
    x = kept.select("id", "title", F.explode(F.array(clean_wiki(fan_wikitext(F.col("text"))))).alias("text"))
    return x.filter(quality_filter(F.col("text"), least) & ~generated_text(F.col("text")))


def wiki_choice(found: DataFrame, skip: list[str], least: int = 500) -> DataFrame:
    """Of discovered wikis (site, name, lang, articles) the English ones that aren't on the skip list and have
    enough articles, one for each site name, the largest."""
    x = found.filter((F.coalesce("lang", F.lit("en")) == "en") & (F.col("articles") >= least) & ~F.col("site").isin(skip))
    return x.groupBy(F.lower(F.trim("name")).alias("name")).agg(F.max_by("site", F.struct("articles", "site")).alias("site"), F.max("articles").alias("articles"))


def in_priority(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    """The union of sources with their ranks."""
    out = None
    for rank, p in parts:
        own = p.withColumn("source_rank", F.lit(rank))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def first_of_names(df: DataFrame, name: Column, order: list[str]) -> DataFrame:
    """Of rows with one name the first by ``order``."""
    return df.groupBy(name.alias("_n")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def sample_corpus(spark: SparkSession, paragraphs: list[str], target_bytes: int) -> DataFrame:
    """(cycle, pos, text): the paragraphs again and again, each repeat marked, until the target is passed."""
    one = sum(len(p.encode()) + 8 for p in paragraphs)
    cycles = spark.range(max(1, -(-target_bytes // max(one, 1)))).select(F.col("id").alias("cycle"))
    own = F.posexplode(F.array(*map(F.lit, paragraphs))).alias("pos", "p")
    return cycles.select("cycle", own).select("cycle", "pos", F.when(F.col("cycle") == 0, F.col("p")).otherwise(F.format_string("[%d.%d] %s", "cycle", F.col("pos") + 1, "p")).alias("text"))
