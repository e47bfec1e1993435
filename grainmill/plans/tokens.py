"""Queries of tokens and packing (P), MinHash (D5), mixes (R) and logs."""

from __future__ import annotations

import json
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

from grainmill.functions import predicates as P
from grainmill.functions import text as T
from grainmill.functions.bpe import MergeTokenizer, WordTokenizer, words
from grainmill.operators import conversations as V
from grainmill.operators import mixing as M
from grainmill.operators import packing as K
from grainmill.operators.dedup import paragraphs_once
from grainmill.operators.minhash import keep_longest
from grainmill.plans.filters import GENERATED_SQL, TRIM, rx, sql_chain, sql_lines
from grainmill.plans.samples import TALKS_SQL, injected, quoted, whole
from grainmill.registry import ORACLES, query
from grainmill.sources.readers import Preset, archived_pages, fan_articles, halved_budget, preset_rows, shared_budget, training_log, wiki_choice
from grainmill.tables import table

C = F.col
#: A given list of merges; this library learns none.
MERGES = [("t", "h"), ("th", "e"), ("e", "r"), ("o", "n"), ("a", "n"), ("i", "n"), ("e", "n"), ("an", "d"), ("t", "i"), ("ti", "on"), ("r", "e"), ("e", "s")]
TOKENIZER = MergeTokenizer(MERGES, K.CHAT_TOKENS)
BLOCK = 256


def docs(spark, d):
    return table(spark, d, "documents")


@query("p1_words", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '''s|''t|''re|''ve|''m|''ll|''d|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+')) AS BIGINT) AS n FROM documents")
def p1(spark, d):
    return docs(spark, d).select("doc_id", F.size(words(C("text"))).cast("long").alias("n"))


def vocabulary():
    """The given byte-level vocabulary that the token queries encode with; its file is never copied."""
    import public_tokenizers

    return _vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@lru_cache(1)
def _vocabulary(path):
    return MergeTokenizer.from_ranks(path, K.CHAT_TOKENS)


def digest_of(ids):
    return F.sha2(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","), 256)


def ids_of(spark, d):
    return K.encoded(docs(spark, d).select("doc_id", "text"), vocabulary())


@query("p4_encoded")
def p4(spark, d):
    return ids_of(spark, d).select("doc_id", F.size("ids").alias("n"), digest_of(C("ids")).alias("digest"))


@query("p3_dropout")
def p3(spark, d):
    """Merges are skipped at random, seeded by the text: more ids, the same text."""
    return K.encoded(docs(spark, d).select("doc_id", "text"), vocabulary(), dropout=0.1, seed=7).select("doc_id", F.size("ids").alias("n"), digest_of(C("ids")).alias("digest"))


@query("p5_words")
def p5(spark, d):
    """Known words are one id and others are spelt; the words known are those of 50 documents or more."""
    w = F.split("text", " ")
    known = docs(spark, d).select(F.explode(F.array_distinct(w)).alias("w")).groupBy("w").count().filter("count >= 50 AND w <> ''").orderBy(F.desc("count"), "w").limit(20_000)
    t = WordTokenizer([r.w for r in known.collect()], "".join(map(chr, range(33, 127))))
    x = K.with_tokenizer(docs(spark, d).select("doc_id", "text"), t, ["text"], "ids array<int>", lambda own, texts: [[own.encode(x or "") for x in texts]])
    return x.select("doc_id", F.size("ids").alias("n"), digest_of(C("ids")).alias("digest"))


@query("p6_pretokenized")
def p6(spark, d):
    """Paragraphs once over the whole corpus, then ids with an end mark and each document's offset in the token stream."""
    rows = docs(spark, d).select("doc_id", "text")
    ranges = max(3 * spark.sparkContext.defaultParallelism, K.groups_for(rows.count()))
    return K.token_stream(paragraphs_once(rows, ranges=ranges), vocabulary(), "doc_id", least=5)


@query("p7_packed")
def p7(spark, d):
    return K.packed(ids_of(spark, d).select("ids"), 512, MergeTokenizer.END)


@query("p8_masks")
def p8(spark, d):
    """The packed rows with their masks: each row's ids and spans, what each position attends to as one number a position (all of the mask,
    see ``mask_of``), and the digest of the mask itself; the pairs that it allows, counted in it, against those that the spans do."""
    x = K.with_masks(p7(spark, d), 512)
    spans = F.aggregate(F.arrays_zip(C("starts").alias("a"), C("ends").alias("b")), F.lit(0).cast("long"), lambda a, s: a + ((s["b"] - s["a"]) * (s["b"] - s["a"] + 1) / 2).cast("long"))
    return x.select("row", F.size("ids").alias("n"), "pairs", spans.alias("expected"), "ids", "starts", "ends", "sees", "mask_sha256")


def _messages(t):
    return F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))


@query("p10_rendered")
def p10(spark, d):
    def kernel(t, talks):
        got = [K.render(t, ms, most=BLOCK) for ms in talks]
        return [[i for i, _ in got], [m for _, m in got]]

    x = V.turns(table(spark, d, "conversations")).select("conv_id", _messages(C("t")).alias("messages"))
    return K.with_tokenizer(x, vocabulary(), ["messages"], "ids array<int>, learnt array<boolean>", kernel).drop("messages")


@query("p9_blocks")
def p9(spark, d):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("conv_id")
        rows = K.next_fit([(list(map(int, i)), list(map(bool, m))) for i, m in zip(pdf["ids"], pdf["learnt"], strict=True)], BLOCK)
        return pd.DataFrame({"part": int(pdf["part"].iloc[0]), "row": range(len(rows)), "x": [x for x, _ in rows], "y": [y for _, y in rows]})

    groups = K.groups_for(table(spark, d, "conversations").select("conv_id").distinct().count())
    parts = p10(spark, d).filter((F.size("ids") <= BLOCK + 1) & F.exists("learnt", lambda m: m)).withColumn("part", F.pmod(F.xxhash64("conv_id"), F.lit(groups)).cast("int"))
    return parts.groupBy("part").applyInPandas(run, "part int, row int, x array<int>, y array<int>")


@query("p11_fitted")
def p11(spark, d):
    def kernel(t, prompts, completions):
        got = [K.fitted(t, p, c, BLOCK) for p, c in zip(prompts, completions, strict=True)]
        return [[s for s, _ in got], [p for _, p in got]]

    # The last line, or the last word of a text of one line, is the completion; all before it is the prompt.
    x = docs(spark, d).select("doc_id", F.rtrim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n")).alias("t"))
    x = x.withColumn("completion", F.when(F.contains("t", F.lit("\n")), F.substring_index("t", "\n", -1)).otherwise(F.substring_index("t", " ", -1)))
    x = x.select("doc_id", F.substr("t", F.lit(1), F.length("t") - F.length("completion")).alias("p"), "completion")
    return K.with_tokenizer(x, vocabulary(), ["p", "completion"], "status string, prompt string", kernel).select("doc_id", "status", "prompt")


def _preferences(x, t, most):
    def kernel(own, prompts, good, bad):
        got = [K.preference(own, p, a, b, most) for p, a, b in zip(prompts, good, bad, strict=True)]
        return [[g[k][i] if g else None for g in got] for k in ("chosen", "rejected") for i in (0, 1)]

    out = K.with_tokenizer(x, t, ["p", "x", "y"], "chosen array<int>, chosen_labels array<int>, rejected array<int>, rejected_labels array<int>", kernel)
    return out.filter("chosen IS NOT NULL").drop("p", "x", "y")


@query("p13_preferences")
def p13(spark, d):
    """The first line of a text as prompt; all that follows against the source's name."""
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    return _preferences(docs(spark, d).select("doc_id", line.alias("p"), F.substr("text", F.length(line) + 1).alias("x"), C("source").alias("y")), vocabulary(), 4 * BLOCK)


@query("p12_feedback")
def p12(spark, d):
    """Chats as preference pairs: what came before an answer, that answer against the one before it."""
    t = V.turns(table(spark, d, "conversations"))
    answers = F.filter("t", lambda x: x["role"] == "assistant")
    shown = F.array_join(F.transform(F.filter("t", lambda x: x["role"] == "user"), lambda x: F.concat(F.lit("User: "), x["text"])), "\n")
    pairs = t.filter(F.size(answers) >= 2).select(C("conv_id").alias("doc_id"), shown.alias("p"), F.element_at(answers, -1)["text"].alias("x"), F.element_at(answers, -2)["text"].alias("y"))
    return _preferences(pairs, vocabulary(), BLOCK)


@query("x14_parsed")
def x14(spark, d):
    """Rendered chats back into content, calls and thinking: the ids that a model would generate for each answer."""
    def generated(t, x):
        ids, learnt = K.render(t, [{"role": "assistant", "content": f"<think>{len(x)}</think>{x}", "tool_calls": [{"name": "f", "arguments": {"n": len(x)}}]}])
        return [i for i, own in zip(ids, learnt, strict=True) if own]

    def kernel(t, texts):
        got = [K.parse(t, generated(t, x or "")) for x in texts]
        return [[g["content"] for g in got], [g["thinking"] for g in got], [json.dumps(g["tool_calls"]) for g in got]]

    x = table(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", "text")
    return K.with_tokenizer(x, vocabulary(), ["text"], "content string, thinking string, calls string", kernel).drop("text")


@query("d5_minhash")
def d5(spark, d):
    return keep_longest(docs(spark, d).select("doc_id", "text"))


_A, _A_SQL = injected(["all is well", "As an AI, no", "I'm OpenAssistant", "fine words", "a Qwen base model"])
_MIX_SQL = f"""WITH x AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS prompt, {_A_SQL} AS completion FROM documents),
    p AS (SELECT DISTINCT lower(trim(prompt)) AS q FROM x WHERE id % 10 = 0),
    g AS (SELECT *, CASE WHEN regexp_matches(completion, {rx(P.BOILERPLATE)}) THEN 'boilerplate' WHEN regexp_matches(completion, {rx(P.FOREIGN)}) THEN 'foreign' WHEN lower(trim(prompt)) IN (SELECT q FROM p) THEN 'leak' ELSE 'kept' END AS reason FROM x WHERE id % 3 <> 0)"""
_REASONS_SQL = f"{_MIX_SQL} SELECT reason, count(*) AS n FROM g GROUP BY ALL"
_ROWS_SQL = f"{_MIX_SQL} SELECT id, prompt, completion FROM g WHERE reason = 'kept' UNION ALL SELECT id, prompt, completion FROM x, range(8) AS r(k) WHERE id % 3 = 0 AND lower(trim(prompt)) NOT IN (SELECT q FROM p)"


def _mix(spark, d, completion, judge=lambda x: x):
    """General records, probes and own records of whole texts, the first line of each as the prompt; ``judge`` adds columns to records."""
    x = docs(spark, d).select(C("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("prompt"), completion.alias("completion"))
    return M.sft_mix(judge(x.filter("id % 3 <> 0")), x.filter("id % 10 = 0").select("prompt"), judge(x.filter("id % 3 = 0")), 8)


@query("r9_mix_reasons", _REASONS_SQL)
def r9_reasons(spark, d):
    return _mix(spark, d, _A())[1]


@query("r9_mix", _ROWS_SQL)
def r9_mix(spark, d):
    return _mix(spark, d, _A())[0]


@query("r9_fitted_mix")
def r9_fitted(spark, d):
    """The mix with every record fitted to a block of ids, those that can't be fitted left out.

    A record is fitted once, however often the mix repeats it, and texts don't move.
    """
    def kernel(t, prompts, completions):
        return [[s for s, _ in (K.fitted(t, p, c, 4 * BLOCK) for p, c in zip(prompts, completions, strict=True))]]

    judge = lambda x: K.with_tokenizer(x, vocabulary(), ["prompt", "completion"], "status string", kernel)
    return _mix(spark, d, _A(), judge)[0].filter("status <> 'dropped'").select("id", "status")


@query("r4_identity", f"SELECT doc_id FROM (SELECT doc_id, {_A_SQL} AS a FROM documents) WHERE NOT regexp_matches(a, '(?i)qwen|base model')")
def r4(spark, d):
    return M.identity(docs(spark, d).select("doc_id", _A().alias("completion"))).select("doc_id")


@query("r5_tool_examples", """SELECT p_partkey AS id, 'What is ' || p_size || ' * 2?' AS question, '{"name":"calculate","arguments":{"expression":"' || p_size || '"}}' AS call FROM part""")
def r5(spark, d):
    x = table(spark, d, "part").select(C("p_partkey").alias("id"), C("p_size").cast("string").alias("value"), (C("p_size") * 2).cast("string").alias("result"))
    m = M.tool_examples(x, "What is %s * 2?", "calculate", "expression")
    return m.select("id", F.get("messages", F.lit(0))["content"].alias("question"), F.get("messages", F.lit(1))["content"].alias("call"))


@query("r5_tool_forms", """SELECT p_partkey AS id, 'error' AS form, 4 AS turns, '{"error":"part ' || p_partkey || ' is gone"}' AS third FROM part
    UNION ALL SELECT p_partkey, 'dialogue', 8, CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 'restraint', 2, NULL FROM part WHERE p_partkey % 4 <> 0""")
def r5_forms(spark, d):
    k, size = C("p_partkey"), C("p_size").cast("string")
    p = table(spark, d, "part")
    errors = M.tool_errors(p.select(k.alias("id"), size.alias("value"), F.concat(F.lit("part "), k.cast("string"), F.lit(" is gone")).alias("error")), "Find %s.", "find", "part", "That failed: %s")
    talks = M.tool_dialogues(p.select(k.alias("id"), F.array(size, k.cast("string")).alias("values"), F.array(size, size).alias("results")), "What is %s?", "And %s?", "find", "part")
    plain = M.tool_restraint(p.select(k.alias("id"), C("p_name").alias("question"), F.when(k % 4 == 0, F.lit(" ")).otherwise(C("p_type")).alias("answer")))
    out = None
    for form, rows in (("error", errors), ("dialogue", talks), ("restraint", plain)):
        own = rows.select("id", F.lit(form).alias("form"), F.size("messages").alias("turns"), F.get("messages", F.lit(2))["content"].alias("third"))
        out = own if out is None else out.unionByName(own)
    return out


@query("r6_distractors")
def r6(spark, d):
    return M.with_distractors(docs(spark, d).select(C("doc_id").alias("id"), C("text").alias("fact")), 3)


#: Answers that a preference rejects: claims of another origin, and phrases of assistants.
_WRONG = [["I come from some other laboratory.", "Another model answers here, not me.", "I was made elsewhere."], ["As an AI, I have no opinion on that.", "I am only a program and cannot say."]]
_wrong_sql = " UNION ALL ".join(f"SELECT prompt, chosen, [{', '.join(map(quoted, pool))}][i % {len(pool)} + 1] AS rejected FROM q" for pool in _WRONG)


@query(
    "r7_preference_pairs",
    f"""WITH q AS (SELECT q[i + 1] AS prompt, a[i % len(a) + 1] AS chosen, i FROM (SELECT *, unnest(range(len(q))) AS i FROM {TALKS_SQL})), held AS (SELECT lower(text) AS h FROM conversations WHERE role = 'user' AND turn >= 6 UNION ALL SELECT lower(text) FROM benchmark)
    SELECT DISTINCT prompt, chosen, rejected FROM ({_wrong_sql}) WHERE chosen <> rejected AND lower(trim(prompt)) NOT IN (SELECT trim(h) FROM held WHERE h IS NOT NULL)""",
)
def r7(spark, d):
    """Users' questions with their answers, against wrong ones; the benchmark and questions late in a conversation are probes."""
    said = table(spark, d, "conversations")
    probes = said.filter("role = 'user' AND turn >= 6").select(C("text").alias("prompt")).unionByName(table(spark, d, "benchmark").select(C("text").alias("prompt")))
    return M.preference_pairs(V.talks(said), _WRONG, probes)


@query("r8_search_corpus", "SELECT doc_id, TRUE AS positive FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, FALSE FROM documents WHERE doc_id % 2 = 1")
def r8(spark, d):
    return M.search_corpus(docs(spark, d).select("doc_id").filter("doc_id % 2 = 0"), docs(spark, d).select("doc_id").filter("doc_id % 2 = 1"))


@query("s26_training_log", "SELECT event_id AS step, value AS loss, event_id % 10 = 0 AS validation FROM (SELECT event_id, round(abs(value), 3) AS value FROM events)")
def s26(spark, d):
    loss = F.format_string("%.3f", F.round(F.abs("value"), 3))
    line = F.when(C("event_id") % 10 == 0, F.format_string("val loss %s at step %d", loss, "event_id")).otherwise(F.format_string("[x] step %d | loss %s | 5 tok/s", "event_id", loss))
    return training_log(table(spark, d, "events").select(line.alias("value")))


@query("s17_wiki_choice", "SELECT lower(trim(name)) AS name, arg_max(site, (articles, site)) AS site, max(articles) AS articles FROM (SELECT source AS name, lang || '-' || source AS site, lang, count(*) AS articles FROM documents GROUP BY ALL) WHERE coalesce(lang, 'en') = 'en' AND articles >= 5 AND site NOT IN ('en-src1') GROUP BY ALL")
def s17(spark, d):
    found = docs(spark, d).groupBy(C("source").alias("name"), F.concat_ws("-", "lang", "source").alias("site"), "lang").agg(F.count("*").alias("articles"))
    return wiki_choice(found, ["en-src1"], 5)


@query("s13_halved_budget", "SELECT lang, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT lang, b, sum(b) OVER (PARTITION BY lang ORDER BY doc_id) - b AS before FROM (SELECT doc_id, lang, strlen(text) AS b FROM documents WHERE lang IN ('en', 'de'))) WHERE before < 250000 GROUP BY lang")
def s13(spark, d):
    x = halved_budget(docs(spark, d).select("doc_id", "lang", "text"), ("en", "de"), "lang", 500_000, "doc_id", 100_000)
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


@query(
    "s14_shared_budget",
    """WITH x AS (SELECT doc_id, lang, strlen(text) AS b, CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 END AS source_rank FROM documents WHERE length(text) >= 500 AND (doc_id % 4 = 0 OR doc_id % 3 = 0))
    SELECT doc_id, lang, source_rank, before // 200000 AS file FROM (SELECT *, sum(b) OVER (ORDER BY source_rank, doc_id) - b AS before FROM x WHERE source_rank IS NOT NULL) WHERE before < 700000""",
)
def s14(spark, d):
    """Permissively licensed texts of three languages in order of priority, until they share the budget."""
    licences = F.when(C("doc_id") % 4 == 0, F.array().cast("array<string>")).when(C("doc_id") % 3 == 0, F.array(F.lit("MIT"))).otherwise(F.array(F.lit("GPL-3.0")))
    good = docs(spark, d).filter(P.permissive(licences) & (F.length("text") >= 500)).select("doc_id", "lang", "text")
    return shared_budget(good, {"fr": 0, "en": 1, "es": 2}, "lang", 700_000, "doc_id", 200_000).select("doc_id", "lang", "source_rank", "file")


def _good_sql(text, least):
    return f"length({text}) >= {least} AND length(regexp_replace({text}, '\\P{{L}}', '', 'g')) >= 0.5 * length({text}) AND length(regexp_replace({text}, '[^.?!]', '', 'g')) >= 3"


@query(
    "s16_archived_pages",
    rf"""WITH b AS ({ORACLES["t7_html_text"]}),
    n AS (SELECT page_id, regexp_replace(regexp_replace(substr(regexp_replace(url, '[^\p{{L}}\p{{N}}_]', '_', 'g'), 1, 120), '_+', '_', 'g'), '^_|_$', '', 'g') AS name FROM pages),
    g AS (SELECT page_id, name, body AS text, lower(body) AS t FROM b JOIN n USING (page_id) WHERE {_good_sql("body", 100)})
    SELECT page_id, name, text FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id) AS rn FROM g WHERE NOT ({GENERATED_SQL})) WHERE rn = 1""",
)
def s16(spark, d):
    return archived_pages(table(spark, d, "pages"), 100).select("page_id", "name", "text")


_MARKED_SQL = f"{quoted("'" * 3 + "Bold" + "'" * 3 + " [[Target|shown]] ")} || text || chr(10) || '{{{{Infobox|a={{{{b}}}}}}}}'"
_DENIED_SQL = " OR ".join(f"contains(lower(title), {quoted(x)})" for x in P.FANDOM_TITLE_PARTS)


@query(
    "s18_fan_articles",
    f"""WITH x AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'List of ' || source ELSE source || ' ' || doc_id END AS title, {_MARKED_SQL} AS text FROM documents),
    k AS (SELECT id, title, {sql_lines(sql_chain(sql_chain("text", [*T.FAN_STEPS, (TRIM, "")]), T.WIKI_STEPS), "NOT (length(l) < 20 AND ends_with(l, ':'))")} AS text FROM x WHERE length(text) >= 200 AND NOT ({_DENIED_SQL})),
    g AS (SELECT id, title, text, lower(text) AS t FROM k WHERE {_good_sql("text", 1500)})
    SELECT id, title, text FROM g WHERE NOT ({GENERATED_SQL})""",
)
def s18(spark, d):
    title = F.when(C("doc_id") % 5 == 0, F.concat(F.lit("List of "), "source")).otherwise(F.concat_ws(" ", "source", C("doc_id").cast("string")))
    marked = F.concat(F.lit("'''Bold''' [[Target|shown]] "), "text", F.lit("\n{{Infobox|a={{b}}}}"))
    return fan_articles(docs(spark, d).select(C("doc_id").alias("id"), title.alias("title"), marked.alias("text")))


@query("s10_s12_streamed", r"SELECT source, count(*) AS n FROM (SELECT source, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id) - strlen(text) AS before FROM documents WHERE length(text) >= 500 AND length(regexp_replace(text, '\P{L}', '', 'g')) >= 0.5 * length(text) AND length(regexp_replace(text, '[^.?!]', '', 'g')) >= 3) WHERE before < 60000 GROUP BY source")
def s10(spark, d):
    """A preset for each source: its rules, then its byte budget."""
    return preset_rows(docs(spark, d), {f"src{i}": Preset(target_bytes=60_000, human_only=False) for i in range(64)}).groupBy("source").agg(F.count("*").alias("n"))


@query("f21_vocab_bounds", "SELECT doc_id, list_max(list_transform(string_split(text, ''), lambda c: unicode(c))) < 200 AS inside FROM documents WHERE length(text) > 0")
def f21(spark, d):
    ids = F.transform(F.split("text", ""), lambda c: F.ascii(c))
    return docs(spark, d).filter("length(text) > 0").select("doc_id", ((F.array_max(ids) < 200) & (F.array_min(ids) >= 0)).alias("inside"))


@query("f18_f19_f21_ids")
def f18_ids(spark, d):
    """The rules of ids, on the ids of whole texts: enough of them, those that fit a block, those inside the vocabulary."""
    t, ids = vocabulary(), C("ids")
    inside = (F.array_max(ids) < len(t)) & (F.array_min(ids) >= 0)
    return ids_of(spark, d).select("doc_id", (F.size(ids) >= 5).alias("enough"), (F.size(ids) <= 4 * BLOCK + 1).alias("sft"), (F.size(ids) <= 4 * BLOCK).alias("dpo"), F.coalesce(inside, F.lit(True)).alias("inside"))


@query("f19_fits_block", f"SELECT doc_id, n <= {BLOCK} + 1 AS sft, n <= {BLOCK} AS dpo FROM (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS n FROM documents)")
def f19(spark, d):
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9']+"), F.lit(0)))
    return docs(spark, d).select("doc_id", (n <= BLOCK + 1).alias("sft"), (n <= BLOCK).alias("dpo"))


@query(
    "f19_trainable",
    f"""WITH t AS (SELECT conv_id, role, len(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS n FROM conversations)
    SELECT conv_id, sum(n) <= {BLOCK} + 1 AND coalesce(sum(n) FILTER (role = 'assistant'), 0) > 0 AS sft FROM t GROUP BY conv_id""",
)
def f19_trainable(spark, d):
    """Conversations that fit a block and have a position to learn from: a word of an answer."""
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9']+"), F.lit(0)))
    t = table(spark, d, "conversations").select("conv_id", "role", n.alias("n"))
    learnt = F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0))
    return t.groupBy("conv_id").agg(((F.sum("n") <= BLOCK + 1) & (learnt > 0)).alias("sft"))


@query("f21_vocab_bounds_whole", "SELECT page_id, list_max(list_transform(string_split(html, ''), lambda c: unicode(c))) < 200 AS inside FROM pages WHERE length(html) > 0")
def f21_whole(spark, d):
    ids = F.transform(F.split("html", ""), lambda c: F.ascii(c))
    return table(spark, d, "pages").filter("length(html) > 0").select("page_id", ((F.array_max(ids) < 200) & (F.array_min(ids) >= 0)).alias("inside"))


@query("r9_mix_reasons_whole", whole(_REASONS_SQL, _A_SQL, "text"))
def r9_reasons_whole(spark, d):
    return _mix(spark, d, C("text"))[1]


@query("r9_mix_whole", whole(_ROWS_SQL, _A_SQL, "text"))
def r9_mix_whole(spark, d):
    return _mix(spark, d, C("text"))[0]


@query("r4_identity_whole", whole(ORACLES["r4_identity"], _A_SQL, "text"))
def r4_whole(spark, d):
    return M.identity(docs(spark, d).select("doc_id", C("text").alias("completion"))).select("doc_id")
