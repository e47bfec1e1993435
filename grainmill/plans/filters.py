"""Queries of the predicates (F) and text transforms (T), with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import predicates as P
from grainmill.functions import text as T
from grainmill.operators.curation import valid_row
from grainmill.plans.samples import chosen, injected, quoted, whole
from grainmill.registry import ORACLES, query
from grainmill.tables import table

C = F.col


def docs(spark, d):
    return table(spark, d, "documents")


def list_sql(parts) -> str:
    return "[" + ", ".join(map(quoted, parts)) + "]"


def rx(patterns: list[str]) -> str:
    return quoted("(?i)" + "|".join(patterns))


@query("f1_quality", r"SELECT doc_id FROM documents WHERE length(text) >= 500 AND length(regexp_replace(text, '\P{L}', '', 'g')) >= 0.5 * length(text) AND length(regexp_replace(text, '[^.?!]', '', 'g')) >= 3")
def f1(spark, d):
    return docs(spark, d).filter(T.quality_filter(C("text"))).select("doc_id")


_AI = [P.STRONG_MARKERS[0].upper(), " ".join(P.WEAK_MARKERS[:4]), " ".join(P.WEAK_MARKERS[3:6]), P.STRONG_MARKERS[-1], (P.WEAK_MARKERS[0] + " ") * 5]
_ai, _ai_sql = injected(_AI)
_count = " + ".join(f"CAST(contains(t, {quoted(m)}) AS INT)" for m in P.WEAK_MARKERS)
_strong = " OR ".join(f"contains(t, {quoted(m)})" for m in P.STRONG_MARKERS)


#: F2 for a lower-case text ``t``.
GENERATED_SQL = f"({_strong}) OR ({_count}) >= 4"


@query("f2_generated", f"SELECT doc_id, {GENERATED_SQL} AS generated FROM (SELECT doc_id, lower({_ai_sql}) AS t FROM documents)")
def f2(spark, d):
    return docs(spark, d).select("doc_id", P.generated_text(_ai()).alias("generated"))


_TITLES = ["Talk:Water", "User talk:Ann", "Water", "Talking", "Help:Contents", "List of rivers", "Lists of lakes", "Mercury (disambiguation)", "Listing of all", "list ofall", "Gadget definition:x"]
_title, _title_sql = chosen(_TITLES, "doc_id")
_ns, _ns_sql = chosen(["0", "", "4", "0", "0", "0", "0"], "doc_id")


@query("f3_namespace", f"SELECT doc_id, coalesce(nullif({_ns_sql}, ''), '0') = '0' AND NOT regexp_matches({_title_sql}, '^({'|'.join(P.NAMESPACES)}):') AS article FROM documents")
def f3(spark, d):
    return docs(spark, d).select("doc_id", P.article_namespace(_title(), _ns()).alias("article"))


_wiki = ["#REDIRECT [[x]]", "  \n#redirect [[y]]", "no #redirect here", "{{Disambiguation}}", "see x (disambiguation) there", "plain"]
_w, _w_sql = injected(_wiki)


@query("f4_redirect", f"SELECT doc_id, doc_id % 5 = 0 OR starts_with(lower(regexp_replace({_w_sql}, '^\\s+', '')), '#redirect') AS redirect FROM documents")
def f4(spark, d):
    return docs(spark, d).select("doc_id", P.redirect(_w(), F.when(C("doc_id") % 5 == 0, F.lit("x"))).alias("redirect"))


@query(
    "f5_disambiguation",
    f"""SELECT doc_id, contains(lower(t), 'disambiguation') OR contains(lower(substr(w, 1, 500)), '(disambiguation)')
      OR contains(substr(lower(w), 1, 1000), '{{{{disambiguation') OR regexp_matches(lower(t), '^lists? of ') AS dump,
      contains(lower(t), 'disambiguation') OR regexp_matches(lower(t), '^lists? of') AS api,
      len(list_filter({list_sql(P.FANDOM_TITLE_PARTS)}, lambda p: contains(lower(t), p))) > 0 AS fandom
    FROM (SELECT doc_id, {_title_sql} AS t, {_w_sql} AS w FROM documents)""",
)
def f5(spark, d):
    return docs(spark, d).select("doc_id", P.disambiguation(_title(), _w()).alias("dump"), P.list_title(_title()).alias("api"), P.fandom_title(_title()).alias("fandom"))


_kind, _kind_sql = chosen(["1", "2", "3", "1", "4"], "doc_id")


@query("f6_posts", f"SELECT doc_id FROM documents WHERE {_kind_sql} IN ('1', '2') AND n_chars >= 1000 AND CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END <> ''")
def f6(spark, d):
    return docs(spark, d).filter(P.usable_post(_kind(), C("n_chars"), F.when(C("doc_id") % 4 == 0, F.lit("")).otherwise(C("text")), 1000)).select("doc_id")


@query("f7_pair_lengths", "SELECT doc_id FROM documents WHERE length(split_part(text, ' ', 1)) >= 5 AND length(substr(text, length(split_part(text, ' ', 1)) + 2)) >= 10")
def f7(spark, d):
    first = F.split_part("text", F.lit(" "), F.lit(1))
    return docs(spark, d).filter(P.pair_lengths(first, F.substr("text", F.length(first) + 2))).select("doc_id")


@query("f8_english", "SELECT doc_id FROM documents WHERE coalesce(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END, 'en') = 'en'")
def f8(spark, d):
    return docs(spark, d).filter(P.english(F.when(C("doc_id") % 7 != 0, C("lang")))).select("doc_id")


_LIC = ["MIT", "GPL-3.0", "Apache-2.0", "ISC", "AGPL-3.0", "cc0-1.0"]
_l1, _l1s = chosen(_LIC, "p_partkey")


@query("f9_permissive", f"SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN TRUE ELSE lower({_l1s}) IN ({list_sql(P.PERMISSIVE)[1:-1]}) OR (p_partkey % 4 = 1 AND 'isc' IN ({list_sql(P.PERMISSIVE)[1:-1]})) END AS permitted FROM part")
def f9(spark, d):
    k = C("p_partkey") % 4
    own = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(_l1(), F.lit("ISC"))).otherwise(F.array(_l1()))
    return table(spark, d, "part").select("p_partkey", P.permissive(own).alias("permitted"))


_VOICE = ["As an AI, I can't", "as a helpful AI assistant", "I do not have personal feelings", "I'm sorry, but I cannot", "the language model of physics", "I'm OpenAssistant", "trained by OpenAI", "i am gpt4", "developed by nobody", "a Qwen base model"]
_v, _v_sql = injected(_VOICE)


@query("f10_f11_f12_voice", f"SELECT doc_id, regexp_matches(t, {rx(P.BOILERPLATE)}) AS boilerplate, regexp_matches(t, {rx(P.FOREIGN)}) AS foreign_identity, regexp_matches(t, {rx([P.STALE])}) AS stale FROM (SELECT doc_id, {_v_sql} AS t FROM documents)")
def f10(spark, d):
    return docs(spark, d).select("doc_id", P.boilerplate(_v()).alias("boilerplate"), P.foreign_identity(_v()).alias("foreign_identity"), P.stale(_v()).alias("stale"))


_EX = ["I should say", "[CMD]search.web x[/CMD] and more words to be long", "User: hi there friend\nAssistant: hello to you", "q: what is it that you say a: nothing at all", "short", "[CMD]file.read and never closed, which is wrong"]
_e, _e_sql = injected(_EX)
_st, _st_sql = chosen(["basics", "commands", "web", "conversation", "basics"], "doc_id")


@query(
    "f13_valid_example",
    f"""SELECT doc_id, length(t) >= 30 AND NOT regexp_matches(t, {rx([P.LEAKED])}) AND CASE s
      WHEN 'commands' THEN contains(t, '[CMD]') AND contains(t, '[/CMD]')
      WHEN 'web' THEN contains(t, '[CMD]') AND contains(lower(t), 'search.web')
      WHEN 'conversation' THEN (contains(lower(t), 'user:') AND (contains(lower(t), 'assistant:') OR contains(lower(t), 'ai:')))
        OR (contains(lower(t), 'q:') AND contains(lower(t), 'a:')) OR (contains(t, chr(10)) AND length(t) >= 60)
      ELSE TRUE END AS valid FROM (SELECT doc_id, {_e_sql} AS t, {_st_sql} AS s FROM documents)""",
)
def f13(spark, d):
    return docs(spark, d).select("doc_id", P.valid_example(_e(), _st()).alias("valid"))


_ASK = ["what is 7 * 8", "sum of 3 and 4", "sum yourself up", "remember that", "my dog's name is Rex", "I love tea", "3x4", "2 apples"]
_q, _q_sql = injected(_ASK, key="conv_id")


@query("f14_f15_intent", f"SELECT conv_id, turn, regexp_matches(t, '[0-9]') AND (regexp_matches(t, {rx([P.ARITHMETIC_WORDS])}) OR regexp_matches(t, {quoted(P.ARITHMETIC_SIGNS)})) AS arithmetic, regexp_matches(t, {rx([P.MEMORABLE])}) AS memorable FROM (SELECT conv_id, turn, {_q_sql} AS t FROM conversations)")
def f14(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", P.arithmetic(_q()).alias("arithmetic"), P.memorable(_q()).alias("memorable"))


@query("f16_graded", "SELECT conv_id, turn, (turn % 3 = 0 OR contains(lower(text), 'the') OR contains(lower(text), 'xyz')) AND NOT contains(lower(text), 'tion') AS passed FROM conversations")
def f16(spark, d):
    want = F.when(C("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("The"), F.lit("xyz")))
    return table(spark, d, "conversations").select("conv_id", "turn", P.graded(C("text"), want, F.array(F.lit("TION"))).alias("passed"))


@query(
    "f17_row_rules",
    """SELECT conv_id, count_if(role = 'user') >= 1 AND count_if(role = 'assistant') >= 1 AND count_if(trim(text) = '') = 0 AS preference_ok,
      CAST(count_if(role NOT IN ('system', 'user', 'assistant')) AS BIGINT) AS bad_roles FROM conversations GROUP BY conv_id""",
)
def f17(spark, d):
    r = C("role")
    ok = (F.count_if(r == "user") >= 1) & (F.count_if(r == "assistant") >= 1) & (F.count_if(F.trim("text") == "") == 0)
    return table(spark, d, "conversations").groupBy("conv_id").agg(ok.alias("preference_ok"), F.count_if(~r.isin("system", "user", "assistant")).alias("bad_roles"))


_MODES = {
    "dpo": "trim(coalesce(p, '')) <> '' AND trim(coalesce(c, '')) <> '' AND trim(coalesce(r, '')) <> ''",
    "grpo": "trim(coalesce(p, '')) <> ''",
    "kto": "trim(coalesce(p, '')) <> '' AND trim(coalesce(c, '')) <> '' AND d IS NOT NULL",
    "lora": "trim(coalesce(c, '')) <> ''",
    "vision": "trim(coalesce(i, '')) <> '' AND trim(coalesce(c, '')) <> ''",
    "sft": "trim(coalesce(c, '')) <> '' OR (trim(coalesce(p, '')) <> '' AND trim(coalesce(c, '')) <> '')",
}


@query(
    "f17_mode_rules",
    f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' ' WHEN doc_id % 7 = 0 THEN NULL ELSE split_part(text, chr(10), 1) END AS p, text AS c, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS r, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 2 = 0 END AS d, CASE WHEN doc_id % 11 <> 0 THEN lang END AS i FROM documents)
    SELECT doc_id, {', '.join(f"{sql} AS {m}" for m, sql in _MODES.items())} FROM x""",
)
def f17_modes(spark, d):
    k = C("doc_id")
    prompt = F.when(k % 5 == 0, F.lit(" ")).when(k % 7 != 0, F.split_part("text", F.lit("\n"), F.lit(1)))
    row = {"prompt": prompt, "chosen": C("text"), "rejected": F.when(k % 3 == 0, F.lit("")).otherwise(C("source")), "response": C("text"), "completion": C("text"), "text": C("text"), "desirable": F.when(k % 4 != 0, k % 2 == 0), "image": F.when(k % 11 != 0, C("lang"))}
    return docs(spark, d).select("doc_id", *[valid_row(m, row).alias(m) for m in _MODES])


@query("f18_min_tokens", r"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS BIGINT) AS n FROM documents WHERE len(regexp_extract_all(lower(text), '[a-z0-9'']+')) >= 5")
def f18(spark, d):
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9']+"), F.lit(0))).cast("long")
    return docs(spark, d).select("doc_id", n.alias("n")).filter("n >= 5")


_TAG = ["<search>x</search>", "<search>open only", "none"]
_t, _t_sql = injected(_TAG)


@query("f20_tag_rules", f"SELECT doc_id FROM (SELECT doc_id, doc_id % 2 = 0 AS positive, {_t_sql} AS t FROM documents) WHERE CASE WHEN positive THEN NOT (contains(t, '<search>') AND contains(t, '</search>')) ELSE contains(t, '<search>') OR contains(t, '</search>') END")
def f20(spark, d):
    a, b = F.contains(_t(), F.lit("<search>")), F.contains(_t(), F.lit("</search>"))
    return docs(spark, d).filter(F.when(C("doc_id") % 2 == 0, ~(a & b)).otherwise(a | b)).select("doc_id")


def sql_chain(x: str, steps) -> str:
    for p, to, *times in steps:
        p, flags = T.PLAIN_HEADING if p == T.HEADING else p, "g"
        if p.startswith("(?"):
            flags += p[2 : p.index(")")].replace("m", "").replace("U", "")
            p = ("(?m)" if "m" in p[: p.index(")")] else "") + p[p.index(")") + 1 :]
        for _ in range(times[0] if times else 1):
            x = f"regexp_replace({x}, {quoted(p)}, {quoted(to.replace('$', chr(92)))}, '{flags}')"
    return x


TRIM = r"^\s+|\s+$"


def sql_lines(x: str, keep: str) -> str:
    lines = f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: regexp_replace(l, '{TRIM}', '', 'g')), lambda l: l = '' OR ({keep}))"
    return f"regexp_replace(regexp_replace(array_to_string({lines}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '{TRIM}', '', 'g')"


_RAW = ["a\r\nb  \n\n\n\nc", "tab\t\nend ", "nul" + chr(1) + "x", "[12] seen [citation needed] at https://x.y/z and [note]\nHead:\nmore text is here", "plain"]
_r, _r_sql = injected(_RAW)


@query("t1_clean", "SELECT doc_id, " + sql_chain(f"({_r_sql})", [(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), (r"\r\n?", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"^[ \t\n]+|[ \t\n]+$", "")]) + " AS clean FROM documents")
def t1(spark, d):
    return docs(spark, d).select("doc_id", T.clean_text(_r()).alias("clean"))


@query("t2_one_line", f"SELECT doc_id, regexp_replace(regexp_replace({_r_sql}, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS line FROM documents")
def t2(spark, d):
    return docs(spark, d).select("doc_id", T.one_line(_r()).alias("line"))


@query("t3_clean_wiki", "SELECT doc_id, " + sql_lines(sql_chain(f"({_r_sql})", T.WIKI_STEPS), "NOT (length(l) < 20 AND ends_with(l, ':'))") + " AS clean FROM documents")
def t3(spark, d):
    return docs(spark, d).select("doc_id", T.clean_wiki(_r()).alias("clean"))


def _first_sql(x: str, markers) -> str:
    return "coalesce(" + ", ".join(f"nullif(strpos({x}, {quoted(m)}), 0)" for m in markers) + ", 0)"


_BOOK = ["*** START OF THE PROJECT GUTENBERG EBOOK\nbody  of\n\n\n\nthe book\n*** END OF THIS PROJECT GUTENBERG EBOOK", "End of Project Gutenberg tail", "*END*THE SMALL PRINT\nx *** START OF THIS PROJECT GUTENBERG\ny"]
_b, _b_sql = injected(_BOOK)


@query(
    "t5_book_text",
    f"""WITH b AS (SELECT doc_id, {_b_sql} AS t FROM documents),
    m AS (SELECT *, {_first_sql('t', T.BOOK_STARTS)} AS s, {_first_sql('t', T.BOOK_ENDS)} AS e FROM b),
    l AS (SELECT *, CASE WHEN s > 0 AND strpos(substr(t, s), chr(10)) > 0 THEN s - 1 + strpos(substr(t, s), chr(10)) ELSE 0 END AS line FROM m)
    SELECT doc_id, {sql_chain("substr(t, line + 1, greatest(0, CASE WHEN e > 0 THEN e - 1 ELSE length(t) END - line))", [('[ \\t]+', ' '), ('\\n{3,}', chr(10) * 2), (TRIM, '')])} AS body FROM l""",
)
def t5(spark, d):
    return docs(spark, d).select("doc_id", T.book_text(_b()).alias("body"))


def sql_entities(x: str) -> str:
    for a, b in T.ENTITIES:
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    return x


@query(
    "t7_html_text",
    "SELECT page_id, " + sql_lines(sql_chain(sql_entities(sql_chain("html", [(f"(?si)<{t}[^>]*>.*?</{t}>", "") for t in T.HTML_BLOCKS])), [("<[^>]+>", " "), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")]), "length(l) >= 30") + " AS body FROM pages",
)
def t7(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_text(C("html")).alias("body"))


@query("t8_post_text", "SELECT page_id, " + sql_chain(sql_entities("html || '<pre><code>x</code></pre>&lt;b&gt;y'"), [("(?s)<pre><code>.*?</code></pre>", ""), ("(?s)<code>.*?</code>", ""), ("<[^>]+>", " "), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (TRIM, "")]) + " AS body FROM pages")
def t8(spark, d):
    return table(spark, d, "pages").select("page_id", T.post_text(F.concat("html", F.lit("<pre><code>x</code></pre>&lt;b&gt;y"))).alias("body"))


@query("t9_t10_names", r"SELECT page_id, regexp_replace(regexp_replace(substr(regexp_replace(url, '[^\p{L}\p{N}_\s-]', '', 'g'), 1, 80), '^\s+|\s+$', '', 'g'), '\s+', '_', 'g') AS safe, regexp_replace(regexp_replace(substr(regexp_replace(url, '[^\p{L}\p{N}_]', '_', 'g'), 1, 120), '_+', '_', 'g'), '^_|_$', '', 'g') AS url_name FROM pages")
def t9(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_name(C("url")).alias("safe"), T.url_name(C("url")).alias("url_name"))


_GEN = ["<think>so</think> The answer is... 42", "Here's an example: a b", "here is the training example.\nx", "nothing to strip"]
_g, _g_sql = injected(_GEN)


@query("t11_generated", "SELECT doc_id, " + sql_chain(_g_sql, [("</?think>", ""), (TRIM, ""), (r"(?i)^The answer is\.{0,3}\s*", ""), (TRIM, ""), (r"(?i)^(?:Here is|Here's) (?:a |an |the )?(?:training )?example[:.\s]*", ""), (TRIM, "")]) + " AS clean FROM documents")
def t11(spark, d):
    return docs(spark, d).select("doc_id", T.generated_example(_g()).alias("clean"))


@query("t13_context", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE lang || chr(10) || chr(10) || 'Context: ' || source END AS prompt FROM documents")
def t13(spark, d):
    return docs(spark, d).select("doc_id", F.when(C("doc_id") % 3 == 0, C("lang")).otherwise(F.concat("lang", F.lit("\n\nContext: "), "source")).alias("prompt"))


@query("t17_pair_text", "SELECT doc_id, 'User: ' || source || chr(10) || 'Assistant: ' || text AS seq FROM documents")
def t17(spark, d):
    return docs(spark, d).select("doc_id", F.format_string("User: %s\nAssistant: %s", "source", "text").alias("seq"))


@query("t19_paragraphs", "SELECT conv_id, CAST(i - 1 AS INT) AS pos, regexp_replace(p[i], '^\\s+|\\s+$', '', 'g') AS para FROM (SELECT conv_id, string_split(string_agg(text, chr(10) || chr(10) ORDER BY turn), chr(10) || chr(10)) AS p FROM conversations GROUP BY conv_id), unnest(range(1, len(p) + 1)) AS r(i)")
def t19(spark, d):
    from grainmill.operators.conversations import joined

    return joined(table(spark, d, "conversations")).select("conv_id", F.posexplode(F.split("text", "\n\n")).alias("pos", "p")).select("conv_id", "pos", T.trimmed(C("p")).alias("para"))


_STOPS = ["tion", "er ", "zzz"]


@query("t25_stop", f"SELECT doc_id, coalesce(least({', '.join(f'nullif(strpos(text, {quoted(s)}), 0)' for s in _STOPS)}) - 1, -1) AS stop FROM documents")
def t25(spark, d):
    return docs(spark, d).select("doc_id", T.found_stop(C("text"), _STOPS).cast("long").alias("stop"))


_BETWEEN = ("([\\p{L}\\p{M}\\p{N}_])\\.([\\p{L}\\p{M}\\p{N}_])", "$1\ue000$2")
#: T12 without looking around: dots between word characters are put by (twice, as matches may touch), others go.
DEDUP_KEY_SQL = sql_chain(f"lower({sql_chain('text', [(TRIM, '')])})", [("\\s+", " "), _BETWEEN, _BETWEEN, ("\\.", ""), ("\ue000", "."), ("[,;:!?\"'`~@#$%^&*(){}|\\\\<>+=_-]", "")])


@query("t12_dedup_key", f"SELECT doc_id, {DEDUP_KEY_SQL} AS key FROM documents")
def t12(spark, d):
    return docs(spark, d).select("doc_id", T.dedup_key(C("text")).alias("key"))


_WT = ["{{Infobox|a={{b}}}} '''Bold''' [[Target|shown]] and [[plain]] text.<ref>x</ref>", "== Head ==\n* item one\n[[File:a.png|thumb]]\n[http://a.b c d] end of the line that is long enough.", "{| class=x\n|-\n| cell\n|}\n&nbsp;after &amp; more<!-- gone -->"]
_wt, _wt_sql = injected(_WT)


@query("t4_fan_wikitext", "SELECT doc_id, " + sql_chain(_wt_sql, [*T.FAN_STEPS, (TRIM, "")]) + " AS plain FROM documents")
def t4(spark, d):
    return docs(spark, d).select("doc_id", T.fan_wikitext(_wt()).alias("plain"))


@query("t6_dump_wikitext", "SELECT doc_id, " + sql_lines(sql_chain(_wt_sql, T.DUMP_STEPS), "(length(l) >= 30 OR regexp_matches(l, '[.!?:]$')) AND NOT regexp_matches(l, '^[*#;:]+$')") + " AS plain FROM documents")
def t6(spark, d):
    return docs(spark, d).select("doc_id", T.dump_wikitext(_wt()).alias("plain"))





@query("f2_generated_whole", whole(ORACLES["f2_generated"], _ai_sql, "text"))
def f2_whole(spark, d):
    return docs(spark, d).select("doc_id", P.generated_text(C("text")).alias("generated"))


@query("f10_f11_f12_voice_whole", whole(ORACLES["f10_f11_f12_voice"], _v_sql, "text"))
def f10_whole(spark, d):
    return docs(spark, d).select("doc_id", P.boilerplate(C("text")).alias("boilerplate"), P.foreign_identity(C("text")).alias("foreign_identity"), P.stale(C("text")).alias("stale"))


@query("t1_clean_whole", whole(ORACLES["t1_clean"], _r_sql, "text"))
def t1_whole(spark, d):
    return docs(spark, d).select("doc_id", T.clean_text(C("text")).alias("clean"))


@query("t2_one_line_whole", whole(ORACLES["t2_one_line"], _r_sql, "text"))
def t2_whole(spark, d):
    return docs(spark, d).select("doc_id", T.one_line(C("text")).alias("line"))


@query("t3_clean_wiki_whole", whole(ORACLES["t3_clean_wiki"], _r_sql, "text"))
def t3_whole(spark, d):
    return docs(spark, d).select("doc_id", T.clean_wiki(C("text")).alias("clean"))


@query("t5_book_text_whole", whole(ORACLES["t5_book_text"], _b_sql, "text"))
def t5_whole(spark, d):
    return docs(spark, d).select("doc_id", T.book_text(C("text")).alias("body"))


@query("f13_valid_example_whole", whole(ORACLES["f13_valid_example"], _e_sql, "text"))
def f13_whole(spark, d):
    return docs(spark, d).select("doc_id", P.valid_example(C("text"), _st()).alias("valid"))


@query("f14_f15_intent_whole", whole(ORACLES["f14_f15_intent"], _q_sql, "text"))
def f14_whole(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", P.arithmetic(C("text")).alias("arithmetic"), P.memorable(C("text")).alias("memorable"))


@query("f20_tag_rules_whole", whole(ORACLES["f20_tag_rules"], _t_sql, "text"))
def f20_whole(spark, d):
    a, b = F.contains(C("text"), F.lit("<search>")), F.contains(C("text"), F.lit("</search>"))
    return docs(spark, d).filter(F.when(C("doc_id") % 2 == 0, ~(a & b)).otherwise(a | b)).select("doc_id")


@query("t11_generated_whole", whole(ORACLES["t11_generated"], _g_sql, "text"))
def t11_whole(spark, d):
    return docs(spark, d).select("doc_id", T.generated_example(C("text")).alias("clean"))
