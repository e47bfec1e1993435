"""Queries of instruction records (T13 to T27, S20, A2), with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.operators import conversations as V
from grainmill.operators import records as R
from grainmill.plans.samples import quoted
from grainmill.registry import query
from grainmill.tables import table

C = F.col
LINE = r"regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')"
GENERIC = ", ".join(map(quoted, R.GENERIC))


def turns(spark, d, names=None):
    role = (lambda x: x["role"]) if names is None else (lambda x: F.coalesce(F.try_element_at(names, x["role"]), x["role"]))
    return V.turns(table(spark, d, "conversations")).select("conv_id", F.transform("t", lambda x: F.struct(role(x).alias("role"), x["text"].alias("text"))).alias("turns"))


def shared():
    return F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"))


def pick(kind: str, role: str, more: str = "TRUE") -> str:
    return f"{kind}(CASE WHEN role = '{role}' AND {more} THEN x END, CASE WHEN role = '{role}' AND {more} THEN turn END)"


def oracle(kind: str, line: str, more: str = "TRUE", least: int = 2) -> str:
    return f"""WITH c AS (SELECT conv_id, turn, role, {line} AS x FROM conversations),
      f AS (SELECT *, min(CASE WHEN role = 'assistant' AND x <> '' THEN turn END) OVER (PARTITION BY conv_id) AS fa, count(*) OVER (PARTITION BY conv_id) AS n FROM c),
      p AS (SELECT conv_id, {pick(kind, 'system', more)} AS s, {pick(kind, 'user', more)} AS q, {pick(kind, 'assistant', more)} AS a FROM f WHERE x <> '' AND n >= {least} GROUP BY conv_id)
    SELECT conv_id, CASE WHEN lower(coalesce(s, '')) IN ({GENERIC}) THEN q ELSE s || chr(10) || chr(10) || q END AS prompt, a AS completion FROM p WHERE length(q) >= 5 AND length(a) >= 10"""


@query("t14_last_of_roles", oracle("max_by", LINE))
def t14(spark, d):
    return R.last_of_roles(turns(spark, d, shared())).select("conv_id", "prompt", "completion")


@query("t15_first_of_roles", oracle("min_by", r"regexp_replace(text, '^\s+|\s+$', '', 'g')", "role <> 'system'", 1).replace("s || chr(10) || chr(10) || q", "q"))
def t15(spark, d):
    return R.first_of_roles(turns(spark, d, shared())).select("conv_id", "prompt", "completion")


@query("t16_until_answer", oracle("min_by", LINE, "turn <= coalesce(fa, 1000000)", 1))
def t16(spark, d):
    return R.until_answer(turns(spark, d)).select("conv_id", "prompt", "completion")


@query(
    "t13_instructions",
    rf"""WITH x AS (SELECT doc_id, {LINE.replace('text', 'split_part(text, chr(10), 1)')} AS i, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS c, {LINE.replace('text', 'substr(text, length(split_part(text, chr(10), 1)) + 1)')} AS r FROM documents)
    SELECT doc_id, CASE WHEN c = '' THEN i ELSE i || chr(10) || chr(10) || 'Context: ' || c END AS prompt, r AS completion FROM x WHERE length(i) >= 5 AND length(r) >= 10""",
)
def t13(spark, d):
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    x = table(spark, d, "documents").select("doc_id", line.alias("instruction"), F.when(C("doc_id") % 3 == 0, F.lit("")).otherwise(C("source")).alias("context"), F.substr("text", F.length(line) + 1).alias("response"))
    return R.instructions(x).select("doc_id", "prompt", "completion")


@query(
    "j2_replies",
    rf"""WITH m AS (SELECT conv_id * 1000 + turn AS message_id, CASE WHEN role = 'assistant' THEN conv_id * 1000 + turn - 1 - (turn - 1) % 2 END AS parent_id, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'prompter' END AS role,
        CASE WHEN conv_id % 9 = 0 THEN 'de' WHEN conv_id % 2 = 0 THEN 'en' END AS lang, CASE WHEN turn % 4 = 1 THEN NULL ELSE turn % 3 END AS rank, {LINE} AS x, turn AS pos FROM conversations),
      b AS (SELECT parent_id, arg_min(struct_pack(x := x, lang := coalesce(lang, 'en')), (coalesce(rank, 999), pos)) AS b FROM m WHERE role = 'assistant' GROUP BY parent_id)
    SELECT message_id, m.x AS prompt, b.b.x AS completion FROM m JOIN b ON b.parent_id = message_id WHERE role = 'prompter' AND m.parent_id IS NULL AND coalesce(m.lang, 'en') = 'en' AND b.b.lang = 'en' AND length(m.x) >= 10 AND length(b.b.x) >= 10""",
)
def j2(spark, d):
    c, t = C("conv_id"), C("turn")
    a = C("role") == "assistant"
    m = table(spark, d, "conversations").select(
        (c * 1000 + t).alias("message_id"), F.when(a, c * 1000 + t - 1 - (t - 1) % 2).alias("parent_id"), F.when(a, "assistant").otherwise("prompter").alias("role"),
        F.when(c % 9 == 0, "de").when(c % 2 == 0, "en").alias("lang"), F.when(t % 4 != 1, t % 3).alias("rank"), "text", t.alias("pos"),
    )
    return R.replies(m)


@query("t18_sequences")
def t18(spark, d):
    return R.parsed(table(spark, d, "documents").select("doc_id", F.when(C("doc_id") % 3 == 0, F.concat(F.lit("Q: "), F.split_part("text", F.lit(" "), F.lit(1)), F.lit(" A: "), C("text"))).otherwise(C("text")).alias("text")))


@query("t23_last_user", "SELECT conv_id, max_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def t23(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


@query(
    "t24_tools_system",
    f"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Available tools:' || chr(10) || '{{"name":"tool' || p_size || '","description":"","parameters":{{"x":"string"}}}}' || chr(10) || {quoted(R.TOOL_SYNTAX)} END AS body FROM part""",
)
def t24(spark, d):
    spec = F.struct(F.concat(F.lit("tool"), C("p_size").cast("string")).alias("name"), F.lit(None).cast("string").alias("description"), F.create_map(F.lit("x"), F.lit("string")).alias("parameters"))
    none = F.array().cast("array<struct<name:string,description:string,parameters:map<string,string>>>")
    return table(spark, d, "part").select("p_partkey", R.tools_system(F.when(C("p_partkey") % 3 == 0, none).otherwise(F.array(spec))).alias("body"))


@query("t26_prompts", "SELECT doc_id, 'Training example #' || doc_id || ' of 9.' || chr(10) || 'Stage: ' || upper(lang) || ' | Difficulty: ' || upper(source) || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Write ONLY the example, no labels or meta-text. Make it different from previous examples.' AS prompt, 'Question: ' || lang || chr(10) || 'Answer: ' || source || chr(10) || chr(10) AS shots FROM documents")
def t26(spark, d):
    shots = F.array(*[F.struct(C("lang").alias("q"), C("source").alias("a"))] * 2)
    return table(spark, d, "documents").select("doc_id", R.example_prompt(C("doc_id"), 9, C("lang"), C("source"), C("text")).alias("prompt"), R.shots_prefix(shots, 1).alias("shots"))


@query("t27_envelopes", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'call_1' ELSE 'call_0,call_1' END AS ids FROM part")
def t27(spark, d):
    calls = F.array(*[F.struct(n.alias("name"), F.lit("{}").alias("arguments")) for n in (F.when(C("p_partkey") % 3 != 0, F.lit("f")), F.lit("g"))])
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(R.call_envelopes(calls), lambda e: e["id"]), ",").alias("ids"))


@query("a2_row_counts", "SELECT * FROM (SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'benchmark', count(*) FROM benchmark) UNION ALL SELECT 'TOTAL', (SELECT count(*) FROM documents) + (SELECT count(*) FROM pages) + (SELECT count(*) FROM benchmark)")
def a2(spark, d):
    parts = None
    for t in ("documents", "pages", "benchmark"):
        own = table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        parts = own if parts is None else parts.unionByName(own)
    return parts.rollup("name").agg(F.sum("n").alias("n")).select(F.coalesce("name", F.lit("TOTAL")).alias("name"), "n")


@query("u2_combined_pairs", f"SELECT DISTINCT prompt, completion FROM ({oracle('max_by', LINE).split('SELECT conv_id, CASE')[0]} SELECT CASE WHEN lower(coalesce(s, '')) IN ({GENERIC}) THEN q ELSE s || chr(10) || chr(10) || q END AS prompt, a AS completion FROM p WHERE length(q) >= 5 AND length(a) >= 10)")
def u2(spark, d):
    x = R.last_of_roles(turns(spark, d, shared()))
    return R.combined([x, x])
