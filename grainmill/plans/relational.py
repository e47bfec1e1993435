"""Queries of deduplication (D), joins (J), sets (U) and retrieval (R), with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import text as T
from grainmill.operators import conversations as V
from grainmill.operators import curation as K
from grainmill.operators import retrieval as R
from grainmill.operators.dedup import first_rows, pair_key, paragraphs_once, unseen
from grainmill.operators.ranks import places
from grainmill.plans.filters import DEDUP_KEY_SQL
from grainmill.plans.samples import chosen, quoted, whole
from grainmill.registry import ORACLES, query
from grainmill.tables import table

C = F.col
#: The first line of each text as prompt and all that follows as completion.
PAIRS = "(SELECT doc_id, split_part(text, chr(10), 1) AS prompt, substr(text, length(split_part(text, chr(10), 1)) + 1) AS completion FROM documents)"


def docs(spark, d):
    return table(spark, d, "documents")


def pairs(spark, d):
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    return docs(spark, d).select("doc_id", line.alias("prompt"), F.substr("text", F.length(line) + 1).alias("completion"))


def talk(spark, d):
    return table(spark, d, "conversations")


@query(
    "d1_paragraphs_once",
    r"""WITH c AS (SELECT conv_id % 60 AS k, conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
    t AS (SELECT conv_id AS doc_id, CASE WHEN k < 20 THEN text || chr(10) || chr(10) || first(text) OVER (PARTITION BY k ORDER BY conv_id) ELSE text END AS text FROM c),
    p AS (SELECT doc_id, i AS pos, regexp_replace(a[i], '^\s+|\s+$', '', 'g') AS p FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS a FROM t), unnest(range(1, len(a) + 1)) AS r(i)),
    f AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY doc_id, pos) AS rn FROM p WHERE p <> ''),
    g AS (SELECT doc_id, string_agg(p, chr(10) || chr(10) ORDER BY pos) AS text FROM f WHERE length(p) < 50 OR rn = 1 GROUP BY doc_id)
    SELECT doc_id, text FROM g WHERE length(text) >= 50""",
)
def d1(spark, d):
    from pyspark.sql import Window

    c = V.joined(talk(spark, d)).withColumn("k", C("conv_id") % 60)
    first = F.first("text").over(Window.partitionBy("k").orderBy("conv_id"))
    return paragraphs_once(c.select(C("conv_id").alias("doc_id"), F.when(C("k") < 20, F.concat("text", F.lit("\n\n"), first)).otherwise(C("text")).alias("text")))


@query("d1_lines_once", r"SELECT doc_id, CAST(pos AS INT) AS pos FROM (SELECT doc_id, i - 1 AS pos, l[i] AS x, row_number() OVER (PARTITION BY l[i] ORDER BY doc_id, i) AS rn FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS r(i)) WHERE rn = 1 AND x <> ''")
def d1_lines(spark, d):
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "x")).filter("x <> ''")
    return lines.groupBy(F.sha2("x", 256).alias("k")).agg(F.min(F.struct("doc_id", "pos")).alias("a")).select("a.*")


@query("d2_pairs_once", f"SELECT doc_id, prompt, completion FROM (SELECT *, row_number() OVER (PARTITION BY prompt || completion ORDER BY doc_id) AS rn FROM {PAIRS}) WHERE rn = 1")
def d2(spark, d):
    return first_rows(pairs(spark, d), pair_key(C("prompt"), C("completion")), ["doc_id"])


@query("d3_captions_once", f"SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY sha256(prompt || chr(1) || completion) ORDER BY doc_id) AS rn FROM {PAIRS}) WHERE rn = 1")
def d3(spark, d):
    return first_rows(pairs(spark, d), pair_key(C("prompt"), C("completion"), "\x00"), ["doc_id"]).select("doc_id")


@query("d4_texts_once", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def d4(spark, d):
    return docs(spark, d).groupBy(F.sha2("text", 256).alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(
    "d6_normalised_once",
    f"WITH k AS (SELECT doc_id, {DEDUP_KEY_SQL} AS k FROM documents) SELECT min(doc_id) AS doc_id FROM k WHERE doc_id % 10 <> 0 AND k NOT IN (SELECT k FROM k WHERE doc_id % 10 = 0) GROUP BY k",
)
def d6(spark, d):
    new = docs(spark, d).filter("doc_id % 10 <> 0").select("doc_id", "text")
    old = docs(spark, d).filter("doc_id % 10 = 0").select("text")
    return first_rows(unseen(new, T.dedup_key(C("text")), old, T.dedup_key(C("text"))), F.sha2(T.dedup_key(C("text")), 256), ["doc_id"]).select("doc_id")


@query("d7_batch_add", "SELECT min(doc_id) AS doc_id FROM documents WHERE doc_id % 10 <> 0 AND trim(text) NOT IN (SELECT trim(text) FROM documents WHERE doc_id % 10 = 0) GROUP BY trim(text)")
def d7(spark, d):
    key = F.trim(C("text"))
    new = unseen(docs(spark, d).filter("doc_id % 10 <> 0"), key, docs(spark, d).filter("doc_id % 10 = 0"), key)
    return new.groupBy(F.sha2(F.trim("text"), 256).alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("d8_conversations_once", "SELECT min(conv_id) AS conv_id FROM (SELECT conv_id, string_agg(role || chr(1) || text, chr(2) ORDER BY turn) AS k FROM conversations GROUP BY conv_id) GROUP BY k")
def d8(spark, d):
    c = V.turns(talk(spark, d)).withColumn("k", F.to_json(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))))
    return c.groupBy(F.sha2("k", 256).alias("k")).agg(F.min("conv_id").alias("conv_id")).select("conv_id")


@query("d9_questions_once", f"SELECT min(doc_id) AS doc_id, count(*) AS n FROM {PAIRS} GROUP BY lower(trim(prompt))")
def d9(spark, d):
    return pairs(spark, d).groupBy(F.lower(F.trim("prompt")).alias("q")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


@query("d10_names_once", r"SELECT min(page_id) AS page_id FROM (SELECT page_id, regexp_replace(regexp_replace(substr(regexp_replace(url, '[^\p{L}\p{N}_]', '_', 'g'), 1, 120), '_+', '_', 'g'), '^_|_$', '', 'g') AS k FROM pages) GROUP BY k")
def d10(spark, d):
    return table(spark, d, "pages").groupBy(F.regexp_replace(F.regexp_replace(F.substring(F.regexp_replace("url", "(?U)[^\\w]", "_"), 1, 120), "_+", "_"), "^_|_$", "").alias("k")).agg(F.min("page_id").alias("page_id")).select("page_id")


@query("d11_sites_once", "SELECT lang AS site, arg_max(source, (n, source)) AS source, max(n) AS n FROM (SELECT lower(trim(lang)) AS lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def d11(spark, d):
    n = docs(spark, d).groupBy(F.lower(F.trim("lang")).alias("site"), "source").agg(F.count("*").alias("n"))
    return n.groupBy("site").agg(F.max_by("source", F.struct("n", "source")).alias("source"), F.max("n").alias("n"))


@query("d12_duplicate_ratio", "SELECT source, count(*) - count(DISTINCT text) AS duplicates, round((count(*) - count(DISTINCT text)) / count(*), 6) AS ratio FROM documents GROUP BY source")
def d12(spark, d):
    n = docs(spark, d).groupBy("source", F.sha2("text", 256).alias("k")).agg(F.count("*").alias("n"))
    return n.groupBy("source").agg((F.sum("n") - F.count("*")).alias("duplicates"), F.round((F.sum("n") - F.count("*")) / F.sum("n"), 6).alias("ratio"))


@query("d13_done_keys", "SELECT doc_id, substr(sha256(text), 1, 16) AS key FROM documents WHERE substr(sha256(text), 1, 16) NOT IN (SELECT substr(sha256(text), 1, 16) FROM documents WHERE doc_id % 4 = 0)")
def d13(spark, d):
    key = F.substring(F.sha2("text", 256), 1, 16)
    return unseen(docs(spark, d).withColumn("key", key), C("key"), docs(spark, d).filter("doc_id % 4 = 0"), key).select("doc_id", "key")


@query(
    "j1_answers_titles",
    """WITH q AS (SELECT conv_id, arg_min(text, turn) AS title FROM conversations WHERE role = 'user' AND conv_id % 5 <> 0 GROUP BY conv_id),
    a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND length(text) >= 40)
    SELECT a.conv_id, turn, CASE WHEN title IS NULL THEN 'A: ' || text ELSE 'Q: ' || title || chr(10) || chr(10) || 'A: ' || text END AS body FROM a LEFT JOIN q USING (conv_id)""",
)
def j1(spark, d):
    q = talk(spark, d).filter("role = 'user' AND conv_id % 5 <> 0").groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"))
    a = talk(spark, d).filter("role = 'assistant' AND length(text) >= 40")
    body = F.when(C("title").isNull(), F.concat(F.lit("A: "), "text")).otherwise(F.concat(F.lit("Q: "), "title", F.lit("\n\nA: "), "text"))
    return a.join(q, "conv_id", "left").select("conv_id", "turn", body.alias("body"))


@query(
    "j2_best_reply",
    """WITH m AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_linenumber % 3 END AS rank, CASE WHEN l_partkey % 5 = 0 THEN 'de' ELSE 'en' END AS lang FROM lineitem),
    b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(rank, 999), l_linenumber, lang) AS rn FROM m)
    SELECT o_orderkey, l_linenumber FROM orders JOIN b ON o_orderkey = l_orderkey WHERE rn = 1 AND lang = 'en'""",
)
def j2(spark, d):
    n = C("l_linenumber")
    best = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct(F.coalesce(F.when(n % 4 != 0, n % 3), F.lit(999)), n.alias("n"), F.when(C("l_partkey") % 5 == 0, F.lit("de")).otherwise(F.lit("en")).alias("lang"))).alias("b"))
    return table(spark, d, "orders").join(best, C("o_orderkey") == C("l_orderkey")).filter("b.lang = 'en'").select("o_orderkey", C("b.n").alias("l_linenumber"))


@query(
    "j3_leak_guard",
    """WITH q AS (SELECT conv_id, lower(trim(arg_min(text, turn))) AS k FROM conversations WHERE role = 'user' GROUP BY conv_id)
    SELECT conv_id FROM q WHERE k NOT IN (SELECT k FROM q WHERE conv_id % 25 = 0)""",
)
def j3(spark, d):
    """Conversations whose first question isn't one of the held-out conversations' first questions."""
    q = talk(spark, d).filter("role = 'user'").groupBy("conv_id").agg(F.lower(F.trim(F.min_by("text", "turn"))).alias("k"))
    return unseen(q, C("k"), q.filter("conv_id % 25 = 0"), C("k")).select("conv_id")


@query("j4_existing", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def j4(spark, d):
    return docs(spark, d).select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("j5_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels UNION SELECT item_id FROM benchmark)")
def j5(spark, d):
    done = table(spark, d, "labels").select("doc_id").unionByName(table(spark, d, "benchmark").select(C("item_id").alias("doc_id")))
    return docs(spark, d).select("doc_id").join(done, "doc_id", "left_anti")


_ANS = ["one", "two", "three"]


@query("j6_rotating_answers", f"SELECT doc_id, {chosen(_ANS, 'doc_id')[1]} AS answer FROM documents UNION ALL SELECT doc_id, {chosen(_ANS, '(doc_id + 1)')[1]} AS answer FROM documents")
def j6(spark, d):
    answers = F.array(*map(F.lit, _ANS))
    both = F.array_distinct(F.array(*[F.element_at(answers, ((C("doc_id") + k) % len(_ANS) + 1).cast("int")) for k in (0, 1)]))
    return docs(spark, d).select("doc_id", F.explode(both).alias("answer"))


@query("j6_operand_grid", "SELECT a, b, a + b AS total, a * b AS product FROM range(21) AS x(a), range(21) AS y(b)")
def j6_grid(spark, d):
    n = F.sequence(F.lit(0), F.lit(20)).cast("array<bigint>")
    return spark.range(1).select(F.explode(n).alias("a")).select("a", F.explode(n).alias("b")).select("a", "b", (C("a") + C("b")).alias("total"), (C("a") * C("b")).alias("product"))


_STOP_SQL = "[" + ", ".join(map(quoted, R.STOPWORDS)) + "]"
TERMS = "regexp_extract_all(lower({}), '[a-z0-9'']+')"


@query(
    "j9_fuzzy_match",
    f"""WITH m AS (SELECT doc_id, list_distinct(list_filter({TERMS.format('text')}, lambda x: NOT list_contains({_STOP_SQL}, x))) AS t FROM documents),
    x AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM m),
    k AS (SELECT a.doc_id, b.doc_id AS other, a.n + b.n AS s, count(*) AS k FROM x a JOIN x b ON a.term = b.term AND a.doc_id > b.doc_id AND 2 * least(a.n, b.n) >= greatest(a.n, b.n) GROUP BY ALL)
    SELECT doc_id, min(other) AS replaces FROM k WHERE 2 * k >= s - k GROUP BY doc_id""",
)
def j9(spark, d):
    """The first earlier text that each text is like, over whole texts."""
    return R.alike(docs(spark, d)).filter("other < doc_id").select("doc_id", C("other").alias("replaces"))


@query(
    "r1_bm25",
    f"""WITH d AS (SELECT doc_id, {TERMS.format('text')} AS t FROM documents),
    s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
    p AS (SELECT doc_id, len(t) AS len, term, count(*) AS tf FROM d, unnest(t) AS u(term) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    q AS (SELECT item_id AS query_id, term, count(*) AS times FROM benchmark, unnest({TERMS.format('text')}) AS u(term) GROUP BY ALL),
    x AS (SELECT query_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY ALL)
    SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM x WHERE score > 0) WHERE rank <= 5""",
)
def r1(spark, d):
    return R.bm25(docs(spark, d), table(spark, d, "benchmark").select(C("item_id").alias("query_id"), "text"), 5)


@query("r2_memory_add", "SELECT (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY item_id) AS id, text FROM benchmark UNION ALL SELECT doc_id AS id, text FROM documents WHERE doc_id % 9 <> 0")
def r2(spark, d):
    """Memories are added, and deleted by id."""
    old = docs(spark, d).select(C("doc_id").alias("id"), "text")
    top = old.agg(F.max("id").alias("top"))
    new = table(spark, d, "benchmark").select("item_id", "text")
    placed = new.join(places(new.select("item_id"), ["item_id"]), "item_id").crossJoin(F.broadcast(top)).select((C("top") + C("place") + 1).alias("id"), "text")
    return K.without(old, old.select("id").filter("id % 9 = 0")).unionByName(placed)


_STATUS = "CASE WHEN doc_id % 7 = 0 THEN 'rejected' WHEN doc_id % 3 = 0 OR n_chars > 4000 THEN 'approved' ELSE 'pending' END"


@query("r3_curation", f"SELECT source, {_STATUS} AS status, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY ALL")
def r3(spark, d):
    s = docs(spark, d).withColumn("status", F.expr(_STATUS))
    return s.groupBy("source", "status").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("r3_approved_text", f"SELECT doc_id AS id, text FROM documents WHERE {_STATUS} = 'approved'")
def r3_text(spark, d):
    """What a curated dataset gives to training."""
    return K.training_text(docs(spark, d).select(C("doc_id").alias("id"), "text", "source", F.lit("").alias("stage"), F.expr(_STATUS).alias("status")))


@query(
    "r3_workflow",
    r"""WITH a AS (SELECT doc_id AS id, text, source, CASE WHEN doc_id % 5 = 0 THEN 'approved' ELSE 'pending' END AS status FROM documents),
    n AS (SELECT min(item_id) AS pos, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM benchmark GROUP BY t HAVING t <> '' AND t NOT IN (SELECT text FROM a)),
    b AS (SELECT id, text, source, status FROM a UNION ALL SELECT (SELECT max(id) FROM a) + row_number() OVER (ORDER BY pos), t, 'items', 'pending' FROM n),
    c AS (SELECT id, text, source, CASE WHEN id % 6 = 0 THEN 'approved' WHEN id % 3 = 0 THEN 'rejected' ELSE status END AS status FROM b WHERE id % 10 <> 7)
    SELECT id, source, CASE WHEN status = 'pending' THEN 'rejected' ELSE status END AS status, sha256(text) AS digest FROM c""",
)
def r3_workflow(spark, d):
    """Entries are added, decided one by one (the last decision counts), removed, and the rest rejected."""
    own = docs(spark, d).select(C("doc_id").alias("id"), "text", "source", F.lit("").alias("stage"), F.when(C("doc_id") % 5 == 0, F.lit("approved")).otherwise(F.lit("pending")).alias("status"))
    every = K.added(own, table(spark, d, "benchmark").select(C("item_id").alias("pos"), "text"), "items")
    ids = every.select("id")
    decisions = ids.filter("id % 3 = 0").select(F.lit(1).alias("pos"), "id", F.lit("rejected").alias("status")).unionByName(ids.filter("id % 6 = 0").select(F.lit(2).alias("pos"), "id", F.lit("approved").alias("status")))
    left = K.without(K.decided(every, decisions), ids.filter("id % 10 = 7"))
    return K.all_pending(left, "rejected").select("id", "source", "status", F.sha2("text", 256).alias("digest"))


@query("u1_union_sources", "SELECT 0 AS source_rank, doc_id AS id, length(text) AS n FROM documents UNION ALL SELECT 1, page_id, length(html) FROM pages UNION ALL SELECT 2, item_id, length(text) FROM benchmark")
def u1(spark, d):
    parts = [("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("benchmark", "item_id", "text")]
    out = None
    for i, (t, k, c) in enumerate(parts):
        own = table(spark, d, t).select(F.lit(i).alias("source_rank"), C(k).alias("id"), F.length(c).cast("long").alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


@query("u2_combine", "SELECT sha256(t) AS key, count(*) AS n FROM (SELECT text AS t FROM documents UNION ALL SELECT text FROM conversations) GROUP BY t")
def u2(spark, d):
    return docs(spark, d).select("text").unionByName(talk(spark, d).select("text")).groupBy(F.sha2("text", 256).alias("key")).agg(F.count("*").alias("n"))


@query("u3_minus_skip", "(SELECT lang AS x FROM documents UNION SELECT source FROM documents) EXCEPT SELECT unnest(['src1', 'de'])")
def u3(spark, d):
    both = docs(spark, d).select(C("lang").alias("x")).union(docs(spark, d).select("source")).distinct()
    return both.filter(~C("x").isin("src1", "de"))


@query("u4_jaccard", f"SELECT doc_id, item_id, len(list_intersect(a, b)) AS k, len(list_distinct(list_concat(a, b))) AS n FROM (SELECT doc_id, {TERMS.format('text')} AS a FROM documents) JOIN (SELECT item_id, {TERMS.format('text')} AS b FROM benchmark) ON doc_id = item_id")
def u4(spark, d):
    a = docs(spark, d).select("doc_id", R.terms(C("text")).alias("a"))
    b = table(spark, d, "benchmark").select("item_id", R.terms(C("text")).alias("b"))
    return a.join(b, C("doc_id") == C("item_id")).select("doc_id", "item_id", F.size(F.array_intersect("a", "b")).cast("long").alias("k"), F.size(F.array_union("a", "b")).cast("long").alias("n"))


@query("u5_recrawl", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents WHERE n_chars < 500)")
def u5(spark, d):
    again = table(spark, d, "labels").select("doc_id").intersect(docs(spark, d).filter("n_chars < 500").select("doc_id"))
    return docs(spark, d).select("doc_id").subtract(again)


@query("t14_t16_roles", """SELECT conv_id, max_by(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END) AS last_user,
      min_by(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END) AS first_user,
      min_by(CASE WHEN role = 'assistant' THEN text END, CASE WHEN role = 'assistant' THEN turn END) AS first_answer,
      min_by(CASE WHEN role = 'user' AND turn < coalesce(fa, 1000000) THEN text END, CASE WHEN role = 'user' AND turn < coalesce(fa, 1000000) THEN turn END) AS user_before_answer
    FROM (SELECT *, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS fa FROM conversations) GROUP BY conv_id""")
def t14(spark, d):
    t = V.turns(talk(spark, d))
    return t.select("conv_id", V.last_text(C("t"), "user").alias("last_user"), V.first_text(C("t"), "user").alias("first_user"), V.first_text(C("t"), "assistant").alias("first_answer"), V.first_text(V.before_answer(C("t")), "user").alias("user_before_answer"))


@query("t20_transcript", "SELECT conv_id, string_agg(CASE role WHEN 'system' THEN text WHEN 'assistant' THEN 'Bot: ' || text ELSE 'User: ' || text END, chr(10) ORDER BY turn) || chr(10) || 'Bot:' AS body FROM conversations GROUP BY conv_id")
def t20(spark, d):
    line = lambda x: F.when(x["role"] == "system", x["text"]).when(x["role"] == "assistant", F.concat(F.lit("Bot: "), x["text"])).otherwise(F.concat(F.lit("User: "), x["text"]))
    return V.turns(talk(spark, d)).select("conv_id", F.concat(F.array_join(F.transform("t", line), "\n"), F.lit("\nBot:")).alias("body"))


@query("t21_t22_texts", "SELECT conv_id, lower(trim(min_by(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END))) AS question, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ' ' ORDER BY turn), '') AS answers FROM conversations GROUP BY conv_id")
def t21(spark, d):
    t = C("t")
    return V.turns(talk(spark, d)).select("conv_id", F.lower(F.trim(V.first_text(t, "user"))).alias("question"), F.array_join(F.transform(V.of_role(t, "assistant"), lambda x: x["text"]), " ").alias("answers"))


SOURCE_PAIRS = "(SELECT doc_id, lang || '/' || source AS prompt, text AS completion FROM documents)"


def source_pairs(spark, d):
    """Language and source of each text as prompt and the whole text as completion."""
    return docs(spark, d).select("doc_id", F.concat_ws("/", "lang", "source").alias("prompt"), C("text").alias("completion"))


@query("d2_pairs_once_whole", whole(ORACLES["d2_pairs_once"], PAIRS, SOURCE_PAIRS))
def d2_whole(spark, d):
    return first_rows(source_pairs(spark, d), pair_key(C("prompt"), C("completion")), ["doc_id"])


@query("d3_captions_once_whole", whole(ORACLES["d3_captions_once"], PAIRS, SOURCE_PAIRS))
def d3_whole(spark, d):
    return first_rows(source_pairs(spark, d), pair_key(C("prompt"), C("completion"), "\x00"), ["doc_id"]).select("doc_id")


@query("d9_questions_once_whole", whole(ORACLES["d9_questions_once"], PAIRS, SOURCE_PAIRS))
def d9_whole(spark, d):
    return source_pairs(spark, d).groupBy(F.lower(F.trim("prompt")).alias("q")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


@query("j3_leak_guard_whole", "SELECT doc_id FROM documents WHERE lower(trim(text)) NOT IN (SELECT lower(trim(text)) FROM documents WHERE doc_id % 25 = 0)")
def j3_whole(spark, d):
    key = F.lower(F.trim("text"))
    return unseen(docs(spark, d).withColumn("k", key), C("k"), docs(spark, d).filter("doc_id % 25 = 0"), key).select("doc_id")


@query(
    "j9_fuzzy_match_whole",
    f"""WITH m AS (SELECT conv_id * 1000 + turn AS doc_id, list_distinct(list_filter({TERMS.format('text')}, lambda x: NOT list_contains({_STOP_SQL}, x))) AS t FROM conversations),
    x AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM m),
    k AS (SELECT a.doc_id, b.doc_id AS other, a.n + b.n AS s, count(*) AS k FROM x a JOIN x b ON a.term = b.term AND a.doc_id > b.doc_id GROUP BY ALL)
    SELECT doc_id, min(other) AS replaces FROM k WHERE 2 * k >= s - k GROUP BY doc_id""",
)
def j9_whole(spark, d):
    """The same over the turns of conversations: many short texts."""
    return R.alike(talk(spark, d).select((C("conv_id") * 1000 + C("turn")).alias("doc_id"), "text")).filter("other < doc_id").select("doc_id", C("other").alias("replaces"))


@query("u4_jaccard_whole", f"SELECT conv_id, a.turn, len(list_intersect(a.t, b.t)) AS k, len(list_distinct(list_concat(a.t, b.t))) AS n FROM (SELECT conv_id, turn, {TERMS.format('text')} AS t FROM conversations) a JOIN (SELECT conv_id, turn - 1 AS turn, {TERMS.format('text')} AS t FROM conversations) b USING (conv_id, turn)")
def u4_whole(spark, d):
    """Each turn of a conversation and the next one."""
    a = talk(spark, d).select("conv_id", "turn", R.terms(C("text")).alias("a"))
    b = talk(spark, d).select("conv_id", (C("turn") - 1).alias("turn"), R.terms(C("text")).alias("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.size(F.array_intersect("a", "b")).cast("long").alias("k"), F.size(F.array_union("a", "b")).cast("long").alias("n"))


@query("u5_recrawl_whole", "SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE length(html) < 2000)")
def u5_whole(spark, d):
    """Pages to keep as done: those that were fetched, less those that came back too short."""
    pages = table(spark, d, "pages")
    return pages.select("url").subtract(pages.select("url").intersect(pages.filter("length(html) < 2000").select("url")))
