"""Goldens and properties of operators that SQL can't express, and of readers, writers and streams."""

import random

import pytest
from pyspark.sql import functions as F

from grainmill.functions import scalars, text
from grainmill.functions.bpe import MergeTokenizer, WordTokenizer, marked_words
from grainmill.operators import minhash, mixing, packing, records, series
from grainmill.operators.dedup import paragraphs_once
from grainmill.operators.graph import components
from grainmill.plans.tokens import MERGES, TOKENIZER
from grainmill.sources import readers, sinks
from grainmill.streaming import streams


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_wikitext(spark):
    raw = "{{a|{{b}}}}'''Bold''' [[T|shown]] [[plain]]<ref name=x>r</ref> [http://u.v w]\n== Head ==\n* item\n{|\n|cell\n|}&amp;__TOC__<!-- c -->"
    assert one(spark, text.fan_wikitext, raw) == "Bold shown plain w\nHead\nitem\n&"
    assert one(spark, text.dump_wikitext, "{{x}}'''A''' sentence that is long enough, [[T|shown]].\nshort\nok.") == "A sentence that is long enough, shown.\nok."


def test_dedup_key(spark):
    assert one(spark, text.dedup_key, "  File.write, the END.  (a_b)") == "file.write the end ab"


@pytest.mark.parametrize("expression,value", [("2 + 3 * 4", "14"), ("7 / 2", "3.5"), ("4.0 * 2", "8"), ("2 ** 5000", None), ("x + 1", None), ("1 // 0", None), ("-3 % 5", "2"), ("", None), ("(10**12)**1000", None), ("(10**12)**300", str(10**3600)), ("(10**12)**1000 // (10**12)**999", str(10**12))])
def test_calculator(expression, value):
    assert scalars.calculate(expression) == value


def test_rewards(spark):
    r = spark.createDataFrame([("<think>a</think><answer>1/2</answer>",), ("0.5",), ("none",)], "x string")
    assert [round(x.y, 6) for x in r.select(scalars.reasoning_reward(F.col("x"), F.lit("0.5")).alias("y")).collect()] == [1.0, 0.8, 0.0]


def test_advantages(spark):
    r, v, g, lam = [1.0, 0.0, 2.0], [0.5, 0.2, 0.1], 0.99, 0.95
    want, a = [], 0.0
    for i in (2, 1, 0):
        a = r[i] + g * (v[i + 1] if i < 2 else 0) - v[i] + g * lam * a
        want.insert(0, a)
    got = spark.createDataFrame([(r, v)], "r array<double>, v array<double>").select(series.advantages(F.col("r"), F.col("v"), g, lam).alias("a")).first().a
    assert got == pytest.approx(want)


def test_marked_words():
    assert marked_words("Q: what's it? A: <think>x</think> FAQ: y") == ["<Q>", "what", "'s", "it", "?", "<A>", "<think>", "x", "</think>", "FAQ", ":", "y"]


def test_tokenizer():
    t = MergeTokenizer(MERGES, ["<think>"])
    for x in ("the thé 漢\n  and", "", "<think>then</think>"):
        assert t.decode(t.encode(x)) == x
    assert [t.name_of[i] for i in t.encode("then", ends=False)] == ["the", "n"]
    assert t.encode("a")[0] == t.BEGIN and t.encode("a")[-1] == t.END


def test_best_fit():
    rng = random.Random(1)
    seqs = [list(range(rng.randint(1, 60))) for _ in range(200)]
    rows, spans = packing.best_fit(seqs, 64, 99)
    assert all(len(r) <= 64 for r in rows) and sum(map(len, spans)) == 200
    assert sum(map(len, rows)) >= 0.93 * 64 * len(rows)
    back = sorted(tuple(r[a : b - 1]) for r, s in zip(rows, spans, strict=True) for a, b in s)
    assert back == sorted(map(tuple, seqs))


def test_chat_round_trip():
    m = [{"role": "system", "content": "be kind"}, {"role": "user", "content": "hi <|im_end|> there"}, {"role": "assistant", "content": "<think>hm</think>yes", "tool_calls": [{"name": "f", "arguments": '{"a": 1}'}]}]
    ids, learnt = packing.render(TOKENIZER, m)
    assert ids.count(TOKENIZER.id_of["<|im_end|>"]) == 3 and learnt[-1] and not learnt[0]
    got = packing.parse(TOKENIZER, [i for i, k in zip(ids, learnt, strict=True) if k])
    assert got == {"content": "yes", "tool_calls": [{"name": "f", "arguments": {"a": 1}}], "thinking": "hm"}
    short, _ = packing.render(TOKENIZER, m, most=40)
    assert len(short) <= 40 and short[0] == TOKENIZER.BEGIN


def test_fitted_and_preferences():
    assert packing.fitted(TOKENIZER, "p", "c", 64)[0] == "kept"
    status, p = packing.fitted(TOKENIZER, "word " * 200, "done", 256)
    assert status == "trimmed" and len(packing.render(TOKENIZER, [{"role": "user", "content": p}, {"role": "assistant", "content": "done"}])[0]) <= 257
    assert packing.fitted(TOKENIZER, "p", "x" * 900, 64)[0] == "dropped"
    pair = packing.preference(TOKENIZER, "q", "long answer", "no", 64)
    assert len(pair["chosen"][0]) == len(pair["rejected"][0]) and packing.preference(TOKENIZER, " ", "a", "b", 9) is None
    assert packing.preference(TOKENIZER, None, "a", "b", 9) is None and packing.preference(TOKENIZER, "q", "a", None, 9) is None


def test_next_fit():
    rows = packing.next_fit([([1, 2, 3], [False, True, True]), ([4, 5], [False, True])], 4)
    assert rows == [([1, 2, 3, 4], [2, 3, packing.IGNORE, 5])]


def test_minhash(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here " * 3
    rows = [(1, base), (2, base + "!"), (3, "something else entirely, with other letters"), (4, base), (5, "ab")]
    assert sorted(r.doc_id for r in minhash.keep_longest(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [2, 3, 5]
    a, b = 123456789012345678, (1 << 61) - 3
    import numpy as np

    assert int(minhash.mulmod(np.array([a], np.uint64), np.array([b], np.uint64))[0]) == a * b % ((1 << 61) - 1)


def test_minhash_chain(spark):
    """Forty texts, each near the next one only: their pairs form one chain."""
    pairs = [(i, i + 1) for i in range(40)]
    got = components(spark.createDataFrame(pairs, "u long, v long").repartition(5)).collect()
    assert {r.node: r.root for r in got} == dict.fromkeys(range(41), 0)
    base = [f"{i:03d}" for i in range(400)]
    texts = [(k, " ".join(["x" * 3 + str(k)] * 0 + base[3 * k : 3 * k + 120])) for k in range(40)]
    got = minhash.keep_longest(spark.createDataFrame([*texts, (99, None)], "doc_id long, text string")).collect()
    assert 0 < len(got) <= 41


def test_sequences_of_odd_lines():
    assert records.sequences('{"prompt": "a", "completion": "b"}\n5\n[1]\nnull\n"x"') == ["User: a\nAssistant: b"]
    assert records.sequences('{"prompt": "", "question": "a", "answer": "b"}') == ['{"prompt": "", "question": "a", "answer": "b"}']
    assert records.sequences("{" * 100_000) and records.sequences(None) == [] and records.sequences("Q: a A: b Q: c A: d") == ["User: a\nAssistant: b", "User: c\nAssistant: d"]


def test_paragraphs_of_copies(spark):
    p = "a paragraph that is certainly longer than fifty characters"
    docs = spark.createDataFrame([(i, f"short {i}\n\n{p}\n\n{p} {i}") for i in range(60)] + [(99, None), (98, "")], "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.text for r in paragraphs_once(docs).collect()}
    assert got[0] == f"short 0\n\n{p}\n\n{p} 0" and got[7] == f"short 7\n\n{p} 7" and len(got) == 60


def test_paragraphs(spark):
    p = "a paragraph that is certainly longer than fifty characters"
    got = paragraphs_once(spark.createDataFrame([(1, f"{p}\n\nshort\n\n{p}"), (2, f"{p}\n\nshort")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.text) for r in got] == [(1, f"{p}\n\nshort")]


def test_teachings(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["x", "y"]), (2, ["c"], ["z"])], "id long, questions array<string>, answers array<string>")
    got = sorted((r.prompt, r.completion) for r in mixing.teachings(df).collect())
    assert got == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "z")]
    with pytest.raises(ValueError):
        mixing.search_corpus(df, df, True, True)


def test_readers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.txt").write_text("plain\ntext")
    (tmp_path / "d" / "b.jsonl").write_text('{"text": " one "}\n{broken\n{"text": ""}\n{"other": 1}\n')
    (tmp_path / "c.json").write_text('[{"text": "two"}, {"text": " three "}, {"x": 1}]')
    (tmp_path / "e.json").write_text('{"text": "not a list"}')
    assert sorted(r.text for r in readers.corpus(spark, str(tmp_path)).collect()) == ["one", "plain\ntext", "three", "two"]
    (tmp_path / "p.txt2").write_text("# c\n\n ask \n")
    assert [r.prompt for r in readers.prompts(spark, str(tmp_path / "p.txt2")).collect()] == ["ask"]
    data = readers.token_file([1, 2, 70_000], 100_000)
    (tmp_path / "t.bin").write_bytes(data)
    assert readers.token_files(spark, str(tmp_path / "t.bin")).first().ids == [1, 2, 70_000]
    for bad in (b"NOPE" + data[4:], data[:-1], data[:-4]):
        with pytest.raises(ValueError):
            readers.read_tokens(bad)


def test_dumps(spark, tmp_path):
    body = "A sentence that is long enough to stay. " * 20
    (tmp_path / "w.xml").write_text(f"<m><page><title>Water</title><ns>0</ns><revision><text>{body}</text></revision></page><page><title>Talk:W</title><ns>1</ns><revision><text>{body}</text></revision></page><page><title>R</title><ns>0</ns><redirect title='x'/><revision><text>{body}</text></revision></page></m>")
    assert [r.title for r in readers.wiki_articles(readers.wiki_pages(spark, str(tmp_path / "w.xml"))).collect()] == ["Water"]
    (tmp_path / "p.xml").write_text('<posts><row Id="1" PostTypeId="1" Score="3" Title="T" Body="&lt;p&gt;q&lt;/p&gt;"/><row Id="2" PostTypeId="2" ParentId="1" Score="5" Body="b"/></posts>')
    got = {r.id: r for r in readers.posts(spark, str(tmp_path / "p.xml")).collect()}
    assert got[2].parent == 1 and got[1].title == "T" and got[1].body == "<p>q</p>"


def test_budget(spark):
    df = spark.createDataFrame([(i, "x" * 10) for i in range(20)], "doc_id long, text string")
    got = readers.budgeted(df, 95, "doc_id", batch=30).collect()
    assert len(got) == 10 and {r.file for r in got} == {0, 1, 2, 3}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", "c"), (" ", "c")], "prompt string, completion string")
    assert [r.value for r in sinks.transcript(df).collect()] == ["User: p\n\nAssistant: c\n"]
    sinks.json_lines(df, str(tmp_path / "j"))
    sinks.json_lines(df, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    sinks.batches(df, str(tmp_path / "q"), 1)
    assert sinks.append_checked(df, str(tmp_path / "q"), 2) == 4
    with pytest.raises(ValueError):
        sinks.append_checked(df, str(tmp_path / "q"), 2)


def test_streams(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    good = "A good sentence with many letters. Is it? Yes! " * 15
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    docs([(1, good, "a"), (2, good, "a"), (3, "short", "a")]).write.parquet(src)
    run = lambda: streams.write_once(streams.once(streams.accepted(streams.documents(spark, src))), out, ck).awaitTermination()
    run()
    docs([(4, good, "b"), (5, good + "new", "b")]).write.mode("append").parquet(src)
    run()
    assert spark.read.parquet(out).count() == 2


def test_memories(spark):
    mem = lambda rows: spark.createDataFrame(rows, "id long, text string")
    got = streams.upserted(mem([(1, "my dog is Rex"), (2, "tea at noon")]), mem([(5, "dog called Rex"), (6, "cats sleep")])).collect()
    assert sorted((r.id, r.text) for r in got) == [(1, "dog called Rex"), (2, "tea at noon"), (6, "cats sleep")]


def test_word_tokenizer():
    t = WordTokenizer(["hello", "world"], "abcdefghijklmnopqrstuvwxyz")
    assert len(t.encode("hello world", ends=False)) == 3 and t.decode(t.encode("hello odd  world")) == "hello odd  world"
    assert t.encode("é", ends=False) == [t.UNKNOWN]


def test_sample_corpus(spark):
    rows = readers.sample_corpus(spark, ["one paragraph", "another"], 200).collect()
    assert len({r.text for r in rows}) == len(rows) and sum(len(r.text) for r in rows) >= 150
